import random

import pytest

from matchloom.llm import token_counts, tokens


def expected(path, texts):
    if path.endswith(".model"):
        import sentencepiece

        return [len(ids) for ids in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def stored(spark, folder):
    return spark.read.schema(token_counts.STORED).parquet(folder).where("length(content) > 0")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_are_the_library_s(spark, table, odd, name):
    odd += [(20, "  a<|endoftext|>b  <|ENDOFTEXT|> \t<|startoftext|>"), (21, "İstanbul ΣΑΣ é x y"), (22, "it's \x1c done\x85now")]
    path = tokens.vocabulary(name)
    got = sorted(map(tuple, token_counts.count_tokens(table(odd), path, limit=2).collect()), key=str)
    texts = [t or "" for _, t in odd]
    want = [(i, len(t.encode()), n, n > 2) for (i, _), t, n in zip(odd, texts, expected(path, texts), strict=True)]
    assert got == sorted(want, key=str)


def test_normalisation_changes_no_count(spark):
    rng = random.Random(4)
    parts = ["a", "B", "it's", "'", "s", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", " ", " ", "12", "<|endoftext|>", "<|", "é", "é", "́", "日本", "!", "ß", "İ"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(4000)]
    path = tokens.vocabulary("word_bpe_49k.json")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path).collect()}
    assert [got[k] for k in range(len(texts))] == expected(path, texts)


def test_only_distinct_misses_are_encoded_and_appended(spark, tmp_path):
    folder, path = (tmp_path / "counts").as_uri(), tokens.vocabulary("word_bpe_49k.json")
    docs = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = token_counts.count_tokens(docs(*["one  two"] * 50, "one two", "three", None), path, folder)
    assert first.count() == 53 and stored(spark, folder).where("n_tokens >= 0").count() == 3
    # What is stored is believed: a stored count, changed by hand, comes back.
    version = token_counts.version_digest(path)
    token_counts.count_tokens(docs(" one\ttwo", "four"), path, folder).collect()
    assert stored(spark, folder).count() == 4
    poisoned = stored(spark, folder).where("n_tokens = 2").selectExpr("version", "content", "cast(77 as long) n_tokens")
    rows = poisoned.collect()
    spark.createDataFrame(rows, token_counts.STORED).write.mode("append").parquet(folder)
    assert {r.n_tokens for r in token_counts.count_tokens(docs("one two"), path, folder).collect()} == {77}
    # Another tokenizer shares the folder, not the counts.
    other = tokens.vocabulary("byte_bpe_50k.json")
    assert token_counts.version_digest(other) != version
    assert [r.n_tokens for r in token_counts.count_tokens(docs("one  two"), other, folder).collect()] == expected(other, ["one  two"])
    assert stored(spark, folder).select("version").distinct().count() == 2


def test_empty_table(spark, table):
    assert token_counts.count_tokens(table([]), tokens.vocabulary("word_bpe_49k.json")).collect() == []


def test_given_table(spark, sf):
    from matchloom.llm.queries import op12_token_counts

    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op12_token_counts(spark, sf).collect()}
    texts = [r.text or "" for r in rows]
    want = expected(tokens.vocabulary("word_bpe_49k.json"), texts)
    assert got == {r.doc_id: (len(t.encode()), n, n > 2048) for r, t, n in zip(rows, texts, want, strict=True)}
