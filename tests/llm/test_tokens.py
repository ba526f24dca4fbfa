import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from matchloom.llm import common, packing, token_files, tokens
from matchloom.sources import stores

WORD, BYTE = (tokens.vocabulary(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def texts():
    rng = random.Random(1)
    parts = ["a", "B", " ", "\n", "'s", "é", "1", "!", "\t", "£", "<|endoftext|>", "word", "Σ", "İ", "ß"]
    fixed = ["", " ", "a  b", " a", "a\n", "x\ty z", "foo<|endoftext|>bar baz <|endoftext|>", "it's 's  don't", "a\xa0b", "a b c d\x1ce", "ΑΣ ΣΑΣ", "日本 語", "\r\nb", "a ́b", "é É", "'s\n't", "😀 a😀", "<|startoftext|> X"]
    return fixed + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_are_the_librarys(path, monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 300)  # forgets again and again
    known, library = tokens.ChunkEncoder(path), Tokenizer.from_file(path)
    for k in range(0, 1600, 100):
        part = texts()[k : k + 100]
        assert known.encode(part) == [tokens.ids_bytes(e.ids) for e in library.encode_batch(part, add_special_tokens=False)]


@pytest.mark.parametrize("memory", [10, 450_000])
@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_do_not_depend_on_what_came_before(path, memory, monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", memory)
    rng = random.Random(8)
    letters = "aAbBzZéÉëßẞſıİIiΣσςΛλοΟГгґЯяЙйﬁǅǆКKÅÅ日本한글ئآاُ"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(400)]
    chunks = [f(w) + rng.choice(["", "", ",", "!)", "'s", "1"]) for w in [*stems, "λογος", "ΛΟΓΟΣ", "λογοσ"] for f in (str, str.upper, str.lower, str.title)]
    library = Tokenizer.from_file(path)
    for seed in range(2):
        rng.shuffle(chunks)
        known = tokens.ChunkEncoder(path)
        for some in (chunks, chunks[::-1], [" ".join(chunks[k : k + 9]) for k in range(0, len(chunks), 9)]):
            for k in range(0, len(some), 50):
                part = some[k : k + 50]
                assert known.encode(part) == [tokens.ids_bytes(e.ids) for e in library.encode_batch(part, add_special_tokens=False)]


def test_rows_without_id_fill_many_shards(spark, table):
    rows = [(None, "same words here")] * 900 + [(5, "same words here")] * 300 + [(k, f"other {k}") for k in range(100)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = token_files.write_token_files(table(rows), WORD, 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files.shards) > 2 and max(n for _, _, n, _ in files.shards) < 900
    got = sorted(token_files.read_token_files(spark, files).collect(), key=lambda r: r.start)
    assert len(got) == 1300 and [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_planes_round_trip(planes):
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 8, 1000):
        ids = rng.integers(0, 2**32, n, dtype=np.uint32)
        assert (token_files.join_planes(token_files.split_planes(ids, planes), n, planes) == ids).all()


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_files(spark, table, odd, planes, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 1000)
    rows = odd + [(1000 - k, t) for k, t in enumerate(texts()[:80])]
    files = token_files.write_token_files(table(rows), WORD, 2, planes=planes)
    got = token_files.read_token_files(spark, files).collect()
    library, at = Tokenizer.from_file(WORD), 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert len(got) == len(rows)
    for (i, t), r in zip(order, sorted(got, key=lambda r: r.start), strict=True):
        ids = tokens.ids_bytes([*library.encode(t or "", add_special_tokens=False).ids, 2])
        assert (r.doc_id, r.start, bytes(r.ids)) == (i, at, ids)
        at += len(ids) // 4
    assert at == sum(s[3] for s in files.shards)


def test_damaged_shard_is_refused(spark, table, tmp_path):
    files = token_files.write_token_files(table([(1, "a b")]), WORD, 2, folder=str(tmp_path / "ids"))
    path = tmp_path / "ids" / files.shards[0][0]
    path.write_bytes(path.read_bytes()[:-5])
    with pytest.raises(Exception, match="whole shard"):
        token_files.read_token_files(spark, files).collect()


def test_a_folder_of_one_machine_is_refused(spark, monkeypatch):
    monkeypatch.setattr(stores, "is_local", lambda session: False)
    for good in ("s3a://bucket/ids", "file:///mnt/ids", "/" + common.shared_dir(spark).removeprefix("file:").lstrip("/") + "/ids"):
        assert common.checked_folder(spark, good) == good
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.checked_folder(spark, "/tmp/ids")


def test_empty_files(spark, table):
    assert token_files.read_token_files(spark, token_files.write_token_files(table([]), WORD, 2)).collect() == []


def cheapest(marks, costs, length):
    """All cuts by plain quadratic dynamic programming."""
    at, best = [0, *marks], [0] + [None] * len(marks)
    for j in range(1, len(at)):
        sizes = ((at[j] - at[i], best[i]) for i in range(j) if at[j] - at[i] <= length)
        best[j] = min(c + packing.ONE_MORE + costs[j - 1] + (packing.padding(n, length) if costs[j - 1] == 0 or n == length else length - n) for n, c in sizes)
    return best[-1]


def test_cuts_are_the_cheapest():
    rng = random.Random(4)
    for _ in range(200):
        length = rng.choice([8, 16, 32])
        marks = np.cumsum([rng.randint(1, length // 2) for _ in range(rng.randint(1, 30))]).tolist()
        costs = [rng.choice([0, packing.SENTENCE, packing.INSIDE]) for _ in marks]
        costs[-1] = 0
        cuts = packing.best_cuts(marks, costs, [c == 0 for c in costs], length)
        assert cuts[-1] == marks[-1] and all(b - a <= length for a, b in zip([0, *cuts], cuts, strict=False))
        cost_of = dict(zip(marks, costs, strict=True))
        spent = sum(packing.ONE_MORE + cost_of[b] + (packing.padding(b - a, length) if cost_of[b] == 0 or b - a == length else length - (b - a)) for a, b in zip([0, *cuts], cuts, strict=False))
        assert spent == cheapest(marks, costs, length)


def test_pieces(table, odd, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 5000)
    rows = odd + [(1000 + k, t * 20) for k, t in enumerate(texts()[:60])]
    got = packing.pack_documents(table(rows), BYTE, 0).collect()
    library = Tokenizer.from_file(BYTE)
    want = {}
    for i, t in rows:
        want.setdefault((i, zlib.crc32(tokens.ids_bytes([*library.encode(t or "", add_special_tokens=False).ids, 0]))), []).append(1)
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i in {i for i, _ in rows}:
        pieces = sorted(by_doc[i], key=lambda r: (r.sequence_id, r.offset))
        left = {c: len(v) for (j, c), v in want.items() if j == i}
        ids = b""
        for r in pieces:
            assert r.start == len(ids) // 4
            ids += bytes(r.ids)
            if len(ids) // 4 == r.doc_tokens:
                left[zlib.crc32(ids)] -= 1
                ids = b""
        assert not ids and not any(left.values())
    used = padded = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and len(r.ids)
            at += len(r.ids) // 4
        assert at <= packing.LENGTH
        used, padded = used + at, padded + packing.padding(at)
    assert padded < 0.05 * used


def test_no_documents(table):
    assert packing.pack_documents(table([]), BYTE, 0).collect() == []


def test_an_encoder_remembers_as_many_chunks_as_it_may():
    known = tokens.ChunkEncoder(BYTE, 200)
    for k in range(20):
        known.encode([" ".join(f"longchunk{k}x{n}" for n in range(150))])
    known.encode([""])
    assert len(known.later) <= 200
