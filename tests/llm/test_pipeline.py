"""The corpus pipeline against a slow version of each stage, with null and repeated doc_ids, copies and empty texts."""

import random
import zlib
from collections import Counter

import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from matchloom.llm import tokens

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu", "pe") for b in ("ra", "si", "to", "vu", "ze") for c in ("", "n", "st")]
ITEMS = ["If Anna has 3 apples and Bob gives Anna 4 kg of apples, how many apples does Anna carry home?", "a plain question on rivers that flow to the north and on towns beside them"]
SLUR = "blockhead"


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def fingerprint(t):
    w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow(rows):
    """The stages' rows; toxic rows and rows with an item are known by how they were made."""
    stages = [[r for r in rows if SLUR not in (r[1] or "")]]
    norm = lambda r: "".join((r[1] or "").split(" "))
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    best = {}
    for r in sorted(stages[-1], key=lambda r: (-len(r[1] or ""), order(r))):
        best.setdefault(norm(r), r)
    stages.append(list(best.values()))
    prints = [fingerprint(t) for _, t in stages[-1]]
    root = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    first = {}
    for k, r in sorted(enumerate(stages[-1]), key=lambda x: order(x[1])):
        first.setdefault(root[k], r)
    stages.append(list(first.values()))
    stages.append([r for r in stages[-1] if not any(new in (r[1] or "") for new in (*ITEMS, ITEMS[0].replace("Anna", "Mia").replace("3", "8")))])
    return stages


@pytest.fixture
def rows():
    rng = random.Random(6)
    clean = [text(rng, rng.randint(60, 400)) for _ in range(120)]
    out = [(k, t) for k, t in enumerate(clean)] + [(None, text(rng, 80)) for _ in range(6)] + [(7, text(rng, 90)), (7, text(rng, 90)), (None, None), (200, "")]
    out += [(300 + k, f"{text(rng, 60)} {SLUR} {text(rng, 60)}") for k in range(60)]
    out += [(400, clean[3]), (None, clean[3]), (None, clean[4].replace(" ", "  ")), (None, clean[4].replace(" ", "  ")), (401, clean[5] + " end")]
    out += [(k, f"{text(rng, 50)}. {ITEMS[k % 2]} {text(rng, 50)}") for k in (500, 501)] + [(None, f"{text(rng, 50)}. {ITEMS[0].replace('Anna', 'Mia').replace('3', '8')}"), (8, ITEMS[1])]
    return out


def test_all_stages(spark, rows, tmp_path):
    labels = [(k, int(SLUR in (t or ""))) for k, t in rows if k is not None]
    spark.createDataFrame([(k, t, "en", "web", len(t or ""), 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    expected = slow(rows)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        path = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        assert Counter((r.doc_id, r.text or "") for r in docs.collect()) == Counter((i, t or "") for i, t in expected[k]), name
    assert all(c == 1 for c in Counter(expected[-1]).values()) and len(expected[-1]) > 120
    library = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    want = Counter((i, zlib.crc32(tokens.ids_bytes([*library.encode(t or "", add_special_tokens=False).ids, 0]))) for i, t in expected[-1])
    got, held = Counter(), {}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        held[r.doc_id] = (held[r.doc_id] if r.start else b"") + bytes(r.ids)
        if len(held[r.doc_id]) == 4 * r.doc_tokens:
            got[r.doc_id, zlib.crc32(held[r.doc_id])] += 1
    assert got == want


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string"), ("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
