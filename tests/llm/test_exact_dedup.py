import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from matchloom.llm import filters
from matchloom.llm.exact_dedup import exact_duplicates


def brute(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, k))
    out = []
    for norm, members in groups.items():
        members.sort()
        keep = rows[members[0][3]][0]
        for n, m in enumerate(members):
            out.append((rows[m[3]][0], keep, len(members), n == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("salts", [1, 7, 64])
def test_brute_force(table, odd, salts):
    rows = odd + [(100 + k, "hot  text") for k in range(50)] + [(200 + k, f"t {k % 7}" + " " * (k % 3)) for k in range(40)]
    got = exact_duplicates(table(rows), salts).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


@pytest.mark.parametrize("salts", [1, 5])
def test_hot_texts_of_rows_without_id(table, odd, salts):
    """One text, without doc_id or under one and the same, in most rows."""
    rows = odd + [(None, "hot  text")] * 150 + [(9, "hot text ")] * 100 + [(50 + k, "also hot" + " " * (k % 3)) for k in range(60)]
    got = exact_duplicates(table(rows), salts, least_hot=20).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_salts_spread_a_hot_text(spark):
    """Rows of one text have salts by their number, so no join key holds them all."""
    docs = spark.range(0, 4000, 1, 4).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    plan = exact_duplicates(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "pmod(row" in plan
    assert [tuple(r) for r in exact_duplicates(docs).groupBy("kept", "group_size").count().orderBy("kept").collect()] == [(False, 4000, 3999), (True, 4000, 1)]


def test_two_texts_of_one_digest_are_an_error(table, monkeypatch):
    monkeypatch.setattr("matchloom.llm.exact_dedup.F.sha2", lambda c, n: F.lit("ab" * 32))
    for least in (1000, 1):
        with pytest.raises(Exception, match="share one SHA-256"):
            exact_duplicates(table([(k, f"text {k % 3}") for k in range(20)]), least_hot=least).collect()


def test_negative_and_large_ids(table):
    rows = [(-(2**62), "a b"), (2**62, "ab"), (0, "a b"), (-1, "a  b")]
    assert {r.keep_id for r in exact_duplicates(table(rows)).collect()} == {-1}


def test_empty(table):
    assert exact_duplicates(table([])).collect() == []


def test_salts_checked(table):
    with pytest.raises(ValueError):
        exact_duplicates(table([]), 65)


def test_filter_keeps_one_row_a_group(table, odd):
    docs = table(odd)
    kept = filters.without_exact_duplicates(docs)
    assert kept.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in odd})
