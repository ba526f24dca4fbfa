"""Filters tell rows apart by their text too: null and repeated doc_ids lose no clean row and keep no copy."""

import random
from collections import Counter

import pytest

from matchloom.llm import filters

ITEM = "If Anna has 3 apples and Bob gives Anna 4 kg of apples, how many apples does Anna carry home?"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture
def bench(spark):
    return spark.createDataFrame([(1, ITEM)], "item_id long, text string")


def left(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_contaminated_rows_go_alone(table, bench):
    rng = random.Random(1)
    clean = [words(rng, 40) for _ in range(3)]
    docs = table([(None, ITEM), (None, clean[0]), (None, clean[1]), (5, clean[2]), (5, ITEM)])
    assert left(filters.without_contaminated(docs, bench)) == Counter([(None, clean[0]), (None, clean[1]), (5, clean[2])])


def test_near_duplicates_of_rows_without_id(table):
    rng = random.Random(2)
    a, b, c = (words(rng, 200) for _ in range(3))
    docs = table([(1, a), (None, a), (None, b), (2, c), (2, a)])
    assert left(filters.without_near_duplicates(docs)) == Counter([(1, a), (None, b), (2, c)])
    assert left(filters.without_near_duplicates(table([(None, a)] * 5 + [(None, b)] * 2 + [(3, b)]))) == Counter([(None, a), (3, b)])


def test_exact_duplicates_of_rows_without_id(table):
    docs = table([(None, "a b"), (None, "a  b"), (None, None), (None, ""), (3, "c"), (3, "c"), (3, "d"), (4, "d")])
    kept = left(filters.without_exact_duplicates(docs))
    assert {t for _, t in kept} <= {"a  b", None, "", "c", "d"} and sum(kept.values()) == 4 and kept[None, "a  b"] == kept[3, "c"] == kept[3, "d"] == 1


def test_clashing_columns(spark, bench):
    rows = [(1, "one two three four five", 0.1, b"x", 3, 7), (1, "one two three four five", 0.2, b"y", 4, 8), (None, ITEM, 0.3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `__ml_score` double, `__ml_digest` binary, `__ml_id` int, `a.b` int")
    for kept in (filters.without_exact_duplicates(docs), filters.without_near_duplicates(docs)):
        assert kept.columns == docs.columns and kept.count() == 2
    assert filters.without_contaminated(docs, bench).count() == 2
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert filters.without_toxic(docs, labels).columns == docs.columns


def test_decisions_join_by_shuffle_too(table, bench, monkeypatch):
    rng = random.Random(3)
    texts = [words(rng, 60) for _ in range(6)]
    docs = table([(k, t) for k, t in enumerate(texts * 2)] + [(None, texts[0]), (None, ITEM)])
    filter_all = lambda: left(filters.without_contaminated(filters.without_near_duplicates(filters.without_exact_duplicates(docs)), bench))
    one = filter_all()
    monkeypatch.setattr(filters, "SMALL", 0)
    assert filter_all() == one == Counter((k, t) for k, t in enumerate(texts))


def test_empty(table, bench):
    for kept in (filters.without_exact_duplicates(table([])), filters.without_near_duplicates(table([])), filters.without_contaminated(table([]), bench)):
        assert kept.count() == 0
