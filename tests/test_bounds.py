"""What a task holds at once, and what is computed for a row no more than once."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from matchloom.functions import repeats
from matchloom.operators import embed, match, segment
from matchloom.session import BATCH, make_visible


def test_repeats_hold_the_words_of_one_slice(monkeypatch):
    """The words of a whole batch took some thirty times its bytes."""
    texts = [f"row {n} says {n} this again this again and ends" for n in range(300)] + ["", "one two " * 500]
    want, held = repeats.without_repeats(texts), []
    whole = repeats.without_repeats
    monkeypatch.setattr(repeats, "without_repeats", lambda some: held.append(sum(map(len, some))) or whole(some))
    monkeypatch.setattr(repeats, "SLICE_BYTES", 1000)
    assert repeats._of_texts(pa.array(texts)).to_pylist() == want
    assert max(held[:-1]) <= 1000 and len(held) > 10
    rows = [[texts[:7], []], [], [texts[7:], [""]]]
    got = repeats._of_lists(pa.array(rows, pa.list_(pa.list_(pa.string())))).to_pylist()
    assert got == [[whole(u) for u in row] for row in rows]
    assert repeats._of_lists(pa.array([], pa.list_(pa.list_(pa.string())))).to_pylist() == []


def test_a_slice_of_an_array_keeps_its_own_lists():
    rows = pa.array([[["a b a b"]], [["c d c d"], ["e"]], [[]]], pa.list_(pa.list_(pa.string())))
    assert repeats._of_lists(rows.slice(1)).to_pylist() == [[["c d"], ["e"]], [[]]]


def test_headings_are_sought_once_a_row(spark):
    """They were sought again for each category."""
    rows = segment.with_sections(spark.createDataFrame([("Clerk Summary Calm. Skills Excel, SQL",)], "t string"), F.col("t"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Activities and Honors\\b") == 1


def test_copies_tie_wherever_they_stand_and_few_scores_are_held(monkeypatch):
    """Matrix products may round copies apart, and a broadcast of all candidates grew with them."""
    rng = np.random.default_rng(3)
    them = rng.normal(size=(700, 64)).astype(np.float32)
    them[rng.integers(0, 700, 300)] = them[5]
    them = (them / np.linalg.norm(them, axis=1, keepdims=True)).astype(np.float32).astype(float)
    us = them[::9]
    exact = np.zeros((len(us), len(them)))
    for x, y in zip(us.T, them.T):
        exact += x[:, None] * y
    codes = rng.permutation(700)
    for size in (3, 37, 4096):
        monkeypatch.setattr(match, "CANDIDATES", size)
        monkeypatch.setattr(match, "SUBJECTS", 10 * size)
        best = match.Best(us, 5)
        for a in range(0, 700, 111):
            best.add(them[a : a + 111], codes[a : a + 111])
        got = best.table(pa.array(range(len(us))), pa.int64()).to_pylist()
        want = [(i, codes[j]) for i, row in enumerate(np.clip(exact, -1, 1)) for j in np.lexsort((codes, -row))[:5]]
        assert [(r["user_id"], r["code"]) for r in got] == want


def test_the_smaller_side_is_broadcast(spark):
    e = [[1.0, 0.0], [0.0, 1.0], [0.6, 0.8]]
    users = spark.createDataFrame([(n, e[n]) for n in range(2)], "user_id int, embedding array<float>")
    careers = spark.createDataFrame([(c, v) for c, v in zip("abc", e)], "code string, embedding array<float>")
    sides = (users, careers), (users.union(users.selectExpr("user_id + 2", "embedding")), careers)
    for us, them in sides:
        assert [tuple(r) for r in match.topk_arrow(us, them, 2).select("user_id", "rank", "code").orderBy("user_id", "rank").limit(4).collect()] == [(0, 1, "a"), (0, 2, "c"), (1, 1, "b"), (1, 2, "c")]


def test_texts_are_encoded_a_few_at_once(spark, monkeypatch):
    """A batch's texts were Python strings all at once, and long ones were encoded 32 together."""
    monkeypatch.setattr(embed, "BATCH_BYTES", 100)
    texts = ["a" * 30, None, "b" * 250, "c", "", "d" * 99, "e"]
    assert list(embed.in_turn(pa.array(texts), 3)) == [["a" * 30, ""], ["b" * 250], ["c", "", "d" * 99], ["e"]]
    assert list(embed.in_turn(pa.array([], pa.string()), 3)) == []
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n long, profile_text string")
    got = [r.embedding for r in embed.encode(rows, embed.HashingEncoder(8), batch_size=2).orderBy("n").collect()]
    assert got == [v.tolist() for v in embed.HashingEncoder(8).encode([t or "" for t in texts])]


def test_workers_get_batches_of_bounded_bytes(spark):
    """All of 10,000 rows up to 64 MB came at once, whatever the texts' length."""
    rows = make_visible(spark).range(0, 600, 1, 1).select(F.repeat(F.lit("word "), 10_000).alias("t"))  # 30 MB in one task

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["n", "rows"])

    got = rows.mapInArrow(sizes, "n long, rows long").collect()
    assert sum(r.rows for r in got) == 600 and max(r.n for r in got) < 6 << 20


def test_a_batch_size_that_was_chosen_stays(spark):
    try:
        spark.conf.set(BATCH, "1000000b")
        assert make_visible(spark).conf.get(BATCH) == "1000000b"
    finally:
        spark.conf.unset(BATCH)
