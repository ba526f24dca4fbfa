"""Running sums, numbers and quantiles of groups that fill many tasks; coverage and best children in one shuffle."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.operators import catalog, quantiles, ranges, stats
from matchloom.plans import lifecycles


@pytest.fixture(autouse=True)
def apart(spark):
    """Small ranges aren't merged, so that groups do fill several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plan_of(df):
    return df._jdf.queryExecution().toString()


def hot(n, seed=1):
    """(group, value): nine tenths of the rows in one group, few values twice or more."""
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.9 else rng.choice(["a", "b", None]), rng.choice([round(rng.gauss(0, 9), 3), float(rng.randrange(3))])) for _ in range(n)]


def test_numbers_of_a_hot_group(spark):
    rows = [(g, i) for i, (g, _) in enumerate(hot(5000))]
    random.Random(2).shuffle(rows)
    got = ranges.numbered(spark.createDataFrame(rows, "g string, `the id` long").repartition(7), ["g"], ["the id"])
    seen: dict = {}
    want = {}
    for g, i in sorted(rows, key=lambda r: r[1]):
        seen[g] = want[i] = seen.get(g, 0) + 1
    assert {r["the id"]: r.nth for r in got.collect()} == {i: want[i] for i in want}
    # No window is over the group alone, and the hot group is in several ranges.
    assert "windowspecdefinition(g#" not in plan_of(got)
    spread = spark.createDataFrame(rows, "g string, i long").repartitionByRange("g", "i").where("g = 'hot'").groupBy(F.spark_partition_id()).count()
    assert spread.count() > 1


def test_running_sums_without_keys_with_ties_and_nulls(spark):
    rows = [(None, 5, 1), (None, 5, 2), (3, 1, 3), (3, 1, 4), (3, None, 10), (1, 0, 7)]
    df = spark.createDataFrame(rows, "k int, o int, n int")
    got = sorted((r.k or 0, r.o if r.o is not None else -1, r.upto) for r in ranges.running(df, ["k"], ["o"], F.col("n"), "upto").collect())
    ties = {x[2] for x in got if x[:2] == (0, 5)}
    assert ties in ({1, 3}, {2, 3}) and got[2] == (1, 0, 7) and got[3] == (3, -1, 10) and {x[2] for x in got[4:]} in ({13, 17}, {14, 17})
    assert sorted(r.nth for r in ranges.numbered(df, [], ["n"]).collect()) == [1, 2, 3, 4, 5, 6]
    assert ranges.numbered(df.limit(0), ["k"], ["o"]).collect() == []


FRACTIONS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("accuracy", [5, 1000])
def test_exact_quantiles_of_hot_and_small_groups(spark, accuracy):
    rows = [*hot(6000, 3), ("one", 4.0), ("same", 1.5), ("same", 1.5), ("none", None), ("nan", float("nan")), ("nan", 2.0), ("two", 1.0), ("two", 2.0)]
    got = {r.g: r.q for r in quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", FRACTIONS, accuracy).collect()}
    want: dict = {}
    for g, v in rows:
        if v is not None and v == v:
            want.setdefault(g, []).append(v)
    assert set(got) == set(want)
    for g, v in want.items():
        assert got[g] == pytest.approx(np.quantile(v, FRACTIONS).tolist(), abs=1e-9), g


def test_only_values_near_the_ranks_are_counted_one_by_one(spark):
    rows = spark.range(40_000).select((F.col("id") % 10 == 0).alias("g"), F.hash("id").cast("double").alias("v"))
    sketch = rows.groupBy("g").agg(F.percentile_approx("v", [0.498, 0.502], 1000).alias("s")).select("g", F.array(F.struct(F.col("s")[0].alias("low"), F.col("s")[1].alias("high"))).alias("lows"))
    cells = quantiles._cells(rows.withColumnRenamed("v", "__v"), ["g"], sketch)
    assert cells.agg(F.sum("n")).first()[0] == 40_000 and cells.count() < 400


def test_a_missed_bracket_is_counted_again(spark, monkeypatch):
    rows = spark.createDataFrame([("x", float(i)) for i in range(100)] + [("y", 1.0)], "g string, v double")
    real = F.percentile_approx
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda v, asked, accuracy: real(v, [0.9 for _ in asked], accuracy))
    assert {r.g: r.q for r in quantiles.exact_quantiles(rows, ["g"], "v", [0.5]).collect()} == {"x": [49.5], "y": [1.0]}


def test_five_numbers_and_audit(spark):
    rows = hot(3000, 5) + [("hot", 500.0), ("hot", -500.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    r = stats.five_numbers(df, "g", "v").where("g = 'hot'").first()
    v = np.array([x for g, x in rows if g == "hot"])
    q1, q3 = np.quantile(v, 0.25), np.quantile(v, 0.75)
    inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
    assert (r.q1, r.q3, r.low_whisker, r.high_whisker) == pytest.approx((q1, q3, inside.min(), inside.max())) and r.outliers == len(v) - len(inside)
    audit = stats.token_audit(spark.createDataFrame([(n,) for n in (3, 9, 9, 250, 257, 300)], "n int"), F.col("n")).first()
    assert (audit.profiles, audit.median_tokens, audit.minimum_tokens, audit.maximum_tokens, audit.profiles_in_245_to_250_range) == (6, 129.5, 3, 300, 1)
    assert audit.average_tokens == pytest.approx(138) and audit.percentage_over_limit == pytest.approx(100 / 3)
    none = stats.token_audit(spark.createDataFrame([], "n int"), F.col("n")).first()
    assert none.profiles == 0 and none.median_tokens is None


def test_occurrence_numbers_of_one_content(spark):
    """One content in nine tenths of the rows."""
    rows = [("same", "x", i) if i % 10 else (f"own {i}", "x", i) for i in range(1, 2001)]
    people = spark.createDataFrame(rows, "resume string, interests string, pos long").repartition(6)
    done = lifecycles.identified(people)
    ids = [r.user_id for r in done.where("resume = 'same'").orderBy("pos").collect()]
    assert [i.rsplit("_", 1)[1] for i in ids] == [f"{k:02d}" for k in range(1, 1801)] and len(set(ids)) == 1800
    assert done.select("user_id").distinct().count() == 2000 and "windowspecdefinition(__digest#" not in plan_of(done)


def test_coverage_is_one_shuffle(spark):
    parents = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "k int")
    children = {"a": spark.createDataFrame([(1,), (1,), (9,), (None,)], "k int"), "b": spark.createDataFrame([(2,), (3,)], "k int"), "c": parents.limit(0)}
    done = stats.coverage(parents, children, "k")
    assert {r.source: (r.covered, r.lacking, round(r.share, 3)) for r in done.collect()} == {"a": (2, 3, 0.4), "b": (2, 3, 0.4), "c": (0, 5, 0.0)}
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert [r.share for r in stats.coverage(parents.limit(0), children, "k").collect()] == [None] * 3


def test_best_children_of_a_hot_parent(spark):
    """Nine tenths of 5,000 children have one parent; a task hands on only so many of a parent as can be shown."""
    rng = random.Random(7)
    rows = [(1 if i % 10 else i, f"Skill {i}", float(rng.randrange(50))) for i in range(5000)]
    skills = spark.createDataFrame(rows, "k int, name string, score double").repartition(6)
    done = catalog.skill_lists(skills, "k", 3)
    got = {r.k: r.skills for r in done.collect()}
    want: dict = {}
    for k, name, score in sorted(rows, key=lambda r: (-r[2], r[1].lower(), r[1])):
        want.setdefault(k, []).append(name)
    assert got == {k: v[:3] for k, v in want.items()}
    plan = done._jdf.queryExecution().executedPlan().toString()
    before = plan.split("Initial Plan")[-1].split("Exchange hashpartitioning")[1]
    assert "WindowGroupLimit" in before and "Partial" in before
    assert {r.k: r.skills for r in catalog.skill_lists(skills, "k").collect()} == want
