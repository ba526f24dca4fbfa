"""The relational core of the catalogue profiles.

Inputs carry ``pos``, their order in the source; every tie is broken by it. Children are
reduced to a row a parent before they are joined, so joins never multiply rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import parse_number
from ..functions.text import casefold, clean
from ..session import checkpointed


def first_nonempty(rows: DataFrame, key: str, fields: list[str], pos: str = "pos") -> DataFrame:
    """For each key the first non-empty value of every field, each field for itself; blank keys are dropped."""
    firsts = [F.coalesce(F.expr(f"min_by(`{f}`, `{pos}`) FILTER (WHERE `{f}` <> '')"), F.lit("")).alias(f) for f in fields]
    return rows.where(F.col(key) != "").groupBy(key).agg(*firsts)


def known(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent exists. Spark broadcasts the keys if they are few."""
    return children.join(parents.select(key), key, "left_semi")


def best_skill(skills: DataFrame, key: str, scale: str = "IM") -> DataFrame:
    """key, name, score: for each name, whatever its case, the highest score; the earliest row on a tie."""
    rated = (
        skills.where((F.col("name") != "") & (F.upper("scale") == scale))
        .withColumn("score", parse_number(F.col("value")))
        .where(F.col("score").isNotNull())
    )
    best = F.max_by(F.struct("name", "score"), F.struct("score", -F.col("pos")))
    return rated.groupBy(key, casefold(F.col("name")).alias("same")).agg(best.alias("best")).select(key, "best.name", "best.score")


def best_task(tasks: DataFrame, key: str) -> DataFrame:
    """key, pos, text, core, support: the content of the best row, at the place of the first one.

    Best is core before not core, then the larger support, then the earlier row.
    """
    rows = tasks.where(F.col("text") != "").select(
        key, "text", "pos", (F.lower("kind") == "core").alias("core"), F.coalesce(parse_number(F.col("support")), F.lit(0.0)).alias("support")
    )
    best = F.max_by(F.struct("text", "core", "support"), F.struct("core", "support", -F.col("pos")))
    return (
        rows.groupBy(key, casefold(F.col("text")).alias("same"))
        .agg(F.min("pos").alias("pos"), best.alias("best"))
        .select(key, "pos", "best.text", "best.core", "best.support")
    )


def rank_skills(skills: DataFrame, key: str, top: int = 0) -> DataFrame:
    """rank by score, then by name; only the first `top`, or all if it is 0."""
    if top < 0:
        raise ValueError("top must be nonnegative")
    order = Window.partitionBy(key).orderBy(F.desc("score"), casefold(F.col("name")), "name")
    ranked = skills.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top) if top else ranked


def skill_lists(skills: DataFrame, key: str, top: int = 0) -> DataFrame:
    """key, skills: names in rank order, the first `top`, or all if it is 0. With top, each task hands on no more than so many of a parent."""
    shown = rank_skills(skills, key, top) if top else skills
    in_order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), casefold(F.col("name")).alias("l"), F.col("name").alias("name"))))
    return shown.groupBy(key).agg(F.transform(in_order, lambda x: x["name"]).alias("skills"))


def task_lists(tasks: DataFrame, key: str) -> DataFrame:
    """key, tasks: records in order of first appearance."""
    return tasks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "text", "core", "support"))).alias("tasks"))


def with_children(parents: DataFrame, skills: DataFrame, tasks: DataFrame, key: str) -> DataFrame:
    """Parents with both lists; those without children keep empty ones."""
    return (
        parents.join(skill_lists(skills, key), key, "left")
        .join(task_lists(tasks, key), key, "left")
        .withColumn("skills", F.coalesce("skills", F.expr("cast(array() as array<string>)")))
        .withColumn("tasks", F.coalesce("tasks", F.expr("cast(array() as array<struct<pos:bigint,text:string,core:boolean,support:double>>)")))
    )


def previous(rows: DataFrame, group: str, order: str) -> DataFrame:
    """group, order and previous, the order of the row before it in its group (null for the first), for few or hot groups.

    The rows are dealt by ranges of (group, order), so a group may fill many tasks; a range's first row has the
    last one of the ranges before it, of which there are no more than tasks.
    """
    dealt = checkpointed(rows.select(group, order).repartitionByRange(group, order).withColumn("part", F.spark_partition_id()))
    last = dealt.groupBy(group, "part").agg(F.max(order).alias("last"))
    border = last.withColumn("border", F.lag("last").over(Window.partitionBy(group).orderBy("part"))).drop("last").withColumnRenamed(group, "of")
    inside = dealt.withColumn("inside", F.lag(order).over(Window.partitionBy(group, "part").orderBy(order)))
    joined = inside.join(border.withColumnRenamed("part", "of_part"), F.col(group).eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    return joined.select(group, order, F.coalesce("inside", "border").alias("previous"))


def cleaned(rows: DataFrame, names: dict[str, str], optional: tuple[str, ...] = ()) -> DataFrame:
    """Source columns under new names, cleaned; optional ones that are absent are empty. Keeps pos."""
    columns = [
        (clean(F.col(f"`{old}`")) if old in rows.columns or old not in optional else F.lit("")).alias(new) for old, new in names.items()
    ]
    return rows.select(*columns, "pos")
