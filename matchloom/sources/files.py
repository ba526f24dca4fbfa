"""Readers and writers: CSV with all columns as strings, JSON objects, dense arrays, text reports.

Readers give a DataFrame with ``pos``, the row's place in the source, where later steps need it.
"""

from __future__ import annotations

import uuid
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean, collapse
from ..operators.quality import QualityError, no_blank, nonempty, require, require_columns, unique_key, violations
from ..operators.ranges import numbered, running
from ..session import checkpointed
from . import arrays
from .stores import checked_folder

CSV = {"header": True, "escape": '"', "encoding": "UTF-8", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


#: Files' blocks up to which they are summed up in one task and broadcast (some 20 MB); beyond it, by ranges and a shuffled join.
MOST_BLOCKS = 100_000


def natural(name: Column) -> Column:
    """A name's parts, numbers written with 20 digits, so that part-10 comes behind part-9."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(parts, lambda x: F.when(x.rlike(r"^\d") & (F.length(x) < 20), F.lpad(x, 20, "0")).otherwise(x))


def with_pos(rows: DataFrame) -> DataFrame:
    """pos from 1 of rows with __file and __block, in the order of the files' names, blocks and lines.

    Spark packs blocks into tasks by size, so the order of tasks says nothing. A block lies in one task, where
    ascending numbers give the order of its rows; the rows in earlier blocks come from running sums over the blocks.
    The numbers are checkpointed, so that both steps see the same ones.
    """
    spread = checkpointed(rows.withColumn("__at", F.monotonically_increasing_id()))
    blocks = spread.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    blocks, order = checkpointed(blocks.withColumn("__name", natural(F.col("__file")))), ["__name", "__file", "__block"]
    few = blocks.limit(MOST_BLOCKS + 1).count() <= MOST_BLOCKS
    upto = blocks.withColumn("__upto", F.sum("__n").over(Window.orderBy(*order))) if few else running(blocks, [], order, F.col("__n"), "__upto")
    starts = upto.select("__file", "__block", (F.col("__upto") - F.col("__n") - F.col("__first") + 1).alias("__shift"))
    return spread.join(F.broadcast(starts) if few else starts, ["__file", "__block"]).withColumn("pos", F.col("__at") + F.col("__shift")).drop("__file", "__block", "__at", "__shift")


def _files(spark: SparkSession, path: str) -> dict[str, bool]:
    """Each file, and whether a quoted value in it may hold a line end: some line has an odd number of quotes."""
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    rows = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.bool_or(odd).alias("odd")).collect()
    return {unquote(r.file): r.odd for r in rows}


def read_csv(spark: SparkSession, path: str, required: list[str], tidy: bool = True, multi_line: bool | None = None) -> DataFrame:
    """A CSV table with pos: required columns are checked, nameless ones dropped, values cleaned (tidy) or verbatim.

    A byte order mark is skipped. Extra columns stay. Several files count in the order of their names. Files in which quoted
    values hold line ends are looked for, and are one task each; all others are split. multi_line says so for all files.
    """
    reader = lambda whole: spark.read.options(**CSV, multiLine=whole)
    first = reader(multi_line is not False).csv(path)
    require_columns(first, required, path)
    names = [c for c in first.columns if c and not c.startswith("_c")]
    if multi_line is None:
        found = _files(spark, path)
        sources = [(w, sorted(f for f, odd in found.items() if odd == w)) for w in (True, False)] if any(found.values()) else [(False, [path])]
    else:
        sources = [(multi_line, [path])]
    as_read = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names]
    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block")]
    parts = [reader(w).schema(first.schema).csv(paths).select(*as_read, *place) for w, paths in sources if paths]
    return with_pos(reduce(DataFrame.unionByName, parts)).select(*[(clean(F.col(f"`{c}`")) if tidy else F.col(f"`{c}`")).alias(c) for c in names], "pos")


def text_column(columns: list[str], preferred: str = "profile_text", legacy: str | None = "text") -> str:
    return preferred if preferred in columns or legacy is None else legacy


def load_profiles(rows: DataFrame, keys: list[str], label: str, legacy: str | None = None) -> DataFrame:
    """keys, profile_text and pos of a profile table, checked: nothing blank, first key unique, order kept in pos."""
    text = text_column(rows.columns, legacy=legacy)
    require_columns(rows, [*keys, text], label)
    out = rows.select(*[F.btrim(F.coalesce(F.col(f"`{k}`"), F.lit(""))).alias(k) for k in keys], collapse(F.coalesce(F.col(text), F.lit(""))).alias("profile_text"), "pos")
    require(violations(nonempty(out, label), no_blank(out, [*keys, "profile_text"], keys[0]), unique_key(out, keys[0], label)))
    return out


def read_metadata(rows: DataFrame, fields: list[str], label: str) -> DataFrame:
    """Only the asked fields, stripped; none blank, the first one unique."""
    require_columns(rows, fields, label)
    out = rows.select(*[F.btrim(F.coalesce(F.col(f"`{f}`"), F.lit(""))).alias(f) for f in fields], "pos")
    require(violations(nonempty(out, label), no_blank(out, fields, fields[0]), unique_key(out, fields[0], label)))
    return out


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": "", "nullValue": ""}
    rows.select(*[f"`{c}`" for c in columns or rows.columns]).write.mode("overwrite").options(**options).csv(path)


def write_json(stats: DataFrame, path: str) -> None:
    """One-row statistics as a JSON object."""
    stats.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def write_report(lines: DataFrame, path: str, order: list[str]) -> None:
    """A text report from a column line."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)


def read_array(spark: SparkSession, path: str, piece: int = arrays.PIECE) -> DataFrame:
    """pos and embedding of a dense ``.npy`` array, about `piece` bytes a task; pickled content is refused."""
    spark.dataSource.register(arrays.ArraySource)
    return spark.read.format("dense_array").option("path", checked_folder(spark, path)).option("piece", piece).load()


def write_array(vectors: DataFrame, path: str, pos: str = "pos", pieces: bool | None = None) -> None:
    """A dense array file in the order of pos, written by the tasks; see ``arrays``. pieces: for stores without random access, known by the path."""
    spark = vectors.sparkSession
    target = checked_folder(spark, path)
    rows = vectors.select(F.col(pos).cast("long").alias("__pos"), F.col("embedding").cast("array<float>").alias("embedding"))
    size = F.size("embedding")
    n, width, least, low, high, distinct = rows.agg(
        F.count(F.lit(1)), F.coalesce(F.max(size), F.lit(0)), F.coalesce(F.min(size), F.lit(0)), F.min("__pos"), F.max("__pos"), F.countDistinct("__pos")
    ).first()
    if width != least or width < 0:
        raise QualityError(f"vectors have {least} to {width} dimensions")
    if distinct != n:
        raise QualityError(f"{n - distinct} vectors repeat a position or have none")
    if n and (low, high) == (1, n):
        placed = rows.select((F.col("__pos") - 1).alias("at"), "embedding")
    else:
        placed = rows.join(numbered(rows.select("__pos"), [], ["__pos"]), "__pos").select((F.col("nth") - 1).alias("at"), "embedding")
    by_pieces = pieces if pieces is not None else "://" in target and not target.startswith("file:")
    spark.dataSource.register(arrays.ArraySource)
    told = {"path": target, "rows": n, "width": width, "job": uuid.uuid4().hex, "pieces": str(by_pieces).lower()}
    placed.repartitionByRange("at").sortWithinPartitions("at").write.format("dense_array").options(**told).mode("append").save()
