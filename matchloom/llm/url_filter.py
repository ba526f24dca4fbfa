"""URL filter: a blocked Bloom filter in front of an exact hash join.

A list of canonical entries ``host/path`` stands for hosts (with all subdomains) and path
prefixes. Rules are compared with a url's host and path as they stand; the list of blocked urls with
canonical ones (``canonical``). A url asks for every pair of one of its host suffixes, up to as many labels as
an entry has, and one of the path lengths that occur. The keys pass a blocked Bloom filter first (one
64-bit block a key, four bits in it); the few possible hits go to an exact equi join with the entries,
which removes the false positives. Of several fitting entries the longest wins.

The filter is built where the list is: each key's block bits are OR-ed by ``bit_or`` in a
group-by. Rows without a possible hit, the bulk, never leave their task: only the others go through the join and the
group-by. Only filters of at most ``max_blocks`` 64-bit words are sent to the executors
(parameter, 1,048,576: 8 MB); a larger list keeps that size and merely passes more false
positives on to the join, whose strategy Spark chooses by size.

Defined results: a null url, or one without ``://``, has empty host and path, no rule and
the verdict of an unlisted url; an empty list or table works; rows that repeat a page_id are
each judged; of rules with one entry the first verdict by name counts; very long urls are read whole; other columns are not
looked at.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values of the production query: (entry, verdict).
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Listed canonical urls, which the method blocks where no rule speaks.
LISTED = ["cheap-pills.example.com/", "spam-farm.example.org/", "casino-bonus.example.org/", "free-downloads.example.com/"]
MAX_BLOCKS = 1 << 20


def host_and_path():
    """Columns host and path of the column __url."""
    rest = F.when(F.instr("__url", "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)"))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def canonical(host: Column, path: Column) -> tuple[Column, Column]:
    """Host without user, port and final dots; path unescaped, without empty, ``.`` and ``..`` segments, / if empty.

    A path with an escape that can't be read is left escaped.
    """
    plain_host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")
    unescaped = F.when(F.contains(path, F.lit("%")), F.coalesce(F.try_url_decode(F.regexp_replace(path, r"\+", "%2B")), path)).otherwise(path)

    def resolved(p: Column) -> Column:
        step = lambda s, x: F.when(x.isin("", "."), s).when(x == "..", F.regexp_replace(s, r"/[^/]*$", "")).otherwise(F.concat(s, F.lit("/"), x))
        kept = F.aggregate(F.split(p, "/"), F.lit(""), step)
        return F.concat(kept, F.when(p.rlike(r"(^|/)\.{0,2}$"), F.lit("/")).otherwise(F.lit("")))

    plain_path = bound(unescaped, lambda p: F.when(p == "", F.lit("/")).when(p.rlike(r"//|/\.|^[^/]"), resolved(p)).otherwise(p))
    return plain_host, plain_path


def _mask(h):
    """Four of 64 bits from a 64-bit hash."""
    return F.expr(
        f"shiftleft(1L, cast({h} & 63 as int)) | shiftleft(1L, cast(shiftright({h}, 6) & 63 as int))"
        f" | shiftleft(1L, cast(shiftright({h}, 12) & 63 as int)) | shiftleft(1L, cast(shiftright({h}, 18) & 63 as int))"
    )


def blocked_bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, bits) of the filter over the column key."""
    hashed = keys.select(F.xxhash64("key").alias("h"))
    return (
        hashed.select(F.expr(f"cast(shiftrightunsigned(h, 24) % {blocks} as int)").alias("block"), _mask("h").alias("bits"))
        .groupBy("block")
        .agg(F.bit_or("bits").alias("bits"))
    )


def filter_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url).

    rules: columns entry (``host/path``) and verdict; the longest fitting rule decides, of equal
    rules the first verdict by name. listed: column entry; a url that no rule fits is blocked if
    one of these fits it, else allowed. Both go through one filter and one join.
    """
    spark = pages.sparkSession
    entries = (
        rules.select(F.col("entry"), F.lit(1).alias("tier"), F.col("verdict").alias("said"))
        .unionByName(listed.select(F.col("entry"), F.lit(0).alias("tier"), F.lit("block").alias("said")))
        .where(F.instr("entry", "/") > 1)
        .groupBy("entry", "tier")
        .agg(F.min("said").alias("said"))
        .withColumn("key", F.concat_ws(" ", F.col("tier").cast("string"), "entry"))
    )
    n = entries.count()
    shapes = entries.groupBy("tier").agg(
        F.sort_array(F.collect_set(F.expr("length(entry) - instr(entry, '/') + 1"))).alias("lengths"), F.max(F.expr("size(split(split(entry, '/')[0], '[.]'))")).alias("labels")
    )
    shape = {r.tier: (r.lengths, r.labels) for r in shapes.collect()}
    blocks = max(64, min(max_blocks, 1 << (n // 4).bit_length()))
    words = [0] * blocks
    for row in blocked_bloom(entries, blocks).toLocalIterator():
        words[row.block] = row.bits
    filter_words = spark.sparkContext.broadcast(words)

    def possible(keys: pd.Series, hashes: pd.Series) -> pd.Series:
        import numpy as np

        table = np.array(filter_words.value, dtype=np.int64).view(np.uint64)
        sizes = np.fromiter((len(k) for k in keys), dtype=np.int64, count=len(keys))
        if not sizes.sum():
            return pd.Series([[] for _ in keys])
        h = np.concatenate([np.asarray(x, dtype=np.int64) for x in hashes]).view(np.uint64)
        block = (h >> np.uint64(24)) % np.uint64(len(table))
        mask = np.zeros(len(h), dtype=np.uint64)
        for shift in (0, 6, 12, 18):
            mask |= np.uint64(1) << ((h >> np.uint64(shift)) & np.uint64(63))
        hit = (table[block.astype(np.int64)] & mask) == mask
        ends = np.cumsum(sizes)
        return pd.Series([[k for k, ok in zip(ks, hit[e - s : e], strict=True) if ok] for ks, s, e in zip(keys, sizes, ends, strict=True)])

    #: Called nondeterministic, so that the filters below its result don't run it once more.
    possible = F.pandas_udf(possible, T.ArrayType(T.StringType())).asNondeterministic()

    def keys(tier: int, host: str, path: str) -> Column:
        """Every pair of a host suffix and a path prefix that an entry of the tier may be."""
        lengths, labels = shape.get(tier, ([], 1))
        parts = bound(F.split(F.col(host), r"\."), lambda p: F.transform(F.sequence(F.greatest(F.size(p) - labels + 1, F.lit(1)), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), ".")))
        whole = F.array(*[F.lit(x) for x in lengths]).cast("array<int>")
        prefixes = F.transform(F.filter(whole, lambda k: k <= F.length(path)), lambda k: F.substring(path, 1, k))
        return bound(prefixes, lambda ps: F.flatten(F.transform(parts, lambda s: F.transform(ps, lambda p: F.concat(F.lit(f"{tier} "), s, p)))))

    host, path = host_and_path()
    plain_host, plain_path = canonical(F.col("host"), F.col("path"))
    parsed = (
        pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("__url"))
        .select("page_id", host.alias("host"), path.alias("path"))
        .withColumn("row", F.monotonically_increasing_id())
        .withColumns({"plain_host": plain_host, "plain_path": plain_path})
        .withColumn("keys", F.concat(keys(1, "host", "path"), keys(0, "plain_host", "plain_path")))
        .withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k)))
        .select("row", "page_id", "host", "path", possible("keys", "hashes").alias("hits"))
    )
    hit = F.size("hits") > 0
    allowed = parsed.where(~hit).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    asked = parsed.where(hit).select("row", "page_id", "host", "path", F.explode("hits").alias("key"))
    found = F.when(F.col("said").isNotNull(), F.struct("tier", F.length("entry").alias("n"), "entry", "said"))
    ruled = F.col("found.tier") == 1
    judged = (
        asked.join(entries, "key", "left")
        .groupBy("row", "page_id", "host", "path")
        .agg(F.max(found).alias("found"))
        .select("page_id", "host", "path", F.when(ruled, F.col("found.entry")).alias("rule"), F.coalesce("found.said", F.lit("allow")).alias("verdict"))
    )
    return allowed.unionByName(judged)


def production_lists(spark: SparkSession, listed: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rules and listed entries; listed: a Parquet table with the column entry, instead of LISTED."""
    rows = spark.read.parquet(listed).select("entry") if listed else spark.createDataFrame([(x,) for x in LISTED], "entry string")
    return spark.createDataFrame(RULES, "entry string, verdict string"), rows
