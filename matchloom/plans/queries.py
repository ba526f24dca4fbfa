"""One query an operator, over the driver's tables. Names, columns and results match ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import repeats, sets, text, vectors
from ..functions.numbers import is_finite
from ..functions.tokens import PatternCounter
from ..operators import catalog, embed, match, quality, segment, select_catalog, select_person, stats
from ..operators.ranges import numbered
from ..sources import files
from ..sources.stores import new_folder

Query = Callable[[SparkSession, str], DataFrame]
#: Parameters of the queries: every so many-th vector is a subject, how many candidates each gets, interests that units are scored against.
EVERY, K = 100, 5
INTERESTS = "I enjoy the analysis of data and helping the team with reports."


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Vectors whose id is divisible by EVERY as subjects; all vectors as candidates."""
    e = table(spark, sf, "embeddings")
    users = e.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("user_id"), "embedding")
    return users, e.select(F.col("vec_id").alias("code"), "embedding", F.concat(F.lit("Label "), F.col("label").cast("string")).alias("title"))


def _best(spark: SparkSession, sf: str) -> DataFrame:
    return match.topk(*_sides(spark, sf), K)


def _rounded(best: DataFrame) -> DataFrame:
    return best.select("user_id", "rank", "code", F.round("score", 6).alias("score"))


def topk_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """By the plan that fits the sizes; topk_columns would take some hundred times as long a pair."""
    return _rounded(_best(spark, sf))


def topk_cosine_arrow(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_best(spark, sf))


def topk_cosine_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(match.topk_blocks(*_sides(spark, sf), K, 200))


def rank_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = stats.rank_summary(_best(spark, sf))
    return s.select("rank", "matches", "codes", *[F.round(c, 6).alias(c) for c in ("mean_score", "least_score", "largest_score")])


def match_verification(spark: SparkSession, sf: str) -> DataFrame:
    return quality.match_checks(_best(spark, sf))


def match_report(spark: SparkSession, sf: str) -> DataFrame:
    titled = match.with_titles(_best(spark, sf), _sides(spark, sf)[1].select("code", "title"))
    return titled.select("user_id", "rank", text.match_line(F.col("rank"), F.col("title"), F.col("code").cast("string"), F.round("score", 4)).alias("line"))


def vector_quality(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        "vec_id", F.size(e).alias("width"), F.round(vectors.norm(e), 5).alias("length"), vectors.all_finite(e).alias("finite"), vectors.is_unit(e).alias("unit")
    )


def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.lit("d").alias("source"), F.col("doc_id").alias("id"), "text")
    turns = table(spark, sf, "conversations").select(F.lit("c").alias("source"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return docs.unionByName(turns).select("source", "id", text.clean(F.col("text")).alias("text"))


def scrub_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(text.scrub(F.coalesce("text", F.lit("")))).alias("scrubbed"))


def collapse_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(repeats.normalize(F.coalesce("text", F.lit("")))).alias("normalized"))


def first_nonempty_by_key(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    rows = docs.select(
        F.coalesce("source", F.lit("")).alias("source"), F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("lang"),
        F.when(F.col("doc_id") % 7 < 5, "").otherwise(F.col("text")).alias("text"),
    )
    return catalog.first_nonempty(rows, "source", ["lang", "text"]).select("source", "lang", F.md5("text").alias("text"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("key"), F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("name"),
        F.when(F.col("event_id") % 5 == 0, "LV").otherwise("im").alias("scale"),
        F.when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.format_string("%.1f", F.round(F.col("value"), 0))).alias("value"), F.col("event_id").alias("pos"),
    )


def _best_events(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    return catalog.best_skill(catalog.known(_events(spark, sf), customers, "key"), "key")


def dedup_argmax(spark: SparkSession, sf: str) -> DataFrame:
    return _best_events(spark, sf)


def rank_skills_topn(spark: SparkSession, sf: str) -> DataFrame:
    top = catalog.rank_skills(_best_events(spark, sf), "key", 3)
    in_order = F.array_sort(F.collect_list(F.struct("rank", "name")))
    return top.groupBy("key").agg(F.array_join(F.transform(in_order, lambda x: x["name"]), "; ").alias("skills"), F.max("rank").alias("ranks"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select(
        F.col("conv_id").alias("key"), F.col("turn").alias("pos"), text.clean(F.col("text")).alias("text"),
        F.when(F.col("role") == "assistant", "Core").otherwise("Supplemental").alias("kind"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.length("text").cast("string")).alias("support"),
    )


def _twice(rows: DataFrame) -> DataFrame:
    """Every turn again as a later row of other case, so that duplicates meet."""
    again = rows.select("key", (F.col("pos") + 1000).alias("pos"), F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("text"), F.lit("core").alias("kind"), F.lit("7").alias("support")).where("pos % 2 = 0")
    return rows.unionByName(again)


def dedup_first_position(spark: SparkSession, sf: str) -> DataFrame:
    best = catalog.best_task(_twice(_turns(spark, sf)), "key")
    return best.select("key", "pos", F.md5("text").alias("text"), "core", "support")


def left_join_coverage(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels")
    children = {"labels": labels, "toxic": labels.where("toxic = 1"), "quality": labels.where("quality = 1")}
    return stats.coverage(docs, children, "doc_id")


def profile_render(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("pos"))
    best = orders.groupBy("key", "name").agg(F.max("score").alias("score"))
    tasks = orders.select("key", F.concat(F.lit("Order "), F.col("pos").cast("string"), F.lit(".")).alias("text"), "pos", F.lit(True).alias("core"), F.lit(0.0).alias("support"))
    parents = customers.select(F.col("c_custkey").alias("key"), F.trim("c_name").alias("title"), F.concat("c_mktsegment", F.lit(" in "), "n_name").alias("description"))
    lists = catalog.with_children(parents, best, tasks, "key")
    return lists.select("key", text.render_catalog(F.col("title"), F.col("description"), F.slice("skills", 1, 10), F.transform("tasks", lambda t: t["text"])).alias("profile")).where("profile <> ''")


def content_hash_id(spark: SparkSession, sf: str) -> DataFrame:
    digest = text.content_digest(F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit("")))
    docs = table(spark, sf, "documents").select("doc_id", digest.alias("digest"))
    return numbered(docs, ["digest"], ["doc_id"]).select("doc_id", text.content_id(F.col("digest"), F.col("nth")).alias("user_id"))


def word_sets(spark: SparkSession, sf: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    of = table(spark, sf, "documents").select("doc_id", text.letter_words(t).alias("l"), text.content_words(t).alias("c"))
    return of.select("doc_id", F.size("l").alias("letter_words"), F.size("c").alias("content_words"), F.md5(F.array_join(F.array_sort("c"), " ")).alias("words"))


def set_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Each document against the one before it in its source."""
    docs = table(spark, sf, "documents")
    words = docs.select("doc_id", text.content_words(F.coalesce("text", F.lit(""))).alias("a"))
    before = catalog.previous(docs, "source", "doc_id").where("previous is not null").select("doc_id", "previous")
    rows = before.join(words, "doc_id").join(words.select(F.col("doc_id").alias("previous"), F.col("a").alias("b")), "previous")
    a, b = F.col("a"), F.col("b")
    return rows.select(
        "doc_id", sets.common(a, b).alias("common"), F.round(sets.novelty(a, b), 6).alias("novelty"), F.round(sets.jaccard(a, b), 6).alias("jaccard"),
        F.round(F.coalesce(sets.overlap(a, b), F.lit(0.0)), 6).alias("overlap"), sets.within(a, b).alias("within"), sets.near_duplicate(a, b).alias("alike"),
    )


def stable_distinct_units(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of each document, the first of each key in order."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), text.collapse)
    told = lambda u: F.when(F.size(u) > 0, F.array(F.struct(F.size(u).cast("long").alias("units"), F.md5(F.array_join(u, "|")).alias("text"))))
    return table(spark, sf, "documents").select("doc_id", F.inline(text.once(text.stable_distinct(lines), told)))  # a filter would compute the units again


def sentence_units(spark: SparkSession, sf: str) -> DataFrame:
    turns = segment.with_units(_spread(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id"), F.col("text"))
    return turns.select("conv_id", "turn", *[F.size(c).alias(f"{c}_units") for c in ("experience", "education", "skills")])


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows over all cores, where few bytes stand for much work and a scan or adaptive execution would make one task of them."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, key)


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf, "customer").join(nations, "c_nationkey")


def _clerks(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with their nation's name and the keys and priorities of their orders in order, as (k, p)."""
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").cast("string").alias("k"), F.col("o_orderpriority").alias("p"), F.col("o_orderkey").alias("n")))).alias("orders"))
    in_order = F.array_sort("orders", lambda a, b: F.when(a["n"] < b["n"], -1).when(a["n"] > b["n"], 1).otherwise(0))
    return _customers(spark, sf).join(orders, "c_custkey", "left").withColumn("orders", in_order)


def section_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Resumes made of customers and their orders, with repeated statements, debris, prose that looks like headings and a long list."""
    statements = F.transform("orders", lambda o: F.concat(F.lit("Prepared order "), o["k"], F.lit(" of "), o["p"], F.lit(" with care.")))
    n, long_list = F.col("n_name"), "Managed lots " + " ".join(map(str, range(1, 61))) + " Reviewed them all."
    resume = F.concat_ws(
        " ", F.col("c_mktsegment"), F.lit("CLERK Kim Poe Summary Careful with numbers in"), F.concat(n, F.lit(".")), F.lit("Experience"), F.array_join(statements, " "),
        F.lit("Problem Solving Skills were used."), F.upper(F.get(statements, 0)), F.when(F.col("c_custkey") % 3 == 0, F.lit(long_list)), F.lit("Education Bachelor of Arts :"), n,
        F.lit("College; I like it; M.Ed : Library Studies St. Olga; BA Skills Excel (tables, charts), SQL; etc,"), F.col("c_mktsegment"), F.lit("trade"),
    )
    found = segment.with_sections(_spread(_clerks(spark, sf).select("c_custkey", resume.alias("resume")), "c_custkey"), F.col("resume"))
    return found.select("c_custkey", "title", *[F.array_join(c, " | ").alias(c) for c in ("education", "experience", "skills", "summary")])


def task_priority_first(spark: SparkSession, sf: str) -> DataFrame:
    """The order in which tasks are tried before any is chosen."""
    return select_catalog.priorities(catalog.task_lists(catalog.best_task(_turns(spark, sf), "key"), "key"), "key")


def unit_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of conversations scored as experience units against fixed interests, nothing chosen yet."""
    lines = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "raw"))
    rows = lines.withColumn("unit", text.collapse(F.col("raw")))
    return rows.select("conv_id", "turn", "pos", text.word_count(F.col("unit")).alias("words"), F.round(select_person.scores(F.col("unit"), "Experience", text.content_words(F.lit(INTERESTS))), 6).alias("score"))


def token_stats(spark: SparkSession, sf: str) -> DataFrame:
    audit = stats.token_audit(table(spark, sf, "documents"), PatternCounter.column(F.coalesce("text", F.lit(""))))
    return audit.select("profiles", *[F.round(c, 6).alias(c) for c in ("average_tokens", "median_tokens", "percentage_over_limit")], "minimum_tokens", "maximum_tokens", "profiles_in_245_to_250_range")


def budget_select_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as entities, their orders as tasks and the orders' priorities as skills; some have a task or a skill that never fits."""
    clerks, many = _clerks(spark, sf), " ".join(["lot"] * 300)
    parents = clerks.select(F.col("c_custkey").alias("key"), F.trim("c_name").alias("title"), F.concat("c_mktsegment", F.lit(" in "), "n_name").alias("description"))
    orders = clerks.select(F.col("c_custkey").alias("key"), F.posexplode("orders").alias("pos", "o"))
    tasks = orders.select("key", F.col("pos").cast("long").alias("pos"), F.concat(F.lit("Order "), "o.k", F.lit(".")).alias("text"), (F.col("pos") % 2 == 0).alias("core"), F.col("pos").cast("double").alias("support"))
    tasks = tasks.unionByName(clerks.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("key"), F.lit(-1).cast("long").alias("pos"), F.lit(f"{many}.").alias("text"), F.lit(True).alias("core"), F.lit(99.0).alias("support")))
    skills = orders.select("key", F.col("o.p").alias("name")).distinct().withColumn("score", F.substring("name", 1, 1).cast("double"))
    skills = skills.unionByName(clerks.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("key"), F.lit(many).alias("name"), F.lit(9.0).alias("score")))
    return select_catalog.choose(_spread(catalog.with_children(parents, skills, tasks, "key"), "key"), PatternCounter(), "key")


def budget_select_talks(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as entities: turns as tasks, all their words as skills, so that the budget decides."""
    tasks = catalog.best_task(_turns(spark, sf), "key")
    rated = tasks.select("key", F.explode(text.letter_words(F.col("text"))).alias("name"), "support").groupBy("key", "name").agg(F.max("support").alias("score"))
    parents = tasks.groupBy("key").agg(F.concat(F.lit("Conversation "), F.first("key").cast("string")).alias("title"), F.lit("Turns of a talk.").alias("description"))
    return select_catalog.choose(_spread(catalog.with_children(parents, rated, tasks, "key"), "key"), PatternCounter(), "key")


def budget_select_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Resumes made of customers: a statement that never fits, one that says the same again; some interests are missing or too long."""
    n, long_list = F.col("n_name"), "Counted lots " + " ".join(map(str, range(1, 301))) + "."
    resume = F.concat_ws(
        " ", F.col("c_mktsegment"), F.lit("CLERK Summary Careful with numbers in"), F.concat(n, F.lit(".")), F.lit(f"Experience {long_list} Prepared ledgers for"), n, F.lit("mills in 2011. Prepared ledgers for"), n,
        F.lit("mills. Education Bachelor of Arts :"), n, F.lit("College Skills Excel, SQL"),
    )
    interests = F.when(F.col("c_custkey") % 50 == 0, " ".join(f"aim{k}" for k in range(300))).when(F.col("c_custkey") % 50 == 1, "").otherwise(F.concat(F.lit("I like to find out why figures disagree in "), n, F.lit(".")))
    people = _customers(spark, sf).select(F.col("c_custkey").alias("user_id"), resume.alias("resume"), interests.alias("interests"))
    return select_person.choose(_spread(people, "user_id"), PatternCounter())


def skill_five_number(spark: SparkSession, sf: str) -> DataFrame:
    s = stats.five_numbers(table(spark, sf, "events"), "event_type", "value")
    return s.select("event_type", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "minimum", "maximum", "low_whisker", "high_whisker")], "outliers")


def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.md5(F.coalesce("text", F.lit(""))).alias("k"), F.col("lang").alias("v"))
    pages = table(spark, sf, "pages").select(F.col("url").alias("k"), F.lit("").alias("v"))
    return quality.violations(quality.unique_key(docs, "k", "text"), quality.unique_key(pages, "k", "url"), quality.no_blank(pages, ["v"], "k"))


def ordered_equality(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), "label")
    shifted = rows.select((F.col("pos") + 1).alias("pos"), "label")
    return quality.same_order(rows, shifted, ["label"]).select("rule", "key")


def numbers_parsed(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.numbers import parse_number

    e = table(spark, sf, "events")
    written = F.element_at(F.array(F.col("event_id").cast("string"), F.lit("nan"), F.lit("inf"), F.lit("1d"), F.lit(" 1.5 "), F.lit("1e400"), F.lit("")), (F.col("event_id") % 7 + 1).cast("int"))
    return e.select("event_id", parse_number(written).alias("value")).select("event_id", F.coalesce("value", F.lit(0.0)).alias("support"), is_finite(F.coalesce("value", F.lit(float("nan")))).alias("kept"))


def file_order(spark: SparkSession, sf: str) -> DataFrame:
    """Turns written as CSV in three steps of very different size, each of several files, and read back in the order of the files' names."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    last = turns.agg(F.coalesce(F.max("conv_id"), F.lit(0))).first()[0]
    folder, key = new_folder(spark, "turns"), F.col("conv_id")
    for step, those in {"step-1": key < last // 20, "step-2": key.between(last // 20, last // 3 * 2), "step-10": key > last // 3 * 2}.items():
        files.write_csv(turns.where(those).orderBy("conv_id", "turn"), f"{folder}/{step}")
    back = files.read_csv(spark, f"{folder}/*", ["conv_id", "turn", "text"], tidy=False)
    return back.select("pos", F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.md5(F.regexp_replace("text", r"\r\n?", "\n")).alias("text"))


def array_exchange(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors written to a dense array file by all tasks, in descending order of id, and read back by ranges of rows."""
    vectors_of = table(spark, sf, "embeddings").select((-F.col("vec_id")).alias("pos"), "embedding")
    folder = new_folder(spark, "arrays")
    spark.range(0).write.parquet(folder)  # makes the folder, in any store
    files.write_array(vectors_of, f"{folder}/vectors.npy")
    back, e = files.read_array(spark, f"{folder}/vectors.npy", piece=1 << 20), F.col("embedding")
    return back.select("pos", F.size(e).alias("width"), F.round(e[0].cast("double"), 6).alias("first"), F.round(vectors.dot(e, e), 4).alias("squared"))


def round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """What documents lose and gain where those of one language are written in capitals."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.md5(F.coalesce("text", F.lit(""))).alias("text"))
    changed = docs.withColumn("text", F.when(F.col("lang") == "de", F.upper("text")).otherwise(F.col("text")))
    return quality.round_trip(docs, changed).select(F.col("key").alias("how"), F.get_json_object("detail", "$.doc_id").cast("long").alias("doc_id"), F.get_json_object("detail", "$.text").alias("text"))


def encode_hashing(spark: SparkSession, sf: str) -> DataFrame:
    encoded = embed.encode(table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("profile_text")), embed.HashingEncoder(64))
    e = F.col("embedding")
    return encoded.select("doc_id", F.size(e).alias("width"), vectors.is_unit(e, 2e-5).alias("unit"), F.round(e[0].cast("double"), 4).alias("first"))


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            topk_cosine, topk_cosine_arrow, topk_cosine_blocks, rank_summary, match_verification, match_report, vector_quality, clean_text, scrub_text, collapse_repeats,
            first_nonempty_by_key, dedup_argmax, dedup_first_position, rank_skills_topn, left_join_coverage, profile_render, content_hash_id, word_sets, set_measures,
            stable_distinct_units, sentence_units, section_extract, task_priority_first, unit_scores, token_stats, budget_select_catalog, budget_select_talks, budget_select_profile,
            skill_five_number, duplicate_keys, ordered_equality, numbers_parsed, encode_hashing, file_order, array_exchange, round_trip,
        )
    }
