"""The three lifecycles: catalogue profiles, people's profiles, matching; and encoding between them.

``commands`` has the command lines. Everything is checked before anything is written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_digest, content_id, match_line, render_catalog
from ..functions.tokens import PatternCounter, TokenCounter, counted
from ..operators import catalog, embed, match, quality, select_catalog, select_person, stats
from ..operators.ranges import numbered
from ..schemas import BUDGET, CODE, DESCRIPTION, MODEL_LIMIT, TITLE
from ..session import checkpointed
from ..sources import files


def catalog_lists(occupations: DataFrame, skills: DataFrame, tasks: DataFrame) -> DataFrame:
    """code, title, description, skills, tasks from the three source tables (each with pos)."""
    parents = catalog.first_nonempty(catalog.cleaned(occupations, {CODE: "code", TITLE: "title", DESCRIPTION: "description"}), "code", ["title", "description"])
    rated = catalog.cleaned(skills, {CODE: "code", "Element Name": "name", "Scale ID": "scale", "Data Value": "value"})
    said = catalog.cleaned(tasks, {CODE: "code", "Task": "text", "Incumbents Responding": "support", "Task Type": "kind"}, ("Incumbents Responding", "Task Type"))
    best = catalog.best_skill(catalog.known(rated, parents, "code"), "code")
    return catalog.with_children(parents, best, catalog.best_task(catalog.known(said, parents, "code"), "code"), "code")


def catalog_profiles(lists: DataFrame, top_skills: int = 10, counter: TokenCounter | None = None, budget: int = BUDGET) -> DataFrame:
    """Profiles of ten columns, with code for the sort; an entity that doesn't fit stops the run with all errors."""
    if top_skills < 0:
        raise quality.QualityError("top_skills is below zero")
    shown = F.slice("skills", F.lit(1), F.lit(top_skills)) if top_skills else F.col("skills")
    texts = F.transform("tasks", lambda t: t["text"])
    full = lists.select(
        F.col("code").alias(CODE), F.col("title").alias(TITLE), F.col("description").alias(DESCRIPTION), F.array_join(shown, "; ").alias("Skills"),
        F.array_join(texts, " ").alias("Tasks"), render_catalog(F.col("title"), F.col("description"), shown, texts).alias("full_profile_text"), "code",
    )
    chosen = select_catalog.choose(lists, counter or PatternCounter(), "code", budget)
    return full.join(chosen, "code").where("error is not null or profile_text <> ''")


def no_errors(profiles: DataFrame, key: str) -> DataFrame:
    quality.require(quality.violations(profiles.where("error is not null").select(F.lit("profile").alias("rule"), F.col(f"`{key}`").cast("string").alias("key"), F.col("error").alias("detail"))))
    return profiles.drop("error")


def prepare_catalog(spark: SparkSession, occupations: str, skills: str, tasks: str, output: str | None = None, top_skills: int = 10, counter: TokenCounter | None = None) -> DataFrame:
    """Catalogue profiles from three CSV files, sorted by code."""
    lists = catalog_lists(
        files.read_csv(spark, occupations, [CODE, TITLE, DESCRIPTION]),
        files.read_csv(spark, skills, [CODE, "Element Name", "Scale ID", "Data Value"]),
        files.read_csv(spark, tasks, [CODE, "Task"]),
    )
    done = no_errors(checkpointed(catalog_profiles(lists, top_skills, counter)), "code").orderBy("code").drop("code")
    if output:
        files.write_csv(done, output)
    return done


def identified(people: DataFrame) -> DataFrame:
    """user_id and source_row of people (resume, interests, pos): a content hash and the content's occurrence number."""
    digests = people.select(F.col("pos").alias("__pos"), content_digest(F.col("resume"), F.col("interests")).alias("__digest"))
    ids = numbered(digests, ["__digest"], ["__pos"]).select("__pos", content_id(F.col("__digest"), F.col("nth")).alias("user_id"))
    return people.join(ids, F.col("pos") == F.col("__pos")).drop("__pos").withColumn("source_row", F.col("pos").cast("int"))


def person_profiles(people: DataFrame, counter: TokenCounter | None = None, budget: int = BUDGET) -> DataFrame:
    """Profiles of people with user_id, resume and interests."""
    chosen = select_person.choose(people, counter or PatternCounter(), "user_id", budget)
    return people.select("user_id", "source_row", F.col("resume").alias("original_resume"), F.col("interests").alias("original_interests")).join(chosen, "user_id")


def prepare_people(spark: SparkSession, source: str, output: str | None = None, counter: TokenCounter | None = None) -> DataFrame:
    """People's profiles from a CSV file of resumes and interests, in source order."""
    raw = files.read_csv(spark, source, ["Resume_str", "Generated_Interests"], tidy=False)
    people = identified(raw.select(F.col("Resume_str").alias("resume"), F.col("Generated_Interests").alias("interests"), "pos"))
    quality.require(quality.nonempty(people, "people"))
    done = no_errors(checkpointed(person_profiles(people, counter)), "source_row").drop("title")
    recount = PatternCounter.column(F.col("profile_text")) if counter is None else counted(counter, F.col("profile_text"))
    quality.require(quality.violations(quality.unique_key(done, "user_id", "user ID"), quality.token_recount(done, recount, "user_id", BUDGET, MODEL_LIMIT)))
    done = done.orderBy("source_row")
    if output:
        files.write_csv(done, output)
        files.write_json(stats.run_stats(done, F.col("token_count")), f"{output}.stats.json")
    return done


def encode_profiles(profiles: DataFrame, key: str, encoder: embed.Encoder, counter_column=None, batch_size: int = 32, expected: int | None = None) -> DataFrame:
    """key, other columns and embedding of checked profiles; texts over the model's limit are refused, not cut."""
    tokens = counter_column if counter_column is not None else PatternCounter.column(F.col("profile_text"))
    over = profiles.where(tokens > MODEL_LIMIT).select(F.lit("over the token limit").alias("rule"), F.col(f"`{key}`").alias("key"), tokens.cast("string").alias("detail"))
    rules = [over] + ([quality.row_count(profiles, expected, "users")] if expected else [])
    quality.require(quality.violations(*rules))
    return embed.checked(checkpointed(embed.encode(profiles, encoder, "profile_text", batch_size)), key, encoder.width)


@dataclass
class Matched:
    matches: DataFrame
    report: DataFrame


def match_profiles(
    users: DataFrame, careers: DataFrame, k: int = 5, width: int | None = None, user_stats: DataFrame | None = None, career_stats: DataFrame | None = None,
    user_order: DataFrame | None = None, career_order: DataFrame | None = None, unchecked: tuple[str, ...] = (),
) -> Matched:
    """The k best careers of each user, verified. users: user_id, pos, embedding; careers: code, title, embedding.

    The runs' statistics must name one model; user_order (user_id, pos) and career_order (code, title, pos) are the
    profiles that the vectors were made of, which the vectors must follow row by row. What is not given must be named
    in unchecked: "runs" for both statistics, "user_order", "career_order".
    """
    given = {"runs": (user_stats, career_stats), "user_order": (user_order,), "career_order": (career_order,)}
    lacking = [name for name, tables in given.items() if name not in unchecked and any(t is None for t in tables)]
    if unknown := set(unchecked) - set(given):
        raise quality.QualityError(f"no such check: {', '.join(sorted(unknown))}")
    if lacking:
        raise quality.QualityError(f"matching needs {', '.join(lacking)}, or to be told that they are unchecked")
    quality.require(quality.violations(quality.nonempty(users, "users"), quality.nonempty(careers, "careers")))
    size = width or users.select(F.size("embedding")).first()[0]
    rules = [
        quality.unique_key(users, "user_id", "user ID"), quality.unique_key(careers, "code", "code"), quality.vectors(users, "user_id", size), quality.vectors(careers, "code", size),
    ]
    if "runs" not in unchecked:
        rules.append(quality.same_run(user_stats, career_stats))
    if "user_order" not in unchecked:
        rules.append(quality.same_order(users, user_order, ["user_id"]))
    if "career_order" not in unchecked:
        rules.append(quality.same_order(careers, career_order, ["code", "title"]))
    quality.require(quality.violations(*rules))
    best = checkpointed(match.topk(users, careers, k))
    quality.require(quality.valid_matches(best, k))
    titled = match.with_titles(best, careers.select("code", "title")).join(users.select("user_id", "pos"), "user_id").orderBy("pos", "rank")
    matches = titled.select("user_id", "rank", F.col("code").alias("career_code"), F.col("title").alias("career_title"), F.col("score").alias("cosine_similarity"))
    report = titled.select("pos", "rank", match_line(F.col("rank"), F.col("title"), F.col("code"), F.col("score")).alias("line"))
    return Matched(matches, report)
