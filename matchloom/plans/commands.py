"""Command lines of the five steps: ``python -m matchloom.plans.commands STEP ...``.

Each step reads what the ones before have written into the data folder: profiles as CSV, vectors as Parquet with
their ids, run statistics as JSON. ``--vocabulary`` names a WordPiece vocabulary for exact token counts, ``--encoder``
the published model (default) or hashing, which needs no file.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import TokenCounter, WordPieceCounter, counted
from ..operators import embed, quality, stats
from ..schemas import CODE, MODEL_NAME, MODEL_REVISION, TITLE
from ..session import make_visible
from ..sources import files, resolve
from . import lifecycles

#: Names of the files in the data folder.
OCCUPATIONS, SKILLS, TASKS = "occupations.csv", "skills.csv", "tasks.csv"
CAREERS, USERS = "processed_career_profiles.csv", "processed_user_profiles.csv"
CAREER_VECTORS, USER_VECTORS, MATCHES = "career_vectors", "user_vectors", "career_matches.csv"


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="matchloom")
    steps = parser.add_subparsers(dest="step", required=True)

    def step(name: str, *flags: tuple[str, dict]) -> None:
        one = steps.add_parser(name)
        for flag, how in (*flags, ("--vocabulary", {}), ("--encoder", {"choices": ["published", "hashing"], "default": "published"})):
            one.add_argument(flag, **how)

    folder, output = ("--data-dir", {"default": "DATA"}), ("--output", {})
    batch = ("--batch-size", {"type": int, "default": 32})
    step("prepare-careers", folder, output, ("--top-skills", {"type": int, "default": 10}), *((f"--{n}", {"default": f}) for n, f in (("occupations", OCCUPATIONS), ("skills", SKILLS), ("tasks", TASKS))))
    step("embed-careers", folder, batch)
    step("prepare-users", folder, output, ("--input", {}))
    step("embed-users", folder, batch, ("--expected-users", {"type": int, "default": 20}))
    step("match", folder, output)
    return parser


def _encoder(args: argparse.Namespace) -> tuple[embed.Encoder, str, str]:
    if args.encoder == "hashing":
        encoder = embed.HashingEncoder()
        return encoder, "hashing", str(encoder.width)
    return embed.SentenceEncoder(), MODEL_NAME, MODEL_REVISION


def _counter(args: argparse.Namespace) -> TokenCounter | None:
    return WordPieceCounter(args.vocabulary) if args.vocabulary else None


def _tokens(args: argparse.Namespace):
    text = F.col("profile_text")
    counter = _counter(args)
    return counted(counter, text) if counter else lifecycles.PatternCounter.column(text)


def prepare_careers(spark: SparkSession, args: argparse.Namespace) -> str:
    paths = [resolve.only_one(spark, args.data_dir, n) for n in (args.occupations, args.skills, args.tasks)]
    output = args.output or f"{args.data_dir}/{CAREERS}"
    done = lifecycles.prepare_catalog(spark, *paths, output=output, top_skills=args.top_skills, counter=_counter(args))
    return f"{done.count()} career profiles in {output}"


def prepare_users(spark: SparkSession, args: argparse.Namespace) -> str:
    source = args.input or resolve.find_input(spark, args.data_dir)
    output = args.output or f"{args.data_dir}/{USERS}"
    return f"{lifecycles.prepare_people(spark, source, output, _counter(args)).count()} user profiles in {output}"


def _embedded(args: argparse.Namespace, profiles: DataFrame, key: str, name: str, expected: int | None) -> str:
    encoder, model, revision = _encoder(args)
    done = lifecycles.encode_profiles(profiles, key, encoder, _tokens(args), args.batch_size, expected)
    output = f"{args.data_dir}/{name}"
    done.write.mode("overwrite").parquet(output)
    files.write_json(stats.run_stats(profiles, _tokens(args), model, revision, dimensions=encoder.width), f"{output}.stats.json")
    return f"vectors of {encoder.width} dimensions in {output}"


def _careers(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    rows = files.load_profiles(files.read_csv(spark, f"{args.data_dir}/{CAREERS}", [CODE, TITLE]), [CODE, TITLE], "careers", legacy="text")
    return rows.withColumnsRenamed({CODE: "code", TITLE: "title"})


def _users(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return files.load_profiles(files.read_csv(spark, f"{args.data_dir}/{USERS}", ["user_id"]), ["user_id"], "users")


def embed_careers(spark: SparkSession, args: argparse.Namespace) -> str:
    quality.require_positive(batch_size=args.batch_size)
    return _embedded(args, _careers(spark, args), "code", CAREER_VECTORS, None)


def embed_users(spark: SparkSession, args: argparse.Namespace) -> str:
    quality.require_positive(batch_size=args.batch_size, expected_users=args.expected_users)
    return _embedded(args, _users(spark, args), "user_id", USER_VECTORS, args.expected_users)


def match(spark: SparkSession, args: argparse.Namespace) -> str:
    """The vectors' runs must agree and their rows follow the profiles."""
    vectors = {n: spark.read.parquet(f"{args.data_dir}/{n}") for n in (USER_VECTORS, CAREER_VECTORS)}
    runs = {n: files.read_json(spark, f"{args.data_dir}/{n}.stats.json") for n in vectors}
    done = lifecycles.match_profiles(
        vectors[USER_VECTORS], vectors[CAREER_VECTORS], user_stats=runs[USER_VECTORS], career_stats=runs[CAREER_VECTORS], user_order=_users(spark, args), career_order=_careers(spark, args)
    )
    output = args.output or f"{args.data_dir}/{MATCHES}"
    files.write_csv(done.matches, output)
    files.write_report(done.report, f"{output}.txt", ["pos", "rank"])
    return f"matches in {output}"


STEPS = {"prepare-careers": prepare_careers, "embed-careers": embed_careers, "prepare-users": prepare_users, "embed-users": embed_users, "match": match}


def main(arguments_given: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 with the reason on standard error where an input breaks a rule."""
    args = arguments().parse_args(arguments_given)
    spark = make_visible(spark or SparkSession.builder.appName(f"matchloom {args.step}").getOrCreate())
    try:
        print(STEPS[args.step](spark, args))
    except quality.QualityError as error:
        print(f"{args.step}: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
