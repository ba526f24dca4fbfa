"""The five steps from the command line, and what they refuse."""

import sys
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.functions.tokens import PatternCounter, WordPieceCounter, counted
from matchloom.operators import embed, quality
from matchloom.plans import commands, lifecycles
from matchloom.schemas import CODE, WIDTH
from matchloom.session import shared_dir
from matchloom.sources import files

VOCABULARY = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "clerk", "keep", "##s", "##ing", "records", "and", "plan", ".", ":", "i", "like", "order", "x"]


@pytest.fixture
def data(tmp_path):
    (tmp_path / "occupations.csv").write_text(f"{CODE},Title,Description\n11,Clerk,Keeps records.\n22,Planner,Makes plans.\n33,Miller,Grinds corn.\n44,Baker,Bakes bread.\n55,Smith,Bends iron.\n66,Cook,Cooks meals.\n")
    (tmp_path / "skills.csv").write_text(f"{CODE},Element Name,Scale ID,Data Value\n11,Reading,IM,4\n22,Writing,IM,3\n")
    (tmp_path / "tasks.csv").write_text(f"{CODE},Task,Task Type,Incumbents Responding\n11,Keep the books in order.,Core,90\n")
    (tmp_path / "people.csv").write_text('Resume_str,Generated_Interests\n"CLERK Experience Managed records and kept the books. Skills Excel, SQL",I like order.\n"PLANNER Experience Prepared plans.",I like plans.\n')
    return tmp_path


def run(spark, *args):
    return commands.main([str(a) for a in args], spark)


def test_all_steps(spark, data, capsys):
    at = ["--data-dir", data, "--encoder", "hashing"]
    assert run(spark, "prepare-careers", *at, "--top-skills", 1) == 0
    assert run(spark, "prepare-users", "--input", data / "people.csv", "--output", data / commands.USERS) == 0
    assert run(spark, "embed-careers", *at, "--batch-size", 2) == 0
    assert run(spark, "embed-users", *at, "--expected-users", 2) == 0
    assert run(spark, "match", *at) == 0
    got = files.read_csv(spark, str(data / commands.MATCHES), ["user_id", "rank"]).collect()
    assert len(got) == 10 and {r.user_id for r in got} == {r.user_id for r in spark.read.parquet(str(data / commands.USER_VECTORS)).collect()}
    assert len(spark.read.text(str(data / f"{commands.MATCHES}.txt")).collect()) == 10
    stats = files.read_json(spark, str(data / f"{commands.USER_VECTORS}.stats.json")).first()
    assert (stats.profiles, stats.dimensions, stats.model) == (2, WIDTH, "hashing")

    assert run(spark, "embed-users", *at, "--expected-users", 3) == 1 and "expected 3" in capsys.readouterr().err
    assert run(spark, "embed-users", *at, "--batch-size", 0) == 1 and "batch_size" in capsys.readouterr().err
    other = spark.read.parquet(str(data / commands.USER_VECTORS)).collect()
    spark.createDataFrame([(r.user_id, r.profile_text, 3 - r.pos, r.embedding) for r in other], "user_id string, profile_text string, pos long, embedding array<float>").write.mode("overwrite").parquet(str(data / commands.USER_VECTORS))
    assert run(spark, "match", *at) == 1 and "order or content differs" in capsys.readouterr().err


def test_wrong_arguments(spark, data, capsys):
    for wrong in ([], ["nothing"], ["match", "--top-skills", "3"]):
        with pytest.raises(SystemExit):
            run(spark, *wrong)
    assert run(spark, "prepare-careers", "--data-dir", data / "none") == 1 and "exactly one" in capsys.readouterr().err
    assert run(spark, "prepare-careers", "--data-dir", data, "--top-skills", -1) == 1 and "top_skills" in capsys.readouterr().err


def test_runs_must_agree(spark, data):
    users = spark.createDataFrame([("u", 1, [1.0, 0.0])], "user_id string, pos long, embedding array<float>")
    careers = spark.createDataFrame([("A", "A", 1, [1.0, 0.0])], "code string, title string, pos long, embedding array<float>")
    run_of = lambda m: spark.createDataFrame([(m, "1")], "model string, revision string")
    assert lifecycles.match_profiles(users, careers, 1, user_stats=run_of("m"), career_stats=run_of("m"), user_order=users, career_order=careers).matches.count() == 1
    right = {"user_stats": run_of("m"), "career_stats": run_of("m"), "user_order": users, "career_order": careers}
    for wrong, why in (
        ({"career_stats": run_of("n")}, "model"), ({"career_stats": None}, "needs runs"), ({"career_order": careers.withColumn("title", F.lit("B"))}, "order"),
        ({"user_order": None}, "needs user_order"), ({"user_order": users.withColumn("pos", F.lit(2))}, "order"),
    ):
        with pytest.raises(quality.QualityError, match=why):
            lifecycles.match_profiles(users, careers, 1, **right | wrong)
    with pytest.raises(quality.QualityError, match="users found: none"):
        lifecycles.match_profiles(users.limit(0), careers, 1, **right)


def test_word_pieces(spark, tmp_path):
    path = tmp_path / "vocab.txt"
    path.write_text("\n".join(VOCABULARY) + "\n")
    counter = WordPieceCounter(str(path))
    texts = {"Clerk keeps records and plans.": 10, "": 2, "keeping": 4, "unseen": 3, "I like order: x": 7}
    assert {t: counter.count(t) for t in texts} == texts
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(counted(counter, F.col("t"))).collect()] == list(texts.values())


def test_recount_uses_the_given_counter(spark, data):
    """A counter that is wrong about the first text that it sees: first the title alone, at the recount a profile."""

    class Fickle:
        asked = 0

        def count(self, text):
            self.asked += 1
            return PatternCounter().count(text) + (self.asked == 1)

    with pytest.raises(quality.QualityError, match="token count differs"):
        lifecycles.prepare_people(spark, str(data / "people.csv"), counter=Fickle())


def test_published_model_is_loaded_once(monkeypatch):
    loaded = []

    class Model:
        def __init__(self, name, revision):
            loaded.append((name, revision))

        def encode(self, texts, convert_to_numpy, normalize_embeddings):
            assert convert_to_numpy and normalize_embeddings
            return np.eye(len(texts), WIDTH)

    module = types.ModuleType("sentence_transformers")
    module.SentenceTransformer = Model
    monkeypatch.setitem(sys.modules, "sentence_transformers", module)
    encoder = embed.SentenceEncoder()
    assert encoder.encode(["a", "b"]).dtype == np.float32 and encoder.encode(["c"]).shape == (1, WIDTH)
    assert loaded == [(encoder.model, encoder.revision)] and encoder.__getstate__()["_loaded"] is None


class _Session:
    """A session of a cluster without a shared folder."""

    class conf:
        get = staticmethod(lambda name, default=None: default)

    class sparkContext:
        master = "spark://host:7077"


def test_a_cluster_needs_a_shared_folder(spark):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(_Session)
    assert shared_dir(spark)


def test_arrays_of_unequal_vectors_are_refused(spark, tmp_path):
    with pytest.raises(quality.QualityError, match="dimensions"):
        files.write_array(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "pos long, embedding array<float>"), str(tmp_path / "a.npy"))
    files.write_array(spark.createDataFrame([], "pos long, embedding array<float>"), str(tmp_path / "b.npy"))
    assert np.load(tmp_path / "b.npy").shape == (0, 0)
