"""The relational core: reductions with known rows, matching, rules, statistics, files."""

import numpy as np
import plain_sections as slow
import pytest
from pyspark.sql import functions as F

from matchloom.functions import numbers, repeats, sets, text, vectors
from matchloom.functions.tokens import PatternCounter
from matchloom.operators import catalog, embed, match, quality, stats
from matchloom.plans import lifecycles
from matchloom.schemas import CODE
from matchloom.sources import files, resolve
from matchloom.streaming import live


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_fields_are_filled_independently(spark):
    df = spark.createDataFrame([("a", "", "d1", 1), ("a", "t2", "d2", 2), ("", "x", "y", 3), ("b", "", "", 4)], "code string, title string, description string, pos long")
    assert rows(catalog.first_nonempty(df, "code", ["title", "description"]), "code") == [("a", "t2", "d1"), ("b", "", "")]


def test_best_skill(spark):
    data = [("k", "Speaking", "IM", "3", 1), ("k", "SPEAKING", "im", "3", 2), ("k", "Reading", "LV", "5", 3), ("k", "Reading", "IM", "nan", 4), ("k", "Reading", "IM", "1d", 5), ("k", "", "IM", "4", 6), ("k", "Maths", "IM", "1_0", 7)]
    schema = "code string, name string, scale string, value string, pos long"
    assert rows(catalog.best_skill(spark.createDataFrame(data, schema), "code"), "name") == [("k", "Maths", 10.0), ("k", "Speaking", 3.0)]
    data.append(("k", "speaking", "IM", "4", 8))
    assert ("k", "speaking", 4.0) in rows(catalog.best_skill(spark.createDataFrame(data, schema), "code"))


def test_best_task_keeps_the_first_place(spark):
    data = [("k", "X", "Supplemental", "1", 1), ("k", "Y", "", "inf", 2), ("k", "x", "CORE", "", 3)]
    df = spark.createDataFrame(data, "code string, text string, kind string, support string, pos long")
    assert rows(catalog.best_task(df, "code"), "pos") == [("k", 1, "x", True, 0.0), ("k", 2, "Y", False, 0.0)]


def test_top_skills(spark):
    df = spark.createDataFrame([("k", n, s) for n, s in (("b", 2.0), ("a", 2.0), ("c", 3.0))], "code string, name string, score double")
    assert [r.name for r in catalog.rank_skills(df, "code", 2).orderBy("rank").collect()] == ["c", "a"]
    assert catalog.rank_skills(df, "code", 0).count() == 3
    with pytest.raises(ValueError):
        catalog.rank_skills(df, "code", -1)


def test_numbers(spark):
    written = ["1", " 1.5 ", "1e3", "-.5", "1_0", "1__0", "1d", "1f", "nan", "inf", "1e999", "", None, "5."]
    df = spark.createDataFrame([(w,) for w in written], "w string")
    assert [r[0] for r in df.select(numbers.parse_number(F.col("w"))).collect()] == [1.0, 1.5, 1000.0, -0.5, 10.0, None, None, None, None, None, None, None, None, 5.0]


def test_clean_and_normalize_agree_with_python(spark):
    texts = [" a  b\xa0c ", "NA", " n/a ", "None", "NULL", None, "one two one two", "x www.a.org/b y", "a@b.co, and", "__ ok", "• Company Name z", "﻿q", "a—"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(text.clean(F.col("t")), repeats.normalize(F.coalesce("t", F.lit("")))).collect()
    missing = {"", "nan", "none", "null", "n/a", "na"}
    for t, (c, n) in zip(texts, got, strict=True):
        plain = " ".join((t or "").split())
        assert c == ("" if plain.casefold() in missing else plain)
        assert n == slow.normalize(t or "")


def test_set_measures(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["b", "c", "d"]), ([], ["a"]), (list("abcdef"), list("abcdefghijkl"))], "a array<string>, b array<string>")
    a, b = F.col("a"), F.col("b")
    got = rows(df.select(sets.jaccard(a, b), sets.novelty(a, b), sets.overlap(a, b), sets.within(a, b), sets.near_duplicate(a, b)))
    assert got == [(0.5, 1 / 3, 2 / 3, False, False), (0.0, 0.0, None, True, False), (0.5, 0.0, 1.0, True, True)]


USERS = [("z", 1, [1.0, 0.0]), ("a", 2, [0.0, 1.0])]
CAREERS = [("C", "C", [0.0, 1.0]), ("B", "B", [1.0, 0.0]), ("A", "A", [1.0, 0.0]), ("D", "D", [-1.0, 0.0])]


@pytest.fixture
def sides(spark):
    return spark.createDataFrame(USERS, "user_id string, pos long, embedding array<float>"), spark.createDataFrame(CAREERS, "code string, title string, embedding array<float>")


@pytest.mark.parametrize("plan", [match.topk_columns, match.topk_arrow, lambda u, c, k: match.topk_blocks(u, c, k, 1), match.topk])
def test_ties_go_by_code(sides, plan):
    got = rows(plan(*sides, 3), F.desc("user_id"), "rank")
    assert got == [("z", 1, "A", 1.0), ("z", 2, "B", 1.0), ("z", 3, "C", 0.0), ("a", 1, "C", 1.0), ("a", 2, "A", 0.0), ("a", 3, "B", 0.0)]


def test_plans_agree(spark):
    rng = np.random.default_rng(1)
    unit = lambda n: [(v / np.linalg.norm(v)).tolist() for v in rng.normal(size=(n, 8))]
    users = spark.createDataFrame(list(enumerate(unit(30))), "user_id long, embedding array<float>")
    careers = spark.createDataFrame(list(enumerate(unit(200))), "code long, embedding array<float>")
    plans = [match.topk_columns(users, careers, 7), match.topk_arrow(users, careers, 7), match.topk_blocks(users, careers, 7, 50)]
    a, b, c = ([(r.user_id, r.rank, r.code, round(r.score, 9)) for r in p.orderBy("user_id", "rank").collect()] for p in plans)
    assert a == b == c and len(a) == 210


@pytest.mark.parametrize("plan", [match.topk_columns, match.topk_arrow])
def test_no_cosine_is_refused_and_overshoot_clipped(spark, plan):
    careers = spark.createDataFrame([("A", [1.0, 0.0])], "code string, embedding array<double>")
    good = spark.createDataFrame([("u", [1.000005, 0.0])], "user_id string, embedding array<double>")
    bad = spark.createDataFrame([("u", [1.0001, 0.0])], "user_id string, embedding array<double>")
    assert rows(plan(good, careers, 1)) == [("u", 1, "A", 1.0)]
    with pytest.raises(Exception, match="invalid cosine"):
        plan(bad, careers, 1).collect()


def test_k_is_checked():
    for k in (0, 5):
        with pytest.raises(ValueError):
            match.checked_k(k, 4)


def test_match_lifecycle(sides, spark):
    with pytest.raises(quality.QualityError, match="needs runs, user_order, career_order"):
        lifecycles.match_profiles(*sides, k=2)
    with pytest.raises(quality.QualityError, match="no such check: order"):
        lifecycles.match_profiles(*sides, k=2, unchecked=("order",))
    free = {"unchecked": ("runs", "user_order", "career_order")}
    done = lifecycles.match_profiles(*sides, k=2, **free)
    assert [(r.user_id, r.rank, r.career_code) for r in done.matches.collect()] == [("z", 1, "A"), ("z", 2, "B"), ("a", 1, "C"), ("a", 2, "A")]
    assert done.report.orderBy("pos", "rank").first().line == "  1. A (A) - cosine similarity 1.0000"
    zero = spark.createDataFrame([("z", 1, [0.0, 0.0])], sides[0].schema)
    with pytest.raises(quality.QualityError, match="length is not one"):
        lifecycles.match_profiles(zero, sides[1], 2, **free)
    narrow = spark.createDataFrame([("z", 1, [1.0])], sides[0].schema)
    with pytest.raises(quality.QualityError, match="another width"):
        lifecycles.match_profiles(narrow, sides[1], 2, width=2, **free)
    one = spark.createDataFrame([("m", "r1")], "model string, revision string")
    two = spark.createDataFrame([("m", "")], "model string, revision string")
    with pytest.raises(quality.QualityError, match="revision"):
        lifecycles.match_profiles(*sides, 2, user_stats=one, career_stats=two, unchecked=("user_order", "career_order"))


def test_rules(spark):
    m = spark.createDataFrame([("u", 1, "A", 0.5), ("u", 2, "A", 0.7), ("v", 1, "A", 0.9), ("v", 2, "B", 0.1)], "user_id string, rank int, code string, score double")
    assert [r.key for r in quality.valid_matches(m, 2).collect()] == ["u"]
    with pytest.raises(quality.QualityError, match="duplicate user ID"):
        quality.require(quality.unique_key(m, "user_id", "user ID"))
    assert quality.row_count(m, 4, "rows").count() == 0 and quality.row_count(m, 3, "rows").count() == 1
    with pytest.raises(quality.QualityError):
        quality.require_columns(m, ["user_id", "nope"])
    with pytest.raises(quality.QualityError):
        quality.require_positive(batch_size=0)
    assert quality.round_trip(m, m).count() == 0 and quality.round_trip(m, m.limit(3)).count() == 1
    assert quality.nonempty(m.limit(0), "rows").count() == 1 and quality.nonempty(m, "rows").count() == 0


def test_csv_keeps_order_blanks_and_quotes(spark, tmp_path):
    source = tmp_path / "people.csv"
    source.write_text('﻿Resume_str,Generated_Interests,Extra\n" lead ""q"", x\nsecond line",  i ,1\nb,,2\nb,,3\n', encoding="utf-8")
    raw = files.read_csv(spark, str(source), ["Resume_str", "Generated_Interests"], tidy=False)
    assert rows(raw.select("pos", "Resume_str", "Generated_Interests"), "pos") == [(1, ' lead "q", x\nsecond line', "  i "), (2, "b", ""), (3, "b", "")]
    ids = [r.user_id for r in lifecycles.identified(raw.select(F.col("Resume_str").alias("resume"), F.col("Generated_Interests").alias("interests"), "pos")).orderBy("pos").collect()]
    assert ids[1][:-3] == ids[2][:-3] and [i[-3:] for i in ids] == ["_01", "_01", "_02"]
    files.write_csv(raw.drop("pos"), str(tmp_path / "out"))
    back = files.read_csv(spark, str(tmp_path / "out"), ["Extra"], tidy=False)
    assert quality.round_trip(raw.drop("pos"), back.drop("pos")).count() == 0
    with pytest.raises(quality.QualityError, match="missing columns"):
        files.read_csv(spark, str(source), ["Nope"])


def test_pos_is_dense_over_many_tasks(spark, tmp_path):
    spark.range(100).select(F.format_string("v%03d", "id").alias("v")).repartition(7).write.option("header", True).csv(str(tmp_path / "many"))
    got = files.read_csv(spark, str(tmp_path / "many"), ["v"])
    assert sorted(r.pos for r in got.collect()) == list(range(1, 101))


def test_profile_loaders(spark):
    both = spark.createDataFrame([("22", "22", "old", "short 22", 1), ("11", "11", "old", " short  11", 2)], f"`{CODE}` string, Title string, text string, profile_text string, pos long")
    assert [r.profile_text for r in files.load_profiles(both, [CODE, "Title"], "career", "text").orderBy("pos").collect()] == ["short 22", "short 11"]
    assert files.load_profiles(both.drop("profile_text"), [CODE], "career", "text").first().profile_text == "old"
    users = spark.createDataFrame([("z", "First", 1), ("z", "Second", 2)], "user_id string, profile_text string, pos long")
    with pytest.raises(quality.QualityError, match="duplicate user ID"):
        files.load_profiles(users, ["user_id"], "user ID")
    with pytest.raises(quality.QualityError, match="nonempty"):
        files.load_profiles(users.limit(1).withColumn("profile_text", F.lit(" ")), ["user_id"], "user ID")
    assert files.read_metadata(both, [CODE], "careers").columns == [CODE, "pos"]


def test_arrays_and_json(spark, tmp_path):
    array = np.eye(3, dtype=np.float32)
    np.save(tmp_path / "a.npy", array, allow_pickle=False)
    got = files.read_array(spark, str(tmp_path / "a.npy"))
    assert rows(got.select("pos", "embedding"), "pos") == [(k + 1, row.tolist()) for k, row in enumerate(array)]
    files.write_array(got, str(tmp_path / "b.npy"))
    assert np.array_equal(np.load(tmp_path / "b.npy"), array)
    np.save(tmp_path / "bad.npy", np.array([{"a": 1}], dtype=object), allow_pickle=True)
    with pytest.raises(Exception, match="allow_pickle|pickle"):
        files.read_array(spark, str(tmp_path / "bad.npy")).collect()
    facts = stats.run_stats(spark.createDataFrame([(246,), (250,), (16,)], "token_count int"), F.col("token_count"), users=3)
    files.write_json(facts, str(tmp_path / "stats"))
    back = files.read_json(spark, str(tmp_path / "stats")).first()
    assert (back.profiles, back.median_tokens, back.profiles_in_245_to_250_range, back.percentage_truncated) == (3, 246.0, 2, 0.0)


def test_finding_inputs(spark, tmp_path):
    with pytest.raises(quality.QualityError):
        resolve.find_input(spark, str(tmp_path))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / resolve.PREFERRED[1]).write_text("x")
    assert resolve.find_input(spark, str(tmp_path)).endswith(resolve.PREFERRED[1])
    (tmp_path / resolve.PREFERRED[0]).write_text("x")
    assert resolve.find_input(spark, str(tmp_path)).endswith(resolve.PREFERRED[0])
    (tmp_path / "in" / resolve.PREFERRED[0]).write_text("x")
    with pytest.raises(quality.QualityError, match="multiple"):
        resolve.find_input(spark, str(tmp_path))
    (tmp_path / "m.csv").write_text("x")
    assert resolve.only_one(spark, str(tmp_path), "m.csv").endswith("/m.csv")
    (tmp_path / resolve.SUBFOLDER).mkdir()
    (tmp_path / resolve.SUBFOLDER / "m.csv").write_text("x")
    with pytest.raises(quality.QualityError, match="exactly one"):
        resolve.only_one(spark, str(tmp_path), "m.csv")


def test_catalog_lifecycle(spark, tmp_path):
    (tmp_path / "o.csv").write_text(f"{CODE},Title,Description\n2,Beta,Does beta.\n1,,First things.\n1,Alpha,Other.\n,Nobody,None\n")
    (tmp_path / "s.csv").write_text(f"{CODE},Element Name,Scale ID,Data Value\n1,Reading,IM,4\n1,Writing,IM,4\n1,READING,IM,5\n1,Maths,LV,5\n9,Other,IM,5\n")
    (tmp_path / "t.csv").write_text(f"{CODE},Task\n1,Read the first things.\n1,Write them down.\n9,Nothing.\n")
    paths = [str(tmp_path / n) for n in ("o.csv", "s.csv", "t.csv")]
    got = lifecycles.prepare_catalog(spark, *paths, output=str(tmp_path / "out")).collect()
    assert [r[CODE] for r in got] == ["1", "2"] and len(got[0]) == 10
    assert got[0].profile_text == got[0].full_profile_text == "Occupation: Alpha Description: First things. Skills: READING; Writing Tasks: Read the first things. Write them down."
    assert got[1].profile_text == "Occupation: Beta Description: Does beta."
    assert files.read_csv(spark, str(tmp_path / "out"), [CODE]).count() == 2
    with pytest.raises(quality.QualityError):
        lifecycles.prepare_catalog(spark, *paths, top_skills=-1)
    (tmp_path / "o.csv").write_text(f"{CODE},Title,Description\n1,A,{'One more plain line. ' * 100}\n")
    with pytest.raises(quality.QualityError, match="take more than"):
        lifecycles.prepare_catalog(spark, *paths)


def test_people_lifecycle_and_encoding(spark, tmp_path):
    (tmp_path / "p.csv").write_text('Resume_str,Generated_Interests\n"CLERK Experience Managed records. Skills Excel, SQL",I like order.\n"CLERK Experience Prepared plans.",I like plans.\n')
    got = lifecycles.prepare_people(spark, str(tmp_path / "p.csv"), str(tmp_path / "out"))
    assert [r.source_row for r in got.collect()] == [1, 2]
    assert files.read_json(spark, str(tmp_path / "out.stats.json")).first().profiles == 2
    encoded = lifecycles.encode_profiles(got, "user_id", embed.HashingEncoder(16), expected=2)
    assert encoded.select(F.bool_and(vectors.is_unit(F.col("embedding"), 2e-5))).first()[0]
    with pytest.raises(quality.QualityError, match="expected 3"):
        lifecycles.encode_profiles(got, "user_id", embed.HashingEncoder(16), expected=3)
    long = got.withColumn("profile_text", F.repeat(F.lit("word "), 300))
    with pytest.raises(quality.QualityError, match="token limit"):
        lifecycles.encode_profiles(long, "user_id", embed.HashingEncoder(16))
    (tmp_path / "q.csv").write_text("Resume_str,Generated_Interests\nA,\n")
    with pytest.raises(quality.QualityError, match="are empty"):
        lifecycles.prepare_people(spark, str(tmp_path / "q.csv"))


def test_pattern_counter_is_the_same_in_spark(spark):
    texts = ["", "a", "Ab-1 c!", "é x", "a\tb\n", "日本"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(PatternCounter.column(F.col("t"))).collect()] == [PatternCounter().count(t) for t in texts]


def test_missing_encoder_package_is_named():
    pytest.importorskip("numpy")
    try:
        import sentence_transformers  # noqa: F401
    except ImportError:
        with pytest.raises(quality.QualityError, match="sentence_transformers"):
            embed.SentenceEncoder().encode(["x"])


def test_stream(spark, tmp_path):
    encoder = embed.HashingEncoder(16)
    people = spark.createDataFrame([("u1", "alpha beta"), ("u2", "gamma")], "user_id string, profile_text string")
    careers = embed.encode(spark.createDataFrame([("A", "alpha beta"), ("B", "gamma delta")], "code string, profile_text string"), encoder)
    people.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(people.schema).parquet(str(tmp_path / "in"))
    query = live.match_stream(stream, careers, encoder, str(tmp_path / "out"), str(tmp_path / "check"), 1).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("user_id", "code"), "user_id") == [("u1", "A"), ("u2", "B")]


def test_case_folding(spark):
    """Two letters fold to one form in Spark if and only if they do in Python, as far as both know them."""
    import unicodedata

    letters = [chr(c) for c in range(0xFFFF) if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lt")]
    df = spark.createDataFrame([(c,) for c in letters], "c string")
    got = {r.c: r.f for r in df.select("c", text.casefold(F.col("c")).alias("f")).collect()}
    newer = {c for c in letters if got[c] != c.casefold()}
    assert len(newer) < 20 and all(ord(c) > 0x1C80 for c in newer)  # letters that are younger than the JVM's tables
    words = ["Straße", "STRASSE", "ΛΟΓΟΣ", "λογος", "ﬁn", "FIN", "İ", "ı", "I", "i", "ſ", "S"]
    folded = {w: f for w, f in df.sparkSession.createDataFrame([(w,) for w in words], "w string").select("w", text.casefold(F.col("w"))).collect()}
    for a in words:
        for b in words:
            assert (folded[a] == folded[b]) == (a.casefold() == b.casefold()), (a, b)


def test_names_that_differ_in_case_alone_are_one(spark):
    data = [("k", "Straße", "IM", "3", 1), ("k", "STRASSE", "IM", "4", 2)]
    assert rows(catalog.best_skill(spark.createDataFrame(data, "code string, name string, scale string, value string, pos long"), "code")) == [("k", "STRASSE", 4.0)]


def test_repeats_agree_with_python_on_odd_words(spark):
    rng = np.random.default_rng(4)
    some = ["a", "b", "B", "ab", "-a", "x-a", "(b", ".", "é", "É", "c", "ß", "_"]
    texts = [" ".join(rng.choice(some, rng.integers(0, 30))) for _ in range(1500)]

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(repeats.collapse_repeats(F.col("t"))).collect()] == [slow.collapse_repeats(t) for t in texts] == repeats.without_repeats(texts)
    assert sum(slow.collapse_repeats(t) != t for t in texts) > 100


def test_distinct_units_agree_with_python(spark):
    rng = np.random.default_rng(5)
    units = [[str(x) for x in rng.choice(["A b", "a  B.", "", "...", "c", "C!", "é", "É", "d_1", "d 1", "Straße", "STRASSE"], rng.integers(0, 12))] for _ in range(300)]
    df = spark.createDataFrame([(u,) for u in units], "u array<string>")
    got = [r[0] for r in df.select(text.stable_distinct(F.transform("u", text.collapse))).collect()]
    key = lambda u: " ".join(__import__("re").sub(r"\W+", " ", u.casefold()).split())
    want = []
    for us in units:
        first = {}
        for u in us:
            if key(u):
                first.setdefault(key(u), " ".join(u.split()))
        want.append(list(first.values()))
    assert got == want


def test_previous_row_of_a_hot_group(spark):
    data = [("hot" if k % 10 else ["a", "b", None][k % 3], k * 3) for k in range(2000)]
    df = spark.createDataFrame(data, "g string, k long").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.g, r.k): r.previous for r in catalog.previous(df, "g", "k").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, last = {}, {}
    for g, k in sorted(data, key=lambda x: x[1]):
        want[g, k], last[g] = last.get(g), k
    assert got == want


def test_white_space_runs(spark):
    texts = ["a b", " a", "a  b ", "a\n b", "a \n\tb", "\u2003x\xa0 y", "\x1c", "", "a\x85b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(text.collapse(F.col("t"))).collect()] == [" ".join(t.split()) for t in texts]
