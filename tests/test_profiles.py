"""Choices of units: examples with known results, and properties."""

import random
import re

import plain_sections as plain
import pytest
from pyspark.sql import functions as F

from matchloom.functions.tokens import Costs, PatternCounter
from matchloom.functions.text import content_words, letter_words
from matchloom.operators import segment, select_person
from matchloom.operators.select_catalog import CatalogChoice, DoesNotFit, render
from matchloom.schemas import CATEGORIES

COUNTER = PatternCounter()


class Rendering:
    """A counter that doesn't say that its counts add up, so that whole texts are counted."""

    def __init__(self):
        self.count = COUNTER.count


def with_words(tasks):
    return [{**t, "words": sorted(set(re.findall("[a-z]{3,}", t["text"].lower())))} for t in tasks]


@pytest.fixture(scope="module")
def person(spark):
    """A person's choice by the columns' sections and points."""

    def make(resume, interests, counter=COUNTER):
        row = select_person.prepared(spark.createDataFrame([("k", resume, interests)], "user_id string, resume string, interests string"), "user_id").first()
        units = {c: [tuple(u) for u in row[c]] for c in CATEGORIES}
        return select_person.PersonChoice(row.title, units, row.interests, counter), row

    return make


@pytest.fixture(scope="module")
def sections(spark):
    def make(*texts):
        rows = segment.with_sections(spark.createDataFrame(list(enumerate(texts)), "n int, t string"), F.col("t")).orderBy("n").collect()
        return [(r.title, {c: r[c.lower()] for c in CATEGORIES}) for r in rows]

    return make


TASKS = [
    {"text": "Weigh the ore and note what each cart holds.", "core": True, "support": 95.0},
    {"text": "Tell the foremen about poor seams and agree on the next shaft.", "core": True, "support": 90.0},
    {"text": "Oil the scales and keep the shed dry.", "core": False, "support": 60.0},
]
TASKS = with_words(TASKS)
RESUME = (
    "BOOKKEEPER Summary Careful with numbers. Experience Prepared monthly ledgers for a mill. "
    "Reviewed invoices and found gaps. Reviewed invoices and found gaps. "
    "Education Bachelor of Arts : Economics Riverside College Skills Excel, SQL, payroll, double entry"
)
INTERESTS = "I like to find out why figures disagree."


def test_whole_tasks_are_reserved_beside_many_skills():
    args = ("Weigher", "Weighs what the mine brings up.", [f"Craft number {i}" for i in range(80)], TASKS, COUNTER)
    result = CatalogChoice(*args).run()
    text, n, skills, tasks = result
    assert result == CatalogChoice(*args).run()
    assert len(tasks) >= 2 and 245 <= n <= 250 and n == COUNTER.count(text) and 0 in skills
    assert all(TASKS[i]["text"] in text for i in tasks) and args[1] in text


def test_sparse_source_is_not_padded():
    text, n, skills, tasks = CatalogChoice("Miller", "Grinds corn.", [], [], COUNTER).run()
    assert text == "Occupation: Miller Description: Grinds corn." and n < 245 and skills == tasks == []


def test_oversized_description_fails():
    with pytest.raises(DoesNotFit, match="take more than"):
        CatalogChoice("Miller", "One more plain line. " * 100, [], [], COUNTER)


def test_task_that_fits_nowhere_fails():
    with pytest.raises(DoesNotFit, match="none of its tasks"):
        CatalogChoice("A", "B", [], with_words([{"text": "word " * 300, "core": True, "support": 1.0}]), COUNTER).run()


def test_exchange_reaches_for_the_target():
    """Two short core tasks fill the budget badly; a longer one takes a place."""
    tasks = [{"text": f"{'alpha ' * n}{k}.", "core": True, "support": float(100 - k)} for k, n in enumerate((100, 100, 130))]
    tasks = with_words(tasks)
    choice = CatalogChoice("T", "D", [], tasks, COUNTER)
    before = CatalogChoice("T", "D", [], tasks, COUNTER)
    before.reserve_tasks()
    _, n, _, chosen = choice.run()
    assert n > before.cost([], before.with_tasks) and n <= 250 and 2 in chosen


def test_output_order_is_source_order():
    rng = random.Random(5)
    for _ in range(60):
        tasks = [{"text": "w" * rng.randint(1, 9) + " x" * rng.randint(1, 90) + f" t{k}.", "core": rng.random() < 0.5, "support": rng.random() * 100} for k in range(rng.randint(1, 9))]
        tasks = with_words(tasks)
        skills = [f"skill {'s' * rng.randint(1, 30)} {k}" for k in range(rng.randint(0, 30))]
        text, n, s, t = CatalogChoice("Title", "Some description.", skills, tasks, COUNTER).run()
        assert (text, n, s, t) == CatalogChoice("Title", "Some description.", skills, tasks, Rendering()).run()
        assert n == COUNTER.count(text) <= 250 and len(set(s)) == len(s) and len(set(t)) == len(t)
        assert text == render("Title", "Some description.", [skills[i] for i in sorted(s)], [tasks[i]["text"] for i in sorted(t)])


def test_balanced_person(person):
    choice, row = person(RESUME, INTERESTS)
    text, n, chosen = choice.run()
    assert (text, n, chosen) == person(RESUME, INTERESTS)[0].run() == person(RESUME, INTERESTS, Rendering())[0].run()
    assert row.title == "BOOKKEEPER" and INTERESTS in text and n == COUNTER.count(text) <= 250
    assert all(chosen[c] for c in ("Education", "Experience", "Skills"))
    whole = plain.normalize(RESUME)
    assert row.whole == whole and all(u in whole for units in chosen.values() for u in units)
    assert text.count("Reviewed invoices and found gaps.") == 1


def test_long_resumes_swap_and_keep_the_budget(person):
    rng = random.Random(9)
    words = "reports budgets audits records systems clients ledgers payroll controls forecasts plans models errors trends".split()
    for length in (60, 12):
        units = [f"{rng.choice(['Designed', 'Managed', 'Reviewed', 'Prepared'])} {' '.join(rng.choice(words) for _ in range(rng.randint(4, 25)))} {k}." for k in range(length)]
        resume = "CLERK Experience " + " ".join(units) + " Skills Excel; SQL, ledgers Summary Plans budgets. Wants audits."
        text, n, chosen = person(resume, INTERESTS)[0].run()
        assert n == COUNTER.count(text) <= 250 and len(chosen["Experience"]) > 3
        assert (text, n, chosen) == person(resume, INTERESTS, Rendering())[0].run()


def test_points_of_units(spark):
    """Columns against the rule written out."""
    wanted = "reports budgets 2011 excel".split()
    units = ["Managed reports, budgets and 3 audits.", "Bachelor of Arts : reports", "", "etc", " ".join(f"excel{k}" for k in range(30)), "MBA 2011"]
    df = spark.createDataFrame([(u,) for u in units], "u string")
    for category in CATEGORIES:
        got = [r[0] for r in df.select(select_person.scores(F.col("u"), category, F.array(*map(F.lit, wanted)))).collect()]
        for u, s in zip(units, got, strict=True):
            terms = plain.content_words(u)
            want = 3 * len(terms & set(wanted)) + 3 * u.startswith("Managed") + (2 if terms else 0)
            want += {"Education": 4 * u.startswith(("Bachelor", "MBA")), "Experience": 0.8 * bool(re.search(r"\d", u)), "Skills": -0.2 * max(0, len(u.split()) - 20)}.get(category, 0)
            assert s == pytest.approx(want), (category, u)


@pytest.mark.parametrize(("resume", "interests", "why"), [("WELDER Experience Built frames.", "", "empty"), ("", "Something.", "empty"), (" ,; ", "x", "empty"), (None, None, "empty"), ("WELDER Experience Built frames.", " ".join(f"word{k}" for k in range(300)), "more than the budget"), ("WELDER Experience " + "frame " * 40 + " ".join(f"f{k}" for k in range(300)), "I like it.", "no unit")])
def test_what_does_not_fit(spark, resume, interests, why):
    rows = spark.createDataFrame([("k", resume, interests)], "user_id string, resume string, interests string")
    r = select_person.choose(rows, COUNTER).first()
    assert why in r.error and r.profile_text is None and r.token_count is None


def test_degrees_and_abbreviations(sections):
    title, units = sections("LIBRARIAN Kim Poe Education M.Ed : Library Studies 2011 St. Olga's College B.S : Chemistry 2003 Hilltop University Skills Cataloguing, chemistry")[0]
    assert title == "LIBRARIAN" and len(units["Education"]) == 1
    assert all(x in units["Education"][0] for x in ("M.Ed : Library Studies", "St. Olga's College", "B.S : Chemistry"))


def test_degree_behind_its_institution(sections):
    _, units = sections("NURSE Education 6/2001 Lakeside University Public education and Care Masters of Nursing 6/1997 Northern College Evening Program Skills Triage")[0]
    assert len(units["Education"]) == 1
    assert "Lakeside University Public education and Care Masters of Nursing" in units["Education"][0]


def test_lists_in_parentheses(spark):
    texts = ["Tools (saw, plane), glue; nails", "a), b (c, d", "", "((a, b), c), d", "no, list", "),(,),"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(segment.outside_parentheses(F.col("t"))).collect()
    assert [r[0] for r in got] == [plain.split_outside_parentheses(t) for t in texts]
    assert got[0][0] == ["Tools (saw, plane)", " glue", " nails"] and got[1][0] == ["a)", " b (c, d"] and got[2][0] == [""]


def test_prose_is_no_heading(sections):
    _, units = sections("CLERK Experience Problem Solving Skills used daily. Taught Special Education classes. Skills Excel, etc, view")[0]
    assert units["Skills"] == ["Excel"] and any("Special Education" in u for u in units["Experience"])


def test_without_headings_everything_is_experience(sections):
    for text in ("Wrote letters. Kept books.", "Skills etc, view; class Education While there. Wrote letters. Kept books."):
        title, units = sections(text)[0]
        assert (title, units) == plain.extract_sections(text) or {c: u for c, u in units.items() if u} == {c: u for c, u in plain.extract_sections(text)[1].items() if u}
    assert sections("Wrote letters. Kept books.")[0][1]["Experience"] == ["Wrote letters.", "Kept books."]


def made_resume(rng):
    some = (
        "Education|Experience|Skills|Summary|Highlights|Interests|Special Education|Problem Solving Skills|Education and Training|Education GPA|CLERK|DATA/ENTRY|Dr.|e.g.|B.S.|U.S.A.|St. Olga|M.Ed.|"
        "Managed|Developed|plans.|books!|letters?Kept|(a, b|c)|;|,|etc|etc.|While|This was|Excel|Python|SQL|one two|one two|one two three|x|é ß|2011|Company Name|• |__|a@b.org|The end.|Prepared ledgers for mills;|;; "
    ).split("|")
    return " ".join(rng.choices(some, k=rng.randrange(1, rng.choice([8, 40, 160]))))


def test_sections_and_units_are_those_of_plain_python(spark, sections):
    rng = random.Random(11)
    texts = [made_resume(rng) for _ in range(500)] + ["", None]
    for text, (title, units) in zip(texts, sections(*texts), strict=True):
        want_title, want = plain.extract_sections(text or "")
        assert title == want_title and {c: u for c, u in units.items() if u} == {c: u for c, u in want.items() if u}, text
    raw = [t.replace("  ", "\n") for t in texts[:200] if t]
    rows = segment.with_units(spark.createDataFrame(list(enumerate(raw)), "n int, t string"), F.col("t")).orderBy("n").collect()
    for text, r in zip(raw, rows, strict=True):
        assert {c: r[c.lower()] for c in CATEGORIES} == {c: plain.split_units(text, c) for c in CATEGORIES}, text


def test_long_units_are_cut_at_actions(spark):
    text = "Managed " + " ".join(f"thing{k}" for k in range(60)) + " Developed plans"
    assert segment.with_units(spark.createDataFrame([(text,)], "t string"), F.col("t")).first().experience[-1] == "Developed plans"


def test_only_repeats_and_choices_leave_the_jvm(spark):
    """Scores, priorities, sentences, headings and spans are columns."""
    from matchloom.operators import select_catalog

    df = spark.createDataFrame([("a", "b")], "t string, u string")
    tasks = spark.createDataFrame([("k", [(1, "Weigh ore.", True, 5.0), (2, "...", True, 5.5)])], "key string, tasks array<struct<pos:long,text:string,core:boolean,support:double>>")
    ranked = select_catalog.priorities(tasks, "key")
    assert [tuple(r) for r in ranked.collect()] == [("k", 1, True, 5.0, 1), ("k", 2, True, 5.5, 2)]
    for done in (df.select(select_person.scores(F.col("t"), "Skills", content_words(F.col("u")))), ranked, df.select(segment.pieces(F.col("t"), "Skills"), segment.stretches(F.col("t"))), df.select(letter_words(F.col("t")))):
        plan = done._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan and "InPandas" not in plan


def test_normalize_repeats_and_placeholders(spark):
    from matchloom.functions import repeats

    text = "• Company Name － City , State , USA one two three one two three x@y.org __ end,"
    assert spark.createDataFrame([(text,)], "t string").select(repeats.normalize(F.col("t"))).first()[0] == plain.normalize(text) == "one two three end"


def test_a_catalogue_choice_counts_each_part_a_few_times(monkeypatch):
    """Every skill tried had all chosen ones counted again, so the work went by the square of the skills."""
    looks = []
    piece = Costs.piece
    monkeypatch.setattr(Costs, "piece", lambda self, text: looks.append(text) or piece(self, text))
    skills = [f"skill{n}" for n in range(600)]
    tasks = with_words([{"text": f"Task {n} of many.", "core": n % 2 == 0, "support": float(n)} for n in range(6)])
    many = CatalogChoice("Title", "Text.", skills, tasks, COUNTER, 5000).run()
    assert len(many[2]) == 600 and len(looks) < 3 * 606
    assert many == CatalogChoice("Title", "Text.", skills, tasks, Costs(COUNTER), 5000).run()
