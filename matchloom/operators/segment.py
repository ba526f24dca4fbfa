"""Sections and units out of resume-like text, as column functions.

A text is marked at its headings and split there, a section's text at the ends of sentences and then as its category
needs. All units of a row are scrubbed, freed of repeated phrases in one batch (functions.repeats) and made distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.repeats import collapse_repeats_each, normalize
from ..functions.text import ACTION, SPACE, UNSEEN, casefold, content_words, scrub, stable_distinct, stripped, tidy, word_count
from ..schemas import CATEGORIES

#: Headings, compound names before their parts, and the categories of some.
HEADINGS = (
    "Education and Training|Professional Experience|Professional Summary|Professional Affiliations|Additional Information|Activities and Honors|"
    "Areas of Expertise|Technical Skills|Computer Skills|Skill Highlights|Core Strengths|Career Overview|Work Experience|Work History|"
    "Accomplishments|Qualifications|Certifications|Publications|Presentations|Community Service|Affiliations|Achievements|Highlights|"
    "Experience|Employment|Education|Summary|Profile|Skills|Interests|Languages|Portfolio"
)
CATEGORY = {
    "Education": ("Education", "Education and Training"),
    "Experience": ("Professional Experience", "Work Experience", "Work History", "Experience", "Employment", "Accomplishments"),
    "Skills": (
        "Skills", "Technical Skills", "Computer Skills", "Skill Highlights", "Core Strengths", "Highlights", "Areas of Expertise",
        "Qualifications", "Certifications", "Languages",
    ),
    "Summary": ("Summary", "Professional Summary", "Career Overview", "Profile"),
}
#: What stands before or behind a word that only looks like a heading.
NOT_AFTER = {
    "Education": "Special|Elementary|Secondary|General|Physical",
    "Skills": "Solving|Organizational|Telephone|Communication|Clinical",
}
NOT_BEFORE = {"Education": r"and Safety|endorsement|Elementary|GPA|\d{4} Southern"}
#: Fixed values.
DEBRIS = (
    "dec", "view", "works", "etc", "etc.", "increase", "class", "office", "clients", "client", "phone", "written", "government", "features",
    "forms", "managers", "printer", "fax machine", "works great with others",
)
#: Abbreviations whose full stop ends no sentence; single letters with full stops, two or more, are others.
ABBREVIATIONS = r"Dr|Mr|Ms|St|Univ|M\.Ed|B\.S"
#: Words that open a skill of their own.
SKILL_LEADS = "Adobe|Microsoft|Proficient|Strong|Excellent|Knowledgeable|Qualified|Certified|CPR|HIPAA|Trained|Python|SQL|Windows|Linux|Ability|Skilled|Experienced"
#: The part of a title that is a role, in capitals.
ROLE = r"[A-Z][A-Z0-9/&()-]*(?:\s+[A-Z0-9/&()-]+)*(?=\s|$)"
#: How prose begins that is no entry of an education section.
NO_DEGREE = r"(?:While|I |This |Also )"
#: Words of a unit from which on it is cut at actions, and content words that an education needs.
LONG_UNIT, LEAST_WORDS = 55, 3
#: Stands for a full stop that ends no sentence; marks a cut and the end of a heading. The latter two are in no text.
DOT, CUT, MARK = "․", "﷐", "﷑"

#: Full stops of abbreviations: behind the first letter of two, behind a further one, behind a known one.
_SHIELDED = rf"\.(?:(?<=\b[A-Za-z]\.)(?=[A-Za-z]\.)|(?<=\b[A-Za-z]\.[A-Za-z]\.)|(?<=\b(?:{ABBREVIATIONS})\.))"
_SENTENCE = rf"{UNSEEN}(?<=[.!?]){SPACE}+(?=[A-Z])|(?=[A-Z])(?<=[a-z][.!?])|[\r\n]+"


def _heading_pattern() -> str:
    """Headings in normalised text, without those that their neighbourhood shows to be prose."""
    names = []
    for name in HEADINGS.split("|"):
        before = f"(?<!(?:{NOT_AFTER[name]}) )" if name in NOT_AFTER else ""
        behind = f"(?! (?:{NOT_BEFORE[name]}))" if name in NOT_BEFORE else ""
        names.append(f"{before}{name}\\b{behind}")
    return rf"\b(?=[A-Z])({'|'.join(names)})"


_HEADING = _heading_pattern()


def cut_at(text: Column, pattern: str) -> Column:
    """Parts between matches. Replacing keeps the compiled pattern, which splitting by a pattern doesn't."""
    return F.split(F.regexp_replace(text, pattern, CUT), CUT)


def _cut_each(texts: Column, cut) -> Column:
    return F.flatten(F.transform(texts, cut))


def outside_parentheses(text: Column) -> Column:
    """Parts between commas and semicolons that no parenthesis encloses; a surplus closing one counts for nothing."""
    state = lambda level, out: F.struct(level.alias("level"), out.alias("out"))

    def step(s: Column, t: Column) -> Column:
        level = F.when(t == "(", s["level"] + 1).when(t == ")", F.greatest(s["level"] - 1, F.lit(0))).otherwise(s["level"])
        return state(level, F.concat(s["out"], F.array(F.when(s["level"] == 0, F.regexp_replace(t, "[,;]", CUT)).otherwise(t))))

    tokens = cut_at(text, r"(?<=[()])|(?=[()])")
    cut = F.aggregate(tokens, state(F.lit(0), F.array().cast("array<string>")), step, lambda s: F.array_join(s["out"], ""))
    return F.when(F.contains(text, F.lit("(")), F.split(cut, CUT)).otherwise(cut_at(text, "[,;]"))


def _skills(sentence: Column) -> Column:
    return _cut_each(outside_parentheses(sentence), lambda part: cut_at(part, rf"{UNSEEN}{SPACE}+(?=[A-Z])(?=(?:{SKILL_LEADS})\b)"))


def _courses(sentence: Column) -> Column:
    return F.split(sentence, ";")


def _statements(sentence: Column) -> Column:
    return F.when(word_count(sentence) > LONG_UNIT, cut_at(sentence, rf"{UNSEEN}{SPACE}+(?=[A-Z])(?={ACTION}\b)")).otherwise(F.array(sentence))


#: How a category's sentences are cut further.
CUTS = {"Skills": _skills, "Education": _courses}


def sentences(text: Column) -> Column:
    return F.transform(cut_at(F.regexp_replace(text, _SHIELDED, DOT), _SENTENCE), lambda s: F.replace(s, F.lit(DOT), F.lit(".")))


def pieces(text: Column, category: str) -> Column:
    """Whole units of a section as they are written: sentences, cut further as its category needs."""
    return parts(sentences(text), category)


def parts(sentences: Column, category: str) -> Column:
    return _cut_each(sentences, CUTS.get(category, _statements))


def with_fixed(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are computed once a row. Spark would put a column's expression wherever a vector function's argument uses it, here once a unit; into a generator's output it puts nothing."""
    return rows.select("*", F.inline_outer(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def with_distinct(rows: DataFrame, text: Column, lists: dict[str, Column]) -> DataFrame:
    """rows with a column a list of the text's units, normalised, the first of each key. Scrubbing again takes what repeats had kept apart."""
    clean = lambda u: F.when(F.col("__tidy"), stripped(u)).otherwise(scrub(u))
    marked = with_fixed(rows, __tidy=tidy(text))
    shortened = marked.withColumn("__units", F.array(*[F.transform(x, clean) for x in lists.values()])).withColumn("__units", collapse_repeats_each(F.col("__units")))
    return shortened.withColumns({name: stable_distinct(F.transform(F.col("__units")[i], clean)) for i, name in enumerate(lists)}).drop("__units", "__tidy")


def with_units(rows: DataFrame, text: Column) -> DataFrame:
    """rows with education, experience, skills and summary: the text's units as each category would cut it."""
    texts = rows.withColumn("__text", F.coalesce(text, F.lit("")))
    cut = with_fixed(texts, __sentences=sentences(F.col("__text")))
    return with_distinct(cut, F.col("__text"), {c.lower(): parts(F.col("__sentences"), c) for c in CATEGORIES}).drop("__text", "__sentences")


def stretches(text: Column) -> Column:
    """What stands before the first heading, with no category, then each heading's category and what stands behind it up to the next."""
    category = F.create_map(*[F.lit(x) for c, names in CATEGORY.items() for n in names for x in (n, c)])
    parts = F.split(F.regexp_replace(text, _HEADING, f"{CUT}$1{MARK}"), CUT)

    def part(p: Column) -> Column:
        named = F.contains(p, F.lit(MARK))
        kind = F.when(named, F.try_element_at(category, F.substring_index(p, MARK, 1)))
        return F.struct(kind.alias("category"), F.trim(F.when(named, F.substring_index(p, MARK, -1)).otherwise(p)).alias("text"))

    return F.transform(parts, part)


#: What a unit must be like to count, in the categories that ask for something.
COUNTS = {
    "Skills": lambda unit: ~F.btrim(casefold(unit), F.lit(".")).isin(*DEBRIS),
    "Education": lambda unit: (F.size(content_words(unit)) >= LEAST_WORDS) & ~unit.rlike("^" + NO_DEGREE),
}


def _title(found: Column) -> Column:
    head = found[0]["text"]
    role = F.regexp_extract(head, f"^({ROLE})", 1)
    return F.when(F.size(found) > 1, F.when(role != "", F.trim(role)).otherwise(head)).otherwise("")


def with_sections(rows: DataFrame, text: Column) -> DataFrame:
    """rows with whole (the normalised text), title and the units of education, experience, skills and summary.

    Without any unit the whole text counts as experience.
    """
    marked = with_fixed(rows.withColumn("whole", normalize(F.coalesce(text, F.lit("")))), __found=stretches(F.col("whole")))
    of = lambda c: F.transform(F.filter("__found", lambda x: x["category"] == c), lambda x: x["text"])
    cutter = lambda c: lambda t: pieces(t, c)
    lists = {c.lower(): _cut_each(of(c), cutter(c)) for c in CATEGORIES}
    # Any unit of experience or summary counts; only where neither has any the whole text may be needed.
    needed = F.size(F.filter("__found", lambda x: x["category"].isin("Experience", "Summary") & x["text"].rlike(r"[\p{L}\p{N}_]"))) == 0
    lists["__else"] = F.when(needed, pieces(F.col("whole"), "Experience")).otherwise(F.array().cast("array<string>"))
    done = with_distinct(marked, F.col("whole"), lists).withColumns({c.lower(): F.filter(c.lower(), counts) for c, counts in COUNTS.items()})
    empty = sum((F.size(c.lower()) for c in CATEGORIES), F.lit(0)) == 0
    return done.withColumn("title", _title(F.col("__found"))).withColumn("experience", F.when(empty, F.col("__else")).otherwise(F.col("experience"))).drop("__found", "__else")
