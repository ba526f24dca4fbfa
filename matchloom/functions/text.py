"""Text functions on columns; everything here stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import MISSING

#: The 29 code points that count as white space, unlike Java's ASCII class.
_ODD = r"\x09-\x0d\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = rf"[\x20{_ODD}]"
#: Runs of white space that aren't one blank; most blanks are, and stay as they are. One look passes over a visible ASCII character.
UNSEEN = r"(?![!-~])"
RUN = rf"{UNSEEN}(?:\x20{UNSEEN}{SPACE}+|(?!\x20)[{_ODD}]{SPACE}*)"

#: What scrubbing removes, in order, and what it puts there.
SCRUBS = [
    (r"[\u200b\ufeff]", ""),
    (r"[\u2022\u25cf\u25e6]", " "),
    (r"https?://\S+|www\.\S+|\b[\w.+-]+@[\w.-]+\.[A-Za-z]+\b", " "),
    (r"\bCompany Name\b", " "),
    (r"[－–—-]?\s*\bCity\s*,\s*State\b(?:\s*,\s*(?:United States|USA|US))?", " "),
    (r"_{2,}", " "),
]
#: Substrings without which the pattern at the same place can't match.
SCRUB_SIGNS = [("\u200b", "\ufeff"), ("\u2022", "\u25cf", "\u25e6"), ("http", "www.", "@"), ("Company Name",), ("City",), ("__",)]
#: What is stripped from both ends.
OUTER = " ,;-－–—"
#: Words that say nothing about a text's content.
STOP = (
    "a an the and or of to in for with on as at by from my i me our their that this is are was were have has had it its be being been "
    "work working worked skills experience ability strong excellent professional company city state"
).split()
#: Verbs that open a statement of what somebody did.
ACTION = (
    "(?:Analyzed|Analyze|Designed|Design|Developed|Created|Managed|Maintained|Coordinated|Implemented|Prepared|Provided|Conducted|Assisted|"
    "Responsible|Performed|Supported|Taught|Trained|Led|Built|Monitored|Communicated|Researched|Tested|Oversaw|Organized|Facilitated|"
    "Evaluated|Improved|Reviewed|Utilized|Collaborated|Helped)"
)
#: Names of degrees.
DEGREE = (
    r"(?:Master(?:s|'s)?(?: of [A-Za-z]+)?|Bachelor(?:s|'s)?(?: of [A-Za-z]+)?|Associate(?: of [A-Za-z]+ [A-Za-z]+| Degree)?"
    r"|BSEE|BBA|MBA|AAS Degree|M\.Ed|B\.S|BA|BS|AA|Certificate in [A-Za-z ]+(?= :))"
)


def once(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Rare letters that fold to another form than their small letter; ß and ς, the common ones, are replaced without a table.
FOLDED = {c: c.casefold() for c in map(chr, range(0x80, 0xFFFF)) if c not in "ßς" and (len(c.casefold()) > 1 or c.casefold() != c.lower())}


def _ranges(letters, gap: int = 16) -> str:
    """A character class of few ranges around the letters, which is tried faster than a class of them all."""
    out: list[list[int]] = []
    for c in sorted(map(ord, letters)):
        if out and c - out[-1][1] <= gap:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


def casefold(text: Column) -> Column:
    """Text in a form that is equal for texts that differ in case alone; ß is ss, a dotless i stays."""
    table = F.map_from_arrays(F.split(F.lit(",".join(FOLDED)), ","), F.split(F.lit(",".join(FOLDED.values())), ","))  # folded to one literal

    def folded(t: Column) -> Column:
        letters = F.transform(F.split(t, ""), lambda c: F.coalesce(F.try_element_at(table, c), F.lower(c)))
        return F.when(t.rlike(_ranges(FOLDED)), F.array_join(letters, "")).otherwise(F.lower(t))

    other = F.translate(once(F.replace(text, F.lit("ß"), F.lit("ss")), folded), "ς", "σ")  # lower-casing makes ς of a final Σ
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(other)  # ASCII, as most keys are


def collapse(text: Column) -> Column:
    """Runs of white space become one blank; none at either end."""
    return F.trim(F.regexp_replace(text, RUN, " "))


def clean(text: Column) -> Column:
    """Null and the written forms of a missing value become the empty string."""
    plain = collapse(F.coalesce(text, F.lit("")))
    return F.when(F.lower(plain).isin(*MISSING), F.lit("")).otherwise(plain)


def scrub(text: Column) -> Column:
    """Remove invisible characters, bullets, addresses and placeholders; collapse; strip separators at the ends."""
    for (pattern, instead), signs in zip(SCRUBS, SCRUB_SIGNS, strict=True):
        text = once(text, _replaced(signs, "(?U)" + pattern, instead))
    return stripped(collapse(text))


def tidy(text: Column) -> Column:
    """Whether scrubbing any part of the text could only strip its ends."""
    return ~reduce(Column.__or__, [F.contains(text, F.lit(s)) for signs in SCRUB_SIGNS for s in signs]) & ~text.rlike(RUN)


def stripped(text: Column) -> Column:
    """What scrub leaves of a part of a tidy text."""
    return F.btrim(text, F.lit(OUTER))


def _replaced(signs: tuple[str, ...], pattern: str, instead: str):
    """A replacement that is tried only on texts with one of the signs."""
    return lambda t: F.when(reduce(Column.__or__, [F.contains(t, F.lit(s)) for s in signs]), F.regexp_replace(t, pattern, instead)).otherwise(t)


def letter_words(text: Column) -> Column:
    """Distinct words of three and more letters a-z."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z]{3,})"), F.lit(1)))


def content_words(text: Column) -> Column:
    """Distinct words without stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z][a-z0-9+#-]*)"), F.lit(1)))
    return F.array_except(found, F.array(*map(F.lit, STOP)))


def dedup_key(text: Column) -> Column:
    """Letters, digits and underscores without regard to case, one blank for all else."""
    return F.trim(F.regexp_replace(casefold(text), r"[^\p{L}\p{N}_]+", " "))


def stable_distinct(units: Column) -> Column:
    """The first unit of each key, in order; units without a key go. Only where keys repeat are they sorted, in the row, so nothing is shuffled."""

    def first_ones(keyed: Column) -> Column:
        by_key = once(F.array_sort(F.transform(keyed, lambda x, i: F.struct(x["key"], i.alias("pos"), x["unit"]))), lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["key"] != x["key"])))
        in_order = F.array_sort(F.transform(by_key, lambda x: F.struct(x["pos"], x["unit"])))
        unlike = F.size(F.array_distinct(F.transform(keyed, lambda x: x["key"]))) == F.size(keyed)
        return F.when(unlike, F.transform(keyed, lambda x: x["unit"])).otherwise(F.transform(in_order, lambda x: x["unit"]))

    keyed = F.transform(units, lambda u: F.struct(dedup_key(u).alias("key"), u.alias("unit")))
    return once(F.filter(keyed, lambda x: x["key"] != ""), first_ones)


def word_count(text: Column) -> Column:
    plain = collapse(text)
    return F.when(plain == "", F.lit(0)).otherwise(F.size(F.split(plain, " ")))


def labelled(*parts: tuple[str, Column]) -> Column:
    """``Label: value`` of the parts that aren't empty, one blank between."""
    return F.concat_ws(" ", *[F.when(value != "", F.concat(F.lit(f"{label}: "), value)) for label, value in parts])


def render_catalog(title: Column, description: Column, skills: Column, tasks: Column) -> Column:
    """A catalogue profile from two texts and two arrays."""
    return labelled(("Occupation", title), ("Description", description), ("Skills", F.array_join(skills, "; ")), ("Tasks", F.array_join(tasks, " ")))


def content_digest(resume: Column, interests: Column) -> Column:
    """The SHA-256 of both texts with a NUL between."""
    return F.sha2(F.concat(resume, F.char(F.lit(0)), interests), 256)


def content_id(digest: Column, occurrence: Column) -> Column:
    """user_, the first 16 hex digits of a content's digest, two-digit occurrence."""
    number = occurrence.cast("string")
    return F.concat(F.lit("user_"), F.substring(digest, 1, 16), F.lit("_"), F.when(occurrence < 10, F.concat(F.lit("0"), number)).otherwise(number))


def match_line(rank: Column, title: Column, code: Column, score: Column) -> Column:
    return F.format_string("  %d. %s (%s) - cosine similarity %.4f", rank, title, code, score)
