"""Sections and units by plain Python, one text at a time: the slow version that the column functions are compared with."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

from matchloom.functions.text import ACTION, OUTER, SCRUBS, STOP
from matchloom.operators.segment import CATEGORY, DEBRIS, DOT, HEADINGS, LEAST_WORDS, LONG_UNIT, NO_DEGREE, ROLE, SKILL_LEADS
from matchloom.schemas import CATEGORIES

REPEAT = r"\b(\S++(?:\s++\S++){1,15})\s++\1(?=\s|$)"
ABBREVIATION = r"\b(?:[A-Za-z]\.){2,}|\b(?:Dr|Mr|Ms|St|Univ|M\.Ed|B\.S)\."
SENTENCE = r"(?<=[.!?])\s+(?=[A-Z])|(?<=[a-z][.!?])(?=[A-Z])|[\r\n]+"
LOOK_BEFORE, LOOK_BEHIND = 22, 35
NOT_AFTER = {
    "Education": r"(?:Special|Elementary|Secondary|General|Physical)\s+$",
    "Skills": r"(?:Solving|Organizational|Telephone|Communication|Clinical)\s+$",
}
NOT_BEFORE = {"Education": r"\s+(?:and Safety|endorsement|Elementary|GPA|\d{4}\s+Southern)"}

_SCRUBS = [(re.compile(p), r) for p, r in SCRUBS]
_REPEAT = re.compile(REPEAT, re.IGNORECASE)
_HEADING = re.compile(rf"\b({HEADINGS})\b")
_KIND = {name: category for category, names in CATEGORY.items() for name in names}
_ABBREVIATION, _SENTENCE = re.compile(ABBREVIATION), re.compile(SENTENCE)
_LEAD, _DEED = re.compile(rf"\s+(?=(?:{SKILL_LEADS})\b)"), re.compile(rf"\s+(?={ACTION}\b)")
_TOKEN = re.compile(r"[a-z][a-z0-9+#-]*")
_STOP = frozenset(STOP)


def collapse_repeats(text: str, passes: int = 3) -> str:
    for _ in range(passes):
        text = _REPEAT.sub(r"\1", text)
    return text


def normalize(text: str) -> str:
    for pattern, instead in _SCRUBS:
        text = pattern.sub(instead, text)
    return collapse_repeats(" ".join(text.split()).strip(OUTER))


def content_words(text: str) -> frozenset[str]:
    return frozenset(_TOKEN.findall(text.lower())) - _STOP


def stable_distinct(units) -> list[str]:
    """Normalised units, the first of each key; the key is case-folded with single blanks for all but word characters."""
    by_key: dict[str, str] = {}
    for unit in map(normalize, units):
        by_key.setdefault(re.sub(r"\W+", " ", unit.casefold()).strip(), unit)
    by_key.pop("", None)
    return list(by_key.values())


def split_outside_parentheses(text: str) -> list[str]:
    """Parts between commas and semicolons that no parenthesis encloses; a surplus closing one counts for nothing."""
    level, cuts = 0, [-1]
    for at, c in enumerate(text):
        if c in "()":
            level = level + 1 if c == "(" else max(level - 1, 0)
        elif level == 0 and c in ",;":
            cuts.append(at)
    return [text[a + 1 : b] for a, b in pairwise([*cuts, len(text)])]


def _skills(sentence: str) -> Iterator[str]:
    return chain.from_iterable(map(_LEAD.split, split_outside_parentheses(sentence)))


def _courses(sentence: str) -> Iterable[str]:
    return sentence.split(";")


def _statements(sentence: str) -> Iterable[str]:
    return _DEED.split(sentence) if len(sentence.split()) > LONG_UNIT else (sentence,)


#: How a category's sentences are cut further.
CUTS = {"Skills": _skills, "Education": _courses}


def split_units(text: str, category: str) -> list[str]:
    """Whole units of a section: sentences, cut further as its category needs."""
    cut = CUTS.get(category, _statements)
    shielded = _ABBREVIATION.sub(lambda m: m[0].translate({ord("."): DOT}), text)
    return stable_distinct(unit for sentence in _SENTENCE.split(shielded) for unit in cut(sentence.translate({ord(DOT): "."})))


def headings(text: str) -> list[re.Match]:
    """Headings, without those that their neighbourhood shows to be prose."""

    def real(m: re.Match) -> bool:
        before, behind = text[max(0, m.start() - LOOK_BEFORE) : m.start()], text[m.end() : m.end() + LOOK_BEHIND]
        ahead, after = NOT_AFTER.get(m[0]), NOT_BEFORE.get(m[0])
        return not (ahead and re.search(ahead, before)) and not (after and re.match(after, behind))

    return [m for m in _HEADING.finditer(text) if real(m)]


def stretches(text: str) -> list[tuple[str | None, str]]:
    """What stands before the first heading, then each heading's category with what stands behind it up to the next."""
    marks = [(0, 0, None), *((*m.span(), _KIND.get(m[0])) for m in headings(text)), (len(text), len(text), None)]
    return [(category, text[begin:end].strip()) for (_, begin, category), (end, _, _) in pairwise(marks)]


#: What a unit must be like to count, in the categories that ask for something.
COUNTS = {
    "Skills": lambda unit: unit.casefold().strip(".") not in DEBRIS,
    "Education": lambda unit: len(content_words(unit)) >= LEAST_WORDS and not re.match(NO_DEGREE, unit),
}


def extract_sections(raw: str) -> tuple[str, dict[str, list[str]]]:
    """(title, units by category) of a resume; without any unit the whole text counts as experience."""
    text = normalize(raw)
    (_, head), *sections = stretches(text)
    role = re.match(ROLE, head)
    title = (role[0] if role else head).strip() if sections else ""
    by_category = {c: [u for category, part in sections if category == c for u in split_units(part, c)] for c in CATEGORIES}
    units = {c: [u for u in stable_distinct(found) if COUNTS.get(c, bool)(u)] for c, found in by_category.items()}
    if not any(units.values()):
        units["Experience"] = split_units(text, "Experience")
    return title, units
