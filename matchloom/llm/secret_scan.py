"""Secret scan, in DataFrame functions only.

Three fixed patterns (assign, access, hex) give the base spans. The method adds spans of kind
``entropy``: candidate strings are runs of 20 and more characters of A-Z a-z 0-9 + / = _ -.
Each belongs to the first class that covers it:

    hex       0-9 a-f        windows of 20, 3.0 bits or more
    HEX       0-9 A-F        windows of 20, 3.0 bits or more
    lower     no upper case  windows of 20, 3.5 to 3.7 bits or more
    upper     no lower case  windows of 20, 3.45 to 3.6 bits or more
    letters   no digit       windows of 20, 3.7 to 3.9 bits or more
    base64    all the rest   windows of 20, 3.75 to 3.9 bits or more

The largest of many windows is higher than that of one, so the limit rises evenly from a candidate of 20 characters to one
of 32 and then stands: at each length all but a few in a hundred random keys of the class reach it (``LIMITS``).
A window slides over the candidate one character at a time. The count of each character in
the window is kept in a string, a character a count, and moves by one up for the entering and one
down for the leaving character; with them moves sum(n * log2 n), from which the entropy follows. The
largest entropy of any window counts. Candidates need two of digits, upper- and lower-case letters, so
that words of one case aren't scored, and are suppressed when an allow-list pattern fits them or
the characters before them (check sums, uuids, paths, names, sample keys), or when a base span
already covers a part of them.

Positions are code points, end exclusive; they are found without Python: ``split`` gives the
text between the matches and ``regexp_extract_all`` the matches, and lengths add up.
Every text is read whole, and the time grows in proportion to its length and its matches (``scanned``). No
row leaves its task: there is no shuffle.

Defined results: null and empty texts have no span; very long texts and candidates are scanned to their
end; a null doc_id and repeated rows each give their own row; spans that begin at one place come in the
order of KINDS; an empty table gives none; other columns are not looked at.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, id_and_text, scanned, spans_text

#: Fixed values.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_GATE = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
VALUE = r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: Runs, whose matches are those of AKIA[A-Z0-9]+ with 16 and [0-9a-f]+ with 32 or more characters.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
WINDOW = 20
#: Sums move by rounding errors; an entropy this little under a limit counts as at it.
SLACK = 1e-9
#: Limits in bits for candidates of WINDOW characters and of FULL and more.
LIMITS = {"hex": (3.0, 3.0), "HEX": (3.0, 3.0), "lower": (3.5, 3.7), "upper": (3.45, 3.6), "letters": (3.7, 3.9), "base64": (3.75, 3.9)}
FULL = 32
#: Patterns of the classes but the last, in turn.
CLASSES = {"hex": "^[0-9a-f]+$", "HEX": "^[0-9A-F]+$", "lower": "^[^A-Z]+$", "upper": "^[^a-z]+$", "letters": "^[^0-9]+$"}
#: Patterns of strings that are no secrets.
ALLOWED = [
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)example|sample|dummy|placeholder|changeme|xxxxx",
    r"(?i)abcdefghij|0123456789",
]
#: Shapes of strings that are no secrets, as (what fits, what doesn't). No pattern repeats a group: the JVM would go one call deeper a repetition.
SHAPES = [
    # Paths of short lower-case parts.
    ([r"^[a-z0-9_/-]+$", r"[^/]/[^/]+/"], [r"//|[^/]{20}/"]),
    # Words and numbers of one case, each by itself between signs.
    ([r"^[a-z0-9_/-]+$", r"[_/-]"], [r"[a-z][0-9]|[0-9][a-z]"]),
    ([r"^[A-Z0-9_/-]+$", r"[_/-]"], [r"[A-Z][0-9]|[0-9][A-Z]"]),
    # Names of words in camel, snake or kebab case, with a short number behind.
    ([r"^[A-Za-z_-]+[0-9]{0,4}$"], [r"[A-Z][^a-z]|[A-Z]$|[_-][_-]|[_-][a-z][^a-z]|[_-][a-z]$"]),
]
#: What may stand before a check sum.
ALLOWED_BEFORE = r"(?i)(sha-?(1|224|256|384|512)|md5|crc32|checksum|integrity|digest|commit)[\s\"':=-]{1,3}$"
KINDS = ["assign", "access", "hex", "entropy"]


SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string,before:string>"


def _spans(pattern: str, gate: Column, kind: str, keep, before: bool = False) -> Column:
    """All matches as an array of (start, rank, end, kind, value, before); gate false: none."""
    pairs = F.arrays_zip(F.split("text", pattern, -1).alias("gap"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("hit"))

    def one(at: Column, pair: Column) -> Column:
        start = at + F.char_length(pair["gap"])
        span = F.struct(
            start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (start + F.char_length(pair["hit"])).alias("end"), F.lit(kind).alias("kind"), pair["hit"].alias("value"),
            (F.right(pair["gap"], F.lit(20)) if before else F.lit("")).alias("before"),
        )
        return F.when(pair["hit"].isNotNull() & keep(pair["hit"]), span)

    move = lambda at, pair: at + F.char_length(pair["gap"]) + F.coalesce(F.char_length(pair["hit"]), F.lit(0))
    return F.when(gate, scanned(pairs, F.lit(0), move, one, SPAN)).otherwise(F.array().cast(f"array<{SPAN}>"))


def largest_entropy(value: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits a character, of any window of an ASCII string.

    Strings shorter than the window count as one window of their own length.
    """
    nlog = [0.0] + [n * math.log2(n) for n in range(1, window + 1)] + [0.0]
    weights = F.expr("array(" + ", ".join(f"{x!r}D" for x in nlog) + ")")
    base = 65  # a count n is written as the character with this code and n
    places = F.transform(F.split(value, ""), lambda c: F.ascii(c) + 1)
    #: Each character with the one that leaves as it enters: 0, none, for the first window.
    moves = bound(places, lambda p: F.arrays_zip(p.alias("i"), F.slice(F.concat(F.array_repeat(F.lit(0), window), p), F.lit(1), F.size(p)).alias("o")))
    count = lambda counts, place: F.ascii(counts.substr(place, F.lit(1))) - base
    put = lambda counts, place, n: F.overlay(counts, F.char(n + base), place, F.lit(1))

    def step(a: Column, p: Column) -> Column:
        entering, leaving = p["i"], p["o"]
        ci, co = count(a["c"], entering), count(a["c"], leaving)
        up = F.get(weights, ci + 1) - F.get(weights, ci)
        down = F.when(leaving > 0, F.get(weights, co - 1) - F.get(weights, co)).otherwise(0.0)
        entered = put(a["c"], entering, ci + 1)
        same = entering == leaving
        counts = F.when(same, a["c"]).when(leaving > 0, put(entered, leaving, co - 1)).otherwise(entered)
        s = F.when(same, a["s"]).otherwise(a["s"] + up + down)
        n = a["n"] + 1
        return F.struct(counts.alias("c"), s.alias("s"), n.alias("n"), F.when(n >= window, F.least(a["m"], s)).otherwise(a["m"]).alias("m"))

    zero = F.struct(F.lit(chr(base) * 128).alias("c"), F.lit(0.0).alias("s"), F.lit(0).alias("n"), F.lit(1e18).alias("m"))
    whole = lambda a: F.log2(F.greatest(a["n"], F.lit(1)).cast("double")) - a["s"] / F.greatest(a["n"], F.lit(1))
    return F.aggregate(moves, zero, step, lambda a: F.when(a["n"] < window, whole(a)).otherwise(F.lit(math.log2(window)) - a["m"] / F.lit(float(window))))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy."""
    always = lambda m: F.lit(True)
    rows = (
        id_and_text(docs)
        .withColumn("assign", _spans(ASSIGN, F.col("text").rlike(ASSIGN_GATE), "assign", lambda m: F.char_length(F.regexp_replace(m, VALUE, "")) >= 8))
        .withColumn("access", _spans(ACCESS, F.contains(F.col("text"), F.lit("AKIA")), "access", always))
        .withColumn("hex", _spans(HEX, F.col("text").rlike(HEX), "hex", always))
        .withColumn("base", F.concat("assign", "access", "hex"))
        .withColumn("runs", _spans(CANDIDATE, F.col("text").rlike(CANDIDATE), "entropy", lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]") | m.rlike("[a-z]") & m.rlike("[A-Z]"), before=True))
    )
    value = lambda c: c["value"]
    shaped = lambda v, yes, no: reduce(Column.__and__, [*(v.rlike(p) for p in yes), *(~v.rlike(p) for p in no)])
    listed = lambda v: reduce(Column.__or__, [v.rlike("|".join(f"(?:{p})" for p in ALLOWED)), *(shaped(v, *s) for s in SHAPES)])
    allowed = lambda c: listed(value(c)) | c["before"].rlike(ALLOWED_BEFORE)
    rise = lambda c, k: F.lit(LIMITS[k][0]) + F.lit((LIMITS[k][1] - LIMITS[k][0]) / (FULL - WINDOW)) * (F.least(F.char_length(value(c)), F.lit(FULL)) - WINDOW)
    limit = lambda c: F.coalesce(*[F.when(value(c).rlike(p), rise(c, k)) for k, p in CLASSES.items()], rise(c, "base64"))
    #: All spans by start, each with the next: a run is covered if a base span before it reaches into it, or the next span is one that begins in it.
    sorted_spans = F.array_sort(F.concat("base", "runs"))
    in_turn = bound(sorted_spans, lambda e: F.arrays_zip(e.alias("s"), F.slice(e, F.lit(2), F.size(e)).alias("next")))
    is_run = lambda c: c["rank"] == KINDS.index("entropy")
    reach = lambda r, p: F.when(is_run(p["s"]), r).otherwise(F.greatest(r, p["s"]["end"]))
    begins_in = lambda p: F.coalesce(~is_run(p["next"]) & (p["next"]["start"] < p["s"]["end"]), F.lit(False))
    free = scanned(in_turn, F.lit(0), reach, lambda r, p: F.when(is_run(p["s"]) & (r <= p["s"]["start"]) & ~begins_in(p), p["s"]), SPAN)
    added = F.filter(F.filter(free, lambda c: ~allowed(c)), lambda c: largest_entropy(value(c)) >= limit(c) - SLACK)
    rows = rows.withColumn("added", F.when(F.size("runs") > 0, added).otherwise(F.col("runs")))
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_entropy"),
    )
