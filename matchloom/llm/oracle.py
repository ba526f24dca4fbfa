"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from . import secret_scan
from .license_scan import BETWEEN, HOLDER, LATER, LEAD, MARKS, NAMED, NOTICE, PREFIX, RETURNS, RULES, SENTENCES, TAGGED, TAIL, WORDS
from .url_filter import LISTED
from .url_filter import RULES as URL_RULES

EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
k AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER w AS nth
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, nth = 1 AS kept, text_sha256 FROM k
"""


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def url_sql() -> str:
    entries = [(e, 1, v) for e, v in URL_RULES] + [(e, 0, "block") for e in LISTED]
    values = ", ".join(f"({_q(e)}, {_q(e.split('/')[0])}, {_q(e[e.index('/'):])}, {tier}, {_q(v)})" for e, tier, v in entries)
    return f"""
WITH rules(rule, rhost, rpath, tier, said) AS (VALUES {values}),
p AS (
  SELECT row_number() OVER () AS rid, page_id, url,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
c AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\\.+$', '') AS chost,
         CASE WHEN path = '' THEN '/' ELSE path END AS cpath  -- enough for a list of whole hosts
  FROM p),
f AS (
  SELECT c.*, r.rule, r.tier, r.said, row_number() OVER (PARTITION BY rid ORDER BY r.tier DESC NULLS LAST, length(r.rule) DESC) AS nth
  FROM c LEFT JOIN rules r
    ON CASE r.tier WHEN 1 THEN (host = r.rhost OR ends_with(host, '.' || r.rhost)) AND starts_with(path, r.rpath)
       ELSE (chost = r.rhost OR ends_with(chost, '.' || r.rhost)) AND starts_with(cpath, r.rpath) END)
SELECT page_id, host, path, CASE WHEN tier = 1 THEN rule END AS rule, coalesce(said, 'allow') AS verdict
FROM f WHERE nth = 1
"""


def license_sql() -> str:
    """No gate: every text is cut and looked up."""
    keys = "[" + ", ".join(map(_q, SENTENCES)) + "]"
    values = "[" + ", ".join(map(_q, SENTENCES.values())) + "]"
    holder, named = map(_q, HOLDER)
    normal = f"regexp_replace(replace(trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')), 'licence', 'license'), {holder}, {named})"
    names, ids = ("[" + ", ".join(map(_q, x)) + "]" for x in (NAMED, NAMED.values()))
    parts = f"string_split_regex(regexp_replace(regexp_replace(s, {_q(PREFIX)}, ''), {_q(LATER)}, '', 'g'), {_q(BETWEEN)})"
    part_ids = f"list_transform({parts}, lambda p: {ids}[list_position({names}, regexp_replace(regexp_replace(p, {_q(LEAD)}, ''), {_q(TAIL)}, ''))])"
    known = f"CASE WHEN list_contains({keys}, s) THEN [{values}[list_position({keys}, s)]] WHEN regexp_matches(s, {_q(PREFIX)}) THEN list_filter({part_ids}, lambda p: p IS NOT NULL) ELSE [] END"
    cut = "string_split(regexp_replace(lower({}), '([.!?;])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10))"
    place = "CAST(coalesce(list_sum(sizes[1:i - 1]), 0) AS BIGINT)"
    found = (
        f"(SELECT flatten(list_transform(range(1, len(ids) + 1), lambda i: list_transform(ids[i], lambda z: {{{{'at': {place}, 'id': z}}}}))) FROM "
        f"(SELECT list_transform(list_transform(pieces, lambda x: {normal}), lambda s: {known}) AS ids, "
        "list_transform(pieces, lambda x: length(regexp_replace(x, '\\s+', '', 'g'))) AS sizes FROM (SELECT {} AS pieces)))"
    )
    clean = "coalesce(text, '')"
    for pattern, instead in ((RETURNS, "chr(10)"), (WORDS, "''"), (MARKS, "''"), (NOTICE, "'\\0' || chr(10)"), (TAGGED, "'\\0' || chr(10)")):
        clean = f"regexp_replace({clean}, {_q(pattern.replace('(?md)', '(?m)').replace('(?mid)', '(?mi)'))}, {instead}, 'g')"
    lines, wrapped = found.format(cut.format("text")), found.format(cut.format("regexp_replace(text, '([^\\n])\\n([^\\n])', '\\1 \\2', 'g')"))
    fits = ", ".join(
        f"CASE WHEN regexp_matches(seq, {_q('.*'.join(f' {i} ' for i in r))}) THEN {_q(name)} END" for name, r, _ in RULES
    )
    hidden = ", ".join(
        f"CASE WHEN list_contains(fits, {_q(name)}) THEN [{', '.join(map(_q, hides))}] ELSE [] END" for name, _, hides in RULES if hides
    )
    names = "[" + ", ".join(_q(n) for n in dict.fromkeys(name for name, _, _ in RULES)) + "]"
    return f"""
WITH d AS (SELECT doc_id, {clean} AS text FROM documents),
b AS (SELECT doc_id, list_transform(list_sort(list_distinct(list_concat({lines}, {wrapped}))), lambda x: x.id) AS ids FROM d),
c AS (SELECT doc_id, ids, ' ' || array_to_string(ids, '  ') || ' ' AS seq FROM b),
e AS (SELECT doc_id, ids, [{fits}] AS fits FROM c),
g AS (SELECT doc_id, ids, fits, flatten([{hidden}]) AS hidden FROM e)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
       array_to_string(list_filter({names}, lambda n: list_contains(fits, n) AND NOT list_contains(hidden, n)), ',') AS licenses
FROM g
"""


def _spans_sql(pattern: str, rank: int) -> str:
    """All matches with their places: lengths of the gaps and the matches before add up."""
    p = _q(pattern)
    before = "coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)"
    start = f"CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + {before} AS BIGINT)"
    return (
        f"(SELECT list_transform(range(1, len(hits) + 1), lambda i: {{'s': {start}, 'r': {rank}, 'e': {start} + length(hits[i]), 'v': hits[i], 'b': right(gaps[i], 20)}}) "
        f"FROM (SELECT string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}) AS hits))"
    )


def secret_sql() -> str:
    kinds = "[" + ", ".join(map(_q, secret_scan.KINDS)) + "]"
    write = f"array_to_string(list_transform(list_sort(list_transform({{}}, lambda x: {{{{'s': x.s, 'r': x.r, 'e': x.e}}}})), lambda x: {kinds}[x.r + 1] || ':' || x.s || ':' || x.e), ',')"
    allowed = _q("|".join(f"(?:{p})" for p in secret_scan.ALLOWED))
    fits = lambda p: f"regexp_matches(c.v, {_q(p)})"
    shapes = " OR ".join("(" + " AND ".join([*map(fits, yes), *(f"NOT {fits(p)}" for p in no)]) + ")" for yes, no in secret_scan.SHAPES)
    w, limits = secret_scan.WINDOW, secret_scan.LIMITS
    rise = lambda k: f"{limits[k][0]}::DOUBLE + {(limits[k][1] - limits[k][0]) / (secret_scan.FULL - w)!r}::DOUBLE * (least(length(c.v), {secret_scan.FULL}) - {w})"
    limit = "(CASE " + " ".join(f"WHEN regexp_matches(c.v, {_q(p)}) THEN {rise(k)}" for k, p in secret_scan.CLASSES.items()) + f" ELSE {rise('base64')} END)"
    entropy = f"list_max(list_transform(range(0, greatest(1, length(c.v) - {w - 1})), lambda k: list_entropy(string_split(substr(c.v, k + 1, {w}), ''))))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, list_filter({_spans_sql(secret_scan.ASSIGN, 0)}, lambda x: length(regexp_replace(x.v, {_q(secret_scan.VALUE)}, '')) >= 8) AS assign,
         {_spans_sql(secret_scan.ACCESS, 1)} AS access, {_spans_sql(secret_scan.HEX, 2)} AS hex,
         list_filter({_spans_sql(secret_scan.CANDIDATE, 3)}, lambda x: (regexp_matches(x.v, '[0-9]') AND regexp_matches(x.v, '[A-Za-z]')) OR (regexp_matches(x.v, '[a-z]') AND regexp_matches(x.v, '[A-Z]'))) AS runs
  FROM d),
b AS (SELECT *, list_concat(list_concat(assign, access), hex) AS base FROM m),
a AS (
  SELECT *, list_filter(runs, lambda c: NOT regexp_matches(c.v, {allowed}) AND NOT regexp_matches(c.b, {_q(secret_scan.ALLOWED_BEFORE)})
      AND NOT ({shapes}) AND len(list_filter(base, lambda x: x.s < c.e AND c.s < x.e)) = 0 AND {entropy} >= {limit} - {secret_scan.SLACK}) AS added
  FROM b)
SELECT doc_id, CAST(len(assign) AS BIGINT) AS n_assign, CAST(len(access) AS BIGINT) AS n_access, CAST(len(hex) AS BIGINT) AS n_hex,
       sha256({write.format("base")}) AS base_sha256, {write.format("list_concat(base, added)")} AS spans, CAST(len(added) AS BIGINT) AS n_entropy
FROM a
"""


def centroid_sql(k: int = 8, rounds: int = 10, width: int = 64, seed: str = "3") -> str:
    """Full scans; doubles hold all integers in them exactly."""
    parts = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS p
  FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width})""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), p) - 1 AS c, p AS q
  FROM v QUALIFY c < {k})""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT rid, min({{'d': list_dot_product(p, p) - 2 * list_dot_product(p, q) + list_dot_product(q, q), 'c': c}}) AS best FROM v, c{r} GROUP BY rid)""")
        if r < rounds:
            parts.append(f"""m{r} AS (
  SELECT c, list(x ORDER BY i) AS q FROM (
    SELECT c, i, floor(sum(x) / count(*)) AS x FROM (SELECT a.best.c AS c, unnest(v.p) AS x, unnest(range({width})) AS i FROM a{r} a JOIN v USING (rid)) GROUP BY c, i)
  GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.q, c{r}.q) AS q FROM c{r} LEFT JOIN m{r} USING (c))""")
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, CAST(a.best.c AS INTEGER) AS cluster, CAST(a.best.d AS BIGINT) AS distance,
       CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(q, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (rid) JOIN c{rounds} ON c{rounds}.c = a.best.c
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_centroids": centroid_sql(), "op2_licenses": license_sql(), "op3_secrets": secret_sql(), "op7_urls": url_sql(), "op9_exact_dedup": EXACT_DEDUP}
