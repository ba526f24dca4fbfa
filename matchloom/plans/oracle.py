"""DuckDB SQL with the results of ``queries``; what it lacks has property and example tests instead."""

from __future__ import annotations

from ..functions.repeats import LONGEST_REPEAT
from ..functions.text import ACTION, STOP
from ..operators.segment import LONG_UNIT, SKILL_LEADS
from .queries import EVERY, INTERESTS, K

_SPACE = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _collapse(t: str) -> str:
    return f"trim(regexp_replace({t}, '{_SPACE}+', ' ', 'g'))"


def _clean(t: str) -> str:
    c = _collapse(f"coalesce({t}, '')")
    return f"CASE WHEN lower({c}) IN ('', 'nan', 'none', 'null', 'n/a', 'na') THEN '' ELSE {c} END"


_STOP = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"


def _content(t: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({t}), '[a-z][a-z0-9+#-]*')), lambda w: NOT list_contains({_STOP}, w))"


def _letters(t: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({t}), '[a-z]{{3,}}'))"


_BEST = f"""
pairs AS (
  SELECT u.vec_id AS user_id, c.vec_id AS code, c.label AS label,
         greatest(-1.0, least(1.0, list_dot_product(u.embedding::DOUBLE[], c.embedding::DOUBLE[]))) AS score
  FROM embeddings u, embeddings c WHERE u.vec_id % {EVERY} = 0),
best AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, code) AS INTEGER) AS rank FROM pairs
  QUALIFY rank <= {K})
"""
_TOPK = f"WITH {_BEST} SELECT user_id, rank, code, round(score, 6) AS score FROM best"
_EVENTS = """
ev AS (
  SELECT user_id AS key, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS name, event_id AS pos, round(value, 0) AS score
  FROM events WHERE event_id % 5 <> 0 AND event_id % 11 <> 0 AND user_id IN (SELECT c_custkey FROM customer)),
top AS (
  SELECT key, name, score FROM ev QUALIFY row_number() OVER (PARTITION BY key, lower(name) ORDER BY score DESC, pos) = 1)
"""
_TURNS = f"""
turns AS (
  SELECT conv_id AS key, turn AS pos, {_clean("text")} AS text, role = 'assistant' AS core,
         CASE WHEN turn % 3 = 0 THEN 0.0 ELSE CAST(length(text) AS DOUBLE) END AS support
  FROM conversations)
"""
_TASKS = """
kept AS (
  SELECT key, min(pos) OVER (PARTITION BY key, lower(text)) AS pos, text, core, support
  FROM {source} WHERE text <> ''
  QUALIFY row_number() OVER (PARTITION BY key, lower(text) ORDER BY core DESC, support DESC, {source}.pos) = 1)
"""


def _scrub(t: str = "coalesce(text, '')") -> str:
    word = r"[\p{L}\p{N}_]"
    for pattern, instead in (
        (r"[\x{200b}\x{feff}]", ""),
        (r"[\x{2022}\x{25cf}\x{25e6}]", " "),
        (rf"https?://[^\s\x{{85}}\x{{a0}}]+|www\.[^\s\x{{85}}\x{{a0}}]+|{word}(?:{word}|[.+-])*@(?:{word}|[.-])+\.[A-Za-z]+", " "),
        (r"\bCompany Name\b", " "),
        (r"[－–—-]?\s*\bCity\s*,\s*State\b(?:\s*,\s*(?:United States|USA|US))?", " "),
        (r"_{2,}", " "),
    ):
        t = f"regexp_replace({t}, '{pattern}', '{instead}', 'g')"
    return f"trim({_collapse(t)}, ' ,;-－–—')"


def _one_pass(source: str, n: int) -> str:
    """Tokens (doc_id, i, raw, w) of source without the second of two equal phrases, the leftmost first, of these the longest."""
    order, word = "(PARTITION BY doc_id ORDER BY i)", r"[\p{L}\p{N}\p{M}_]"
    ks = range(2, LONGEST_REPEAT + 1)
    leads = ", ".join(f"lead(w, {k}) OVER o AS c{k}, coalesce(w = lead(w, {k}) OVER o, false) AS e{k}" for k in ks)
    runs = ", ".join(f"c{k}, coalesce(bool_and(e{k}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND {k - 1} FOLLOWING), false) AS r{k}" for k in ks)
    found = " UNION ALL ".join(f"SELECT doc_id, i, {k} AS k, w, c{k} AS c FROM r{n} WHERE r{k} AND ends_with(w, c{k})" for k in ks)
    return f"""
e{n} AS (SELECT *, {leads} FROM {source} WINDOW o AS {order}),
r{n} AS (SELECT doc_id, i, w, {runs} FROM e{n}),
f{n} AS (SELECT *, length(w) - length(c) AS off FROM ({found})),
b{n} AS (
  SELECT doc_id, i, k FROM f{n}
  WHERE CASE WHEN off = 0 THEN regexp_matches(c, '^{word}') ELSE regexp_matches(substr(w, off, 1), '{word}') <> regexp_matches(substr(w, off + 1, 1), '{word}') END
  QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY off, k DESC) = 1),
l{n} AS (SELECT doc_id, list({{'first': i, 'next': i + 2 * k, 'gone': [{{'a': i + k, 'b': i + 2 * k}}]}} ORDER BY i) AS all_found FROM b{n} GROUP BY doc_id),
g{n} AS (
  SELECT doc_id, unnest(list_reduce(all_found, lambda x, y: CASE WHEN y.first >= x.next THEN {{'first': x.first, 'next': y.next, 'gone': list_concat(x.gone, y.gone)}} ELSE x END).gone, recursive := true)
  FROM l{n}),
p{n} AS (
  SELECT t.doc_id, row_number() OVER (PARTITION BY t.doc_id ORDER BY t.i) AS i, t.raw, t.w
  FROM {source} t LEFT JOIN g{n} g ON g.doc_id = t.doc_id AND t.i >= g.a AND t.i < g.b WHERE g.a IS NULL)"""


def _collapse_repeats() -> str:
    return f"""WITH s AS (SELECT doc_id, {_scrub()} AS t FROM documents),
p0 AS (SELECT doc_id, unnest(string_split(t, ' ')) AS raw, lower(raw) AS w, generate_subscripts(string_split(t, ' '), 1) AS i FROM s),
{_one_pass("p0", 1)},
{_one_pass("p1", 2)},
{_one_pass("p2", 3)}
SELECT doc_id, md5(string_agg(raw, ' ' ORDER BY i)) AS normalized FROM p3 GROUP BY doc_id"""


#: Separates the pieces that replacements make; no text has it.
_CUT = "\x1e"


def _outside(t: str) -> str:
    """Commas and semicolons outside parentheses become cuts; a surplus closing parenthesis counts for nothing."""
    deeper = "CASE y.o WHEN '(' THEN x.l + 1 WHEN ')' THEN greatest(x.l - 1, 0) ELSE x.l END"
    return (
        f"list_reduce(list_transform(string_split({t}, ''), lambda c: {{'l': 0, 'o': c}}), lambda x, y: {{'l': {deeper}, 'o': x.o || CASE WHEN x.l = 0 AND y.o IN (',', ';') THEN '{_CUT}' ELSE y.o END}}, {{'l': 0, 'o': ''}}).o"
    )


def _sentence_units() -> str:
    abbreviations = r"\b(Dr|Mr|Ms|St|Univ|M\.Ed|B\.S)\."
    t = f"regexp_replace(coalesce(text, ''), '{abbreviations}', '\\1\u2024', 'g')"
    t = f"regexp_replace({t}, '\\b([A-Za-z])\\.([A-Za-z])\\.', '\\1\u2024\\2\u2024', 'g')"
    for _ in range(3):
        t = f"regexp_replace({t}, '\u2024([A-Za-z])\\.', '\u2024\\1\u2024', 'g')"
    for pattern in (r"([.!?])\s+([A-Z])", r"([a-z][.!?])([A-Z])"):
        t = f"regexp_replace({t}, '{pattern}', '\\1{_CUT}\\2', 'g')"
    sentences = f"list_transform(regexp_split_to_array({t}, '[{_CUT}\\r\\n]+'), lambda s: replace(s, '\u2024', '.'))"
    words = f"len(string_split({_collapse('s')}, ' '))"
    cuts = {
        "experience": f"CASE WHEN {words} > {LONG_UNIT} THEN regexp_replace(s, '\\s+({ACTION}\\b)', '{_CUT}\\1', 'g') ELSE s END",
        "education": f"replace(s, ';', '{_CUT}')",
        "skills": f"regexp_replace({_outside('s')}, '\\s+((?:{SKILL_LEADS})\\b)', '{_CUT}\\1', 'g')",
    }
    key = f"trim(regexp_replace(lower({_scrub('u')}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"
    counts = ", ".join(
        f"CAST(len(list_filter(list_distinct(list_transform(string_split(array_to_string(list_transform(ss, lambda s: {cut}), '{_CUT}'), '{_CUT}'), lambda u: {key})), lambda k: k <> '')) AS INTEGER) AS {name}_units"
        for name, cut in cuts.items()
    )
    return f"WITH s AS (SELECT conv_id, turn, {sentences} AS ss FROM conversations) SELECT conv_id, turn, {counts} FROM s"


_CLERKS = """
orders_of AS (SELECT o_custkey, list({'k': CAST(o_orderkey AS VARCHAR), 'p': o_orderpriority} ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey),
clerks AS (SELECT c_custkey, c_name, c_mktsegment, n_name, orders FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders_of ON o_custkey = c_custkey)
"""


def _tokens(t: str) -> str:
    return f"CAST(len(regexp_extract_all({t}, '[A-Za-z0-9]+|[^\\sA-Za-z0-9\\x{{0b}}]')) + 2 AS INTEGER)"


def _section_extract() -> str:
    """What the sections of the resumes are, from what these were made of."""
    lots = " ".join(map(str, range(1, 61)))
    return f"""WITH {_CLERKS}
        SELECT c_custkey, c_mktsegment || ' CLERK' AS title, 'Bachelor of Arts : ' || n_name || ' College | M.Ed : Library Studies St. Olga' AS education,
          array_to_string(list_concat(list_concat(list_transform(coalesce(orders, []), lambda o: 'Prepared order ' || o.k || ' of ' || o.p || ' with care.'), ['Problem Solving Skills were used.']),
            CASE WHEN c_custkey % 3 = 0 THEN ['Managed lots {lots}', 'Reviewed them all.'] ELSE [] END), ' | ') AS experience,
          'Excel (tables, charts) | SQL | ' || c_mktsegment || ' trade' AS skills, 'Careful with numbers in ' || n_name || '.' AS summary
        FROM clerks"""


def _budget_select_profile() -> str:
    """All that fits and says something new, in the order in which it can only have been chosen."""
    return f"""WITH {_CLERKS},
        p AS (SELECT c_custkey AS user_id, c_mktsegment || ' CLERK' AS title, 'Bachelor of Arts : ' || n_name || ' College' AS education, 'Prepared ledgers for ' || n_name || ' mills in 2011.' AS experience,
          'Careful with numbers in ' || n_name || '.' AS summary, 'I like to find out why figures disagree in ' || n_name || '.' AS interests,
          CASE c_custkey % 50 WHEN 0 THEN 'title and interests alone take more than the budget' WHEN 1 THEN 'resume or interests are empty' END AS error FROM clerks),
        t AS (SELECT *, 'Background: ' || title || ' Education: ' || education || '. Experience: ' || experience || ' Skills: Excel; SQL Summary: ' || summary || ' Interests: ' || interests AS text FROM p)
        SELECT user_id, CASE WHEN error IS NULL THEN text END AS profile_text, CASE WHEN error IS NULL THEN {_tokens("text")} END AS token_count, CASE WHEN error IS NULL THEN title END AS title,
          CASE WHEN error IS NULL THEN education END AS selected_education, CASE WHEN error IS NULL THEN experience END AS selected_experience, CASE WHEN error IS NULL THEN 'Excel | SQL' END AS selected_skills,
          CASE WHEN error IS NULL THEN summary END AS selected_summary, error FROM t"""


def _budget_select_catalog() -> str:
    """Everything but what never fits, skills by rank and tasks in source order."""
    return f"""WITH {_CLERKS},
        s AS (SELECT c_custkey, 'Occupation: ' || trim(c_name) || ' Description: ' || c_mktsegment || ' in ' || n_name AS head,
          array_to_string(list_reverse(list_sort(list_distinct(list_transform(coalesce(orders, []), lambda o: o.p)))), '; ') AS skills,
          array_to_string(list_transform(coalesce(orders, []), lambda o: 'Order ' || o.k || '.'), ' ') AS tasks FROM clerks),
        t AS (SELECT *, head || CASE WHEN skills <> '' THEN ' Skills: ' || skills ELSE '' END || CASE WHEN tasks <> '' THEN ' Tasks: ' || tasks ELSE '' END AS text,
          tasks = '' AND c_custkey % 4 = 0 AS bare FROM s)
        SELECT c_custkey AS key, CASE WHEN NOT bare THEN text END AS profile_text, CASE WHEN NOT bare THEN {_tokens("text")} END AS token_count, CASE WHEN NOT bare THEN skills END AS selected_skills,
          CASE WHEN NOT bare THEN tasks END AS selected_tasks, CASE WHEN bare THEN split_part(split_part(head, 'Occupation: ', 2), ' Description: ', 1) || ': none of its tasks has room' END AS error FROM t"""


_ENCODE = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS word FROM documents),
h AS (SELECT doc_id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) AS h FROM w),
v AS (SELECT doc_id, (h >> 1) % 64 AS place, sum(CASE WHEN h & 1 = 1 THEN 1 ELSE -1 END) AS x FROM h GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(x * x)) AS length, coalesce(max(x) FILTER (WHERE place = 0), 0) AS x FROM v GROUP BY doc_id)
SELECT doc_id, 64 AS width, true AS unit, round(CASE WHEN coalesce(length, 0) = 0 THEN 1.0 ELSE n.x / length END, 4) AS first
FROM documents LEFT JOIN n USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    found = {
        "topk_cosine": _TOPK,
        "topk_cosine_arrow": _TOPK,
        "topk_cosine_blocks": _TOPK,
        "rank_summary": f"""WITH {_BEST} SELECT rank, count(*) AS matches, count(DISTINCT code) AS codes, round(avg(score), 6) AS mean_score,
            round(min(score), 6) AS least_score, round(max(score), 6) AS largest_score FROM best GROUP BY rank""",
        "match_verification": f"""WITH {_BEST}, l AS (SELECT *, coalesce(score > lag(score) OVER (PARTITION BY user_id ORDER BY rank), false) AS rises FROM best)
            SELECT user_id, count(*) AS n, count(DISTINCT code) AS codes, list(rank ORDER BY rank) = range(1, count(*) + 1) AS contiguous, NOT bool_or(rises) AS ordered
            FROM l GROUP BY user_id""",
        "match_report": f"""WITH {_BEST} SELECT user_id, rank,
            printf('  %d. %s (%s) - cosine similarity %.4f', rank, 'Label ' || label, CAST(code AS VARCHAR), round(score, 4)) AS line FROM best""",
        "vector_quality": """WITH n AS (SELECT vec_id, embedding, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings)
            SELECT vec_id, CAST(len(embedding) AS INTEGER) AS width, round(l, 5) AS length, len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AS finite, abs(l - 1) <= 1e-5 AS unit FROM n""",
        "clean_text": f"""SELECT 'd' AS source, doc_id AS id, {_clean("text")} AS text FROM documents
            UNION ALL SELECT 'c', conv_id * 1000 + turn, {_clean("text")} FROM conversations""",
        "scrub_text": f"SELECT doc_id, md5({_scrub()}) AS scrubbed FROM documents",
        "first_nonempty_by_key": """WITH r AS (SELECT coalesce(source, '') AS source, doc_id AS pos, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS lang,
              CASE WHEN doc_id % 7 < 5 THEN '' ELSE text END AS text FROM documents)
            SELECT source, coalesce(min_by(lang, pos) FILTER (WHERE lang <> ''), '') AS lang, md5(coalesce(min_by(text, pos) FILTER (WHERE text <> ''), '')) AS text
            FROM r WHERE source <> '' GROUP BY source""",
        "dedup_argmax": f"WITH {_EVENTS} SELECT * FROM top",
        "rank_skills_topn": f"""WITH {_EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, lower(name)) AS rank FROM top QUALIFY rank <= 3)
            SELECT key, string_agg(name, '; ' ORDER BY rank) AS skills, CAST(max(rank) AS INTEGER) AS ranks FROM r GROUP BY key""",
        "dedup_first_position": f"""WITH {_TURNS}, twice AS (SELECT * FROM turns UNION ALL SELECT key, pos + 1000, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), true, 7.0 FROM turns WHERE pos % 2 = 0),
            {_TASKS.format(source="twice")} SELECT key, pos, md5(text) AS text, core, support FROM kept""",
        "left_join_coverage": """WITH s(source, id) AS (SELECT 'labels', doc_id FROM labels UNION SELECT 'toxic', doc_id FROM labels WHERE toxic = 1 UNION SELECT 'quality', doc_id FROM labels WHERE quality = 1),
            c AS (SELECT source, count(DISTINCT id) AS covered FROM s SEMI JOIN documents ON id = doc_id GROUP BY source), n AS (SELECT count(*) AS n FROM documents)
            SELECT source, covered, n - covered AS lacking, covered / n AS share FROM c, n""",
        "profile_render": """WITH s AS (SELECT o_custkey AS key, o_orderpriority AS name, max(o_totalprice) AS score FROM orders GROUP BY ALL),
            r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, lower(name)) AS rank FROM s QUALIFY rank <= 10),
            sk AS (SELECT key, string_agg(name, '; ' ORDER BY rank) AS skills FROM r GROUP BY key),
            ta AS (SELECT o_custkey AS key, string_agg('Order ' || o_orderkey || '.', ' ' ORDER BY o_orderkey) AS tasks FROM orders GROUP BY o_custkey)
            SELECT c_custkey AS key, 'Occupation: ' || trim(c_name) || ' Description: ' || c_mktsegment || ' in ' || n_name || coalesce(' Skills: ' || skills, '') || coalesce(' Tasks: ' || tasks, '') AS profile
            FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN sk ON sk.key = c_custkey LEFT JOIN ta ON ta.key = c_custkey""",
        "content_hash_id": """WITH h AS (SELECT doc_id, sha256(coalesce(text, '') || chr(0) || coalesce(lang, '')) AS h FROM documents),
            n AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS n FROM h)
            SELECT doc_id, 'user_' || substr(h, 1, 16) || '_' || CASE WHEN n < 10 THEN '0' || n ELSE CAST(n AS VARCHAR) END AS user_id FROM n""",
        "word_sets": f"""WITH w AS (SELECT doc_id, {_letters("coalesce(text, '')")} AS l, {_content("coalesce(text, '')")} AS c FROM documents)
            SELECT doc_id, CAST(len(l) AS INTEGER) AS letter_words, CAST(len(c) AS INTEGER) AS content_words, md5(array_to_string(list_sort(c), ' ')) AS words FROM w""",
        "set_measures": f"""WITH w AS (SELECT doc_id, source, {_content("coalesce(text, '')")} AS a FROM documents),
            p AS (SELECT doc_id, a, lag(a) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM w QUALIFY b IS NOT NULL),
            m AS (SELECT doc_id, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS common FROM p),
            x AS (SELECT *, common / greatest(1, na + nb - common) AS jac, CASE WHEN least(na, nb) > 0 THEN common / least(na, nb) ELSE 0.0 END AS ov FROM m)
            SELECT doc_id, CAST(common AS INTEGER) AS common, round((na - common) / greatest(1, na), 6) AS novelty, round(jac, 6) AS jaccard, round(ov, 6) AS overlap,
                   na = common AS within, jac >= 0.65 OR (na >= 6 AND nb >= 6 AND ov >= 0.85) AS alike FROM x""",
        "stable_distinct_units": f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
            u AS (SELECT doc_id, pos, {_collapse("raw")} AS unit FROM l), k AS (SELECT *, trim(regexp_replace(lower(unit), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS key FROM u),
            f AS (SELECT * FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) = 1)
            SELECT doc_id, count(*) AS units, md5(string_agg(unit, '|' ORDER BY pos)) AS text FROM f GROUP BY doc_id""",
        "task_priority_first": f"""WITH {_TURNS}, {_TASKS.format(source="turns")}
            SELECT key, pos, core, support, CAST(row_number() OVER (PARTITION BY key ORDER BY core DESC,
              support / 100 + CASE WHEN len({_letters("text")}) > 0 THEN 1.0 ELSE 0.0 END DESC, pos) AS INTEGER) AS priority FROM kept""",
        "unit_scores": f"""WITH l AS (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM conversations),
            u AS (SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, {_collapse("raw")} AS unit FROM l), t AS (SELECT *, {_content("unit")} AS terms FROM u)
            SELECT conv_id, turn, pos, CAST(CASE WHEN unit = '' THEN 0 ELSE len(string_split(unit, ' ')) END AS INTEGER) AS words,
              round(3.0::DOUBLE * len(list_intersect(terms, {_content(f"'{INTERESTS}'")})) + CASE WHEN regexp_matches(unit, '\\b{ACTION}\\b') THEN 3.0 ELSE 0.0 END
                + CASE WHEN len(terms) > 0 THEN 2.0 ELSE 0.0 END + CASE WHEN regexp_matches(unit, '[0-9]') THEN 0.8 ELSE 0.0 END, 6) AS score FROM t""",
        "token_stats": r"""WITH n AS (SELECT len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^\sA-Za-z0-9\x{0b}]')) + 2 AS n FROM documents)
            SELECT count(*) AS profiles, round(avg(n), 6) AS average_tokens, round(median(n), 6) AS median_tokens, round(100.0 * count(*) FILTER (WHERE n > 256) / count(*), 6) AS percentage_over_limit,
              CAST(min(n) AS INTEGER) AS minimum_tokens, CAST(max(n) AS INTEGER) AS maximum_tokens, count(*) FILTER (WHERE n BETWEEN 245 AND 250) AS profiles_in_245_to_250_range FROM n""",
        "skill_five_number": """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type),
            j AS (SELECT q.*, value, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM events e JOIN q USING (event_type))
            SELECT event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(min(value), 6) AS minimum, round(max(value), 6) AS maximum,
              round(min(value) FILTER (WHERE inside), 6) AS low_whisker, round(max(value) FILTER (WHERE inside), 6) AS high_whisker, count(*) FILTER (WHERE NOT inside) AS outliers
            FROM j GROUP BY ALL""",
        "duplicate_keys": """SELECT 'duplicate text' AS rule, md5(coalesce(text, '')) AS key, CAST(count(*) AS VARCHAR) AS detail FROM documents GROUP BY ALL HAVING count(*) > 1
            UNION ALL SELECT 'duplicate url', url, CAST(count(*) AS VARCHAR) FROM pages GROUP BY url HAVING count(*) > 1
            UNION ALL SELECT 'values must be nonempty', url, 'v' FROM pages""",
        "ordered_equality": """SELECT 'order or content differs' AS rule, CAST(coalesce(a.vec_id, b.vec_id + 1) AS VARCHAR) AS key
            FROM embeddings a FULL JOIN embeddings b ON a.vec_id = b.vec_id + 1 WHERE a.label IS DISTINCT FROM b.label OR a.vec_id IS NULL OR b.vec_id IS NULL""",
        "numbers_parsed": """SELECT event_id, CASE event_id % 7 WHEN 0 THEN CAST(event_id AS DOUBLE) WHEN 4 THEN 1.5 ELSE 0.0 END AS support, event_id % 7 IN (0, 4) AS kept FROM events""",
        "collapse_repeats": _collapse_repeats(),
        "sentence_units": _sentence_units(),
        "section_extract": _section_extract(),
        "budget_select_profile": _budget_select_profile(),
        "budget_select_catalog": _budget_select_catalog(),
        "encode_hashing": _ENCODE,
        "file_order": """SELECT row_number() OVER (ORDER BY conv_id, turn) AS pos, conv_id, turn, md5(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g')) AS text FROM conversations""",
        "array_exchange": """SELECT row_number() OVER (ORDER BY vec_id DESC) AS pos, CAST(len(embedding) AS INTEGER) AS width, round(CAST(embedding[1] AS DOUBLE), 6) AS first,
            round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS squared FROM embeddings""",
        "round_trip": """WITH d AS (SELECT doc_id, lang, md5(coalesce(text, '')) AS text FROM documents), c AS (SELECT doc_id, lang, CASE WHEN lang = 'de' THEN upper(text) ELSE text END AS text FROM d)
            SELECT 'lost' AS how, doc_id, text FROM (FROM d EXCEPT ALL FROM c) UNION ALL SELECT 'new', doc_id, text FROM (FROM c EXCEPT ALL FROM d)""",
    }
    return found
