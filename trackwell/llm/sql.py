"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

import re

from trackwell.llm import license_scan
from trackwell.llm.line_dedup import MEAN_LINES, WEIGHTS
from trackwell.llm.quality_rules import BOILERPLATE, NAVIGATION, SENTENCE_END, SHOUTS, SYMBOLS, TERMINAL_MARKS


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_SPACE = r"'[\x20\x09-\x0D]+'"
_WORD = r"'[^\x20\x09-\x0D]+'"
_SOLID = r"'[^\x20\x09-\x0D]'"
_TERMINAL = "[" + "".join(TERMINAL_MARKS).replace("]", r"\]") + r"][\x20\x09-\x0D]*$"
_FAILS = f"""(len(regexp_extract_all(x, {_WORD})) > 0 AND (
    NOT (regexp_matches(x, {_quoted(_TERMINAL)}) OR regexp_matches(x, {_quoted(SENTENCE_END)}))
    OR 10 * (len(regexp_extract_all(x, {_quoted(SYMBOLS)})) + len(regexp_extract_all(x, {_quoted(SHOUTS)}))) > len(regexp_extract_all(x, {_WORD}))
    OR regexp_matches(x, {_quoted(NAVIGATION)}) OR regexp_matches(x, {_quoted(BOILERPLATE)})))"""

OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, {_SPACE}), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_SOLID})) AS ls,
             list_filter(string_split(t, chr(10)), lambda x: {_FAILS}) AS bad FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM s WHERE len(ws) >= 5)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(5) AS f(k) GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, {_quoted(SYMBOLS)})) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
             CAST(length(regexp_replace(array_to_string(bad, ''), {_SPACE}, '', 'g')) AS BIGINT) AS lost_chars
      FROM s LEFT JOIN covered USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost_chars <= 30 * word_chars AS kept
FROM m"""

_ROLLED = " + ".join(f"{w} * coalesce(lag(h, {n}) OVER p, 0)" if n else "h" for n, w in enumerate(WEIGHTS))
_TEXTS = "SELECT DISTINCT doc_id, text, coalesce(CAST('0x' || substr(md5(text), 1, 15) AS BIGINT), -1) AS t FROM documents"
_LINES = "unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i"
OP10 = f"""
WITH d AS (SELECT row_number() OVER () AS r, * FROM ({_TEXTS})),
l AS (SELECT r, doc_id, t, {_LINES} FROM d),
s AS (SELECT * FROM l WHERE regexp_matches(line, {_SOLID})),
w AS (SELECT r, doc_id, t, i AS k, lead(i) OVER p AS e, line || chr(10) || lead(line) OVER p AS body FROM s WINDOW p AS (PARTITION BY r ORDER BY i)),
f AS (SELECT *, row_number() OVER p AS n, first_value(r) OVER p AS fr, first_value(e) OVER p AS fe FROM w WHERE e IS NOT NULL WINDOW p AS (PARTITION BY body ORDER BY doc_id NULLS FIRST, t, k)),
g AS (SELECT DISTINCT r, unnest(range(k, e + 1)) AS i FROM f WHERE NOT (r = fr AND k <= fe)),
o AS (SELECT l.r, count(*) AS n_lines, count(g.i) AS removed_lines, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS clean FROM l LEFT JOIN g ON g.r = l.r AND g.i = l.i GROUP BY l.r)
SELECT x.doc_id, n_lines, removed_lines, CAST(length(CASE WHEN x.text IS NULL THEN NULL ELSE clean END) AS BIGINT) AS kept_chars, CASE WHEN x.text IS NULL THEN NULL ELSE md5(clean) END AS kept_md5
FROM documents x JOIN d ON d.doc_id IS NOT DISTINCT FROM x.doc_id AND d.text IS NOT DISTINCT FROM x.text JOIN o ON o.r = d.r"""

OP10_CHUNKS = f"""
WITH d AS (SELECT row_number() OVER () AS r, * FROM ({_TEXTS})),
u AS (SELECT r, doc_id, t, {_LINES} FROM d),
l AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM u),
e AS (SELECT *, CASE WHEN ({_ROLLED}) % {MEAN_LINES} = 0 THEN 1 ELSE 0 END AS cut FROM l WINDOW p AS (PARTITION BY r ORDER BY i)),
k AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM e),
c AS (SELECT r, doc_id, t, k, count(*) AS n_lines, count(*) FILTER (regexp_matches(line, {_SOLID})) AS n_solid, string_agg(line, chr(10) ORDER BY i) AS body
      FROM k GROUP BY r, doc_id, t, k),
f AS (SELECT *, n_solid > 1 AND row_number() OVER (PARTITION BY n_solid > 1, body ORDER BY doc_id NULLS FIRST, t, k) > 1 AS gone FROM c),
o AS (SELECT r, CAST(sum(n_lines) AS BIGINT) AS n_lines, CAST(count(*) AS BIGINT) AS n_chunks, CAST(count(*) FILTER (gone) AS BIGINT) AS removed_chunks,
             CAST(coalesce(sum(n_lines) FILTER (gone), 0) AS BIGINT) AS removed_lines,
             coalesce(string_agg(body, chr(10) ORDER BY k) FILTER (NOT gone), '') AS clean FROM f GROUP BY r)
SELECT x.doc_id, n_lines, n_chunks, removed_chunks, removed_lines, CAST(length(CASE WHEN x.text IS NULL THEN NULL ELSE clean END) AS BIGINT) AS kept_chars,
       CASE WHEN x.text IS NULL THEN NULL ELSE md5(clean) END AS kept_md5
FROM documents x JOIN d ON d.doc_id IS NOT DISTINCT FROM x.doc_id AND d.text IS NOT DISTINCT FROM x.text JOIN o ON o.r = d.r"""


def _license_regex(template: str) -> str:
    """A template as a regular expression over words that each stand between two spaces."""
    out = ""
    for mark, limit, word in re.findall(rf"<<(/?opt|any (\d+))>>|({license_scan.WORD})", template):
        if mark == "opt":
            out += "(?:"
        elif mark == "/opt":
            out += ")?"
        else:
            out += f"(?: [^ ]+ ){{0,{limit}}}" if limit else f" {word} "
    return out


_L = _quoted(license_scan.WORD)
_AT = " OR ".join(
    "(" + " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(text.split())) + f") /* {label} */" for label, text in license_scan.PHRASES
)
_BASE = ", ".join(f"CASE WHEN regexp_matches(j, '{_license_regex(t)}') THEN '{label}' END" for label, t in license_scan.PHRASES)
_MORE = ", ".join(f"CASE WHEN regexp_matches(j, '{_license_regex(t)}') THEN '{label}' END" for label, t in license_scan.TEMPLATES)
_DISTINCT = "array_to_string(list_sort(list_distinct(list_filter({}, lambda x: x IS NOT NULL))), ',')"
OP2 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_L}) AS ws FROM documents),
j AS (SELECT doc_id, ws, ' ' || array_to_string(ws, '  ') || ' ' AS j, list_filter(range(1, len(ws) + 1), lambda i: {_AT}) AS places FROM w),
m AS (SELECT *, [{_BASE}] AS base, [{_MORE}] AS more FROM j)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
       CAST(list_min(places) - 1 AS BIGINT) AS first_word, CAST(list_max(places) - 1 AS BIGINT) AS last_word,
       {_DISTINCT.format('base')} AS base_labels, {_DISTINCT.format('list_concat(base, more)')} AS labels,
       CASE WHEN len(list_filter(more, lambda x: x IS NOT NULL)) > 0 THEN 1.0 WHEN len(places) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM m"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
s AS (SELECT r, doc_id, ts, len(ts) AS n FROM d WHERE len(ts) > 0),
a AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM s),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM s) GROUP BY r, t),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
f AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, a GROUP BY t, n_docs),
i AS (SELECT r, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))) AS impact FROM p JOIN s USING (r) JOIN f USING (t), a),
x AS (SELECT item_id, r, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN i USING (t) GROUP BY item_id, r),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
      FROM x JOIN s USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10"""
