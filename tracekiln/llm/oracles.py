"""SQL for DuckDB with the same rows as the queries, where SQL can express them."""

from __future__ import annotations

from tracekiln.llm import license_scan, quality_rules
from tracekiln.llm.chat_format import CLOSE, MIDDLE, OPEN

ORACLES: dict[str, str] = {}

_WS = r"[\x20\x09-\x0D]"
_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLES["op2_exact_dedup"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, length(t) AS n_points, sha256(regexp_replace(t, '{_WS}', '', 'g')) AS h FROM d)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       h AS text_sha256
FROM n WINDOW w AS (PARTITION BY h ORDER BY n_points DESC, doc_id)
"""


def _license() -> str:
    known = ", ".join(f"({_q(v)}, '{k}')" for k, v in license_scan.SENTENCES.items())
    steps, last = [], "seq"
    for k, (_, sequence) in enumerate(license_scan.RULES):
        pattern = _q(" " + "  ".join(sequence.split()) + " ")
        steps.append(f"r{k} AS (SELECT *, contains(rest, {pattern}) AS hit_{k}, replace(rest, {pattern}, ' . ') AS rest_{k} FROM {last})")
        steps.append(f"s{k} AS (SELECT * EXCLUDE (rest, rest_{k}), rest_{k} AS rest FROM r{k})")
        last = f"s{k}"
    names = list(dict.fromkeys(x for x, _ in license_scan.RULES))
    hit = lambda x: "(" + " OR ".join(f"hit_{k}" for k, (y, _) in enumerate(license_scan.RULES) if x == y) + ")"
    joined = ", ".join(f"CASE WHEN {hit(x)} THEN {_q(x)} END" for x in names)
    count = " + ".join(f"CAST({hit(x)} AS BIGINT)" for x in names)
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
parts AS (SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '([.!?]){_WS}+', '\\1' || chr(10), 'g'), chr(10))) AS s,
                 generate_subscripts(string_split(regexp_replace(coalesce(text, ''), '([.!?]){_WS}+', '\\1' || chr(10), 'g'), chr(10)), 1) AS i FROM documents),
ids AS (SELECT p.doc_id, string_agg(k.id, ' ' ORDER BY p.i) AS sentence_ids, string_agg(' ' || k.id || ' ', '' ORDER BY p.i) AS rest
        FROM parts p JOIN known k ON trim(regexp_replace(lower(p.s), '[^a-z0-9]+', ' ', 'g')) = k.sentence GROUP BY p.doc_id),
seq AS (SELECT d.doc_id, coalesce(i.sentence_ids, '') AS sentence_ids, coalesce(i.rest, '') AS rest FROM documents d LEFT JOIN ids i USING (doc_id)),
{", ".join(steps)}
SELECT doc_id, sentence_ids, concat_ws(' ', {joined}) AS licenses, trim(regexp_replace(rest, '[. ]+', ' ', 'g')) AS unruled, {count} AS n_licenses
FROM {last}
"""


ORACLES["op6_license_scan"] = _license()


def _quality() -> str:
    word = r"[^\x20\x09-\x0D]+"
    fails = f"(NOT regexp_matches(l, {_q(quality_rules.ENDING)}) OR regexp_matches(l, {_q(quality_rules.NAVIGATION)}) OR regexp_matches(l, {_q(quality_rules.BOILERPLATE)}))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{word}') AS ws FROM d),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
win3 AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM win),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win3),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep WHERE n > 1) GROUP BY doc_id),
li AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
lw AS (SELECT doc_id, l, len(regexp_extract_all(l, '{word}')) AS nw, {fails} AS bad FROM li WHERE regexp_matches(l, '{word}')),
ls AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines, count(*) FILTER (WHERE NOT bad) AS n_good_lines, coalesce(sum(nw) FILTER (WHERE NOT bad), 0) AS n_good_words FROM lw GROUP BY doc_id),
f AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_WS}', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_good_lines, 0) AS BIGINT) AS n_good_lines, CAST(coalesce(n_good_words, 0) AS BIGINT) AS n_good_words
      FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN ls USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_good_words >= {quality_rules.KEEP_PERCENT} * n_words) AS kept,
       n_lines, n_good_lines, n_good_words
FROM f
"""


ORACLES["op9_quality_rules"] = _quality()

_OPEN, _MIDDLE, _CLOSE = (_q(x).replace("\n", "' || chr(10) || '") for x in (OPEN, MIDDLE, CLOSE))


def _chat_side(name: str, flag: str) -> str:
    return f"""{name} AS (
  SELECT pair_id, string_agg(r, '' ORDER BY place) AS body,
         string_agg(CASE WHEN role = 'assistant' THEN (start + length({_OPEN}) + length(role) + length({_MIDDLE}))::VARCHAR || ':' || (start + length(r))::VARCHAR END, ',' ORDER BY place) AS mask
  FROM (SELECT t.*, sum(length(r)) OVER (PARTITION BY t.pair_id ORDER BY t.place) - length(r) AS start
        FROM turns t JOIN prefix p USING (pair_id) WHERE {flag} t.rejected AND t.place >= p.n_prefix) GROUP BY pair_id)"""


ORACLES["op10_preference_format"] = f"""
WITH base AS (SELECT conv_id >> 1 AS pair_id, conv_id % 2 <> 0 AS rejected, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT pair_id, rejected, role, text, row_number() OVER (PARTITION BY pair_id, rejected ORDER BY turn, role, text) - 1 AS place,
                 {_OPEN} || role || {_MIDDLE} || text || {_CLOSE} AS r FROM base),
sides AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.place, r.place) AS place, coalesce(c.role = r.role AND c.text = r.text, false) AS same
          FROM (SELECT * FROM turns WHERE NOT rejected) c FULL JOIN (SELECT * FROM turns WHERE rejected) r ON c.pair_id = r.pair_id AND c.place = r.place),
prefix AS (SELECT pair_id, coalesce(min(place) FILTER (WHERE NOT same), count(*)) AS n_prefix FROM sides GROUP BY pair_id),
{_chat_side("c", "NOT")},
{_chat_side("x", "")},
p AS (SELECT pair_id, string_agg(r, '' ORDER BY place) AS prompt FROM turns t JOIN prefix USING (pair_id) WHERE NOT rejected AND place < n_prefix GROUP BY pair_id)
SELECT pair_id, CAST(n_prefix AS BIGINT) AS n_prefix, coalesce(prompt, '') AS prompt, coalesce(c.body, '') AS chosen, coalesce(x.body, '') AS rejected,
       coalesce(c.mask, '') AS chosen_mask, coalesce(x.mask, '') AS rejected_mask
FROM prefix LEFT JOIN p USING (pair_id) LEFT JOIN c USING (pair_id) LEFT JOIN x USING (pair_id)
"""
