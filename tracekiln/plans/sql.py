"""DuckDB expressions with the meaning of the column functions, to check them by."""

from __future__ import annotations

from tracekiln.functions import classify, quality, text
from tracekiln.plans.dims import STRATEGIES
from tracekiln.plans.fixtures import problems_sql
from tracekiln.plans.prompts import HEADER, LAYOUTS, SAMPLING, TEMPERATURE

NAMES = [n for n, _ in STRATEGIES]
PROBLEMS = f"p AS ({problems_sql('VARCHAR')})"


def q(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def normalize(x: str) -> str:
    plain = strip(f"replace(regexp_replace(regexp_replace({strip(x)}, {q(text.CURRENCY)}, '', 'g'), {q(text.UNITS)}, '', 'g'), ',', '')")
    digits = f"replace({plain}, '_', '')"
    number = f"TRY_CAST({digits} AS DOUBLE)"
    short = f"regexp_replace(regexp_replace(CAST(round(TRY_CAST({digits} AS DECIMAL(38,10)), 4) AS VARCHAR), '0+$', ''), '\\.$', '')"
    return f"(CASE WHEN NOT regexp_matches({plain}, {q(text.NUMERIC)}) OR {number} IS NULL OR isinf({number}) THEN NULL ELSE {short} END)"


def all_of(x: str, pattern: str, k: int = 0) -> str:
    return f"regexp_extract_all({x}, {q(pattern)}, {k})"


def answer(x: str) -> str:
    return (
        f"(CASE WHEN regexp_matches({x}, {q(text.MARKER)}) THEN {normalize(f'regexp_extract({x}, {q(text.MARKER)}, 1)')} "
        f"WHEN regexp_matches({x}, {q(text.PHRASE)}) THEN {normalize(f'regexp_extract({x}, {q(text.PHRASE)}, 1)')} "
        f"ELSE {normalize(all_of(x, text.NUMBER) + '[-1]')} END)"
    )


def final_answer(x: str) -> str:
    return (
        f"(CASE WHEN regexp_matches({x}, {q(text.PLAIN_MARKER)}) THEN replace(regexp_extract({x}, {q(text.PLAIN_MARKER)}, 1), ',', '') "
        f"WHEN regexp_matches({x}, {q(text.PLAIN_PHRASE)}) THEN replace(regexp_extract({x}, {q(text.PLAIN_PHRASE)}, 1), ',', '') "
        f"ELSE replace({all_of(x, text.PLAIN_NUMBER)}[-1], ',', '') END)"
    )


def match(a: str, b: str) -> str:
    na, nb = f"TRY_CAST({a} AS DOUBLE)", f"TRY_CAST({b} AS DOUBLE)"
    return f"coalesce({a} = {b} OR CASE WHEN {na} IS NOT NULL AND {nb} IS NOT NULL THEN abs({na} - {nb}) <= 1e-9 ELSE lower({strip(a)}) = lower({strip(b)}) END, false)"


def steps(x: str) -> str:
    lines = f"list_filter(string_split({x}, chr(10)), lambda l: NOT starts_with({strip('l')}, '####'))"
    done = f"list_transform({lines}, lambda l: {strip(f'regexp_replace(l, {q(text.COMPUTATION)}, $$= \\2$$, $$g$$)')})"
    return f"list_filter({done}, lambda l: l <> '')"


def trace_steps(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {strip('l')}), lambda l: l <> '' AND NOT starts_with(l, '####'))"


def numbers(x: str) -> str:
    return f"list_distinct(list_filter(list_transform({all_of(x, text.NUMBER)}, lambda n: {normalize('n')}), lambda n: n IS NOT NULL))"


def gold(x: str) -> str:
    return f"list_filter(list_transform({all_of(x, text.COMPUTATION, 2)}, lambda n: {normalize('n')}), lambda n: n IS NOT NULL)"


def hits(x: str, words: tuple[str, ...]) -> str:
    return f"list_filter([{', '.join(q(w) for w in words)}], lambda w: contains(lower({x}), w))"


def category(x: str) -> str:
    cases = " ".join(f"WHEN len({hits(x, words)}) > 0 THEN '{name}'" for name, words in reversed(classify.KEYWORDS.items()))
    return f"(CASE {cases} ELSE 'arithmetic' END)"


def keyword_hits(x: str) -> str:
    cases = " ".join(f"WHEN len({hits(x, words)}) > 0 THEN {hits(x, words)}" for _, words in reversed(classify.KEYWORDS.items()))
    return f"(CASE {cases} ELSE [] END)"


def mentions(x: str) -> str:
    return f"len({all_of(x, classify.MENTION)})"


def guess(x: str) -> str:
    return f"greatest(1, {mentions(x)} // 2)"


def worked(x: str) -> str:
    return f"len(list_filter(string_split({x}, chr(10)), lambda l: regexp_matches(l, {q(classify.OPERATION_LINE)})))"


def complexity(n: str) -> str:
    return f"(CASE WHEN {n} <= 3 THEN 'simple' WHEN {n} <= 5 THEN 'medium' ELSE 'complex' END)"


def operation_counts(x: str) -> dict[str, str]:
    """Counts by operation; a sign counts where no word character stands beside it, which RE2 cannot say in one pattern."""
    out = {}
    for name, pattern in classify.OPERATIONS.items():
        if "(?<!" in pattern:
            sign, words = pattern[4:].split("|", 1)
            c = sign[len(r"(?<!\w)[")]
            alone = rf"len(list_filter(range(1, length({x}) + 1), lambda i: {x}[i] = '{c}' AND (i = 1 OR NOT regexp_matches({x}[i - 1], '\w')) AND (i = length({x}) OR NOT regexp_matches({x}[i + 1], '\w'))))"
            out[name] = f"({alone} + len({all_of(x, '(?i)' + words)}))"
        else:
            out[name] = f"len({all_of(x, pattern)})"
    return out


def richness(x: str) -> str:
    step = " + ".join(f"CAST(contains(lower({x}), {q(w)}) AS INT)" for w in classify.STEP_WORDS)
    length = f"CASE WHEN length({x}) < 40 THEN 0.3 WHEN length({x}) <= 200 THEN 1.0 WHEN length({x}) >= 500 THEN 0.4 ELSE CAST(700 - length({x}) AS DECIMAL(10,0)) * 0.002 END"
    return f"CAST(round(CAST(0.35 * CAST({length} AS DECIMAL(10,6)) + CAST(least(5, {mentions(x)}) AS DECIMAL(10,0)) * 0.07 + CAST(least(3, {step}) AS DECIMAL(10,0)) * 0.1 AS DECIMAL(18,8)), 4) AS DOUBLE)"


def scored(more: str = "") -> str:
    """CTEs p, s (candidates) and r (ranked)."""
    return f"""{PROBLEMS},
s AS (SELECT pid AS original_index, question, answer AS ground_truth, {richness('question')} AS richness_score, {category('question')} AS category_type FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY category_type ORDER BY richness_score DESC, original_index) AS rank FROM s){more}"""


def allocated() -> str:
    """CTEs down to a: the selection, each strategy after those of greater need (of equal need, of smaller number)."""
    needs = ", ".join(f"({sid}, '{name}', {need})" for sid, (name, need) in enumerate(STRATEGIES))
    order = ", ".join(f"('{c}', {i})" for i, c in enumerate(classify.CATEGORIES))
    return scored(f""",
needs(strategy_id, strategy_name, need) AS (VALUES {needs}),
dim AS (SELECT d.strategy_id, d.strategy_name, d.need, CAST(coalesce(sum(e.need), 0) + 1 AS INT) AS a, CAST(coalesce(sum(e.need), 0) + d.need AS INT) AS b
  FROM needs d LEFT JOIN needs e ON e.need > d.need OR (e.need = d.need AND e.strategy_id < d.strategy_id) GROUP BY d.strategy_id, d.strategy_name, d.need),
cats(category_type, cat_ord) AS (VALUES {order}),
n AS (SELECT category_type, count(*) AS n FROM s GROUP BY 1),
pick AS (SELECT strategy_id, original_index, question, r.category_type, rank, cat_ord, false AS is_reuse FROM r JOIN dim ON rank BETWEEN a AND b AND need > 0 JOIN cats USING (category_type)
  UNION ALL SELECT strategy_id, original_index, question, r.category_type, rank, cat_ord, true FROM r JOIN n USING (category_type) JOIN dim ON need > 0 AND rank < a
    AND rank <= need - greatest(0, least(n, b) - a + 1) JOIN cats USING (category_type)),
a AS (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY cat_ord, is_reuse, rank) - 1 AS position FROM pick)""")


def equation(e: str) -> str:
    n = lambda k: f"TRY_CAST(replace({e}[{k}], ',', '') AS DOUBLE)"
    a, b, c = n(1), n(3), n(4)
    want = f"(CASE {e}[2] WHEN '+' THEN {a} + {b} WHEN '-' THEN {a} - {b} WHEN '*' THEN {a} * {b} WHEN '×' THEN {a} * {b} ELSE {a} / nullif({b}, 0) END)"
    return f"(CASE WHEN {e}[2] IN ('/', '÷') AND {b} = 0 THEN {a} IS NOT NULL AND {c} IS NOT NULL ELSE coalesce(abs({c} - {want}) <= greatest(1e-6, abs({want}) * 1e-4), false) END)"


def rated(problems: str = PROBLEMS) -> str:
    """CTEs p (or the one given), t (parts), v (scores) and x (rated traces)."""
    eq = lambda k: all_of("trace", quality.EQUATION, k)
    parts = f"list_transform(range(1, len({eq(1)}) + 1), lambda i: [{eq(1)}[i], {eq(2)}[i], {eq(3)}[i], {eq(4)}[i]])"
    lev = "levenshtein(st[i], st[j])"
    return f"""{problems},
t AS (SELECT pid, question, answer, trace, {parts} AS eqs, {gold('answer')} AS gold, {numbers('trace')} AS nums, {trace_steps('trace')} AS st,
  {answer('trace')} AS pred_answer, {answer('answer')} AS gold_answer, {category('question')} AS category_type FROM p),
u AS (SELECT *, len(list_filter(eqs, lambda e: {equation('e')})) AS ok, len(list_filter(list_distinct(gold), lambda g: list_contains(nums, g))) AS covered,
  len(list_filter(gold, lambda g: list_contains(nums, g))) AS told,
  len(list_filter(range(1, len(st) + 1), lambda i: len(list_filter(range(1, i), lambda j: 10 * {lev} < 3 * greatest(length(st[i]), length(st[j])))) > 0)) AS red,
  len(list_distinct(gold)) AS n_want FROM t),
v AS (SELECT *, CAST(round(CASE WHEN len(eqs) > 0 AND n_want > 0 THEN 0.6 * (ok / len(eqs)) + 0.4 * (covered / n_want) WHEN len(eqs) > 0 THEN ok / len(eqs)
    WHEN n_want > 0 THEN covered / n_want ELSE 0.4 END, 4) AS DECIMAL(5,4)) AS dv,
  CAST(round(CASE WHEN len(gold) > 0 THEN told / len(gold) ELSE 0.5 END, 4) AS DECIMAL(5,4)) AS de,
  CAST(round(CASE WHEN len(st) <= 1 THEN 0.8 ELSE (len(st) - red) / len(st) END, 4) AS DECIMAL(5,4)) AS dr, {match('pred_answer', 'gold_answer')} AS is_correct FROM u),
w AS (SELECT *, CAST(round(CAST(0.40 * dv + 0.35 * de + 0.25 * dr AS DECIMAL(12,8)), 4) AS DECIMAL(5,4)) AS dx FROM v),
x AS (SELECT *, CAST(dx AS DOUBLE) AS rex_score, CAST(dv AS DOUBLE) AS validity, CAST(de AS DOUBLE) AS execution, CAST(dr AS DOUBLE) AS redundancy, len(st) AS num_steps, len(gold) AS n_gold_ops,
  CASE WHEN is_correct AND dx >= 0.65 THEN 'good' WHEN is_correct AND dx >= 0.35 THEN 'medium' WHEN NOT is_correct AND dx >= 0.65 THEN 'medium' ELSE 'bad' END AS category FROM w)"""


def stub(rows: str) -> str:
    """CTEs g0 to g: what the backend without a model answers for ``rows`` (pid, question, sid).

    Attempts differ by the error alone, so the vote is the side with more attempts, the first attempt's on a tie.
    """
    plan = ", ".join(f"({sid}, '{name}', '{t:g}', {n})" for sid, name in enumerate(NAMES) for t, n in [SAMPLING.get(sid, (TEMPERATURE, 1))])
    digit = "strpos('0123456789abcdef', md5(k || '|' || temp || '|' || question)[2]) - 1"
    return f"""plan(sid, strategy_name, temp, n) AS (VALUES {plan}),
g0 AS (SELECT pid, question, sid, strategy_name, n, list_transform(regexp_extract_all(question, '[0-9]+'), lambda d: CAST(d AS BIGINT)) AS ns,
  list_transform(range(0, n), lambda k: CAST(({digit}) % 8 < 2 AS BIGINT)) AS errs FROM ({rows}) JOIN plan USING (sid)),
g1 AS (SELECT *, CASE WHEN 2 * list_sum(errs) > n THEN 1 WHEN 2 * list_sum(errs) = n THEN errs[1] ELSE 0 END AS err FROM g0),
g AS (SELECT pid, sid, strategy_name, n, CASE WHEN len(ns) < 3 THEN 'First take ' || array_to_string(ns, ' + ') || ' = ' || (list_sum(ns) + err) || chr(10) || 'So that is all.' || chr(10) || '#### ' || (list_sum(ns) + err)
  ELSE 'First take ' || ns[2] || ' * ' || ns[3] || ' = ' || ns[2] * ns[3] || chr(10) || 'Next put ' || ns[2] * ns[3] || ' + ' || ns[1] || ' = ' || (ns[2] * ns[3] + ns[1] + err) || chr(10) || '#### ' || (ns[2] * ns[3] + ns[1] + err) END AS trace FROM g1)"""


def retried(pool: str, sid: int, enough: tuple[str, ...]) -> str:
    """CTEs down to y: rows of a pool with their new trace, its evaluation and whether they are recovered."""
    again = rated("p AS (SELECT o.pid, o.question, o.answer, g.trace FROM o JOIN g USING (pid))")
    wanted = ", ".join(q(c) for c in enough)
    return f"""o AS (WITH {rated()} SELECT pid, question, answer FROM x WHERE category = '{pool}'),
{stub(f"SELECT pid, question, {sid} AS sid FROM o")}, y AS (WITH {again} SELECT *, category IN ({wanted}) AS recovered FROM x)"""


def prompt(sid: int) -> str:
    """A query of the prompts of one strategy, with the selection's examples and their true answers as solutions."""
    solved = "e.answer"
    block = lambda n: f"coalesce((SELECT string_agg('Example ' || (position + 1)::VARCHAR || ':' || chr(10) || 'Question: ' || e.question || chr(10) || 'Solution: ' || {solved} || chr(10) || chr(10), '' ORDER BY position) FROM ex e WHERE position < {n}), '')"
    one = lambda head, mid, tail: f"coalesce((SELECT {q(head)} || e.question || {q(mid)} || {solved} || {q(tail)} FROM ex e WHERE position = 0), '')"
    named = {
        "question": "p.question",
        "hint": f"'[Problem type: ' || upper({category('p.question')}) || ' | Complexity: ' || {complexity(guess('p.question'))} || ']' || chr(10) || chr(10)",
        "manual5": block(5),
        "near3": block(3),
        "near2": block(2),
        "example": one("Example:\nQuestion: ", "\nSolution: ", "\n\n"),
        "worked": one("Worked example:\nQuestion: ", "\nFull solution:\n", "\n\nApply the same approach:\n\n"),
        "reversed": f"coalesce((SELECT '[Example — answer is ' || coalesce({final_answer(solved)}, 'None') || ', question: ' || e.question || ']' || chr(10) || chr(10) FROM ex e WHERE position = 0), '')",
    }
    body = " || ".join([q(HEADER), *[f"({named[x[1:-1]]})" if x.startswith("{") else q(x) for x in LAYOUTS[sid]]])
    temperature, n = SAMPLING.get(sid, (TEMPERATURE, 1))
    return f"""WITH {allocated()},
ex AS MATERIALIZED (SELECT a.position, a.question, p.answer FROM a JOIN p ON p.pid = a.original_index WHERE strategy_id = {sid})
SELECT p.pid, {body} AS prompt, CAST({temperature} AS DOUBLE) AS temperature, {n} AS num_return_sequences FROM p"""

