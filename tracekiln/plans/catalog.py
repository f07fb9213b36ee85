"""Named queries over the tables and the SQL that gives the same rows.

Arrays are joined to strings, so that engines can be compared by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekiln.functions import classify, text, vectors, votes
from tracekiln.operators import neighbours, pools, records, reports, retry, selection
from tracekiln.plans import fixtures, generation, sql
from tracekiln.plans.prompts import DYNAMIC

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


P = sql.PROBLEMS


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.preprocessed(fixtures.problems(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.scored(_parsed(spark, sf_dir), ordinal="pid")


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = records.evaluated(_parsed(spark, sf_dir))
    return rated.withColumn("category_type", classify.category_type(F.col("question")))


# Text and answers

_NUMBERS = {
    "n_money": "'$' || CAST(p AS {s}) || ',000 dollars'",
    "n_fraction": "CAST(q AS {s}) || '.' || CAST(p AS {s}) || '0'",
    "n_long": "'-' || CAST(q AS {s}) || '.0' || CAST(p AS {s}) || CAST(qp AS {s})",
    "n_range": "CAST(q AS {s}) || '-' || CAST(p AS {s})",
    "n_percent": "CAST(q AS {s}) || '%'",
    "n_units": "' ' || CAST(qp AS {s}) || ' Boxes '",
}


@query(f"WITH {P} SELECT pid, {', '.join(f'{sql.normalize(f"({e.format(s='VARCHAR')})")} AS {n}' for n, e in _NUMBERS.items())} FROM p")
def normalize_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [text.normalize_number(F.expr(e.format(s="STRING"))).alias(n) for n, e in _NUMBERS.items()]
    return fixtures.problems(spark, sf_dir).select("pid", *cols)


@query(f"WITH {P} SELECT pid, {sql.answer('trace')} AS of_trace, {sql.answer('answer')} AS of_answer, {sql.answer('question')} AS of_question FROM p")
def extract_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.problems(spark, sf_dir).select("pid", *[text.extract_answer(F.col(c)).alias(f"of_{c}") for c in ("trace", "answer", "question")])


@query(f"WITH {P} SELECT pid, {sql.final_answer('trace')} AS of_trace, {sql.final_answer('question')} AS of_question FROM p")
def extract_final_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.problems(spark, sf_dir).select("pid", *[text.extract_final_answer(F.col(c)).alias(f"of_{c}") for c in ("trace", "question")])


@query(f"WITH {P} SELECT pid, {sql.match(sql.answer('trace'), sql.answer('answer'))} AS is_correct FROM p")
def answers_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("pid", text.answers_match(text.extract_answer(F.col("trace")), F.col("clean_answer")).alias("is_correct"))


@query(
    f"WITH {P} SELECT pid, array_to_string({sql.all_of('answer', text.COMPUTATION, 1)}, ';') AS exprs, array_to_string({sql.all_of('answer', text.COMPUTATION, 2)}, ';') AS results FROM p"
)
def extract_computations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.extract_computations(F.col("answer"))
    return fixtures.problems(spark, sf_dir).select("pid", F.array_join(found["expr"], ";").alias("exprs"), F.array_join(found["result"], ";").alias("results"))


@query(f"WITH {P} SELECT pid, array_to_string({sql.steps('answer')}, ' / ') AS steps FROM p")
def solution_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.problems(spark, sf_dir).select("pid", F.array_join(text.solution_steps(F.col("answer")), " / ").alias("steps"))


@query(
    f"WITH {P} SELECT pid, question, answer AS raw_answer, {sql.answer('answer')} AS clean_answer, len({sql.steps('answer')}) AS expected_steps, "
    f"len({sql.all_of('answer', text.COMPUTATION)}) AS n_computations FROM p"
)
def preprocess_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("pid", "question", "raw_answer", "clean_answer", "expected_steps", "n_computations")


@query(
    f"WITH {P}, c AS (SELECT {sql.answer('answer')} AS a, len({sql.steps('answer')}) AS s, len({sql.all_of('answer', text.COMPUTATION)}) AS n FROM p) "
    "SELECT count(*) AS n_problems, CAST(sum(n) AS BIGINT) AS computations, CAST(sum(s) AS BIGINT) AS steps, round(avg(n), 4) AS avg_computations, round(avg(s), 4) AS avg_steps, count(a) AS n_answers FROM c"
)
def preprocess_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.preprocess_stats(_parsed(spark, sf_dir))


@query(f"WITH {P} SELECT pid AS ordinal, question FROM p ORDER BY pid LIMIT 1")
def first_problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.first_row(fixtures.problems(spark, sf_dir).select(F.col("pid").alias("ordinal"), "question"))


@query(f"WITH {P} SELECT pid, len(list_filter(regexp_split_to_array(trace, '\\s+'), lambda w: w <> '')) AS num_tokens FROM p")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.problems(spark, sf_dir).select("pid", text.word_count(F.col("trace")).alias("num_tokens"))


# Classification

_D = "d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"


@query(f"WITH {P} SELECT pid, {sql.category('question')} AS category_type, array_to_string({sql.keyword_hits('question')}, ';') AS keyword_hits FROM p")
def category_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.problems(spark, sf_dir).select("pid", classify.category_type(F.col("question")).alias("category_type"), F.array_join(classify.keyword_hits(F.col("question")), ";").alias("keyword_hits"))


@query(
    f"WITH {_D} SELECT doc_id, {sql.category('text')} AS category_type, array_to_string({sql.keyword_hits('text')}, ';') AS keyword_hits, {sql.guess('text')} AS estimated_steps FROM d"
)
def document_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return fixtures.documents(spark, sf_dir).select(
        "doc_id", classify.category_type(c).alias("category_type"), F.array_join(classify.keyword_hits(c), ";").alias("keyword_hits"), classify.estimated_steps(c).alias("estimated_steps")
    )


@query(f"WITH {P} SELECT {sql.category('question')} AS category_type, count(*) AS n, repeat('█', CAST(least(count(*), 50) AS INT)) AS bar FROM p GROUP BY 1")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.problems(spark, sf_dir).select(classify.category_type(F.col("question")).alias("category_type"))
    return reports.category_counts(rows)


@query(
    f"WITH {P}, c AS (SELECT pid, {sql.guess('question')} AS of_question, CASE WHEN length(answer) > 0 THEN {sql.worked('answer')} ELSE {sql.guess('question')} END AS of_answer FROM p) "
    f"SELECT pid, of_question, of_answer, {sql.complexity('of_question')} AS complexity, {sql.complexity('of_answer')} AS complexity_solved FROM c"
)
def complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    alone, solved = classify.estimated_steps(F.col("question")), classify.estimated_steps(F.col("question"), F.col("answer"))
    return fixtures.problems(spark, sf_dir).select(
        "pid", alone.alias("of_question"), solved.alias("of_answer"), classify.complexity(alone).alias("complexity"), classify.complexity(solved).alias("complexity_solved")
    )


def _operation_sql() -> str:
    counts = ", ".join(f"{e} AS n_{n}" for n, e in sql.operation_counts("s").items())
    names = list(classify.OPERATIONS)
    most = f"greatest({', '.join(f'n_{n}' for n in names)})"
    ties = " + ".join(f"CAST(n_{n} = {most} AS INT)" for n in names)
    cases = " ".join(f"WHEN n_{n} = {most} THEN '{n}'" for n in names)
    return f"WITH {P}, j AS (SELECT pid, trace || ' ' || question AS s FROM p), c AS (SELECT pid, {counts} FROM j) SELECT pid, CASE WHEN {most} = 0 THEN 'none' WHEN {ties} > 1 THEN 'mixed' {cases} END AS main_operation FROM c"


@query(_operation_sql())
def main_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.categorized(fixtures.problems(spark, sf_dir), solution="trace")
    return rows.select("pid", "main_operation")


@query(f"WITH {P} SELECT pid AS id, {sql.richness('question')} AS richness_score FROM p UNION ALL SELECT -1 - doc_id, {sql.richness('coalesce(text, $$$$)')} FROM documents")
def richness(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours = fixtures.problems(spark, sf_dir).select(F.col("pid").alias("id"), classify.richness(F.col("question")).alias("richness_score"))
    return ours.unionAll(fixtures.documents(spark, sf_dir).select((-1 - F.col("doc_id")).alias("id"), classify.richness(F.col("text")).alias("richness_score")))


# Selection


@query(f"WITH {sql.scored()} SELECT original_index, category_type, richness_score, rank FROM r")
def rank_in_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.ranked(_scored(spark, sf_dir)).select("original_index", "category_type", "richness_score", "rank")


@query(
    f"WITH {sql.allocated()} SELECT strategy_id, strategy_name, need AS n_per_cat, a AS rank_start, b AS rank_end FROM dim"
)
def strategy_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.strategies(spark)


@query(f"WITH {sql.allocated()} SELECT strategy_id, position, original_index, category_type, rank, is_reuse FROM a")
def select_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.selected(_scored(spark, sf_dir)).select("strategy_id", "position", "original_index", "category_type", "rank", "is_reuse")


@query(f"WITH {sql.allocated()} SELECT original_index, question, ground_truth, richness_score, category_type FROM s WHERE original_index NOT IN (SELECT original_index FROM a)")
def remaining_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    return selection.remaining(rows, selection.selected(rows)).select("original_index", "question", "ground_truth", "richness_score", "category_type")


@query(
    f"WITH {sql.allocated()} SELECT strategy_id, {', '.join(f'''count(*) FILTER (WHERE category_type = '{c}') AS {c}''' for c in classify.CATEGORIES)}, count(*) AS total FROM a GROUP BY 1"
)
def selection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.selection_summary(selection.selected(_scored(spark, sf_dir)))


@query(f"WITH {sql.allocated()} SELECT count(*) AS n_total, count(DISTINCT original_index) AS n_distinct FROM a")
def total_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.total_examples(selection.selected(_scored(spark, sf_dir)))


@query(
    f"WITH {sql.allocated()} SELECT d.strategy_id, d.strategy_name, CAST(d.need * 8 AS BIGINT) AS need, count(a.position) AS have, d.need = 0 OR count(a.position) >= d.need * 8 AS sufficient "
    "FROM dim d LEFT JOIN a USING (strategy_id) GROUP BY 1, 2, d.need"
)
def sufficiency_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.sufficiency(selection.selected(_scored(spark, sf_dir)))


@query(
    f"WITH {sql.allocated()}, rest AS (SELECT * FROM s WHERE original_index NOT IN (SELECT original_index FROM a)) SELECT count(*) AS n_overlap FROM rest WHERE question IN (SELECT question FROM a)"
)
def overlap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    chosen = selection.selected(rows)
    return selection.overlap(chosen, selection.remaining(rows, chosen))


@query(f"WITH {sql.allocated()} SELECT category_type, count(*) AS n, repeat('█', CAST(least(count(*), 50) AS INT)) AS bar FROM a GROUP BY 1")
def exemplar_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.category_counts(selection.selected(_scored(spark, sf_dir)))


@query(
    f"WITH {sql.allocated()} SELECT category_type, count(*) AS n, repeat('█', CAST(least(count(*), 40) AS INT)) AS bar FROM s WHERE original_index NOT IN (SELECT original_index FROM a) GROUP BY 1"
)
def remaining_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    return reports.category_counts(selection.remaining(rows, selection.selected(rows)), bar=40)


@query(f"WITH {sql.allocated()} SELECT original_index, question, category_type FROM s WHERE original_index NOT IN (SELECT original_index FROM a) ORDER BY md5(original_index || '|42'), original_index LIMIT 200")
def pilot_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    return selection.sample(selection.remaining(rows, selection.selected(rows)), "original_index", 200).select("original_index", "question", "category_type")


# Quality

_SCORES = ("rex_score", "validity", "execution", "redundancy", "is_correct", "pred_answer", "gold_answer", "category", "num_steps", "n_gold_ops")


@query(f"WITH {sql.rated()} SELECT pid, validity FROM x")
def step_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rated(spark, sf_dir).select("pid", "validity")


@query(f"WITH {sql.rated()} SELECT pid, execution FROM x")
def execution_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rated(spark, sf_dir).select("pid", "execution")


@query(f"WITH {sql.rated()} SELECT pid, redundancy, num_steps FROM x")
def redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rated(spark, sf_dir).select("pid", "redundancy", "num_steps")


@query(f"WITH {sql.rated()} SELECT pid, {', '.join(_SCORES)} FROM x")
def rex_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rated(spark, sf_dir).select("pid", *_SCORES)


@query(f"WITH {sql.rated()} SELECT category, is_correct, count(*) AS n FROM x GROUP BY 1, 2")
def rex_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rated(spark, sf_dir).groupBy("category", "is_correct").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {sql.rated()} SELECT category_type, category, count(*) AS n, round(avg(rex_score), 6) AS avg_rex FROM x GROUP BY 1, 2")
def rex_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rated(spark, sf_dir).groupBy("category_type", "category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rex_score"), 6).alias("avg_rex"))


@query()
def document_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines of whole documents; DuckDB's edit distance counts bytes, so there is no SQL for it."""
    from tracekiln.functions import quality

    docs = fixtures.documents(spark, sf_dir).select("doc_id", text.trace_steps(F.col("text")).alias("steps"))
    return docs.select("doc_id", F.size("steps").alias("num_steps"), quality.redundancy(F.col("steps")).cast("double").alias("redundancy"))


# Neighbours


def _knn_sql(boost: str) -> str:
    dot = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE)))"
    return f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS pool_id, a.label = b.label AS same, {dot} AS d FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
k AS (SELECT query_id, pool_id, {boost} AS similarity FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, pool_id) AS rank FROM k)
SELECT query_id, rank, pool_id, round(similarity, 6) AS similarity FROM o WHERE rank <= 3"""


def _knn(spark: SparkSession, sf_dir: str, category: bool) -> DataFrame:
    pool = fixtures.embeddings(spark, sf_dir)
    found = neighbours.nearest(pool.where(F.col("id") % 100 == 0), pool, 3, category)
    return found.withColumn("similarity", F.round("similarity", 6))


@query(_knn_sql("CASE WHEN same THEN least(1.0, d + 0.15) ELSE d END"))
def knn_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, True)


@query(_knn_sql("d"))
def knn_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, False)


@query(rf"""WITH {P}, w AS (SELECT pid, regexp_extract_all(lower(question), '\b\w\w+\b') AS w FROM p),
t AS (SELECT pid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
e AS (SELECT pid, term, count(*) AS tf FROM t GROUP BY 1, 2),
v AS (SELECT term, sum(tf) AS al, count(*) AS df FROM e GROUP BY 1 ORDER BY al DESC, term LIMIT 512),
x AS (SELECT pid, term, tf * (ln((1 + (SELECT count(*) FROM p)) / (1 + df)) + 1) AS w FROM e JOIN v USING (term)),
n AS (SELECT pid, sqrt(sum(w * w)) AS norm FROM x GROUP BY 1)
SELECT pid, term, round(w / norm, 6) AS weight FROM x JOIN n USING (pid)""")
def tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.tf_idf(fixtures.problems(spark, sf_dir), "pid", "question").withColumn("weight", F.round("weight", 6))


# Votes, prompts, generation


@query(f"""WITH {P}, a AS (SELECT pid // 5 AS batch, pid, {sql.final_answer('trace')} AS answer FROM p),
c AS (SELECT batch, answer, count(*) AS n, min(pid) AS first FROM a WHERE answer IS NOT NULL GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY n DESC, first) AS k FROM c)
SELECT batch, answer AS vote, n AS n_votes FROM o WHERE k = 1""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.problems(spark, sf_dir).select(F.floor(F.col("pid") / 5).alias("batch"), "pid", text.extract_final_answer(F.col("trace")).alias("answer"))
    return votes.vote_by(rows, "batch", "answer", "pid")


@query(f"""WITH {P}, a AS (SELECT pid, trace, {sql.final_answer('trace')} AS ans FROM p), m AS (SELECT pid, [ans, CAST(q AS VARCHAR), CAST(q AS VARCHAR), ans, NULL] AS l, trace FROM a JOIN p USING (pid, trace))
SELECT pid, l[1] AS vote, trace AS chosen FROM m""")
def vote_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.problems(spark, sf_dir)
    ans = text.extract_final_answer(F.col("trace"))
    other = F.col("q").cast("string")
    rows = rows.select("pid", F.array(F.col("trace"), other, other, F.col("trace"), F.lit(None)).alias("traces"), F.array(ans, other, other, ans, F.lit(None)).alias("answers"))
    rows = rows.withColumn("vote", votes.majority_vote(F.col("answers")))
    return rows.select("pid", "vote", votes.representative(F.col("traces"), F.col("answers"), F.col("vote")).alias("chosen"))


def _prompts(spark: SparkSession, sf_dir: str, sid: int | str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    fields = ("ground_truth",)
    manual = generation.manual_examples(selection.selected(rows), fields)
    return generation.prompted(rows, sid, manual, None, fields)


def _prompt(sid: int) -> None:
    def made(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _prompts(spark, sf_dir, sid).select(F.col("original_index").alias("pid"), "prompt", "temperature", "num_return_sequences")

    made.__name__ = f"prompt_{sid:02}"
    query(sql.prompt(sid))(made)


for _sid in range(16):
    _prompt(_sid)


@query(
    f"WITH {P}, {sql.stub('SELECT pid, question, pid % 16 AS sid FROM p')}, t AS (SELECT *, len(list_filter(regexp_split_to_array(trace, '\\s+'), lambda w: w <> '')) AS num_tokens FROM g) "
    f"SELECT pid AS original_index, CAST(sid AS INT) AS strategy_id, strategy_name, trace, {sql.final_answer('trace')} AS answer, num_tokens, CASE WHEN n > 1 THEN n ELSE 0 END AS n_candidates, CASE WHEN n = 1 THEN num_tokens ELSE 0 END AS n_logprobs FROM t"
)
def generate_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every problem once, strategies in turn, with the backend that needs no model."""
    scored = _scored(spark, sf_dir).select("original_index", "question", "category_type", "complexity")
    rows = scored.withColumn("sid", F.pmod("original_index", F.lit(16)).cast("int"))
    manual = generation.manual_examples(selection.selected(_scored(spark, sf_dir)), ("ground_truth",))
    made = generation.generated(generation.prompted(rows, "sid", manual, None, ("ground_truth",)), generation.StubBackend())
    return made.select("original_index", "strategy_id", "strategy_name", "trace", "answer", "num_tokens", F.size("candidates").alias("n_candidates"), F.size(F.coalesce("token_logprobs", F.array())).alias("n_logprobs"))


@query()
def prompt_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of the strategies that retrieve, for every hundredth problem, with the nearest of the whole good pool."""
    pool = pools.view(_pool(spark, sf_dir), "good").withColumn("embedding", vectors.word_vector(F.col("question")))
    rows = _scored(spark, sf_dir).where(F.col("original_index") % 100 == 0).withColumn("embedding", vectors.word_vector(F.col("question")))
    fields = ("trace", "ground_truth")
    near = generation.near_examples(rows, pool, fields=fields)
    sid = F.element_at(F.array(*[F.lit(s) for s in DYNAMIC]), (F.pmod(F.floor(F.col("original_index") / 100), F.lit(len(DYNAMIC))) + 1).cast("int"))
    made = generation.prompted(rows.withColumn("sid", sid), "sid", None, near, fields)
    return made.select("original_index", "strategy_id", "prompt", "temperature", "num_return_sequences")


# Pools


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = _rated(spark, sf_dir).withColumn("original_index", F.col("pid")).withColumn("ground_truth", F.col("raw_answer"))
    return pools.added(None, rated.select("original_index", "question", "ground_truth", "trace", "category_type", "rex_score", "category", "pid"), seq="pid")


_G = f"{sql.rated()}, g AS (SELECT pid AS seq, category_type, rex_score FROM x WHERE category = 'good')"


@query(f"WITH {_G} SELECT row_number() OVER (ORDER BY rex_score DESC, seq) - 1 AS position, seq, category_type, rex_score FROM g ORDER BY 1 LIMIT 5")
def pool_top_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.good(_pool(spark, sf_dir), 5).select("position", "seq", "category_type", "rex_score")


@query(f"WITH {_G} SELECT row_number() OVER (ORDER BY (category_type = 'arithmetic') DESC, rex_score DESC, seq) - 1 AS position, seq, category_type, rex_score FROM g ORDER BY 1 LIMIT 40")
def pool_category_pref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.good(_pool(spark, sf_dir), 40, "arithmetic").select("position", "seq", "category_type", "rex_score")


@query(
    f"WITH {_G}, h AS (SELECT *, row_number() OVER (PARTITION BY category_type ORDER BY rex_score DESC, seq) AS rn FROM g) "
    "SELECT row_number() OVER (ORDER BY rn > 1, rex_score DESC, seq) - 1 AS position, seq, category_type, rex_score FROM h ORDER BY 1 LIMIT 12"
)
def pool_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.good(_pool(spark, sf_dir), 12, strategy="diverse").select("position", "seq", "category_type", "rex_score")


@query(f"WITH {_G} SELECT row_number() OVER (ORDER BY md5(seq || '|42'), seq) - 1 AS position, seq, category_type, rex_score FROM g ORDER BY 1 LIMIT 20")
def pool_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.good(_pool(spark, sf_dir), 20, strategy="random").select("position", "seq", "category_type", "rex_score")


@query(
    f"WITH {sql.rated()}, c AS (SELECT category_type, count(*) AS n FROM x WHERE category = 'good' GROUP BY 1) SELECT count(*) AS total, "
    + ", ".join(f"count(*) FILTER (WHERE category = '{p}') AS {p}, round(100 * count(*) FILTER (WHERE category = '{p}') / count(*), 1) AS {p}_pct" for p in pools.POOLS)
    + ", round(avg(rex_score) FILTER (WHERE category = 'good'), 4) AS avg_good_score, (SELECT string_agg(category_type || ':' || n, ';' ORDER BY category_type) FROM c) AS good_by_category FROM x"
)
def pool_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.transform(F.map_entries("good_by_category"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return pools.stats(_pool(spark, sf_dir)).withColumn("good_by_category", F.array_join(F.array_sort(entries), ";"))


@query(f"WITH {sql.rated()} SELECT category_type, count(*) AS n FROM x WHERE category = 'good' GROUP BY 1")
def pool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.summary(_pool(spark, sf_dir))


def _retried(spark: SparkSession, sf_dir: str, pool: str | None) -> DataFrame:
    manual = generation.manual_examples(selection.selected(_scored(spark, sf_dir)), ("trace", "raw_answer"))
    every = _pool(spark, sf_dir)
    rows = every.where(F.col("pool").isin(*retry.RULES)) if pool is None else pools.view(every, pool)
    return retry.retried(rows, pool, generation.StubBackend(), manual)


@query(f"WITH {sql.retried('medium', 2, ('good',))} SELECT pid AS original_index, category, rex_score, 2 AS strategy_id, true AS retry, 'medium' AS recovered_from FROM y WHERE recovered")
def retry_medium(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retry.recovered(_retried(spark, sf_dir, "medium"), "medium").select("original_index", "category", "rex_score", "strategy_id", "retry", "recovered_from")


@query(f"WITH {sql.retried('bad', 15, ('good', 'medium'))} SELECT pid AS original_index, category, rex_score, 15 AS strategy_id, true AS retry, 'bad' AS recovered_from FROM y WHERE recovered")
def retry_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retry.recovered(_retried(spark, sf_dir, "bad"), "bad").select("original_index", "category", "rex_score", "strategy_id", "retry", "recovered_from")


def _rate_sql(pool: str, sid: int, enough: tuple[str, ...]) -> str:
    return f"(WITH {sql.retried(pool, sid, enough)} SELECT count(*) FILTER (WHERE recovered) AS recovered, count(*) AS total, round(100 * count(*) FILTER (WHERE recovered) / greatest(count(*), 1), 1) AS rate_pct, '{pool}' AS pool FROM y)"


@query(f"{_rate_sql('medium', 2, ('good',))} UNION ALL {_rate_sql('bad', 15, ('good', 'medium'))}")
def recovery_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retry.recovery_rates(_retried(spark, sf_dir, None))
