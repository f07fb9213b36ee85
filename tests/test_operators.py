"""Selection, pools, retries, prompts, files and the stream against plain Python."""

from __future__ import annotations

import json
import random
from datetime import datetime

import pytest

from tracekiln import schemas
from tracekiln.functions.classify import CATEGORIES
from tracekiln.operators import neighbours, pools, retry, selection
from tracekiln.operators.records import bounded
from tracekiln.plans.dims import STRATEGIES, strategy_rows
from tracekiln.plans.generation import HuggingFaceBackend, StubBackend, generated, prompted
from tracekiln.plans.prompts import SAMPLING
from tracekiln.sources import files
from tracekiln.streaming import feedback


def test_rank_intervals():
    spans = {sid: (a, b) for sid, _, need, a, b in strategy_rows() if need}
    assert spans == {2: (1, 5), 13: (6, 10), 15: (11, 15), 3: (16, 18), 7: (19, 21), 8: (22, 24), 9: (25, 27), 14: (28, 30), 10: (31, 32), 11: (33, 34), 12: (35, 35)}


def greedy(by_category: dict[str, list[int]]) -> dict[int, list[int]]:
    """Each strategy takes its need in turn, unused first, and fills up with used ones."""
    used: set[int] = set()
    out = {}
    for sid in sorted(range(16), key=lambda s: -STRATEGIES[s][1]):
        need, chosen = STRATEGIES[sid][1], []
        for c in CATEGORIES:
            ranking = by_category.get(c, [])
            new = [x for x in ranking if x not in used][:need]
            old = [x for x in ranking if x in used][: need - len(new)]
            used.update(new)
            chosen += new + old
        out[sid] = chosen
    return out


def test_selection_is_the_greedy_one(spark):
    r = random.Random(1)
    sizes = dict(zip(CATEGORIES, (0, 1, 3, 5, 17, 34, 35, 60), strict=True))
    rows = [(i, c, r.choice([0.1, 0.2, 0.3])) for i, c in enumerate(c for c, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame([(i, f"q{i}", c, s) for i, c, s in rows], "original_index long, question string, category_type string, richness_score double")
    ranking = {c: [i for i, d, s in sorted(rows, key=lambda x: (-x[2], x[0])) if d == c] for c in CATEGORIES}
    want = greedy(ranking)
    chosen = selection.selected(df.repartition(5))
    got: dict[int, list[int]] = {s: [] for s in range(16)}
    for x in chosen.orderBy("strategy_id", "position").collect():
        got[x["strategy_id"]].append(x["original_index"])
    assert got == want
    rest = {x[0] for x in selection.remaining(df, chosen).select("original_index").collect()}
    assert rest == {i for i, *_ in rows} - {i for v in want.values() for i in v}
    assert selection.overlap(chosen, df).first()[0] == len({i for v in want.values() for i in v})
    enough = {x["strategy_id"]: x["sufficient"] for x in selection.sufficiency(chosen).collect()}
    assert enough == {s: need == 0 or len(want[s]) >= 8 * need for s, (_, need) in enumerate(STRATEGIES)}


def test_sample_and_bounds(spark):
    df = spark.range(100).withColumnRenamed("id", "ordinal")
    a = [r[0] for r in selection.sample(df, "ordinal", 10).collect()]
    assert len(set(a)) == 10 and a == [r[0] for r in selection.sample(df.repartition(7), "ordinal", 10).collect()]
    assert bounded(df, 0).count() == 100 and bounded(df, 7).count() == 7 and bounded(df).count() == 100


def test_neighbours(spark):
    r = random.Random(2)
    rows = [(i, [r.random() for _ in range(4)], r.choice("ab")) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>, category string")
    got = neighbours.nearest(df, df, 3, block=7).orderBy("query_id", "rank").collect()
    f32 = {x["id"]: x["embedding"] for x in df.collect()}
    for q, _, c in rows:
        dots = {j: sum(a * b for a, b in zip(f32[q], f32[j], strict=True)) for j, _, _ in rows}
        want = sorted(rows, key=lambda x: (-(min(1.0, dots[x[0]] + 0.15) if x[2] == c else dots[x[0]]), x[0]))[:3]
        assert [x["pool_id"] for x in got if x["query_id"] == q] == [x[0] for x in want]
    assert neighbours.nearest(df, df.limit(0), 3).count() == 0


ROWS = [(0, "good", "time", 0.7), (1, "good", "rate", 0.9), (2, "good", "time", 0.9), (3, "medium", "rate", 0.5), (4, "odd", None, 0.1), (5, "good", None, 0.8)]


def pool_of(spark):
    df = spark.createDataFrame([(i, f"q{i}", c, t, s) for i, c, t, s in ROWS], "seq long, question string, category string, category_type string, rex_score double")
    return pools.added(None, df)


def test_pools(spark):
    pool = pool_of(spark)
    order = lambda **k: [r["seq"] for r in pools.good(pool, **k).orderBy("position").collect()]
    assert order(k=9) == [1, 2, 5, 0]
    assert order(k=3, category_type="time") == [2, 0, 1]
    assert order(k=9, strategy="diverse") == [1, 2, 5, 0]
    assert order(k=4, by=("hybrid_score", "quality_score")) == [0, 1, 2, 5]
    assert sorted(order(k=2, strategy="random")) == sorted(order(k=2, strategy="random")) and len(order(k=9, strategy="random")) == 4
    with pytest.raises(ValueError, match="strategy"):
        pools.good(pool, strategy="best")
    s = pools.stats(pool).first()
    assert (s["total"], s["good"], s["medium"], s["bad"], s["good_pct"], s["avg_good_score"]) == (6, 4, 1, 1, 66.7, 0.825)
    assert s["good_by_category"] == {"time": 2, "rate": 1, "unknown": 1}
    empty = pools.stats(pool.limit(0)).first()
    assert (empty["total"], empty["good_pct"], empty["avg_good_score"], empty["good_by_category"]) == (0, 0.0, 0.0, {})
    assert pools.moved_to_good(pool, pools.view(pool, "medium")).count() == 7
    assert pools.view(pools.replaced(pool, "bad", pool.limit(0)), "bad").count() == 0
    with pytest.raises(ValueError, match="good"):
        pools.replaced(pool, "good", pool)


def test_prompts_and_generation(spark):
    df = spark.createDataFrame([(i, "What is 3 and 4?", "time", "simple") for i in range(16)], "original_index int, question string, category_type string, complexity string")
    rows = prompted(df, "original_index").orderBy("original_index").collect()
    for r in rows:
        t, n = SAMPLING.get(r["original_index"], (0.7, 1))
        assert (r["temperature"], r["num_return_sequences"]) == (t, n) and "Question: What is 3 and 4?" in r["prompt"]
    assert "[Problem type: TIME | Complexity: simple]" in rows[10]["prompt"]
    with pytest.raises(Exception, match="unknown strategy"):
        prompted(df, 16).collect()
    made = {r["original_index"]: r for r in generated(prompted(df, "original_index"), StubBackend(wrong_of_8=0)).collect()}
    for sid, r in made.items():
        n = SAMPLING.get(sid, (0.7, 1))[1]
        assert r["answer"] == "7" and r["strategy_name"] == STRATEGIES[sid][0] and len(r["candidates"]) == (n if n > 1 else 0)
        assert (r["token_logprobs"] is None) == (n > 1) and r["num_tokens"] == len(r["trace"].split())
    with pytest.raises(RuntimeError, match="torch"):
        HuggingFaceBackend("none").open()


def test_row_that_the_backend_fails_on_stays(spark):
    class Picky:
        """A backend that raises for requests with a certain word, and so for every batch that has one."""

        def open(self):
            ask = StubBackend().open()

            def run(requests):
                if any("odd" in r[0].rsplit("Question: ", 1)[-1] for r in requests):
                    raise ValueError("odd")
                return ask(requests)

            return run

    rows = spark.createDataFrame([(0, "Add 2 and 3.", "#### 5"), (1, "An odd 2 and 3.", "#### 5")], "original_index long, question string, raw_answer string").coalesce(1)
    outcome = retry.retried(rows, "bad", Picky())
    assert {r["original_index"]: r["new"]["trace"] is not None for r in outcome.collect()} == {0: True, 1: False}
    assert [r["original_index"] for r in retry.left_over(outcome).where("original_index = 1").collect()] == [1]
    with pytest.raises(Exception, match="odd"):
        generated(prompted(retry.categorized(retry.preprocessed(rows, answer="raw_answer")), 0), Picky()).collect()


def test_nearest_examples_in_prompts(spark):
    import math
    import re
    import zlib
    from collections import Counter

    from pyspark.sql import functions as F

    from tracekiln.functions.vectors import word_vector
    from tracekiln.plans.generation import near_examples

    texts = ["red pens and blue pens", "a pump fills tanks", "blue pens in a box", "", "tanks and a pump", "red red box"]
    kinds = ["x", "y", "x", "y", "y", "x"]

    def vector(t):
        c = Counter(zlib.crc32(w.encode()) % 64 for w in re.findall("[a-z0-9]+", t))
        n = max(1.0, math.sqrt(sum(v * v for v in c.values())))
        return {k: v / n for k, v in c.items()}

    pool = spark.createDataFrame([(i, t, k, f"trace {i}") for i, (t, k) in enumerate(zip(texts, kinds, strict=True))], "seq long, question string, category_type string, trace string")
    pool = pool.withColumn("embedding", word_vector(F.col("question")))
    asked = pool.withColumn("original_index", F.col("seq") + 10).withColumn("complexity", F.lit("simple"))
    near = near_examples(asked, pool, 3)
    made = {r["original_index"] - 10: r["near"] for r in near.collect()}
    for i, t in enumerate(texts):
        a = vector(t)
        score = {j: min(1.0, s + 0.15) if kinds[i] == kinds[j] else s for j, o in enumerate(texts) for s in [sum(v * vector(o).get(k, 0) for k, v in a.items())]}
        best = sorted(score, key=lambda j: (-round(score[j], 12), j))[:3]
        assert [round(score[int(e["trace"][6:])], 9) for e in made[i]] == [round(score[j], 9) for j in best]
    prompts = {r["original_index"]: r["prompt"] for r in prompted(asked, 3, None, near).collect()}
    assert all(e["trace"] in prompts[i + 10] for i, x in made.items() for e in x)


def test_retry(spark):
    q = "A shop takes 2 percent off 3 boxes that cost 5 dollars. What is left to pay?"
    truth = "We take <<3*5=15>>15.\nWe put <<15+2=17>>17.\n#### 17"
    rows = spark.createDataFrame([(1, q, truth, "medium"), (2, "Is it 1 or 2?", "#### 9", "medium")], "original_index long, question string, ground_truth string, category string")
    outcome = retry.retried(rows, "medium", StubBackend(wrong_of_8=0))
    back = retry.recovered(outcome, "medium").collect()
    assert [(r["original_index"], r["category"], r["retry"], r["recovered_from"], r["strategy_id"]) for r in back] == [(1, "good", True, "medium", 2)]
    left = retry.left_over(outcome)
    assert left.columns == rows.columns and [r["original_index"] for r in left.collect()] == [2]
    assert tuple(retry.recovery_rate(outcome).first()) == (1, 2, 50.0)


def test_files(spark, tmp_path):
    pool = pool_of(spark)
    path = files.save_pool(pool, str(tmp_path), "run", datetime(2024, 1, 2, 3, 4, 5))
    assert path.endswith("pool_run_20240102_030405")
    got = files.load_pool(spark, path)
    assert sorted((r["seq"], r["pool"]) for r in got.collect()) == sorted((r["seq"], r["pool"]) for r in pool.collect())
    assert files.load_pool(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "good.json").write_text(json.dumps([{"question": "a", "rex_score": 0.9}, {"question": "b"}], indent=2))
    arrays = files.load_pool_arrays(spark, str(tmp_path / "good.json"), str(tmp_path / "missing.json"))
    assert [(r["pool"], r["seq"], r["question"], r["rex_score"]) for r in arrays.orderBy("seq").collect()] == [("good", 0, "a", 0.9), ("good", 1, "b", None)]
    config = files.run_config(spark, 7473, 200, 7223)
    files.write_json(config, str(tmp_path / "config"), 1)
    assert spark.read.json(str(tmp_path / "config")).first()["pool_size"] == 7473


def test_examples_round_trip(spark, tmp_path):
    rows = [(i, f"q{i}", "t", 0.5, c) for i, c in enumerate(c for c in CATEGORIES for _ in range(6))]
    df = spark.createDataFrame(rows, "original_index long, question string, ground_truth string, richness_score double, category_type string")
    chosen = selection.selected(df)
    files.write_examples(chosen, str(tmp_path / "examples"))
    whole = json.loads(next((tmp_path / "examples").glob("*.txt")).read_text())
    assert set(whole) == {str(i) for i in range(16)} and whole["0"] == []
    back = files.read_examples(spark, str(tmp_path / "examples"))
    key = lambda d: sorted((r["strategy_id"], r["position"], r["original_index"]) for r in d.collect())
    assert key(back) == key(chosen)


def test_stream_sees_what_earlier_batches_made(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for b in range(2):
        rows = [{"ordinal": 16 * b + k, "question": "A shop takes 2 percent off 3 boxes that cost 5 dollars.", "answer": "<<3*5=15>> <<15+2=17>>\n#### 17"} for k in range(16)]
        (source / f"{b}.json").write_text("\n".join(map(json.dumps, rows)))
    stream = feedback.run(feedback.read_stream(spark, str(source)), str(tmp_path / "pool"), str(tmp_path / "state"), StubBackend(wrong_of_8=0))
    stream.awaitTermination(120)
    assert stream.exception() is None
    made = feedback.snapshot(spark, str(tmp_path / "pool"), 99)
    assert made.count() == 32 and made.where("pool = 'good'").count() > 0
    assert feedback.snapshot(spark, str(tmp_path / "pool"), 1).count() == 16
    assert set(made.columns) == {f.split(" ")[0] for f in schemas.POOL.replace("array<string>", "x").split(", ")}


def test_orders_are_dealt_to_all_cores(spark, tmp_path):
    """A small file is one task; what is made of its rows is not. (F1 of round 3)"""
    from tracekiln.plans import fixtures

    row = "id AS o_orderkey, id AS o_custkey, double(id) AS o_totalprice"
    spark.range(1000).selectExpr(*row.split(", ")).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    parts = [len(p) for p in fixtures.problems(spark, str(tmp_path)).rdd.glom().collect()]
    assert sum(parts) == 1000 and max(parts) < 100 and sum(n > 0 for n in parts) >= 16


def test_filter_on_a_pool_rates_once(spark):
    """The rating is in the plan once, not also in the filter, and whichever pool is asked for. (F1, F9 to F12 of round 3)"""
    from tracekiln.operators import records

    q, a, t = "A shop takes 2 percent off 3 boxes.", "We take <<3*5=15>>15.\n#### 15", "First take 3 * 5 = 15\nNext 1\n#### 15"
    df = spark.createDataFrame([(0, q, a, t), (1, q, a, "#### 9"), (2, None, None, None)], "seq long, question string, answer string, trace string")
    pool = pools.added(None, records.evaluated(records.preprocessed(df)))
    for name in pools.POOLS:
        plan = pools.view(pool, name)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("levenshtein") == 1
    assert {r["seq"]: r["pool"] for r in pool.collect()} == {0: "good", 1: "bad", 2: "bad"}
    again = records.settled(df, seq=df["seq"] + 1)
    assert again.columns == ["question", "answer", "trace", "seq"] and [r["seq"] for r in again.orderBy("seq").collect()] == [1, 2, 3]


def test_search_gives_what_the_expressions_give(spark):
    """Copies, ties, capped scores, nulls, NaN and lengths that differ, in many packs and blocks, against all pairs. (F2, F4, F5 of round 3)"""
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    from tracekiln.functions.vectors import boosted, cosine

    r = random.Random(3)
    vectors = [[r.choice([0.0, 0.1, 0.3, 0.9]) for _ in range(4)] for _ in range(40)]
    odd = [None, [], [0.1, None, 0.2, 0.3], [float("nan"), 0.1, 0.1, 0.1], [0.5, 0.5], [1e20, 0.0, 0.0, 0.0], [-0.0, 0.0, 0.0, 0.0]]
    rows = [(i, r.choice(vectors) if i % 9 else r.choice(odd), r.choice(["a", "b", None])) for i in range(400)]
    pool = spark.createDataFrame(rows, "id long, embedding array<float>, category string").repartition(3)
    asked = pool.where("id % 5 = 0")
    for category in (True, False):
        score = cosine(F.col("q"), F.col("embedding"))
        score = boosted(score, F.coalesce(F.col("qc") == F.col("category"), F.lit(False))) if category else score
        q = asked.select(F.col("id").alias("query_id"), F.col("embedding").alias("q"), F.col("category").alias("qc"))
        order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "pool_id")
        every = q.crossJoin(pool.withColumnRenamed("id", "pool_id")).select("query_id", "pool_id", score.alias("similarity"))
        want = every.withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("query_id", "rank", "pool_id", "similarity")
        got = neighbours.nearest(asked, pool, 3, category, block=30)
        key = lambda d: sorted(map(repr, d.collect()))
        assert key(got) == key(want)


def test_search_reads_the_pool_once(spark):
    """However many queries there are: no branch of the plan for each 512 of them. (F2 of round 3)"""
    from pyspark.sql import functions as F

    pool = spark.range(3000).select("id", F.array(F.rand(1), F.rand(2)).alias("embedding"), F.lit("x").alias("category"))
    near = neighbours.nearest(pool, pool, 1, block=neighbours.BLOCK)
    assert near._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0
    assert near.count() == 3000


def test_retries_of_all_pools_are_one_pass(spark):
    """Both rates from one run of the backend, the same as pool by pool; the outcome is not rated again for its filter. (F3, F6, F7 of round 3)"""
    q = "A shop takes 2 percent off {} boxes that cost 5 dollars. What is left to pay?"
    rows = [(i, q.format(i), f"<<{i}*5={5 * i}>>\n<<{5 * i}+2={5 * i + 2}>>\n#### {5 * i + 2 + (i == 4)}", "medium" if i % 2 else "odd", None) for i in range(3, 12)]
    df = spark.createDataFrame(rows, "seq long, question string, ground_truth string, category string, trace string")
    pool = pools.added(None, df.withColumnRenamed("seq", "original_index"), seq="original_index")
    both = retry.retried(pool, None, StubBackend())
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    want = {}
    for name in retry.RULES:
        one = retry.retried(pools.view(pool, name), name, StubBackend())
        assert sorted(map(repr, one.collect())) == sorted(map(repr, pools.view(both, name).collect()))
        won = retry.recovered(one, name)._jdf.queryExecution().optimizedPlan().toString()
        assert won.count("levenshtein") == 1
        want[name] = tuple(retry.recovery_rate(one).first())
    assert {r["pool"]: tuple(r)[:3] for r in retry.recovery_rates(both).collect()} == want and 0 < want["medium"][0]
    assert sorted(map(tuple, retry.recovery_rates(both.limit(0)).collect())) == [(0, 0, 0.0, "bad"), (0, 0, 0.0, "medium")]


def test_other_columns_pass_the_backend_as_they_are(spark):
    from pyspark.sql import functions as F

    df = spark.range(3).select(F.col("id").alias("original_index"), F.concat(F.lit("Add 2 and "), F.col("id")).alias("question"), F.lit("time").alias("category_type"), F.lit("simple").alias("complexity"))
    df = df.withColumn("kept", F.struct(F.when(F.col("original_index") == 1, F.array(F.lit(1), F.lit(None))).alias("a"), F.lit(None).cast("decimal(5,2)").alias("b"), F.map_from_arrays(F.array(F.lit("k")), F.array("original_index")).alias("c")))
    made = {r["original_index"]: r["kept"] for r in generated(prompted(df, 0), StubBackend()).collect()}
    assert made == {r["original_index"]: r["kept"] for r in df.collect()}


def test_tf_idf_without_a_shuffle_of_terms(spark):
    """Keys that repeat, are null or have long texts, against plain Python; no term of a lone text is shuffled with its key. (F8 of round 3)"""
    import math
    import re
    from collections import Counter

    r = random.Random(4)
    word = lambda: r.choice("ab bc cd de ef É١x a".split())
    rows = [(i if i % 5 else i // 20, " ".join(word() for _ in range(r.choice([0, 1, 5, 9])))) for i in range(60)]
    rows += [(1000, " ".join(word() for _ in range(400))), (1001, None), (None, "ab bc"), (None, "ab zz")]
    df = spark.createDataFrame(rows, "k int, t string").repartition(3)
    each: dict = {}
    for k, t in rows:
        w = re.findall(r"\b\w\w+\b", (t or "").lower())
        each.setdefault(k, Counter()).update(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])
    every, docs = Counter(), Counter()
    for c in each.values():
        every.update(c)
        docs.update(c.keys())
    vocabulary = sorted(every, key=lambda x: (-every[x], x.encode()))[:20]
    want = {}
    for k, c in each.items():
        w = {x: c[x] * (math.log((1 + len(rows)) / (1 + docs[x])) + 1) for x in vocabulary if x in c}
        want |= {(k, x): v / math.sqrt(sum(y * y for y in w.values())) for x, v in w.items() if k is not None}
    made = neighbours.tf_idf(df, "k", "t", 20)
    got = {(x["k"], x["term"]): x["weight"] for x in made.collect()}
    assert made.columns == ["k", "term", "weight"] and got.keys() == want.keys() and len(want) > 100
    assert all(abs(got[x] - want[x]) < 1e-12 for x in want)
    lone = spark.range(200).selectExpr("id AS k", "concat('one two w', id) AS t")
    made = neighbours.tf_idf(lone, "k", "t")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert made.count() == 1000 and "MapInArrow" in plan
