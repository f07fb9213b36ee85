"""Problems and traces derived from ``orders``, the same in Spark and in SQL.

One problem an order, on whole numbers only. Eight templates give eight topics,
the last only for the first orders, so that a topic is too short for its quota.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Question by topic number; {q}, {p} and {t} stand for numbers of the order.
TEMPLATES = (
    "A shop takes {t} percent off {q} boxes that cost {p} dollars. What is left to pay?",
    "{q} boxes cost {p} dollars. What is the total price?",
    "A crew works {q} hours and {p} hours more. How long is that?",
    "A pump fills {q} tanks at a speed of {p}. What is the total?",
    "There are {q} red pens and {p} blue pens. How many pens in all?",
    "The ratio of red to blue is {q} to {p}. Find the blue part.",
    "Bob must pick {q} or {p}. Which is bigger, exactly?",
    "Add {q} and {p}, now double it.",
)
#: Orders from this number on have no problem of the last topic.
SCARCE = 160
#: Into how many parts the orders are dealt: some for each core, and not fewer where executors are still to come.
PARTS_A_CORE, LEAST_PARTS = 3, 32


def _filled(template: str) -> str:
    """SQL for a template, for both engines."""
    text = "'" + template + "'"
    for name in ("q", "p", "t"):
        text = text.replace("{" + name + "}", f"' || CAST({name} AS {{string}}) || '")
    return text.replace("'' || ", "").replace(" || ''", "")


def problems_sql(string: str, orders: str = "orders") -> str:
    """SQL of the problems and their traces: pid, question, answer, trace; ``string`` names the text type."""
    s = lambda x: f"CAST({x} AS {string})"
    questions = " ".join(f"WHEN {k} THEN {_filled(t).replace('{string}', string)}" for k, t in enumerate(TEMPLATES))
    line = f"'First take ' || {s('q')} || ' * ' || {s('p')} || ' = ' || {s('qp')}"
    nl = "chr(10)"
    second = f"CASE WHEN pid % 3 = 0 THEN 'Now, we add the rest' ELSE 'Next put ' || {s('qp')} || ' + ' || {s('t')} || ' = ' || {s('y')} END"
    twice = f"CASE WHEN pid % 7 = 0 THEN {line} || '!' || {nl} ELSE '' END"
    return f"""
SELECT pid, q, p, t, qp, x, y, CASE k {questions} END AS question,
  'First we take <<' || {s('q')} || '*' || {s('p')} || '=' || {s('qp')} || '>>' || {s('qp')} || ' in all.' || {nl} || 'Next we put <<'
    || {s('qp')} || '+' || {s('t')} || '=' || {s('x')} || '>>' || {s('x')} || '.' || {nl} || '#### ' || {s('x')} AS answer,
  CASE WHEN pid % 11 = 0 THEN '#### ' || {s('x')}
    ELSE {line} || {nl} || {twice} || {second} || {nl} || '#### ' || {s('y')} END AS trace
FROM (SELECT *, CASE WHEN pid % 5 = 0 THEN x + 1 ELSE x END AS y FROM (SELECT *, qp + t AS x FROM (SELECT *, q * p AS qp FROM (
  SELECT o_orderkey AS pid, CAST(floor(o_totalprice) AS BIGINT) % 47 + 3 AS q, o_custkey % 90 + 10 AS p, o_orderkey % 6 + 2 AS t,
    CASE WHEN o_orderkey % 8 = 7 AND o_orderkey >= {SCARCE} THEN 0 ELSE o_orderkey % 8 END AS k FROM {orders}))))"""


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, question, answer, trace and the numbers in them; over the three columns of ``orders`` that it needs.

    A file of a few megabytes is one task or two, but its rows are a minute's work and more.
    So the three columns are dealt to all cores before anything is made of them.
    """
    orders = spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    dealt = orders.repartition(max(LEAST_PARTS, PARTS_A_CORE * spark.sparkContext.defaultParallelism), "o_orderkey")
    return spark.sql(problems_sql("STRING", "{orders}"), orders=dealt)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, embedding, category: the label stands for a topic."""
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("category"))
