"""Golden cases of the text, classification and quality functions."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracekiln.functions import classify, quality, text, votes


def values(spark, fn, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", fn(F.col("x"))).orderBy("i").collect()]


ANSWERS = {
    "#### 1,024": "1024",
    "#### 18.": "18",
    "#### 18.50": "18.5",
    "#### $18": "18",
    "#### -": None,
    "#### 5-3": None,
    "42 apples, yes": None,
    "The answer is 7, ok": "7",
    "The answer is $7": "7",
    "answer: 3.": "3",
    ".5 left": "5",
    "0.00001 x": "0",
    "1 and 2 #### 3 #### 4": "3",
    "9" * 400: None,
    "": None,
}


def test_extract_answer(spark):
    assert values(spark, text.extract_answer, ANSWERS) == list(ANSWERS.values())


def test_normalize_number(spark):
    cases = {"18%": None, "1,024": "1024", "18.0": "18", "18.5": "18.5", "$3,000 dollars": "3000", "\t7 \n": "7", "1d": None, "nan": None, "1_0": "10", "+5": "5", "12 Boxes": "12"}
    assert values(spark, text.normalize_number, cases) == list(cases.values())
    assert values(spark, text.normalize_number, [None]) == [None]


def test_extract_final_answer(spark):
    cases = {"#### 18.0": "18.0", "so the answer = 1,5 x": "15", "a, b": "", "nothing": None}
    assert values(spark, text.extract_final_answer, cases) == list(cases.values())


def test_computations_and_steps(spark):
    rows = values(spark, text.extract_computations, ["John has <<3*4=12>> 12 apples", "<<3+4=7=7>>", "none"])
    assert [[tuple(p) for p in r] for r in rows] == [[("3*4", "12")], [("3+4=7", "7")], []]
    assert values(spark, text.solution_steps, ["He has <<3*4=12>>12 apples\n #### 5\n\n x "]) == [["He has = 1212 apples", "x"]]


def test_answers_match(spark):
    cases = [("7", "7", True), ("7", "7.0", True), (None, "7", False), ("7", None, False), ("Yes ", "yes", True), ("7", "yes", False), ("-0", "0", True)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, p string, g string, w boolean")
    assert [r[0] for r in df.orderBy("i").select(text.answers_match(F.col("p"), F.col("g"))).collect()] == [c[2] for c in cases]


def test_categories_over_fire(spark):
    cases = {"a team of reachers": ("time", ["am"]), "coffee for 3": ("monetary", ["fee"]), "multiple taxis": ("percentage", ["tax", "tip"]), "": ("arithmetic", [])}
    assert values(spark, classify.category_type, cases) == [c for c, _ in cases.values()]
    assert values(spark, classify.keyword_hits, cases) == [k for _, k in cases.values()]


def test_operation_counts(spark):
    cases = {"3+4": "none", "3 + 4": "addition", "add": "none", "adds": "addition", "division": "none", "newspaper super paper per": "division", "unless": "subtraction", "well-known - x": "subtraction", "adds minus": "mixed"}
    assert values(spark, classify.main_operation, cases) == list(cases.values())


def test_complexity_and_richness(spark):
    assert values(spark, classify.number_mentions, ["1 and 2.5, x3 4x"]) == [2]
    assert values(spark, classify.richness, ["Add 17 and 40, now double it.", "A crew works 17 hours and 40 hours more. How long is that?", "x" * 201, "x" * 600]) == [0.245, 0.59, 0.3493, 0.14]
    df = spark.createDataFrame([("1 2 3 4 5 6", None), ("1", ""), ("1", "1 + 2\n3 * 4\nx")], "q string, s string")
    assert [r[0] for r in df.select(classify.estimated_steps(F.col("q"), F.col("s"))).collect()] == [3, 1, 2]


GOLD = [("3*5", "15"), ("15-4", "11")]
TRACES = [
    ("He buys 3 * 5 = 15 pens.\nHe loses four: 15 - 4 = 11\n#### 11", GOLD, 1, 1, 1, 1, "11", "good"),
    ("He buys 3 * 5 = 15 pens.\nHe loses four: 15 - 4 = 11\n#### 12", GOLD, 1, 1, 1, 1, "12", "medium"),
    ("He buys 3 * 5 = 16 pens.\nThen 16 - 4 = 12 remain here\n#### 12", GOLD, 0.3, 0, 1, 0.37, "12", "bad"),
    ("He buys 3 * 5 = 15 pens.\nHe buys 3 * 5 = 15 pens!\nHe loses four: 15 - 4 = 11\n#### 11", GOLD, 1, 1, 0.6667, 0.9167, "11", "good"),
    ("#### 11", GOLD, 0.5, 0.5, 0.8, 0.575, "11", "medium"),
    ("no numbers at all", GOLD, 0, 0, 0.8, 0.2, None, "bad"),
    ("3 / 0 = 5\n#### 11", GOLD, 0.8, 0.5, 0.8, 0.695, "11", "good"),
    ("We add.\nThen done\n#### 11", [], 0.4, 0.5, 1, 0.585, "11", "medium"),
]


def test_evaluation(spark):
    from tracekiln.operators.records import evaluated

    df = spark.createDataFrame([(i, t, "11", g) for i, (t, g, *_) in enumerate(TRACES)], "i int, trace string, clean_answer string, computations array<struct<expr: string, result: string>>")
    got = evaluated(df).orderBy("i").select("validity", "execution", "redundancy", "rex_score", "pred_answer", "category").collect()
    assert [tuple(r) for r in got] == [t[2:] for t in TRACES]


def test_equations(spark):
    cases = {"10-3-2=5": [("-3", "-", "2", "5", False)], "2+3+4=9": [("3", "+", "4", "9", False)], "3 * 4 = 12.": [("3", "*", "4", "12", True)], "$3 * 4 = $12": [], "50% * 4 = 2": [], "5/0=1": [("5", "/", "0", "1", True)]}
    found = values(spark, lambda x: F.transform(quality.equations(x), lambda e: F.struct(e["a"], e["op"], e["b"], e["c"], quality.equation_holds(e))), cases)
    assert [[tuple(e) for e in r] for r in found] == list(cases.values())


@pytest.mark.parametrize(("ok", "score", "want"), [(True, "0.65", "good"), (True, "0.6499", "medium"), (True, "0.35", "medium"), (True, "0.3499", "bad"), (False, "0.65", "medium"), (False, "0.6499", "bad")])
def test_labels(spark, ok, score, want):
    assert spark.range(1).select(quality.label(F.lit(ok), F.lit(score).cast("decimal(5,4)"))).first()[0] == want


def _distance(a: str, b: str) -> float:
    if max(len(a), len(b)) > 200:
        x, y = set(a.lower().split()), set(b.lower().split())
        return 1 - len(x & y) / len(x | y)
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1] / max(len(a), len(b))


def test_redundant_steps_like_brute_force(spark):
    r = random.Random(3)
    docs = []
    for _ in range(40):
        base = ["".join(r.choice("abé ") for _ in range(r.randint(3, 30))).strip() or "a" for _ in range(4)] + [" ".join(r.choice(["un", "deux", "trois", "vier"]) + str(r.randrange(30)) for _ in range(60))]
        lines = [r.choice(base) for _ in range(r.randint(0, 6))]
        docs.append([x[:-1] + "z" if r.random() < 0.5 else x for x in lines])
    want = [sum(any(_distance(x, y) < 0.3 for y in d[:i]) for i, x in enumerate(d)) for d in docs]
    assert values(spark, quality.redundant_steps, docs, "array<string>") == want


def test_tenths_are_not_redundant(spark):
    assert values(spark, quality.redundant_steps, [["abcdefghij", "abcdefgxyz"], ["abcdefghij", "abcdefghyz"]], "array<string>") == [0, 1]


def test_votes(spark):
    cases = [["b", "a", "a", "b"], [None, "4", None], [None, None], []]
    assert values(spark, votes.majority_vote, cases, "array<string>") == ["b", "4", None, None]
    r = random.Random(5)
    rows = [(k, r.choice(["1", "2", "3", None]), i) for k in range(30) for i in range(r.randint(1, 8))]
    got = {x["k"]: x["vote"] for x in votes.vote_by(spark.createDataFrame(rows, "k int, a string, i int"), "k", "a", "i").collect()}
    for k in range(30):
        c = Counter(a for q, a, _ in rows if q == k and a is not None)
        assert got[k] == (c.most_common(1)[0][0] if c else None)


def test_whole_numbers_take_the_short_way_to_the_same_string(spark):
    cases = ["7", "007", "-0", "-5", "1,234", "5,", ",5", "1,,2", "-", ",", "0", "999999999999999", "1234567890123456", "-,5", "5\n", " 5", "٣"]
    assert values(spark, text.normalize_number, cases) == values(spark, text._any_number, cases)


def test_steps_on_both_sides_of_the_length_for_words(spark):
    long = " ".join(f"word{i}" for i in range(40))
    cases = [(["a b c d", "a b c d"], 1), ([long, long + " more"], 1), (["a b c d", "a b c d", long, long + "!", ""], 2), ([long], 0), ([], 0)]
    got = values(spark, quality.redundant_steps, [c for c, _ in cases], "array<string>")
    assert got == [n for _, n in cases]
