"""Generation: prompts through a text backend, votes over several sequences.

The model is the one part that runs in Python: a backend is a picklable object
whose ``open()`` is called once for each task and gives a function from a batch of
requests to lists of sequences.
"""

from __future__ import annotations

import hashlib
import logging
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracekiln.functions.text import extract_final_answer, word_count
from tracekiln.functions.votes import majority_vote, representative
from tracekiln.operators.neighbours import nearest
from tracekiln.plans.prompts import DYNAMIC, prompt, strategy_name

#: (prompt, temperature, number of sequences, number of new tokens)
Request = tuple[str, float, int, int]
#: For each request its sequences, and for a single one the tokens with their log probabilities, or None.
Answer = tuple[list[str], list[tuple[str, float]] | None]


class Backend(Protocol):
    def open(self) -> Callable[[list[Request]], list[Answer]]: ...


class StubBackend:
    """A backend without a model: a pure function of the last question in the prompt and the attempt.

    It adds the first two numbers of the question, or the first to the product of the
    next two where there are three, and errs on some attempts.
    """

    def __init__(self, wrong_of_8: int = 2, logprobs: bool = True):
        self.wrong_of_8, self.logprobs = wrong_of_8, logprobs

    def _one(self, text: str, attempt: int, temperature: float) -> str:
        question = text.rsplit("Question: ", 1)[-1].split("\n", 1)[0]
        numbers = [int(x) for x in re.findall(r"\d+", question)] or [0]
        off = int(hashlib.md5(f"{attempt}|{temperature:g}|{question}".encode()).digest()[0] % 8 < self.wrong_of_8)
        if len(numbers) < 3:
            total = sum(numbers) + off
            return f"First take {' + '.join(map(str, numbers))} = {total}\nSo that is all.\n#### {total}"
        a, b, c = numbers[:3]
        return f"First take {b} * {c} = {b * c}\nNext put {b * c} + {a} = {b * c + a + off}\n#### {b * c + a + off}"

    def open(self) -> Callable[[list[Request]], list[Answer]]:
        def run(requests: list[Request]) -> list[Answer]:
            out = []
            for text, temperature, n, most in requests:
                traces = [" ".join(self._one(text, k, temperature).split(" ")[:most]) for k in range(n)]
                out.append((traces, [(t, -0.5) for t in traces[0].split()] if self.logprobs and n == 1 else None))
            return out

        return run


class HuggingFaceBackend:
    """A causal model of the transformers library, loaded once for each task; needs torch on the executors.

    Prompts are cut to ``context`` tokens; sampling with top-p 0.95, greedy at temperatures of 0.01 and less.
    """

    def __init__(self, model: str, context: int = 1024, logprobs: bool = True):
        self.model, self.context, self.logprobs = model, context, logprobs

    def open(self) -> Callable[[list[Request]], list[Answer]]:
        try:
            import torch
            from transformers import AutoModelForCausalLM, AutoTokenizer
        except ImportError as e:
            raise RuntimeError("this backend needs torch and transformers on every executor") from e
        device = "cuda" if torch.cuda.is_available() else "cpu"
        words = AutoTokenizer.from_pretrained(self.model)
        model = AutoModelForCausalLM.from_pretrained(self.model).to(device).eval()

        def run(requests: list[Request]) -> list[Answer]:
            out = []
            for text, temperature, n, most in requests:
                given = words(text, return_tensors="pt", truncation=True, max_length=self.context).to(device)
                asked = self.logprobs and n == 1
                with torch.no_grad():
                    made = model.generate(
                        **given, max_new_tokens=most, num_return_sequences=n, do_sample=temperature > 0.01, temperature=max(temperature, 1e-4), top_p=0.95,
                        return_dict_in_generate=True, output_scores=asked, pad_token_id=words.eos_token_id,
                    )
                new = made.sequences[:, given["input_ids"].shape[1] :]
                pairs = None
                if asked:
                    pairs = [(words.decode([t]), float(torch.log_softmax(s[0], -1)[t])) for t, s in zip(new[0].tolist(), made.scores, strict=False)]
                out.append(([words.decode(x, skip_special_tokens=True) for x in new], pairs))
            return out

        return run


def prompted(problems: DataFrame, strategy: str | int, manual: DataFrame | None = None, near: DataFrame | None = None, fields: tuple[str, ...] = ("trace", "raw_answer")) -> DataFrame:
    """Adds strategy_id, prompt, temperature and num_return_sequences.

    ``manual``: strategy_id and an array ``examples`` (16 rows at most, sent to all);
    ``near``: the problem's id and an array ``near`` of retrieved examples, or None.
    """
    sid = F.col(strategy) if isinstance(strategy, str) else F.lit(strategy)
    rows = problems.withColumn("strategy_id", sid.cast("int"))
    kind = "array<struct<question: string, " + ", ".join(f"{f}: string" for f in fields) + ">>"
    rows = rows.join(F.broadcast(manual), "strategy_id", "left") if manual is not None else rows.withColumn("examples", F.lit(None).cast(kind))
    rows = rows.join(near, "original_index", "left") if near is not None else rows.withColumn("near", F.lit(None).cast(kind))
    have = F.coalesce("examples", F.array().cast(kind))
    near_of = F.when(F.col("strategy_id").isin(*DYNAMIC), F.col("near"))
    made = prompt(F.col("strategy_id"), F.col("question"), have, near_of, F.col("category_type"), F.col("complexity"), fields)
    return rows.withColumn("__p", made).select(*[c for c in rows.columns if c not in ("examples", "near")], "__p.*")


def manual_examples(chosen: DataFrame, fields: tuple[str, ...] = ("trace", "raw_answer")) -> DataFrame:
    """strategy_id and its examples in order, from the selection (at most 280 rows); fields that rows lack are null."""
    cells = [F.col(f).cast("string").alias(f) if f in chosen.columns else F.lit(None).cast("string").alias(f) for f in fields]
    ordered = F.array_sort(F.collect_list(F.struct("position", F.col("question"), *cells)))
    return chosen.groupBy("strategy_id").agg(F.transform(ordered, lambda e: F.struct(e["question"].alias("question"), *[e[f].alias(f) for f in fields])).alias("examples"))


def near_examples(problems: DataFrame, pool: DataFrame, k: int = 3, category: bool = True, fields: tuple[str, ...] = ("trace", "raw_answer")) -> DataFrame:
    """original_index and an array ``near`` of the k most similar examples of the pool, the best first.

    ``problems`` has original_index, embedding and category_type; ``pool`` has seq, embedding,
    category_type, question and the fields, of which those that it lacks are null.
    """
    asked = problems.select(F.col("original_index").alias("id"), "embedding", F.col("category_type").alias("category"))
    cells = [F.col(f).cast("string").alias(f) if f in pool.columns else F.lit(None).cast("string").alias(f) for f in fields]
    held = pool.select(F.col("seq").alias("id"), "embedding", F.col("category_type").alias("category"), F.struct("question", *cells).alias("example"))
    shown = nearest(asked, held, k, category, more=("example",))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "pool_id", "example")))
    return shown.groupBy(F.col("query_id").alias("original_index")).agg(F.transform(ordered, lambda e: e["example"]).alias("near"))


def answers(ask: Callable[[list[Request]], list[Answer]], requests: list[Request], skip_failures: bool) -> list[Answer]:
    """What the backend gives; with ``skip_failures`` a request that it raises for has no sequences."""
    try:
        return ask(requests)
    except Exception:
        if not skip_failures:
            raise
        if len(requests) > 1:
            return [x for r in requests for x in answers(ask, [r], True)]
        logging.getLogger(__name__).warning("a request failed and is skipped", exc_info=True)
        return [([], None)]


def sequences(prompts: DataFrame, backend: Backend, max_new_tokens: int = 512, skip_failures: bool = False) -> DataFrame:
    """Adds ``traces`` and ``token_logprobs`` from the backend, batch by batch; other columns pass through as they are."""
    more = StructType.fromDDL("traces array<string>, token_logprobs array<struct<token: string, logprob: double>>")
    schema = StructType([*prompts.schema.fields, *more.fields])
    types = to_arrow_schema(more)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = backend.open()
        for rows in source:
            columns = [rows.column(c).to_pylist() for c in ("prompt", "temperature", "num_return_sequences")]
            got = answers(ask, [(p, float(t), int(n), max_new_tokens) for p, t, n in zip(*columns, strict=True)], skip_failures)
            traces = [list(t) for t, _ in got]
            chances = [None if p is None else [{"token": a, "logprob": b} for a, b in p] for _, p in got]
            made = [pa.array(x, f.type) for x, f in zip((traces, chances), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *made], names=schema.names)

    return prompts.mapInArrow(run, schema)


def generated(prompts: DataFrame, backend: Backend, max_new_tokens: int = 512, skip_failures: bool = False) -> DataFrame:
    """Adds trace, answer, strategy_name, num_tokens, candidates and token_logprobs.

    Of several sequences the vote decides, and their log probabilities are dropped.
    """
    made = sequences(prompts, backend, max_new_tokens, skip_failures).withColumn("__answers", F.transform("traces", extract_final_answer))
    many = F.col("num_return_sequences") > 1
    made = made.withColumn("answer", F.when(many, majority_vote(F.col("__answers"))).otherwise(F.try_element_at("__answers", F.lit(1))))
    made = made.withColumn("trace", F.when(many, representative(F.col("traces"), F.col("__answers"), F.col("answer"))).otherwise(F.try_element_at("traces", F.lit(1))))
    return made.withColumns(
        {
            "strategy_name": strategy_name(F.col("strategy_id")),
            "num_tokens": word_count(F.col("trace")),
            "candidates": F.when(many, F.col("traces")).otherwise(F.array().cast("array<string>")),
            "token_logprobs": F.when(~many, F.col("token_logprobs")),
        }
    ).drop("traces", "__answers")
