r"""Operator 3: secret scans with a trigram inverted index.

A Boolean query over trigrams is derived from each rule's regular expression: an
AND of what must follow one another, an OR of alternatives. For each block of
texts, postings (trigram to texts) are made for the trigrams that the queries
name, and intersected and united as a query says; the rule's expression then
verifies the texts that are left. A rule without a mandatory trigram is scanned
over every text: where it is a run of some characters of a least length, the runs
are found from one array of all bytes.

Defined cases: a null or empty text has no spans; ``base_sha256`` is then that of
the empty string. Positions count code points, ends are exclusive. Matches of one
rule do not overlap; those of different rules may. Repeated rows give equal rows;
other columns are ignored. Texts are scanned whole, of any length.
"""

from __future__ import annotations

import hashlib
import re
import re._parser as parser
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracekiln.llm.common import batches


@dataclass(frozen=True)
class Rule:
    """``group`` must have ``least`` characters, or the match is dropped. ``run``: the class of bytes of a rule that is one run of them."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    run: str = ""


BASE = (
    Rule("assign", r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32, "0123456789abcdef"),
)
MORE = (
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("bearer", r"(?ai:authorization):\x20*(?ai:bearer)\x20+[A-Za-z0-9._~+/-]{20,}=*"),
    Rule("private_key", r"-----BEGIN[A-Z\x20]*PRIVATE KEY-----"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]+:[^\s:/@]+@"),
)
RULES = BASE + MORE

#: A set of literal strings is expanded up to this size while a query is derived.
EXPAND = 64


def _exact(items) -> set[str] | None:
    """All strings that a parsed pattern matches, lower case, if they are few."""
    out = {""}
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            part = {chr(arg).lower()}
        elif name == "IN" and all(str(x) == "LITERAL" for x, _ in arg):
            part = {chr(x).lower() for _, x in arg}
        elif name == "SUBPATTERN":
            part = _exact(arg[3])
        elif name == "BRANCH":
            each = [_exact(x) for x in arg[1]]
            part = None if None in each else set().union(*each)
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] <= 8 and (inner := _exact(arg[2])) is not None:
            part = {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(inner, repeat=n)} if len(inner) ** arg[1] <= EXPAND else None
        else:
            part = None
        if part is None or len(out) * len(part) > EXPAND:
            return None
        out = {a + b for a in out for b in part}
    return out


def trigrams(text: str) -> list[bytes]:
    raw = text.encode()
    return [raw[i : i + 3] for i in range(len(raw) - 2)]


def _one_of(strings: set[str]):
    """OR over strings of AND over their trigrams; None if one of them is too short to tell."""
    if any(len(s.encode()) < 3 for s in strings):
        return None
    return ("or", [("and", trigrams(s)) for s in sorted(strings)])


def query_of(pattern: str):
    """The Boolean trigram query of a pattern, over lower-cased text; None if nothing is mandatory."""

    def derive(items) -> list:
        needs, run = [], {""}
        for item in items:
            part = _exact([item])
            if part is not None and len(run) * len(part) <= EXPAND:
                run = {a + b for a in run for b in part}
                continue
            needs.append(_one_of(run))
            run = {""} if part is None else part
            op, arg = str(item[0]), item[1]
            if part is not None:
                continue
            if op == "SUBPATTERN":
                needs += derive(arg[3])
            elif op in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
                needs += derive(arg[2])
            elif op == "BRANCH":
                each = [derive(x) for x in arg[1]]
                needs.append(("or", [("and", x) for x in each]) if all(any(y is not None for y in x) for x in each) else None)
        needs.append(_one_of(run))
        return needs

    needs = [x for x in derive(parser.parse(pattern)) if x is not None]
    return ("and", needs) if needs else None


def named(query) -> set[bytes]:
    return {query} if isinstance(query, bytes) else {t for x in query[1] if x is not None for t in named(x)}


def answered(query, postings: dict[bytes, np.ndarray]) -> np.ndarray:
    """The texts that fulfil a query: postings intersected and united."""
    if isinstance(query, bytes):
        return postings[query]
    parts = [answered(x, postings) for x in query[1] if x is not None]
    return (np.logical_and if query[0] == "and" else np.logical_or).reduce(parts)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Index:
    """Postings of a block of texts for the trigrams that some queries name."""

    def __init__(self, queries: list):
        self.grams = sorted({t for q in queries if q is not None for t in named(q)})
        self.table = np.zeros(1 << 24, dtype=np.uint16 if len(self.grams) < 1 << 16 else np.uint32)
        for k, t in enumerate(self.grams):
            self.table[t[0] << 16 | t[1] << 8 | t[2]] = k + 1

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> dict[bytes, np.ndarray]:
        texts = len(offsets) - 1
        held = np.zeros((len(self.grams) + 1, texts), dtype=bool)
        if len(data) >= 3:
            low = _LOWER[data].astype(np.int32)
            which = self.table[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
            at = np.flatnonzero(which)
            text = np.searchsorted(offsets, at, side="right") - 1
            inside = at + 2 < offsets[text + 1]
            held[which[at[inside]], text[inside]] = True
        return {t: held[k + 1] for k, t in enumerate(self.grams)}


def long_runs(data: np.ndarray, offsets: np.ndarray, members: np.ndarray, least: int) -> np.ndarray:
    """Which texts have a run of at least so many bytes of a class."""
    out = np.zeros(len(offsets) - 1, dtype=bool)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = members[data]
    edges = np.flatnonzero(np.diff(inside))
    begin, end = edges[::2], edges[1::2]
    long = end - begin >= least
    # A run may go on from one text into the next: all texts that it touches are verified.
    for a, b in zip(begin[long], end[long], strict=True):
        out[np.searchsorted(offsets, a, side="right") - 1 : np.searchsorted(offsets, b - 1, side="right")] = True
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(all bytes, offsets, the column) of a column of strings; null is empty."""
    column = pa.compute.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(column) else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0], column


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.compiled = [re.compile(r.pattern) for r in rules]
        self.queries = [query_of(r.pattern) for r in rules]
        self.index = Index(self.queries)
        self.members = [np.isin(np.arange(256), [ord(c) for c in r.run]).astype(np.int8) if r.run else None for r in rules]

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """For each rule the numbers of the texts to verify."""
        postings = self.index.postings(data, offsets)
        out = []
        for rule, query, members in zip(self.rules, self.queries, self.members, strict=True):
            if query is not None:
                out.append(np.flatnonzero(answered(query, postings)))
            elif members is not None:
                out.append(np.flatnonzero(long_runs(data, offsets, members, rule.least)))
            else:
                out.append(np.arange(len(offsets) - 1))
        return out

    def spans(self, batch: pa.RecordBatch) -> dict[int, list[tuple[int, int, int]]]:
        """(start, number of the rule, end) by text, in order; texts without a span are absent."""
        data, offsets, column = utf8(batch.column("text"))
        found: dict[int, list[tuple[int, int, int]]] = {}
        texts: dict[int, str] = {}
        for k, chosen in enumerate(self.candidates(data, offsets)):
            rule = self.rules[k]
            for i in chosen.tolist():
                text = texts.get(i)
                if text is None:
                    text = texts[i] = column[i].as_py()
                for m in self.compiled[k].finditer(text):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found.setdefault(i, []).append((m.start(), k, m.end()))
        for x in found.values():
            x.sort()
        return found


def joined(spans: list[tuple[int, int, int]], kinds: list[str]) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> DataFrame:
    """One row a document: doc_id, n_<kind> of each base rule, base_sha256, spans."""
    kinds = [r.kind for r in rules]
    schema = "doc_id long, " + ", ".join(f"n_{x} long" for x in kinds[:base]) + ", base_sha256 string, spans string"

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches(source, most_bytes=2_000_000):
            found = scanner.spans(batch)
            rows = [found.get(i, []) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    *[pa.array([sum(x[1] == k for x in r) for r in rows], pa.int64()) for k in range(base)],
                    pa.array([hashlib.sha256(joined([x for x in r if x[1] < base], kinds).encode()).hexdigest() for r in rows], pa.string()),
                    pa.array([joined(r, kinds) for r in rows], pa.string()),
                ],
                names=["doc_id", *[f"n_{x}" for x in kinds[:base]], "base_sha256", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each span of a secret replaced by ``<kind>``, other columns as they are."""
    kinds = [r.kind for r in rules]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches(source, most_bytes=2_000_000):
            texts = batch.column("text").to_pylist()
            for i, spans in scanner.spans(batch).items():
                texts[i] = replaced(texts[i], [(a, b, kinds[k]) for a, k, b in spans])
            place = batch.schema.get_field_index("text")
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Spans in order of start; those that overlap become one, named after the first."""
    out, upto = [], 0
    for a, b, kind in spans:
        if a >= upto:
            out += [text[upto:a], f"<{kind}>"]
        upto = max(upto, b)
    return "".join(out) + text[upto:]
