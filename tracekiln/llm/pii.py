r"""Operator 4: personal data by boosted trees over candidate spans.

High-recall generators propose overlapping spans in what base spans leave: the
longest ones, and those of numbers and accounts from every start of a token to
every end of one. Each candidate is described by
its format (digits, separators, lengths, checks) and by the words before it, and
scored by gradient-boosted trees; a threshold for each kind, calibrated on
held-out examples of formats that the trees were not fitted on, selects what is
redacted beside the base spans. Among selected candidates that overlap, the better
score stays; base spans always stay.

The trees are trained here, on the driver, from ``EXAMPLES`` examples drawn from
templates with a fixed seed: what does the model good is format and context, and
the corpus has no labelled spans. The model is a few thousand numbers.

Defined cases: a null or empty text has no spans; ``base_sha256`` is then that of
the empty string. Positions count code points, ends are exclusive. Base matches
of one kind do not overlap; those of different kinds may. Repeated rows give
equal rows; an empty table gives no rows; other columns are ignored. Texts are
scanned whole, of any length, in time that grows with their length: expressions
that begin with a run are tried where a run begins, or back from the sign they need.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracekiln.llm.common import batches, trimmed
from tracekiln.llm.secret_scan import joined, replaced, utf8

#: How many template examples the trees are fitted on, and as many of other templates calibrate the thresholds.
EXAMPLES = 4000
#: Part of the selected held-out examples that must be personal.
PRECISION = 0.95

Span = tuple[int, int]
Finder = Callable[[str, int, int], Iterator[Span]]


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    """Whether the check digits of an account number hold."""
    plain = text.replace(" ", "")
    return len(plain) >= 15 and plain.isascii() and plain.isalnum() and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _ip(span: str) -> bool:
    parts = [p.lstrip("0") for p in span.split(".")]
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def _card(span: str) -> bool:
    d = digits_of(span)
    return 12 <= len(d) <= 19 and luhn(d)


def _phone(span: str) -> bool:
    return 9 <= len(digits_of(span)) <= 15


_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"


def matches(pattern: str) -> Finder:
    """The matches of an expression that does not begin with a run, or not inside one."""
    compiled = re.compile(pattern)

    def found(text: str, first: int, last: int) -> Iterator[Span]:
        return (m.span() for m in compiled.finditer(text, first, last))

    return found


def addresses(mark: str, domain: str) -> Finder:
    """Matches of a run of ``[A-Za-z0-9._%+-]``, a mark and a domain: the run is looked for back from the mark."""
    marks, domains = re.compile(mark), re.compile(domain)

    def found(text: str, first: int, last: int) -> Iterator[Span]:
        low = first
        for m in marks.finditer(text, first, last):
            if m.start() < low:
                continue
            run = text[low : m.start()]
            start = low + len(run.rstrip(_LOCAL))
            low = m.start()
            if start < m.start() and (end := domains.match(text, m.end(), last)):
                low = end.end()
                yield start, low

    return found


BASE: tuple[tuple[str, Finder, Callable[[str], bool]], ...] = (
    ("email", addresses("@", r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda span: True),
    ("ip", matches(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), _ip),
    ("card", matches(r"[0-9]([\x20-]?[0-9])+"), _card),
    ("phone", matches(r"\+[0-9][\x20().0-9-]+[0-9]"), _phone),
)
_NUMBER = r"\(?[0-9][0-9()/.\x20-]{5,24}[0-9]"
_PARTS = r"[0-9]{2,5}(?:[-/.\x20][0-9]{2,5}){1,4}"
_ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Generators of candidates. They overlap and take in much that is not personal.
CANDIDATES: tuple[tuple[str, Finder], ...] = (
    ("contact", addresses(r"\x20?(?:\[at\]|\(at\)|@)\x20?", r"[A-Za-z0-9-]+(?:\x20?(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z0-9-]+)+")),
    ("contact", addresses(r"\x20(?:at|\[at\]|\(at\))\x20", r"[A-Za-z0-9-]+(?:\x20dot\x20[A-Za-z0-9-]+)+")),
    ("number", matches(_NUMBER)),
    ("number", matches(_PARTS)),
    ("network", matches(rf"(?<![A-Za-z0-9:])(?:(?:{_HEX}:){{3,7}}{_HEX}|(?:[0-9A-Fa-f]{{2}}[:-]){{5}}[0-9A-Fa-f]{{2}})(?![A-Za-z0-9:])")),
    ("network", matches(rf"(?<![A-Za-z0-9:])(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?(?![A-Za-z0-9:])")),
    ("account", matches(_ACCOUNT)),
)
#: Kinds that are also asked for each span between a start and an end of tokens: start, end, expressions, most code points.
TOKENS = {
    "number": (re.compile(r"(?<![0-9A-Za-z().-])[(0-9]"), re.compile(r"[0-9](?![0-9A-Za-z()-]|\.[0-9])"), (re.compile(_NUMBER), re.compile(_PARTS)), 29),
    "account": (re.compile(r"(?<![A-Za-z0-9])[A-Z](?=[A-Z][0-9]{2})"), re.compile(r"[A-Z0-9](?![A-Za-z0-9])"), (re.compile(_ACCOUNT),), 44),
}
KINDS = [k for k, _, _ in BASE] + ["contact", "number", "network", "account"]
ADDED = KINDS[len(BASE) :]

#: Words before a span that speak for, or against, personal data.
FOR = ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "whatsapp", "ssn", "social", "security", "passport", "iban", "account", "email", "mail", "contact", "reach", "mac", "address", "born", "patient", "licence", "insurance", "host", "device", "taxpayer", "identity")
AGAINST = ("version", "order", "invoice", "isbn", "page", "pages", "total", "price", "year", "years", "figure", "table", "section", "chapter", "item", "sku", "serial", "build", "release", "score", "ratio", "id", "no", "costs", "population", "distance")
WORD = re.compile(r"[a-z]+")
_GROUP = re.compile(r"[0-9]+")


def features(kind: str, span: str, before: str) -> list[float]:
    """Format and context of a candidate."""
    d = digits_of(span)
    words = WORD.findall(before.lower())[-4:]
    sizes = [len(g) for g in _GROUP.findall(span)] or [0]
    return [
        float(ADDED.index(kind)),
        len(span),
        len(d),
        len(d) / len(span),
        len(sizes),
        sizes[0],
        sizes[-1],
        max(sizes),
        span.count("-"),
        span.count(" "),
        span.count("."),
        span.count("/"),
        span.count("(") + span.count("["),
        span.count(":"),
        float("::" in span),
        sum(c.isupper() for c in span),
        float(luhn(d)) if d else 0.0,
        float(kind == "account" and iban(span)),
        float(bool(re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", span))),
        float(bool(re.match(r"(19|20)[0-9]{2}[-/. ]|.*[-/. ](19|20)[0-9]{2}$", span))),
        float(bool(re.fullmatch(r"\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}", span))),
        float(span[0] == "0"),
        float(sum(w in FOR for w in words)),
        float(bool(words) and words[-1] in FOR),
        float(sum(w in AGAINST for w in words)),
        float("[at]" in span or "(at)" in span or " at " in span),
        float(" dot " in span or "dot]" in span or "dot)" in span),
    ]


class Trees:
    """Gradient-boosted trees for a yes or no, logistic loss, exact splits on quantile bins."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 16):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.prior = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
        score, self.trees = np.full(len(y), self.prior), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            nodes: list[tuple] = []
            self._grow(binned, y - p, p * (1 - p), np.arange(len(y)), self.depth, nodes, score)
            self.trees.append(nodes)
        return self

    def _grow(self, binned, g, h, rows, depth, nodes, score) -> int:
        """Adds a node (feature, cut, left, right, value) and its subtree; leaves move the scores."""
        me = len(nodes)
        nodes.append(None)
        best = (1e-3, -1, 0)
        whole = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        for f in range(binned.shape[1]) if depth else ():
            sums_g = np.bincount(binned[rows, f], g[rows], minlength=self.bins + 1).cumsum()
            sums_h = np.bincount(binned[rows, f], h[rows], minlength=self.bins + 1).cumsum()
            gain = sums_g**2 / (sums_h + 1.0) + (sums_g[-1] - sums_g) ** 2 / (sums_h[-1] - sums_h + 1.0) - whole
            k = int(gain[: len(self.cuts[f])].argmax()) if len(self.cuts[f]) else 0
            if len(self.cuts[f]) and gain[k] > best[0]:
                best = (float(gain[k]), f, k)
        if best[1] < 0:
            value = self.rate * g[rows].sum() / (h[rows].sum() + 1.0)
            score[rows] += value
            nodes[me] = (-1, 0.0, 0, 0, float(value))
            return me
        _, f, k = best
        left = binned[rows, f] <= k
        a = self._grow(binned, g, h, rows[left], depth - 1, nodes, score)
        b = self._grow(binned, g, h, rows[~left], depth - 1, nodes, score)
        nodes[me] = (f, float(self.cuts[f][k]), a, b, 0.0)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for rows of features: all trees are gone down at once."""
        most = max(map(len, self.trees))
        nodes = np.zeros((len(self.trees), most, 5))
        for k, tree in enumerate(self.trees):
            nodes[k, : len(tree)] = tree
        out = np.zeros(len(x))
        tree = np.arange(len(self.trees))[None, :]
        for a in range(0, len(x), 4096):
            rows = x[a : a + 4096]
            at = np.zeros((len(rows), len(self.trees)), dtype=np.int64)
            for _ in range(self.depth):
                feature, cut, left, right, _value = (nodes[tree, at, c] for c in range(5))
                value = rows[np.arange(len(rows))[:, None], np.maximum(feature, 0).astype(np.int64)]
                at = np.where(feature < 0, at, np.where(value <= cut, left, right)).astype(np.int64)
            out[a : a + 4096] = 1 / (1 + np.exp(-(self.prior + nodes[tree, at, 4].sum(axis=1))))
        return out


def templates(r: random.Random, held: bool) -> tuple[list, list]:
    """(kind, maker) of personal and of other spans; those for calibration (``held``) have formats of their own."""
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghinorstu") for _ in range(r.randint(2, 9)))
    upper = lambda k: "".join(r.choice("ABCDEFGHKLMNPRSTUVWXYZ") for _ in range(k))
    top = lambda: r.choice(["com", "org", "net", "de", "io"])

    def account(country: str, bank: str, step: int) -> str:
        check = 98 - int("".join(str(int(c, 36)) for c in f"{bank}{country}00")) % 97
        plain = f"{country}{check:02}{bank}"
        return plain if not step else " ".join(plain[k : k + step] for k in range(0, len(plain), step))

    def spoiled(plain: str) -> str:
        return plain[:2] + f"{(int(plain[2:4]) + r.randint(1, 40)) % 97:02}" + plain[4:]

    if not held:
        yes = [
            ("number", lambda: f"({num(3)}) {num(3)}-{num(4)}"),
            ("number", lambda: f"{num(3)}{(s := r.choice('-. '))}{num(3)}{s}{num(4)}"),
            ("number", lambda: f"0{num(3)} {num(3)} {num(4)}"),
            ("number", lambda: f"0{num(r.randint(2, 4))}{r.choice(' -/')}{num(r.randint(6, 8))}"),
            ("number", lambda: f"{num(3)}-{num(2)}-{num(4)}"),
            ("number", lambda: num(r.randint(8, 10))),
            ("contact", lambda: f"{word()}.{word()} {r.choice(['[at]', '(at)'])} {word()} {r.choice(['[dot]', '(dot)', '.'])} {top()}"),
            ("contact", lambda: f"{word()} at {word()} dot {top()}"),
            ("network", lambda: ":".join("%02x" % r.randrange(256) for _ in range(6))),
            ("network", lambda: ":".join("%x" % r.randrange(65536) for _ in range(8))),
            ("network", lambda: f"fe80::{r.randrange(65536):x}:{r.randrange(65536):x}"),
            ("network", lambda: f"2001:db8::{r.randrange(65536):x}"),
            ("account", lambda: account("DE", num(18), r.choice([0, 4]))),
            ("account", lambda: account("ES", num(20), 4)),
            ("account", lambda: account("NL", upper(4) + num(10), 0)),
        ]
        no = [
            ("number", lambda: f"{r.choice(['19', '20'])}{num(2)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}"),
            ("number", lambda: f"{r.randint(1, 28):02}/{r.randint(1, 12):02}/20{num(2)}"),
            ("number", lambda: num(r.randint(7, 20))),
            ("number", lambda: " ".join(num(r.randint(1, 5)) for _ in range(r.randint(2, 7)))),
            ("number", lambda: ".".join(str(r.randrange(40)) for _ in range(r.randint(3, 5)))),
            ("number", lambda: f"{num(3)}-{num(1)}-{num(2)}-{num(6)}-{num(1)}"),
            ("number", lambda: f"{num(4)}-{num(4)}"),
            ("number", lambda: f"20{num(2)}-20{num(2)}"),
            ("number", lambda: f"{num(2)}-{num(2)}"),
            ("number", lambda: f"{num(3)}) {num(3)}-{num(4)}"[r.randint(1, 3) :]),
            ("number", lambda: f"{num(3)}-{num(4)}"),
            ("contact", lambda: f"{word()}@{word()}.{word()}"[: r.randint(6, 30)] + "." + word()),
            ("network", lambda: ":".join(num(2) for _ in range(r.randint(4, 5)))),
            ("network", lambda: f"{r.choice('abcdef')}::{r.choice(['a', 'add', 'bad', 'c', 'dead'])}"),
            ("account", lambda: f"{upper(2)}{num(2)} {upper(4)} {upper(4)}"),
            ("account", lambda: f"{upper(2)}{num(2)}{upper(4)}{num(4)}"),
            ("account", lambda: spoiled(account("DE", num(18), 0))),
        ]
        return yes, no
    yes = [
        ("number", lambda: f"{num(3)}/{num(3)}-{num(4)}"),
        ("number", lambda: f"0{num(4)} {num(6)}"),
        ("number", lambda: f"({num(3)}){num(3)}-{num(4)}"),
        ("number", lambda: f"0{num(2)} {num(3)} {num(2)} {num(2)}"),
        ("number", lambda: num(9)),
        ("contact", lambda: f"{word()} (at) {word()} (dot) {top()}"),
        ("contact", lambda: f"{word()}_{num(2)} at {word()} dot co dot {top()}"),
        ("network", lambda: "-".join("%02x" % r.randrange(256) for _ in range(6))),
        ("network", lambda: f"fe80::{r.randrange(1, 65536):x}"),
        ("account", lambda: account("GB", upper(4) + num(14), r.choice([0, 4]))),
        ("account", lambda: account("FR", num(23), 4)),
    ]
    no = [
        ("number", lambda: f"{num(2)}.{num(3)}.{num(3)}"),
        ("number", lambda: f"{r.randint(1, 28):02}.{r.randint(1, 12):02}.19{num(2)}"),
        ("number", lambda: f"{num(5)} {num(5)}"),
        ("number", lambda: f"{num(1)}-{num(3)}-{num(5)}-{num(1)}"),
        ("number", lambda: num(r.randint(11, 18))),
        ("contact", lambda: f"{word()} @ {word()}.{word()}"),
        ("network", lambda: f"{num(2)}:{num(2)}:{num(2)}:{num(2)}"),
        ("network", lambda: f"{r.choice(['ace', 'bed', 'cab', 'dad'])}::{r.choice(['b', 'fade', 'face'])}"),
        ("account", lambda: f"{upper(2)}{num(2)} {num(4)} {upper(4)}"),
        ("account", lambda: spoiled(account("GB", upper(4) + num(14), 0))),
    ]
    return yes, no


def examples(n: int, seed: int, held: bool = False) -> list[tuple[str, str, str, bool]]:
    """(kind, span, text before, personal) from templates."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghinorstu") for _ in range(r.randint(2, 9)))
    yes, no = templates(r, held)
    out = []
    for _ in range(n):
        personal = r.random() < 0.5
        kind, make = r.choice(yes if personal else no)
        span = make()
        cue = r.random()
        hints, others = (FOR, AGAINST) if personal else (AGAINST, FOR)
        # Digits alone are personal by what is said before them; for others it only helps.
        sure = span.isdigit() and personal or cue < 0.6
        said = [word() for _ in range(3)] + ([r.choice(hints)] if sure else [r.choice(others)] if cue > 0.97 and not span.isdigit() else [word()])
        out.append((kind, span, " ".join(said) + r.choice([" ", ": ", " is "]), personal))
    return out


@functools.cache
def trained(n: int = EXAMPLES) -> tuple[Trees, dict[str, float]]:
    """The trees, and for each kind the least score above which held-out examples are personal often enough."""
    given, held = examples(n, 1), examples(n, 2, held=True)
    trees = Trees().fit(np.array([features(k, s, b) for k, s, b, _ in given]), np.array([float(p) for *_, p in given]))
    scores = trees.predict(np.array([features(k, s, b) for k, s, b, _ in held])).tolist()
    least = {}
    for kind in ADDED:
        scored = sorted(((score, p) for score, (k, *_, p) in zip(scores, held, strict=True) if k == kind), reverse=True)
        right, least[kind] = 0, 1.1
        for i, (score, personal) in enumerate(scored, 1):
            right += personal
            if right >= PRECISION * i and (i == len(scored) or scored[i][0] < score):
                least[kind] = score
    return trees, least


def base_spans(text: str) -> list[tuple[int, int, int]]:
    return sorted((a, k, b) for k, (_, find, holds) in enumerate(BASE) for a, b in find(text, 0, len(text)) if holds(text[a:b]))


def free_parts(found: list[tuple[int, int, int]], size: int) -> list[Span]:
    """What is left between the spans, which stand in order."""
    out, at = [], 0
    for a, _, b in found:
        if a > at:
            out.append((at, a))
        at = max(at, b)
    return [*out, (at, size)] if size > at else out


def proposed(text: str, parts: list[Span]) -> set[tuple[str, int, int]]:
    """(kind, start, end) of all candidates within ``parts``."""
    out = set()
    for first, last in parts:
        for kind, find in CANDIDATES:
            out.update((kind, a, b) for a, b in find(text, first, last))
        for kind, (begins, stops, patterns, most) in TOKENS.items():
            ends = None
            low = 0
            for m in begins.finditer(text, first, last):
                if ends is None:
                    ends = [x.end() for x in stops.finditer(text, first, last)]
                a = m.start()
                while low < len(ends) and ends[low] <= a:
                    low += 1
                for pattern in patterns:
                    longest = pattern.match(text, a, min(last, a + most))
                    for k in range(low, len(ends)):
                        b = ends[k]
                        if longest is None or b > longest.end():
                            break
                        if pattern.fullmatch(text, a, b):
                            out.add((kind, a, b))
    return out


def all_spans(texts: list[str], trees: Trees, least: dict[str, float]) -> list[list[tuple[int, int, int]]]:
    """For each text (start, number of the kind, end): base spans and selected candidates, in order."""
    found = [base_spans(t) for t in texts]
    seen: dict[tuple[str, str, str], int] = {}
    asked = []
    for i, text in enumerate(texts):
        for kind, a, b in proposed(text, free_parts(found[i], len(text))):
            asked.append((i, kind, a, b, seen.setdefault((kind, text[a:b], text[max(0, a - 40) : a]), len(seen))))
    if not asked:
        return found
    scores = trees.predict(np.array([features(*x) for x in seen])).tolist()
    chosen: dict[int, list] = {}
    for i, kind, a, b, k in asked:
        if scores[k] >= least[kind]:
            chosen.setdefault(i, []).append((-scores[k], a - b, a, KINDS.index(kind), b))
    for i, candidates in chosen.items():
        taken = bytearray(len(texts[i]))
        for a, _, b in found[i]:
            taken[a:b] = b"\x01" * (b - a)
        for _, _, a, k, b in sorted(set(candidates)):
            if 1 not in taken[a:b]:
                taken[a:b] = b"\x01" * (b - a)
                found[i].append((a, k, b))
        found[i].sort()
    return found


def spans_of(text: str, trees: Trees, least: dict[str, float]) -> list[tuple[int, int, int]]:
    return all_spans([text], trees, least)[0]


#: What every expression needs one of: a digit, or a sign. ``network`` has colons or dashes, ``contact`` a mark or " at ".
_NEEDED = np.zeros(256, dtype=bool)
_NEEDED[[*range(48, 58), *b"@[(:-"]] = True


def worth_a_look(data: np.ndarray, offsets: np.ndarray, column: pa.Array) -> np.ndarray:
    """Texts that any expression could match: with a digit, or a sign or word that the others need."""
    hit = pa.compute.match_substring(column, " at ").to_numpy(zero_copy_only=False).copy()
    at = np.flatnonzero(_NEEDED[data])
    hit[np.searchsorted(offsets, at, side="right") - 1] = True
    return np.flatnonzero(hit)


def _found(source: Iterator[pa.RecordBatch], model) -> Iterator[tuple[pa.RecordBatch, dict[int, tuple[str, list]]]]:
    trees, least = model
    for batch in batches(source, most_bytes=2_000_000):
        data, offsets, column = utf8(batch.column("text"))
        chosen = worth_a_look(data, offsets, column).tolist()
        texts = [column[i].as_py() for i in chosen]
        yield batch, {i: (t, x) for i, t, x in zip(chosen, texts, all_spans(texts, trees, least), strict=True) if x}


def personal(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans."""
    model = trained()
    base = len(BASE)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _found(source, model):
            rows = [found[i][1] if i in found else [] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    *[pa.array([sum(x[1] == k for x in r) for r in rows], pa.int64()) for k in range(base)],
                    pa.array([hashlib.sha256(joined([x for x in r if x[1] < base], KINDS).encode()).hexdigest() for r in rows], pa.string()),
                    pa.array([joined(r, KINDS) for r in rows], pa.string()),
                    pa.array([len(r) for r in rows], pa.int64()),
                ],
                names=["doc_id", *[f"n_{k}" for k in KINDS[:base]], "base_sha256", "spans", "n_spans"],
            )

    counts = ", ".join(f"n_{k} long" for k in KINDS[:base])
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id long, {counts}, base_sha256 string, spans string, n_spans long")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced by ``<kind>``; other columns as they are."""
    model = trained()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _found(source, model):
            place = batch.schema.get_field_index("text")
            texts = batch.column(place).to_pylist()
            for i, (text, spans) in found.items():
                texts[i] = replaced(text, [(a, b, KINDS[k]) for a, k, b in spans])
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return docs.mapInArrow(trimmed(run), docs.schema)
