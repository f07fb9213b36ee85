r"""Operator 7: byte-level BPE encoding and decoding.

Pre-tokenisation is vectorised over many texts at once: a table turns codepoints
into an array of classes, every class is a function on the states of a small
automaton, and an associative scan over those functions (composition is a table
look-up) gives the state before each codepoint, from which the boundaries
follow. No regular expression runs. Slices are hashed from prefix sums and looked
up in an array cache, which has every slice itself: a slice takes an entry's tokens
only if it is equal to it, codepoint by codepoint. Slices that are not there go
through pair merging. Offsets of slices and tokens are kept, and decoding goes
through them.

The automaton stands for the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+``.

Defined cases: a null text is the empty text; it has no ids, and the digests are
those of the empty string. Any text decodes to its own bytes. Repeated rows give
equal rows; other columns are ignored. A very long text is a batch of its own.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracekiln.llm.common import batches, large_cache

# Classes of codepoints; a quote is O unless a contraction follows it, and the
# last white space before a visible character is told apart.
O, L, N, SPACE, SPACE_LAST, WHITE, WHITE_LAST, QUOTE_1, QUOTE_2 = range(9)
# States: nothing open (a text or a contraction ended), in a run, after the one
# space that joins what follows, in white space, with 1 or 2 letters of a contraction to go.
FREE, IN_L, IN_N, IN_O, JOINED, IN_WHITE, LEFT_1, LEFT_2 = range(8)


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The state after a codepoint of this class, and whether a slice begins with it."""
    run = {L: IN_L, N: IN_N, O: IN_O}
    if kind in (QUOTE_1, QUOTE_2):
        if state in (IN_O, JOINED):
            return IN_O, False
        return (LEFT_1 if kind == QUOTE_1 else LEFT_2), True
    if kind == L and state in (LEFT_1, LEFT_2):
        return (FREE if state == LEFT_1 else LEFT_1), False
    if kind in run:
        return run[kind], state not in (run[kind], JOINED)
    if kind == SPACE_LAST:
        return JOINED, True
    if kind == WHITE_LAST:
        return IN_WHITE, True
    return IN_WHITE, state != IN_WHITE


@functools.cache
def automaton() -> tuple[bytes, bytes, bytes, bytes]:
    """Tables of one byte to one: class (+ 9 at a text's start) to function, two functions to their composition,
    function to the state it gives from FREE, and state and class to whether a slice begins."""
    plain = [tuple(_step(s, k)[0] for s in range(8)) for k in range(9)]
    first = [(f[FREE],) * 8 for f in plain]
    elements: dict[tuple, int] = {}
    for f in (tuple(range(8)), *plain, *first):
        elements.setdefault(f, len(elements))
    todo = list(elements)
    while todo:
        f = todo.pop()
        for g in (*plain, *first):
            h = tuple(g[x] for x in f)
            if h not in elements:
                elements[h] = len(elements)
                todo.append(h)
    assert len(elements) <= 16  # so that two of them make one byte
    functions = np.array(list(elements), dtype=np.uint8)
    composed = np.zeros(256, dtype=np.uint8)
    for i, f in enumerate(elements):
        for j, g in enumerate(elements):
            composed[16 * i + j] = elements[tuple(g[x] for x in f)]
    generators, free, begins = (np.zeros(256, dtype=np.uint8) for _ in range(3))
    generators[: 2 * 9] = [elements[f] for f in (*plain, *first)]
    free[: len(functions)] = functions[:, FREE]
    for s in range(8):
        for k in range(9):
            begins[16 * s + k] = _step(s, k)[1]
    return tuple(x.tobytes() for x in (generators, composed, free, begins))


def _mapped(codes: np.ndarray, table: bytes) -> np.ndarray:
    return np.frombuffer(codes.tobytes().translate(table), dtype=np.uint8)


def scanned(ids: np.ndarray, block: int = 64) -> np.ndarray:
    """Inclusive scan of function ids under composition, blockwise."""
    _, composed, _, _ = automaton()
    n = len(ids)
    if n <= block:
        out = ids.copy()
        for i in range(1, n):
            out[i] = composed[16 * int(out[i - 1]) + int(out[i])]
        return out
    rows = -(-n // block)
    grid = np.zeros(rows * block, dtype=np.uint8)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)
    for j in range(1, block):
        grid[j] = _mapped((grid[j - 1] << 4) | grid[j], composed)
    before = np.zeros(rows, dtype=np.uint8)
    before[1:] = scanned(grid[-1].copy(), block)[:-1]
    grid = _mapped((before << 4)[None, :] | grid, composed).reshape(block, rows)
    return np.ascontiguousarray(grid.T).ravel()[:n]


@functools.cache
def class_table() -> np.ndarray:
    """Class of each codepoint, without what depends on neighbours."""
    import regex

    table = np.zeros(0x110000, dtype=np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for pattern, kind in ((r"\p{L}+", L), (r"\p{N}+", N), (r"\s+", WHITE)):
        for m in regex.finditer(pattern, every):
            table[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    table[0xD800:0xE000] = O
    table[0x20] = SPACE
    return table


#: Letters of the contractions after a quote, one letter or two.
_ONE = np.zeros(128, dtype=bool)
_ONE[[ord(c) for c in "stmd"]] = True
_TWO = ("re", "ve", "ll")


def boundaries(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where slices begin, for texts laid end to end that begin at ``starts`` (each of one codepoint or more)."""
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64)
    generators, _, free, begins = automaton()
    kind = class_table()[points]
    opens = np.zeros(n + 1, dtype=bool)
    opens[starts] = True
    opens[n] = True
    white = kind >= SPACE
    last = white & ~opens[1:]
    last[:-1] &= ~white[1:]
    kind += last.view(np.uint8)  # SPACE to SPACE_LAST, WHITE to WHITE_LAST
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        at = lambda d: np.where(quotes + d < n, points[np.minimum(quotes + d, n - 1)], 0)
        one = at(1)
        here = ~opens[quotes + 1]
        kind[quotes[here & (one < 128) & _ONE[np.minimum(one, 127)]]] = QUOTE_1
        two = at(2)
        pair = functools.reduce(np.logical_or, ((one == ord(a)) & (two == ord(b)) for a, b in _TWO))
        kind[quotes[here & pair & ~opens[np.minimum(quotes + 2, n)]]] = QUOTE_2
    coded = kind.copy()
    coded[starts] += 9
    before = np.empty(n, dtype=np.uint8)
    before[1:] = _mapped(scanned(_mapped(coded, generators))[:-1], free)
    before[starts] = FREE
    found = _mapped((before << 4) | kind, begins).astype(bool)
    found[starts] = True
    return np.flatnonzero(found)


_R = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, as many as asked for."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = pow(_R, -1, 1 << 64)
            for name, base in (("up", _R), ("down", inverse)):
                p = np.ones(size, dtype=np.uint64)
                done, factor = 1, base
                while done < size:
                    p[done : 2 * done] = p[:done] * np.uint64(factor)
                    done, factor = 2 * done, factor * factor & _M
                setattr(cls, name, p)
        return cls.up, cls.down


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slice_hashes(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices of ``points``, from one prefix sum."""
    up, down = Powers.of(len(points) + 1)
    sums = np.zeros(len(points) + 1, dtype=np.uint64)
    x = points.astype(np.uint64)
    x += np.uint64(0x7F4A7C15)
    x *= np.uint64(0xD1342543DE82EF95)
    x ^= x >> np.uint64(29)
    x *= up[: len(points)]
    np.cumsum(x, out=sums[1:])
    return mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def ragged(source: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """source[begin[i] : begin[i] + sizes[i]] for all i, end to end."""
    total = int(sizes.sum())
    if not total:
        return source[:0]
    to = np.cumsum(sizes) - sizes
    return source[np.repeat(begin - to, sizes) + np.arange(total)]


def equal_slices(x: np.ndarray, begin: np.ndarray, y: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which slices x[begin : begin + sizes] equal y[start : start + sizes]."""
    to = np.cumsum(sizes) - sizes
    differ = np.flatnonzero(ragged(x, begin, sizes) != ragged(y, start, sizes))
    out = np.ones(len(sizes), dtype=bool)
    out[np.searchsorted(to, differ, side="right") - 1] = False
    return out


class Codec:
    """Encoder and decoder of one vocabulary, with its cache; one for each worker process."""

    SLOTS = 1 << 21
    MOST = 1 << 22  # entries that the cache may hold before it begins anew, and a quarter of its tokens

    def __init__(self, ranks: dict[bytes, int], special: dict[str, int] | None = None):
        import public_tokenizers
        import tiktoken

        self.special = special or {}
        self.merge = tiktoken.Encoding("slices", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        size = max([*ranks.values(), *self.special.values()]) + 1
        raw, decimal = [b""] * size, [b"%d " % i for i in range(size)]
        for b, i in (*ranks.items(), *((k.encode(), i) for k, i in self.special.items())):
            raw[i] = b
        self.raw = self._table(raw)
        self.decimal = self._table(decimal)
        self.clear()

    @staticmethod
    def _table(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        return np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes

    def clear(self) -> None:
        self.keys = np.zeros(self.SLOTS, dtype=np.uint64)
        self.entry = np.full(self.SLOTS, -1, dtype=np.int32)
        self.begin = np.zeros(1 << 16, dtype=np.int32)
        self.size = np.zeros(1 << 16, dtype=np.int32)
        self.tokens = np.zeros(1 << 18, dtype=np.int32)
        # The slices of the entries, as codepoints.
        self.said_at = np.zeros(1 << 16, dtype=np.int64)
        self.said_size = np.zeros(1 << 16, dtype=np.int64)
        self.said = np.zeros(1 << 18, dtype=np.uint32)
        self.entries = self.used = self.spoken = 0

    def _room(self, entries: int, tokens: int, points: int) -> None:
        of_entries = self.entries + entries
        for name, need in (("begin", of_entries), ("size", of_entries), ("said_at", of_entries), ("said_size", of_entries), ("tokens", self.used + tokens), ("said", self.spoken + points)):
            have = getattr(self, name)
            if len(have) < need:
                setattr(self, name, np.concatenate([have, np.zeros(max(need - len(have), len(have)), dtype=have.dtype)]))

    def _added(self, text: str, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of new entries for these slices, which are merged."""
        merge = self.merge
        new = [merge(text[a:b].encode()) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        sizes = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
        flat = np.fromiter((t for x in new for t in x), dtype=np.int32, count=int(sizes.sum()))
        said = end - begin
        self._room(len(new), len(flat), int(said.sum()))
        ids = np.arange(self.entries, self.entries + len(new))
        self.begin[ids] = self.used + np.cumsum(sizes) - sizes
        self.size[ids] = sizes
        self.tokens[self.used : self.used + len(flat)] = flat
        self.said_at[ids] = self.spoken + np.cumsum(said) - said
        self.said_size[ids] = said
        self.said[self.spoken : self.spoken + int(said.sum())] = ragged(points, begin, said)
        self.entries += len(new)
        self.used += len(flat)
        self.spoken += int(said.sum())
        return ids

    def _is(self, entry: np.ndarray, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which slices are equal to those of the entries."""
        out = self.said_size[entry] == end - begin
        at = np.flatnonzero(out)
        out[at] = equal_slices(points, begin[at], self.said, self.said_at[entry[at]], (end - begin)[at])
        return out

    def _entries(self, text: str, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The cache's entry of each slice; slices that it lacks are merged and added."""
        if self.used > 4 * self.MOST or self.entries > self.MOST or self.spoken > 8 * self.MOST:
            self.clear()
        hashes = slice_hashes(points, begin, end)
        slot = (hashes & np.uint64(self.SLOTS - 1)).astype(np.int64)
        entry = np.where(self.keys[slot] == hashes, self.entry[slot], -1)
        hit = np.flatnonzero(entry >= 0)
        entry[hit[~self._is(entry[hit], points, begin[hit], end[hit])]] = -1
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            fresh, at, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            ids = self._added(text, points, begin[missing[at]], end[missing[at]])
            slot = (fresh & np.uint64(self.SLOTS - 1)).astype(np.int64)
            self.keys[slot] = fresh
            self.entry[slot] = ids
            entry[missing] = ids[back]
            # Other slices under the hash of one that was just added are entries that no slot leads to.
            other = missing[~self._is(entry[missing], points, begin[missing], end[missing])]
            if len(other):
                entry[other] = self._added(text, points, begin[other], end[other])
        return entry

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, where each text's ids begin and the last ones end); strings of special tokens are ordinary text."""
        full = [i for i, t in enumerate(texts) if t]
        offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        if not full:
            return np.zeros(0, dtype=np.int32), offsets
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        starts = np.cumsum(lengths) - lengths
        begin = boundaries(points, starts[lengths > 0])
        end = np.append(begin[1:], len(points))
        entry = self._entries(joined, points, begin, end)
        sizes = self.size[entry].astype(np.int64)
        ids = ragged(self.tokens, self.begin[entry], sizes)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        offsets[:-1] = upto[np.searchsorted(begin, starts)]
        offsets[-1] = upto[-1]
        return ids, offsets

    def encode_special(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, but the strings of special tokens become their ids."""
        marks = [k for k in self.special if any(k in t for t in texts)]
        if not marks:
            return self.encode(texts)
        import re

        cut = re.compile("(" + "|".join(map(re.escape, sorted(marks, key=len, reverse=True))) + ")")
        parts = [cut.split(t) for t in texts]
        flat = [p for x in parts for p in x]
        named = [k % 2 == 1 for x in parts for k in range(len(x))]
        ids, offsets = self.encode(["" if s else p for p, s in zip(flat, named, strict=True)])
        sizes = np.diff(offsets)
        out = [np.array([self.special[p]], dtype=np.int32) if s else ids[a : a + n] for p, s, a, n in zip(flat, named, offsets, sizes, strict=False)]
        ends = np.cumsum([len(x) for x in out])
        upto = np.cumsum([len(x) for x in parts])
        return np.concatenate(out), np.concatenate([[0], ends[upto - 1]])

    def decoded(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where each text's bytes begin."""
        return self._spread(self.raw, ids, offsets)

    def decimals(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decimal ids with a space after each, and where each text's begin."""
        return self._spread(self.decimal, ids, offsets)

    def _spread(self, table, ids, offsets):
        flat, begin, sizes = table
        upto = np.concatenate([[0], np.cumsum(sizes[ids])])
        return ragged(flat, begin[ids], sizes[ids]), upto[offsets]


def ranks_of(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(bytes to rank, special tokens) of a .tiktoken file, or of a byte-level .json."""
    if not path.endswith(".json"):
        with open(path, "rb") as lines:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, {}
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    # Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on.
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(other)}
    return {bytes(byte_of[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}, special


@large_cache
def codec(path: str) -> Codec:
    return Codec(*ranks_of(path))


def texts_of(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in batch.column("text").to_pylist()]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """One row a document: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches(source):
            ids, offsets = own.encode(texts_of(batch))
            said, said_at = own.decimals(ids, offsets)
            raw, raw_at = own.decoded(ids, offsets)
            said, raw = memoryview(said), memoryview(raw)
            sha = lambda x: hashlib.sha256(x).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(np.diff(offsets)),
                    pa.array([sha(said[a : max(a, b - 1)]) for a, b in zip(said_at[:-1].tolist(), said_at[1:].tolist(), strict=True)], pa.string()),
                    pa.array([sha(raw[a:b]) for a, b in zip(raw_at[:-1].tolist(), raw_at[1:].tolist(), strict=True)], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
