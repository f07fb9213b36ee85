r"""Operator 1: packing documents into sequences by minimum bin slack.

Each task encodes its documents, cuts them into pieces and packs the pieces that
are shorter than a sequence. Pieces are counted by length. For a sequence, the
longest piece left is taken and a subset-sum program on a bitset (bit s: sum s
can be reached) finds the multiset of other lengths that comes closest to filling
it; stepping back through the bitsets gives how often each length is used, and
the pattern found is used as often as the counts allow. Where the sequence cannot
be filled, a sum that is a power of two is preferred, since it needs no padding.
Work is done in windows of many pieces; what a window could not place exactly is
carried to the next, until more than ``CARRIED`` windows' worth of pieces wait: then
the longest ones get the patterns that come closest. There is no shuffle.

Defined cases: a null or empty text is the one closing id. A document of any
length is cut into full sequences and a rest. Repeated rows are packed each for
itself. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tracekiln.llm.bpe import codec, texts_of
from tracekiln.llm.common import batches, trimmed

CAPACITY = 2048
CLOSING = 1
WINDOW = 16_384
#: Windows' worth of pieces that may wait for lengths that fill their sequences.
CARRIED = 4

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def slack_pattern(lengths: list[int], counts: Counter, capacity: int) -> tuple[Counter, int]:
    """The multiset of lengths (ascending list, with counts) for one sequence, and its sum.

    Its longest length is always used; the rest comes closest to the capacity.
    """
    seed = lengths[-1]
    room = capacity - seed
    mask = (1 << (room + 1)) - 1
    goal = 1 << room
    reach, steps = 1, []
    for k in range(bisect_right(lengths, room) - 1, -1, -1):
        if reach & goal:
            break
        length = lengths[k]
        left = min(counts[length] - (length == seed), room // length)
        times = 1
        while left > 0:  # 1, 2, 4, ... copies at once: any number up to the count is a sum of these
            use = min(times, left)
            steps.append((length, use, reach))
            reach |= (reach << (length * use)) & mask
            left -= use
            times *= 2
    best = reach.bit_length() - 1
    if best < room:
        power = 1 << (capacity - 1).bit_length() - 1
        while power >= seed:
            if power <= seed + best and reach >> (power - seed) & 1:
                best = power - seed
                break
            power >>= 1
    found, rest = Counter({seed: 1}), best
    for length, use, before in reversed(steps):
        if not before >> rest & 1:
            found[length] += use
            rest -= length * use
    return found, seed + best


def patterns(counts: Counter, capacity: int, last: bool) -> Iterator[tuple[list[int], int]]:
    """(lengths of a sequence, how often) until the counts are used up.

    If ``last`` is false, only full sequences are given, and the counts that are
    left belong to the next window.
    """
    counts = Counter({k: v for k, v in counts.items() if v > 0})
    lengths = sorted(counts)
    while lengths:
        found, total = slack_pattern(lengths, counts, capacity)
        if total < capacity and not last:
            lengths.pop()  # stays in the counts: carried on
            continue
        times = min(counts[k] // n for k, n in found.items())
        yield [k for k, n in found.items() for _ in range(n)], times
        for k, n in found.items():
            counts[k] -= n * times
            if not counts[k]:
                lengths.pop(bisect_right(lengths, k) - 1)


class Packer:
    """Sequences of one task."""

    def __init__(self, capacity: int, first_id: int, most_waiting: int = CARRIED * WINDOW):
        self.capacity, self.next_id, self.most_waiting = capacity, first_id, most_waiting
        self.open: dict[int, deque] = {}
        self.waiting = 0
        self.out: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw, n = ids.astype("<u4").tobytes(), len(ids)
        for start in range(0, n, self.capacity):
            size = min(self.capacity, n - start)
            piece = (doc_id, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)]), n)
            if size == self.capacity:
                self.out.append((*piece, self.next_id, 0))
                self.next_id += 1
            else:
                self.open.setdefault(size, deque()).append(piece)
                self.waiting += 1

    def _place(self, last: bool, least_waiting: int = 0) -> None:
        for lengths, times in patterns(Counter({k: len(v) for k, v in self.open.items()}), self.capacity, last):
            for _ in range(times):
                offset = 0
                for size in lengths:
                    self.out.append((*self.open[size].popleft(), self.next_id, offset))
                    offset += size
                self.waiting -= len(lengths)
                self.next_id += 1
                if self.waiting <= least_waiting:
                    return

    def close(self, last: bool) -> None:
        """Full sequences of what waits; if it is the last window or too much is left, others as well."""
        self._place(last)
        if self.waiting > self.most_waiting:
            self._place(True, self.most_waiting // 2)

    def rows(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) or [()] * 7
        self.out = []
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, window: int = WINDOW) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        packer = Packer(capacity, TaskContext.get().partitionId() << 36, CARRIED * window)
        limit = window
        for batch in batches(source):
            ids, offsets = own.encode_special(texts_of(batch))
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                packer.add(doc_id, np.append(ids[offsets[k] : offsets[k + 1]], np.int32(CLOSING)))
            if packer.waiting >= limit:
                packer.close(last=False)
                limit = packer.waiting + window
            if len(packer.out) >= 50_000:
                yield packer.rows()
        packer.close(last=True)
        yield packer.rows()

    return docs.select("doc_id", "text").mapInArrow(trimmed(run, codec), SCHEMA)
