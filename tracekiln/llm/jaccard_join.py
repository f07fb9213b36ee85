r"""Operator 5: n-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct word shingles, as 64-bit tokens under a key
drawn for each call, so that no text can be written whose words collide. Tokens
have one global order: first those of a zone of small values, unique ones before
rare ones before frequent ones, then all others, each by value. Two sets can only
reach the similarity if they share enough tokens at the front of that order, so a
prefix is indexed: a rare token by itself, frequent tokens in combinations of two out
of the same part of the frequent class, and nothing for a unique one, which no other
set has. The prefix is extended until whatever tokens a partner may lack, one rare
token or one combination is left in common: over parts, the sum of (tokens - 1), plus
the unique and rare tokens, exceeds the number that may be missing.

Tokens are counted in fronts, which hold the whole zone of their sets. Frequent is a
token of ``LEAST_FREQUENT`` sets and unique one of a single set, unless it shares its
bit with another in a table of ``BITS`` bits. Frequent and rare may be told apart by
any function of the token and a token that is taken for rare is only indexed in vain,
so bits that are shared cost time only, and what is sent to the tasks has one size for
any corpus. Exact copies of a set are one item.

Signatures that the same items have are one bucket, named after one of them. A
bucket is cut into blocks of a bounded number of items and tokens, and all pairs of
blocks are compared in tasks on sketches: a bit is the parity of the tokens that
fall on it, so two sketches never differ in more bits than the sets do in tokens,
and what they rule out cannot be a link. First each item is held against one leader
of its block, which is linear and joins most near copies; then all pairs of
different components are. What is left is verified on the tokens themselves: pair by
pair, or, where a block has more pairs than a multiple of its items, inside the task
that holds the block. So no step has rows that grow with the square of a group, and
no link between components is lost.

Defined cases: a null or empty text has no shingles, and is alone even among its
like. A text with fewer words than a shingle is one shingle. Repeated rows and
exact copies share a component. Rows without ``doc_id`` link like others; a
component of such rows alone has no ``component_id``. Where one ``doc_id`` stands for
several texts, each links for itself. An empty table gives no rows; other columns
are ignored. Texts count whole. Two shingles or sets are taken for equal at 64 and
128 equal bits of their keyed hashes.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracekiln.llm.bpe import mixed
from tracekiln.llm.common import batches, freed, stored, trimmed
from tracekiln.llm.secret_scan import _LOWER, utf8

#: Fronts that a frequent token stands in, at least.
LEAST_FREQUENT = 8
#: The zone has so many percent of the tokens that a set may lack.
ZONE_PERCENT = 160
#: Size of a table of bits. A token counts as frequent, and a signature as shared, if its bit is set.
BITS = 1 << 26
#: Bits that one row of the table has, by Spark's bitmap functions.
_ROW = 1 << 15
#: Items and tokens of a block, on average at most; a single set may have more tokens.
BLOCK_ITEMS, BLOCK_TOKENS = 1 << 11, 1 << 19
#: Pairs that a block may hand on for each of its items, before it is verified as a whole.
PAIRS_AN_ITEM = 4
#: Pairs of sketches that are compared in one step.
STEP = 1 << 16
#: Rows of three numbers that may be sent to every task.
SENT = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(9, 14)]] = True
_TURN = np.uint64(0x9FB21C651E98DF25)


# Sets of tokens


def word_hashes(low: np.ndarray, begin: np.ndarray, end: np.ndarray, key: int) -> np.ndarray:
    """64-bit hashes of words (slices of bytes), eight bytes at a time."""
    eights = np.ndarray((len(low) + 1,), dtype="<u8", buffer=np.concatenate([low, np.zeros(8, np.uint8)]), strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
    first, second = (np.uint64(int.from_bytes(hashlib.blake2b(b"%d" % k, key=key.to_bytes(8, "little"), digest_size=8).digest(), "little")) for k in range(2))
    size = end - begin
    out = mixed((eights[begin] & masks[np.minimum(size, 8)]) ^ first)
    out = mixed(out + size.astype(np.uint64) * _TURN)
    at, done = np.flatnonzero(size > 8), 8
    while len(at):
        if done >= 1024:  # few words are so long: the rest of each at once
            for i in at.tolist():
                rest = hashlib.blake2b(low[begin[i] + done : end[i]].tobytes(), key=key.to_bytes(8, "little"), digest_size=8).digest()
                out[i] ^= np.uint64(int.from_bytes(rest, "little"))
            out[at] = mixed(out[at])
            break
        more = eights[begin[at] + done] & masks[np.minimum(size[at] - done, 8)]
        out[at] = mixed((out[at] * _TURN) ^ mixed(more ^ second))
        done += 8
        at = at[size[at] > done]
    return out


def token_sets(data: np.ndarray, offsets: np.ndarray, words: int, key: int) -> list[np.ndarray]:
    """Sorted distinct tokens of each text, from all their bytes."""
    space = np.ones(len(data) + 2, dtype=bool)
    space[1:-1] = _SPACE[data]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[inner] = True
    begin = np.flatnonzero(~space[1:] & (space[:-1] | edge))
    end = np.flatnonzero(~space[:-1] & (space[1:] | edge))
    hashes = word_hashes(_LOWER[data], begin, end, key)
    first = np.searchsorted(begin, offsets[:-1])
    last = np.append(first[1:], len(begin))
    rolled = np.zeros(len(hashes), dtype=np.uint64)
    count = len(hashes) - words + 1
    if count > 0:
        for k in range(words):
            rolled[:count] = mixed(rolled[:count] * _TURN + hashes[k : k + count])
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            x = np.array([b - a], dtype=np.uint64)
            for k in range(a, b):
                x = mixed(x * _TURN + hashes[k : k + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def width(n: int) -> int:
    """Bits of the sketch of a set of n."""
    return max(256, 1 << (n - 1).bit_length()) if n else 256


def sketch(tokens: np.ndarray) -> bytes:
    """The parity of the tokens on each bit."""
    bits = width(len(tokens))
    on = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(on.astype(np.uint8), bitorder="little").tobytes()


# Signatures


def shared_least(n: int, percent: int) -> int:
    """Tokens that a set of n must share with a partner of any size."""
    return -(-percent * n // 100)


def parts_met(n: int, percent: int) -> list[int]:
    """Numbers of parts of the frequent class, by the larger set's missing tokens: all that a set of n may meet."""
    least, most = (s - shared_least(s, percent) + 1 for s in (n, 100 * n // percent))
    return sorted({max(1, 1 << (k - 1) if k else 1) for k in range(least.bit_length() - 1, most.bit_length())})


def zone(percent: int) -> np.uint64:
    return np.uint64(min((1 << 64) - 1, ZONE_PERCENT * (100 - percent) * (1 << 64) // 10_000))


def front(tokens: np.ndarray, percent: int) -> np.ndarray:
    """The tokens of a set that its signatures may need: the zone, and enough to extend any prefix."""
    n = len(tokens)
    if n < 2:
        return tokens[:0]
    enough = n - shared_least(n, percent) + 1 + parts_met(n, percent)[-1]
    return tokens[: max(enough, int(np.searchsorted(tokens, zone(percent))))]


def signatures(tokens: np.ndarray, again: np.ndarray, often: np.ndarray, n: int, percent: int) -> np.ndarray:
    """The signatures of a set of n with this front, whose tokens other sets have or not, and are frequent or not."""
    if n < 2:  # a partner of a single token is an exact copy
        return tokens[:0]
    lack = n - shared_least(n, percent)
    inside = int(np.searchsorted(tokens, zone(percent)))
    again, often = again[:inside], often[:inside]
    need = lack + 1 - int((~again).sum())
    if need <= 0:
        return tokens[:0]
    rare, common, beyond = tokens[:inside][again & ~often], tokens[:inside][again & often], tokens[inside:]
    if len(rare) >= need:
        return rare[:need]
    need, short = need - len(rare), 0
    out = [rare]
    for m in parts_met(n, percent):
        part = ((common >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
        # A token covers one missing token if its part has been met before.
        new = np.zeros(len(common), dtype=bool)
        new[np.unique(part, return_index=True)[1]] = True
        covered = np.cumsum(~new)
        stop = int(np.searchsorted(covered, need)) + 1
        if stop > len(common):
            short = max(short, need - (int(covered[-1]) if len(covered) else 0))
        part, used = part[:stop], common[:stop]
        order = np.argsort(part, kind="stable")
        part, used = part[order], used[order]
        step = 1
        while step < len(part):  # pairs at distance 1, 2, ... inside a part
            same = np.flatnonzero(part[step:] == part[:-step])
            if not len(same):
                break
            out.append(mixed(used[same] * _TURN + mixed(used[same + step]) + np.uint64(m)))
            step += 1
    if short > len(beyond):
        raise AssertionError("a prefix cannot be extended")
    return np.unique(np.concatenate([*out, beyond[:short]]))


def held(tokens: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which tokens have their bit set."""
    at = tokens & np.uint64(BITS - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bit_table(values: DataFrame) -> np.ndarray:
    """The bits of a column of longs, put together on the executors; BITS / 8 bytes whatever the corpus."""
    place = values.select(F.col(values.columns[0]).bitwiseAND(F.lit(BITS - 1)).alias("p"))
    rows = place.groupBy(F.floor(F.col("p") / _ROW).alias("row")).agg(F.bitmap_construct_agg((F.col("p") % _ROW).cast("int")).alias("bits"))
    out = np.zeros((BITS // _ROW, _ROW // 8), dtype=np.uint8)
    for r in rows.collect():
        out[r["row"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.ravel()


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.uint64)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """The rows of a column of lists of longs, as unsigned numbers."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a hash of the text that tells rows of one ``doc_id`` apart."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], F.xxhash64(docs["text"]).alias("text_key"))


def shapes(docs: DataFrame, words: int, percent: int, key: int) -> DataFrame:
    """doc_id, text_key, n_shingles, two halves of the set's hash, its front and its sketch."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            data, offsets, _ = utf8(batch.column("text"))
            sets = token_sets(data, offsets, words, key)
            halves = [pa.array(np.array([mixed(x ^ np.uint64(k)).sum(dtype=np.uint64) for x in sets], dtype=np.uint64).view(np.int64)) for k in (0, 0xA0761D6478BD642F)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array([len(x) for x in sets], pa.int64()),
                    *halves,
                    _lists([front(x, percent) for x in sets]),
                    pa.array([sketch(x) if len(x) > 1 else b"" for x in sets], pa.binary()),
                ],
                names=["doc_id", "text_key", "n_shingles", "set_a", "set_b", "front", "sketch"],
            )

    return _keyed(docs).mapInArrow(trimmed(run), "doc_id long, text_key long, n_shingles long, set_a long, set_b long, front array<long>, sketch binary")


def signed(items: DataFrame, percent: int, shared, frequent, only=None) -> DataFrame:
    """item, signature; ``only`` is a broadcast table of bits of the signatures wanted, the others are of tokens."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            own, found = [], []
            for item, n, tokens in zip(batch.column("item").to_pylist(), batch.column("n").to_pylist(), _arrays(batch.column("front")), strict=True):
                x = signatures(tokens, held(tokens, shared.value), held(tokens, frequent.value), n, percent)
                if only is not None:
                    x = x[held(x, only.value)]
                own.append(np.full(len(x), item, dtype=np.int64))
                found.append(x)
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(np.concatenate(found).view(np.int64))], names=["item", "signature"])

    return items.select("item", "n", "front").mapInArrow(trimmed(run), "item long, signature long")


# Comparing


class Compared:
    """Sizes and sketches of rows, and which pairs of them may reach the similarity."""

    def __init__(self, n: np.ndarray, sketches: pa.Array, percent: int):
        self.n, self.percent = n, percent
        raw = sketches.to_pylist()
        self.width = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        self.place = np.zeros(len(raw), dtype=np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.place[at] = np.arange(len(at))
            self.rows[w] = np.frombuffer(b"".join(raw[i] for i in at.tolist()), dtype=np.uint64).reshape(len(at), -1)

    def _at(self, i: np.ndarray, w: int) -> np.ndarray:
        """Sketches of rows folded to ``w`` bytes: a bit of the half is the parity of two."""
        out = np.empty((len(i), w // 8), dtype=np.uint64)
        for own in np.unique(self.width[i]).tolist():
            some = np.flatnonzero(self.width[i] == own)
            x = self.rows[own][self.place[i[some]]]
            while x.shape[1] > w // 8:
                x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
            out[some] = x
        return out

    def possible(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs (i, j) sizes and sketches leave room for."""
        p = self.percent
        out = (100 * self.n[i] >= p * self.n[j]) & (100 * self.n[j] >= p * self.n[i])
        at = np.flatnonzero(out)
        least = np.minimum(self.width[i[at]], self.width[j[at]])
        for w in np.unique(least).tolist():
            some = at[least == w]
            each = max(1, 8 * STEP // w)
            for k in range(0, len(some), each):
                x = some[k : k + each]
                differ = np.bitwise_count(self._at(i[x], w) ^ self._at(j[x], w)).sum(axis=1, dtype=np.int64)
                out[x] = (100 + p) * differ <= (100 - p) * (self.n[i[x]] + self.n[j[x]])
        return out


def whole_groups(source: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows, which stand in groups, in batches that break at groups only."""
    rest: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(rest).combine_chunks().to_batches()[0]

    for batch in source:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        other = np.zeros(batch.num_rows, dtype=bool)
        for v in values:
            other |= v != v[-1]
        cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if not cut and rest and all(rest[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in keys):
            rest.append(batch)
            continue
        if cut:
            rest.append(batch.slice(0, cut))
        if rest:
            yield joined()
        rest = [batch.slice(cut)]
    if rest:
        yield joined()


def _groups(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """The number of each row's group."""
    new = np.zeros(batch.num_rows, dtype=bool)
    for k in keys:
        v = batch.column(k).to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new)


def near_leaders(placed: DataFrame, percent: int) -> DataFrame:
    """(a, b): items and the leader of their block, where they may be linked."""
    keys = ["signature", "block"]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(source, keys):
            group = _groups(batch, keys)
            first = np.searchsorted(group, group)
            item = batch.column("item").to_numpy()
            rows = np.flatnonzero(item != item[first])
            rows = rows[Compared(batch.column("n").to_numpy(), batch.column("sketch"), percent).possible(rows, first[rows])]
            yield pa.RecordBatch.from_arrays([pa.array(item[rows]), pa.array(item[first[rows]])], names=["a", "b"])

    # In every bucket the same order, so that items of many buckets have few leaders.
    dealt = placed.repartition(*keys).sortWithinPartitions(*keys, F.xxhash64("item"), "item")
    return dealt.select(*keys, "item", "n", "sketch").mapInArrow(trimmed(run), "a long, b long").distinct()


def near_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that may be linked, as rows (signature, low, high, a, b).

    A pair of blocks with more such pairs than ``PAIRS_AN_ITEM`` for each item gives
    its items instead, with b null.
    """
    keys = ["signature", "low", "high"]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(source, keys):
            group = _groups(batch, keys)
            item, n, part, block = (batch.column(c).to_numpy() for c in ("item", "n", "component", "block"))
            same = batch.column("low").to_numpy() == batch.column("high").to_numpy()
            compared = Compared(n, batch.column("sketch"), percent)
            # Rows of a group stand by size: partners of a row come after it, up to its largest one.
            place = group.astype(np.int64) << 40 | n
            stop = np.searchsorted(place, group.astype(np.int64) << 40 | 100 * n // percent, side="right")
            count = np.maximum(stop - np.arange(len(n)) - 1, 0)
            upto = np.concatenate([[0], np.cumsum(count)])
            left, right = [], []
            row = 0
            while row < len(n):
                end = max(row + 1, int(np.searchsorted(upto, upto[row] + 8 * STEP, side="right")) - 1)
                i = np.repeat(np.arange(row, end), count[row:end])
                j = i + 1 + np.arange(len(i)) - np.repeat(upto[row:end] - upto[row], count[row:end])
                wanted = (part[i] != part[j]) & (same[i] | (block[i] != block[j]))
                i, j = i[wanted], j[wanted]
                good = compared.possible(i, j)
                left.append(i[good])
                right.append(j[good])
                row = end
            i, j = np.concatenate(left), np.concatenate(right)
            dense = np.bincount(group[i], minlength=group[-1] + 1) > PAIRS_AN_ITEM * np.bincount(group)
            whole = dense[group[i]]
            flagged = np.unique(np.concatenate([i[whole], j[whole]]))
            rows = np.concatenate([i[~whole], flagged])
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(k).take(pa.array(rows)) for k in keys],
                    pa.array(item[rows]),
                    pa.array(np.concatenate([item[j[~whole]], np.zeros(len(flagged), dtype=np.int64)]), mask=np.arange(len(rows)) >= len(rows) - len(flagged)),
                ],
                names=[*keys, "a", "b"],
            )

    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = placed.select("*", other).select("signature", "block", "component", "item", "n", "sketch", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    dealt = spread.repartition(*keys).sortWithinPartitions(*keys, "n")
    return dealt.select(*keys, "block", "component", "item", "n", "sketch").mapInArrow(trimmed(run), "signature long, low int, high int, a long, b long")


def sets_of(docs: DataFrame, items: DataFrame, wanted: DataFrame, words: int, key: int) -> DataFrame:
    """item, tokens of the wanted items, from one row of ``docs`` each."""
    rows = stored(items.select("item", "doc_id", "text_key").join(wanted.select("item").distinct(), "item", "left_semi"), "join-wanted")
    small = rows.count() <= SENT
    rows = rows.select("item", F.col("doc_id").alias("of"), F.col("text_key").alias("of_key"))
    texts = _keyed(docs).join(F.broadcast(rows) if small else rows, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key")))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            data, offsets, _ = utf8(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("item"), _lists(token_sets(data, offsets, words, key))], names=["item", "tokens"])

    return texts.select("item", "text").mapInArrow(trimmed(run), "item long, tokens array<long>").dropDuplicates(["item"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    left = sets.select(F.col("item").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("item").alias("b"), F.col("tokens").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def linked_inside(flagged: DataFrame, sets: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join all components which links inside a pair of blocks join."""
    keys = ["signature", "low", "high"]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(source, keys):
            item, part = batch.column("item").to_numpy(), batch.column("component").to_numpy()
            tokens, group = _arrays(batch.column("tokens")), _groups(batch, keys)
            n = np.array([len(x) for x in tokens], dtype=np.int64)
            compared = Compared(n, pa.array([sketch(x) for x in tokens], pa.binary()), percent)
            left, right = [], []
            for g in range(group[-1] + 1):
                first, stop = np.searchsorted(group, [g, g + 1]).tolist()
                own = part[first:stop].copy()
                for i in range(first, stop - 1):
                    j = np.arange(i + 1, stop)
                    j = j[own[j - first] != own[i - first]]
                    for k in j[compared.possible(np.full(len(j), i), j)].tolist():
                        if own[k - first] == own[i - first]:
                            continue
                        both = len(np.intersect1d(tokens[i], tokens[k], assume_unique=True))
                        if 100 * both >= percent * (n[i] + n[k] - both):
                            own[own == own[k - first]] = own[i - first]
                            left.append(item[i])
                            right.append(item[k])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    rows = flagged.join(sets, "item").join(parts, "item", "left").withColumn("component", F.coalesce("component", "item"))
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "component", "item", "tokens").mapInArrow(trimmed(run), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """item, component: the smallest item that links lead to, for all items of ``links`` (a, b)."""
    spark = links.sparkSession
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "join-edges")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("item"), "label"), "join-labels")
    while True:
        near = both.join(labels.select(F.col("item").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        met = labels.select("item", "label").join(near, labels["item"] == near["a"]).select("item", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("item").alias("label"), F.col("label").alias("further"))
        new = stored(met.join(jump, "label", "left").select("item", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "join-labels")
        done = not new.where("old <> label").take(1)
        freed(spark, *[labels, both] if done else [labels])
        if done:
            return new.select("item", F.col("label").alias("component"))
        labels = new


def joined(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """One row a document: doc_id, text_key, n_shingles, item, component, first: the least (no_id, doc_id, text_key) of the component.

    Documents without shingles have no item.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    spark = docs.sparkSession
    key = secrets.randbits(64)
    formed = stored(shapes(docs, words, percent, key), "join-shapes")
    some = formed.where("n_shingles > 0")
    items = some.groupBy("set_a", "set_b").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first"), F.any_value("n_shingles").alias("n"), F.any_value("front").alias("front"), F.any_value("sketch").alias("sketch")
    )
    items = stored(items.select(F.monotonically_increasing_id().alias("item"), "set_a", "set_b", "n", "first", "front", "sketch"), "join-items")
    counts = items.select(F.explode("front").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = stored(counts, "join-counts")
    sent = [spark.sparkContext.broadcast(bit_table(counts.where(F.col("n") >= k).select("token"))) for k in (2, LEAST_FREQUENT)]

    # Of signatures that the same items have, one is kept.
    met = signed(items, percent, *sent).groupBy("signature").agg(F.count(F.lit(1)).alias("g"), F.min("item").alias("least"), F.bit_xor(F.xxhash64("item")).alias("who")).where("g > 1")
    buckets = stored(met.groupBy("g", "least", "who").agg(F.min("signature").alias("signature")).select("signature"), "join-buckets")
    posted = signed(items, percent, *sent, spark.sparkContext.broadcast(bit_table(buckets))).join(buckets, "signature")
    posted = stored(posted.join(items.select("item", "n"), "item"), "join-posted")
    blocks = posted.groupBy("signature").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ITEMS), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    placed = posted.join(blocks, "signature").withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    placed = stored(placed.join(items.select("item", "sketch"), "item"), "join-placed")

    chosen = items.select("item", "first.doc_id", "first.text_key")

    def checked(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("item")).union(pairs.select(F.col("b").alias("item")))
        return stored(verified(pairs, sets_of(docs, chosen, ends, words, key), percent), "join-links")

    led = stored(near_leaders(placed, percent), "join-led")
    links = [checked(led)]
    parts = components(links[0])
    near = placed.join(parts, "item", "left").withColumn("component", F.coalesce("component", "item"))
    near = stored(near_pairs(near, percent), "join-near")
    links.append(checked(near.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
    flagged = near.where("b is null").select("signature", "low", "high", F.col("a").alias("item"))
    if flagged.take(1):
        links.append(stored(linked_inside(flagged, sets_of(docs, chosen, flagged, words, key), parts, percent), "join-links"))
    found = components(reduce(DataFrame.union, links))

    firsts = found.join(items.select("item", "first"), "item")
    least = firsts.groupBy("component").agg(F.min("first").alias("least"))
    of_linked = found.join(least, "component").select("item", "component", "least")
    of_set = stored(
        items.select("item", "set_a", "set_b", "first")
        .join(of_linked, "item", "left")
        .select("set_a", "set_b", "item", F.coalesce("component", "item").alias("component"), F.coalesce("least", "first").alias("first")),
        "join-sets",
    )
    freed(spark, items, counts, buckets, posted, placed, led, near, *links)
    with_set = some.join(of_set, ["set_a", "set_b"]).select("doc_id", "text_key", "n_shingles", "item", "component", "first")
    empty = formed.where("n_shingles = 0").select("doc_id", "text_key", "n_shingles", *[F.lit(None).cast(of_set.schema[c].dataType).alias(c) for c in ("item", "component", "first")])
    rows = with_set.unionByName(empty)
    rows._tracekiln_sources = [formed, of_set]
    return rows


def similar(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id."""
    rows = joined(docs, words, percent)
    return rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"))


def thinned(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest ``doc_id``; columns as they are.

    Documents without shingles stay. Of rows repeated whole, one stays.
    """
    rows = joined(docs, words, percent)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    each = stored(rows.where("n_shingles > 0").groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"), F.bool_or(key != F.col("first")).alias("goes")), "join-goes")
    freed(docs.sparkSession, *rows._tracekiln_sources)

    def of(names: DataFrame, how: str) -> DataFrame:
        few = names.count() <= SENT
        names = names.select(F.col("doc_id").alias("tracekiln_of"), F.col("text_key").alias("tracekiln_key"))
        return docs.join(F.broadcast(names) if few else names, docs["doc_id"].cast("long").eqNullSafe(F.col("tracekiln_of")) & (F.xxhash64(docs["text"]) == F.col("tracekiln_key")), how)

    again = each.where("n > 1 and not goes")
    if not again.take(1):
        return of(each.where("goes"), "left_anti")
    once = of(each.where("goes or n > 1"), "left_anti")
    twice = of(again, "left_semi").withColumn("tracekiln_key", F.xxhash64("text")).dropDuplicates(["doc_id", "tracekiln_key"]).drop("tracekiln_key")
    return once.unionByName(twice)
