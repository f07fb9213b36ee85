"""Work of Arrow batches in Python workers: exact search on packed rows, and weights of terms.

In the search, matrix products find who may be near, sums in the order of the elements decide.
A pack is a table of (id, h, embedding, category) in the order of ids, written as bytes; h tells
groups of the same id apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Batches = Iterator[pa.RecordBatch]
#: Rows and numbers of a pack, at most (one row at least).
ROWS, NUMBERS = 2048, 1 << 19
#: Rows from which copies are looked for, and bytes that a task keeps of them.
LOOK, KEPT = 1 << 16, 128 << 20
#: Queries of a pack and pairs of them that are scored at once.
STRIP, PAIRS = 512, 1 << 18


def _by_id(table: pa.Table) -> pa.Table:
    return table.take(pc.sort_indices(table["id"], null_placement="at_start"))


def _lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all lists, where each begins, and its length; -1 for a list that is null or has a null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    flat = column.flatten()
    length = np.where(column.is_valid().to_numpy(zero_copy_only=False), size, -1)
    if flat.null_count:
        length[np.unique(np.repeat(np.arange(len(size)), size)[flat.is_null().to_numpy(zero_copy_only=False)])] = -1
        flat = pc.fill_null(flat, 0)
    return flat.to_numpy(zero_copy_only=False).astype(np.float64), begin, length


def first_copies(k: int) -> Callable[[Batches], Batches]:
    """Of rows with the same embedding and category in a task, those of the k smallest ids; more may stay.

    Where few rows have copies, they are passed on at once.
    """

    def least(table: pa.Table) -> pa.Table:
        table = _by_id(table)
        column = table["embedding"].combine_chunks()
        flat, begin, length = _lists(column)
        kinds = table["category"].to_pylist()
        seen: dict[tuple, int] = {}
        keep = []
        for i, (b, n, kind) in enumerate(zip(begin.tolist(), length.tolist(), kinds, strict=True)):
            key = (flat[b : b + n].tobytes(), n, kind) if n >= 0 else (column[i].as_py() and str(column[i].as_py()), n, kind)
            before = seen.get(key, 0)
            if before < k:
                seen[key] = before + 1
                keep.append(i)
        return table.take(pa.array(keep, pa.int64()))

    def run(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []
        rows, look = 0, LOOK
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < look and sum(b.nbytes for b in held) < KEPT:
                continue
            few = least(pa.Table.from_batches(held)).combine_chunks()
            held = few.to_batches()
            if 10 * few.num_rows > 9 * rows or few.nbytes > KEPT // 2:
                yield from held
                held = []
            rows = sum(b.num_rows for b in held)
            look = rows + LOOK
        if held:
            yield from least(pa.Table.from_batches(held)).combine_chunks().to_batches()

    return run


def packed(batches: Batches) -> Batches:
    """One row of bytes for each pack."""

    def pack(table: pa.Table) -> Batches:
        table = _by_id(table)
        numbers = pc.sum(pc.list_value_length(table["embedding"])).as_py() or 0
        step = max(1, min(ROWS, ROWS * NUMBERS // max(numbers, 1) if numbers > NUMBERS else ROWS))
        for at in range(0, table.num_rows, step):
            out = pa.BufferOutputStream()
            part = table.slice(at, step).combine_chunks()
            with pa.ipc.new_stream(out, part.schema) as writer:
                writer.write_table(part)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], ["pack"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        batch = batch.select(["id", "h", "embedding", "category"])
        for at in range(0, batch.num_rows, ROWS):
            held.append(batch.slice(at, ROWS))
            if sum(b.num_rows for b in held) >= ROWS:
                whole = pa.Table.from_batches(held)
                yield from pack(whole.slice(0, ROWS))
                rest = whole.slice(ROWS)
                held = rest.to_batches() if rest.num_rows else []
    if held:
        yield from pack(pa.Table.from_batches(held))


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _groups(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix by length of the embedding; rows without a whole embedding under -1."""
    flat, begin, length = _lists(table["embedding"])
    out = {}
    for n in np.unique(length).tolist():
        at = np.flatnonzero(length == n)
        if n < 0:
            out[n] = (at, np.zeros((len(at), 0)))
        elif len(at) == len(length):
            out[n] = (at, flat.reshape(len(at), n))
        else:
            out[n] = (at, flat[begin[at][:, None] + np.arange(n)])
    return out


def _floor(scores: np.ndarray, k: int) -> np.ndarray:
    """For each row a value that at least k of its scores reach (all of them, if there are fewer)."""
    n, wide = scores.shape[1], 32
    if n <= k:
        return np.full(len(scores), -np.inf)
    if n >= 4 * k * wide:
        whole = n // wide * wide
        scores = scores[:, :whole].reshape(len(scores), -1, wide).max(axis=2)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def _first(mask: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the first k marks of each row; takes the marks away."""
    rows, cols = [], []
    left = np.arange(len(mask))
    for _ in range(k):
        col = mask[left].argmax(axis=1) if len(left) else np.zeros(0, np.int64)
        hit = mask[left, col]
        left, col = left[hit], col[hit]
        rows.append(left)
        cols.append(col)
        mask[left, col] = False
    return np.concatenate(rows), np.concatenate(cols)


def _strip(q: np.ndarray, qn: np.ndarray, queries: dict, pool: dict, same: np.ndarray | None, n_pool: int, k: int, boost: float) -> tuple[np.ndarray, ...]:
    """query, pool row, similarity and its class (0 NaN, 1 number, 2 null) of the k best and a few more, for some queries.

    ``q``: the rows of these queries; ``qn``: the length of each.
    """
    score = np.full((len(q), n_pool), -np.inf)
    null = np.ones((len(q), n_pool), bool)
    margin = np.zeros(len(q))
    for n, (prow, pmat) in pool.items():
        at = np.flatnonzero(qn == n)
        if n < 0 or not len(at):
            continue
        qmat = queries[n][1][np.searchsorted(queries[n][0], q[at])]
        cells = (slice(None), slice(None)) if len(at) == len(q) and len(prow) == n_pool else np.ix_(at, prow)
        score[cells] = qmat @ pmat.T
        null[cells] = False
        # Sums in another order differ by far less than this.
        size = np.sqrt((qmat * qmat).sum(axis=1)) * np.sqrt((pmat * pmat).sum(axis=1).max(initial=0.0))
        margin[at] = np.nan_to_num(1e-12 * max(n, 1) * size, nan=np.inf, posinf=np.inf)
    odd = np.isnan(score)
    guess = np.where(odd, np.inf, score)
    sure = np.zeros((0, 0), bool)
    if same is not None:
        guess = np.where(same, np.minimum(1.0, guess + boost), guess)
        sure = same & (null | odd | (score + boost >= 1.0 + margin[:, None] + 1e-12))
        guess[sure] = 1.0
        null &= ~same
    with np.errstate(invalid="ignore"):
        least = np.nan_to_num(_floor(guess, k) - margin - 1e-12, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
    may = (guess >= least[:, None]) & ~null
    if same is not None:
        may &= ~sure
    rows, cols = np.nonzero(may)
    value = np.zeros(len(rows))
    for n, (prow, pmat) in pool.items():
        if n < 0 or n not in queries:
            continue
        qmat, place, qplace = queries[n][1], np.full(n_pool, -1), np.searchsorted(queries[n][0], q)
        place[prow] = np.arange(len(prow))
        mine = np.flatnonzero((qn[rows] == n) & (place[cols] >= 0))
        for at in range(0, len(mine), PAIRS):
            some = mine[at : at + PAIRS]
            a, b = qplace[rows[some]], place[cols[some]]
            total = np.zeros(len(some))
            for i in range(n):
                total += qmat[a, i] * pmat[b, i]
            value[some] = total
    if same is not None:
        like = same[rows, cols]
        value[like] = np.fmin(1.0, value[like] + boost)
    kind = np.where(np.isnan(value), 0, 1)
    out = [(rows, cols, value, kind)]
    if same is not None:
        r, c = _first(sure, k)
        out.append((r, c, np.ones(len(r)), np.ones(len(r), int)))
    if null.any():
        r, c = _first(null, k)
        out.append((r, c, np.zeros(len(r)), np.full(len(r), 2)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def best_pairs(k: int, category: bool, boost: float, schema: pa.Schema) -> Callable[[Batches], Batches]:
    """The k best of a pool pack for each query of a query pack; columns query_id, query_h, pool_id, pool_h, similarity."""

    def of(queries: pa.Table, pool: pa.Table) -> Batches:
        qs, ps = _groups(queries), _groups(pool)
        lengths = np.full(queries.num_rows, -1)
        for n, (at, _) in qs.items():
            lengths[at] = n
        if category:
            both = pa.chunked_array([*queries["category"].chunks, *pool["category"].chunks]).combine_chunks()
            codes = both.dictionary_encode().indices
            codes = pc.fill_null(codes, -1).to_numpy(zero_copy_only=False)
            qc, pcat = codes[: queries.num_rows], codes[queries.num_rows :]
        for at in range(0, queries.num_rows, STRIP):
            q = np.arange(at, min(at + STRIP, queries.num_rows))
            same = (qc[q][:, None] == pcat[None, :]) & (pcat >= 0)[None, :] if category else None
            row, col, value, kind = _strip(q, lengths[q], qs, ps, same, pool.num_rows, k, boost)
            order = np.lexsort((col, -np.where(kind == 1, value, 0.0), kind, row))
            row, col, value, kind = row[order], col[order], value[order], kind[order]
            begins = np.searchsorted(row, np.arange(len(q)))
            best = np.arange(len(row)) - begins[row] < k
            row, col, value, kind = q[row[best]], col[best], value[best], kind[best]
            asked, found = queries.take(pa.array(row)), pool.take(pa.array(col))
            similarity = pa.array(value, pa.float64(), mask=kind == 2)
            cells = [asked["id"], asked["h"], found["id"], found["h"], similarity]
            arrays = [(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).cast(f.type) for c, f in zip(cells, schema, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for query_pack, pool_pack in zip(batch["query_pack"], batch["pack"], strict=True):
                yield from of(_unpacked(query_pack.as_py()), _unpacked(pool_pack.as_py()))

    return run


def weights(terms: list[str], idf: list[float], schema: pa.Schema) -> Callable[[Batches], Batches]:
    """Of rows with a key and its terms: key, term and weight, for the terms that are known. No two rows have the same key."""

    def run(batches: Batches) -> Batches:
        known, scale = pa.array(terms, pa.string()), np.array(idf, np.float64)
        for batch in batches:
            lists = batch.column(1)
            rows = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            found = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
            code, times = np.unique(rows[found >= 0] * max(len(terms), 1) + found[found >= 0], return_counts=True)
            if not len(code):
                continue
            row, term = np.divmod(code, len(terms))
            w = times * scale[term]
            norm = np.sqrt(np.bincount(row, w * w, batch.num_rows))
            cells = [batch.column(0).take(pa.array(row)), known.take(pa.array(term)), pa.array(w / norm[row])]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cells, schema, strict=True)], schema=schema)

    return run
