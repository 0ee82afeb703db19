"""Exact top-k inner product search by the threshold algorithm (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.llm.common import dropped, released, written

BLOCK, QUERY_BLOCK, FIRST_DEPTH = 4096, 256, 32
#: Components of one block's vectors, at most, and of the queries that one round takes to all blocks.
BLOCK_SIZE, ROUND_SIZE = BLOCK * 64, 1 << 21
Best = tuple[np.ndarray, np.ndarray, np.ndarray]


def best_of(found: Best, k: int) -> Best:
    """Of (query, id, score) the k best of each query, ties to the smaller id, in order."""
    order = np.lexsort((found[1], -found[2], found[0]))
    query = found[0][order]
    order = order[np.arange(len(order)) - np.searchsorted(query, query) < k]
    return found[0][order], found[1][order], found[2][order]


def largest(v: np.ndarray) -> int:
    return max(int(v.max(initial=0)), -int(v.min(initial=0)))


def nothing() -> Best:
    return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)


def threshold_searches(vectors: np.ndarray, ids: np.ndarray, lists: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, best: Best, floors: np.ndarray | None = None) -> Best:
    """(place of the query, id, score) of the k best rows for each query, of these rows and of `best`, which other
    rows gave; ties to the smaller id.

    own: place of the query's own row, or -1. floors: scores that k rows elsewhere reach; what is below may be
    left out.

    lists: per dimension, the rows in ascending order of that component; a positive weight reads its list
    from the end, a negative one from the start. Queries read in step: what any of them meets is scored in full
    for all that still read. A query stops when the bound on rows not met, the weighted sum of the components last
    read, is below its k-th score. A bound equal to it goes on, as a tie may have a smaller id.
    """
    n, m, each = len(vectors), len(queries), np.arange(vectors.shape[1])
    exact = largest(vectors) * largest(queries) * max(1, vectors.shape[1]) < 2**53
    kind = np.float64 if exact else np.int64
    v, q = vectors.astype(kind, copy=False), queries.astype(kind)
    lowest = -np.inf if exact else np.iinfo(np.int64).min
    least = np.full(m, lowest, kind) if floors is None else floors.astype(kind)
    seen, active, depth, step = np.zeros(n, bool), np.arange(m), 0, FIRST_DEPTH

    def raised() -> None:
        if len(best[0]):
            at = np.flatnonzero(np.arange(len(best[0])) - np.searchsorted(best[0], best[0]) == k - 1)
            least[best[0][at]] = np.maximum(least[best[0][at]], best[2][at].astype(kind))

    raised()
    while depth < n and len(active):
        end, w = min(n, depth + step), q[active]
        up, down = np.flatnonzero((w > 0).any(0)), np.flatnonzero((w < 0).any(0))
        new = np.zeros(n, bool)
        if len(up) + len(down):
            new[lists[n - end : n - depth].take(up, 1)] = True
            new[lists[depth:end].take(down, 1)] = True
        else:
            new[:], end = True, n
        new = np.flatnonzero(new & ~seen)
        seen[new] = True
        score = w @ v[new].T
        place = np.searchsorted(new, own[active])
        met = np.flatnonzero(np.append(new, -2)[place] == own[active])
        other = np.ones(score.shape, bool)
        other[met, place[met]] = False
        cut = least[active]
        open_ = np.flatnonzero(cut == lowest)
        if len(open_) and len(new) > k:
            score_of = np.where(other[open_], score[open_], lowest)
            cut[open_] = np.partition(score_of, len(new) - k, axis=1)[:, len(new) - k]
        i, j = np.nonzero((score >= cut[:, None]) & other)
        best = best_of((np.append(best[0], active[i]), np.append(best[1], ids[new[j]]), np.append(best[2], score[i, j].astype(np.int64))), k)
        raised()
        depth, step = end, step * 2
        if depth < n:
            bound = np.maximum(w, 0) @ v[lists[n - end], each] + np.minimum(w, 0) @ v[lists[end - 1], each]
            active = active[least[active] <= bound]
    return best


def threshold_search(vectors: np.ndarray, ids: np.ndarray, lists: np.ndarray, query: np.ndarray, own: int, k: int, floor: int | None = None, rows: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(id, score) of the k best rows for one query. own: its row, by `rows`, which names each; else by ids."""
    place = np.flatnonzero((ids if rows is None else rows) == own)
    floors = None if floor is None else np.array([floor])
    _, found, score = threshold_searches(vectors, ids, lists, query[None], np.append(place, -1)[:1], k, nothing(), floors)
    return list(zip(found.tolist(), score.tolist(), strict=True))


def _packed(v: np.ndarray) -> np.ndarray:
    """Integers in as few bytes as hold them."""
    low, high = int(v.min(initial=0)), int(v.max(initial=0))
    return v.astype(next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _matrix(rows: pa.ChunkedArray) -> np.ndarray:
    flat = rows.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(rows), -1) if len(flat) else np.zeros((len(rows), 0), np.int64)


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for every vector whose vec_id is divisible by `every`, against all others.

    Vectors are dealt into blocks of about `block`, or fewer where they are long, each written once with its sorted
    lists, a list a dimension. Queries go to all tasks in rounds of ROUND_SIZE components, so that neither the
    driver nor a task holds more of them; a task reads its blocks one after the other, and the k-th score that it
    has is a floor for the next: there the threshold algorithm stops as soon as its bound falls below. Blocks are
    neither moved nor copied; the best k a query and task go on. Every query meets every block, as a
    result must know of all rows: the work grows with the queries times the blocks. Null vectors, null vec_ids and
    null or non-finite components take no part; a query meets vectors of its own length; with fewer than k others
    all are returned. Rows that repeat a vec_id are vectors of their own: each is a candidate for all rows but
    itself, and as a query gets a ranking of its own.
    """
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    whole = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    whole = whole.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).withColumn("d", F.size("x"))
    whole = written(whole, "vectors")
    n, size, asked_size = whole.agg(F.count("*"), F.sum("d"), F.sum(F.when(F.col("vec_id") % every == 0, F.col("d") + 2))).first()
    blocks, rounds = max(1, -(-n // block), -(-(size or 0) // BLOCK_SIZE)), -(-(asked_size or 0) // ROUND_SIZE)

    def listed(table: pa.Table) -> pa.Table:
        v = _matrix(table.column("x"))
        lists = np.argsort(v, axis=0, kind="stable").astype("<u2" if len(v) <= 1 << 16 else "<i4")
        v = _packed(v)
        held = [table.column(c).to_numpy().astype("<i8").tobytes() for c in ("row", "vec_id")]
        return pa.table({"d": pa.array([v.shape[1]], pa.int32()), "n": pa.array([len(v)], pa.int32()), "kind": [v.dtype.str], "row": pa.array(held[:1], pa.binary()), "ids": pa.array(held[1:], pa.binary()), "x": pa.array([v.tobytes()], pa.binary()), "lists": pa.array([lists.tobytes()], pa.binary())})

    dealt = whole.withColumn("c", F.pmod(F.xxhash64("row"), F.lit(blocks))).groupBy("d", "c")
    candidates = written(dealt.applyInArrow(listed, "d int, n int, kind string, row binary, ids binary, x binary, lists binary"), "blocks")
    asked = written(whole.where(F.col("vec_id") % every == 0), "asked")

    def met(at: int) -> DataFrame:
        """The best k of each query of a round in each task's blocks."""
        rows = asked.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == at).toArrow()
        length = rows.column("d").to_numpy()
        queries = {}
        for d in np.unique(length):
            own = rows.filter(pa.array(length == d))
            queries[int(d)] = own.column("row").to_numpy(), own.column("vec_id").to_numpy(), _packed(_matrix(own.column("x")))
        shared = asked.sparkSession.sparkContext.broadcast(queries)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[tuple[int, int], Best] = {}
            for batch in batches:
                for i in range(batch.num_rows):
                    d, size, kind = (batch.column(c)[i].as_py() for c in ("d", "n", "kind"))
                    if d not in shared.value:
                        continue
                    read = lambda c, t: np.frombuffer(batch.column(c)[i].as_buffer(), t)  # noqa: B023, E731
                    row, ids, v, lists = read("row", "<i8"), read("ids", "<i8"), read("x", kind).reshape(size, d).astype(np.int64), read("lists", "<u2" if size <= 1 << 16 else "<i4").reshape(size, d)
                    q_row, _, q = shared.value[d]
                    order = np.argsort(row)
                    place = order[np.minimum(np.searchsorted(row, q_row, sorter=order), size - 1)]
                    own = np.where(row[place] == q_row, place, -1)
                    v = v.astype(np.float64) if largest(v) * max(1, largest(q)) * max(1, d) < 2**53 else v
                    for a in range(0, len(q), QUERY_BLOCK):
                        part = slice(a, a + QUERY_BLOCK)
                        best[d, a] = threshold_searches(v, ids, lists, q[part].astype(np.int64), own[part], k, best.get((d, a), nothing()))
            for (d, a), (i, found, score) in best.items():
                q_row, q_ids, _ = shared.value[d]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (q_row[a + i], q_ids[a + i], found, score)], ["row", "query_id", "vec_id", "score"])

        return candidates.select("d", "n", "kind", "row", "ids", "x", "lists").mapInArrow(released(search), "row long, query_id long, vec_id long, score long")

    place = "row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)"
    tops = [written(met(at).selectExpr("query_id", f"{place} AS rank", "vec_id", "score").where(f"rank <= {k}"), "top") for at in range(rounds)]
    dropped(whole, candidates, asked)
    schema = "query_id long, rank int, vec_id long, score long"
    return reduce(DataFrame.unionByName, tops) if tops else vectors.sparkSession.createDataFrame([], schema)
