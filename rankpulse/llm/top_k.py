"""Exact top-k by inner product with multi-resolution segment statistics.

A vector is cut into 1, 4 and 16 segments; of each it keeps the mean and the norm of the deviations. For a query q and a candidate x,
|q - x|^2 >= |q|^2 + |x|^2 - 2 * sum over segments of (length * mean(q) * mean(x) + dev(q) * dev(x)), by Cauchy-Schwarz on the
deviations; so the sum bounds the inner product from above, the tighter the finer the segments.

Rows are packed into blocks. Candidates are dealt to shares of bounded bytes, one of which a task holds, and the query set, a stated share
of all rows, is sent to every share in blocks; a task returns k rows a query. Within a share, candidates that look alike stand together in parts. A
query first meets those of its best bounds, and the k-th best exact score of them is its floor. Then it visits the parts whose best bound
reaches the floor, best part first: the pairs of a part are bounded coarse to fine, and exact scores are computed for the rows and columns that are left and raise
the floor. The same is done at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow

LEVELS = (1, 4, 16)
#: Rows of a block of candidates and of one of queries.
BLOCK, QUERY_BLOCK = 256, 1024
#: Bytes of candidates in a share, at 8 bytes a component.
SHARE_BYTES = 32 << 20
#: Candidates of a part; as many as SEEDS times k candidates of a query give its first floor.
STEP, SEEDS = 512, 4
#: Components from this on don't take part: what they make can't be a score of 64 bits.
HUGE = 2.0**62


def _blocks(vectors: DataFrame, scale: float, size: int) -> DataFrame:
    """Blocks of up to `size` rows of equal dimension: dim, ids (int64), data (a row a vector, integers as wide as they must be). Vectors with gaps are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for dim, ids, rows in _whole(batch, scale):
                own = held.setdefault(dim, [])
                own.append((ids, rows))
                if sum(len(i) for i, _ in own) >= size:
                    ids, rows = (np.concatenate(x) for x in zip(*own, strict=True))
                    full = len(ids) // size * size
                    for at in range(0, full, size):
                        yield _block(dim, ids[at : at + size], rows[at : at + size])
                    held[dim] = [(ids[full:], rows[full:])]
        for dim, own in held.items():
            ids, rows = (np.concatenate(x) for x in zip(*own, strict=True))
            if len(ids):
                yield _block(dim, ids, rows)

    return in_arrow(vectors, run, "dim int, ids binary, data binary")


def _whole(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, ids, integer vectors) of a batch's vectors that are whole and finite."""
    ids, lists = batch.column(0), batch.column(1)
    there = pc.and_(pc.is_valid(ids), pc.is_valid(lists))
    ids, lists = ids.filter(there), lists.filter(there)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(lists.flatten(), pa.float64())
    values = flat.to_numpy(zero_copy_only=False)  # nulls become nan
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ids = ids.to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        if dim == 0:
            yield 0, ids[at], np.zeros((len(at), 0), np.int64)
            continue
        rows = values[starts[at][:, None] + np.arange(dim)]
        with np.errstate(over="ignore"):
            rows = np.floor(scale * rows)
        fine = (np.abs(rows) < HUGE).all(1)  # nor are nan and infinity
        yield dim, ids[at[fine]], rows[fine].astype(np.int64)


def _block(dim: int, ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    most = int(np.abs(rows).max(initial=0))
    rows = rows.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)
    return pa.record_batch([pa.array([dim], pa.int32()), pa.array([ids.astype(np.int64).tobytes()]), pa.array([np.ascontiguousarray(rows).tobytes()])], ["dim", "ids", "data"])


def _unpacked(data: bytes, rows: int, dim: int) -> np.ndarray:
    """The vectors of a block as int64."""
    kind = f"i{len(data) // (rows * dim)}" if dim else "i8"
    return np.frombuffer(data, kind).reshape(rows, dim).astype(np.int64)


def statistics(rows: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the segments, and the mean and the norm of the deviations of each row in each."""
    edges = np.linspace(0, rows.shape[1], min(segments, rows.shape[1]) + 1).astype(int)
    lengths = np.diff(edges)
    means = np.add.reduceat(rows, edges[:-1], axis=1) / lengths
    devs = np.sqrt(np.add.reduceat((rows - np.repeat(means, lengths, axis=1)) ** 2, edges[:-1], axis=1))
    return lengths, means, devs


class Share:
    """The candidates of one dimension that a task holds, with the statistics of their segments. Rows that look alike stand together."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        if rows.shape[1]:
            order = _alike(rows.astype(np.float64))
            ids, rows = ids[order], rows[order]
        self.ids, self.rows, self.exact = ids, rows, rows.astype(np.float64)
        self.levels = [_features(self.exact, n, False) for n in LEVELS] if rows.shape[1] else []
        self.most = float(np.abs(rows).max(initial=0))


def _alike(rows: np.ndarray) -> np.ndarray:
    """An order of the rows in which each follows others that are nearest to the same one of a few rows, by the means of the finest segments."""
    _, means, _ = statistics(rows, LEVELS[-1])
    centres = means[np.linspace(0, len(rows) - 1, max(1, min(256, len(rows) // STEP * 4))).astype(int)]
    nearest = [np.argmin((centres * centres).sum(1)[None, :] - 2 * means[at] @ centres.T, axis=1) for at in _parts(len(rows), 4096)]
    return np.argsort(np.concatenate(nearest or [np.zeros(0, np.int64)]), kind="stable")


def _features(rows: np.ndarray, segments: int, weighted: bool) -> np.ndarray:
    """Means (times the lengths, if weighted) and deviations side by side: products of two rows of features are bounds."""
    lengths, means, devs = statistics(rows, segments)
    return np.hstack([means * lengths if weighted else means, devs])


def best(queries: np.ndarray, query_ids: np.ndarray, share: Share, k: int, tally: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the query, vec_id, score) of each query's k best rows of a share but its own, ties to the smaller id.

    tally: gets the pairs looked at, those that each level leaves, in order, and those whose scores are computed, first ones apart.
    """
    n, tally = len(queries), [0] * (2 + len(LEVELS)) if tally is None else tally
    tally[0] += n * len(share.ids)
    found = tuple(np.zeros(0, np.int64) for _ in range(3))
    if not queries.shape[1] or float(np.abs(queries).max(initial=0)) * share.most * queries.shape[1] >= 2**53:
        return _by_integers(queries, query_ids, share, k)
    exact = queries.astype(np.float64)
    levels = [_features(exact, m, True) for m in LEVELS]
    parts = _parts(len(share.ids), STEP)
    # the best bound of each part, and the candidates of the best bounds of all
    tops, seeds, marks = np.empty((n, len(parts))), np.zeros((n, 0), np.int64), np.zeros((n, 0))
    for p, at in enumerate(parts):
        bound = levels[-1] @ share.levels[-1][at].T
        bound[query_ids[:, None] == share.ids[None, at]] = -np.inf
        tops[:, p] = bound.max(1)
        few = np.argpartition(-bound, min(SEEDS * k, bound.shape[1]) - 1, axis=1)[:, : SEEDS * k]
        seeds, marks = np.hstack([seeds, few + at.start]), np.hstack([marks, np.take_along_axis(bound, few, 1)])
        keep = np.argpartition(-marks, min(SEEDS * k, marks.shape[1]) - 1, axis=1)[:, : SEEDS * k]
        seeds, marks = np.take_along_axis(seeds, keep, 1), np.take_along_axis(marks, keep, 1)
    first = np.einsum("id,ijd->ij", exact, share.exact[seeds]) if seeds.size else np.zeros((n, 0))
    first[~np.isfinite(marks)] = -np.inf
    floor = -np.sort(-first, axis=1)[:, k - 1] if first.shape[1] >= k else np.full(n, -np.inf)
    for p in np.argsort(-tops.max(0, initial=-np.inf)):
        at = parts[p]
        rows = np.flatnonzero(tops[:, p] >= floor - _slack(tops[:, p]))
        columns = np.arange(at.start, at.stop)
        for level, (a, b) in enumerate(zip(levels, share.levels, strict=True)):
            bound = a[rows] @ b[columns].T
            alive = (bound >= (floor[rows, None] - _slack(bound))) & (query_ids[rows, None] != share.ids[None, columns])
            tally[1 + level] += int(alive.sum())
            kept, left = alive.any(1), alive.any(0)
            rows, columns, alive = rows[kept], columns[left], alive[np.ix_(kept, left)]
        if not len(rows):
            continue
        tally[-1] += alive.size
        score = np.where(alive, np.rint(exact[rows] @ share.exact[columns].T), -np.inf)
        least = -np.partition(-score, k - 1, axis=1)[:, k - 1] if score.shape[1] > k else np.full(len(rows), -np.inf)
        q, x = np.nonzero(alive & (score >= np.maximum(least, floor[rows])[:, None]))
        found = _first(*(np.concatenate(c) for c in zip(found, (rows[q], share.ids[columns[x]], score[q, x].astype(np.int64)), strict=True)), k)
        # the k-th best so far of those that have k; a first floor stays until then
        last = np.searchsorted(found[0], np.arange(n), "right") - 1
        full = np.bincount(found[0], minlength=n) >= k
        floor[full] = np.maximum(floor[full], found[2][last[full]])
    return found


def _by_integers(queries: np.ndarray, query_ids: np.ndarray, share: Share, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same where doubles don't hold the scores: every pair in whole numbers, held to 64 bits."""
    found = tuple(np.zeros(0, np.int64) for _ in range(3))
    for at in _parts(len(share.ids), STEP):
        q, x = np.nonzero(query_ids[:, None] != share.ids[None, at])
        whole = queries.astype(object) @ share.rows[at].astype(object).T if queries.shape[1] else np.zeros((len(queries), len(share.ids[at])), object)
        score = np.array([max(-(2**63), min(2**63 - 1, int(v))) for v in whole[q, x]], dtype=np.int64)
        found = _first(*(np.concatenate(c) for c in zip(found, (q, share.ids[at][x], score), strict=True)), k)
    return found


def _slack(bound: np.ndarray) -> np.ndarray:
    """Rounding of the bounds."""
    return 1e-9 * np.abs(np.where(np.isfinite(bound), bound, 0)) + 1e-6


def _parts(n: int, size: int) -> list[slice]:
    return [slice(i, min(n, i + size)) for i in range(0, n, size)]


def _first(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    starts = np.searchsorted(q, q, "left")
    keep = np.arange(len(q)) - starts < k
    return q[keep], ids[keep], scores[keep]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest inner product of floor(scale * x) for each query row.

    Vectors that are null, hold a null or non-finite component or have no id take no part; vectors meet those of their own dimension.
    A row whose id is the query's is its own; rows with a repeated id count once each, and as a query the id counts once, by the least
    of its valid vectors. Fewer rows give fewer ranks, an empty table none. A vector with a component of 2^62 or more, once scaled, takes no part
    either; scores that don't fit 64 bits are held to the least or greatest number that does.
    """
    v = F.col("v")
    inside = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), is_query.alias("q")).where(F.col("vec_id").isNotNull() & inside)
    spark = vectors.sparkSession
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(8 * F.size("v")), F.lit(0)).alias("bytes")).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # enough shares for all tasks, none above SHARE_BYTES, and no more than there are blocks
    shares = max(1, min(size["n"] // BLOCK, max(2 * tasks, size["bytes"] // SHARE_BYTES)))
    one = rows.where("q").groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = _blocks(one, scale, QUERY_BLOCK).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).withColumn("query", F.lit(True))
    candidates = _blocks(rows.select("vec_id", "v"), scale, BLOCK).withColumn("share", F.pmod(F.xxhash64("ids"), F.lit(shares)).cast("int")).withColumn("query", F.lit(False))
    dealt = candidates.unionByName(queries).repartition(tasks, "share").sortWithinPartitions("share", "dim", "query")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, share = None, [], None
        for batch in batches:
            for at, dim, query, ids, data in zip(*(batch.column(c).to_pylist() for c in ("share", "dim", "query", "ids", "data")), strict=True):
                if (at, dim) != current:
                    current, held, share = (at, dim), [], None
                ids = np.frombuffer(ids, np.int64)
                data = _unpacked(data, len(ids), dim)
                if not query:
                    held.append((ids, data))
                elif held:
                    share = share or Share(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    q, x, score = best(data, ids, share, k)
                    yield pa.record_batch([pa.array(ids[q]), pa.array(x), pa.array(score)], ["query_id", "vec_id", "score"])

    found = in_arrow(dealt.select("share", "dim", "query", "ids", "data"), run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
