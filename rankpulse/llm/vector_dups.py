"""Near-duplicate vectors within a label by products of int8 tiles with rigorous error bounds.

A vector x is scaled to length 1 and quantised: x = s * q + r, q of 8 bits. For two vectors the cosine differs from s * s' * <q, q'> by no more
than |r| |s'q'| + |sq| |r'| + |r| |r'| (Cauchy-Schwarz), so a tile of integer products tells which pairs can't reach the threshold. Only
the others are computed again in double precision, and that decides.

Equal vectors of a label are one class from the start. The classes of a label are cut into blocks; a task compares one block with itself or with
another and gives back, for each class, the number of vectors linked to it, and a spanning forest of the tile's links instead of its pairs.
So a group of n near copies costs rows in proportion to n and to its blocks, while every link is counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, in_arrow, stored
from .near_dup import components

#: A block has about MIN_ROWS classes or more; a label gets up to SPREAD blocks of that size, and more only when its blocks would pass BLOCK_BYTES of float64.
MIN_ROWS, SPREAD, BLOCK_BYTES = 1024, 8, 16 << 20
#: Rows and columns of a product at once, and pairs that are computed again at once.
STEP, PAIRS = 1024, 32_768
#: Rounding of sums of products of unit vectors in double precision, times the dimension.
ROUNDING = 4e-16


class Tile:
    """Unit vectors, their quantised form and the norms that bound what quantising changed."""

    def __init__(self, rows: np.ndarray):
        rows = rows / np.abs(rows).max(1, keepdims=True)  # so that squares neither overflow nor vanish
        self.unit = rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
        self.scale = np.abs(self.unit).max(1) / 127
        self.codes = np.rint(self.unit / self.scale[:, None]).astype(np.int8)
        inside = self.codes * self.scale[:, None]
        norm = lambda x: np.sqrt(np.einsum("ij,ij->i", x, x)) * (1 + ROUNDING * rows.shape[1])
        self.inside, self.error = norm(inside), norm(self.unit - inside)


def quantised(a: Tile, b: Tile, left: slice, right: slice) -> np.ndarray:
    """Integer products of codes. Single precision holds them exactly for 1,024 components at a time."""
    total = np.zeros((left.stop - left.start, right.stop - right.start))
    for at in range(0, a.codes.shape[1], 1024):
        part = slice(at, at + 1024)
        total += a.codes[left, part].astype(np.float32) @ b.codes[right, part].astype(np.float32).T
    return total


def possible(a: Tile, b: Tile, left: slice, right: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the pairs whose cosine may reach the threshold."""
    most = quantised(a, b, left, right)
    most *= a.scale[left, None]
    most *= b.scale[None, right]
    most += a.error[left, None] * (b.inside + b.error)[None, right]
    most += a.inside[left, None] * b.error[None, right]
    i, j = np.nonzero(most >= threshold - 2 * ROUNDING * a.codes.shape[1])
    return i + left.start, j + right.start


def links(a: Tile, b: Tile | None, threshold: float, tally: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of a, rows of b) of the linked pairs, in parts; b None: pairs within a, each once.

    tally: gets the pairs looked at, those computed in double precision and those linked.
    """
    own, b, tally = b is None, b or a, [0, 0, 0] if tally is None else tally
    n, m = len(a.unit), len(b.unit)
    for x in range(0, n, STEP):
        for y in range(x if own else 0, m, STEP):
            left, right = slice(x, min(n, x + STEP)), slice(y, min(m, y + STEP))
            i, j = possible(a, b, left, right, threshold)
            if own and x == y:
                i, j = i[i < j], j[i < j]
            tally[0] += (left.stop - x) * (right.stop - y)
            tally[1] += len(i)
            for at in range(0, len(i), PAIRS):
                p, q = i[at : at + PAIRS], j[at : at + PAIRS]
                near = np.einsum("ij,ij->i", a.unit[p], b.unit[q]) >= threshold
                if near.any():
                    tally[2] += int(near.sum())
                    yield p[near], q[near]


def join(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a and b, place by place; roots holds the least member of each node's set, before and after."""
    while len(a):
        a, b = roots[a], roots[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(roots, np.maximum(a, b), np.minimum(a, b))
        while (roots[roots] != roots).any():
            roots[:] = roots[roots]


def _compared(cut: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n): n vectors are linked with class a (b null), or a and b are in one component (n null).

    cut: grp, blocks, block, cid, n, v. A block meets itself and every other of its group; one pair of blocks is in memory at a time.
    """
    each = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = each.select("grp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "n", "v")
    rows = dealt.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "block")
    keys = ("grp", "i", "j", "block")

    def compare(parts: list[tuple[tuple, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        sides = []
        for block in sorted({p[0][3] for p in parts}):
            cid, n, rows = (np.concatenate(x) for x in zip(*[p[1:] for p in parts if p[0][3] == block], strict=True))
            sides.append((cid, n, Tile(rows)))
        (_, i, j, _), first, last = parts[0][0], sides[0], sides[-1]
        if i != j and len(sides) < 2:  # by chance a block is empty
            return
        own, shift = i == j, 0 if i == j else len(first[0])
        cid, n = (first[k] if own else np.concatenate([first[k], last[k]]) for k in (0, 1))
        roots, linked = np.arange(len(cid)), np.zeros(len(cid), np.int64)
        for p, q in links(first[2], None if own else last[2], threshold):
            q = q + shift
            np.add.at(linked, p, n[q])
            np.add.at(linked, q, n[p])
            join(roots, p, q)
        some, child = np.flatnonzero(linked), np.flatnonzero(roots != np.arange(len(roots)))
        a = pa.array(np.concatenate([cid[some], cid[child]]), pa.int64())
        b = pa.array(np.concatenate([np.zeros(len(some), np.int64), cid[roots[child]]]), pa.int64(), mask=np.arange(len(a)) < len(some))
        count = pa.array(np.concatenate([linked[some], np.zeros(len(child), np.int64)]), pa.int64(), mask=np.arange(len(a)) >= len(some))
        yield pa.record_batch([a, b, count], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy() for k in keys], 1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            vectors = batch.column("v")
            flat = pc.cast(vectors.flatten(), pa.float64()).to_numpy().reshape(len(key), -1) if len(set(pc.list_value_length(vectors).to_pylist())) == 1 else None
            for x, y in zip(edges, edges[1:], strict=False):
                at = tuple(key[x].tolist())
                if held and held[0][0][:3] != at[:3]:
                    yield from compare(held)
                    held = []
                rows = flat[x:y] if flat is not None else np.array(vectors.slice(x, y - x).to_pylist(), np.float64)
                held.append((at, batch.column("cid").to_numpy()[x:y], batch.column("n").to_numpy()[x:y], rows))
        if held:
            yield from compare(held)

    return in_arrow(rows.select(*keys, "cid", "n", "v"), run, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Two rows are linked if their labels are equal and not null, their vectors have one dimension and a cosine of threshold or more in double
    precision. n_links counts the other rows that a row is linked with, component_id is the least id that links reach, kept says whether it is the row's own.
    Vectors that are null, empty, zero or hold a null or non-finite component, and rows without a label, link with nothing and are kept. Rows
    that repeat an id are rows of their own: each is linked with its twins. Null ids take part but name no component that has another id; alone
    they are kept. Other columns are dropped; an empty table gives no rows.
    """
    v = F.col("v")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    fine = rows.where(F.coalesce(whole & F.col("label").isNotNull(), F.lit(False)))
    classes = fine.groupBy("label", "v").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("rep")).withColumn("cid", F.monotonically_increasing_id())
    classes = stored(classes.withColumn("dim", F.size("v")), "vector-classes")
    size = F.greatest(F.least(F.ceil(F.count(F.lit(1)) / MIN_ROWS), F.lit(SPREAD)), F.ceil(F.count(F.lit(1)) * F.col("dim") * 8 / BLOCK_BYTES))
    groups = stored(classes.groupBy("label", "dim").agg(size.cast("long").alias("blocks")).withColumn("grp", F.monotonically_increasing_id()), "vector-groups")
    cut = classes.join(groups, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    found = stored(_compared(cut.select("grp", "blocks", "block", "cid", "n", "v"), threshold), "vector-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("linked"))
    joined = components(found.where("b is not null").select("a", "b"))
    known = classes.join(counts, "cid", "left").join(joined.select(F.col("node").alias("cid"), F.col("label").alias("root")), "cid", "left")
    known = stored(known.select("label", "v", "rep", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root")), "vector-known")
    least = known.groupBy("root").agg(F.min("rep").alias("component_id"))
    final = stored(known.join(least, "root").select("label", "v", "n_links", "component_id"), "vector-components")
    discard(classes, groups, found, joined, known)
    out = rows.join(final, ["label", "v"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
