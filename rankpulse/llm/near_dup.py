"""Near-duplicate documents by HyperMinHash.

A document is its set of word shingles, as 64-bit hashes. One hash function deals the set to `BANDS * ROWS` buckets; a register keeps
the leading-zero count (6 bits) and 10 mantissa bits of the least value in its bucket, and an empty bucket borrows a full one's
register, the same for all documents. Bands of registers give candidates; the registers' collision-corrected Jaccard estimate drops
what is far off; what is left is confirmed on the full sets.

Documents with equal sets are one class from the start, and only classes are compared. In each bucket of a band the classes meet
the most central ones first. Those that such links leave in different components are compared with each other after that, in blocks
and in memory: by registers, which gives clusters of components that may be linked, then by full sets within the clusters. Only a spanning forest
of links leaves a task, so a large group of near copies costs rows in proportion to its size, and no link that joins components is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import encoders
from .common import arrow_map, discard, in_arrow, stored

BANDS, ROWS = 51, 5
REGISTERS = BANDS * ROWS
#: An estimate this far below the threshold rules a pair out: six standard errors of 255 registers.
MARGIN = 0.15
#: Central classes that the others of a bucket meet before pairs do.
LEADERS = 3
#: Rows of tables that are broadcast at most; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: About as many members, and bytes of them, of a cluster does a task compare with each other, or with as many others.
BLOCK, BLOCK_BYTES = 2048, 8 << 20
#: About as many classes of those that meet one leader go to a task with it.
MET = 1024
_NONE = -(2**63)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes (uint64) of each text: `words` neighbouring words, A-Z lower-cased; of fewer words, all as one."""
    for _, part in encoders.slices(column):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(part))
        flat = lists.flatten().dictionary_encode()
        names = flat.dictionary.to_pylist()
        hashes = np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in names], dtype=np.uint64)
        empty = names.index("") if "" in names else -1
        codes, starts = flat.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        for i in range(len(part)):
            own = codes[starts[i] : starts[i + 1]]
            own = hashes[own[own != empty]]
            n = min(words, len(own))
            if n == 0:
                yield np.zeros(0, np.uint64)
                continue
            h = np.full(len(own) - n + 1, n, np.uint64)
            for k in range(n):
                h = _mix(h + own[k : len(own) - n + 1 + k])
            yield np.unique(h)


def _probes(seed: int = 11) -> np.ndarray:
    """For each register the order in which it looks for a full one when it is empty."""
    random = np.random.default_rng(seed)
    return np.stack([random.permutation(REGISTERS) for _ in range(REGISTERS)])


def registers(sets: list[np.ndarray], probes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16), a row a set. Sets must not be empty."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    h = np.concatenate(sets)
    high, low = h >> np.uint64(32), h & np.uint64(0xFFFFFFFF)
    carry = (low * np.uint64(REGISTERS)) >> np.uint64(32)
    bucket = ((high * np.uint64(REGISTERS) + carry) >> np.uint64(32)).astype(np.int64)
    value = h * np.uint64(REGISTERS)  # the rest, uniform within the bucket; sets are sorted, so the first of a bucket is its least
    at = owner * REGISTERS + bucket
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    at, value = at[first], value[first]
    zeros = np.minimum(63, 64 - np.frexp(np.maximum(value, np.uint64(1)).astype(np.float64))[1]).clip(0)
    # rounding to a double may carry into the next power of two
    zeros = np.where((value << zeros.astype(np.uint64)) >> np.uint64(63) == 0, np.minimum(63, zeros + 1), zeros)
    mantissa = (value << np.minimum(63, zeros + 1).astype(np.uint64)) >> np.uint64(54)
    out = np.full(len(sets) * REGISTERS, -1, np.int64)
    out[at] = zeros.astype(np.int64) << 10 | mantissa.astype(np.int64)
    full = out >= 0
    gaps = np.flatnonzero(~full)
    for attempt in range(REGISTERS):
        if not len(gaps):
            break
        source = gaps - gaps % REGISTERS + probes[gaps % REGISTERS, attempt]
        found = full[source]
        out[gaps[found]] = out[source[found]]
        gaps = gaps[~found]
    return out.reshape(len(sets), REGISTERS).astype(np.uint16)


_WEIGHTS = _mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(BANDS, ROWS) | np.uint64(1)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each row of registers."""
    rows = regs.reshape(-1, BANDS, ROWS).astype(np.uint64)
    return _mix((rows * _WEIGHTS).sum(2) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).astype(np.int64)


def _shares(sizes: np.ndarray) -> np.ndarray:
    """For sets of these sizes: how often a bucket's least value has 0, 1, 2 .. leading zeros."""
    n, z = np.maximum(1.0, sizes / REGISTERS)[:, None], np.arange(0, 24)[None, :]
    return (1 - 2.0 ** -(z + 1)) ** n - (1 - 2.0**-z).clip(0) ** n


def estimate(a: np.ndarray, b: np.ndarray, shares_a: np.ndarray, shares_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, less the share of equal registers that chance gives sets of these _shares().

    By chance two unrelated least values fall into one cell: their leading zeros and their ten mantissa bits agree.
    """
    equal, chance = (a == b).mean(1), (shares_a * shares_b).sum(1) / 1024
    return ((equal - chance) / (1 - chance)).clip(0)


SIGNATURE = "doc_id long, n_shingles long, digest binary, regs binary"


def signatures(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, digest (of the set), regs of every row; a set without shingles has neither digest nor registers."""

    def start():
        probes = _probes()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, digests, regs, held = [], [], [], []

            def flush():
                regs.extend(x.tobytes() for x in registers(held, probes)) if held else None
                held.clear()

            where: list[int] = []
            for i, s in enumerate(shingle_sets(batch.column(1), words)):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                if len(s):
                    where.append(i)
                    held.append(s)
                    if len(held) >= 512:
                        flush()
            flush()
            out: list[bytes | None] = [None] * batch.num_rows
            for i, r in zip(where, regs, strict=True):
                out[i] = r
            return pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(out, pa.binary())], [c.split()[0] for c in SIGNATURE.split(", ")])

        return one

    return arrow_map(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), SIGNATURE, start)


def _exploded(classes: DataFrame) -> DataFrame:
    """(key, cid) of each band of each class."""

    def start():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            return pa.record_batch([pa.array(band_keys(regs).ravel()), pa.array(np.repeat(batch.column("cid").to_numpy(), BANDS))], ["key", "cid"])

        return one

    return arrow_map(classes.select("cid", "regs"), "key long, cid long", start)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it has few rows; rows of two or three numbers each."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose estimate is within MARGIN of the threshold."""
    a = classes.select(F.col("cid").alias("a"), F.col("regs").alias("regs_a"), F.col("n_shingles").alias("n_a"))
    b = classes.select(F.col("cid").alias("b"), F.col("regs").alias("regs_b"), F.col("n_shingles").alias("n_b"))

    def start():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("regs_a", "regs_b")]
            j = estimate(*regs, *(_shares(batch.column(c).to_numpy()) for c in ("n_a", "n_b")))
            return batch.select(["a", "b"]).filter(pa.array(j >= threshold - MARGIN))

        return one

    # sizes alone bound the similarity
    near = pairs.join(a, "a").join(b, "b").where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    return arrow_map(near.select("a", "b", "regs_a", "regs_b", "n_a", "n_b"), "a long, b long", start)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union.

    Sets of b go to the task of (a, salt), after a copy of a's own set; a task holds one set of a at a time. A leader has as many salts as those
    that meet it fill tasks.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(MET))).cast("long").alias("salts"))
    dealt = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
    own = dealt.select("a", "salt").distinct().join(sets.select(F.col("cid").alias("a"), "shingles"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "shingles")
    others = dealt.join(sets.select(F.col("cid").alias("b"), "shingles"), "b").select("a", "salt", "b", "shingles")
    rows = own.unionByName(others).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.uint64)
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, b, raw in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                own = np.frombuffer(raw, np.uint64)
                if b is None:
                    held = own
                    continue
                both = np.concatenate([held, own])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(held) + len(own) - common):
                    found.append((a, b))
            yield pa.record_batch([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return in_arrow(rows.select("a", "b", "shingles"), run, "a long, b long")


def _sets_of(cids: DataFrame, classes: DataFrame, docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(cid, shingles) of the classes in cids, from the text of one document each; an error if docs no longer has one of them."""
    wanted = stored(classes.join(cids, "cid", "left_semi").select("cid", F.coalesce("rep", F.lit(_NONE)).alias("key"), "digest"), "near-dup-wanted")
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("key"), F.col(text_col).alias("text"))

    def start():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [(c, s.tobytes()) for c, d, s in zip(batch.column("cid").to_pylist(), batch.column("digest").to_pylist(), shingle_sets(batch.column("text"), words), strict=True) if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == d]
            return pa.record_batch([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary())], ["cid", "shingles"])

        return one

    n = wanted.count()
    found = texts.join(_small(wanted, n), "key").select("cid", "digest", "text")
    sets = stored(arrow_map(found, "cid long, shingles binary", start).dropDuplicates(["cid"]), "near-dup-sets")
    discard(wanted)
    if sets.count() != n:
        raise RuntimeError(f"{n} classes are wanted, {sets.count()} have a text: ids or texts changed between two readings of the documents")
    return sets


class _Near:
    """Members with registers: which of others may be linked to member i by their estimates."""

    def __init__(self, threshold: float, data: list[bytes], sizes: np.ndarray, split: int):
        self.threshold, self.sizes, self.shares = threshold, sizes, _shares(sizes)
        self.regs = np.frombuffer(b"".join(data), np.uint16).reshape(len(data), REGISTERS)

    def hits(self, i: int, others: np.ndarray) -> np.ndarray:
        n, m = self.sizes[i], self.sizes[others]
        others = others[np.minimum(m, n) >= self.threshold * np.maximum(m, n)]
        return others[estimate(self.regs[i][None, :], self.regs[others], self.shares[i : i + 1], self.shares[others]) >= self.threshold - MARGIN]


class _Linked:
    """Members with sets: which of others are linked to member i, by products of the sets' incidence over hashes that two hold."""

    def __init__(self, percent: int, data: list[bytes], _: np.ndarray, split: int):
        sets = [np.frombuffer(d, np.uint64) for d in data]
        self.percent, self.sizes = percent, np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        often = count[column] > 1
        place = np.cumsum(count > 1) - 1
        owner, column, width = owner[often], place[column[often]], int((count > 1).sum())
        self.first = split if split < len(sets) else 0  # the right side begins here
        self.common = np.zeros((split, len(sets) - self.first), np.float32)
        for at in range(0, width, 1024):  # a slice of the hashes at a time
            inside = (column >= at) & (column < at + 1024)
            part = np.zeros((len(sets), min(1024, width - at)), np.float32)
            part[owner[inside], column[inside] - at] = 1
            self.common += part[:split] @ part[self.first :].T

    def hits(self, i: int, others: np.ndarray) -> np.ndarray:
        c = np.rint(self.common[i, others - self.first]).astype(np.int64)
        return others[100 * c >= self.percent * (self.sizes[i] + self.sizes[others] - c)]


def _size_class(threshold: float):
    """A class of n_shingles: sets that may be linked are of one class or of neighbouring ones. A class is wider by a millionth than that takes, so rounding does no harm."""
    return F.floor(F.log("n_shingles") / max(-math.log(threshold) * (1 + 1e-6), 0.01)).cast("long")


def _compared(members: DataFrame, make, threshold: float, of_labels: bool = False) -> DataFrame:
    """(a, b) that join labels of members (cluster, cid, label, n_shingles, data) of one cluster: a spanning forest of hits.

    A cluster of more than about BLOCK members or BLOCK_BYTES of data is cut by size, as sets whose sizes differ much aren't linked, and each
    size class into blocks, dealt by a hash of cid, so that a cluster is never counted through in one task. A task compares the members of one block,
    or those of one with those of another of the same or the next size, in memory, and no pair becomes a row but the forest's: fewer than the labels
    that meet there. What the forest joins already isn't compared again. A block is copied once for each block of its own and the neighbouring sizes.
    make(data, sizes, split) gives hits(i, others). a and b are cids, or labels if of_labels.
    """
    blocks = lambda n, size: F.ceil(F.greatest(n / F.lit(float(BLOCK)), size / F.lit(float(BLOCK_BYTES)))).cast("long")
    classed, cluster = members.withColumn("size", _size_class(threshold)), Window.partitionBy("cluster")
    sizes = classed.groupBy("cluster", "size").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("data")).alias("bytes"))
    sizes = sizes.select("cluster", "size", blocks(F.col("n"), F.col("bytes")).alias("blocks"), (blocks(F.sum("n").over(cluster), F.sum("bytes").over(cluster)) == 1).alias("one"))
    near = F.filter(F.collect_list(F.struct("size", "blocks")).over(cluster), lambda x: F.abs(x["size"] - F.col("size")) <= 1)
    name = lambda size, block: size * (1 << 40) + block
    others = F.flatten(F.transform(near, lambda x: F.transform(F.sequence(F.lit(0).cast("long"), x["blocks"] - 1), lambda b: name(x["size"], b))))
    told = sizes.select("cluster", "size", "blocks", "one", F.when(F.col("one"), F.array(F.lit(0).cast("long"))).otherwise(others).alias("others"))
    block = F.when(F.col("one"), F.lit(0).cast("long")).otherwise(name(F.col("size"), F.pmod(F.xxhash64("cid"), F.col("blocks"))))
    cut = classed.join(told, ["cluster", "size"]).withColumn("block", block)
    each = cut.withColumn("other", F.explode("others"))
    dealt = each.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "label", "n_shingles", "data")
    rows = dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "block", "cid")
    names = ("cluster", "i", "j", "block", "cid", "label", "n_shingles", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, found = None, [], []

        def close() -> None:
            if len(held) < 2:
                return
            blocks, cids, labels, sizes, data = (list(x) for x in zip(*held, strict=True))
            split = blocks.count(blocks[0])
            nodes, roots = labels if of_labels else cids, np.array(labels)
            if (roots == roots[0]).all():
                return
            test = make(data, np.array(sizes), split)
            for i in range(split):
                others = np.arange(split if split < len(held) else i + 1, len(held))
                others = others[roots[others] != roots[i]]
                for k in test.hits(i, others).tolist() if len(others) else ():
                    if roots[k] != roots[i]:
                        found.append((nodes[i], nodes[k]))
                        roots[roots == roots[k]] = roots[i]

        for batch in batches:
            for cluster, i, j, *member in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if (cluster, i, j) != current:
                    close()
                    current, held = (cluster, i, j), []
                held.append(member)
            if len(found) > 10_000:
                yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])
                found = []
        close()
        if found:
            yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return in_arrow(rows, run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of each node of an edge: label is the least node of its component.

    Every node points to its least neighbour; pointers jump until each reaches the root of its tree; edges are drawn between the roots
    and the same is done with what is left of them, which is little after the first round.
    """
    ends = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    rest, labels = stored(ends(edges), "near-dup-edges"), None
    while True:
        near = rest.union(rest.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label"))
        step = stored(near, "near-dup-labels")
        while True:
            up = step.select(F.col("node").alias("label"), F.col("label").alias("above"))
            jumped = stored(step.join(up, "label", "left").select("node", F.coalesce("above", "label").alias("label"), F.col("label").alias("old")), "near-dup-labels")
            discard(step)
            step = jumped
            if not jumped.where("old <> label").limit(1).count():
                break
        root = step.select("node", "label")
        left, right = root.select(F.col("node").alias("a"), F.col("label").alias("la")), root.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        less = stored(ends(rest.join(left, "a").join(right, "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))), "near-dup-edges")
        if labels is None:
            new = stored(root, "near-dup-labels")
        else:
            new = stored(labels.join(root.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left").select("node", F.coalesce("root", "label").alias("label")), "near-dup-labels")
            discard(labels)
        discard(rest, step)
        labels, rest = new, less
        if not rest.limit(1).count():
            discard(rest)
            return labels


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; component_id is the least doc_id of all that
    links reach, kept says whether that is the document's own. Texts that are null or without words have no shingles, keep their id
    and are kept. Null ids take part in linking but never name a component that has another; alone they are kept. Repeated rows
    are copies. Other columns are dropped; an empty table gives no rows.
    """
    threshold = percent / 100
    sig = stored(signatures(docs, words, id_col, text_col), "near-dup-signatures")
    grouped = sig.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"))
    classes = stored(grouped.withColumn("cid", F.monotonically_increasing_id()), "near-dup-classes")

    # what is known of a bucket comes from aggregates and joins, so that one of very many classes is never in one task
    # a set of n shingles and another one have at most n in common and at least n + 1 in all: below that size only equal sets are linked
    keys = stored(_exploded(classes.where(f"100 * n_shingles >= {percent} * (n_shingles + 1)")), "near-dup-keys")
    several = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = stored(keys.join(several, "key"), "near-dup-shared")
    discard(keys)
    degree = stored(shared.groupBy("cid").agg(F.sum(F.col("size") - 1).alias("degree")), "near-dup-degrees")
    active = stored(classes.join(degree.select("cid"), "cid", "left_semi").select("cid", "n_shingles", "regs"), "near-dup-active")

    # central classes first: the most central one of each of LEADERS shares of a bucket
    slot = F.pmod(F.xxhash64("cid"), F.lit(LEADERS))
    best = shared.join(degree, "cid").groupBy("key", slot.alias("slot")).agg(F.min(F.struct((-F.col("degree")).alias("less"), "cid")).alias("top"))
    heads = best.select("key", F.col("top.cid").alias("a"))
    met = shared.select("key", F.col("cid").alias("b")).join(heads, "key").where("a <> b")
    tried = stored(met.select("a", "b").distinct(), "near-dup-pairs")
    discard(degree)
    links = _verified(tried, active, classes, docs, words, percent, id_col, text_col)
    labels = components(links)
    discard(tried)

    # then those that are still apart: by estimates into clusters, whose sets are compared exactly
    apart = shared.where(f"size > {LEADERS}").select("key", "cid").join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("key", "cid", F.coalesce("label", "cid").alias("label"))
    apart = stored(apart, "near-dup-labelled")
    discard(shared, labels)
    split = apart.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    mixed = stored(apart.join(split, "key", "left_semi"), "near-dup-apart")
    near = stored(_compared(mixed.join(active, "cid").select(F.col("key").alias("cluster"), "cid", "label", "n_shingles", F.col("regs").alias("data")), partial(_Near, threshold), threshold, of_labels=True).distinct(), "near-dup-near")
    discard(apart, active)
    roots = components(near)
    clusters = roots.select(F.col("node").alias("label"), F.col("label").alias("cluster"))
    told = stored(clusters.join(mixed.select("cid", "label").distinct(), "label"), "near-dup-clusters")
    sets = _sets_of(told.select("cid"), classes, docs, words, id_col, text_col)
    more = stored(_compared(told.join(sets, "cid").select("cluster", "cid", "label", (F.length("shingles") / 8).cast("long").alias("n_shingles"), F.col("shingles").alias("data")), partial(_Linked, percent), threshold), "near-dup-links")
    discard(near, roots, mixed, told, sets)
    labels = components(links.union(more))

    known = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("digest", "rep", F.coalesce("label", "cid").alias("label"))
    least = known.groupBy("label").agg(F.min("rep").alias("component_id"))
    final = stored(known.join(least, "label").select("digest", "component_id"), "near-dup-components")
    discard(links, more, labels, classes)
    out = sig.select("doc_id", "n_shingles", "digest").join(final, "digest", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one document of each component: that of the least id; null ids come last, rows of one id in any order.

    The numbers are stored with the rows, as another job may split the same files otherwise and number them anew.
    """
    numbered = stored(docs.withColumn("near_dup_row", F.monotonically_increasing_id()), "near-dup-numbered")
    found = near_duplicates(numbered, words, percent, "near_dup_row", text_col).select(F.col("doc_id").alias("near_dup_row"), "component_id")
    ids = numbered.select("near_dup_row", F.col(id_col).alias("id"))
    rank = F.struct(F.col("id").isNull().alias("blank"), "id", "near_dup_row")
    told = stored(found.join(ids, "near_dup_row").select("component_id", "near_dup_row", rank.alias("rank")), "near-dup-ranks")
    firsts = told.groupBy("component_id").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = stored(told.join(firsts, "component_id").where("rank <> first").select("near_dup_row"), "near-dup-gone")
    return numbered.join(_small(gone, gone.count()), "near_dup_row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _verified(pairs: DataFrame, active: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs that are links: by estimate, then on the full sets."""
    likely = stored(_likely(pairs, active, percent / 100), "near-dup-likely")
    cids = likely.select(F.col("a").alias("cid")).union(likely.select("b")).distinct()
    sets = _sets_of(cids, classes, docs, words, id_col, text_col)
    links = stored(_confirmed(likely, sets, percent), "near-dup-links")
    discard(likely, sets)
    return links
