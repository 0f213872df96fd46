"""Alignment of two tokenizers over one corpus, in Arrow tables within a task and in Spark's tables between tasks.

Byte-level ids (A) and pieces (B) of a text cover the same bytes. List columns of ids are flattened beside their parent indices; cumulative sums of
token lengths, restarted at each document, are the tokens' ends; an Acero hash join of both sides on (document, end) finds the places where
both end, which cut a document into groups. A pair of ids is linked where its tokens share a group.

A batch of documents is a chunk. Its distinct pairs, with the number of its documents that hold each, come out of Table.group_by and are merged by
Spark into counts of the corpus; each chunk gets the counts of its own pairs back. So what is shuffled is a chunk's distinct pairs, not its links,
and each text is encoded once: what a chunk must know of its documents is stored as numbers of its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import encoders
from .common import discard, in_arrow, stored

#: Bytes of text in a chunk: a task holds some hundred bytes of arrays a byte of it.
CHUNK_BYTES = 2 << 20
#: A group of more links than this is counted by distinct ids before its links are formed, and at most so many distinct links are formed at once.
WIDE, AT_ONCE = 64, 2_000_000

_CHUNK = "chunk long, kind int, idx int, a int, b int, docs long, n_pairs int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
_NAMES = [c.split()[0] for c in _CHUNK.split(", ")]
_DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Side:
    """Ids and bytes of a tokenizer's tokens. MARKS may follow an id where groups are written."""

    MARKS = (",", "|", ";", "")

    def __init__(self, encoder, tokens: pa.Array):
        self.encoder, self.tokens, self.size = encoder, tokens, len(tokens)
        self.lengths = pc.binary_length(tokens).to_numpy().astype(np.int64)

    def ids(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text; nulls are empty texts."""
        packed = [bytes(x) for x in self.encoder.each(texts)]
        offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.uint32).astype(np.int32)))

    def joined(self, lists: pa.ListArray) -> list[memoryview]:
        """The bytes of each list's tokens, one after the other."""
        ids = lists.flatten()
        data = memoryview(self.tokens.take(ids).buffers()[2] or b"").cast("B") if len(ids) else memoryview(b"")
        ends = np.concatenate([[0], np.cumsum(self.lengths[ids.to_numpy()])])[lists.offsets.to_numpy()].tolist()
        return [data[x:y] for x, y in zip(ends, ends[1:], strict=False)]


class Aligner:
    """Both sides. a_path: a `tokenizers` file of byte-level BPE, a_ranks: its vocabulary as ranks, b_path: a sentencepiece file.

    decimals: each id of A, then of B, as text with each of the marks after it.
    """

    def __init__(self, a_path: str, a_ranks: str, pattern: str, b_path: str):
        a = encoders.ByteLevel(a_path, a_ranks, pattern, specials=False)
        b = encoders.PieceIds(b_path)
        self.a, self.b = Side(a, a.tokens()), Side(b, b.tokens())
        self.decimals = pa.array((f"{i}{m}".encode() for side in (self.a, self.b) for m in Side.MARKS for i in range(side.size)), pa.binary())

    def lists(self, texts: pa.Array) -> tuple[pa.ListArray, pa.ListArray]:
        """Ids of A and of B; none for a text that is null or empty, or whose tokens' bytes aren't those of the text after a space."""
        texts = pc.fill_null(texts, "")
        spaced = pc.binary_join_element_wise(" ", texts, "")
        a, b = self.a.ids(spaced), self.b.ids(texts)
        there = pc.not_equal(texts, "").to_pylist()
        same = [t and x == y == s.encode("utf-8", "surrogatepass") for t, x, y, s in zip(there, self.a.joined(a), self.b.joined(b), spaced.to_pylist(), strict=True)]
        if not all(same):
            keep = pa.array(same)
            none = pa.scalar([], a.type)
            a, b = (pc.if_else(keep, x, none) for x in (a, b))
        return a, b


def ends(lists: pa.ListArray, lengths: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Flattened ids, their parents and the byte where each token ends in its own document."""
    ids, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    running = pc.cumulative_sum(pc.take(pa.array(lengths), ids))
    # a document's segment starts where the one before ended
    firsts = lists.value_lengths().to_numpy(zero_copy_only=False).cumsum()[:-1]
    before = pa.array(np.concatenate([[0], np.concatenate([[0], running.to_numpy()])[firsts]]).astype(np.int64))
    return ids, parents, pc.subtract(running, pc.take(before, parents))


def _pairs(doc: np.ndarray, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, width: int) -> pa.Table:
    """(key, times): how often each document has each pair of ids linked; key is document * 2^32 + a * width + b.

    doc, na, nb: of each group; group_a, group_b: of each token. Groups of one token a side are pairs as they stand, narrow ones are joined on their
    number, wide ones after their equal ids are counted and in parts of the ids of A that make AT_ONCE rows each.
    """
    key = lambda g, x, y: doc[g].astype(np.int64) << 32 | x.astype(np.int64) * width + y
    links, one = na * nb, (na == 1) & (nb == 1)
    in_a, in_b = one[group_a], one[group_b]
    keys, times = [key(group_a[in_a], a[in_a], b[in_b])], [np.ones(int(one.sum()), np.int64)]

    def joined(x: pa.Table, y: pa.Table) -> None:
        if not x.num_rows or not y.num_rows:
            return
        got = x.join(y, "g", join_type="inner", use_threads=False)
        g, i, j, n, m = (got.column(c).to_numpy() for c in ("g", "a", "b", "n", "m"))
        keys.append(key(g, i, j))
        times.append(n * m)

    def side(group: np.ndarray, ids: np.ndarray, which: np.ndarray, name: str, count: str) -> pa.Table:
        at = which[group]
        return pa.table({"g": group[at], name: ids[at], count: np.ones(int(at.sum()), np.int64)})

    def counted(t: pa.Table, name: str, count: str) -> pa.Table:
        return t.group_by(["g", name], use_threads=False).aggregate([(count, "sum")]).rename_columns(["g", name, count])

    narrow, wide = ~one & (links <= WIDE), links > WIDE
    joined(side(group_a, a, narrow, "a", "n"), side(group_b, b, narrow, "b", "m"))
    if wide.any():
        x, y = counted(side(group_a, a, wide, "a", "n"), "a", "n"), counted(side(group_b, b, wide, "b", "m"), "b", "m")
        distinct = [np.bincount(t.column("g").to_numpy(), minlength=len(doc)) for t in (x, y)]
        parts = int((distinct[0] * distinct[1]).sum()) // AT_ONCE + 1
        part = x.column("a").to_numpy() % parts
        for k in range(parts):
            joined(x.filter(pa.array(part == k)), y)
            if parts > 1:  # equal pairs of one document before the next part
                done = _summed(np.concatenate(keys), np.concatenate(times))
                keys[:], times[:] = [done.column("key").to_numpy()], [done.column("times").to_numpy()]
    return _summed(np.concatenate(keys), np.concatenate(times))


def _summed(keys: np.ndarray, times: np.ndarray) -> pa.Table:
    return pa.table({"key": keys, "times": times}).group_by("key", use_threads=False).aggregate([("times", "sum")]).rename_columns(["key", "times"])


def align_batch(aligner: Aligner, ids: pa.Array, texts: pa.Array, chunk: int) -> Iterator[pa.RecordBatch]:
    """The chunk of a batch: its distinct pairs (kind 0), then its documents (kind 1)."""
    width, docs = aligner.b.size, len(texts)
    lists = aligner.lists(texts)
    (a, parent_a, end_a), (b, parent_b, end_b) = ends(lists[0], aligner.a.lengths), ends(lists[1], aligner.b.lengths)
    stride = int(pc.max(end_a).as_py() or 0) + 1
    place = lambda parent, end: pc.add(pc.multiply(parent, stride), end)
    left = pa.table({"at": place(parent_a, end_a), "i": np.arange(len(a))})
    right = pa.table({"at": place(parent_b, end_b), "j": np.arange(len(b))})
    del end_a, end_b
    cuts = left.join(right, "at", join_type="inner", use_threads=False)
    del left, right
    last_a, last_b = (np.sort(cuts.column(c).to_numpy()) for c in ("i", "j"))  # a group's last tokens
    doc, a, b = parent_a.to_numpy()[last_a], a.to_numpy(), b.to_numpy()
    del cuts, lists, parent_a, parent_b
    na, nb = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    pairs = _pairs(doc, a, b, na, nb, *(np.repeat(np.arange(len(doc), dtype=np.int32), n) for n in (na, nb)), width)
    key, times = pairs.column("key").to_numpy(), pairs.column("times").to_numpy()
    order = np.argsort(key)
    key, times = key[order], times[order]
    del pairs, order
    # partial counts: how many documents of the chunk hold each pair
    partial = pa.table({"pair": key & 0xFFFFFFFF}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
    pair = partial.column("pair").combine_chunks()
    number = pc.index_in(pa.array(key & 0xFFFFFFFF), value_set=pair).to_numpy()
    x = pair.to_numpy()
    none = lambda n, kind: pa.nulls(n, kind)
    n = len(x)
    fixed = lambda value, n, kind: pa.array(np.full(n, value), kind)
    yield pa.record_batch(
        [fixed(chunk, n, pa.int64()), fixed(0, n, pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(x // width, pa.int32()), pa.array(x % width, pa.int32())]
        + [partial.column("count_all").combine_chunks().cast(pa.int64()), fixed(n, n, pa.int32()), *[none(n, pa.int64())] * 5, none(n, pa.string()), none(n, pa.binary()), none(n, pa.binary())],
        _NAMES,
    )
    bounds = np.searchsorted(key >> 32, np.arange(docs + 1)).tolist()
    number, times = number.astype(np.uint16 if n <= 1 << 16 else np.uint32), times.astype(np.min_scalar_type(int(times.max(initial=0))))
    numbers, counts = ([v[s:e].tobytes() for s, e in zip(bounds, bounds[1:], strict=False)] for v in (number, times))
    per = lambda weights: pa.array(np.bincount(doc, weights, docs).astype(np.int64))
    yield pa.record_batch(
        [fixed(chunk, docs, pa.int64()), fixed(1, docs, pa.int32()), *[none(docs, pa.int32())] * 3, none(docs, pa.int64()), fixed(n, docs, pa.int32()), ids]
        + [per(na), per(nb), per(None), per(na * nb), pa.array(_digests(aligner, a, b, doc, na, nb, docs)), pa.array(numbers, pa.binary()), pa.array(counts, pa.binary())],
        _NAMES,
    )


def _digests(aligner: Aligner, a: np.ndarray, b: np.ndarray, doc: np.ndarray, na: np.ndarray, nb: np.ndarray, docs: int) -> list[str]:
    """SHA-256 of `a1,a2|b1;a3|b2,b3` of each document, the empty string of one without tokens."""
    comma, bar, semicolon, nothing = range(4)
    size_a, size_b = aligner.a.size, aligner.b.size
    ends_a, ends_b = np.cumsum(na), np.cumsum(nb)
    mark_a, mark_b = np.full(len(a), comma), np.full(len(b), comma)
    mark_a[ends_a - 1] = bar
    mark_b[ends_b - 1] = np.where(np.append(doc[1:] != doc[:-1], True), nothing, semicolon) if len(doc) else 0
    # a token of A stands after the tokens of B of the groups before, one of B after those of A up to its own group
    written = np.empty(len(a) + len(b), np.int64)
    written[np.arange(len(a)) + np.repeat(ends_b - nb, na)] = mark_a * size_a + a
    written[np.arange(len(b)) + np.repeat(ends_a, nb)] = 4 * size_a + mark_b * size_b + b
    text = aligner.decimals.take(pa.array(written))
    data, offsets = memoryview(text.buffers()[2] or b""), np.frombuffer(text.buffers()[1], np.int32)
    tokens = np.concatenate([[0], np.cumsum(np.bincount(doc, na + nb, docs).astype(np.int64))])
    at = offsets[tokens].tolist() if len(written) else [0] * (docs + 1)
    return [hashlib.sha256(data[s:e]).hexdigest() if e > s else "" for s, e in zip(at, at[1:], strict=False)]


def chunks(docs: DataFrame, a_path: str, a_ranks: str, pattern: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of all documents, stored: rows of pairs (kind 0) and of documents (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, task = encoders.shared(Aligner, a_path, a_ranks, pattern, b_path), TaskContext.get().partitionId()
        at = 0
        for batch in batches:
            for start, texts in encoders.slices(batch.column(1), CHUNK_BYTES):
                yield from align_batch(aligner, batch.column(0).slice(start, len(texts)), texts, task << 32 | at)
                at += 1
                pa.default_memory_pool().release_unused()

    return stored(in_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, _CHUNK), "alignment-chunks")


def pair_counts(told: DataFrame) -> DataFrame:
    """a, b, count, best: how many documents hold each linked pair of ids, and whether that is the most that its A id has."""
    total = stored(told.where("kind = 0").groupBy("a", "b").agg(F.sum("docs").alias("count")), "alignment-counts")
    most = total.groupBy("a").agg(F.max("count").alias("most"))
    return total.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def rated(told: DataFrame, counts: DataFrame) -> DataFrame:
    """The documents of chunks() with the sums over their links of what pair_counts() says."""
    answers = told.where("kind = 0").select("chunk", "idx", "a", "b").join(counts, ["a", "b"]).select("chunk", F.lit(0).alias("kind"), "idx", "count", "best")
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    rows = answers.unionByName(told.where("kind = 1").select("chunk", "kind", "n_pairs", *kept), allowMissingColumns=True)
    dealt = rows.repartition("chunk").sortWithinPartitions("chunk", "kind").select("chunk", "kind", "idx", "count", "best", "n_pairs", *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, known = None, [], None

        def answer(part: pa.RecordBatch) -> pa.RecordBatch:
            best, total = [], []
            for p, t in zip(part.column("pairs"), part.column("times"), strict=True):
                p, t = p.as_buffer(), t.as_buffer()
                number = np.frombuffer(p, np.uint16 if part.column("n_pairs")[0].as_py() <= 1 << 16 else np.uint32)
                times = np.frombuffer(t, f"u{t.size // len(number)}").astype(np.int64) if len(number) else np.zeros(0, np.int64)
                total.append(int((times * known[0][number]).sum()))
                best.append(int(times[known[1][number]].sum()))
            got = [part.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            return pa.record_batch([*got, pa.array(best, pa.int64()), pa.array(total, pa.int64()), part.column("groups_sha256")], [c.split()[0] for c in _DOCUMENT.split(", ")])

        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column("chunk").to_numpy(), batch.column("kind").to_numpy()], 1)
            edges = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist(), len(place)]
            for s, e in zip(edges, edges[1:], strict=False):
                chunk, kind = place[s].tolist()
                if chunk != current:
                    current, held, known = chunk, [], None
                part = batch.slice(s, e - s)
                if kind == 0:
                    held.append(tuple(part.column(c).to_numpy(zero_copy_only=False) for c in ("idx", "count", "best")))
                    continue
                if known is None:
                    n = part.column("n_pairs")[0].as_py()
                    known, held = (np.zeros(n, np.int64), np.zeros(n, bool)), held
                    if sum(len(h[0]) for h in held) != n:
                        raise RuntimeError(f"a chunk has {n} pairs, {sum(len(h[0]) for h in held)} have a count")
                    for idx, count, best in held:
                        known[0][idx], known[1][idx] = count, best
                    held = []
                yield answer(part)

    return in_arrow(dealt, run, _DOCUMENT)


def align(docs: DataFrame, a_path: str, a_ranks: str, pattern: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    n_links counts the pairs of an A and a B token that share a group, n_best those whose ids are linked in more documents than any other pair of their
    A id (ties included), count_sum adds up in how many documents each link's ids are linked. Special strings in texts are plain text. Texts that are null
    or empty, or that a tokenizer doesn't give back byte for byte, have zeros and an empty digest. Rows are documents: a repeated row counts again, a
    null id is kept. Other columns are dropped; an empty table gives no rows.
    """
    told = chunks(docs, a_path, a_ranks, pattern, b_path, id_col, text_col)
    counts = stored(pair_counts(told), "alignment-rated")
    out = stored(rated(told, counts), "alignment-documents")
    discard(told, counts)
    return out
