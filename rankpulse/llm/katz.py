"""Katz backoff language model over words.

Texts are read once and kept as chunks: some megabytes of texts as word hashes and codes. An n-gram is the 64-bit hash of its words, and
hashes are dealt to buckets by ranges, as many as keep what all chunks ask of one within BUCKET_KEYS. For each order a chunk asks the buckets for the counts of its distinct n-grams and tells how often
they stand in its training texts; a bucket adds up, answers, and writes its part of the table of that order. From the counts come the
Good-Turing discounts. Each n-gram has one owner among the chunks that asked for it; owners add an n-gram's discounted count and its
probability one order lower to its history, whose bucket makes of the sums the weight by which the history's distribution sums to one
exactly, writes the table of weights, and answers. Then a chunk has all it takes to evaluate the recursion for each of its tokens: the
discounted probability where the n-gram was seen, else the history's weight times the probability one order lower, down to the unigrams
and the mass of unseen words.

What is shuffled is blocks of sorted, delta-coded keys and their answers; chunks themselves stay in a bucketed table and are not moved.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encoders
from .common import discard, in_arrow, stored, work_dir
from .near_dup import _mix

#: Counts up to this are discounted.
CUTOFF = 5
#: Bytes of text in a chunk.
CHUNK_BYTES = 12 << 20
#: Keys that chunks may ask of one bucket: a task sorts them in memory, some 45 bytes each.
BUCKET_KEYS = 8 << 20
#: Keys of the end of a text and of what stands before its first word.
END, BEGIN = np.uint64(0x8F3D91C4A76B25E1), np.uint64(0x5C1E7F20B94DA863)
_STEP = np.uint64(0x9E3779B97F4A7C15)


# --- arrays as bytes ----------------------------------------------------------------------------------------------------


def pack(a: np.ndarray, ascending: bool = False) -> bytes:
    """An array of 8-byte numbers as compressed bytes: planes of equal significance, of differences if it ascends."""
    a = np.ascontiguousarray(a)
    raw = a.view(np.uint64)
    if ascending and len(raw):
        raw = np.concatenate([raw[:1], np.diff(raw)])
    planes = raw.view(np.uint8).reshape(-1, 8).T.tobytes() if a.dtype != np.float64 else raw.tobytes()
    return len(a).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def unpack(data: bytes, dtype, ascending: bool = False) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.Codec("zstd").decompress(data[8:], 8 * n, asbytes=True), np.uint8)
    if dtype == np.float64:
        return raw.view(np.float64)
    a = np.ascontiguousarray(raw.reshape(8, n).T).view(np.uint64).reshape(n)
    return (np.cumsum(a, dtype=np.uint64) if ascending else a).view(dtype)


def cut(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """(bucket, part) of sorted keys: bucket b has the b-th of equal ranges of hashes."""
    edges = np.searchsorted(keys, np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64), "left")
    edges = [0, *edges.tolist(), len(keys)]
    for b in range(buckets):
        if edges[b] < edges[b + 1]:
            yield b, slice(edges[b], edges[b + 1])


# --- chunks -------------------------------------------------------------------------------------------------------------


def word_hashes(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For parts of a column of texts the 64-bit hashes of all words, A-Z lower-cased, an end after each text, and each text's number of tokens."""
    for _, part in encoders.slices(column):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(part))
        flat = lists.flatten().dictionary_encode()
        names = flat.dictionary.to_pylist()
        hashes = np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in names], dtype=np.uint64)
        codes, edges = flat.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        word = codes != (names.index("") if "" in names else -1)
        ends = np.concatenate([[0], np.cumsum(word)])[edges[1:]]
        yield np.insert(hashes[codes[word]], ends, END), np.diff(ends, prepend=0) + 1


def chunks(docs: DataFrame) -> DataFrame:
    """chunk, tokens, ids, train, lengths, words, codes of docs (id, train, text): a row for some CHUNK_BYTES of text. Words are listed by frequency."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, train, tokens, lengths, size, made = [], [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, train, tokens, lengths, size, made
            words, codes, count = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            name = (TaskContext.get().partitionId() << 24) + made
            row = [[name], [len(codes)], [ids], [train], [pack(np.concatenate(lengths).astype(np.int64))], [pack(words[order])], [pack(rank[codes])]]
            ids, train, tokens, lengths, size, made = [], [], [], [], 0, made + 1
            return pa.record_batch([pa.array(x, t) for x, t in zip(row, schema.types, strict=True)], schema.names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            schema = pa.schema([("chunk", pa.int64()), ("tokens", pa.int64()), ("ids", pa.list_(id_type)), ("train", pa.list_(pa.bool_())), ("lengths", pa.binary()), ("words", pa.binary()), ("codes", pa.binary())])
            for t, n in word_hashes(batch.column(2)):
                tokens.append(t)
                lengths.append(n)
            ids += batch.column(0).to_pylist()
            train += batch.column(1).to_pylist()
            size += batch.column(2).nbytes
            if size >= CHUNK_BYTES:
                yield flush()
        if ids:
            yield flush()

    return in_arrow(docs.select("id", "train", "text"), run, f"chunk long, tokens long, ids array<{kind}>, train array<boolean>, lengths binary, words binary, codes binary")


class Text:
    """The tokens of a chunk, and per order its distinct n-grams and histories: sorted keys, a place of each, and the number at each token."""

    def __init__(self, lengths: bytes, words: bytes, codes: bytes):
        self.lengths = unpack(lengths, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.words, self.codes = unpack(words, np.uint64), unpack(codes, np.int64)
        self.tokens = self.words[self.codes]
        self.place = np.arange(len(self.tokens)) - np.repeat(self.starts, self.lengths)

    def _back(self, j: int) -> np.ndarray:
        if j == 0:
            return self.tokens
        out = np.full(len(self.tokens), BEGIN)
        out[j:] = self.tokens[:-j]
        out[self.place < j] = BEGIN
        return out

    def _key(self, first: int, last: int) -> np.ndarray:
        h = self._back(first)
        for j in range(first - 1, last - 1, -1):
            h = _mix(h + _STEP)
            h += self._back(j)
        return h if first == last else _mix(h)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if k > 1:
            return np.unique(self._key(k - 1, 0), return_index=True, return_inverse=True)
        keys, number = _ranked(self.words)
        at = number[self.codes]
        place = np.empty(len(keys), np.int64)
        place[at[::-1]] = np.arange(len(at) - 1, -1, -1)  # the first place is written last
        return keys, place, at

    def histories(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k > 2:
            return np.unique(self._key(k - 1, 1), return_inverse=True)
        # the words themselves, but ends, and what stands before the first
        before = np.concatenate([[len(self.words)], self.codes[:-1]])
        before[self.place == 0] = len(self.words)
        used = np.flatnonzero(np.bincount(before, minlength=len(self.words) + 1))
        keys, number = _ranked(np.append(self.words, BEGIN)[used])
        of = np.zeros(len(self.words) + 1, np.int64)
        of[used] = number
        return keys, of[before]


def _ranked(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words in order, and the place of each there."""
    by = np.argsort(words)
    number = np.empty(len(words), np.int64)
    number[by] = np.arange(len(words))
    return words[by], number


def _by_chunk(df: DataFrame) -> DataFrame:
    """df as a table bucketed by chunk, which joins on chunk read in place. It has a name in the catalog until _drop()."""
    spark, name, path = df.sparkSession, f"katz_chunks_{uuid.uuid4().hex}", work_dir(df.sparkSession, "katz-chunks")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, "chunk").sortBy("chunk").format("parquet").option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.name, out.stored_at = name, path
    return out


def _drop(held: DataFrame) -> None:
    held.sparkSession.sql(f"drop table {held.name}")
    discard(held)


# --- the model ----------------------------------------------------------------------------------------------------------


def good_turing(of: dict[int, int]) -> dict[int, float]:
    """Discount of each count 1..CUTOFF, from the numbers of n-grams of each count; where those give none in (0, 1), (c - 0.5) / c."""
    n = lambda c: of.get(c, 0)
    out, share = {}, (CUTOFF + 1) * n(CUTOFF + 1) / n(1) if n(1) else 1.0
    for c in range(1, CUTOFF + 1):
        d = ((c + 1) * n(c + 1) / (c * n(c)) - share) / (1 - share) if n(c) and share < 1 else 0.0
        out[c] = d if 0 < d < 1 else (c - 0.5) / c
    return out


@dataclass
class Model:
    """Tables under path, in rows of a bucket each: counts (order, keys, values) and weights=k (keys, scale, weight of histories).

    tokens, types: N and V of the training texts; unseen: the mass of unseen words; discounts: by order the factor of each count.
    """

    path: str
    order: int
    tokens: int = 0
    types: int = 0
    unseen: float = 1.0
    first: float = 1.0
    discounts: dict[int, list[float]] = field(default_factory=dict)

    def counts(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/counts").where("kind = 'table'")

    def weights(self, spark: SparkSession, k: int) -> DataFrame:
        return spark.read.parquet(f"{self.path}/weights={k}").where("kind = 'table'")

    def take(self, tallies: dict[int, list[int]]) -> None:
        """Discounts and unigram mass from each order's numbers of n-grams of counts 1 .. CUTOFF + 1, its tokens and its types."""
        for k in range(1, self.order + 1):
            t = tallies.get(k, [0] * (CUTOFF + 3))
            d = good_turing({c: t[c - 1] for c in range(1, CUTOFF + 2)})
            self.discounts[k] = [0.0, *(d[c] for c in range(1, CUTOFF + 1)), 1.0]
            if k == 1:
                self.tokens, self.types = t[-2], t[-1]
                left = self.tokens - sum((1 - d[c]) * c * t[c - 1] for c in range(1, CUTOFF + 1))
                # a rest for unseen words, even if nothing was discounted
                self.first = min(1.0, (self.tokens + 0.5) / (self.tokens + 1) * self.tokens / left) / self.tokens if self.tokens else 0.0
                self.unseen = 1 - self.first * left if self.tokens else 1.0

    def discounted(self, k: int, c: np.ndarray) -> np.ndarray:
        return np.array(self.discounts[k])[np.minimum(c, CUTOFF + 1)] * c


class Answers:
    """What buckets told a chunk: counts by order, and scale and weight of its histories by order."""

    def __init__(self, replies: list[dict]):
        parts: dict[tuple, list] = {}
        for r in sorted(replies, key=lambda r: (r["kind"], r["order"], r["bucket"])):
            parts.setdefault((r["kind"], r["order"]), []).append(r)
        whole = lambda kind, k, name, dtype: np.concatenate([unpack(r[name], dtype) for r in parts[kind, k]])
        told = {k: whole("count", k, "a", np.int64) for kind, k in parts if kind == "count"}
        self.count, self.own = {k: v >> 1 for k, v in told.items()}, {k: (v & 1).astype(bool) for k, v in told.items()}
        self.scale, self.weight = ({k: whole("weight", k, n, np.float64) for kind, k in parts if kind == "weight"} for n in ("a", "b"))


def chances(model: Model, text: Text, told: Answers, order: int) -> np.ndarray:
    """The probability of each token after the words before it, by the recursion up to an order."""
    c = told.count[1][text.grams(1)[2]]
    p = np.where(c > 0, model.discounted(1, c) * model.first, model.unseen)
    for k in range(2, order + 1):
        c, h = told.count[k][text.grams(k)[2]], text.histories(k)[1]
        p = np.where(c > 0, model.discounted(k, c) * told.scale[k][h], told.weight[k][h] * p)
    return p


# --- questions and answers ----------------------------------------------------------------------------------------------

_ASK = "order int, bucket int, chunk long, keys binary, a binary, b binary, c binary"
_TELL = "kind string, order int, bucket int, chunk long, keys binary, a binary, b binary, tally array<long>"


def _rows(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    columns = [x.split() for x in names.split(", ")]
    return pa.record_batch([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(columns)], [n for n, _ in columns])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Text]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
            yield row, Text(row["lengths"], row["words"], row["codes"])


def _ask_counts(held: DataFrame, order: int, buckets: int) -> DataFrame:
    """Each chunk's distinct n-grams of each order and bucket, and how often they stand in its training texts."""

    def run(batches):
        for row, text in _texts(batches):
            train = np.repeat(np.array(row["train"], dtype=bool), text.lengths)
            for k in range(1, order + 1):
                keys, _, at = text.grams(k)
                n = np.bincount(at[train], minlength=len(keys)).astype(np.int64)
                for b, part in cut(keys, buckets):
                    yield _rows([(k, b, row["chunk"], pack(keys[part], True), pack(n[part]), None, None)], _ASK)

    return in_arrow(held.select("chunk", "train", "lengths", "words", "codes"), run, _ASK)


def _given(table: DataFrame, buckets: int) -> DataFrame:
    """A model's rows (order, keys, a, b) as blocks without a chunk, cut anew: a run has the buckets that its own texts call for."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, dtype = unpack(row["keys"], np.uint64, True), np.int64 if row["b"] is None else np.float64
                values = [None if row[n] is None else unpack(row[n], dtype) for n in ("a", "b")]
                for b, part in cut(keys, buckets):
                    yield _rows([(row["order"], b, None, pack(keys[part], True), *(None if x is None else pack(x[part]) for x in values), None)], _ASK)

    return in_arrow(table.select("order", "keys", "a", "b"), run, _ASK)


def _answered(asked: DataFrame, path: str, answer, orders: range, buckets: int) -> DataFrame:
    """The answers of all buckets, written under path: kinds reply (to chunks) and table (the model's part). answer(blocks) gives rows of _TELL
    for the blocks of one order and bucket, those of a given model (without chunk) first. Each bucket of each order is a task of its own."""
    task = ((F.col("order") - orders.start) * buckets + F.col("bucket")).cast("int")
    dealt = asked.repartitionById(len(orders) * buckets, task).sortWithinPartitions("order", "bucket", F.col("chunk").asc_nulls_first())

    def run(batches):
        current, blocks = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["order"], row["bucket"]) != current:
                    if blocks:
                        yield _rows(answer(blocks), _TELL)
                    current, blocks = (row["order"], row["bucket"]), []
                blocks.append(row)
        if blocks:
            yield _rows(answer(blocks), _TELL)

    in_arrow(dealt, run, _TELL).write.partitionBy("kind").parquet(path)
    return asked.sparkSession.read.schema(_TELL).parquet(path)


def _grouped(blocks: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all blocks one after the other; the order that sorts them; where each distinct one begins there; its number for each."""
    keys = np.concatenate([unpack(b["keys"], np.uint64, True) for b in blocks])
    by = np.argsort(keys, kind="stable")
    first = np.concatenate([[True], np.diff(keys[by]) != 0]) if len(keys) else np.zeros(0, bool)
    number = np.empty(len(keys), np.int64)
    number[by] = np.cumsum(first) - 1
    return keys, by, np.flatnonzero(first), number


def _split(blocks: list[dict]) -> Iterator[tuple[dict, slice]]:
    at = 0
    for b in blocks:
        n = int.from_bytes(b["keys"][:8], "little")
        yield b, slice(at, at + n)
        at += n


def _count(blocks: list[dict]) -> list[tuple]:
    """Counts of a bucket's n-grams to each chunk, with a bit for the first chunk that asks: it owns the n-gram."""
    keys, by, first, number = _grouped(blocks)
    total = np.add.reduceat(np.concatenate([unpack(b["a"], np.int64) for b in blocks])[by], first) if len(keys) else np.zeros(0, np.int64)
    own = np.zeros(len(keys), bool)
    own[by[first]] = True
    k, bucket = blocks[0]["order"], blocks[0]["bucket"]
    told = total[number] << 1 | own
    out = [("reply", k, bucket, b["chunk"], None, pack(told[part]), None, None) for b, part in _split(blocks) if b["chunk"] is not None]
    seen = total > 0
    c = total[seen]
    tally = [*np.bincount(np.minimum(c, CUTOFF + 2), minlength=CUTOFF + 3)[1 : CUTOFF + 2].tolist(), int(c.sum()), len(c)]
    return [*out, ("table", k, bucket, None, pack(keys[by[first]][seen], True), pack(c), None, tally)]


def _weigh(blocks: list[dict]) -> list[tuple]:
    """Scale and weight of a bucket's histories, from the sums of the chunks or from the model's block."""
    keys, by, first, number = _grouped(blocks)
    scale, weight = np.zeros(len(first)), np.ones(len(first))
    given = [(b, part) for b, part in _split(blocks) if b["chunk"] is None]
    if given:
        for b, part in given:
            scale[number[part]], weight[number[part]] = unpack(b["a"], np.float64), unpack(b["b"], np.float64)
    elif blocks[0]["c"] is not None:
        total, dc, mass = (np.add.reduceat(np.concatenate([unpack(b[n], t) for b in blocks])[by], first) for n, t in (("a", np.int64), ("b", np.float64), ("c", np.float64)))
        seen = total > 0
        # what a history's followers leave: the discounts' mass, or 1 in (total + 1) where those are nought
        scale[seen] = np.minimum(1.0, total[seen] / (total[seen] + 1) * total[seen] / dc[seen]) / total[seen]
        weight[seen] = (1 - scale[seen] * dc[seen]) / (1 - mass[seen])
    k, bucket = blocks[0]["order"], blocks[0]["bucket"]
    out = [("reply", k, bucket, b["chunk"], None, pack(scale[number[part]]), pack(weight[number[part]]), None) for b, part in _split(blocks) if b["chunk"] is not None]
    seen = scale > 0
    return [*out, ("table", k, bucket, None, pack(keys[by[first]][seen], True), pack(scale[seen]), pack(weight[seen]), None)]


def _ask_weights(known: DataFrame, model: Model, k: int, buckets: int, fitting: bool) -> DataFrame:
    """Each chunk's distinct histories of order k; in fitting with the sums over the n-grams it owns."""

    def run(batches):
        for row, text in _texts(batches):
            keys, at = text.histories(k)
            sums = None
            if fitting:
                told = Answers(row["replies"])
                _, place, _ = text.grams(k)
                c = told.count[k]
                mine = told.own[k] & (c > 0)
                c, place = c[mine], place[mine]
                below, h = chances(model, text, told, k - 1)[place], at[place]
                sums = [np.bincount(h, x, len(keys)) for x in (c, model.discounted(k, c), below)]
                sums[0] = np.rint(sums[0]).astype(np.int64)
            for b, part in cut(keys, buckets):
                yield _rows([(k, b, row["chunk"], pack(keys[part], True), *((pack(x[part]) for x in sums) if sums else (None, None, None)))], _ASK)

    return in_arrow(known, run, _ASK)


def _known(held: DataFrame, replies: list[tuple[str, DataFrame]]) -> DataFrame:
    """Chunks with all answers to them."""
    rows = None
    for kind, df in replies:
        one = df.where("kind = 'reply'").select("chunk", F.struct(F.lit(kind).alias("kind"), "order", "bucket", "a", "b").alias("r"))
        rows = one if rows is None else rows.unionByName(one)
    return held.join(rows.groupBy("chunk").agg(F.collect_list("r").alias("replies")), "chunk")


def _scored(known: DataFrame, model: Model) -> DataFrame:
    kind = known.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row, text = next(_texts(iter([one.select(["chunk", "lengths", "words", "codes", "replies"])])))
                told = Answers(row["replies"])
                c = told.count[1][text.grams(1)[2]]
                add = lambda x: np.add.reduceat(x, text.starts)  # noqa: B023, E731
                score = add(np.log10(chances(model, text, told, model.order)))
                base = add(np.log10((c + 1) / (model.tokens + model.types + 1)))
                columns = [one.column("ids").flatten(), one.column("train").flatten(), text.lengths, add((c > 0).astype(np.int64)), base, score]
                yield pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], ["id", "train", "n_tokens", "n_known", "base_score", "score"])

    return in_arrow(known, run, f"id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double")


def _run(docs: DataFrame, order: int, path: str, given: Model | None, score_: bool) -> tuple[Model, DataFrame | None]:
    """The rounds over docs (id, train, text): counts, then weights of orders 2 .. order, then scores. A given model answers instead of the texts."""
    spark = docs.sparkSession
    model = given or Model(path, order)
    held = _by_chunk(chunks(docs))
    try:
        # no chunk asks for more keys of an order than it has tokens
        tokens = held.agg(F.sum("tokens")).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // BUCKET_KEYS))
        asked = _ask_counts(held, order, buckets)
        if given:
            asked = asked.unionByName(_given(given.counts(spark), buckets))
        replies = [("count", _answered(asked, f"{path}/counts", _count, range(1, order + 1), buckets))]
        if not given:
            tallies = replies[0][1].where("kind = 'table'").groupBy("order").agg(*[F.sum(F.col("tally")[i]).alias(f"t{i}") for i in range(CUTOFF + 3)]).collect()
            model.take({r["order"]: list(r)[1:] for r in tallies})
        for k in range(2, order + 1):
            asked = _ask_weights(_known(held, replies), model, k, buckets, not given)
            if given:
                asked = asked.unionByName(_given(given.weights(spark, k), buckets))
            replies.append(("weight", _answered(asked, f"{path}/weights={k}", _weigh, range(k, k + 1), buckets)))
        return model, stored(_scored(_known(held, replies), model), "katz-scores") if score_ else None
    finally:
        _drop(held)


def fit(docs: DataFrame, order: int = 2, path: str | None = None) -> Model:
    """Train on all rows of docs (text; other columns don't matter) and write the tables. Null texts are empty: their end counts. Repeated rows
    count as often as they stand. Without rows only unseen words have mass."""
    rows = docs.select(F.lit(0).cast("long").alias("id"), F.lit(True).alias("train"), "text")
    return _run(rows, order, path or work_dir(docs.sparkSession, "katz"), None, False)[0]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """row, n_tokens, n_known, base_score, score of every row of docs (row, text) by a model's tables. A null or empty text is its end alone;
    null and repeated row values are kept; an empty table gives no rows."""
    rows = docs.select(F.col("row").alias("id"), F.lit(False).alias("train"), "text")
    out = _run(rows, model.order, work_dir(docs.sparkSession, "katz-asked"), model, True)[1]
    return out.select(F.col("id").alias("row"), "n_tokens", "n_known", "base_score", "score")


def score_documents(docs: DataFrame, held_out, order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; the model learns from rows not held out.

    Fitting and scoring share their rounds: a chunk asks once for what both need. A null or empty text is its end alone. Null ids are kept,
    repeated rows count as often as they stand, other columns are dropped; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), (~held_out).alias("train"), F.col(text_col).alias("text"))
    model, out = _run(rows, order, work_dir(docs.sparkSession, "katz"), None, True)
    return out.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
