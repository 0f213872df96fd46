"""Language identification by error-correcting output codes.

Every language has a codeword; for each bit a binary n-gram classifier (naive Bayes log-odds over hashed character n-grams) says to
which side a text leans. Decoding adds up, for every language, the logistic loss of the bits against its codeword, each bit
weighted by how well it parts the training documents; the language of least loss wins, and a near tie is flagged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, in_arrow

BUCKETS = 1 << 15
#: Characters that are turned into n-grams at once.
PART = 300_000
UNDETERMINED = "und"


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1 and -1, no two alike: all splits in two for up to 5 languages, else the best of many random codes."""
    if n <= 5:
        columns = [[1, *(1 if k >> j & 1 else -1 for j in range(n - 1))] for k in range(max(0, 2 ** (n - 1) - 1))]
        return np.array(columns, dtype=np.int64).reshape(len(columns), n).T
    bits = max(15, int(np.ceil(10 * np.log2(n))))
    random, best, most = np.random.default_rng(seed), None, -1
    for _ in range(50):
        code = random.integers(0, 2, (n, bits)) * 2 - 1
        code[:, np.abs(code.sum(0)) == n] *= np.where(np.arange(n) % 2, 1, -1)[:, None]
        least = int(min((code[i] != code[j]).sum() for i in range(n) for j in range(i)))
        if least > most:
            best, most = code, least
    return best


def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(1 << 16)])


class Grams:
    """Hashed 1-, 2- and 3-grams of lower-case letters; all else is one boundary mark."""

    def __init__(self):
        self.letter = _letters()

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes of all texts' n-grams as three rows, where each text starts, whether it has a letter)."""
        lower = [x.lower() for x in texts]
        # a mark before each text and two after it, so that no n-gram that counts reaches into the next one; one more ends the last
        sizes = np.array([len(x) + 3 for x in lower])
        joined = "   ".join(["", *lower, ""])[2:] if lower else ""
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        small = np.minimum(points, 0xFFFF)
        letter = self.letter[small]
        if (high := points > 0xFFFF).any():
            letter = letter & ~high | np.isin(points, [p for p in np.unique(points[high]).tolist() if chr(p).isalpha()])
        c = np.where(letter, points, 32).astype(np.uint64)
        one = c * np.uint64(0x9E3779B97F4A7C15)
        two = one.copy()
        two[:-1] += c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        three = two.copy()
        three[:-2] += c[2:] * np.uint64(0x165667B19E3779F9)
        grams = np.stack([one, two + np.uint64(0x27D4EB2F165667C5), three + np.uint64(0x85EBCA77C2B2AE63)])
        grams ^= grams >> np.uint64(29)
        grams *= np.uint64(0xBF58476D1CE4E5B9)
        hashes = (grams >> np.uint64(64 - 15)).astype(np.int32)
        # spaces in a row say nothing
        idle = (c == 32) & np.concatenate([[True], c[:-1] == 32])
        hashes[:, idle] = -1
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
        has = np.add.reduceat(letter, starts) > 0 if len(sizes) else np.zeros(0, bool)
        return hashes, starts, has


def _parts(texts: list[str]):
    """Ranges of texts of about PART characters."""
    start, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= PART or i == len(texts) - 1:
            yield texts[start : i + 1]
            start, chars = i + 1, 0


@dataclass
class Model:
    """languages; code: a row a language; weights[bucket, bit]: log-odds; trust: weight of each bit; scale of the margins."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def predict(self, texts: list[str], grams: Grams) -> list[tuple[str, float, bool]]:
        """(language, score, ambiguous) of each text."""
        out = []
        for part in _parts(texts):
            hashes, starts, has = grams.of(part)
            if not self.languages or not len(starts):
                out += [(UNDETERMINED, 0.0, True)] * len(part)
                continue
            # one row more for idle places: its weight is nought
            total = sum(np.add.reduceat(self.weights[h], starts, axis=0) for h in hashes).astype(np.float64)
            n = np.maximum(1, np.add.reduceat((hashes[0] >= 0).astype(np.int64), starts))
            margin = total / np.sqrt(3 * n)[:, None]
            loss = (np.logaddexp(0, -margin[:, None, :] * self.code[None]) * self.trust).sum(2)
            order = np.argsort(loss, axis=1, kind="stable")
            best = order[:, 0]
            like = np.exp(-(loss - loss.min(1, keepdims=True)))
            score = like.max(1) / like.sum(1)
            for b, s, ok in zip(best.tolist(), score.tolist(), has.tolist(), strict=True):
                out.append((self.languages[b], s, s < AMBIGUOUS) if ok else (UNDETERMINED, 0.0, True))
        return out


#: A score below this is flagged: the second language is nearly as near as the first.
AMBIGUOUS = 0.55


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", alpha: float = 0.5) -> Model:
    """Fit on every row with a language. BUCKETS counts a language reach the driver, whatever the size of the corpus."""
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def count(batches):
        grams, held = Grams(), {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                own = held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for part in _parts(texts):
                    for h in grams.of(part)[0]:
                        own += np.bincount(h[h >= 0], minlength=BUCKETS)
        for lang, own in held.items():
            at = np.flatnonzero(own)
            yield pa.record_batch([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(own[at])], ["lang", "bucket", "n"])

    counts = in_arrow(rows, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    shares = np.zeros((len(languages), BUCKETS))
    for k, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        shares[k, own["bucket"].to_numpy()] = own["n"].to_numpy()
    shares = (shares + alpha) / (shares.sum(1, keepdims=True) + alpha * BUCKETS) if languages else shares
    code = codewords(len(languages))
    sides = [(shares[code[:, b] > 0].mean(0), shares[code[:, b] < 0].mean(0)) for b in range(code.shape[1])] if languages else []
    weights = np.stack([np.log(p) - np.log(q) for p, q in sides], axis=1) if sides else np.zeros((BUCKETS, 0))
    # a bit is trusted by the distance of its two sides, in expected log-odds a gram
    trust = np.array([((p - q) * (np.log(p) - np.log(q))).sum() for p, q in sides])
    trust = trust / trust.mean() if len(trust) and trust.mean() > 0 else np.ones(len(sides))
    return Model(languages, code, np.vstack([weights, np.zeros((1, weights.shape[1]))]).astype(np.float32), trust)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every row; no shuffle.

    A text that is null, empty or without a letter is `und` with score 0, and so is every text if nothing was labelled. Ids may be
    null or repeated; a model of one language gives it to all.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        grams = Grams()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = held.value.predict([x or "" for x in batch.column(1).to_pylist()], grams)
            return pa.record_batch([batch.column(0), *(pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_())))], ["doc_id", "lang_pred", "score", "ambiguous"])

        return one

    return arrow_map(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), "doc_id long, lang_pred string, score double, ambiguous boolean", start)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows whose language is undetermined or ambiguous; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        grams = Grams()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = held.value.predict([x or "" for x in batch.column(text_col).to_pylist()], grams)
            return batch.filter(pa.array([lang != UNDETERMINED and not ambiguous for lang, _, ambiguous in found]))

        return one

    return arrow_map(docs, docs.schema, start)
