"""Quality rules under weak supervision.

Rules vote good (1) or bad (-1) or abstain (0) on text statistics. Expectation-maximisation over the counts of vote patterns
estimates how often each rule votes on good and on bad documents, which gives its accuracy; a document's posterior probability of being good decides. Each rule votes one way, so patterns number at most 2 ** rules, whatever the size of the corpus, so only they reach the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import encoders
from .common import arrow_map, stored

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
ENDS = tuple(".!?…\"”»)")

STATS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_end_lines long, n_letter_words long, n_symbol_words long, n_capital_words long, n_distinct_words long, n_capitals long"
)


def _statistics(column: pa.Array) -> list[tuple]:
    """The statistics of STATS but the id, for each text."""
    out = []
    for _, part in encoders.slices(column):
        lists = pc.ascii_split_whitespace(part)
        words = lists.flatten().dictionary_encode()
        names, codes, starts = words.dictionary, words.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        lengths = pc.utf8_length(names).to_numpy().astype(np.int64)
        letters = pc.match_substring_regex(names, r"\p{L}").to_numpy(zero_copy_only=False)
        marked = pc.match_substring_regex(names, f"[{re.escape(SYMBOLS)}]").to_numpy(zero_copy_only=False)
        shouted = pc.match_substring_regex(names, r"^\P{Ll}*\p{Lu}\P{Ll}*\p{Lu}\P{Ll}*$").to_numpy(zero_copy_only=False)
        many = len(names)
        for i, text in enumerate(part.to_pylist()):
            own = codes[starts[i] : starts[i + 1]]
            own = own[lengths[own] > 0]
            n = len(own)
            covered = 0
            if n >= 4:
                windows = (own[:-2] * many + own[1:-1]) * many + own[2:] if many < 2_000_000 else _renumbered(own)
                _, back, count = np.unique(windows, return_inverse=True, return_counts=True)
                again = count[back] > 1
                if again.any():
                    at = np.zeros(n, bool)
                    at[:-2] |= again
                    at[1:-1] |= again
                    at[2:] |= again
                    covered = int(at.sum())
            lines = [x for x in text.split("\n") if x.strip(SPACES)]
            raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            out.append(
                (
                    n, int(lengths[own].sum()), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), covered,
                    len(lines), sum(x.rstrip(SPACES).endswith(ENDS) for x in lines), int(letters[own].sum()),
                    int(marked[own].sum()), int(shouted[own].sum()), len(np.unique(own)),
                    int(((raw >= 65) & (raw <= 90)).sum()),
                )
            )
    return out


def _renumbered(own: np.ndarray) -> np.ndarray:
    """Three-word windows as numbers, where there are too many words for one product: pairs are numbered first."""
    _, pairs = np.unique(own[:-1] * (own.max() + 1) + own[1:], return_inverse=True)
    return pairs[:-1] * (own.max() + 1) + own[2:]


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of STATS for every row. A null text has no words; words lie between ASCII white space; no shuffle."""
    names = [x.split()[0] for x in STATS.split(", ")]

    def start():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = np.array(_statistics(batch.column(1)), dtype=np.int64).reshape(-1, len(names) - 1)
            return pa.record_batch([batch.column(0), *(pa.array(rows[:, k]) for k in range(rows.shape[1]))], names)

        return one

    return arrow_map(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), STATS, start)


@dataclass(frozen=True)
class Rule:
    """Votes `vote` (1 good, -1 bad) where `holds`, SQL over the statistics, is true; else it abstains."""

    name: str
    vote: int
    holds: str

    def column(self) -> Column:
        return F.expr(f"cast(case when {self.holds} then {self.vote} else 0 end as int)")


RULES = (
    Rule("symbols", -1, "10 * n_symbols > n_words"),
    Rule("marked_words", -1, "20 * n_symbol_words > n_words"),
    Rule("same_lines", -1, "n_lines >= 3 and 10 * n_dup_lines > 4 * n_lines"),
    Rule("same_words", -1, "10 * n_repeat_words > 4 * n_words"),
    Rule("variety", -1, "n_words between 50 and 5000 and 10 * n_distinct_words < 3 * n_words"),
    Rule("letters", -1, "10 * n_letter_words < 8 * n_words"),
    Rule("capitals", -1, "10 * n_capitals > 3 * word_chars"),
    Rule("shouting", -1, "10 * n_capital_words > 4 * n_words"),
    Rule("word_length", -1, "2 * word_chars < 5 * n_words or word_chars > 12 * n_words"),
    Rule("no_sentences", -1, "n_lines >= 3 and 10 * n_end_lines < 3 * n_lines"),
    Rule("prose", 1, "100 * n_letter_words >= 90 * n_words and 50 * n_symbol_words <= n_words and 10 * n_end_lines >= 8 * n_lines and 10 * n_capitals <= 2 * word_chars"),
    Rule("usual_words", 1, "2 * word_chars >= 7 * n_words and word_chars <= 9 * n_words and (n_words > 5000 or 10 * n_distinct_words >= 4 * n_words)"),
)


@dataclass(frozen=True)
class Model:
    """good: share of good documents; on_good[j], on_bad[j]: how often rule j votes on a document of either kind."""

    good: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(good) of each row of votes."""
        g, b = np.array(self.on_good), np.array(self.on_bad)
        cast = votes != 0
        odds = np.log(self.good) - np.log(1 - self.good) + cast @ (np.log(g) - np.log(b)) + ~cast @ (np.log(1 - g) - np.log(1 - b))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def accuracy(self, signs: np.ndarray) -> np.ndarray:
        """How often each rule is right when it votes."""
        g, b = self.good * np.array(self.on_good), (1 - self.good) * np.array(self.on_bad)
        return np.where(signs > 0, g, b) / (g + b)


def fit(votes: np.ndarray, counts: np.ndarray, signs: np.ndarray, rounds: int = 200, strength: float = 20.0) -> Model:
    """Expectation-maximisation over distinct vote patterns and their counts; signs: which way each rule votes.

    It starts from rules that vote rightly more often than not, keeps a prior there of `strength` documents, and holds rates to
    bounds that keep the two classes' meaning: a bad vote falls on a tenth of good documents at most, a good vote on half of them at
    least. Without documents this prior is the model.
    """
    first = Model(0.85, tuple(np.where(signs > 0, 0.85, 0.01)), tuple(np.where(signs > 0, 0.3, 0.3)))
    least_good, most_good = np.where(signs > 0, 0.5, 1e-4), np.where(signs > 0, 0.999, 0.1)
    model, cast = first, votes != 0
    for _ in range(rounds):
        p = model.posterior(votes)
        g, b = counts * p, counts * (1 - p)
        on_good = np.clip((g @ cast + strength * np.array(first.on_good)) / (g.sum() + strength), least_good, most_good)
        on_bad = np.clip((b @ cast + strength * np.array(first.on_bad)) / (b.sum() + strength), 0.02, 0.95)
        good = float(np.clip((g.sum() + strength * first.good) / (counts.sum() + strength), 0.5, 0.99))
        new = Model(good, tuple(on_good), tuple(on_bad))
        change = max(abs(x - y) for x, y in zip((new.good, *new.on_good, *new.on_bad), (model.good, *model.on_good, *model.on_bad), strict=True))
        model = new
        if change < 1e-9:
            break
    return model


def _told(spark: SparkSession, stats: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """p_good of each pattern of votes in stats: at most 2 ** rules rows."""
    votes = [f"vote_{r.name}" for r in rules]
    patterns = stats.groupBy(*votes).count().toPandas()
    seen = patterns[votes].to_numpy(dtype=np.int64).reshape(-1, len(rules))
    patterns["p_good"] = fit(seen, patterns["count"].to_numpy(), np.array([r.vote for r in rules])).posterior(seen)
    schema = ", ".join([*(f"{v} int" for v in votes), "p_good double"])
    return spark.createDataFrame(list(patterns[[*votes, "p_good"]].itertuples(index=False, name=None)), schema)


FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base statistics, base_failed, p_good and kept of every row.

    base_failed: under 50 words, or over half of the words in repeated three-word windows. kept: not base_failed and p_good >=
    threshold. A null or empty text has no words and fails; null ids and repeated rows keep a row each; an empty table gives none.
    """
    votes = {f"vote_{r.name}": r.column() for r in rules}
    stats = stored(text_statistics(docs, id_col, text_col).withColumns(votes), "quality")
    told = _told(docs.sparkSession, stats, rules)
    failed = F.expr(FAILED)
    return stats.join(F.broadcast(told), list(votes)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "p_good",
        (~failed & (F.col("p_good") >= threshold)).alias("kept"),
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.1, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that judge() would not keep. Statistics are taken twice, so that no text is shuffled."""
    votes = {f"vote_{r.name}": r.column() for r in rules}
    told = _told(docs.sparkSession, text_statistics(docs.withColumn("doc_id", F.lit(0)), text_col=text_col).withColumns(votes), rules)
    names = [x.split()[0] for x in STATS.split(", ")][1:]

    def start():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = np.array(_statistics(batch.column("d").field(text_col)), dtype=np.int64).reshape(-1, len(names))
            return pa.record_batch([batch.column("d"), *(pa.array(rows[:, k]) for k in range(rows.shape[1]))], ["d", *names])

        return one

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))  # so that no column of docs clashes
    schema = T.StructType([*whole.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])
    judged = arrow_map(whole, schema, start).withColumns(votes).join(F.broadcast(told), list(votes))
    return judged.where(~F.expr(FAILED) & (F.col("p_good") >= threshold)).select("d.*")
