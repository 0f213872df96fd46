"""Keywords out of tables, found in one pass over the texts by an automaton."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that one automaton holds at most; a longer list is cut into lists of that size, each with a pass of its own.
MOST = 200_000
#: Rows of texts that come to a task at once are bounded by Spark's batches; so are those that leave it.
_WORD_CHARACTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")


def keyword_hits(texts: DataFrame, words: DataFrame, text: Column, id_col: str, word_col: str = "word", most: int = MOST) -> DataFrame:
    """(id_col, word) of every keyword, lower-cased, that a text holds: once each, by the rules of scalars.keyword_match.

    Words of ASCII letters alone need ASCII word bounds, others are substrings; case is ignored, blank words never match. words is any table: its distinct
    words are counted first, and go to the tasks in lists of no more than `most`, each of which becomes one automaton a task. A row of a null id or text
    gives none.
    """
    low = F.lower(F.trim(F.col(word_col)))
    listed = words.select(low.alias("word")).where("word <> ''").distinct()
    n = listed.count()
    rows = texts.select(F.col(id_col).alias("id"), F.lower(text).alias("text")).where("id is not null and text <> ''")
    kind = rows.schema["id"].dataType.simpleString()
    parts, out = max(1, -(-n // most)), None
    for part in range(parts):
        # a list is bounded by `most`, whatever the table's size
        some = [r[0] for r in listed.where(F.pmod(F.xxhash64("word"), F.lit(parts)) == part).collect()] if n else []
        found = rows.mapInArrow(_finder(some), f"id {kind}, word string")
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("id").alias(id_col), "word")


def _finder(words: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for w in words:
            automaton.add_word(w, (w, len(w), w.isascii() and w.isalpha()))
        if words:
            automaton.make_automaton()
        for batch in batches:
            places, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist() if words else ()):
                for w in _hits(automaton, text):
                    places.append(i)
                    found.append(w)
            yield pa.record_batch([batch.column("id").take(pa.array(places, pa.int64())), pa.array(found, pa.string())], ["id", "word"])

    return run


def _hits(automaton, text: str) -> set[str]:
    seen: set[str] = set()
    last = len(text) - 1
    for end, (word, n, bounded) in automaton.iter(text):
        if word in seen:
            continue
        start = end - n + 1
        if bounded and ((start and text[start - 1] in _WORD_CHARACTERS) or (end < last and text[end + 1] in _WORD_CHARACTERS)):
            continue
        seen.add(word)
    return seen


def flag_rows(texts: DataFrame, words: DataFrame, text: Column, id_col: str, flag: str, word_col: str = "word") -> DataFrame:
    """texts with a flag: whether a row holds any of the words. id_col must tell rows apart."""
    ids = keyword_hits(texts, words, text, id_col, word_col).select(id_col).distinct().withColumn(flag, F.lit(True))
    return texts.join(ids, id_col, "left").fillna(False, [flag])


def topic_rows(texts: DataFrame, topics: DataFrame, text: Column, id_col: str) -> DataFrame:
    """(id_col, topic) by a table of topics (topic, word): each topic once a row."""
    hits = keyword_hits(texts, topics, text, id_col)
    return hits.join(topics.select("topic", F.lower(F.trim("word")).alias("word")).distinct(), "word").select(id_col, "topic").distinct()
