"""Rows that repeat an id, with the same text and with another: each is a document of its own."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rankpulse.llm import byte_bpe, chat, packing, queries, token_counts, token_files
from rankpulse.llm.common import work_dir

ROWS = [(5, "same text"), (5, "same text"), (5, "another one"), (None, "no id"), (None, "no id"), (2, None), (2, ""), (9, "last")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, "x") for r in ROWS], "doc_id long, text string, start int, cid string").repartition(3)


def test_byte_bpe(docs):
    got = Counter((r["doc_id"], r["decoded_sha256"]) for r in byte_bpe.digests(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect())
    assert got == Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS)


def test_token_counts(docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs, P.path("piece_bpe_32k.model")).collect())
    assert got == Counter((i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in ROWS)


def test_token_files(spark, docs):
    """Ascending ids, and the same order of equal ids however the rows are dealt."""
    t, seen = Tokenizer.from_file(P.path("word_bpe_49k.json")), []
    for parts in (1, 5):
        path = work_dir(spark, "files")
        token_files.write_tokens(docs.repartition(parts), path, P.path("word_bpe_49k.json"), 2)
        rows = sorted(token_files.read_tokens(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
        assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == Counter((i, (*t.encode(x or "", add_special_tokens=False).ids, 2)) for i, x in ROWS)
        assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()
        named = [r["doc_id"] for r in rows if r["doc_id"] is not None]
        assert named == sorted(named)
        seen.append([(r["doc_id"], tuple(r["ids"])) for r in rows])
    assert seen[0] == seen[1]


def test_packing(docs):
    got = packing.pack(docs, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, 1, with_ids=True).collect()
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter((i, zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for i, x in ROWS)
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == want


def test_conversation_of_the_queries_id(spark):
    """A table that has conversation -7 already: its turns and the added ones are one conversation, by turn."""
    turns = [(-7, 0, "user", "hi"), (-7, 1, "assistant", "yes"), (-7, 2, "user", queries.CONTROL), (-7, 3, "assistant", queries.CONTROL), (1, 0, "user", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    said = "".join(f"{role}\n{text}\n" for _, _, role, text in turns[:4])
    assert got[-7]["n_turns"] == 4 and got[-7]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got[-7]["loss_sha256"] == hashlib.sha256(("yes" + queries.CONTROL).encode()).hexdigest()
