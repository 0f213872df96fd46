import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from rankpulse.llm import byte_bpe, packing, token_counts, token_files
from rankpulse.llm.common import work_dir

TEXTS = [
    None, "", " ", "\n", "  a  b ", "a\n\nb", "\n\n\n x", "x <|endoftext|>  y", "a<|startoftext|>b it'S'", "a\n b\tc  d ", "café Café It's ’s 'll", "日本語 テスト　x", "\x01a \x01b",
    "ΣΑΣ İstanbul ΟΔΟΣ", "▁x y▁", "a\xa0 b", "\r\n a", "y" * 5000, "word " * 3000, "🙂 🙂🙂 \U0001d400x", "same", "same", "z" * 120_000 + " \n" * 2000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 7, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", 7, "x")]
    given = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string").repartition(3)
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text", "1 as n_tokens", "'y' as ids")
    return given.unionByName(real)


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def test_byte_bpe(docs, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    path = P.path("byte_bpe_multi_50k.tiktoken")
    got = byte_bpe.digests(docs, path, P.PATTERN).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = t.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    back = byte_bpe.decode(byte_bpe.encode(docs, path, P.PATTERN), path, P.PATTERN).collect()
    assert all(bytes(r["text_bytes"]).decode() == texts[r["doc_id"]] for r in back)
    assert byte_bpe.digests(docs.limit(0), path, P.PATTERN).count() == 0


def test_token_counts(spark, docs, texts):
    path, cache = P.path("piece_bpe_32k.model"), work_dir(spark, "cache")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for _ in range(2):  # the second run finds all counts in the cache
        got = token_counts.count_tokens(docs, path, cache, limit=100).collect()
        assert len(got) == len(texts)
        for r in got:
            n = len(sp.encode(texts[r["doc_id"]]))
            assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 100)
    assert spark.read.parquet(cache).count() == len(set(texts.values()))
    more = spark.createDataFrame([(1, "quite new"), (2, "same")], "doc_id long, text string")
    assert token_counts.count_tokens(more, path, cache).count() == 2
    assert spark.read.parquet(cache).count() == len(set(texts.values())) + 1
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0


def test_token_files(spark, docs, texts):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    path = work_dir(spark, "files")
    token_files.write_tokens(docs, path, P.path("word_bpe_49k.json"), 2)
    got = {r["doc_id"]: r for r in token_files.read_tokens(spark, path, with_ids=True).collect()}
    start = 0
    for i in sorted(texts, key=lambda x: (x is not None, x)):
        ids = [*t.encode(texts[i], add_special_tokens=False).ids, 2]
        r = got[i]
        assert (r["start"], r["n_tokens"], list(r["ids"])) == (start, len(ids), ids) and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    shuffled = token_files.read_shuffled(spark, path, 5).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in shuffled} == {i: list(r["ids"]) for i, r in got.items()} and [r["doc_id"] for r in shuffled] != list(got)
    none = work_dir(spark, "files")
    token_files.write_tokens(docs.limit(0), none, P.path("word_bpe_49k.json"), 2)
    assert token_files.read_tokens(spark, none).count() == 0


def test_files_roll(spark, docs, texts, monkeypatch):
    """Files of a few bytes each, written twice as by a task that runs again: the index names one set of them."""
    monkeypatch.setattr(token_files, "FILE_BYTES", 100)
    path = work_dir(spark, "files")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        token_files.write_tokens(docs, path, P.path("word_bpe_49k.json"), 2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    token_files.write_tokens(docs, f"{path}/other", P.path("word_bpe_49k.json"), 2)
    index = token_files.read_index(spark, path)
    assert index.select("file").distinct().count() > 4 and index.count() == len(texts)
    both = [{(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_tokens(spark, p).collect()} for p in (path, f"{path}/other")]
    assert both[0] == both[1] and len(both[0]) == len(texts)


def test_damage_is_seen():
    import io

    raw = bytearray(token_files.frame(b"abcd") + token_files.frame(b""))
    assert list(token_files.unframe(io.BytesIO(raw))) == [b"abcd", b""]
    raw[13] ^= 1
    with pytest.raises(ValueError):
        list(token_files.unframe(io.BytesIO(raw)))


def test_packing(spark, docs, texts):
    long_ = " " * 1_200_000 + "x"  # beyond what tiktoken's pattern takes
    docs, texts = docs.unionByName(spark.createDataFrame([(-9, long_, 7, "x")], docs.schema)), texts | {-9: long_}
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pack = lambda d, **k: packing.pack(d, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, 1, **k)
    got = pack(docs, with_ids=True, open_windows=4).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for i, rows in by_doc.items():
        ids = [*t.encode(texts[i], add_special_tokens=False).ids, 1]
        rows.sort(key=lambda r: r["start"])
        assert [x for r in rows for x in np.frombuffer(r["ids"], "<u4").tolist()] == ids and rows[0]["doc_tokens"] == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and len(r["ids"]) == 4 * r["length"] for r in rows)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert sum(r["length"] for r in got) > 0.9 * 2048 * (len(by_seq) - 1)
    assert pack(docs.limit(0)).count() == 0
