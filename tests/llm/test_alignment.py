import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rankpulse.llm import alignment

A, RANKS, B = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")


def ends(parts):
    at = 0
    for p in parts:
        at += len(p)
        yield at


def brute(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each text, by the libraries and loops."""
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    back = {c: b for b, c in enumerate(alignment.encoders.byte_characters())}
    raw_a = {i: bytes(back[c] for c in t) for t, i in first.get_vocab().items() if not t.startswith("<|endof")}
    raw_b = lambda i: bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
    grouped = []
    for text in texts:
        want = (" " + (text or "")).encode()
        a, b = first.encode(" " + (text or ""), add_special_tokens=False).ids, second.encode(text or "")
        pa, pb = [raw_a[i] for i in a], [raw_b(i) for i in b]
        if not text or b"".join(pa) != want or b"".join(pb) != want:
            grouped.append([])
            continue
        cuts = set(ends(pa)) & set(ends(pb))
        groups = [[[], []] for _ in cuts]
        for side, (ids, parts) in enumerate(((a, pa), (b, pb))):
            at = 0
            for i, e in zip(ids, ends(parts), strict=True):
                groups[at][side].append(i)
                at += e in cuts
        grouped.append(groups)
    links = [[(x, y) for g in groups for x in g[0] for y in g[1]] for groups in grouped]
    count = Counter(p for one in links for p in set(one))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for groups, one in zip(grouped, links, strict=True):
        written = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        digest = hashlib.sha256(written.encode()).hexdigest() if groups else ""
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(one), sum(count[p] == best[p[0]] for p in one), sum(count[p] for p in one), digest))
    return out


@pytest.fixture(scope="module")
def texts(spark):
    own = ["", None, " ", "a", "\n\nx", "two  spaces ", "tab\there\r\n", "▁ mark", "an <|endoftext|> inside <s> </s> <0x41>", "日本語のテキスト und Größe", "\U0001f600\U0001f469‍\U0001f680 end", "nul\0here", "﻿bom", "½ ﬁ"]
    long = ["ab" * 3000, "xq" * 500 + " " + "zzyx" * 400, " " * 3000, "abcdefghijklmnopqrstuvwxyz" * 60, "word " * 4000]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60)
    return own + long + [r["text"] for r in docs.collect()] + own[8:11]


@pytest.mark.parametrize("wide, at_once, part", [(64, 2_000_000, 4_000_000), (3, 50, 3000)])
def test_against_the_libraries(spark, texts, monkeypatch, wide, at_once, part):
    """Every column of every row, with chunks, wide groups and their parts of any size; clashing names of other columns change nothing."""
    told = [(i, t, "g", 0) for i, t in enumerate(texts)] + [(None, "two words", "g", 0), (3, "a", "g", 0)]
    df = spark.createDataFrame(told, "doc_id long, text string, chunk string, n_a int").repartition(3)
    aligner = alignment.Aligner(A, RANKS, P.PATTERN, B)
    monkeypatch.setattr(alignment, "WIDE", wide)
    monkeypatch.setattr(alignment, "AT_ONCE", at_once)
    if part < 4_000_000:  # the same in this process, where the patched limits hold: one chunk a text, and all in one
        import pyarrow as pa

        column = pa.array([t for _, t, _, _ in told], pa.string())
        ids = pa.array([i for i, *_ in told], pa.int64())
        whole = [list(alignment.align_batch(aligner, ids, column, 0))]
        each = [list(alignment.align_batch(aligner, ids.slice(k, 1), column.slice(k, 1), k)) for k in range(len(told))]
        for chunks in (whole, each):
            rows = pa.Table.from_batches([b for c in chunks for b in c]).to_pylist()
            got = [(r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) for r in rows if r["kind"] == 1]
            assert got == [(*x[:4], x[6]) for x in brute([t for _, t, _, _ in told])]
            pairs = Counter()
            for r in rows:
                if r["kind"] == 0:
                    pairs[r["a"], r["b"]] += r["docs"]
            if chunks is whole:
                first = pairs
            assert pairs == first
        return
    got = alignment.align(df, A, RANKS, P.PATTERN, B)
    want = [(i, *x) for (i, *_), x in zip(told, brute([t for _, t, _, _ in told]), strict=True)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_empty(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, RANKS, P.PATTERN, B).count() == 0
