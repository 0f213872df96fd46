"""The pipeline's stages against plain versions of their own input, on the smallest tables."""

import corpus_pipeline
import pytest
from test_pairs import brute
from test_text_models import brute as statistics

from rankpulse.llm import language

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The input and the output of each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(10**6, None, None, None, 0), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "12 34 ...", "en", "s", 9), (None, "no id " * 30, "en", "s", 180)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("n_words", docs.doc_id)
    out = []
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        docs = corpus_pipeline.stored(stage(spark, docs, SF), "test")
        out.append((name, rows, docs))
    return out


def test_columns_stay(stages):
    assert [n for n, *_ in stages] == ["language", "quality", "near_dup", "packing"]
    assert all(df.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words"] for _, _, df in stages[:-1])


def test_language_stage(spark, stages):
    _, rows, kept = stages[0]
    model = language.train(spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in rows], "doc_id long, text string, lang string"))
    said = model.predict([r["text"] or "" for r in rows], language.Grams())
    want = [r["text"] for r, (lang, _, ambiguous) in zip(rows, said, strict=True) if lang != "und" and not ambiguous]
    assert sorted(r["text"] for r in kept.collect()) == sorted(want) and len(want) >= 0.98 * len(rows)


def test_quality_stage(stages):
    _, rows, kept = stages[1]
    texts = [r["text"] for r in kept.collect()]
    for t in texts:
        n, *_, again = statistics(t)
        assert n >= 50 and 2 * again <= n
    fine = [r["text"] for r in rows if statistics(r["text"])[0] >= 50 and not any(statistics(r["text"])[2:])]
    assert len(set(fine) - set(texts)) == 0


def test_near_dup_stage(stages):
    _, rows, kept = stages[2]
    group, sets = brute([(r["doc_id"], r["text"]) for r in rows], 5)
    of = {r["text"]: g for r, g in zip(rows, group, strict=True)}
    left = [of[r["text"]] for r in kept.collect()]
    assert len(left) == len(set(left)) == len(set(group)) < len(rows) and all(sets)


def test_packing_stage(stages):
    _, rows, packed = stages[3]
    got = packed.collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    assert set(by) == {r["doc_id"] for r in rows}
    for pieces in by.values():
        at = 0
        for start, length, total in sorted(pieces):
            assert start == at
            at += length
        assert at == total


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
