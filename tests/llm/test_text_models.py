import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankpulse.llm import chat, katz, language, quality, templates

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


EDGE = [(None, "x y"), (1, None), (2, ""), (3, " \n\t "), (4, "One two.\nOne two.\n"), (4, "One two.\nOne two.\n"), (5, "a b c " * 4000), (6, "…" * 50)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, 1, True) for i, t in EDGE], "doc_id long, text string, n_words int, kept boolean")


def test_katz_is_normalised(spark):
    texts = ["a b a c", "a b b", "c", "a b a", "d d a b", "b b b b c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    model = katz.fit(rows, 2)
    words = sorted({w for t in texts for w in t.split()}) + ["unseen"]
    # P(w | a) over all words, the end and one unseen word: score "a w" less what else is scored
    ask = [f"a {w} zz" for w in words]
    scored = {r["row"]: r["score"] for r in katz.score(spark.createDataFrame(list(enumerate([*ask, "a zz", "zz"])), "row long, text string"), model).collect()}
    keys = dict(zip(words, [10 ** scored[i] for i in range(len(words))], strict=True))
    assert len(keys) == len(words) and all(v > 0 for v in keys.values())
    c = Counter(tuple(x) for t in texts for x in zip(["<"] + t.split(), t.split() + [">"], strict=True))
    c1 = Counter(w for t in texts for w in [*t.split(), ">"])
    d1, d2 = katz.good_turing(Counter(c1.values())), katz.good_turing(Counter(c.values()))
    n = sum(c1.values())
    scale1 = min(1.0, (n + 0.5) / (n + 1) * n / sum(d1.get(k, 1) * k for k in c1.values()))
    p1 = {w: scale1 * d1.get(k, 1) * k / n for w, k in c1.items()}
    total = Counter()
    for (h, _), k in c.items():
        total[h] += k
    for h in total:
        dc = sum(d2.get(k, 1) * k for (a, _), k in c.items() if a == h)
        s = min(1, total[h] / (total[h] + 1) * total[h] / dc) / total[h]
        weight = (1 - s * dc) / (1 - sum(p1[w] for (a, w) in c if a == h))
        mass = sum(s * d2.get(k, 1) * k for (a, _), k in c.items() if a == h) + weight * (1 - sum(p1[w] for (a, w) in c if a == h))
        assert abs(mass - 1) < 1e-9
    assert abs(sum(p1.values()) + model.unseen - 1) < 1e-9


def test_katz_beats_the_base_and_takes_edges(docs, edge):
    held = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")
    got = katz.score_documents(docs, F.coalesce(held, F.lit(False))).toPandas()
    out = got[got.held_out]
    assert len(got) == 1000 and out.score.sum() > out.base_score.sum() and (got.score < 0).all()
    rows = katz.score_documents(edge, F.coalesce(F.col("doc_id") == 4, F.lit(False))).collect()
    assert len(rows) == len(EDGE) and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert katz.score_documents(edge.limit(0), F.lit(False)).count() == 0


def test_language(spark, docs, edge):
    held = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2")
    model = language.train(docs.where(~held))
    got = language.identify(docs.where(held), model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    rows = {r["doc_id"]: r for r in language.identify(edge, model).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (1, 2, 3, 6)) and rows[5]["lang_pred"] != "und"
    kept = language.keep_identified(edge, model)
    assert kept.columns == edge.columns and {r["doc_id"] for r in kept.collect()} <= {None, 4, 5}
    empty = language.train(docs.limit(0))
    assert {r["lang_pred"] for r in language.identify(edge, empty).collect()} == {"und"} and language.identify(edge.limit(0), model).count() == 0
    code = language.codewords(9)
    assert min((code[i] != code[j]).sum() for i in range(9) for j in range(i)) >= 8


def brute(t: str) -> tuple:
    w = WORD.findall(t or "")
    tri = Counter(zip(w, w[1:], w[2:]))
    again = {k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in quality.SYMBOLS), len(lines) - len(set(lines)), len(again)


def test_quality(spark, docs, edge):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = quality.judge(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in got:
        assert tuple(r[n] for n in names) == brute(r["text"])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    told = [(labels[r["doc_id"]], r["kept"]) for r in got if r["doc_id"] in labels and not r["base_failed"]]
    assert np.mean([k for q, k in told if q == 1]) > 0.98 and np.mean([k for q, k in told if q == 0]) < 0.1
    rows = quality.judge(edge).collect()
    assert len(rows) == len(EDGE) and all(r["base_failed"] for r in rows)
    assert quality.keep_good(edge).columns == edge.columns and quality.keep_good(docs).count() == sum(r["kept"] for r in got)
    assert quality.judge(edge.limit(0)).count() == 0


def test_verdicts_by_hand(spark, docs):
    """p_good of each document against EM and Bayes written out with dictionaries over vote patterns."""
    got = quality.judge(docs).toPandas()
    stats = quality.text_statistics(docs).withColumns({f"vote_{r.name}": r.column() for r in quality.RULES}).toPandas().set_index("doc_id")
    votes = {i: tuple(bool(row[f"vote_{r.name}"]) for r in quality.RULES) for i, row in stats.iterrows()}
    counts, ups = Counter(votes.values()), [r.vote > 0 for r in quality.RULES]
    first_good, first_bad = [0.85 if u else 0.01 for u in ups], [0.3] * len(ups)
    share, good, bad = 0.85, list(first_good), list(first_bad)

    def chance(v):
        g, b = share, 1 - share
        for x, p, q in zip(v, good, bad, strict=True):
            g, b = g * (p if x else 1 - p), b * (q if x else 1 - q)
        return g / (g + b)

    for _ in range(200):
        p = {v: chance(v) for v in counts}
        n_good, n = sum(counts[v] * p[v] for v in counts), sum(counts.values())
        hold = lambda x, lo, hi: min(max(x, lo), hi)
        new_good = [hold((sum(counts[v] * p[v] for v in counts if v[j]) + 20 * first_good[j]) / (n_good + 20), 0.5 if u else 1e-4, 0.999 if u else 0.1) for j, u in enumerate(ups)]
        new_bad = [hold((sum(counts[v] * (1 - p[v]) for v in counts if v[j]) + 20 * first_bad[j]) / (n - n_good + 20), 0.02, 0.95) for j in range(len(ups))]
        share, good, bad = hold((n_good + 20 * 0.85) / (n + 20), 0.5, 0.99), new_good, new_bad
    want = [chance(votes[i]) for i in got.doc_id]
    assert np.abs(got.p_good - want).max() < 1e-6
    assert ((got.p_good >= 0.1) & ~got.base_failed == got.kept).all() and 0 < got.kept.sum() < len(got)


def test_many_words_in_one_text(spark):
    """Windows of three words are renumbered where a product of word numbers wouldn't fit."""
    words = [f"w{i}" for i in range(2_100_000)]
    text = " ".join([*words, "w0 w1 w2"])
    row = quality._statistics(pa.array([text]))[0]
    assert (row[0], row[4], row[10]) == (2_100_003, 6, 2_100_000)


def test_seven_languages(spark):
    random = np.random.default_rng(4)
    parts = {f"l{k}": [("".join(random.choice(list("abcdefghijklmnop"), 3))) for _ in range(12)] for k in range(7)}
    rows = [(i, " ".join("".join(random.choice(parts[f"l{i % 7}"], 2)) for _ in range(60)), f"l{i % 7}") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df.where("doc_id < 500"))
    got = language.identify(df.where("doc_id >= 500"), model).join(df.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(model.languages) == 7 and (got.lang == got.lang_pred).mean() > 0.97


def test_long_conversation(spark):
    turns = spark.createDataFrame([(1, i, "assistant" if i % 2 else "tool", f"t{i} </turn> " * 20) for i in range(6000)], "conv_id long, turn long, role string, text string")
    r = chat.read_back(chat.format_conversations(turns)).first()
    assert r["n_turns"] == 6000 and r["loss_chars"] == sum(len(f"t{i} </turn> " * 20) for i in range(1, 6000, 2))


def test_rule_rates_are_found():
    random = np.random.default_rng(3)
    good = random.random(20000) < 0.8
    signs, on_good, on_bad = np.array([-1, -1, -1, 1]), np.array([0.02, 0.01, 0.05, 0.9]), np.array([0.7, 0.6, 0.8, 0.2])
    votes = (random.random((20000, 4)) < np.where(good[:, None], on_good, on_bad)) * signs
    seen, counts = np.unique(votes, axis=0, return_counts=True)
    m = quality.fit(seen, counts, signs)
    assert abs(m.good - 0.8) < 0.03 and np.abs(np.array(m.on_good) - on_good).max() < 0.03 and np.abs(np.array(m.on_bad) - on_bad).max() < 0.05
    assert (m.accuracy(signs) > 0.7).all()


def test_chat(spark):
    nasty = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", nasty), (1, 1, "assistant", nasty), (2, 1, "assistant", None), (2, 0, None, "#### <</turn>\\h\\"), (2, 1, "assistant", "b"), (None, 0, "a\nb</turn>", "x"), (3, None, "assistant", "🙂"), (3, None, "assistant", "🙂")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    made = chat.format_conversations(df)
    assert all(r["formatted"].count("</turn>") == r["n_turns"] for r in made.collect())
    got = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    order = {1: [("user", nasty), ("assistant", nasty)], 2: [("", rows[3][3]), ("assistant", ""), ("assistant", "b")], None: [("a\nb</turn>", "x")], 3: [("assistant", "🙂")] * 2}
    for c, turns in order.items():
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[c]["loss_chars"] == len(loss)
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_templates():
    t = templates.compile_template("{% set n = 1 + 2 %}{% for m in xs %}{{ loop.index }}{% if m.a == 'x' and not loop.last %}[{{ m['a']|up }}]{% elif m.a in 'yz' %}({% generation %}{{ m.a ~ n }}{% endgeneration %}){% else %}-{% endif %}{% endfor %}", {"up": lambda s: s.upper()})
    assert t({"xs": [{"a": "x"}, {"a": "y"}, {"a": "x"}]}) == ("1[X]2(y3)3-", [(6, 8)])
    assert templates.fold(templates.parse("a{{ 'b' ~ 1 }}{% if 1 == 2 %}x{% else %}c{% endif %}"), {}) == [("text", "ab1c")]
    assert templates.compile_template("{{ x.__class__ }}{{ x.y.z }}")({"x": "s"}) == ("", [])
    with pytest.raises(templates.TemplateError):
        templates.compile_template("{% if x in y %}a{% endif %}")({"x": 1, "y": 2})
    for bad in ("{% if 1 in 2 %}a{% endif %}", "{% for %}", "{{ f(1) }}", "{% if x %}", "{{ 'a }}", "{{ x|nope }}"):
        with pytest.raises(templates.TemplateError):
            templates.compile_template(bad)


def test_base_score_formula(spark):
    rows = spark.createDataFrame([(0, "A b"), (1, "a")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in katz.score_documents(rows, F.lit(False)).collect()}
    assert got[0]["train_tokens"] == 5 and abs(got[1]["base_score"] - 2 * math.log10(3 / 9)) < 1e-9


MASK = (1 << 64) - 1


def plain_grams(text):
    """Buckets of the 1-, 2- and 3-grams of a text, by loops over whole numbers."""
    c = [ord(x) if x.isalpha() else 32 for x in f" {text.lower()}  "] + [32, 32]
    out = []
    for i in range(len(c) - 2):
        if c[i] == 32 and (i == 0 or c[i - 1] == 32):
            continue
        one = c[i] * 0x9E3779B97F4A7C15
        two = one + c[i + 1] * 0xC2B2AE3D27D4EB4F
        three = two + c[i + 2] * 0x165667B19E3779F9
        for h in (one, two + 0x27D4EB2F165667C5, three + 0x85EBCA77C2B2AE63):
            h &= MASK
            h ^= h >> 29
            out.append((h * 0xBF58476D1CE4E5B9 & MASK) >> 49)
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_language_by_loops(spark, docs, parts):
    """Counts, bits, trust, margins, losses, score and flag against plain arithmetic, however the rows are dealt to batches."""
    rows = [r for r in docs.collect() if r["text"]][:120] + [None]
    rows = [(r["doc_id"], r["text"][:4000], r["lang"]) for r in rows[:-1]] + [(-1, "12 :-)", "en"), (-2, "zz", None), (-3, "\U00010400 Ünï", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts)
    model = language.train(df)
    langs = sorted({r[2] for r in rows if r[2]})
    counts = {x: [0] * language.BUCKETS for x in langs}
    for _, text, lang in rows:
        for g in plain_grams(text) if lang else ():
            counts[lang][g] += 1
    share = {x: [(n + 0.5) / (sum(c) + 0.5 * language.BUCKETS) for n in c] for x, c in counts.items()}
    code = [[int(v) for v in row] for row in language.codewords(len(langs))]
    bits = range(len(code[0]))
    side = lambda b, s, g: sum(share[x][g] for x, k in zip(langs, code, strict=True) if k[b] == s) / sum(k[b] == s for k in code)
    odds = {(b, g): math.log(side(b, 1, g)) - math.log(side(b, -1, g)) for b in bits for g in range(language.BUCKETS)}
    trust = [sum((side(b, 1, g) - side(b, -1, g)) * odds[b, g] for g in range(language.BUCKETS)) for b in bits]
    trust = [t * len(trust) / sum(trust) for t in trust]
    got = {r["doc_id"]: r for r in language.identify(df, model).collect()}
    for doc_id, text, _ in rows:
        r = got[doc_id]
        if not any(x.isalpha() for x in text):
            assert (r["lang_pred"], r["score"], r["ambiguous"]) == ("und", 0.0, True)
            continue
        grams = plain_grams(text)
        margin = [sum(odds[b, g] for g in grams) / math.sqrt(max(3, len(grams))) for b in bits]
        loss = [sum(t * math.log1p(math.exp(-m * s)) if -m * s < 500 else t * -m * s for t, m, s in zip(trust, margin, k, strict=True)) for k in code]
        like = [math.exp(min(loss) - x) for x in loss]
        score = max(like) / sum(like)
        assert r["lang_pred"] == langs[loss.index(min(loss))] or abs(score - 0.5) < 1e-3
        assert r["score"] == pytest.approx(score, abs=2e-3) and r["ambiguous"] == (r["score"] < language.AMBIGUOUS)
