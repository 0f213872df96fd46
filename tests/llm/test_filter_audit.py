import itertools
import math
import re

from rankpulse.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, labels):
    """(part, order, step) -> kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley, document by document."""
    good, toxic = ({i for i, *q in labels if q[k] == 1 and i is not None} for k in (0, 1))
    docs = []
    for i, text, lang in rows:
        t = text or ""
        w = WORD.findall(t)
        capitals = sum("A" <= c <= "Z" for c in t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        fails = dict(zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * capitals > 3 * len(t), bool(set(t) & set("#$%&*|")), copy), strict=True))
        docs.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, total = {}, {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                removed = [d for d in own if f in d[1] and not d[1] & before]
                kept = sum(not d[1] & (before | {f}) for d in own)
                redundant = sum(f in d[1] and bool(d[1] & before) for d in own)
                alone = sum(d[1] == {f} for d in own)
                out[part, "".join(order), step] = [kept, len(removed), redundant, alone, sum(d[2] for d in removed), sum(d[3] for d in removed)]
                total[part, f] = total.get((part, f), 0) + len(removed)
    for (part, order, step), row in out.items():
        row.append(total[part, order[step - 1]])
    return out


def test_against_brute_force(spark):
    """Nulls, empty and very long texts, repeated ids and texts, odd white space, clashing columns, labels that repeat, are null or of no document."""
    long_ = " ".join(f"w{i}" for i in range(250))
    rows = [
        (1, None, "en"), (2, "", "en"), (2, "", "en"), (3, "", None), (None, "", ""), (None, long_, "en"), (4, long_, "en"), (4, long_, "en"), (5, long_, "de"), (6, long_ + " #", "de"), (7, long_.upper(), "de"),
        (8, "a b " * 200, "de"), (9, "A" * 3 + "é" * 97, None), (10, "A" * 4 + "é" * 96, None), (11, "x\x0by\x0cz\x1cq " * 100, "fr"), (12, long_ + " x|", "fr"), (13, "z " * 60_000, "fr"), (3, long_, "en"), (14, "Ä " * 250, "fr"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (4, None, 1), (5, 1, 1), (6, 1, 0), (8, 1, 1), (None, 1, 1), (99, 1, 1), (7, 0, 0)]
    docs = spark.createDataFrame([(*r, 1, "m", 2) for r in rows], "doc_id long, text string, lang string, n int, mask string, good int").repartition(4)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = brute(rows, labels)
    found = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in got}
    assert len(got) == len(want) == 4 * 120 * 5 and found == want
    # what all filters remove of a part is the sum of the shares
    for part in {p for p, *_ in want}:
        shares = {o[0]: found[part, o, 1][-1] for _, o, _ in [k for k in found if k[0] == part]}
        assert sum(shares.values()) == math.factorial(5) * (sum((lang or "") == part for _, _, lang in rows) - found[part, "ABCDE", 5][0])


def test_nothing(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(1, "x", "en")], docs.schema), labels).collect()
    assert len(one) == 600 and {r["good_lost"] for r in one} == {0}
