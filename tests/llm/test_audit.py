import random
import re
from itertools import permutations

from seqmill.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(text, doc_id, first):
    words = WORD.findall(text)
    capitals = sum("A" <= c <= "Z" for c in text)
    out = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * capitals > 5 * len(text), "D": any(c in "#$%&*|" for c in text)}
    return {k for k, v in (out | {"E": doc_id is not None and first is not None and doc_id > first}).items() if v}


def brute(docs, labels):
    """Runs every order filter by filter."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    rows = {}
    for i, t, s in docs:
        ls = [x for x in labels if i is not None and x[0] == i]
        rows.setdefault(s or "", []).append((fails(t or "", i, first.get(t or "")), any(x[1] == 1 for x in ls), any(x[2] == 1 for x in ls)))
    out = {}
    for part, all_ in rows.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = all_
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[0]], [r for r in left if f not in r[0]]
                failing = sum(f in r[0] for r in all_)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(r[0] == {f} for r in all_), sum(r[1] for r in gone), sum(r[2] for r in gone)]
                shapley[f] += len(gone)
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def collected(spark, docs, labels):
    d = spark.createDataFrame([(*x, 1, 2, True) for x in docs], "doc_id long, text string, source string, part int, n int, _first boolean").repartition(3)
    rows = audit.interactions(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert all(r.step in range(1, 6) for r in rows)
    return {(r.part, r.filter_order, r.step): [r[c] for c in names] for r in rows}


def test_interactions_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(90)] + ["UPPER", "CASE", "É", "x|y", "5%", "\u00a0"]
    text = lambda: rng.choice([" ", "\n", "\t\x0b"]).join(rng.choices(vocabulary[: rng.choice([20, 90, 92, 96])], k=rng.randrange(120)))
    texts = [text() for _ in range(60)]
    docs = [(i, rng.choice(texts), rng.choice(["a", "b", None, ""])) for i in range(400)] + [(None, texts[0], "a"), (None, None, "b"), (3, None, "c"), (5, "", "c"), (5, "", "c"), (6, None, "c"), (7, "W " * 300_000, "long")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 400, 3)] + [(0, 1, 1), (None, 1, 1), (9, 2, 5)]
    assert collected(spark, docs, labels) == brute(docs, labels)


def test_many_parts_and_bitmaps(spark, monkeypatch):
    monkeypatch.setattr(audit, "ROWS", 7)
    docs = [(i, "same" if i % 2 else f"text {i} #", f"s{i % 50}") for i in range(200)]
    assert collected(spark, docs, [(1, 1, 0)]) == brute(docs, [(1, 1, 0)])


def test_empty_table(spark):
    assert collected(spark, [(1, "x", "s")], []) == brute([(1, "x", "s")], [])
    d = spark.createDataFrame([], "doc_id long, text string, source string")
    assert audit.interactions(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
