import hashlib
import random
from collections import Counter

from test_llm import docs_of, odd_texts

from seqmill.llm import align, queries


def brute(texts):
    """Digest rows by whole-text encodings and a plain comparison of all token pairs of a text."""
    aligner = align.Aligner(*align.paths(None, None))
    made = []
    for t in texts:
        groups, links, n = [], [], (0, 0)
        a = aligner.a.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        b = aligner.b.encode(t) if t else []
        xs, ys = [aligner.a_bytes[i] for i in a], [aligner.b_bytes[i] for i in b]
        if t and b"".join(xs) == (" " + t).encode() == b"".join(ys):
            ends = lambda parts: [0, *__import__("itertools").accumulate(map(len, parts))]
            ea, eb = ends(xs), ends(ys)
            shared = sorted(set(ea) & set(eb))
            for lo, hi in zip(shared, shared[1:], strict=False):
                ia = [i for i in range(len(a)) if lo <= ea[i] < hi]
                ib = [j for j in range(len(b)) if lo <= eb[j] < hi]
                groups.append((",".join(str(a[i]) for i in ia), ",".join(str(b[j]) for j in ib)))
                links += [(a[i], b[j]) for i in ia for j in ib if ea[i] < eb[j + 1] and eb[j] < ea[i + 1]]
            n = (len(a), len(b))
        made.append((*n, groups, links))
    count = Counter(x for m in made for x in m[3])
    best = {}
    for (_, b), c in count.items():
        best[b] = max(best.get(b, 0), c)
    sha = lambda g: hashlib.sha256(";".join("|".join(x) for x in g).encode()).hexdigest() if g else ""
    return [(na, nb, len(g), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), sha(g)) for na, nb, g, x in made]


def special_texts():
    rng = random.Random(3)
    signs = ["a", "Z", "é", "ß", "日本", "🙂", " ", "  ", "\n", "\t", "\x1c", "\u00a0", "\u2003", "\u2028", "1", "23", "'s", "_", "<", "▁", "\u0301", ".", "--", "\x00", "\x85", "ﬁ"]
    out = ["<|endoftext|> and <s> x </s> <unk> <0x41>", " lead", "trail ", "  ", " \n", "a▁b", "it's a dog's", "don't  stop", "x" * 3000, " " * 500 + "end", "tab\there", "a \nb \tc", "plain words here"]
    return out + ["".join(rng.choices(signs, k=rng.randrange(1, 60))) for _ in range(300)]


def test_alignment_equals_brute_force(spark):
    texts = [t for t in odd_texts() if len(t or "") < 5000] + special_texts() + ["the same line of words"] * 5
    rows = align.digest(docs_of(spark, texts)).collect()
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert {r.doc_id: tuple(r[c] for c in names) for r in rows} == dict(enumerate(brute(texts)))
    assert sum(r.n_a == 0 for r in rows) > 10 and sum(r.n_a > 0 for r in rows) > 100


def test_rare_pairs_and_common_pairs_count_alike(spark, monkeypatch):
    texts = [t for t in special_texts() if len(t) < 200]
    for share in (1, 50):
        monkeypatch.setattr(align, "SHARE", share)
        rows = align.digest(docs_of(spark, texts)).collect()
        assert {r.doc_id: (r.n_best, r.count_sum) for r in rows} == {i: x[4:6] for i, x in enumerate(brute(texts))}


def test_groups_join_to_the_text(spark):
    aligner = align.Aligner(*align.paths(None, None))
    texts = ["naïve words and numbers 12345", "", None, "  two  spaces "]
    rows = align.groups(docs_of(spark, texts)).orderBy("doc_id", "group").collect()
    for i, t in enumerate(texts):
        mine = [r for r in rows if r.doc_id == i]
        assert [r.group for r in mine] == list(range(len(mine)))
        want = (" " + t).encode() if t else b""
        assert b"".join(aligner.a_bytes[x] for r in mine for x in r.a_ids) == want == b"".join(aligner.b_bytes[x] for r in mine for x in r.b_ids)


def test_alignment_of_empty_repeated_null_and_clashing(spark):
    docs = spark.createDataFrame([(None, "one two", 1, 2, 3), (7, "one two", 1, 2, 3), (7, "one two", 1, 2, 3)], "doc_id long, text string, row int, a int, pairs int")
    rows = align.digest(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in rows if r.doc_id) == [(False, 7), (False, 7)] and len({r.count_sum for r in rows}) == 1
    assert rows[0].n_best == rows[0].n_links and rows[0].count_sum == 3 * rows[0].n_links
    assert align.digest(docs.limit(0)).count() == 0 and align.groups(docs.limit(0)).count() == 0
    assert queries.QUERIES["op11_alignment"](spark, "/root/testdata/sf0.001").where("n_links > 0").count() > 100
