"""Probes that once collided: words in Thue-Morse order, and null ids whose texts share a 32-bit hash."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import docs_of

from seqmill.llm import decontaminate, near, substrings, suffixes
from seqmill.llm.common import span_hashes


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
@pytest.mark.parametrize("k", [1, 4, 8])
def test_patterned_words_have_hashes_of_their_own(n, k):
    """Swapped patterns of letters and of blocks of letters differ in both families."""
    a, b = thue_morse(n, "a" * k, "b" * k).encode(), thue_morse(n, "b" * k, "a" * k).encode()
    data = np.frombuffer(a + b, np.uint8)
    starts, ends = np.array([0, len(a)]), np.array([len(a), len(a) + len(b)])
    for which in (0, 1):
        h = span_hashes(data, starts, ends, which)
        assert h[0] != h[1]


def test_hashes_depend_on_the_bytes_of_a_run_alone():
    rng = random.Random(2)
    words = ["".join(rng.choices("ab\x00é", k=rng.randrange(1, 40))).encode() for _ in range(300)] + [b"a", b"a\x00", b"a\x00\x00", b"a" * 8, b"a" * 9, b"\x00"]
    seen = {}
    for glue in (b" ", b"   ", b"xyz"):
        data, starts, ends = b"", [], []
        for w in words:
            starts.append(len(data))
            data += w
            ends.append(len(data))
            data += glue
        for w, h in zip(words, span_hashes(np.frombuffer(data, np.uint8), np.array(starts), np.array(ends)).tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_patterned_words_are_no_matches(spark):
    p, q = thue_morse(1024), thue_morse(1024, "b", "a")
    mine, other = " ".join([p] * 6 + [q] * 7), " ".join([q] * 6 + [p] * 7)
    docs = docs_of(spark, [mine, other])
    assert [r.n_removed for r in substrings.digest(docs).collect()] == [0, 0]
    bench = spark.createDataFrame([(1, " ".join([p] * 13))], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.digest(docs_of(spark, [" ".join([q] * 13)]), bench).collect()] == [False]
    assert all(r.kept for r in near.digest(docs_of(spark, [f"{p} {p} {p}", f"{q} {q} {q}"])).collect())


def test_null_ids_with_colliding_hashes_keep_their_bytes(spark):
    """Two texts of one 32-bit hash: one repeats another row's bytes, the other stands alone."""
    rng = random.Random(9)
    body = "".join(rng.choices("abcdefgh", k=250))
    made = spark.range(400_000).select("id", F.concat(F.lit(body), F.sha2(F.col("id").cast("string"), 256)).alias("x"), F.concat(*[F.sha2(F.concat("id", F.lit(c)), 512) for c in "abc"]).alias("y"))
    hit = made.select(F.hash("x").alias("h"), "x").join(made.select(F.hash("y").alias("h"), "y"), "h").limit(1).collect()
    x, y = hit[0].x, hit[0].y
    docs = spark.createDataFrame([(None, x), (None, y), (5, body)], "doc_id long, text string")
    rows = {r.kept_sha256: r for r in suffixes.digest(docs).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert rows[sha(x[250:])].n_removed == 250 and rows[sha("")].n_removed == 250
    assert rows[sha(y)].n_removed == 0


def test_repeated_ids_with_other_texts(spark):
    text = "".join(random.Random(4).choices("abcdefgh", k=300))
    rows = suffixes.digest(spark.createDataFrame([(1, text), (1, text[::-1]), (1, text), (None, None)], "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in rows) == [0, 0, 300, 300]
