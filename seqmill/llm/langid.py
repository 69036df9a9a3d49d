"""Language ID of web pages by Bayesian evidence fusion.

Evidence: hashed byte trigrams of the visible text (naive Bayes, fitted on a bounded sample of
labelled documents), the language the markup declares, the suffix of the address, and the
host. Comments, scripts and style sheets are no text and declare nothing; declared is the ``lang`` of
the html tag, else its ``xml:lang``, else a content-language meta tag. How far a declaration can be trusted, and the priors of suffixes and hosts, come from the
text posteriors of all pages by grouped aggregation; a host's prior is smoothed towards its
suffix's, and that towards the whole.

Defined cases: null or empty html has no text evidence, a null url no host or suffix (such pages
share the prior of the whole); without labelled documents every column but page_id and the
declared language is null; repeated rows count each; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmill.llm.common import chunks, settle, text_bytes

BUCKETS = 1 << 14
#: Comments, scripts and style sheets; one that is not closed takes all that follows. Each match ends, so time is linear.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*+(?:>.*?(?:</\1\b[^>]*+(?:>|\z)|\z)|\z)"
#: A language code of two or three letters as the value of an attribute.
_CODE = r"""\s*=\s*["']?\s*([a-z]{2,3})(?![a-z])"""
#: Trigrams of a text count as at most this many independent ones.
EVIDENCE = 60.0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _trigrams(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte trigram within a row, and its row."""
    d = _LOWER[data].astype(np.uint32)
    code = (d[:-2] << 16) | (d[1:-1] << 8) | d[2:]
    inside = rows[2:] == rows[:-2]
    return ((code[inside] * np.uint32(2654435761)) >> np.uint32(32 - 14)).astype(np.int64), rows[2:][inside]


def _visible(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes outside tags (ASCII runs of markup aside) and their rows."""
    data, offsets = text_bytes(column)
    rows = np.repeat(np.arange(len(column)), np.diff(offsets))
    if not len(data):
        return data, rows
    at = np.arange(len(data))
    opened = np.maximum.accumulate(np.where(data == 60, at, -1))
    closed = np.maximum.accumulate(np.where(data == 62, at, -1))
    begin = offsets[:-1][rows]
    text = ((opened < begin) | (closed > opened)) & (data != 62)
    return data[text], rows[text]


def fit(documents: DataFrame, max_rows: int = 4_000) -> tuple[list[str], np.ndarray]:
    """All languages of at most ``max_rows`` labelled documents, and log-probabilities (language x bucket)."""
    chosen = documents.where("lang IS NOT NULL AND doc_id IS NOT NULL").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = documents.select("doc_id", "text", "lang").where("lang IS NOT NULL").join(F.broadcast(chosen.distinct()), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                data, offsets = text_bytes(part.column("text"))
                code, own = _trigrams(data, np.repeat(np.arange(part.num_rows), np.diff(offsets)))
                names, which = np.unique(np.array(part.column("lang").to_pylist()), return_inverse=True)
                both, n = np.unique(which[own] * BUCKETS + code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([str(x) for x in names[both // BUCKETS]], pa.string()), pa.array(both % BUCKETS), pa.array(n)], names=["lang", "bucket", "n"])

    counts = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toPandas()  # at most BUCKETS rows for each language of the sample
    langs = sorted(got["lang"].unique())
    table = np.full((len(langs), BUCKETS), 0.5)
    for i, lang in enumerate(langs):
        own = got[got["lang"] == lang]
        table[i, own["bucket"].to_numpy()] += own["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def declared_language(html: str) -> Column:
    """The language that a page declares for itself; null for none."""
    root = F.regexp_extract(html, r"(?is)<html\b([^<>]*)", 1)
    meta = F.regexp_extract(html, r"""(?is)<meta\b([^<>]*\bhttp-equiv\s*=\s*["']?\s*content-language\b[^<>]*)""", 1)
    found = [F.regexp_extract(tag, rf"""(?is)(?:^|[\s"'/]){name}{_CODE}""", 1) for tag, name in ((root, "lang"), (root, "xml:lang"), (meta, "content"))]
    return F.lower(F.coalesce(*[F.nullif(f, F.lit("")) for f in found]))


def evidence(pages: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """Per page: page_id, host, suffix, declared, ll (log-likelihood of the text by language)."""
    held = pages.sparkSession.sparkContext.broadcast(model)  # languages of the sample x BUCKETS doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for part in chunks(batch, "html"):
                code, own = _trigrams(*_visible(part.column("html")))
                n = np.bincount(own, minlength=part.num_rows)
                weight = np.minimum(n, EVIDENCE) / np.maximum(n, 1)
                ll = np.stack([np.bincount(own, weights=row[code], minlength=part.num_rows) * weight for row in model], axis=1)
                ll -= ll.max(axis=1, keepdims=True)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * len(model), pa.int32()), pa.array(ll.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("page_id").cast(pa.int64()), *(part.column(c) for c in ("host", "suffix", "declared")), flat], names=["page_id", "host", "suffix", "declared", "ll"])

    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    rows = pages.select("page_id", F.nullif(host, F.lit("")).alias("host"), F.regexp_replace("html", HIDDEN, " ").alias("html"))
    rows = rows.select("page_id", "html", "host", declared_language("html").alias("declared"))
    rows = rows.withColumn("suffix", F.substring_index("host", ".", -1))
    return rows.mapInArrow(run, "page_id long, host string, suffix string, declared string, ll array<double>")


def fuse(found: DataFrame, langs: list[str], alpha: float = 4.0) -> DataFrame:
    """Posterior over ``langs`` of each page from all its evidence: adds lang, confidence, text_lang."""
    each = range(len(langs))
    post = [F.exp(F.get("ll", F.lit(i))) for i in each]
    total = sum(post[1:], post[0])
    found = found.withColumn("p", F.array(*[p / total for p in post]))
    sums = lambda by: found.where(F.col(by).isNotNull()).groupBy(by).agg(F.array(*[F.sum(F.get("p", F.lit(i))) for i in each]).alias(f"n_{by}"))
    whole = found.agg(*[F.sum(F.get("p", F.lit(i))).alias(f"g{i}") for i in each]).first()
    mass = [(whole[i] or 0.0) + 1.0 for i in each]
    top = [m / sum(mass) for m in mass]

    def smooth(counts, prior):
        n = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.when(counts.isNull(), prior).otherwise(F.array(*[(F.get(counts, F.lit(i)) + alpha * F.get(prior, F.lit(i))) / (n + alpha) for i in each]))

    suffixes = sums("suffix").withColumn("prior_suffix", smooth(F.col("n_suffix"), F.array(*[F.lit(t) for t in top]))).drop("n_suffix")
    declared = sums("declared")
    out = found
    for by, table in (("suffix", suffixes), ("host", sums("host")), ("declared", declared)):
        # A null meets nothing; spread by page, nulls don't land in one task.
        out = out.withColumn("_key", F.coalesce(by, F.concat(F.lit("\0"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
        out = out.join(table.withColumnRenamed(by, "_key"), "_key", "left").drop("_key")
    base = F.coalesce("prior_suffix", F.array(*[F.lit(t) for t in top]))
    out = out.withColumn("base", base).withColumn("prior", smooth(F.col("n_host"), F.col("base")))
    # P(declared | language): soft counts over the language's whole mass.
    trust = lambda i: F.when(F.col("n_declared").isNull(), F.lit(0.0)).otherwise(F.log((F.get("n_declared", F.lit(i)) + 0.5) / (mass[i] + 1.0)))
    score = [F.get("ll", F.lit(i)) + F.log(F.get("prior", F.lit(i))) + trust(i) for i in each]
    out = out.withColumn("score", F.array(*score))
    name = lambda a: F.get(F.array(*[F.lit(x) for x in langs]), (F.array_position(a, F.array_max(a)) - 1).cast("int"))
    z = F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("score")))
    return out.select("page_id", name(F.col("score")).alias("lang"), F.round(1 / z, 4).alias("confidence"), name(F.col("ll")).alias("text_lang"), "declared", "host")


def identify(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Per page: page_id, lang, confidence, text_lang, declared, host."""
    langs, model = fit(documents)
    if not langs:
        none = F.lit(None)
        return pages.select("page_id", none.cast("string").alias("lang"), none.cast("double").alias("confidence"), none.cast("string").alias("text_lang"), none.cast("string").alias("declared"), none.cast("string").alias("host"))
    return fuse(settle(evidence(pages, langs, model)), langs)
