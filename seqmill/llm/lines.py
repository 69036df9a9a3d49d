"""Line dedup by distinct-site spread (native: DataFrame expressions only).

Lines are keyed by a 128-bit hash of their trimmed text. HyperLogLog sketches of the sites a
line occurs on merge by aggregation (partial sketches are built before the shuffle, so a line
on a third of all rows costs one sketch per task). A line whose estimate lies within the
sketch's error of the threshold gets an exact distinct count. Lines on ``min_sites`` sites or
more are boilerplate and are removed everywhere; blank lines are never judged.

Defined cases: null text has no lines and comes back as null; a null site counts as no site;
an empty table gives an empty table; repeated rows are treated alike; rows that share a doc_id
each lose the boilerplate lines they hold, rows with a null one too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmill.llm.common import SPACES, named, settle

MIN_SITES = 10
LG_K = 12


def _trimmed(line):
    return F.btrim(line, F.lit("".join(SPACES)))


def _hashes(line):
    """128 bits of a trimmed line."""
    return F.struct(F.xxhash64(line).alias("h"), F.xxhash64(F.lit("second"), line).alias("h2"))


def site_lines(docs: DataFrame, site: str = "source") -> DataFrame:
    """One row per line with a word: doc_id, site, h, h2."""
    rows = docs.select("doc_id", F.col(site).alias("site"), F.explode(F.split("text", "\n")).alias("line"))
    rows = rows.select("doc_id", "site", _trimmed(F.col("line")).alias("line")).where("line != ''")
    return rows.select("doc_id", "site", _hashes(F.col("line")).alias("x")).select("doc_id", "site", "x.h", "x.h2")


def spread(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """Keys of the boilerplate lines: h, h2, sites (estimate, or exact where near), exact (boolean)."""
    margin = max(1.0, 4 * 1.04 / (2 ** (lg_k / 2)) * min_sites)
    sketched = lines.where("site IS NOT NULL").groupBy("h", "h2").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sk"), F.count("*").alias("n"))
    sketched = sketched.where(F.col("n") >= min_sites).select("h", "h2", F.hll_sketch_estimate("sk").alias("est"))
    sketched = settle(sketched.where(F.col("est") >= min_sites - margin))
    sure = sketched.where(F.col("est") > min_sites + margin).select("h", "h2", F.col("est").alias("sites"), F.lit(False).alias("exact"))
    near = sketched.where(F.col("est") <= min_sites + margin).select("h", "h2")
    pairs = lines.where("site IS NOT NULL").join(near, ["h", "h2"], "left_semi").distinct()
    exact = pairs.groupBy("h", "h2").agg(F.count_distinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    return sure.unionByName(exact.select("h", "h2", "sites", F.lit(True).alias("exact")))


def _without(docs: DataFrame, site: str, min_sites: int) -> DataFrame:
    """(_doc, _text, _removed): each row whole, its text without boilerplate lines, and their number.

    Only (doc_id, line hash) of the lines that go is gathered; each text moves once.
    """
    lines = site_lines(docs, site)
    gone = lines.select("doc_id", "h", "h2").join(spread(lines, min_sites).select("h", "h2"), ["h", "h2"])
    gone = gone.groupBy("doc_id").agg(F.collect_set(F.struct("h", "h2")).alias("_gone"))
    whole = docs.select(F.struct(*map(named, docs.columns)).alias("_doc"))
    gone = gone.withColumnRenamed("doc_id", "_id")
    out = whole.join(gone, whole["_doc"].getField("doc_id").eqNullSafe(gone["_id"]), "left")
    text = F.col("_doc").getField("text")
    old = F.split(text, "\n")
    stays = lambda x: (_trimmed(x) == "") | ~F.array_contains("_gone", _hashes(_trimmed(x)))
    out = out.withColumn("_new", F.when(F.col("_gone").isNull(), old).otherwise(F.filter(old, stays)))
    removed = F.coalesce(F.size(old) - F.size("_new"), F.lit(0)).cast("long")
    return out.select("_doc", F.when(F.col("_gone").isNull(), text).otherwise(F.array_join("_new", "\n")).alias("_text"), removed.alias("_removed"))


def _columns(docs: DataFrame) -> list:
    return [(F.col("_text") if c == "text" else F.col("_doc").getField(c)).alias(c) for c in docs.columns]


def dedup(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with ``text`` without its boilerplate lines, and ``n_removed_lines`` (in place of a column of that name)."""
    kept = [x for c, x in zip(docs.columns, _columns(docs), strict=True) if c != "n_removed_lines"]
    return _without(docs, site, min_sites).select(*kept, F.col("_removed").alias("n_removed_lines"))


def digest(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Per document: lines removed and SHA-256 of the text left (null text: of nothing)."""
    out = dedup(docs.select("doc_id", "text", "source"), "source", min_sites)
    left = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_removed_lines", F.char_length(left).cast("long").alias("n_chars_left"), F.sha2(left.cast("binary"), 256).alias("kept_sha256"))


def clean(docs: DataFrame) -> DataFrame:
    """Pipeline form: the columns of ``docs``; ``n_chars`` (where there) follows the text."""
    out = _without(docs, "source", MIN_SITES).select(*_columns(docs))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
