"""URL filter: policy rules first, then a logistic regression on hashed character n-grams of host and path.

Rules are text like ``example.org/en/``: host, then the beginning of a path. A rule fits its host
and all subdomains; of the rules that fit, the longest decides (of equal ones, the first). Other
urls are judged by the model: each n-gram of host and path (``SIZES``, with marks at both ends)
adds its bucket's weight, over the root of the number of n-grams.

The model learns from a small table (url, label) of at most ``max_rows`` rows, those of smallest
hash of the url; ``ruled`` makes such a table of the urls that the rules decide. Rows are fitted in
the order of that hash, so a fit repeats exactly.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is
judged by the model's bias; without labels of both kinds the model allows everything (with one
kind only, it gives that one); repeated urls are judged alike; labels other than 0 and 1 are
ignored; other columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmill.llm.common import mix

# Fixed policy: verdict and rule.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
SIZES = (3, 4, 5)
BUCKETS = 1 << 16
MAX_ROWS = 4_000
_MARK = "\x02"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_path(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, _PARTS, i), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, begin = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + begin)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def ngrams(urls: list[tuple[str | None, str | None]], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram, offsets by url) of pairs (host, path), over their UTF-8 bytes, with a mark at every end.

    n-grams of a host and of a path have buckets of their own. A url takes two stretches of bytes.
    """
    texts = [(x or "").replace(_MARK, " ") for u in urls for x in u]
    data = np.frombuffer(_MARK.join(["", *texts, ""]).encode(), np.uint8).astype(np.uint64)
    marks = np.flatnonzero(data == ord(_MARK))
    code, found, owner = np.zeros(len(data), np.uint64), [], []
    for n in range(1, max(SIZES) + 1):
        code = code[: max(0, len(data) - n + 1)] * np.uint64(257) + data[n - 1 :] + np.uint64(1)
        if n in SIZES:
            first = np.arange(len(code))
            of = np.searchsorted(marks, first, side="right") - 1
            inside = first + n - 1 <= np.append(marks, -1)[of + 1]
            of = of[inside]
            owner.append(of // 2)
            found.append((mix(code[inside] * np.uint64(2) + (of % 2).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64))
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return found[order], np.searchsorted(owner[order], np.arange(len(urls) + 1))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, urls: list[tuple[str | None, str | None]]) -> np.ndarray:
        """Probability that each (host, path) is to be blocked."""
        found, offsets = ngrams(urls, len(self.weights))
        sums = np.concatenate(([0.0], np.cumsum(self.weights[found])))
        n = np.maximum(np.diff(offsets), 1)
        z = self.bias + (sums[offsets[1:]] - sums[offsets[:-1]]) / np.sqrt(n)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_rows(urls: list[tuple[str | None, str | None]], y: list[int], buckets: int = BUCKETS, ridge: float = 1e-4, rounds: int = 300) -> Model:
    """Logistic regression by accelerated gradient steps from zero."""
    weights, bias = np.zeros(buckets), 0.0
    if len(set(y)) < 2:
        return Model(weights, 40.0 if set(y) == {1} else -40.0)
    found, offsets = ngrams(urls, buckets)
    n = np.maximum(np.diff(offsets), 1)
    row, truth = np.repeat(np.arange(len(y)), np.diff(offsets)), np.asarray(y, float)
    value = 1 / np.sqrt(n[row])
    cells, cell = np.unique(row * buckets + found, return_inverse=True)
    norms = np.bincount(cells // buckets, weights=np.bincount(cell, weights=value) ** 2)
    step = 4 / (1 + norms.max(initial=0) + 4 * ridge)
    ahead, ahead_bias, pace = weights, bias, 1.0
    for _ in range(rounds):
        z = ahead_bias + np.bincount(row, weights=ahead[found] * value, minlength=len(y))
        off = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - truth) / len(y)
        new = ahead - step * (np.bincount(found, weights=off[row] * value, minlength=buckets) + ridge * ahead)
        new_bias, next_pace = ahead_bias - step * off.sum(), (1 + (1 + 4 * pace**2) ** 0.5) / 2
        ahead, ahead_bias = new + (pace - 1) / next_pace * (new - weights), new_bias + (pace - 1) / next_pace * (new_bias - bias)
        weights, bias, pace = new, new_bias, next_pace
    return Model(weights, float(bias))


def fit(labelled: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model of (url, label): label 1 is to be blocked, 0 allowed."""
    rows = labelled.where(F.col("label").isin(0, 1)).select("url", F.col("label").cast("int").alias("label")).distinct()
    host, path = host_path(F.col("url"))
    rows = rows.orderBy(F.md5("url"), "url", "label").limit(max_rows).select(host.alias("host"), path.alias("path"), "label").collect()  # the bounded sample
    return fit_rows([(r.host, r.path) for r in rows], [r.label for r in rows])


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """(url, label) of the urls that a rule decides."""
    _, verdict = fitting_rule(*host_path(F.col("url")), rules)
    return pages.select("url", F.when(verdict == "block", 1).when(verdict == "allow", 0).alias("label")).where(F.col("label").isNotNull())


def judge(pages: DataFrame, model: Model, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, and score (the model's, where no rule fits)."""

    @F.pandas_udf("double")
    def score(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series(model.score(list(zip(hosts.tolist(), paths.tolist(), strict=True))))

    host, path = host_path(F.col("url"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "verdict": verdict})
    free = F.col("rule").isNull()
    rows = rows.withColumn("score", F.when(free, score(F.when(free, F.col("host")), F.when(free, F.col("path")))))
    return rows.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow")))
