"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases and maps homoglyphs and digit substitutions to letters. The lexicon holds word beginnings with their log-odds between toxic
and clean labelled documents; exception phrases (a matched word with the word before it) are
those that clean labelled documents repeat and toxic ones never hold. Matches count by weight,
in total and by length of the text, and a two-feature logistic fit maps both to 0..1.

Learning uses at most ``max_rows`` labelled rows (smallest hash of doc_id), never held-out ones.
Only the lexicon (at most ``max_terms`` entries, and as many exceptions) reaches the executors.
Terms come from the 6 * ``max_terms`` candidates of largest support times log-odds in that sample, and a
term must help one toxic row in 300 (two at least): bounds on what is learnt, never on what is scored.

Defined cases: null, empty or wordless text scores as no match; without labels of both kinds
the lexicon is empty and every score is 0; rows are scored one by one, so repeated rows score
alike; labels other than 0 and 1 are no labels; an empty table gives an empty table; other
columns are ignored. Words are runs of letters and digits: scripts without spaces have no terms
inside a run.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmill.llm.common import settle

THRESHOLD = 0.3
#: Terms are word beginnings of these lengths; shorter words are terms as a whole, marked by WHOLE.
STEM = (4, 8)
WHOLE = "|"
# Fixed folding values: Cyrillic and Greek look-alikes, then digits and signs used as letters.
_LOOKS = dict(zip("авсеіјкмнорԛѕтухԝһԁɡαεικνορτυχ", "abceijkmhopqstyxwhdgaeikvoptux", strict=True))
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
_INSIDE = re.compile(r"[0134578@$!](?:(?<=[^\W\d_].)(?=[^\W_]|[@$!])|(?=[^\W\d_])(?<!!))")
_WORD = re.compile(r"[^\W_]+")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
_LOOK_SEEN = re.compile("[" + "".join(_LOOKS) + "]")
_LOOK_TABLE = str.maketrans(_LOOKS)


def fold(text: str | None) -> str:
    """The text in lower case with look-alikes and digits inside words as letters."""
    t = (text or "").lower()
    if not t.isascii():
        if not unicodedata.is_normalized("NFKC", t):
            t = unicodedata.normalize("NFKC", t).lower()
        t = _HIDDEN.sub("", t)
        if _LOOK_SEEN.search(t):
            t = t.translate(_LOOK_TABLE)
    return _INSIDE.sub(lambda m: _SIGNS[m[0]], t)


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    fit: tuple[float, float, float] = (-20.0, 0.0, 0.0)
    automaton: ahocorasick.Automaton | None = None

    def build(self) -> Lexicon:
        if self.weights and self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for term, w in self.weights.items():
                bare = term.removesuffix(WHOLE)
                self.automaton.add_word(bare, (len(bare), w, bare != term))
            self.automaton.make_automaton()
        return self

    def __getstate__(self) -> dict:
        return self.__dict__ | {"automaton": None}

    def phrases(self, folded: str) -> Iterator[tuple[str, float]]:
        """(word before + matched word, weight) of every word that begins with a term or is one."""
        for end, (size, weight, whole) in self.automaton.iter(folded) if self.automaton else ():
            start = end - size + 1
            if (start == 0 or not folded[start - 1].isalnum()) and not (whole and folded[end + 1 : end + 2].isalnum()):
                z = start
                while z and not folded[z - 1].isalnum():
                    z -= 1
                a = z
                while a and folded[a - 1].isalnum():
                    a -= 1
                yield " ".join([*([folded[a:z]] if a < z else []), _WORD.match(folded, start)[0]]), weight

    def features(self, text: str | None) -> tuple[float, float]:
        folded = fold(text)
        total = sum(w for phrase, w in self.phrases(folded) if phrase not in self.exceptions)
        return float(np.log1p(total)), float(np.log1p(100 * total / max(1, len(folded.split()))))

    def score(self, text: str | None) -> float:
        a, b = self.features(text)
        if not self.weights:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.fit[0] + self.fit[1] * a + self.fit[2] * b, -40, 40))))


def _terms(text: str | None) -> set[str]:
    """All terms that a text could hold."""
    words = set(_WORD.findall(fold(text)))
    return {w[:n] for w in words for n in range(STEM[0], min(STEM[1], len(w)) + 1)} | {w + WHOLE for w in words if len(w) < STEM[0]}


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float, float]:
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (y - p) - ridge * w * [0, 1, 1]
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.diag([1e-6, 1, 1])
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def _cover(rows: list[set[str]], weights: dict[str, float], most: int, times: int = 3) -> dict[str, float]:
    """Greedy choice of terms: each in turn adds most weight to rows with fewer than ``times`` chosen terms.

    Words that merely come along with real terms (in copies of one toxic document) add nothing.
    """
    left, kept = {i: times for i, r in enumerate(rows) if r}, {}
    least = max(2, len(rows) // 300)
    while left and len(kept) < most:
        gain: dict[str, int] = {}
        for i in left:
            for t in rows[i] - kept.keys():
                gain[t] = gain.get(t, 0) + 1
        best = max(gain, key=lambda t: (gain[t] * weights[t], t), default=None)
        if best is None or gain[best] < least:
            break
        kept[best] = weights[best]
        for i in [i for i in left if best in rows[i]]:
            left[i] -= 1
            if not left[i]:
                del left[i]
    return kept


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, max_terms: int = 500, min_log_odds: float = 3.0, min_share: float = 0.004, min_gain: float = 15.0) -> Lexicon:
    """Lexicon, exceptions and fit from at most ``max_rows`` labelled rows that aren't held out."""
    chosen = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))
    rows = settle(rows)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list[int]] = {"": [0, 0]}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for t in _terms(text) | {""}:
                    out.setdefault(t, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(out)), pa.array([v[0] for v in out.values()], pa.int64()), pa.array([v[1] for v in out.values()], pa.int64())], names=["term", "clean", "toxic"])

    counts = settle(rows.mapInArrow(terms, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")))
    whole = counts.where("term = ''").first()
    if whole is None or not whole.t or not whole.c:
        return Lexicon()
    odds = F.log((F.col("t") + 0.5) / (whole.t + 1.0)) - F.log((F.col("c") + 0.5) / (whole.c + 1.0))
    good = counts.where("term != ''").where(F.col("t") >= max(3, min_share * whole.t)).withColumn("w", odds).where(F.col("w") >= min_log_odds)
    good = good.where(F.col("t") * F.col("w") >= min_gain)  # rarer words may be chance
    candidates: dict[str, float] = {}
    for r in sorted(good.orderBy(F.desc(F.col("t") * F.col("w")), "term").limit(6 * max_terms).collect(), key=lambda r: (len(r.term), r.term)):
        if not any(r.term[:n] in candidates for n in range(STEM[0], len(r.term))):
            candidates[r.term] = float(r.w)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [sorted(_terms(t) & candidates.keys()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.string()))], names=["terms"])

    toxic = [set(r.terms) for r in rows.where("toxic = 1").select("text").mapInArrow(present, "terms array<string>").collect()]  # at most max_rows short lists
    kept = _cover(toxic, candidates, max_terms)
    lexicon = Lexicon(kept)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.build()
        for batch in batches:
            pairs = [(p, t) for text, t in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True) for p in {p for p, _ in lex.phrases(fold(text))}]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.string()), pa.array([t for _, t in pairs], pa.int32())], names=["phrase", "toxic"])

    benign = rows.mapInArrow(found, "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).where("t = 0 AND n >= 3")
    lexicon = Lexicon(kept, frozenset(r.phrase for r in benign.orderBy(F.desc("n"), "phrase").limit(max_terms).collect()))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.build()
        for batch in batches:
            f = [lex.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in f], pa.float64()), pa.array([x[1] for x in f], pa.float64()), batch.column("toxic")], names=["a", "b", "toxic"])

    got = sorted(rows.mapInArrow(featured, "a double, b double, toxic int").collect())  # at most max_rows small rows
    x = np.array([[r.a, r.b] for r in got])
    return Lexicon(kept, lexicon.exceptions, _logistic(x, np.array([r.toxic for r in got], float)))


def scores(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Per row: doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.build()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([lex.score(t) for t in batch.column("text").to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns per document."""
    out = scores(docs, learn(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
