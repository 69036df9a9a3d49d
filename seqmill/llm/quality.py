"""Quality rules as a bitmask ledger (native: DataFrame expressions only).

Every rule is evaluated once per document. The ledger keeps the measurements and one failure
bit per rule; policies are versioned sets of rules and are applied to the bits alone, and
ablations come from bitwise aggregation over the ledger, so no rule is ever run again.

Defined cases: a null text has no words and fails ``short``; an empty table gives an empty
ledger; repeated rows each get their own ledger row; other columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmill.llm.common import SPACES, named, strip_chars, words_of

#: Characters that the contract counts as symbols (fixed values).
SYMBOLS = ("#", "*", "$", "%", "&", "|", "<", ">")

#: Rule name -> failure predicate over the measurements. The position is the bit and never changes.
RULES: dict[str, str] = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "n_lines > 0 AND 100 * n_dup_lines > 60 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
}
#: Policy version -> rules in force.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("short", "repetitive"),
    "2024-1": ("short", "repetitive", "symbol_heavy"),
    "2024-2": ("short", "repetitive", "symbol_heavy", "duplicate_lines", "word_length"),
}
CURRENT = "2024-2"


def mask(policy: str) -> int:
    """Bits of a policy's rules."""
    names = list(RULES)
    return sum(1 << names.index(r) for r in POLICIES[policy])


def measure(docs: DataFrame, text: str = "text", *carry: str) -> DataFrame:
    """Measurements per document: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    A repeated 3-word window is found by sorting (hash of the three words, position) within
    the document's own array: equal neighbours are repeats, and the covered words are the sum
    of the steps, at most three, between the sorted positions of repeated windows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    bare = strip_chars(t, SPACES)
    base = docs.select(*carry, t.alias("_text"), words_of(F.col(text)).alias("_w"), bare.alias("_bare"))
    gram = lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.trim(strip_chars(x, SPACES[1:])) != "")
    base = base.select(
        *carry,
        F.size("_w").cast("long").alias("n_words"),
        F.char_length("_bare").cast("long").alias("word_chars"),
        (F.char_length("_bare") - F.char_length(strip_chars(F.col("_bare"), SYMBOLS))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), gram)).otherwise(F.array().cast("array<bigint>")).alias("_h"),
    )
    # Most texts repeat no window at all: only the others are sorted.
    some = F.size(F.array_distinct("_h")) < F.size("_h")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    pairs = F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    base = base.withColumn("_g", F.when(some, F.sort_array(pairs)).otherwise(none))
    repeated = lambda x, j: F.when((x["h"] == F.get("_g", j - 1)["h"]) | (x["h"] == F.get("_g", j + 1)["h"]), x["i"])
    base = base.select(
        *carry, "n_words", "word_chars", "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.array_compact(F.transform("_g", repeated))).alias("_at"),
    )
    step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"))
    covered = F.aggregate("_at", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), step, lambda acc: acc["n"])
    return base.withColumn("n_repeat_words", covered.cast("long")).drop("_at")


def ledger(docs: DataFrame, text: str = "text", *carry: str) -> DataFrame:
    """Measurements and ``failed`` (long): bit b is set where rule b of RULES fails."""
    out = measure(docs, text, *carry)
    bits = [F.when(F.expr(rule), F.lit(1 << b)).otherwise(F.lit(0)) for b, rule in enumerate(RULES.values())]
    return out.withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long"))


def passes(policy: str = CURRENT, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(policy))) == 0


def ablations(book: DataFrame, *policies: str) -> DataFrame:
    """Per policy version (the current one unless named) and rule of it: documents that fail it, that fail
    nothing else, and that are kept without it; n_kept under the whole policy; the bits seen in the ledger.

    All versions come from one bitwise aggregation; an empty ledger gives zeros.
    """
    names, failed = list(RULES), F.col("failed")
    rows = []
    for policy in policies or (CURRENT,):
        m = mask(policy)
        for rule in POLICIES[policy]:
            bit = 1 << names.index(rule)
            of = failed.bitwiseAND(F.lit(m))
            rows += [
                F.struct(
                    F.lit(policy).alias("policy"), F.lit(rule).alias("rule"), F.count_if(of.bitwiseAND(F.lit(bit)) != 0).alias("n_failed"), F.count_if(of == bit).alias("n_only"),
                    F.count_if(of.bitwiseAND(F.lit(m ^ bit)) == 0).alias("n_kept_without"), F.count_if(of == 0).alias("n_kept"),
                )
            ]
    seen = book.agg(F.array(*rows).alias("r"), F.coalesce(F.bit_or("failed"), F.lit(0)).cast("long").alias("bits_seen"))
    return seen.select(F.explode("r").alias("r"), "bits_seen").select("r.*", "bits_seen")


def verdicts(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The contract's digest per document, from the ledger."""
    book = ledger(docs, "text", "doc_id")
    base = F.col("failed").bitwiseAND(F.lit(mask("base"))) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & passes(policy)).alias("kept"), F.col("failed").alias("failed_bits"))


def keep(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents that the policy accepts, with their own columns and nothing else."""
    whole = docs.select(F.struct(*map(named, docs.columns)).alias("_doc"), F.col("text").alias("_t"))
    # A filter on the verdict would be pushed below the ledger with all its expressions copied
    # into it; one on an exploded value stays where it is.
    kept = ledger(whole, "_t", "_doc").select(F.explode_outer(F.array(F.when(passes(policy), F.col("_doc")))).alias("_doc"))
    return kept.where("_doc IS NOT NULL").select("_doc.*")
