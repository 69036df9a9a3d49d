"""Scalar expressions of the engine (all built-in functions, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_text(c: Column) -> Column:
    """Trimmed key; a whole number loses its fraction ("12.0" -> "12"), other text stays."""
    t = F.trim(c)
    n = t.try_cast("double")
    return F.when(n.isNotNull() & (n == F.floor(n)), F.floor(n).cast("bigint").cast("string")).otherwise(t)


def lenient_int(c: Column, default: int = 0) -> Column:
    """Text to integer through double, truncated; anything else is the default."""
    return F.coalesce(c.cast("string").try_cast("double").try_cast("bigint"), F.lit(default))


def truth(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes", "y"), F.lit(False))


def without_side(label: Column) -> Column:
    """Label without what stands before its first underscore; null is ``none``."""
    return F.when(label.isNull() | (label == "none"), "none").otherwise(F.regexp_replace(label, "^[^_]*_", ""))


def binned(c: Column, edges: list[float]) -> Column:
    """Index of the half-open bin [edge, next edge); null outside."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        out = F.when((c >= edges[i]) & (c < edges[i + 1]), i).otherwise(out)
    return out


def side_and_name(label: Column) -> Column:
    """("Top", "net shot") of "Top_net shot"; a label without an underscore has no side."""
    at = F.instr(label, "_")
    return F.struct(F.when(at > 0, F.substring_index(label, "_", 1)).otherwise("").alias("side"), F.regexp_replace(label, "^[^_]*_", "").alias("name"))


def translated(c: Column, words: dict[str, str], default: str | None = None) -> Column:
    """Token by a vocabulary; others become ``default``, or stay as they are."""
    if not words:
        return c if default is None else F.lit(default)
    pairs = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, c), c if default is None else F.lit(default))


# The strokes in the order of the classes.
STROKES = ["net shot", "return net", "smash", "lob", "clear", "drive", "drop", "push", "rush", "cross-court net shot", "short service", "long service"]
#: The 25 classes; a label's place is its code.
LABELS = ["none", *[f"{side}_{stroke}" for side in ("Top", "Bottom") for stroke in STROKES]]


def label_code(label: Column, labels: list[str] = LABELS) -> Column:
    """Place of a label in the ordered dictionary, from 0; -1 where it isn't in there."""
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in labels]), label).cast("int") - 1, F.lit(-1))


def label_of(code: Column, labels: list[str] = LABELS) -> Column:
    """Label of a code; null outside the dictionary."""
    return F.when(code >= 0, F.get(F.array(*[F.lit(x) for x in labels]), code.cast("int")))


def unaliased(source: Column) -> Column:
    """True where a row's features are its own: no alias source, or an empty one."""
    return F.coalesce(source.cast("string"), F.lit("")) == ""


def in_shard(index: Column, workers: int, worker: int) -> Column:
    """Whether a row numbered from 0 belongs to one of ``workers`` equal shards."""
    return F.pmod(index, F.lit(workers)) == worker


def id_ranges(spec: str) -> list[tuple[int, int]]:
    """Inclusive ranges of "1-34,40"; blanks between are fine, anything else raises."""
    out = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        low, _, high = part.partition("-")
        out.append((int(low), int(high or low)))
        if out[-1][0] > out[-1][1]:
            raise ValueError(f"the range {part!r} runs backwards")
    return out


def in_ranges(c: Column, spec: str) -> Column:
    out = F.lit(False)
    for low, high in id_ranges(spec):
        out = out | c.between(low, high)
    return out


def split_of(c: Column, default: str, **specs: str) -> Column:
    """Name of the first split whose ranges hold the id."""
    out = F.lit(default)
    for name, spec in reversed(specs.items()):
        out = F.when(in_ranges(c, spec), name).otherwise(out)
    return out


def dropout_tier(rate: Column, labelled: Column) -> Column:
    """Quality tier of a rate of missing poses, with the kind of label in front."""
    tier = F.when(rate == 1, "all_pose_missing").when(rate >= 0.5, "pose_dropout_ge_50").when(rate >= 0.25, "pose_dropout_25_50").otherwise("pose_dropout_lt_25")
    return F.concat(F.when(labelled, "exact_label_").otherwise("candidate_only_"), tier)


def complement_mean(a: Column, b: Column, fallback: Column) -> Column:
    """1 less the mean of two rates; the fallback where one is missing."""
    return F.coalesce(1 - (a + b) / 2, fallback)


def first_source(**sources: Column) -> Column:
    """(value, source): the first of the named columns that isn't null."""
    tag = F.coalesce(*[F.when(c.isNotNull(), name) for name, c in sources.items()])
    return F.struct(F.coalesce(*sources.values()).alias("value"), tag.alias("source"))


def length_verdict(duration: Column, least: float, most: float) -> Column:
    """Why an interval is rejected: too_short, too_long, or nothing (bounds are fine)."""
    return F.when(duration < least, "too_short").when(duration > most, "too_long").otherwise("")


def transition_name(code: Column) -> Column:
    """Name of a transition between the two states; null is queued."""
    names = {0: "inactive_to_inactive", 1: "inactive_to_active", 2: "active_to_active", 3: "active_to_inactive"}
    out = F.when(code.isNull(), "queued")
    for k, v in names.items():
        out = out.when(code == k, v)
    return out


def ratio_text(c: Column, places: int = 6) -> Column:
    return F.format_string(f"%.{places}f", c.cast("double"))


def inside_court(position: Column, low: float = -0.2, high: float = 1.2) -> Column:
    """Whether a position is anything but all zeros, and all of it within bounds."""
    return F.exists(position, lambda x: x != 0) & F.forall(position, lambda x: x.between(low, high))


def delta_text(names: Column, deltas: Column, k: int) -> Column:
    """The k largest deltas as "name(+0.123), ...", ties by name."""
    pairs = F.zip_with(names, deltas, lambda n, d: F.struct((-d).alias("d"), n.alias("n")))
    return F.array_join(F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.concat(p["n"], F.lit("("), F.format_string("%+.3f", -p["d"]), F.lit(")"))), ", ")


def pearson(a: str, b: str) -> Column:
    """Aggregate: correlation of two columns over the rows that have both; null without variation (``corr`` fails there)."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
