"""Statistics of masks over tensors: reductions along named axes, flags packed as bits, one aggregate per clip.

A frame is a row whose tensors are nested arrays; a mask of a few flags becomes one whole number, so
that rates, recovered values and frames that lack everything come from bit operations of one
partial aggregate. Null flags are false, null values are neither zero nor outside.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _merged(a: Column, b: Column, depth: int, op: Callable[[Column, Column], Column]) -> Column:
    return op(a, b) if depth == 0 else F.zip_with(a, b, lambda x, y: _merged(x, y, depth - 1, op))


def reduced(mask: Column, axes: Sequence[str], over: Collection[str], how: str = "any") -> Column:
    """A nested boolean array reduced along the axes named in ``over``; the other axes stay, in their order."""
    if how not in ("any", "all") or not set(over) <= set(axes):
        raise ValueError(f"no reduction {how!r} of {axes} along {over}")
    if not axes:
        return F.coalesce(mask, F.lit(False))
    parts = F.transform(mask, lambda m: reduced(m, axes[1:], [a for a in over if a in axes[1:]], how))
    if axes[0] not in over:
        return parts
    kept = sum(a not in over for a in axes[1:])
    if kept == 0:
        return (F.exists if how == "any" else F.forall)(parts, lambda p: p)
    op = Column.__or__ if how == "any" else Column.__and__
    return F.aggregate(F.slice(parts, 2, F.size(parts)), F.get(parts, F.lit(0)), lambda a, p: _merged(a, p, kept, op))


def mapped(tensor: Column, depth: int, test: Callable[[Column], Column]) -> Column:
    """``test`` of every value of a tensor of ``depth`` axes."""
    return test(tensor) if depth == 0 else F.transform(tensor, lambda t: mapped(t, depth - 1, test))


def packed(flags: Column) -> Column:
    """Up to 63 flags as one number; the first is the lowest bit."""
    return F.aggregate(F.reverse(flags), F.lit(0).cast("long"), lambda bits, f: F.shiftleft(bits, 1).bitwiseOR(F.coalesce(f, F.lit(False)).cast("long")))


def _values(tensor: Column, depth: int) -> Column:
    for _ in range(depth - 1):
        tensor = F.flatten(tensor)
    return tensor


def _count(tensor: Column, depth: int, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(_values(tensor, depth), test))


def _share(part: Column, of: Column) -> Column:
    return F.try_divide(F.sum(part), F.sum(of))


def _held(bits: str, i: int) -> Column:
    return F.col(bits).bitwiseAND(1 << i) != 0


def _outside(positions: Column, margin: float) -> Column:
    """How many coordinates of each unit lie outside [-margin, 1 + margin]."""
    return F.transform(positions, lambda p: F.size(F.filter(p, lambda v: (v < -margin) | (v > 1 + margin))))


def _shaped(tensor: Column, shape: Sequence[int]) -> Column:
    own = F.size(tensor) == shape[0]
    return F.coalesce(own if len(shape) == 1 else own & F.forall(tensor, lambda t: _shaped(t, shape[1:])), F.lit(False))


def _along(positions: Column, unit: int) -> Column:
    return F.get(F.get(positions, F.lit(unit)), F.lit(1))


def clip_statistics(frames: DataFrame, keys: list[str], joints: int = 17, margin: float = 0.2, split: float = 0.5) -> DataFrame:
    """Rates and counts of two tracked units, per clip.

    ``frames`` holds joints (2 x ``joints`` x 2), positions (2 x 2), shuttle (2) and the masks
    pose_valid, pose_observed, position_valid, position_observed (2 flags each). A frame of another
    shape clears valid_shape; what it holds is counted all the same.
    """
    masks = ("pose_valid", "pose_observed", "position_valid", "position_observed")
    shapes = [_shaped(F.col("joints"), (2, joints, 2)), _shaped(F.col("positions"), (2, 2)), _shaped(F.col("shuttle"), (2,)), *[_shaped(F.col(m), (2,)) for m in masks]]
    shaped = shapes[0]
    for s in shapes[1:]:
        shaped &= s
    zero = lambda v: v == 0
    rows = frames.select(
        *keys, shaped.alias("_shaped"), *[F.coalesce(packed(F.col(m)), F.lit(0)).alias(f"_{m}") for m in masks], _outside(F.col("positions"), margin).alias("_outside"),
        F.coalesce(F.exists("shuttle", lambda v: v != 0), F.lit(False)).alias("_shuttle"), *[_along(F.col("positions"), u).alias(f"_along{u}") for u in (0, 1)],
        *[c for t, d in (("joints", 3), ("positions", 2)) for c in (_count(F.col(t), d, zero).alias(f"_{t}_zero"), F.size(_values(F.col(t), d)).alias(f"_{t}_size"))],
    )
    recovered = lambda what: F.sum(F.bit_count(F.col(f"_{what}_valid").bitwiseAND(F.bitwise_not(F.col(f"_{what}_observed")))))
    missing = lambda what: F.col(f"_{what}_valid") == 0
    out = sum((F.when(_held("_position_valid", u), F.coalesce(F.get("_outside", F.lit(u)), F.lit(0))).otherwise(0) for u in (0, 1)), F.lit(0))
    crossed = F.coalesce(_held("_position_valid", 0) & (F.col("_along0") > split), F.lit(False)) | F.coalesce(_held("_position_valid", 1) & (F.col("_along1") <= split), F.lit(False))
    rate = lambda flag: F.avg(flag.cast("int"))
    units = [rate(_held(f"_{what}_{kind}", u)).alias(f"p{u + 1}_{what}_{kind}_rate") for what in ("pose", "position") for kind in ("observed", "valid") for u in (0, 1)]
    both = [c for what in ("pose", "position") for c in (F.count_if(missing(what)).alias(f"both_{what}_missing_frames"), rate(missing(what)).alias(f"both_{what}_missing_rate"), recovered(what).cast("long").alias(f"{what}_recovered_values"))]
    return rows.groupBy(*keys).agg(
        F.count("*").alias("frame_count"), F.bool_and("_shaped").alias("valid_shape"), *units, *both, rate(F.col("_shuttle")).alias("shuttle_visible_rate"),
        *[_share(F.col(f"_{t}_zero"), F.col(f"_{t}_size")).alias(f"{n}_tensor_zero_rate") for t, n in (("joints", "pose"), ("positions", "position"))],
        F.sum(out).cast("long").alias("position_values_outside"), F.count_if(crossed).alias("side_inconsistent_frames"), rate(crossed).alias("side_inconsistent_rate"),
    )


def branch_statistics(frames: DataFrame, keys: list[str], tolerance: float = 0.2, split: float = 0.5) -> DataFrame:
    """The same tensors without masks: a unit is there where any of its values is not zero; for comparing two branches."""
    nonzero = lambda v: v != 0
    pose = reduced(mapped(F.col("joints"), 3, nonzero), ["unit", "joint", "xy"], ["joint", "xy"])
    position = reduced(mapped(F.col("positions"), 2, nonzero), ["unit", "xy"], ["xy"])
    zero = lambda v: v == 0
    rows = frames.select(
        *keys, packed(pose).alias("_pose"), packed(position).alias("_position"), _outside(F.col("positions"), tolerance).alias("_outside"), reduced(mapped(F.col("shuttle"), 1, zero), ["xy"], ["xy"], "all").alias("_hidden"),
        *[_along(F.col("positions"), u).alias(f"_along{u}") for u in (0, 1)],
        *[c for t, d in (("joints", 3), ("positions", 2)) for c in (_count(F.col(t), d, zero).alias(f"_{t}_zero"), F.size(_values(F.col(t), d)).alias(f"_{t}_size"))],
    )
    out = sum((F.when(_held("_position", u), F.get("_outside", F.lit(u))).otherwise(0) for u in (0, 1)), F.lit(0))
    kept = (~_held("_position", 0) | (F.col("_along0") <= split)) & (~_held("_position", 1) | (F.col("_along1") > split))
    rate = lambda flag: F.avg(F.coalesce(flag, F.lit(False)).cast("int"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("length"), rate(F.col("_pose") == 3).alias("both_pose_valid_rate"), rate(F.col("_position") == 3).alias("both_position_valid_rate"),
        _share(F.col("_joints_zero"), F.col("_joints_size")).alias("pose_zero_rate"), _share(F.col("_positions_zero"), F.col("_positions_size")).alias("position_zero_rate"), rate(F.col("_hidden")).alias("shuttle_zero_rate"),
        F.sum(out).cast("long").alias("position_values_outside"), (F.sum(out) / F.greatest(F.sum(F.bit_count("_position")) * 2, F.lit(1))).alias("position_outside_rate"), rate(kept).alias("side_consistency_rate"),
    )
