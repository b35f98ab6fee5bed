"""Exact joins of points with intervals, of any length and overlap.

Every interval is cut into aligned blocks of 64, 512, 4096 ... seconds (at most 14
per level); a point lies in one block per level.  The join is then an equi-join on
(keys, level, block), with the true bounds checked after.  Rows grow with the inputs
and the answer, never with their product.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import HOUR, running

UNIT, BASE, LEVELS = 64, 8, 10  # the widest block is beyond any epoch time

_BLOCK = "struct<level: int, block: bigint>"


def _run(start: str, stop: str) -> str:
    return (
        f"transform(if({start} < {stop}, sequence({start}, {stop} - 1), cast(array() as array<bigint>)), "
        f"k -> struct(l as level, k as block))"
    )


def _cover(lo: str, hi: str) -> str:
    """Blocks covering [lo, hi]: per level those that no whole parent covers."""
    up = f"cast(ceil(s.a / {BASE}D) as bigint)"
    down = f"cast(floor(s.b / {BASE}D) as bigint)"
    all_here = f"named_struct('a', 0L, 'b', 0L, 'out', concat(s.out, {_run('s.a', 's.b')}))"
    edges = f"concat(s.out, {_run('s.a', f'{up} * {BASE}')}, {_run(f'{down} * {BASE}', 's.b')})"
    pass_up = f"named_struct('a', {up}, 'b', {down}, 'out', {edges})"
    last = f"l = {LEVELS} or {up} >= {down}"
    return (
        f"aggregate(sequence(1, {LEVELS}), named_struct('a', cast(floor({lo} / {UNIT}) as bigint), "
        f"'b', cast(floor({hi} / {UNIT}) as bigint) + 1, 'out', cast(array() as array<{_BLOCK}>)), "
        f"(s, l) -> if(s.a >= s.b, s, if({last}, {all_here}, {pass_up})), s -> s.out)"
    )


def with_blocks(df: DataFrame, lo: str, hi: str) -> DataFrame:
    """One row per covering block of [lo, hi]; adds ``_level`` and ``_block``."""
    return df.selectExpr("*", f"inline({_cover(lo, hi)}) as (_level, _block)")


def with_wide_blocks(df: DataFrame, lo: str, hi: str) -> DataFrame:
    """``with_blocks`` of one size for each row: the widest no longer than [lo, hi], nine at most."""
    sizes = [UNIT * BASE**k for k in range(LEVELS)]
    level = " ".join(f"when {hi} - {lo} < {float(size)!r}D then {k}" for k, size in enumerate(sizes) if k)
    df = df.selectExpr("*", f"case {level} else {LEVELS} end as _level")
    size = f"element_at(array({', '.join(f'{float(size)!r}D' for size in sizes)}), _level)"
    return df.where(f"{lo} <= {hi}").selectExpr(
        "*", f"explode(sequence(cast(floor({lo} / {size}) as bigint), cast(floor({hi} / {size}) as bigint))) as _block")


def point_blocks(df: DataFrame, t: str) -> DataFrame:
    blocks = ", ".join(
        f"struct({k} as level, cast(floor({t} / {float(UNIT * BASE ** (k - 1))!r}D) as bigint) as block)"
        for k in range(1, LEVELS + 1)
    )
    return df.selectExpr("*", f"inline(array({blocks})) as (_level, _block)")


def stab_join(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], t: str, lo: str, hi: str,
    *, closed: bool = True, tiles: bool = False,
) -> DataFrame:
    """Inner join of points with the intervals holding them: lo <= t <= hi (or < hi).

    Column names other than ``keys`` must differ between the two frames.  ``tiles`` is for
    intervals that follow each other: a point that a wide block brings in beside its
    interval then lies in a neighbour, so what is checked stays near the answer.
    """
    # Rows of blocks are many for one, which Spark's estimate leaves out: unasked it may broadcast them.
    p, i = point_blocks(points, t).hint("merge"), (with_wide_blocks if tiles else with_blocks)(intervals, lo, hi)
    j = p.join(i, [*keys, "_level", "_block"])
    inside = (F.col(t) >= F.col(lo)) & ((F.col(t) <= F.col(hi)) if closed else (F.col(t) < F.col(hi)))
    return j.where(inside).drop("_level", "_block")


def with_edges(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], ids: Sequence[str], t: str, lo: str, hi: str, closed: Column
) -> DataFrame:
    """Points and both ends of every interval in one line; ordered by (_t, _k, _id).

    ``_side`` is -1 on the row before an interval's first point, 1 on the row after its
    last, NULL on points.  ``points`` brings ``_id``; ``closed`` tells where hi belongs in.
    """
    end = lambda t, k, side: F.struct(F.col(t).cast("double").alias("_t"), k.alias("_k"), F.lit(side).alias("_side"))
    ends = F.array(end(lo, F.lit(0), -1), end(hi, F.when(closed, 2).otherwise(0), 1))
    e = intervals.where((F.col(lo) < F.col(hi)) | (closed & (F.col(lo) == F.col(hi)))).select(*keys, *ids, F.inline(ends))
    p = points.withColumn("_t", F.col(t).cast("double")).withColumn("_k", F.lit(1)).drop(t)
    return p.where("_t is not null").unionByName(e, allowMissingColumns=True)


def edge_chunk() -> Column:
    return F.floor(F.greatest(F.col("_t"), F.lit(-1.0)) / F.lit(HOUR)).cast("bigint")


def stab_counts(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], ids: Sequence[str], t: str, lo: str, hi: str, closed: Column
) -> DataFrame:
    """(ids, n): points inside the intervals of each id, from running counts at both ends.

    Rows are the points and two per interval, whatever the number of pairs that meet.
    """
    p = points.select(*keys, t, F.lit(None).cast("bigint").alias("_id"))
    line = with_edges(p, intervals, keys, ids, t, lo, hi, closed)
    upto = running(line, keys, edge_chunk(), ["_t", "_k"], sums={"_upto": F.when(F.col("_k") == 1, 1).otherwise(0)})
    return upto.where("_side is not null").groupBy(*ids).agg(F.sum(F.col("_side") * F.col("_upto")).alias("n"))
