"""Ordered calculations over groups of any size.

A plain window puts a whole group in one task, so one hot session would decide
the run time of the job.  Two helpers avoid that:

``running``  computes row numbers, running sums, earlier maxima, last known values
             and lags in two levels.  Rows are cut into chunks by a column that
             follows the order (an hour of the clock, a block of a file).  A
             window runs inside each (group, chunk); one small row per chunk
             carries the state of all earlier chunks.  Exact for every group.

``halo``     serves frames of a fixed number of rows.  With a dense position a
             row is copied to the neighbouring chunk only where the frame crosses
             the border, so chunks can be processed apart.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3600
CHUNK_ROWS = 1 << 20


def time_chunk(ts: Column, seq: Column | None = None, seconds: int = HOUR) -> Column:
    """Chunk for the order (ts, seq).  Unknown times sort first, by seq blocks."""
    known = F.floor(ts / F.lit(seconds)).cast("bigint")
    if seq is None:
        return F.when(ts > 0, known).otherwise(F.lit(-1).cast("bigint"))
    # Below every real hour and increasing with seq.
    unknown = F.floor(seq / F.lit(CHUNK_ROWS)).cast("bigint") - F.lit(1 << 40)
    return F.when(ts > 0, known).otherwise(unknown)


def running(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[str],
    *,
    number: str | None = None,
    sums: Mapping[str, Column] | None = None,
    prev_max: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    lag: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running columns per ``keys`` in ascending ``order`` (names of columns).

    number    0-based row number
    sums      inclusive running sum
    prev_max  maximum over strictly earlier rows
    last      last non-null value at or before the row
    lag       value of the previous row; all lags share one struct
    """
    sums, prev_max = dict(sums or {}), dict(prev_max or {})
    last, lag = dict(last or {}), dict(lag or {})
    keys, order = list(keys), list(order)
    src = df.withColumn("_chunk", chunk)
    for i, e in enumerate(sums.values()):
        src = src.withColumn(f"_s{i}", e)
    for i, e in enumerate(prev_max.values()):
        src = src.withColumn(f"_m{i}", e)
    for i, e in enumerate(last.values()):
        src = src.withColumn(f"_l{i}", e)
    if lag:
        src = src.withColumn("_g", F.struct(*[e.alias(n) for n, e in lag.items()]))

    by = F.struct(*order)
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.sum(f"_s{i}").alias(f"_cs{i}") for i in range(len(sums))]
    aggs += [F.max(f"_m{i}").alias(f"_cm{i}") for i in range(len(prev_max))]
    aggs += [
        F.max_by(F.col(f"_l{i}"), F.when(F.col(f"_l{i}").isNotNull(), by)).alias(f"_cl{i}")
        for i in range(len(last))
    ]
    if lag:
        aggs.append(F.max_by("_g", by).alias("_cg"))
    totals = src.groupBy(*keys, "_chunk").agg(*aggs)

    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_pn")]
    carried += [F.coalesce(F.sum(f"_cs{i}").over(before), F.lit(0)).alias(f"_ps{i}") for i in range(len(sums))]
    carried += [F.max(f"_cm{i}").over(before).alias(f"_pm{i}") for i in range(len(prev_max))]
    carried += [F.last(f"_cl{i}", ignorenulls=True).over(before).alias(f"_pl{i}") for i in range(len(last))]
    if lag:
        one = Window.partitionBy(*keys).orderBy("_chunk")
        carried.append(F.lag("_cg").over(one).alias("_pg"))
    carry = totals.select(*keys, "_chunk", *carried)

    joined = src.join(carry, [*keys, "_chunk"])
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    out = [F.col(c) for c in df.columns]
    if number:
        out.append((F.col("_pn") + F.row_number().over(w) - 1).cast("bigint").alias(number))
    for i, n in enumerate(sums):
        out.append((F.col(f"_ps{i}") + F.coalesce(F.sum(f"_s{i}").over(upto), F.lit(0))).alias(n))
    for i, n in enumerate(prev_max):
        out.append(F.greatest(F.col(f"_pm{i}"), F.max(f"_m{i}").over(prior)).alias(n))
    for i, n in enumerate(last):
        out.append(F.coalesce(F.last(f"_l{i}", ignorenulls=True).over(upto), F.col(f"_pl{i}")).alias(n))
    if lag:
        g = F.coalesce(F.lag("_g").over(w), F.col("_pg"))
        out.append(g.alias("_lagged"))
        joined = joined.select(*out)
        return joined.select(
            *[c for c in joined.columns if c != "_lagged"],
            *[F.col("_lagged")[n].alias(n) for n in lag],
        )
    return joined.select(*out)


def halo(
    df: DataFrame, pos: Column, before: int, after: int, rows: int = CHUNK_ROWS
) -> DataFrame:
    """Copy rows into every chunk whose frames [-before, +after] can reach them.

    Adds ``_chunk`` and ``_home``; run the window per (keys, _chunk) and keep
    ``_home`` rows only.
    """
    lo = F.floor(F.greatest(pos - after, F.lit(0)) / rows)
    hi = F.floor((pos + before) / rows)
    return df.withColumn("_chunk", F.explode(F.sequence(lo, hi))).withColumn(
        "_home", F.col("_chunk") == F.floor(pos / rows)
    )
