"""Helpers that several operators share."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, tune, written

__all__ = ["checkpoint_dir", "components", "in_ranges", "pieces", "ready", "table", "unzip", "written", "zipped"]

BATCH_ROWS = 2000
PIECE_BYTES = 4 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of the operators: adaptive plans and small Arrow batches."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 * PIECE_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` (text or binary) holds about ``limit`` bytes in each."""
    for batch in batches:
        values = batch.column(column)
        at, size = 0, 0
        for k, v in enumerate(pc.binary_length(values).to_pylist()):
            if size and size + (v or 0) > limit:
                yield batch.slice(at, k - at)
                at, size = k, 0
            size += v or 0
        if at < batch.num_rows:
            yield batch.slice(at)
        del batch, values
        pa.default_memory_pool().release_unused()  # a worker lives on between tasks


def zipped(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and the text as zstandard frames in ``_z`` (null stays null).

    For texts that a shuffle has to carry: half the bytes of the row format's own codec.
    """
    kept = docs.select(*keep, F.col(text).alias("_z"))
    schema = kept.withColumn("_z", F.col("_z").cast("binary")).schema

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in pieces(batches, "_z"):
            z = [None if t is None else pack(t) for t in b.column("_z").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(z, pa.binary())], names=[*keep, "_z"])

    return kept.mapInArrow(run, schema)


def unzip(values: list[bytes | None]) -> list[bytes | None]:
    open_ = zstandard.ZstdDecompressor().decompress
    return [None if z is None else open_(z) for z in values]


def in_ranges(rows: DataFrame, ids: DataFrame, column: str, spread: str) -> DataFrame:
    """``rows`` in partitions that follow ``column`` in ascending order, null first.

    Bounds are percentiles of ``ids``, a narrow frame with the same column, so rows are made
    once and not a second time to be sampled.  An id (or null) that fills several ranges
    is dealt to them by the hash of ``spread``, a binary column.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = ", ".join(f"{k / n}D" for k in range(1, n))
    found = ids.selectExpr(
        "count(*) as total", f"count({column}) as known",
        f"{f'approx_percentile({column}, array({marks}), 100000)' if n > 1 else 'null'} as bounds").first()
    total, known = found["total"], found["known"]
    empty = 0 if known == total else min(n - 1, max(1, round(n * (total - known) / total))) if known else n
    bounds = sorted(found["bounds"] or []) if known else []
    step = n / max(n - empty, 1)  # of the bounds keep as many as there are ranges left
    bounds = [bounds[min(round(k * step) - 1, len(bounds) - 1)] for k in range(1, n - empty)] if bounds else []
    bounds = np.array(bounds, np.int64)

    def place(batches):
        for b in batches:
            ids, text = b.column(column), b.column(spread)
            value = ids.fill_null(0).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(bounds, value), np.searchsorted(bounds, value, "right")
            low, wide = low + empty, np.maximum(high - low, 1)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            low, wide = np.where(null, 0, low), np.where(null, max(empty, 1), wide)
            for k in np.flatnonzero(wide > 1).tolist():
                low[k] += zlib.crc32(text[k].as_py() or b"") % wide[k]
            yield b.append_column("_part", pa.array(low.astype(np.int32)))

    schema = rows.withColumn("_part", F.lit(0)).schema
    return rows.mapInArrow(place, schema).repartitionById(n, "_part").drop("_part")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node reachable.

    Every round each node takes its smallest neighbour as parent, follows parents once
    more, and the graph is contracted to the parents; it shrinks by half or more.  Rows
    of nodes without edges are not returned.  Each round is written to the shared folder.
    """
    live = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    names = None
    while not live.isEmpty():
        both = live.select(F.col("a").alias("v"), F.col("b").alias("p")).union(live.select("b", "b"))
        step = both.groupBy("v").agg(F.min("p").alias("p"))
        jump = step.select(F.col("v").alias("p"), F.col("p").alias("q"))
        step = written(step.join(jump, "p", "left").select("v", F.coalesce("q", "p").alias("p")), "parents")
        if names is None:
            names = step.select(F.col("v").alias("node"), F.col("p").alias("root"))
        else:
            moved = step.select(F.col("v").alias("root"), F.col("p").alias("to"))
            names = names.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        names = written(names, "names")
        up_a = step.select(F.col("v").alias("a"), F.col("p").alias("na"))
        up_b = step.select(F.col("v").alias("b"), F.col("p").alias("nb"))
        moved = live.join(up_a, "a").join(up_b, "b").where("na <> nb")
        live = written(
            moved.select(F.greatest("na", "nb").alias("a"), F.least("na", "nb").alias("b")).distinct(), "edges")
    if names is None:
        names = live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return names
