"""Writers of derived tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_stats(sessions: DataFrame, totals: DataFrame, path: str) -> None:
    """Statistics of each log beside its totals, as JSON partitioned by source."""
    sessions.write.mode("overwrite").partitionBy("source_path").json(f"{path}/trajectories")
    totals.write.mode("overwrite").json(f"{path}/totals")


def write_documents(documents: DataFrame, path: str) -> None:
    """Exported documents, one JSON text per line."""
    documents.select(F.col("document").alias("value")).write.mode("overwrite").text(path)


def overwrite_sources(df: DataFrame, path: str) -> None:
    """Replace the partitions of the sources in ``df``; others stay untouched."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_path").parquet(path)


def write_pair_logs(lines: DataFrame, path: str) -> None:
    """Lines of ``forest.pair_lines`` as logs, a folder for each session, in order of the calls."""
    ordered = lines.repartition("session_id").sortWithinPartitions("session_id", "seq")
    ordered.select("session_id", "value").write.mode("overwrite").partitionBy("session_id").text(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Pairs of imported sessions as JSON lines, one folder per session."""
    pairs.write.mode("overwrite").partitionBy("session_id").json(path)
