"""Readers of captured logs: discovery, tolerant JSON lines, watermarks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import PAIR
from ..session import written

# Folders logs are captured into, and folders never searched.
TRACE_DIRS = [".claude-trace", ".codex-trace", ".gemini-trace", ".devin-trace"]
SKIP_DIRS = ["node_modules", ".git", ".cache", ".npm", ".pnpm-store", "Library", ".Trash"]


def _children(batches: Iterator[pa.RecordBatch], trace_dirs: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Folders inside the given ones: trace folders, and those to look into next."""
    for b in batches:
        out = []
        for path in b.column("path").to_pylist():
            store, inside = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
            scheme = path.split("://")[0] + "://" if "://" in path else ""
            try:
                inner = store.get_file_info(fs.FileSelector(inside, allow_not_found=True))
            except OSError:
                continue  # a folder that may not be opened holds no logs for us
            for f in inner:
                name = f.base_name
                if f.type == fs.FileType.Directory and name not in SKIP_DIRS and (name in trace_dirs or not name.startswith(".")):
                    out.append((scheme + f.path, name in trace_dirs))
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in out], pa.string()), pa.array([t for _, t in out], pa.bool_())], names=["path", "trace"])


def discover_folders(
    spark: SparkSession, roots: Sequence[str], trace_dirs: Sequence[str] = TRACE_DIRS, max_depth: int | None = None
) -> DataFrame:
    """Trace folders (path) under the roots, at any depth or not deeper than ``max_depth``.

    Spark passes over hidden folders when it lists, so folders are listed here, a level of
    the tree a round and its folders side by side in tasks.  Skipped and hidden folders are
    not opened, and nothing inside a trace folder is looked at.
    """
    roots = sorted({r.rstrip("/") for r in roots})
    named = [r for r in roots if r.rsplit("/", 1)[-1] in trace_dirs]
    found = spark.createDataFrame([(r,) for r in named], "path string")
    level = spark.createDataFrame([(r,) for r in roots if r not in named], "path string")
    depth = 0
    while (max_depth is None or depth <= max_depth) and not level.isEmpty():
        inner = written(level.repartition(spark.sparkContext.defaultParallelism).mapInArrow(
            lambda batches: _children(batches, trace_dirs), "path string, trace boolean"), "folders")
        found = found.union(inner.where("trace").select("path"))
        level = inner.where("not trace").select("path")
        depth += 1
    return found.distinct()


def trace_folders(
    spark: SparkSession, root: str, trace_dirs: Sequence[str] = TRACE_DIRS, max_depth: int | None = None
) -> list[str]:
    """Paths of ``discover_folders`` for one root, sorted."""
    return sorted(r.path for r in discover_folders(spark, [root], trace_dirs, max_depth).toLocalIterator())


def read_lines(spark: SparkSession, paths: str | Sequence[str], **options) -> DataFrame:
    """Text lines with their file and their order in it.

    ``block_start`` is the offset of the input split; within a split ``row_id``
    ascends with the lines.
    """
    reader = spark.read.option("pathGlobFilter", "*.jsonl").options(**options)
    lines = reader.text([paths] if isinstance(paths, str) else list(paths))
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_id"),
    )


def discover(spark: SparkSession, roots: Sequence[str], max_depth: int | None = None) -> list[str]:
    """What to read for the roots: log files as named, and trace folders found."""
    out: set[str] = set()
    for root in roots:
        out.update([root] if root.endswith(".jsonl") else trace_folders(spark, root, max_depth=max_depth))
    return sorted(out)


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    opts = {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}
    return lines.where(F.trim("value") != "").withColumn("j", F.from_json("value", " ".join(schema.split()), opts))


def parse_pairs(lines: DataFrame, keep: Column | None = None) -> DataFrame:
    """Well-formed pairs; blank, torn and malformed lines are left out.

    ``keep`` filters on the opened line before anything else is done with it.
    """
    j = _parsed(lines, PAIR).where("j._bad is null and (j.request is not null or j.response is not null)")
    out = j.select(
        "source_path", "block_start", "row_id",
        "j.request", "j.response", "j.logged_at", "j.note",
    )
    return out.where(keep) if keep is not None else out


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Lines that are not blank and not a pair."""
    j = _parsed(lines, PAIR)
    return j.where("j._bad is not null or (j.request is null and j.response is null)").select(
        "source_path", "block_start", "row_id", "value"
    )


def read_pairs(spark: SparkSession, paths: str | Sequence[str], keep: Column | None = None) -> DataFrame:
    return parse_pairs(read_lines(spark, paths), keep)


def project_of(path: Column, override: str | None = None, trace_dirs: Sequence[str] = TRACE_DIRS) -> Column:
    """Folder the log belongs to: the parent of its trace folder, or its own folder."""
    if override and override.strip():
        return F.lit(override)
    local = F.regexp_replace(path, "^file:/*", "/")
    folder = F.regexp_replace(local, "/[^/]*$", "")
    name = F.element_at(F.split(folder, "/"), -1)
    return F.when(name.isin(list(trace_dirs)), F.regexp_replace(folder, "/[^/]*$", "")).otherwise(folder)


# -- watermarks and incremental work ------------------------------------------

def file_versions(spark: SparkSession, path: str, *, hash_bytes: bool = False) -> DataFrame:
    """One row per log with its version: the sha256 of its bytes, or of size and time."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
    f = reader.load(path)
    by_stat = F.sha2(F.concat_ws(":", F.col("length").cast("string"), F.col("modificationTime").cast("string")), 256)
    version = F.sha2("content", 256) if hash_bytes else by_stat
    return f.select(
        F.col("path").alias("source_path"), version.alias("content_hash"),
        F.col("modificationTime").alias("modified_at"), F.col("length").alias("size"),
    )


def changed_files(current: DataFrame, known: DataFrame) -> DataFrame:
    """Files that are new or whose version differs from the one recorded."""
    return current.join(known.select("source_path", "content_hash"), ["source_path", "content_hash"], "left_anti")


def replace_sources(existing: DataFrame, fresh: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of ``existing`` without those of ``sources``, plus ``fresh``."""
    kept = existing.join(sources.select("source_path").distinct(), "source_path", "left_anti")
    return kept.unionByName(fresh)
