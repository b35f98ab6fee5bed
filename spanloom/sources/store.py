"""A stored set of tables that follows the logs: ingest and secret scans as incremental jobs.

Every run appends its rows under ``<table>/run=<id>`` and then commits a snapshot of an
index that names, for each log, the run its rows stand in.  Rows of a log are alive only in
that run, so replacing a log rewrites nothing of the others, and a run that dies before its
snapshot leaves no trace for readers.  A snapshot's number is taken by creating its folder:
of two writers that started from the same one the second fails.  ``compact`` gathers what
is alive in one run.  Tables with a ``session_id`` lie in buckets of its hash, so that a
look at one conversation opens one bucket.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.secrets import DETECTORS, Detector, count_redactions, redact
from ..operators.audit import payloads, scan, unscanned
from .pairs import discover_folders, parse_pairs
from .tail import open_log, whole_lines

RULES = "1"  # raise when lines are parsed by other rules: every log is then read again
RANGE = 64 << 20
BUCKETS = 64
LINES = "source_path string, block_start bigint, row_id bigint, value string, error string"


class Store:
    """Tables under ``path``, which any file system pyarrow and Spark know may hold."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _snapshots(self, name: str) -> dict[int, bool]:
        store, inside = fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path)
        found = store.get_file_info(fs.FileSelector(f"{inside}/{name}.index", allow_not_found=True))
        numbers = {int(f.base_name.split("=")[1]): f.path for f in found if f.base_name.startswith("snapshot=")}
        return {n: store.get_file_info(f"{p}/_SUCCESS").type == fs.FileType.File for n, p in numbers.items()}

    def index(self, name: str) -> DataFrame | None:
        """The last committed index of a table; None before the first."""
        done = [n for n, whole in self._snapshots(name).items() if whole]
        return self.spark.read.parquet(f"{self.path}/{name}.index/snapshot={max(done)}") if done else None

    def commit(self, name: str, index: DataFrame) -> None:
        number = max(self._snapshots(name), default=0) + 1
        index.write.parquet(f"{self.path}/{name}.index/snapshot={number}")

    def append(self, table: str, rows: DataFrame, run: str) -> DataFrame:
        where = f"{self.path}/{table}/run={run}"
        if "session_id" in rows.columns:
            dealt = rows.withColumn("bucket", _bucket(F.col("session_id"))).repartition("bucket")
            dealt.write.partitionBy("bucket").parquet(where)
        else:
            rows.write.parquet(where)
        return self.spark.read.schema(rows.schema).parquet(where)

    def _every(self, table: str) -> DataFrame:
        every = self.spark.read.option("basePath", f"{self.path}/{table}").parquet(f"{self.path}/{table}")
        return every.withColumn("run", F.col("run").cast("string"))

    def _of(self, rows: DataFrame, index: DataFrame, keys: Sequence[str]) -> DataFrame:
        return rows.join(index.select(*keys, "run").distinct(), [*keys, "run"], "left_semi").drop("run", "bucket")

    def alive(self, table: str, index: DataFrame, keys: Sequence[str] = ("source_path",)) -> DataFrame:
        """Rows of the runs that ``index`` names for their keys."""
        return self._of(self._every(table), index, keys)

    def of_session(self, table: str, index: DataFrame, session_id: str) -> DataFrame:
        """Those of one conversation, out of its bucket alone."""
        rows = self._every(table).where((F.col("bucket") == _bucket(F.lit(session_id))) & (F.col("session_id") == session_id))
        return self._of(rows, index, ("source_path",))


def _bucket(session_id) -> Column:
    return F.pmod(F.xxhash64(session_id), F.lit(BUCKETS)).cast("int")


@dataclass
class Ingested:
    """What an ingest did; ``failures`` has (source_path, error), ``files`` a row for each log looked at."""

    files: DataFrame
    failures: DataFrame


def _listed(batches):
    """Logs that stand in the given folders, or are given themselves."""
    for b in batches:
        out = []
        for path in b.column("path").to_pylist():
            store, inside = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
            scheme = path.split("://")[0] + "://" if "://" in path else ""
            info = store.get_file_info(inside)
            files = store.get_file_info(fs.FileSelector(inside)) if info.type == fs.FileType.Directory else [info]
            out += [(scheme + f.path, f.size, f.mtime_ns // 1000) for f in files
                    if f.type == fs.FileType.File and f.base_name.endswith(".jsonl")]
        yield pa.RecordBatch.from_arrays([
            pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.timestamp("us", "UTC")))
        ], names=["source_path", "size", "modified_at"])


def list_logs(spark: SparkSession, roots: Sequence[str], max_depth: int | None = None) -> DataFrame:
    """Logs of the roots (folders, or logs named themselves) with size and time of change, from listings alone."""
    named = spark.createDataFrame([(r,) for r in roots if r.endswith(".jsonl")], "path string")
    folders = discover_folders(spark, [r for r in roots if not r.endswith(".jsonl")], max_depth=max_depth)
    paths = folders.union(named).distinct()
    return paths.mapInArrow(_listed, "source_path string, size bigint, modified_at timestamp").dropDuplicates(["source_path"])


def _versions(files: DataFrame, rules: str) -> DataFrame:
    stat = F.concat_ws(":", F.col("size").cast("string"), F.unix_micros("modified_at").cast("string"), F.lit(rules))
    return files.withColumn("content_hash", F.sha2(stat, 256))


def read_ranges(batches):
    """Lines of byte ranges of logs, or the error that reading one met."""
    for b in batches:
        for path, start, end, size in zip(*(b.column(c).to_pylist() for c in ("source_path", "start", "end", "size"))):
            held, held_bytes = [], 0
            try:
                with open_log(path) as file:
                    for at, line in whole_lines(file, start, end, last=end >= size):
                        held.append((path, start, at, line.decode("utf-8", "replace"), None))
                        held_bytes += len(line)
                        if len(held) >= 1000 or held_bytes > 1 << 20:
                            yield _lines(held)
                            held, held_bytes = [], 0
            except Exception as exc:  # noqa: BLE001 - any failure is reported by name
                held.append((path, None, None, None, f"{type(exc).__name__}: {exc}"))
            if held:
                yield _lines(held)


def _lines(rows):
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [c.split()[0] for c in LINES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def ingest(
    store: Store, files: DataFrame, *, derive: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None,
    rules: str = RULES, range_bytes: int = RANGE,
) -> Ingested:
    """Bring the stored pairs, and tables derived from them, up to date with ``files``.

    ``files`` as of ``list_logs``.  Logs whose size, time of change and rules are those of
    the index are not opened.  The others are read in ranges of bytes, side by side.  A log
    that cannot be read to its end is named in ``failures`` and keeps the rows and the
    version it had, so the next run tries it again; the others are stored all the same.
    Each function of ``derive`` gets the pairs of the changed logs and returns rows with
    ``source_path``.  Logs that are no longer listed stay as they were.
    """
    spark, run = store.spark, uuid.uuid4().hex
    known = store.index("pairs")
    files = _versions(files, rules)
    todo = files
    if known is not None:
        todo = files.join(known.select("source_path", "content_hash"), ["source_path", "content_hash"], "left_anti")
    todo = store.append("listed", todo, run)
    ranges = todo.select("source_path", "size", F.explode(F.expr(
        f"sequence(0, greatest(size - 1, 0), {range_bytes})")).alias("start")).withColumn(
        "end", F.least(F.col("start") + range_bytes, "size"))
    read = store.append("staged", ranges.repartition("source_path", "start").mapInArrow(read_ranges, LINES), run)
    failures = read.where("error is not null").groupBy("source_path").agg(F.min("error").alias("error"))
    fresh = todo.join(failures.select("source_path"), "source_path", "left_anti")
    lines = read.where("error is null").drop("error").join(failures.select("source_path"), "source_path", "left_anti")
    pairs = store.append("pairs", parse_pairs(lines), run)
    for name, make in (derive or {}).items():
        store.append(name, make(pairs), run)

    counts = pairs.groupBy("source_path").agg(F.count(F.lit(1)).alias("pairs"))
    entry = fresh.join(counts, "source_path", "left").select(
        "source_path", "content_hash", "size", "modified_at", F.coalesce("pairs", F.lit(0)).alias("pairs"), F.lit(run).alias("run"))
    if known is not None:
        entry = known.join(entry.select("source_path"), "source_path", "left_anti").unionByName(entry)
    store.commit("pairs", entry)
    state = F.when(F.col("error").isNotNull(), "failed").when(F.col("_new"), "indexed").otherwise("skipped").alias("state")
    looked = files.select("source_path").join(todo.select("source_path", F.lit(True).alias("_new")), "source_path", "left")
    return Ingested(looked.join(failures, "source_path", "left").select("source_path", state), failures)


def stored(store: Store, table: str) -> DataFrame:
    """The rows of a table that are alive."""
    return store.alive(table, store.index("pairs"))


def compact(store: Store, tables: Sequence[str]) -> None:
    """Write what is alive of ``tables`` (``pairs`` and derived ones) to one run and commit it."""
    run, index = uuid.uuid4().hex, store.index("pairs")
    for table in tables:
        store.append(table, store.alive(table, index), run)
    store.commit("pairs", index.withColumn("run", F.lit(run)))


def conversation(store: Store, table: str, session_id: str, seq: int | None = None) -> DataFrame:
    """Rows of one conversation in a table with session_id (and seq), or of one of its calls.

    No row rather than those of another conversation when the id or the call is not there.
    """
    rows = store.of_session(table, store.index("pairs"), session_id)
    return rows if seq is None else rows.where(F.col("seq") == seq)


def trajectory(store: Store, table: str, session_id: str, source_path: str) -> DataFrame:
    """Rows of a session, or, when no session has the id, of the first session of the log.

    The first is the one whose call stands before all others; ``table`` has session_id,
    block_start and row_id.
    """
    index = store.index("pairs")
    own = store.of_session(table, index, session_id)
    if not own.isEmpty():
        return own
    log = store.alive(table, index).where(F.col("source_path") == source_path)
    first = log.groupBy("source_path").agg(F.min_by("session_id", F.struct("block_start", "row_id")).alias("session_id"))
    return log.join(first, ["source_path", "session_id"], "left_semi")


# -- secret scans that are kept ------------------------------------------------

_SCAN = ["source_path", "content_hash", "mode", "redact_check"]


def scan_changed(
    store: Store, mode: str = "standard", *, redact_check: bool = True, detectors: list[Detector] = DETECTORS,
) -> DataFrame:
    """Scan the stored logs whose version has no scan in this mode; returns those logs.

    Findings are kept folded by log, secret and location, so that a report is a sum.  A new
    scan of a log takes the place of older ones of its mode; other modes keep theirs.
    """
    run, files, known = uuid.uuid4().hex, store.index("pairs"), store.index("scans")
    todo = files if known is None else unscanned(files, known, mode, redact_check)
    todo = store.append("scanned", todo.select("source_path", "content_hash", "pairs", F.col("run").alias("pairs_run")), run)
    pairs = store.alive("pairs", todo.withColumnRenamed("pairs_run", "run"))
    found = scan(payloads(pairs, mode, detectors), mode, detectors)
    store.append("findings", fold_findings(found), run)

    entry = todo.select("source_path", "content_hash", F.col("pairs").alias("pairs_scanned"))
    if redact_check:
        texts = payloads(pairs, "strict", detectors)
        masked = texts.groupBy("source_path").agg(*[
            F.sum(count_redactions(redact(F.col("text"), m))).alias(f"{m}_masked") for m in ("standard", "strict")])
        entry = entry.join(masked, "source_path", "left")
    else:
        entry = entry.withColumns({f"{m}_masked": F.lit(0) for m in ("standard", "strict")})
    entry = entry.select(
        "source_path", "content_hash", F.lit(mode).alias("mode"), F.lit(redact_check).alias("redact_check"), "pairs_scanned",
        *[F.coalesce(f"{m}_masked", F.lit(0)).cast("bigint").alias(f"{m}_masked") for m in ("standard", "strict")],
        F.lit(run).alias("run"))
    if known is not None:
        stale = entry.select("source_path", "mode", "redact_check")
        entry = known.join(stale, ["source_path", "mode", "redact_check"], "left_anti").unionByName(entry)
    store.commit("scans", entry)
    return todo.select("source_path")


def fold_findings(findings: DataFrame) -> DataFrame:
    """Findings of ``audit.scan`` summed by log, secret and location; sums of these sum again."""
    known = F.when(F.col("ts") > 0, F.col("ts"))
    return findings.groupBy("source_path", "fingerprint", "detector", "location").agg(
        F.min("token_length").alias("token_length"), F.min("last4").alias("last4"),
        F.count(F.when(F.col("direction") == "egress", 1)).alias("egress"),
        F.count(F.when(F.col("direction") != "egress", 1)).alias("response"),
        F.min(known).alias("first_ts"), F.max(known).alias("last_ts"))


def audit_report(store: Store, mode: str = "standard", *, redact_check: bool = True) -> tuple[DataFrame, DataFrame]:
    """(secrets, totals) over the kept scans of the logs as they are stored now.

    ``secrets`` has the columns of ``audit.group_findings``; ``totals`` files, pairs,
    secrets, hits by direction and what each redaction masks.
    """
    files, known = store.index("pairs"), store.index("scans")
    live = known.where((F.col("mode") == mode) & (F.col("redact_check") == redact_check)).join(
        files.select("source_path", "content_hash"), ["source_path", "content_hash"], "left_semi")
    kept = store.alive("findings", live)
    secrets = kept.groupBy("fingerprint", "detector").agg(
        F.min("token_length").alias("token_length"), F.min("last4").alias("last4"), F.sum("egress").alias("egress"),
        F.sum("response").alias("response"), F.countDistinct("location").alias("locations"),
        F.countDistinct("source_path").alias("files"), F.coalesce(F.min("first_ts"), F.lit(0.0)).alias("first_ts"),
        F.coalesce(F.max("last_ts"), F.lit(0.0)).alias("last_ts"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    totals = live.agg(F.count(F.lit(1)).alias("files"), *[zero(c) for c in ("pairs_scanned", "standard_masked", "strict_masked")])
    hits = secrets.agg(F.countDistinct("fingerprint").alias("secrets"), zero("egress"), zero("response"))
    return secrets, totals.withColumn("_one", F.lit(1)).join(hits.withColumn("_one", F.lit(1)), "_one").drop("_one")
