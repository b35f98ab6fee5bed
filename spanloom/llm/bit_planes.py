"""Token ids in a shuffled-plane file format.

A writer puts the ids of all documents one after another in ascending ``doc_id`` order,
cuts the stream of each shard into blocks of a fixed number of ids, transposes a block
into its bit or byte planes and compresses each plane with zstandard.  High planes of
small ids are all zero and take no byte.

Layout under the chosen folder (Parquet is the container, so that a task that is lost
and run again leaves one copy, on any file system that Spark writes):

``chunks``  shard, chunk, first_id (in the shard), n_ids, planes ("bit" or "byte"),
            plane_sizes (compressed bytes of each plane; 0: all zero), payload (planes
            joined), docs (documents that overlap the chunk: doc_id, start in the shard,
            n_tokens)
``index``   shard, chunk, first_id over all shards, n_ids, plane_sizes: enough to find
            the chunk of any position without reading a payload
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_ranges, pieces, unzip, zipped
from .tokens import encoder

BLOCK_IDS = 32_768
_CHUNKS = """shard int, chunk int, first_id long, n_ids int, planes string, plane_sizes array<int>,
payload binary, docs array<struct<doc_id: long, start: long, n_tokens: long>>"""
_PARTS = "shard int, doc_id long, first long, n_tokens long, at long, crc long, ids binary"


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """Transpose 32-bit ids: plane k holds bit (or byte) k of every id, lowest first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [raw[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(parts: list[bytes | None], n: int, planes: str) -> np.ndarray:
    """Inverse of :func:`to_planes`; None stands for a plane of zeros."""
    if planes == "byte":
        raw = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(parts):
            if p is not None:
                raw[:, k] = np.frombuffer(p, np.uint8)
        return raw.reshape(-1).view("<u4")
    bits = np.zeros((n, 32), np.uint8)
    for k, p in enumerate(parts):
        if p is not None:
            bits[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little", count=n)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


def write_planes(
    docs: DataFrame, path: str, tokenizer: str, *, kind: str = "byte", end_id: int = 2,
    planes: str = "byte", block: int = BLOCK_IDS, level: int = 3, special_as_text: bool = False,
) -> None:
    """Encode ``docs`` (doc_id, text) and write the files.

    One shuffle: texts are range-partitioned by doc_id and a shard is one range.  A null
    text counts as empty and has the end id alone.  Rows that share a doc_id are kept,
    in one shard ordered by their text's frame; where an id, or null, fills several shards
    its rows are dealt to them.  An empty table gives empty files.  Other columns are
    ignored.  A text is encoded as one value, at some 20 bytes a character.
    """

    def run(batches):
        shard = TaskContext.get().partitionId()
        pack = zstandard.ZstdCompressor(level=level).compress
        enc = encoder(tokenizer, kind, special_as_text)
        end = np.array([end_id], "<u4").tobytes()
        held, held_ids, first, chunk, at = [], 0, 0, 0, 0  # bytes waiting; their first position
        open_docs: list[dict] = []

        def emit(raw: bytes):
            nonlocal first, chunk, open_docs
            ids = np.frombuffer(raw, "<u4")
            got = [p if p.strip(b"\0") else None for p in to_planes(ids, planes)]
            got = [b"" if p is None else pack(p) for p in got]
            here = [d for d in open_docs if d["start"] < first + len(ids)]
            row = {
                "shard": shard, "chunk": chunk, "first_id": first, "n_ids": len(ids), "planes": planes,
                "plane_sizes": [len(p) for p in got], "payload": b"".join(got), "docs": here,
            }
            first, chunk = first + len(ids), chunk + 1
            open_docs = [d for d in open_docs if d["start"] + d["n_tokens"] > first]
            return row

        for b in pieces(batches, "_z", 2 << 20):
            texts = ["" if t is None else t.decode() for t in unzip(b.column("_z").to_pylist())]
            rows = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.encode(texts)):
                ids += end
                n = len(ids) // 4
                open_docs.append({"doc_id": doc_id, "start": at, "n_tokens": n})
                at += n
                held.append(ids)
                held_ids += n
                if held_ids >= block:
                    raw = b"".join(held)
                    full = held_ids // block * block
                    rows += [emit(raw[k * 4:(k + block) * 4]) for k in range(0, full, block)]
                    held, held_ids = [raw[full * 4:]], held_ids - full
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
        if held_ids:
            yield pa.RecordBatch.from_pylist([emit(b"".join(held))], _ARROW)

    known = docs.select(F.col("doc_id").cast("long"), "text")
    ordered = in_ranges(zipped(known, ["doc_id"]), known, "doc_id", "_z").sortWithinPartitions("doc_id", "_z")
    ordered.mapInArrow(run, _CHUNKS).write.parquet(f"{path}/chunks")
    spark = docs.sparkSession
    index = spark.read.parquet(f"{path}/chunks").select("shard", "chunk", "first_id", "n_ids", "plane_sizes")
    offsets = _offsets(index)
    (index.join(offsets, "shard").select(
        "shard", "chunk", (F.col("first_id") + F.col("before")).alias("first_id"), "n_ids", "plane_sizes")
        .write.parquet(f"{path}/index"))


_ARROW = pa.schema([
    ("shard", pa.int32()), ("chunk", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int32()),
    ("planes", pa.string()), ("plane_sizes", pa.list_(pa.int32())), ("payload", pa.binary()),
    ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]))),
])


def _offsets(chunks: DataFrame) -> DataFrame:
    """Ids in all earlier shards; one row per shard, and a shard is a partition of the writer."""
    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    return totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))


def read_planes(spark: SparkSession, path: str, *, keep_ids: bool = False) -> DataFrame:
    """Read documents back: doc_id, start (over all documents), n_tokens, ids_crc32[, ids].

    A chunk yields a checksum for each document that lies in it whole, and the ids of
    those that cross its border, which meet by document.
    """
    chunks = spark.read.parquet(f"{path}/chunks")

    def run(batches):
        open_ = zstandard.ZstdDecompressor().decompress
        for b in pieces(batches, "payload", 1 << 20):
            out = []
            for r in b.to_pylist():
                parts, k = [], 0
                for size in r["plane_sizes"]:
                    parts.append(open_(r["payload"][k:k + size]) if size else None)
                    k += size
                raw = from_planes(parts, r["n_ids"], r["planes"]).tobytes()
                lo, hi = r["first_id"], r["first_id"] + r["n_ids"]
                for d in r["docs"]:
                    a, z = max(lo, d["start"]), min(hi, d["start"] + d["n_tokens"])
                    ids = raw[(a - lo) * 4:(z - lo) * 4]
                    whole = z - a == d["n_tokens"]
                    out.append((
                        r["shard"], d["doc_id"], d["start"], d["n_tokens"], a - d["start"],
                        zlib.crc32(ids) if whole else None, ids if keep_ids or not whole else None))
            cols = list(zip(*out)) or [()] * 7
            kinds = [pa.int32(), *[pa.int64()] * 5, pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds)],
                names=["shard", "doc_id", "first", "n_tokens", "at", "crc", "ids"])

    found = chunks.mapInArrow(run, _PARTS).groupBy("shard", "first", "doc_id", "n_tokens").agg(
        F.max("crc").alias("crc"),
        F.sort_array(F.collect_list(F.when(F.col("ids").isNotNull(), F.struct("at", "ids")))).alias("parts"))
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), ""))
    out = found.join(F.broadcast(_offsets(chunks)), "shard").select(
        "doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens",
        F.coalesce("crc", F.crc32(joined)).alias("ids_crc32"), *([joined.alias("ids")] if keep_ids else []))
    return out
