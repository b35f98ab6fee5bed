"""SimHash fingerprints, near pairs by shared blocks, and their components.

A 64-bit fingerprint is cut into 7 blocks.  Two fingerprints that differ in at most 4
bits have at least 3 blocks in common (pigeonhole), so they meet under one of the 35
triples of blocks, each 27 or 28 bits wide.  Equal fingerprints are one node from the
start.  Under a key every pair is compared exactly, in blocks of at most ``BLOCK``
fingerprints: a crowded key is dealt to block pairs that run apart.  Only links that
join two parts of a block pair are emitted, which leaves components unchanged and keeps
the output linear in the fingerprints read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, pieces, written

DISTANCE = 4
BLOCK = 4096
WIDTHS = [10, 9, 9, 9, 9, 9, 9]
SHARED = 3


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles; 0 without words."""
    w = text.lower().split()  # bytes: A-Z only, and the six ASCII blanks
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), seed)
    digest = xxhash.xxh64_digest
    joined = map(b" ".join, zip(*(w[k:] for k in range(words))))
    raw = np.frombuffer(b"".join([digest(s, seed) for s in joined]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(raw), 1 << 16):
        ones += np.unpackbits(raw[at:at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long).  A null text has no words."""

    def run(batches):
        for b in pieces(batches, "text"):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t or b"", words, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _forest(fp: np.ndarray, node: np.ndarray, left: int) -> list[tuple[int, int]]:
    """Links within DISTANCE that join parts, between the first ``left`` fingerprints and
    all later ones (left 0: between all)."""
    parent = list(range(len(fp)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for k in range(left or len(fp) - 1):
        lo = left or k + 1
        near = np.flatnonzero(np.bitwise_count(fp[lo:] ^ fp[k]) <= DISTANCE)
        for j in (near + lo).tolist():
            a, b = find(k), find(j)
            if a != b:
                parent[a] = b
                out.append((int(node[k]), int(node[j])))
    return out


def near_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``nodes`` (node, fp) that differ in 4 bits or fewer."""
    starts = [sum(WIDTHS[:k]) for k in range(len(WIDTHS))]
    masks = [((1 << w) - 1) << s for w, s in zip(WIDTHS, starts)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keys = []
    for c in combinations(range(len(WIDTHS)), SHARED):
        mask = 0
        for k in c:
            mask |= signed[k]
        keys.append(F.xxhash64(F.lit(len(keys)), F.col("fp").bitwiseAND(F.lit(mask).cast("long"))))
    rows = nodes.select("node", "fp", F.explode(F.array(*keys)).alias("key"))
    # Keys with one fingerprint go; a crowded key gets as many parts as it has blocks.
    size = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Spark takes rows after an explode for as many as before it: unasked it may broadcast all 35 keys.
    rows = rows.hint("merge")
    part = F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / BLOCK))
    met = rows.join(size, "key").withColumn("part", part).withColumn("parts", F.ceil(F.col("n") / BLOCK))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    met = met.select("key", "node", "fp", "part", other)
    met = met.select(
        "node", "fp", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("pair"),
        "key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"),
        (F.col("part") > F.col("other")).alias("right"))
    dealt = met.repartition("pair").sortWithinPartitions("pair", "key", "lo", "hi", "right", "fp")

    def run(batches):
        held: list = []  # columns of a run that goes on in the next batch

        def close(cols):
            fp, node, lo, hi, right = cols
            n_left = int(len(right) - np.count_nonzero(right)) if lo[0] != hi[0] else 0
            return _forest(fp, node, n_left) if len(fp) > 1 and (lo[0] == hi[0] or 0 < n_left < len(fp)) else []

        for b in batches:
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "node", "lo", "hi", "right", "key")]
            if not len(cols[0]):
                continue
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            fp, node, lo, hi, right, key = cols
            fp = fp.astype(np.int64).view(np.uint64)
            new = (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
            edge = np.concatenate([[0], np.flatnonzero(new) + 1])
            out = []
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
                out += close((fp[s:e], node[s:e], lo[s:e], hi[s:e], right[s:e]))
            held = [c[edge[-1]:] for c in cols]
            yield _links(out)
        if held:
            fp, node, lo, hi, right, _ = held
            yield _links(close((fp.astype(np.int64).view(np.uint64), node, lo, hi, right)))

    return dealt.mapInArrow(run, "a long, b long")


def _links(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])


def simhash_components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that can be reached over links.  Texts without
    words have fingerprint zero.  Repeated rows keep their count; documents without id
    get a fingerprint and, alone with it, no component.
    """
    fps = written(fingerprints(docs), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    found = components(near_links(nodes.where("node is not null")))
    places = written(
        nodes.hint("merge").join(found, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id")), "places")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(places.hint("merge"), "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")
