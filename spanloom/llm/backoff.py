"""Stupid-backoff scores against n-gram counts of the whole corpus.

Documents are dealt to shards of bounded size.  A shard turns its texts into the distinct
n-grams of orders 1 to 3 with their counts (56-bit hashes) and sends them to count
partitions by hash: sorted, as differences, byte plane by byte plane, compressed.  A
count partition adds up the shards and joins the totals back to each shard that asked,
in the order of its list.  The shard then explodes its n-grams again, takes the totals
by their place in that list and sums each document's scores.  A frequent n-gram is
one entry a shard, so no key is hot, and every shuffle carries packed arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unzip, zipped
from .fm_index import words

ORDER = 3
ALPHA = 0.4
SHARD_DOCS = 2048
MICRO = 1_000_000
HASH_BITS = 56
_K = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def _pack(values: np.ndarray) -> bytes:
    """Non-negative integers by byte planes, compressed."""
    raw = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(raw.T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view("<u8")


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data), dtype=np.uint64)


class Grams:
    """Hashes of all n-grams of some texts: ``levels[n - 1][i]`` ends at word i; 0 where a
    document has not enough words before it."""

    def __init__(self, texts: list[str | None], order: int = ORDER):
        split = [words(t) for t in texts]
        self.sizes = np.array([len(w) for w in split], np.int64)
        said = [w for d in split for w in d]
        number = {w: k for k, w in enumerate(dict.fromkeys(said))}
        one = np.array([xxhash.xxh3_64_intdigest(w) >> 8 | 1 for w in number], np.uint64)
        level = one[np.fromiter(map(number.__getitem__, said), np.int64, len(said))] if said else one
        place = np.arange(len(level)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.levels = [level]
        with np.errstate(over="ignore"):
            for n in range(1, order):
                longer = np.zeros(len(level), np.uint64)
                # an n-gram is the one before it and its last word
                mixed = self.levels[-1][:-1] * _K[n % 3] + (level[1:] ^ (level[1:] >> np.uint64(31))) * _K[(n + 1) % 3]
                mixed = (mixed ^ (mixed >> np.uint64(29))) * _K[0]
                longer[1:] = (mixed ^ (mixed >> np.uint64(32))) >> np.uint64(64 - HASH_BITS) | np.uint64(1)
                longer[place < n] = 0
                self.levels.append(longer)

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        grams, n = np.unique(np.concatenate(self.levels), return_counts=True)
        none = int(len(grams) > 0 and grams[0] == 0)
        return grams[none:], n[none:]

    def micro_scores(self, totals: np.ndarray, n_words: int, alpha: float = ALPHA) -> np.ndarray:
        """Score of each word in millionths of a natural logarithm; ``totals`` in the order of ``counted``."""
        grams, place = np.unique(np.concatenate(self.levels), return_inverse=True)
        if len(grams) and grams[0] == 0:
            totals = np.concatenate([[1], totals])
        del grams
        counts = totals.astype(float)[place].reshape(len(self.levels), -1)
        score = np.log(counts[0] / max(n_words, 1))
        score += (len(self.levels) - 1) * np.log(alpha)  # as if backed off to the end
        for n in range(1, len(self.levels)):
            own, before = counts[n], np.ones(counts.shape[1])
            before[1:] = counts[n - 1][:-1]
            seen = (self.levels[n] != 0) & (own >= 2)
            score = np.where(seen, np.log(own / before) + (len(self.levels) - 1 - n) * np.log(alpha), score)
        return np.round(score * MICRO).astype(np.int64)


def word_count(docs: DataFrame) -> int:
    """Words of all texts."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([sum(len(words(t)) for t in b.column("text").to_pylist())], pa.int64())], names=["n"])

    return docs.select("text").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def score_documents(docs: DataFrame, *, order: int = ORDER, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """doc_id, n_words and micro_score of every row of ``docs`` (doc_id, text).

    A word's score is the relative count of the longest n-gram ending there that the
    corpus holds at least twice, times ALPHA for each order given up below ``order``; a
    word in neither is scored by its own count.  micro_score adds up natural logarithms
    in millionths, each rounded, so that no order of summing shows.  A null text and a
    text without words have 0 words and score 0; repeated rows count each.
    """
    shards = max(1, -(-docs.count() // shard_docs))
    parts_bits = max(1, int(2 * shards - 1).bit_length())
    dealt = zipped(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"])
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("doc_id", "_z"), F.lit(shards)))

    def texts(t: pa.Table) -> list:
        return [None if x is None else x.decode() for x in unzip(t.column("_z").to_pylist())]

    def count_shard(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        grams = Grams(texts(t), order)
        h, n = grams.counted()
        part = (h >> np.uint64(HASH_BITS - parts_bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        rows = [(int(part[a]), shard, _pack_sorted(h[a:z]), _pack(n[a:z]))
                for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(h)])]
        cols = zip(*rows) if rows else [[]] * 4
        return pa.table([pa.array(c, k) for c, k in zip(cols, _BLOCK_TYPES)], names=["part", "shard", "h", "n"])

    def join_totals(t: pa.Table) -> pa.Table:
        owners, hs, ns = t.column("shard").to_pylist(), t.column("h").to_pylist(), t.column("n").to_pylist()
        lists = [_unpack_sorted(h) for h in hs]
        grams, at = np.unique(np.concatenate(lists), return_inverse=True)
        totals = np.bincount(at, weights=np.concatenate([_unpack(n) for n in ns])).astype(np.uint64)
        ends = np.cumsum([len(h) for h in lists])
        sums = [_pack(totals[at[e - len(h):e]]) for e, h in zip(ends.tolist(), lists)]
        return pa.table({"shard": pa.array(owners, pa.int64()), "part": t.column("part"), "n": pa.array(sums, pa.binary())})

    blocks = dealt.groupBy("shard").applyInArrow(count_shard, "part long, shard long, h binary, n binary")
    totals = blocks.groupBy("part").applyInArrow(join_totals, "shard long, part long, n binary")
    all_words = word_count(docs)

    def score_shard(t: pa.Table, known: pa.Table) -> pa.Table:
        grams = Grams(texts(t), order)
        parts = known.sort_by("part").column("n").to_pylist()
        n = np.concatenate([_unpack(x) for x in parts]) if parts else np.zeros(0, np.uint64)
        sums = np.concatenate([[0], np.cumsum(grams.micro_scores(n, all_words))])
        ends = np.cumsum(grams.sizes)
        return pa.table({
            "doc_id": t.column("doc_id"), "n_words": pa.array(grams.sizes),
            "micro_score": pa.array(sums[ends] - sums[ends - grams.sizes])})

    return dealt.groupBy("shard").cogroup(totals.groupBy("shard")).applyInArrow(
        score_shard, "doc_id long, n_words long, micro_score long")


_BLOCK_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
