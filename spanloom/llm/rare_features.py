"""Fingerprints of statistically improbable byte windows.

Every 64-byte window of a text has an entropy, put in one of 1001 buckets.  The rarer a
bucket is in the whole corpus, the lower its windows rank.  Over each run of 64 windows
the leftmost one of lowest rank gains a point; windows with enough points are features.
Features are hashed into 2048-bit Bloom filters, a new one being chained when the last
holds 160.  Two fingerprints are compared filter by filter: shared bits less those that
chance would share, over the most they could share.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, unzip, written, zipped

SPAN = 64
BUCKETS = 1001
POINTS = 16
FILTER_BITS = 2048
FILTER_FEATURES = 160
_PIECE = 1 << 20
_SCALE = 1 << 10
_G = np.concatenate([[0], np.round(np.arange(1, SPAN + 2) * np.log2(np.arange(1, SPAN + 2)) * _SCALE)]).astype(np.int64)
_GAIN = np.diff(_G)  # added by one more copy of a byte of which there are k
_MAX = 6 * SPAN * _SCALE
_MIX = np.random.default_rng(2024).integers(1, 1 << 63, SPAN // 8, np.uint64) | np.uint64(1)


def entropy_buckets(x: np.ndarray) -> np.ndarray:
    """Bucket of the window that starts at each byte, for all whole windows of ``x``."""
    n = len(x)
    if n < SPAN:
        return np.zeros(0, np.int16)
    back, ahead = np.zeros(n, np.uint8), np.zeros(n, np.uint8)  # copies in the 63 bytes before, after
    for k in range(1, SPAN):
        same = (x[k:] == x[:-k]).view(np.uint8)
        back[k:] += same
        ahead[:-k] += same
    first = int(_G[np.bincount(x[:SPAN], minlength=256)].sum())
    change = _GAIN[back[SPAN:]] - _GAIN[ahead[:n - SPAN]]
    total = np.concatenate([[first], first + np.cumsum(change)])
    return ((_MAX - total) * (BUCKETS - 1) // _MAX).astype(np.int16)


def _owners(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of texts laid end to end, and which positions begin a window inside one text."""
    starts = np.concatenate([[0], np.cumsum(lengths)])
    inside = np.zeros(starts[-1] + 1, np.int8)
    has = lengths >= width
    np.add.at(inside, starts[:-1][has], 1)
    np.add.at(inside, starts[1:][has] - width + 1, -1)
    return starts, np.cumsum(inside[:-1], dtype=np.int8).astype(bool)


def bucket_counts(texts: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(texts), np.uint8)
    _, inside = _owners(np.array([len(t) for t in texts]), SPAN)
    buckets = entropy_buckets(x)
    return np.bincount(buckets[inside[:len(buckets)]], minlength=BUCKETS)


def rarity(counts: np.ndarray) -> np.ndarray:
    """Rank of each bucket: 0 for the rarest; equal counts by bucket."""
    rank = np.empty(BUCKETS, np.int64)
    rank[np.lexsort((np.arange(BUCKETS), counts))] = np.arange(BUCKETS)
    return rank


def _select(x: np.ndarray, lengths: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of features and the text of each."""
    starts, inside = _owners(lengths, SPAN)
    buckets = entropy_buckets(x)
    n = len(buckets)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = (rank[buckets] << 40) | np.arange(n)
    _, runs = _owners(lengths, 2 * SPAN - 1)
    low = key
    for step in (1, 2, 4, 8, 16, 32):  # minimum over 64 windows
        if len(low) > step:
            low = np.minimum(low[:-step], low[step:])
    low = low & ((1 << 40) - 1)
    points = np.bincount(low[runs[:len(low)]], minlength=n)
    at = np.flatnonzero(points >= POINTS)
    owner = np.searchsorted(starts, at, side="right") - 1
    # a text in which no window has enough points keeps its rarest
    lacking = np.flatnonzero((lengths >= SPAN) & (np.bincount(owner, minlength=len(lengths)) == 0))
    if len(lacking):
        extra = np.array([key[starts[d]:starts[d + 1] - SPAN + 1].min() & ((1 << 40) - 1) for d in lacking])
        at, owner = np.concatenate([at, extra]), np.concatenate([owner, lacking])
        order = np.argsort(at)
        at, owner = at[order], owner[order]
    return at, owner


def digests(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """Bloom filters (rows of 2048 bits as 64-bit words) of each text.

    A text shorter than a window is one feature as a whole; an empty one has no filter.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    x = np.frombuffer(b"".join(texts), np.uint8)
    at, owner = _select(x, lengths, rank)
    raw = x[at[:, None] + np.arange(SPAN)].reshape(-1).view("<u8").reshape(-1, SPAN // 8)
    with np.errstate(over="ignore"):
        h = ((raw ^ (raw >> np.uint64(29))) * _MIX).sum(axis=1, dtype=np.uint64)
        short = np.flatnonzero((lengths > 0) & (lengths < SPAN))
        if len(short):
            whole = [int.from_bytes(hashlib.sha1(texts[k]).digest()[:8], "little") for k in short]
            h, owner = np.concatenate([h, np.array(whole, np.uint64)]), np.concatenate([owner, short])
            order = np.argsort(owner, kind="stable")
            h, owner = h[order], owner[order]
        for _ in range(2):
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    count = np.bincount(owner, minlength=len(texts))
    chain = -(-count // FILTER_FEATURES)
    first = np.cumsum(chain) - chain
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    row = first[owner] + nth // FILTER_FEATURES
    bits = np.zeros((int(chain.sum()), FILTER_BITS), np.uint8)
    for k in range(5):
        bits[row, ((h >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
    packed = np.packbits(bits, axis=1).view("<u8")
    return [packed[a:a + n] for a, n in zip(first.tolist(), chain.tolist())]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; equal digests have 1.  Each filter of the shorter chain takes its best match."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    na, nb = np.bitwise_count(a).sum(axis=1, dtype=float), np.bitwise_count(b).sum(axis=1, dtype=float)
    both = np.array([np.bitwise_count(row & b).sum(axis=1, dtype=float) for row in a])
    chance = na[:, None] * nb[None] / FILTER_BITS
    most = np.minimum(na[:, None], nb[None])
    return float(np.clip((both - chance) / (most - chance), 0, 1).max(axis=1).mean())


def corpus_ranks(docs: DataFrame) -> np.ndarray:
    """Rarity of entropy buckets over all windows of all texts: one partial sum per batch, 1001 totals."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in pieces(batches, "text", _PIECE):
            total += bucket_counts([t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total)], names=["bucket", "n"])

    got = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(BUCKETS, np.int64)
    for r in got.collect():
        counts[r["bucket"]] = r["n"]
    return rarity(counts)


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ("part", pa.int64()), ("first_z", pa.binary()), ("last_z", pa.binary()),
])
_DDL = """doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,
near_edited double, near_next double, part long, first_z binary, last_z binary"""
COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _rows(ids: list, texts: list[str], rank: np.ndarray) -> list[dict]:
    """Results of all texts but the last, each beside the one that follows it."""
    edited = []
    for t, follow in zip(texts, texts[1:]):
        n = len(t) // 4
        edited.append(t[:len(t) - n] + follow[:n])
    raw = [t.encode() for t in [*texts, *edited]]
    made = digests(raw, rank)
    own, other = made[:len(texts)], made[len(texts):]
    out = []
    for k, i in enumerate(ids[:-1]):
        out.append({
            "doc_id": i, "n_chars": len(texts[k]), "edited_sha256": hashlib.sha256(raw[len(texts) + k]).hexdigest(),
            "fingerprint": own[k].tobytes().hex(), "edited_fingerprint": other[k].tobytes().hex(),
            "near_edited": likeness(own[k], other[k]), "near_next": likeness(own[k], own[k + 1]),
        })
    return out


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text, of its edited text (the last quarter replaced by the
    opening of the next document) and of the next document, by ascending doc_id: COLUMNS.

    Texts are range-partitioned once; a partition sends on only its first and its last
    text, which meet the neighbouring partition's.  The last document is followed by the
    first (a single one by itself).  A null text counts as empty; repeated ids are ordered
    by text.  An empty table gives no rows.
    """
    rank = corpus_ranks(docs)

    def run(batches):
        part = TaskContext.get().partitionId()
        pack, held_id, held, first = zstandard.ZstdCompressor(level=1).compress, None, None, None
        for b in pieces(batches, "_z", _PIECE // 4):
            ids = b.column("doc_id").to_pylist()
            texts = ["" if t is None else t.decode() for t in unzip(b.column("_z").to_pylist())]
            if held is None:
                first = texts[0]
            else:
                ids, texts = [held_id, *ids], [held, *texts]
            yield pa.RecordBatch.from_pylist(_rows(ids, texts, rank), _OUT)
            held_id, held = ids[-1], texts[-1]
        if held is not None:
            yield pa.RecordBatch.from_pylist([{
                "doc_id": held_id, "part": part, "first_z": pack(first.encode()), "last_z": pack(held.encode())}], _OUT)

    def join_edges(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                last, follow = (t.decode() for t in unzip([r["last_z"], r["first_z"]]))
                out += _rows([r["doc_id"], None], [last, follow], rank)
            yield pa.RecordBatch.from_pylist(out, _OUT)

    ordered = zipped(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"])
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "_z")
    made = written(ordered.mapInArrow(run, _DDL), "features")
    edges = made.where("part is not null")
    # one narrow row for each partition
    place = Window.orderBy("part")
    follow = edges.select("part").select(
        "part", F.coalesce(F.lead("part").over(place), F.first("part").over(
            place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next"))
    firsts = edges.select(F.col("part").alias("next"), "first_z")
    met = edges.drop("first_z").join(follow, "part").join(firsts, "next").select(made.columns)
    whole = made.where("part is null").select(COLUMNS)
    return whole.unionByName(met.mapInArrow(join_edges, _DDL).select(COLUMNS))
