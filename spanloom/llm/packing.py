"""Packing token pieces into sequences of a fixed length.

Documents are encoded, cut at full sequences, and the pieces are dealt at random (by a
hash of document and position) into groups of bounded size.  Inside a group first-fit
decreasing places them: a tournament tree over the bins holds the largest free room
below each node, so that the leftmost bin with room is found in log(bins) steps.  Groups
are independent; the last bins of a group are the only ones far from full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces
from .tokens import encoder

GROUP_DOCS = 2048
_PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"
_PACKED = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


_FIRST = ["doc_id", "start", "length", "doc_tokens"]
_PLACE = ["sequence_id", "offset"]


class Tournament:
    """Free room of bins; finds the leftmost bin with at least a given room."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.best = [room] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Put ``size`` in the leftmost bin with room: its number and the room it had."""
        best, at = self.best, 1
        while at < self.leaves:
            at *= 2
            if best[at] < size:
                at += 1
        bin_, had = at - self.leaves, best[at]
        best[at] -= size
        at //= 2
        while at:
            top = best[2 * at] if best[2 * at] > best[2 * at + 1] else best[2 * at + 1]
            if best[at] == top:
                break
            best[at] = top
            at //= 2
        return bin_, had


def first_fit_decreasing(sizes: list[int], room: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size; equal sizes keep their order."""
    tree = Tournament(max(1, len(sizes)), room)
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        bins[k], had = tree.place(sizes[k])
        offsets[k] = room - had
    return bins, offsets


def token_pieces(
    docs: DataFrame, tokenizer: str, *, kind: str = "word", end_id: int = 1, length: int = 2048,
) -> DataFrame:
    """Ids of each document with the end id, cut every ``length`` ids: _PIECES rows.

    A null text counts as empty and has the end id alone.
    """

    def run(batches):
        enc = encoder(tokenizer, kind)
        end = np.array([end_id], "<u4").tobytes()
        for b in pieces(batches, "text", 2 << 20):
            out = []
            texts = [t or "" for t in b.column("text").to_pylist()]
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.encode(texts)):
                ids += end
                n = len(ids) // 4
                out += [(doc_id, a, min(length, n - a), n, ids[a * 4:(a + length) * 4]) for a in range(0, n, length)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), [*[pa.int64()] * 4, pa.binary()])],
                names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PIECES)


def pack(found: DataFrame, *, groups: int, length: int = 2048, seed: int = 7) -> DataFrame:
    """Place pieces (at most ``length`` long): adds sequence_id and offset.

    Equal pieces are placed in the order of doc_id and start.  Repeated rows are packed
    each; an empty table gives no rows.  A sequence is the pieces of one sequence_id by
    offset; it holds at most ``length`` ids and nothing is dropped.
    """

    def run(key, t):
        t = t.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("length", "ascending")])
        bins, offsets = first_fit_decreasing(t.column("length").to_pylist(), length)
        placed = [pa.array(np.array(bins, np.int64) + (key[0].as_py() << 32)), pa.array(offsets, pa.int64())]
        return pa.table([*[t.column(c) for c in _FIRST], *placed, t.column("ids")], names=[*_FIRST, *_PLACE, "ids"])

    loose = F.when(F.col("doc_id").isNull(), F.xxhash64("ids"))  # pieces without id are dealt by what they hold
    group = F.pmod(F.xxhash64("doc_id", "start", F.lit(seed), loose), F.lit(groups))
    return found.withColumn("_group", group).groupBy("_group").applyInArrow(run, _PACKED)


def pack_documents(
    docs: DataFrame, tokenizer: str, *, kind: str = "word", end_id: int = 1, length: int = 2048,
    group_docs: int = GROUP_DOCS,
) -> DataFrame:
    """Pieces of all documents with their place: doc_id, start, length, doc_tokens,
    sequence_id, offset, ids (little-endian unsigned 32-bit).

    The number of groups follows the number of documents, so a group stays small.  A
    document without id keeps its pieces (they are told apart by start alone).
    """
    groups = max(1, -(-docs.count() // group_docs))
    return pack(token_pieces(docs, tokenizer, kind=kind, end_id=end_id, length=length), groups=groups, length=length)
