"""Conversation prefix trie by collapsing whole sequences first.

Conversations that read alike from first turn to last are one sequence with a weight and
a list of the conversations that end there.  Sequences that are a proper prefix of another
drop out by an anti join, so the rest are the leaves.  Only one conversation of each
sequence is then cut into prefixes, and prefixes are summed with the weights.

A sequence of d turns is known by d and two sums of 64-bit hashes, one hash for each place
and turn: sums can be taken in any order, in parts, and for a prefix by a running sum.
Every prefix has one owner, the sequence of the smallest member.  What a node saves, that
it is a child and that it is a leaf are entered in the owner's rows, so sums over subtrees
are running sums along sequences and need no walk from level to level.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scan import running
from .common import written

CHUNK_TURNS = 1024
END_BLOCK = 8192  # conversation ids of one block of ids, joined before they are shuffled
_ROOT = "cast(0 as decimal(30, 0))"


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, pos, x1, x2, chars): hashes and length of turn ``pos`` (from 0) of its conversation.

    Order is by turn, null first; turns of one number are ordered by a hash of role and
    text, so that each run has the same order.  Texts are not carried along.  Null role or
    text counts as empty; rows without conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", F.xxhash64(role, text).alias("x1"),
        F.xxhash64(text, role, F.lit(1)).alias("x2"), F.length(text).cast("long").alias("chars"))
    chunk = F.coalesce(F.floor(F.col("turn") / CHUNK_TURNS), F.lit(-(1 << 60)))
    return running(turns, ["conv_id"], chunk, ["turn", "x1", "x2"], number="pos").select(
        "conv_id", "pos", "x1", "x2", "chars")


def with_shared_heads(turns: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt with the first ``head`` (0 to ``most``) turns of conversation ``base``.

    ``turns`` as of ``numbered_turns``.  The head takes the place of as many turns of the
    conversation's own; it is shorter where the base has fewer turns and empty where there
    is none.  Returns all conversation ids and rows (conv_id, d, x1, x2, chars), d from 1.
    """
    ids = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    heads = turns.where(F.col("pos") < most).groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "x1", "x2", "chars"))).alias("turns"))
    made = ids.select("conv_id", base.alias("base"), head.cast("int").alias("h")).join(heads, "base", "left")
    made = made.select("conv_id", "h", F.slice(F.coalesce("turns", F.array().cast(heads.schema["turns"].dataType)), F.lit(1), F.col("h")).alias("turns"))
    made = written(made, "heads")
    shared = made.select("conv_id", F.explode("turns").alias("t")).select(
        "conv_id", (F.col("t.pos") + 1).alias("d"), "t.x1", "t.x2", "t.chars")
    own = turns.join(made.select("conv_id", "h", F.size("turns").alias("n")), "conv_id").where("pos >= h").select(
        "conv_id", (F.col("n") + F.col("pos") - F.col("h") + 1).alias("d"), "x1", "x2", "chars")
    return made.select("conv_id"), shared.union(own)


def _places(rows: DataFrame) -> DataFrame:
    """Two hashes for each place and turn, as numbers whose sums cannot overflow."""
    return rows.withColumns({
        f"y{k}": F.xxhash64(F.lit(k), "d", "x1", "x2").cast("decimal(20, 0)") for k in (1, 2)}).drop("x1", "x2")


def _summed(column: str) -> Column:
    return F.sum(column).cast("decimal(30, 0)")


def _digests(batches):
    """SHA-256 of the ids of each (d, p1, p2), whose rows come sorted by block of ids."""
    key, state = None, None
    for b in batches:
        out = []
        for d, p1, p2, ids in zip(*(b.column(c).to_pylist() for c in ("d", "p1", "p2", "ids"))):
            if (d, p1, p2) != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (d, p1, p2), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _digest_rows(out)
    if key is not None:
        yield _digest_rows([(*key, state.hexdigest())])


def _digest_rows(rows):
    kinds = [("d", pa.int64()), ("p1", pa.decimal128(30, 0)), ("p2", pa.decimal128(30, 0)), ("ends", pa.string())]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])


def prefix_trie(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns.

    ``ids`` (conv_id) are all conversations, those without turns too; ``rows`` are their
    turns (conv_id, d, x1, x2, chars), d from 1 without gaps.  Columns: conv_id (smallest
    member), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.  Without conversations there is no row, not even the root.

    A hot first turn or a conversation repeated a million times is summed in parts before
    any shuffle; its list of ends is hashed as a stream of joined blocks, never held.  A
    conversation of very many turns is handled in chunks of ``CHUNK_TURNS``.
    """
    rows = written(_places(rows), "turns")
    whole = rows.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("d"), _summed("y1").alias("p1"), _summed("y2").alias("p2"))
    whole = written(ids.join(whole, "conv_id", "left").select(
        "conv_id", F.coalesce("d", F.lit(0)).cast("long").alias("d"),
        *[F.coalesce(c, F.expr(_ROOT)).alias(c) for c in ("p1", "p2")]), "sequences")
    weighted = written(
        whole.groupBy("d", "p1", "p2").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("rep")), "weighted")

    # prefixes of one conversation of each sequence
    mine = rows.join(weighted.select(F.col("rep").alias("conv_id"), "n", F.col("d").alias("size")), "conv_id")
    zero = F.expr("cast(0 as decimal(20, 0))")
    roots = weighted.select(
        F.col("rep").alias("conv_id"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("chars"),
        zero.alias("y1"), zero.alias("y2"), "n", F.col("d").alias("size"))
    cut = running(
        mine.unionByName(roots), ["conv_id"], F.floor(F.col("d") / CHUNK_TURNS), ["d"],
        sums={"p1": F.col("y1"), "p2": F.col("y2")})
    prefixes = written(cut.select(
        F.col("conv_id").alias("rep"), "d", "chars", "n", "size",
        *[F.col(f"p{k}").cast("decimal(30, 0)").alias(f"p{k}") for k in (1, 2)],
        *[(F.col(f"p{k}") - F.col(f"y{k}")).cast("decimal(30, 0)").alias(f"q{k}") for k in (1, 2)]), "prefixes")
    nodes = written(prefixes.groupBy("d", "p1", "p2").agg(
        F.sum("n").alias("n_convs"), F.min("rep").alias("rep"), F.max("chars").alias("chars"),
        F.max("q1").alias("q1"), F.max("q2").alias("q2"), (F.max("size") > F.col("d")).alias("longer")), "nodes")
    leaves = weighted.join(nodes.where("longer"), ["d", "p1", "p2"], "left_anti").select(
        weighted["rep"], F.lit(1).alias("leaf"))

    # what an owner's node adds, summed from the deepest turn up
    owned = nodes.select("rep", "d", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), F.lit(1).alias("owner"))
    entered = prefixes.select("rep", "d", "p1", "p2").join(owned, ["rep", "d"], "left").join(leaves, "rep", "left")
    entered = written(entered.withColumn("up", -F.col("d")), "entered")
    below = running(
        entered, ["rep"], -F.floor(F.col("d") / CHUNK_TURNS), ["up"],
        sums={"subtree": F.coalesce("saved", F.lit(0))}, lag={"child": F.col("owner")})
    summed = below.groupBy("d", "p1", "p2").agg(
        F.sum(F.coalesce("child", F.lit(0))).alias("n_children"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"),
        F.sum("subtree").alias("saved_tokens"))

    blocks = whole.groupBy("d", "p1", "p2", F.floor(F.col("conv_id") / END_BLOCK).alias("block")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ends = blocks.repartition("d", "p1", "p2").sortWithinPartitions("d", "p1", "p2", "block").mapInArrow(
        _digests, "d long, p1 decimal(30, 0), p2 decimal(30, 0), ends string")
    above = nodes.select((F.col("d") + 1).alias("d"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("rep").alias("parent"))
    found = nodes.join(summed, ["d", "p1", "p2"]).join(ends, ["d", "p1", "p2"], "left").join(above, ["d", "q1", "q2"], "left")
    return found.select(
        F.col("rep").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs",
        "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
