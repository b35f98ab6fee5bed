"""Substring dedup by compact windows.

Tokens are the hashes of five-word shingles.  Under one hash function a Cartesian tree of
a document gives its compact windows: (left, centre, right) stands for all subsequences
within [left, right] that hold the centre, which have their least hash there.  Trees of
two functions are joined by interval: each cell of their overlay is a run of subsequences
of ``LENGTH`` words that share the signature (least hash, least hash).  Three pairs of
functions are used.  Two documents with a passage of that length in common have its
signatures in common, and a near copy keeps most of them.  Near copies are not left to
that: windows of ``SIMILARITY`` have an exact run of ``sure_run`` shingles in common, and
grams are chosen so that each such run holds one, which is a signature as well.

Documents meet under a signature and are linked to its first holder, first inside a batch
and then among batches, so that a signature of very many documents is one row a batch;
holders of a gram are linked to the first of all as well.  Links of a pair are merged to
regions, and the shingles of a region are compared on both sides: a passage counts when it
has ``LENGTH`` words or more and a similarity (Jaccard, shingles) of ``SIMILARITY`` or more.
Each window of ``LENGTH`` is judged on its own, so a passage does not hang on what stands
beside it.

Documents that are like each other and not like the first holder, their leader, differ from
it by nearly the same edits.  At 0.8 two windows of 50 words differ by one word at most, so
windows are known by their sets of edits to the leader, whole and with one edit taken back;
equal sets over the same words are proof, and are met once a set in order of document.
This covers texts that go side by side with the leader; where it changes by more than
``NEAR_SHIFT`` words or ends inside the window, likeness to a later holder hangs on its own
grams.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, unzip, written, zipped
from .fm_index import cut_spans, words

SHINGLE = 5
LENGTH = 50
SIMILARITY = 0.8
FUNCTIONS = 4
BANDS = ((0, 1), (2, 3), (1, 2))
MANY_DIAGONALS = 24
_ALL = (1 << 64) - 1
NEAR_SHIFT = 8  # words that may be added or dropped along a region
GRID = 64  # ranges asked of a leader are rounded to it, so that few differ
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(51).integers(0, 1 << 63, FUNCTIONS, np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def word_hashes(said: list[bytes]) -> np.ndarray:
    number = {w: k for k, w in enumerate(dict.fromkeys(said))}
    one = np.array([xxhash.xxh3_64_intdigest(w) for w in number], np.uint64)
    return one[np.fromiter(map(number.__getitem__, said), np.int64, len(said))]


def shingled(level: np.ndarray) -> np.ndarray:
    """Hashes of the shingles that begin at each word."""
    h = np.zeros(max(len(level) - SHINGLE + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            h = h * _STEP + level[k:len(h) + k]
    return _mix(h)


def shingles(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, document after document, and the first of each document (and the end)."""
    sizes = np.array([len(d) for d in docs], np.int64)
    counts = np.maximum(sizes - SHINGLE + 1, 0)
    starts = np.concatenate([[0], np.cumsum(counts)])
    if not starts[-1]:
        return np.zeros(0, np.uint64), starts
    h = shingled(word_hashes([w for d in docs for w in d]))
    first = np.repeat(np.cumsum(sizes) - sizes - starts[:-1], counts)
    return h[np.arange(starts[-1]) + first], starts


def compact_windows(values: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(left, centre, right) of the Cartesian tree's nodes that span ``least`` values or more.

    Of equal values the middle one is the centre, which keeps the tree of a text that
    repeats itself shallow.
    """
    out, todo = [], [(0, len(values))] if len(values) >= least else []
    while todo:
        a, b = todo.pop()
        part = values[a:b]
        lows = np.flatnonzero(part == part.min())
        c = a + int(lows[len(lows) >> 1])
        out.append((a, c, b - 1))
        if c - a >= least:
            todo.append((a, c))
        if b - c - 1 >= least:
            todo.append((c + 1, b))
    return out


def window_centres(values: np.ndarray, least: int) -> np.ndarray:
    """For each run of ``least`` values the place of its least one, the first of equal ones.

    That is the centre of the compact window that owns the run; a stretch of starts with one
    centre is all that ``compact_windows`` says of runs of this length, without its tree.
    """
    at = np.arange(max(len(values) - least + 1, 0))
    if not len(at):
        return at
    best, width = np.arange(len(values)), 1
    while 2 * width <= least:
        left, right = best[:-width], best[width:]
        best, width = np.where(values[right] < values[left], right, left), 2 * width
    left, right = best[at], best[at + least - width]
    return np.where(values[right] < values[left], right, left)


def sure_run(least: int, similarity: float) -> int:
    """Shingles that two windows of ``least`` with that similarity have in one run at least.

    A changed, added or dropped word inside costs SHINGLE - 1 shingles or more, so few fit,
    and the shingles in common stand in one run more than that.
    """
    common = math.ceil(2 * similarity / (1 + similarity) * least - 1e-9)
    return -(-common // ((least - common) // (SHINGLE - 1) + 1))


def chosen_grams(h: np.ndarray, starts: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, place in ``h``) of grams, one or more in every ``run`` shingles of a document.

    Of the grams that begin in half a run the first of the least hash is taken, so that
    two documents with the same run take the same gram of it.
    """
    size = (run + 1) // 2
    wide = run - size + 1
    if len(h) < run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(h) - size + 1
    key = np.full(n, np.uint64(size))
    with np.errstate(over="ignore"):
        for k in sorted({*range(0, size, SHINGLE), size - 1}):
            key = key * _STEP + h[k:n + k]
    key = _mix(key)
    picked = np.arange(n - wide + 1) + np.lib.stride_tricks.sliding_window_view(key, wide).argmin(1)
    left = np.repeat(starts[1:], np.diff(starts))[:len(picked)] - np.arange(len(picked))
    at = np.unique(picked[left >= run])
    return (key[at] | np.uint64(1)).view(np.int64), at  # odd, other signatures even


def signature_cells(h: np.ndarray, starts: np.ndarray, least: int, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, document number, shingle position in the document) of all cells.

    A compact window owns the subsequences of ``least`` shingles that start in
    [max(left, centre - least + 1), min(centre, right - least + 1)]; over all windows
    these ranges part a document, so two trees are joined by interval where either's
    centre changes.
    Chosen grams follow as cells of their own.
    """
    sizes = np.diff(starts)
    spans = np.maximum(sizes - least + 1, 0)  # subsequences of each document
    at = np.arange(spans.sum()) + np.repeat(starts[:-1] - np.cumsum(spans) + spans, spans)
    doc = np.repeat(np.arange(len(sizes)), spans)
    trees = []
    for seed in _SEEDS:
        v = _mix(h ^ seed)
        trees.append((v, window_centres(v, least)[at]))
    keys, docs, places = [], [], []
    for band, (i, j) in enumerate(BANDS):
        if not len(at):
            continue
        (vi, ci), (vj, cj) = trees[i], trees[j]
        new = np.ones(len(at), bool)  # where a cell of the overlay begins
        new[1:] = (ci[1:] != ci[:-1]) | (cj[1:] != cj[:-1]) | (doc[1:] != doc[:-1])
        ci, cj, d = ci[new], cj[new], doc[new]
        with np.errstate(over="ignore"):
            key = (_mix(vi[ci] * _STEP + vj[cj] + np.uint64(band + 1)) & ~np.uint64(1)).view(np.int64)
        new = np.ones(len(key), bool)  # a text that repeats itself gives one signature over and over
        new[1:] = (key[1:] != key[:-1]) | (d[1:] != d[:-1])
        keys.append(key[new])
        docs.append(d[new])
        places.append((ci - starts[d])[new])
    key, at = chosen_grams(h, starts, sure_run(least, similarity))
    doc = np.searchsorted(starts, at, "right") - 1
    keys.append(key)
    docs.append(doc)
    places.append(at - starts[doc])
    return np.concatenate(keys), np.concatenate(docs), np.concatenate(places)


_CELL = ["key", "doc", "at", "to_doc", "to_at"]
_LINK = [*_CELL, "led"]
_LINK_DDL = "key long, doc long, at long, to_doc long, to_at long, led boolean"


def _led(key: np.ndarray, doc: np.ndarray, at: np.ndarray, ascending: bool = False) -> pa.RecordBatch:
    """Link the rows of each key to its first; the smallest document's rows are not led.  Of a
    gram, whose key is odd, other places in the first document are led as well: they count."""
    # rows of a key stand in order of document already where the ids of the batch ascend
    order = np.argsort(key, kind="stable") if ascending else np.lexsort((at, doc, key))
    key, doc, at = key[order], doc[order], at[order]
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    lead = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    other = (doc != doc[lead]) | ((key & 1 == 1) & (at != at[lead]))
    return pa.RecordBatch.from_arrays([
        pa.array(key, mask=other & (key & 1 == 0)), pa.array(doc), pa.array(at),
        pa.array(doc[lead], mask=~other), pa.array(at[lead], mask=~other), pa.array(other)], names=_LINK)


def _cells(batches, least: int, similarity: float):
    """Cells of each batch, linked to the first holders in it."""
    for b in pieces(batches, "text", 4 << 20):
        ids = b.column("doc_id").to_numpy(zero_copy_only=False)
        h, starts = shingles([words(t) for t in b.column("text").to_pylist()])
        key, doc, at = signature_cells(h, starts, least, similarity)
        yield _led(key, ids[doc], at, bool((ids[1:] >= ids[:-1]).all()))


def _first_holders(batches):
    """Link the rows of a run of equal keys to its first; rows that are links pass."""
    last = None  # key, document and place that lead the run at the end of the last batch
    for b in batches:
        linked = b.filter(b.column("led"))
        if linked.num_rows:
            yield linked.select(_CELL)
        b = b.filter(pc.invert(b.column("led")))
        if not b.num_rows:
            continue
        key, doc, at = (b.column(c).to_numpy(zero_copy_only=False) for c in _CELL[:3])
        if last is not None:
            key, doc, at = (np.concatenate([[x], y]) for x, y in zip(last, (key, doc, at)))
        first = np.concatenate([[True], key[1:] != key[:-1]])
        lead = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
        other = (doc != doc[lead]) | ((key & 1 == 1) & (at != at[lead]))
        last = key[lead[-1]], doc[lead[-1]], at[lead[-1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[other]) for x in (key, doc, at, doc[lead], at[lead])], names=_CELL)


def _links(cells: DataFrame) -> DataFrame:
    """Links of all cells to first holders; rows that lead a batch meet in one place a key."""
    deal = F.when(F.col("led"), F.xxhash64("doc", "at")).otherwise(F.col("key"))
    return cells.repartition(deal).sortWithinPartitions("key", "doc", "at").mapInArrow(
        _first_holders, ", ".join(f"{c} long" for c in _CELL))


def _regions(batches, least: int):
    """Ranges [b0, b1) of a document to be compared with ranges [a0, a1) of another.

    Links on one diagonal that follow each other within two windows are one stretch;
    stretches of a pair that overlap in both documents, as those of texts that repeat
    themselves do by the thousand, are one region.
    """
    held = None
    reach = least + GRID // 2

    def close(cols):
        doc, to_doc, shift, at = cols
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (to_doc[1:] != to_doc[:-1]) | (shift[1:] != shift[:-1]) | (
            at[1:] - at[:-1] > 2 * least)
        first = np.flatnonzero(new)
        end = at[np.append(first[1:], len(at)) - 1] + reach
        doc, to_doc, shift = doc[first], to_doc[first], shift[first]
        lo = np.maximum(at[first] - reach, 0)
        out: list[tuple] = []
        edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (to_doc[1:] != to_doc[:-1]), [True]]))
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
            for b0, b1, a0, a1 in _joined(lo[i:j], end[i:j], shift[i:j]):
                out.append((doc[i], b0, b1, to_doc[i], a0 // GRID * GRID, a1 // GRID * GRID + GRID))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(x, np.int64)) for x in zip(*out)], names=["doc", "b0", "b1", "to_doc", "a0", "a1"])

    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "to_doc", "shift", "at")]
        if held is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(held, cols)]
        doc, to_doc = cols[:2]
        cuts = np.flatnonzero((doc[1:] != doc[:-1]) | (to_doc[1:] != to_doc[:-1])) + 1
        whole = int(cuts[-1]) if len(cuts) else 0  # the last pair may go on
        held = [c[whole:] for c in cols]
        if whole:
            yield close([c[:whole] for c in cols])
    if held is not None:
        yield close(held)


def _joined(lo: np.ndarray, end: np.ndarray, shift: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes (b0, b1, a0, a1) that hold all stretches [lo, end) and their places, overlapping ones joined."""
    boxes = sorted(zip(lo.tolist(), end.tolist(), np.maximum(lo - shift, 0).tolist(), np.maximum(end - shift, 0).tolist()))
    while True:
        out: list[tuple[int, int, int, int]] = []
        live: list[tuple[int, int, int, int]] = []
        for box in boxes:
            b0, b1, a0, a1 = box
            still = []
            for x in live:
                if x[1] < b0:
                    out.append(x)
                elif x[2] <= a1 and a0 <= x[3]:
                    b0, b1, a0, a1 = min(b0, x[0]), max(b1, x[1]), min(a0, x[2]), max(a1, x[3])
                else:
                    still.append(x)
            live = [*still, (b0, b1, a0, a1)]
        out += live
        if len(out) == len(boxes):
            return out
        boxes = sorted(out)


def _distinct(x: np.ndarray, least: int) -> np.ndarray:
    """Number of distinct values in each window of ``least`` values."""
    n = len(x) - least + 1
    order = np.argsort(x, kind="stable")
    again = np.flatnonzero(x[order[1:]] == x[order[:-1]])
    p, k = order[again], order[again + 1]
    near = k - p < least
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.maximum(k[near] - least + 1, 0), 1)
    np.add.at(step, np.minimum(p[near], n - 1) + 1, -1)
    return least - np.cumsum(step[:n])


def _held(x: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, first window, end) of the runs of windows that hold a value; ``x`` stand at ``at``."""
    order = np.lexsort((at, x))
    x, at = x[order], at[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (at[1:] - at[:-1] > least)
    first = np.flatnonzero(new)
    return x[first], at[first] - least + 1, at[np.append(first[1:], len(x)) - 1] + 1


def _common(b: np.ndarray, p: np.ndarray, a: np.ndarray, q: np.ndarray, least: int, n: int) -> np.ndarray:
    """Number of distinct values that windows 0 to n of ``b`` (at ``p``) and ``a`` (at ``q``) both hold."""
    sides = [_held(b, p, least), _held(a, q, least)]
    value = np.concatenate([s[0] for s in sides for _ in range(2)])
    at = np.concatenate([s[k] for s in sides for k in (1, 2)])
    turn = np.concatenate([np.full(len(s[0]), k) for s in sides for k in (1, -1)])
    order = np.lexsort((turn, at, value))
    at, both = np.clip(at[order], 0, n), np.cumsum(turn[order]) == 2
    was = np.concatenate([[False], both[:-1]])
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at[both & ~was], 1)
    np.add.at(step, at[was & ~both], -1)
    return np.cumsum(step[:n])


def _window_sets(x: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct values in each window of ``least`` values, and a hash of that set."""
    n = len(x) - least + 1
    value, first, end = _held(x, np.arange(len(x)), least)
    first, end = np.clip(first, 0, n), np.clip(end, 0, n)
    count, total = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.uint64)
    mixed = _mix(value ^ _STEP)
    with np.errstate(over="ignore"):
        np.add.at(count, first, 1)
        np.add.at(count, end, -1)
        np.add.at(total, first, mixed)
        np.subtract.at(total, end, mixed)
        return np.cumsum(count[:n]), np.cumsum(total[:n], dtype=np.uint64)


def _incidence(x: np.ndarray, at: np.ndarray, least: int, values: np.ndarray) -> np.ndarray:
    """Which of the sorted ``values`` stand in the windows that start at ``at``."""
    out = np.zeros((len(at), len(values)), np.float32)
    for k in range(least):
        v = x[at + k]
        c = np.minimum(np.searchsorted(values, v), len(values) - 1)
        good = values[c] == v
        out[np.flatnonzero(good), c[good]] = 1
    return out


def _like_sets(b: np.ndarray, a: np.ndarray, rows: np.ndarray, least: int, similarity: float) -> np.ndarray | None:
    """For windows ``rows`` of ``b``: has ``a`` a window whose set is as similar?  All sets of
    both are compared, each once; None where these are too many, as in texts that do not
    repeat themselves."""
    nb, kb = _window_sets(b, least)
    na, ka = _window_sets(a, least)
    _, mine, back = np.unique(kb[rows], return_index=True, return_inverse=True)
    _, theirs = np.unique(ka, return_index=True)
    values = np.intersect1d(b, a)
    if len(mine) * len(theirs) > 4_000_000 or len(values) * (len(mine) + len(theirs)) > 40_000_000:
        return None
    at = rows[mine]
    c = _incidence(b, at, least, values) @ _incidence(a, theirs, least, values).T
    good = c >= similarity * (nb[at][:, None] + na[theirs][None, :] - c) - 1e-6
    return good.any(1)[back]


def _met(b: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of ``a``, ``a`` in that order, and where each of ``b`` begins and ends there."""
    order = np.argsort(a, kind="stable")
    ordered = a[order]
    lo = np.searchsorted(ordered, b)
    hi = lo + (ordered[np.minimum(lo, len(a) - 1)] == b) if len(a) else lo
    if len(a) and (ordered[1:] == ordered[:-1]).any():
        hi = np.searchsorted(ordered, b, "right")
    return order, ordered, lo, hi


def matching_windows(b: np.ndarray, a: np.ndarray, least: int, similarity: float, met=None) -> np.ndarray:
    """For each window of ``least`` shingles of ``b``: is one of ``a`` as similar as ``similarity``?

    Windows are compared on the diagonals on which shingles of both stand, so words may be
    changed, added or dropped, but not moved about.
    """
    n, m = len(b) - least + 1, len(a) - least + 1
    if n < 1 or m < 1:
        return np.zeros(max(n, 0), bool)
    order, ordered, lo, hi = met or _met(b, a)
    hit = np.flatnonzero(hi > lo)
    out = np.zeros(n, bool)
    if not len(hit):
        return out
    share = 2 * similarity / (1 + similarity) * least - 1e-9  # of equal sets of one size with that Jaccard
    sorted_b = np.sort(b)
    if (sorted_b[1:] != sorted_b[:-1]).all() and (ordered[1:] != ordered[:-1]).all():  # the common case
        nb, na = np.full(n, least), np.full(m, least)
        known = np.concatenate([[0], np.cumsum(hi > lo)])
        open_ = known[least:] - known[:-least] >= share
    else:
        nb, na = _distinct(b, least), _distinct(a, least)
        holds = _held(b[hit], hit, least)
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, np.clip(holds[1], 0, n), 1)
        np.add.at(step, np.clip(holds[2], 0, n), -1)
        open_ = np.cumsum(step[:n]) >= similarity * (nb + na.min()) / (1 + similarity) - 1e-9
    if not open_.any():
        return out
    shifts, times = np.unique(
        np.concatenate([order[lo[hit]] - hit, order[hi[hit] - 1] - hit]), return_counts=True)
    if len(shifts) > MANY_DIAGONALS:  # a text that repeats itself: few sets on many diagonals
        rows = np.flatnonzero(open_)
        like = _like_sets(b, a, rows, least, similarity)
        if like is not None:
            out[rows[like]] = True
            return out
    theirs = None
    for d in shifts[np.argsort(-times, kind="stable")].tolist():
        i0, i1 = max(0, -d), min(n, m - d)
        if i1 <= i0 or not open_[i0:i1].any():
            continue
        near = i0 + np.flatnonzero(open_[i0:i1])
        i0, i1 = int(near[0]), int(near[-1]) + 1
        # where no shingle stands twice, shingles in their place are enough for most windows
        same = np.concatenate([[0], np.cumsum(b[i0:i1 + least - 1] == a[i0 + d:i1 + d + least - 1])])
        good = (same[least:] - same[:-least] >= share) & (nb[i0:i1] == least) & (na[i0 + d:i1 + d] == least)
        out[i0:i1] |= good
        open_[i0:i1] &= ~good
        if not open_[i0:i1].any():
            continue
        if theirs is None:
            theirs = np.flatnonzero(np.isin(a, b[hit]))
        p = hit[(hit >= i0) & (hit < i1 + least - 1)]
        q = theirs[(theirs >= i0 + d) & (theirs < i1 + d + least - 1)]
        if not len(p) or not len(q):
            continue
        c = _common(b[p], p - i0, a[q], q - d - i0, least, i1 - i0)
        good = c >= similarity * (nb[i0:i1] + na[i0 + d:i1 + d] - c) - 1e-9
        out[i0:i1] |= good
        open_[i0:i1] &= ~good
        if not open_.any():
            break
    return out


def _whole_stretches(
    b: np.ndarray, a: np.ndarray, least: int, similarity: float, passed: np.ndarray, met,
) -> list[tuple[int, int]]:
    """Stretches [s, e) of dense windows whose similarity with their place in ``a`` is high enough as a whole;
    none where all dense windows have ``passed`` on their own."""
    order, _, lo, hi = met
    place, hit = np.minimum(lo, len(a) - 1), hi > lo
    total = np.concatenate([[0], np.cumsum(hit)])
    share = 2 * similarity / (1 + similarity)  # of equal sets of one size with that Jaccard
    dense = np.flatnonzero(total[least:] - total[:-least] >= np.ceil(share * least - 1e-9))
    if passed[dense].all():
        return []
    cuts = np.flatnonzero(np.diff(dense) > least)
    todo = list(zip(dense[np.concatenate([[0], cuts + 1])].tolist(), (dense[np.append(cuts, len(dense) - 1)] + least).tolist()))
    out = []
    while todo:
        s, e = todo.pop()
        inside = s + np.flatnonzero(hit[s:e])
        if len(inside) < share * least:
            continue
        s, e = int(inside[0]), int(inside[-1]) + 1
        there = order[place[inside]]
        shifts, times = np.unique(there - inside, return_counts=True)
        near = there[np.abs(there - inside - shifts[times.argmax()]) <= e - s]
        mine, theirs = set(b[s:e].tolist()), set(a[near.min():near.max() + 1].tolist())
        exact = len(inside) == e - s >= least
        if exact or len(mine & theirs) >= similarity * len(mine | theirs):
            out.append((s, e))
        elif len(inside) < e - s:  # part it at its widest gap
            k = int(np.diff(inside).argmax())
            todo += [(s, int(inside[k]) + 1), (int(inside[k + 1]), e)]
    return out


def matching_stretches(b: np.ndarray, a: np.ndarray, least: int, similarity: float, met=None) -> list[tuple[int, int]]:
    """Stretches [s, e) of shingles ``b``: the union of the windows of ``least`` that have
    their like in ``a`` (see ``matching_windows``), and longer stretches of dense windows
    that are similar enough as a whole."""
    if len(b) < least or not len(a):
        return []
    met = met or _met(b, a)
    passed = matching_windows(b, a, least, similarity, met)
    found = np.flatnonzero(passed)
    out = _whole_stretches(b, a, least, similarity, passed, met)
    if len(found):
        cuts = np.flatnonzero(np.diff(found) > least)
        out += zip(found[np.concatenate([[0], cuts + 1])].tolist(), (found[np.append(cuts, len(found) - 1)] + least).tolist())
    merged: list[tuple[int, int]] = []
    for s, e in sorted(out):
        if merged and s <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(merged[-1][1], e)
        else:
            merged.append((s, e))
    return merged


def _copied_whole(b: np.ndarray, a: np.ndarray) -> bool:
    """Do the words or shingles ``b`` stand in ``a`` as they are?  Looks at a few places only."""
    n = len(b)
    places = np.flatnonzero(a[n // 2:len(a) - (n - 1 - n // 2)] == b[n // 2])[:4] if 0 < n <= len(a) else ()
    return any((a[p:p + n] == b).all() for p in places)


def edits(b: np.ndarray, a: np.ndarray, met) -> tuple[list[tuple[int, int, int, int, int]], tuple[int, int, int, int]]:
    """What words ``b`` have changed of words ``a`` where both go side by side.

    Runs of shingles (``met`` of those of both) that stand once in ``a`` are chained on
    diagonals near the commonest.  Returns (place in b, words there, place in a, words there, hash of b's words) in order,
    one for each changed word, and the ranges (b, b, a, a) from the first run to the last.
    """
    order, _, lo, hi = met
    i = np.flatnonzero(hi - lo == 1)
    if not len(i):
        return [], (0, 0, 0, 0)
    there = order[lo[i]]
    shift = there - i
    value, times = np.unique(shift, return_counts=True)
    near = np.abs(shift - value[times.argmax()]) <= NEAR_SHIFT
    i, there = i[near], there[near]
    first = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1] + 1) | (there[1:] != there[:-1] + 1)]))
    last = np.append(first[1:], len(i)) - 1
    out = []
    c_end, a_end = int(i[last[0]]) + SHINGLE, int(there[last[0]]) + SHINGLE  # words known to be equal end here
    for x, y in zip(first[1:].tolist(), last[1:].tolist()):
        c, t = int(i[x]), int(there[x])
        if t < a_end - SHINGLE + 1:
            continue  # goes back: not part of the chain
        back = min(c - c_end, t - a_end, 0)  # words at the edge that also fit the other side
        at, n, to, m = c_end + back, c - c_end - back, a_end + back, t - a_end - back
        if n == m:
            out += [(at + k, 1, to + k, 1, int(b[at + k])) for k in np.flatnonzero(b[at:at + n] != a[to:to + n]).tolist()]
        else:
            out.append((at, n, to, m, xxhash.xxh3_64_intdigest(b[at:at + n].tobytes())))
        c_end, a_end = int(i[y]) + SHINGLE, int(there[y]) + SHINGLE
    return out, (int(i[first[0]]), c_end, int(there[first[0]]), a_end)


def edit_sets(
    b: np.ndarray, a: np.ndarray, h: np.ndarray, met, name: int, length: int, core: int, base: int = 0,
) -> list[tuple[int, int, int, int, int, int, int]]:
    """(key, lo, hi, first, words, taken, pad) of the windows of ``b`` that differ from ``a``.

    Two windows of ``length`` words are alike if ``core`` words side by side are the same, or
    all but one word that is changed, added or dropped.  All windows with the same edits of
    ``a`` are one row: they start at words lo to hi of ``a``, the first at word ``first`` of
    ``b``, where it has ``words`` words.  The key is of ``a``'s ``name`` and the edits: of
    all (taken is -1), or, in windows of ``length`` with several, of all but one at the
    place ``taken`` of ``a``, whose first word is number ``base``.  ``pad`` words more on
    either side are alike for any window that holds a core.  Windows in which a shingle stands twice are left out.
    """
    found, (_, _, a_lo, a_hi) = edits(b, a, met)
    if not found:
        return []
    seen = length - SHINGLE + 1
    twice = np.zeros(len(b) + 1, np.int64)
    if len(h) >= seen:
        twice[1:len(h) - seen + 2] = _distinct(h, seen) < seen
    twice = np.cumsum(twice)
    mark = [xxhash.xxh3_64_intdigest(f"{base + to} {n} {m} {w}", name & 0xFFFFFFFFFFFFFFFF) for _, n, to, m, w in found]
    out = []
    for i, (at, n, to, m, _) in enumerate(found):
        before = found[i - 1][2] + found[i - 1][3] if i else a_lo
        total = dropped = 0
        for j in range(i, len(found)):
            z_at, z_n, z_to, z_m, _ = found[j]
            after = found[j + 1][2] if j + 1 < len(found) else a_hi
            total += mark[j]
            dropped += found[j][3] - found[j][1]
            fits = False
            for size in (core, length):
                wide = size + max(0, dropped)  # dropped words leave room
                lo = max(before, z_to + z_m + (z_m == 0) - wide)
                hi = min(to - (m == 0), after - wide)
                fits |= z_to - to < wide
                first = lo + at - to
                if lo > hi or twice[min(first + hi - lo + 1, len(b))] > twice[min(first, len(b))]:
                    continue
                words_ = wide + (z_at + z_n - z_to - z_m) - (at - to)
                out.append(((total * size) & _ALL, lo, hi, first, words_, -1, length - size))
                if size == length and j > i:
                    out += [(((total - mark[k]) * size) & _ALL, lo, hi, first, words_, found[k][2], 0)
                            for k in range(i, j + 1) if found[k][1] <= 1 and found[k][3] <= 1]
            if not fits:
                break
    return out


def _one_text_each(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) with one row an id, and the ids that had several rows (None: no id had).

    Of the texts of an id the smallest stands for it; the others are not compared.
    """
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    again = written(known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "again")
    if again.isEmpty():
        return known, None
    alone = known.join(again, "doc_id", "left_anti")
    chosen = known.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return alone.unionByName(chosen), chosen.select("doc_id", F.xxhash64("text").alias("_known"))


def repeated_passages(
    docs: DataFrame, *, length: int = LENGTH, similarity: float = SIMILARITY,
) -> DataFrame:
    """Passages of ``docs`` (doc_id, text) that repeat one of a document with a smaller id.

    Rows (doc, first, last, to_doc): word range in ``doc`` and the document it repeats.
    The first holder of a passage has no row for it.  A document does not repeat itself;
    equal rows count once, and of several texts of one id the smallest stands for it.  Rows
    without id, without text or with fewer than ``length`` words have no passages.  A text
    is handled as a whole in a task, at some 60 bytes a word.
    """
    known, _ = _one_text_each(docs)
    return _passages(known, length, similarity)


def _passages(known: DataFrame, length: int, similarity: float) -> DataFrame:
    least = length - SHINGLE + 1
    cells = known.mapInArrow(lambda batches: _cells(batches, least, similarity), _LINK_DDL)
    links = written(_links(cells), "links")
    # holders that met the first of their batch are linked to the first of all as well, so
    # that all holders of a gram have one leader to be compared with
    gram = links.where("key & 1 = 1")
    up = gram.where("doc <> to_doc").select(
        "key", F.col("doc").alias("to_doc"), F.col("at").alias("to_at"), F.col("to_doc").alias("_doc"), F.col("to_at").alias("_at"))
    further = gram.where("doc <> to_doc").join(up, ["key", "to_doc", "to_at"]).select(
        "key", "doc", "at", F.col("_doc").alias("to_doc"), F.col("_at").alias("to_at"))
    links = links.union(further)
    texts = zipped(known.where("text is not null"), ["doc_id"])
    found = written(_verified(links, texts, least, similarity), "found")
    return found.where("key is null").select("doc", "first", "last", "to_doc").union(_by_edits(found))


def _by_edits(found: DataFrame) -> DataFrame:
    """Passages that are alike by their edits: proof without another look at the texts.

    Windows with the same edits of the same leader meet in order of document.  One as it
    stands matches an earlier one that starts at the same word, as it stands or with an edit
    taken back; one with an edit taken back matches an earlier one as it stands, or one
    taken back at the same place.  What is held is the first document of each start, so a
    set of edits with very many holders needs no more room than one with few.
    """
    rows = found.where("key is not null").select("key", "doc", "lo", "hi", "first", "words", "taken", "left", "right")
    met = rows.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).where("a < z").select("key")
    rows = rows.join(met, "key").repartition("key").sortWithinPartitions("key", "doc", "lo")
    return rows.mapInArrow(_meet, "doc long, first long, last long, to_doc long")


def _meet(batches):
    key, starts = None, {}
    for b in batches:
        out = []
        for k, doc, lo, hi, first, n, taken, left, right in zip(
                *(b.column(c).to_pylist() for c in ("key", "doc", "lo", "hi", "first", "words", "taken", "left", "right"))):
            if k != key:
                key, starts = k, {}  # (start, taken; None: any) to its first document
            same = (None,) if taken < 0 else (-1, taken)
            hits = [(at, d) for at in range(lo, hi + 1) for d in [min((starts[at, t] for t in same if (at, t) in starts), default=doc)] if d < doc]
            if hits:
                out.append((
                    doc, max(first + hits[0][0] - lo - left, 0), first + hits[-1][0] - lo + n - 1 + max(right, 0), min(d for _, d in hits)))
            for at in range(lo, hi + 1):
                starts.setdefault((at, taken), doc)
                starts.setdefault((at, None), doc)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=["doc", "first", "last", "to_doc"])


_FOUND = ["doc", "first", "last", "to_doc", "key", "lo", "hi", "words", "taken", "left", "right"]


def _verified(links: DataFrame, texts: DataFrame, least: int, similarity: float) -> DataFrame:
    """Passages (doc, first, last, to_doc) of links, and the edited windows of their regions (see ``edit_sets``)."""
    links = links.where("doc <> to_doc").withColumn("shift", F.col("at") - F.col("to_at"))
    sorted_links = links.select("doc", "to_doc", "shift", "at").repartition("doc", "to_doc").sortWithinPartitions(
        "doc", "to_doc", "shift", "at")
    regions = written(
        sorted_links.mapInArrow(
            lambda batches: _regions(batches, least),
            "doc long, b0 long, b1 long, to_doc long, a0 long, a1 long"), "regions")
    asked = regions.select(F.col("to_doc").alias("doc_id"), "a0", "a1").distinct()
    asked = asked.groupBy("doc_id").agg(F.collect_list(F.struct("a0", "a1")).alias("ranges"))
    more = SHINGLE - 1
    core = math.ceil(2 * similarity / (1 + similarity) * least - 1e-9) + more

    def cut(batches):
        for b in pieces(batches, "_z", 1 << 20):
            out: list[list] = [[], [], [], []]
            for i, z, ranges in zip(b.column("doc_id").to_pylist(), unzip(b.column("_z").to_pylist()), b.column("ranges").to_pylist()):
                w = word_hashes(words(z.decode()))
                for r in ranges:
                    for col, x in zip(out, (i, r["a0"], r["a1"], w[r["a0"]:r["a1"] + more].tobytes())):
                        col.append(x)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.binary())],
                names=["to_doc", "a0", "a1", "slice"])

    slices = texts.join(asked.hint("merge"), "doc_id").mapInArrow(cut, "to_doc long, a0 long, a1 long, slice binary")
    both = regions.join(slices.hint("merge"), ["to_doc", "a0", "a1"]).withColumnRenamed("doc", "doc_id")

    def verify(batches):
        seen, w, h = None, None, None
        for b in pieces(batches, "_z", 1 << 20):
            out: list[list] = [[] for _ in _FOUND]
            cols = [b.column(c).to_pylist() for c in ("doc_id", "_z", "b0", "b1", "to_doc", "a0", "slice")]
            for i, z, b0, b1, to, a0, part in zip(*cols):
                if seen != (i, z):
                    seen, w = (i, z), word_hashes(words(unzip([z])[0].decode()))
                    h = shingled(w)
                theirs = np.frombuffer(part, np.uint64)
                own, other = h[b0:b1], shingled(theirs)
                if len(own) >= least and _copied_whole(own, other):
                    rows = [(i, b0, min(b1, len(h)) - 1 + more, to, *[None] * 7)]
                    for col, x in zip(out, zip(*rows)):
                        col += x
                    continue
                met = _met(own, other)
                rows = [(i, b0 + s, b0 + e - 1 + more, to, *[None] * 7)
                        for s, e in matching_stretches(own, other, least, similarity, met)]
                if len(w) >= least + more:
                    rows += [(i, b0 + first, None, None, key - (1 << 63), a0 + lo, a0 + hi, n, taken + a0 * (taken >= 0),
                              pad, min(pad, len(w) - b0 - first - (hi - lo) - n))
                             for key, lo, hi, first, n, taken, pad in edit_sets(w[b0:b1 + more], theirs, own, met, to, least + more, core, a0)]
                for col, x in zip(out, zip(*rows)):
                    col += x
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=_FOUND)

    checked = texts.join(both.hint("merge"), "doc_id").select("doc_id", "_z", "b0", "b1", "to_doc", "a0", "slice")
    return checked.mapInArrow(verify, ", ".join(f"{c} long" for c in _FOUND))


def merged_passages(found: DataFrame) -> DataFrame:
    """One row per document with passages: doc_id, spans (sorted, disjoint word ranges), repeats (documents repeated)."""
    rows = found.groupBy("doc").agg(
        F.array_sort(F.collect_set(F.struct("first", "last"))).alias("s"),
        F.array_sort(F.collect_set("to_doc")).alias("repeats"))
    # spans are sorted by first: one opens where it starts behind all earlier ends
    return rows.mapInArrow(_merge_spans, """doc_id long, spans array<struct<first: long, last: long>>,
        repeats array<long>, n_repeated_words long""")


def _merge_spans(batches):
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    for b in batches:
        spans = []
        for found in b.column("s").to_pylist():
            out: list[dict] = []
            for s in found:
                if out and s["first"] <= out[-1]["last"] + 1:
                    out[-1]["last"] = max(out[-1]["last"], s["last"])
                else:
                    out.append(dict(s))
            spans.append(out)
        words_ = [sum(s["last"] - s["first"] + 1 for s in x) for x in spans]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc"), pa.array(spans, kind), b.column("repeats"), pa.array(words_, pa.int64())],
            names=["doc_id", "spans", "repeats", "n_repeated_words"])


def report(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_spans, n_repeated_words, spans ("first-last ..."), repeats (ids)."""
    found = merged_passages(repeated_passages(docs, **options))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["first"], s["last"])), " ")
    return docs.select(F.col("doc_id").cast("long")).join(found, "doc_id", "left").select(
        "doc_id", F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("n_repeated_words", F.lit(0)).alias("n_repeated_words"),
        F.coalesce(text, F.lit("")).alias("spans"),
        F.coalesce("repeats", F.array().cast("array<long>")).alias("repeats"))


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without repeated passages; a text without one is unchanged.

    Of several texts of one id only the one that was compared is cut; equal rows are cut alike.
    """
    known, several = _one_text_each(docs)
    found = merged_passages(_passages(known, length, similarity)).select("doc_id", "spans")
    if several is not None:
        found = found.join(several, "doc_id", "left")
    else:
        found = found.withColumn("_known", F.lit(None).cast("long"))
    found = written(found, "passages")
    columns = docs.columns
    hidden = [c if c in ("doc_id", "text") else f"_c{k}" for k, c in enumerate(columns)]  # no clash with spans
    kept = [c for c in hidden if c != "text"]
    met = zipped(docs.toDF(*hidden).withColumn("_h", F.xxhash64("text")), [*kept, "_h"]).join(found.hint("merge"), "doc_id", "left")
    met = met.select(*kept, "_z", F.when(F.col("_known").isNull() | (F.col("_known") == F.col("_h")), F.col("spans")).alias("spans"))

    def run(batches):
        for b in pieces(batches, "_z", 1 << 20):
            texts = []
            for z, spans in zip(unzip(b.column("_z").to_pylist()), b.column("spans").to_pylist()):
                t = None if z is None else z.decode()
                if t and spans:
                    n = len(words(t))
                    t = cut_spans(t, [(s["first"], min(s["last"], n - 1)) for s in spans if s["first"] < n])
                texts.append(t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in hidden], names=columns)

    return met.mapInArrow(run, docs.schema)
