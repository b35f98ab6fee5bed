"""Benchmark decontamination with one FM-index per training shard.

A shard is a run of documents of a few megabytes inside one task, so no text is shuffled.
Its words become numbers of the test vocabulary; a word outside it can be in no test
phrase and is a break, as is the end of a document.  Runs of known words shorter than
the shortest phrase are left out of the index for the same reason.  Over what is left
stand a suffix array, its BWT in a wavelet matrix, and the suffix positions of every
16th word and of each run's first.  All phrases are searched backward at once, their
rows are walked to the next sampled position, and the words hit are merged to spans.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

WINDOW = 10
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 4 << 20
SAMPLE = 16
# A-Z fold to a-z; every other ASCII character that is no digit or small letter parts words.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class Phrases:
    """Distinct windows of test items as rows of word numbers, and the items of each."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        seen: dict[tuple[int, ...], list[str]] = {}
        for item, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text))
            size = min(window, len(ids))
            for k in range(len(ids) - size + 1) if size else ():
                seen.setdefault(ids[k:k + size], []).append(str(item))
        self.items = [sorted(set(v)) for v in seen.values()]
        self.sizes = np.array([len(k) for k in seen], np.int64)
        self.ids = np.zeros((len(seen), window), np.int64)  # aligned to the right
        for row, key in zip(self.ids, seen):
            row[window - len(key):] = key
        self.shortest = int(self.sizes.min()) if len(seen) else 0


class FMIndex:
    """Index of word numbers (1 or more) in which 0 marks a break; the last entry is a break."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        n = len(symbols)
        breaks = symbols == 0
        # breaks differ from each other, so that no comparison passes one
        rank = np.where(breaks, np.cumsum(breaks) - 1, symbols + int(breaks.sum()))
        order = np.argsort(rank, kind="stable")
        step = 1
        while True:
            key = rank[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            if n < 2 or rank[order[-1]] == n - 1:
                break
            follow = np.zeros(n, np.int64)
            follow[:-step] = rank[step:] + 1
            rank = rank * (n + 1) + follow
            order = np.argsort(rank, kind="stable")
            step *= 2
        bwt = symbols[order - 1]
        counts = np.bincount(symbols)
        self.first = np.concatenate([[0], np.cumsum(counts)])  # rows before each symbol
        self.bwt = bwt
        self.levels = []
        level = bwt
        for shift in range(int(len(counts) - 1).bit_length() - 1, -1, -1):
            bit = (level >> shift) & 1
            ones = np.concatenate([[0], np.cumsum(bit)])
            self.levels.append((shift, ones, n - int(ones[-1])))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        self.base = self._descend(np.arange(len(counts)), np.zeros(len(counts), np.int64))
        kept = (order % sample == 0) | (symbols[order - 1] == 0)
        self.kept, self.kept_rank, self.places = kept, np.cumsum(kept) - 1, order[kept]

    def _descend(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        for shift, ones, zeros in self.levels:
            up = ones[row]
            row = np.where((symbol >> shift) & 1, zeros + up, row - up)
        return row

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """First row of ``symbol`` plus its occurrences in the BWT before ``row``."""
        return self.first[symbol] + self._descend(symbol, row) - self.base[symbol]

    def search(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that open with each phrase (aligned to the right)."""
        low, high = np.zeros(len(ids), np.int64), np.full(len(ids), len(self.bwt), np.int64)
        width = ids.shape[1]
        for k in range(width):
            live = np.flatnonzero((sizes > k) & (high > low))
            symbol = ids[live, width - 1 - k]
            known = symbol < len(self.first) - 1
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known]
            low[live], high[live] = self.step(symbol, low[live]), self.step(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row, by walking back to a sampled position."""
        out = np.empty(len(rows), np.int64)
        at, steps = np.arange(len(rows)), 0
        while len(at):
            done = self.kept[rows]
            out[at[done]] = self.places[self.kept_rank[rows[done]]] + steps
            at, rows = at[~done], rows[~done]
            rows, steps = self.step(self.bwt[rows], rows), steps + 1
        return out


def occurrences(docs: list[list[bytes]], phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, position in the joined words of ``docs``) of all occurrences."""
    none = np.zeros(0, np.int64)
    get = phrases.vocabulary.get
    ids = np.fromiter((i for d in docs for i in (*[get(w, 0) for w in d], 0)), np.int64)
    if not phrases.shortest or not len(ids):
        return none, none
    place = np.arange(len(ids)) - np.repeat(np.arange(len(docs)), [len(d) + 1 for d in docs])
    # keep each run of known words that is long enough, and the break behind it
    ends = np.flatnonzero(ids == 0)
    size = np.diff(ends, prepend=-1)
    kept = np.repeat(size > phrases.shortest, size)
    ids, place = ids[kept], place[kept]
    if not len(ids):
        return none, none
    index = FMIndex(ids)
    low, high = index.search(phrases.ids, phrases.sizes)
    counts = high - low
    which = np.repeat(np.arange(len(low)), counts)
    rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + low[which]
    return which, place[index.locate(rows)]


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of each span [first, last], nor what stands between them."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    out, at = [], 0
    for a, z in spans:
        out.append(raw[at:places[a][0]])
        at = places[z][1]
    return b"".join([*out, raw[at:]]).decode()


_FOUND = "n_words long, spans array<struct<first: long, last: long>>, items array<string>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def find_phrases(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, columns: list[str] | None = None, cut: bool = False,
) -> DataFrame:
    """``columns`` (all of them where not given) of ``docs`` (with ``text``), and n_words, spans (merged word ranges that
    lie in a test phrase) and items (sorted ids, as strings, of the items met).

    Items (item_id, text) are taken in blocks of about BLOCK_BYTES of text by a hash of
    their id; all documents pass every block, without a shuffle.  A null text has no words.
    Own columns of these names are replaced; repeated rows are treated each.  With ``cut``
    the spans are taken out of ``text``.
    """
    docs = docs.drop("n_words", "spans", "items")
    spark = docs.sparkSession
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    found = docs
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        phrases = spark.sparkContext.broadcast(Phrases([tuple(r) for r in mine.select("item_id", "text").collect()], window))

        last = block == blocks - 1
        keep = columns if columns and last else docs.columns

        def run(batches, phrases=phrases, later=block > 0, keep=keep, cut=cut and last):
            phrases = phrases.value
            for b in pieces(batches, "text", SHARD_BYTES):
                split = [words(t) for t in b.column("text").to_pylist()]
                starts = np.concatenate([[0], np.cumsum([len(w) for w in split])])
                which, at = occurrences(split, phrases)
                spans: list[list] = [[] for _ in split]
                met: list[set] = [set() for _ in split]
                owner = np.searchsorted(starts, at, side="right") - 1
                at = at - starts[owner]
                for d, p, k, n in zip(owner.tolist(), which.tolist(), at.tolist(), phrases.sizes[which].tolist()):
                    spans[d].append((k, k + n - 1))
                    met[d].update(phrases.items[p])
                if later:
                    for k, (s, i) in enumerate(zip(b.column("spans").to_pylist(), b.column("items").to_pylist())):
                        spans[k] += [(x["first"], x["last"]) for x in s]
                        met[k].update(i)
                spans = [_merge(s) for s in spans]
                cols = {c: b.column(c) for c in keep}
                if cut:
                    texts = [cut_spans(t, s) if s else t for t, s in zip(b.column("text").to_pylist(), spans)]
                    cols["text"] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([
                    *cols.values(), pa.array(np.diff(starts)),
                    pa.array([[{"first": a, "last": z} for a, z in s] for s in spans], _SPANS),
                    pa.array([sorted(m) for m in met], pa.list_(pa.string())),
                ], names=[*keep, "n_words", "spans", "items"])

        names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
        found = found.mapInArrow(run, f"{names}, {_FOUND}")
    return found


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of :func:`find_phrases`."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def remove_phrases(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the merged spans cut out of ``text``; clean texts are unchanged."""
    columns = docs.columns
    hidden = [c if c == "text" else f"_c{k}" for k, c in enumerate(columns)]  # no clash with spans and items
    return find_phrases(docs.toDF(*hidden), items, window, cut=True).select(*hidden).toDF(*columns)
