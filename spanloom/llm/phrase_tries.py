"""Phrase collocation mining with double-array tries of candidates.

Texts are cut into words once and written as word numbers with a small dictionary for each
part of a few megabytes.  Words that are frequent enough, then pairs of such words, then
windows both of whose parts were frequent, are summed by 64-bit keys; a sum can only be
too high where keys collide, so no frequent phrase is lost (Apriori).  What passes is a
candidate.  Between levels only a bitmap of fixed size is broadcast, with a bit for each
frequent key; a bit set by chance lets a window through to its sum and does no harm.

Candidates are dealt to blocks of about ``BLOCK``, and the windows of the text that pass the
bitmaps go where their candidate would be, packed and summed for some megabytes of text.
Each block has one trie, with language as the first step: two arrays, so a task advances
all windows at once, one word further a level, and adds up their counts in accepting
states.  These counts are exact, by words and not by keys, and all that the report is made
of.  More candidates mean more blocks; the text is passed over once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, written

LEAST = 30
LONGEST = 4
TOP = 2000
PERCENT = 80  # a phrase goes if one around it has this share of its count
SCALE = 2_000_000
PART_BYTES = 4 << 20
BITS = 1 << 25  # of the bitmap between levels: 4 MB
BLOCK = 20_000  # phrases of one trie
BUFFER = 2_000_000  # windows that a task holds before it sends their counts

# What ends a piece, and lower case of A to Z.  '.' stands for any end.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz.........")
_UPPER = np.uint64(0xFFFFFFFF00000000)
_PART = "lang string, words array<string>, counts array<long>, codes binary"


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(27))


def _parts(texts: list[bytes | None]):
    """Texts joined and cut at ends of pieces, about ``PART_BYTES`` each, however long a text is."""
    whole = b".".join(t for t in texts if t).translate(_TABLE)
    at = 0
    while at < len(whole):
        end = whole.find(b".", at + PART_BYTES)
        end = len(whole) if end < 0 else end
        yield whole[at:end]
        at = end + 1


def _encoded(batches):
    """Parts of one language: distinct words ('.' first), their counts, and the text as word numbers."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for b in pieces(batches, "text", PART_BYTES):
        langs, texts = b.column("lang"), b.column("text").cast(pa.binary())
        for lang in pc.unique(langs).to_pylist():
            for part in _parts(texts.filter(pc.equal(langs, lang)).to_pylist()):
                said = part.replace(b".", b" . ").split()
                said.append(b".")
                number = {w: k for k, w in enumerate(dict.fromkeys([b".", *said]))}
                codes = np.fromiter(map(number.__getitem__, said), np.uint32, len(said))
                counts = np.bincount(codes, minlength=len(number))
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang]), pa.array([list(number)], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                    pa.array([counts], pa.list_(pa.int64())), pa.array([pack(codes.tobytes())], pa.binary())],
                    names=["lang", "words", "counts", "codes"])


def encode(docs: DataFrame) -> DataFrame:
    """Parts (lang, words, counts, codes) of docs (lang, text), written to the shared folder."""
    cut = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text <> ''")
    return written(cut.mapInArrow(_encoded, _PART), "parts")


def _codes(z: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint32)


def _one_by_one(batches):
    """Parts as (lang, words, codes), their words in Python one part at a time."""
    for b in batches:
        for k in range(b.num_rows):
            yield tuple(b.column(c)[k].as_py() for c in ("lang", "words", "codes"))
        pa.default_memory_pool().release_unused()  # a worker lives on between tasks


def _low(column: str) -> Column:
    return F.col(column).bitwiseAND(F.lit(0xFFFFFFFF))


def _word_keys(lang: str, words: list[str]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang)
    return np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words], np.uint64)


def _held(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys & np.uint64(BITS - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _pairs(keys: np.ndarray) -> np.ndarray:
    """Of each place and the next, the upper halves of their keys side by side."""
    return (keys[:-1] & _UPPER) | (keys[1:] >> np.uint64(32))


def _windows(batches, sieves):
    """Counts (pair, n) of windows one word longer than the last sieve's, both of whose parts are frequent.

    A window is known by 32 bits of either part.  Parts that share them only make the sums
    too high and bring in phrases that the tries count as they are.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush():
        pair, n = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.argsort(pair)
        pair, n = pair[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        return pa.RecordBatch.from_arrays(
            [pa.array(pair[first].view(np.int64)), pa.array(np.add.reduceat(n, first).astype(np.int64))], names=["pair", "n"])

    bits = [np.frombuffer(s.value, np.uint8) for s in sieves]
    for lang, words, z in _one_by_one(batches):
        codes = _codes(z)
        own = _word_keys(lang, words)
        good = _held(bits[0], own)
        good[0] = False  # the end of a piece
        at = np.flatnonzero(good[codes])
        keys = own[codes]
        for level in bits[1:]:
            at = at[:-1][np.diff(at) == 1]  # the next place starts a frequent phrase too
            keys = _mix(_pairs(keys))
            at = at[_held(level, keys[at])]
        at = at[:-1][np.diff(at) == 1]
        if not len(at):
            continue
        pair, n = np.unique((keys[at] & _UPPER) | (keys[at + 1] >> np.uint64(32)), return_counts=True)
        held.append((pair, n.astype(np.int32)))
        size += len(pair)
        if size >= BUFFER:
            yield flush()
            size = 0
    if held:
        yield flush()


def _bitmap(keys: DataFrame):
    """A broadcast bitmap with the bit of each ``key`` set, joined from slices of 4 KB."""
    spark = keys.sparkSession

    def pack(group):
        at = group.column("place").to_numpy() & 32767
        one = np.zeros(32768, np.uint8)
        one[at] = 1
        return pa.table({"slice": [int(group.column("slice")[0].as_py())], "bits": [np.packbits(one, bitorder="little").tobytes()]})

    place = F.col("key").bitwiseAND(F.lit(BITS - 1)).alias("place")
    slices = keys.select(place).distinct().select("place", F.shiftright("place", 15).alias("slice"))
    out = bytearray(BITS >> 3)
    for r in slices.groupBy("slice").applyInArrow(pack, "slice long, bits binary").toLocalIterator():
        out[r["slice"] << 12:(r["slice"] + 1) << 12] = r["bits"]
    return spark.sparkContext.broadcast(bytes(out))


def _keyed(rows: DataFrame) -> DataFrame:
    """Add ``key`` of the window ``pair``, as ``_windows`` has it on the next level."""
    def run(batches):
        for b in batches:
            yield b.append_column("key", pa.array(_mix(b.column("pair").to_numpy().view(np.uint64)).view(np.int64)))

    return rows.mapInArrow(run, "pair long, key long")


def word_counts(parts: DataFrame) -> DataFrame:
    """Rows (lang, word, n) of all words."""
    tall = parts.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x"))
    return tall.where("x.words <> '.'").groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("n"))


def candidates(parts: DataFrame, words: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, list]:
    """Rows (lang, words, key) of phrases of 2 to ``longest`` words whose sums by key reach ``least``, and their sieves by length from 1."""
    def run(batches):
        for b in batches:
            langs, said = b.column("lang").to_pylist(), b.column("word").to_pylist()
            keys = np.array([xxhash.xxh3_64_intdigest(w, xxhash.xxh3_64_intdigest(g)) for g, w in zip(langs, said)], np.uint64)
            yield b.append_column("key", pa.array(keys.view(np.int64)))

    level = words.where(F.col("n") >= least).select("lang", "word").mapInArrow(run, "lang string, word string, key long")
    level = written(level.select("key", "lang", F.array("word").alias("words")), "level1")
    found, sieves = None, []
    for k in range(2, longest + 1):
        sieves.append(_bitmap(level))
        seen = list(sieves)
        sums = parts.select("lang", "words", "codes").mapInArrow(
            lambda batches, seen=seen: _windows(batches, seen), "pair long, n long")
        frequent = _keyed(sums.groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("pair"))
        frequent = frequent.select("key", F.shiftrightunsigned("pair", 32).alias("head"), _low("pair").alias("tail"))
        part = F.shiftrightunsigned("key", 32)
        head = level.select(part.alias("head"), "lang", "words")
        # the tail goes on where the head's words after the first end
        tail = level.select(part.alias("tail"), F.col("lang").alias("_lang"), F.col("words").alias("_words"))
        met = frequent.join(head.hint("merge"), "head").join(tail.hint("merge"), "tail").where(
            f"lang = _lang and slice(words, 2, {k}) = slice(_words, 1, {k - 2})")
        level = written(met.select("key", "lang", F.concat("words", F.array(F.element_at("_words", -1))).alias("words")), f"level{k}")
        found = level if found is None else found.union(level)
    sieves.append(_bitmap(level))
    return found.select("lang", "words", "key"), sieves


class Trie:
    """Double-array trie: the child of state s by symbol c is t = base[s] + c if check[t] is s.

    ``rows`` are symbol numbers (from 1) in columns, 0 after the end; row k is accepted in
    the state whose ``accept`` is k.  States of many children are placed first; those with
    one child fill what is left.
    """

    def __init__(self, rows: np.ndarray, symbols: int):
        order = np.lexsort(rows.T[::-1])
        rows = rows[order]
        n, depth = rows.shape
        room = symbols + 2  # no state lies below, so no base is negative
        self.base = np.zeros(room + 2 * n + symbols, np.int32)
        self.check = np.full(len(self.base), -1, np.int32)
        self.used = np.zeros(len(self.base), bool)
        self.used[:room] = True
        self.low = room
        state = np.zeros(n, np.int64)  # of each row at the depth reached
        changed = np.zeros(n, bool)
        changed[:1] = True
        ends = np.zeros(n, np.int64)
        for d in range(depth):
            live = rows[:, d] > 0
            changed[1:] |= rows[1:, d] != rows[:-1, d]
            opens = np.flatnonzero(changed & live)
            if not len(opens):
                break
            parent, code = state[opens], rows[opens, d].astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
            stops = np.append(starts[1:], len(opens))
            place = np.zeros(len(opens), np.int64)
            many = np.flatnonzero(stops - starts > 1)
            for g in many[np.argsort(starts[many] - stops[many], kind="stable")].tolist():
                kids = code[starts[g]:stops[g]]
                place[starts[g]:stops[g]] = self._fit(parent[starts[g]], kids)
            one = starts[stops - starts == 1]
            place[one] = self._fill(parent[one], code[one])
            state = np.where(live, place[np.maximum(np.cumsum(changed & live) - 1, 0)], state)
            ends = np.where(live, state, ends)
        top = int(np.flatnonzero(self.used)[-1]) + 1 + symbols
        self._grow(top)
        self.base, self.check = self.base[:top], self.check[:top]
        self.accept = np.full(top, -1, np.int32)
        self.accept[ends] = order
        del self.used

    def _grow(self, size: int) -> None:
        more = size - len(self.used)
        if more > 0:
            more = max(more, len(self.used) // 2)
            self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])
            self.used = np.concatenate([self.used, np.zeros(more, bool)])

    def _fit(self, parent: int, kids: np.ndarray) -> np.ndarray:
        """Place children that share a base: the first one that leaves all their places free."""
        at, span = self.low, int(kids[-1])
        while True:
            self._grow(at + 4096 + span + 1)
            start = at + np.flatnonzero(~self.used[at:at + 4096]) - kids[0]
            for c in kids[1:].tolist():
                start = start[~self.used[start + c]]
                if not len(start):
                    break
            if len(start):
                break
            if self.used[self.low:at + 4096].all():
                self.low = at + 4096
            at += 4096
        t = start[0] + kids
        self.base[parent], self.check[t], self.used[t] = start[0], parent, True
        return t

    def _fill(self, parent: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Place only children in the first free places."""
        self._grow(self.low + len(code) + int(self.used[self.low:].sum()) + 1)
        t = self.low + np.flatnonzero(~self.used[self.low:])[:len(code)]
        self.base[parent], self.check[t], self.used[t] = t - code, parent, True
        return t

    def count(self, start: int, codes: np.ndarray, longest: int, out: np.ndarray) -> None:
        """Advance all places of ``codes`` (0: no symbol) from state ``start`` together, add accepted rows to ``out``."""
        at = np.flatnonzero(codes)
        state = np.full(len(at), start, np.int64)
        for k in range(longest):
            inside = at + k < len(codes)
            at, state = at[inside], state[inside]
            t = self.base[state] + codes[at + k]
            good = self.check[t] == state
            at, state = at[good], t[good]
            if not len(at):
                return
            hit = self.accept[state]
            out += np.bincount(hit[hit >= 0], minlength=len(out))

    def follow(self, start: int, columns: np.ndarray, n: np.ndarray, out: np.ndarray) -> None:
        """Advance whole windows (a row a place, 0 after the end, -1: no symbol) together, add ``n`` to accepted rows of ``out``."""
        state, good = np.full(len(n), start, np.int64), np.ones(len(n), bool)
        for codes in columns:
            good &= codes >= 0
            t = self.base[state] + np.maximum(codes, 0)
            good &= (codes == 0) | (self.check[t] == state)
            state = np.where(good & (codes > 0), t, state)
        hit = self.accept[state]
        good &= hit >= 0
        np.add.at(out, hit[good], n[good])


def _trie(rows: pa.Table) -> tuple[Trie, pa.Array, int]:
    """The trie of phrases (lang, words) and its symbols in order: words, and languages after a line feed."""
    n = rows.num_rows
    said = rows.column("words").combine_chunks()
    longest = pc.list_value_length(said).to_numpy()
    langs = pc.binary_join_element_wise("\n", rows.column("lang").combine_chunks().cast(pa.string()), "")
    both = pa.concat_arrays([langs, said.flatten().cast(pa.string())]).dictionary_encode()
    codes = both.indices.to_numpy() + 1
    table = np.zeros((n, 1 + int(longest.max())), np.int32)
    table[:, 0] = codes[:n]
    first = np.cumsum(longest) - longest
    table[np.repeat(np.arange(n), longest), 1 + np.arange(len(codes) - n) - np.repeat(first, longest)] = codes[n:]
    return Trie(table, len(both.dictionary)), both.dictionary, int(longest.max())


def _dealt(batches, sieves, blocks: int):
    """Windows of 2 words or more that pass the sieves, each sent to the block of its key.

    Rows (block, lang, words, windows, wide): windows as numbers of ``words`` from 1, ``wide``
    columns (0 after the end) and a last one for their count.  Windows are told apart by
    their words; keys only say which block a window goes to.
    """
    pack = zstandard.ZstdCompressor(level=1).compress
    bits = [np.frombuffer(s.value, np.uint8) for s in sieves]
    held: dict[str, tuple[dict, list]] = {}
    size = 0

    def flush(lang, number, found):
        rows, n, block = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((*rows.T[::-1], block))
        rows, n, block = rows[order], n[order], block[order]
        new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1) | (block[1:] != block[:-1])])
        first = np.flatnonzero(new)
        rows, n, block = rows[first], np.add.reduceat(n, first), block[first]
        edge = np.append(np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])), len(block))
        used, packed = [], []
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
            own = np.unique(rows[s:e])
            own = own[own > 0]
            local = np.searchsorted(own, rows[s:e], "right")  # 0 stays 0
            used.append(own - 1)
            packed.append(pack(np.vstack([local.T, n[s:e]]).astype(np.uint32).tobytes()))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in used])]).astype(np.int32)
        words = pa.ListArray.from_arrays(pa.array(offsets), pa.array(list(number), pa.string()).take(pa.array(np.concatenate(used))))
        return pa.RecordBatch.from_arrays(
            [pa.array(block[edge[:-1]]), pa.array([lang] * len(packed)), words, pa.array(packed, pa.binary()), pa.array([len(bits)] * len(packed))],
            names=["block", "lang", "words", "windows", "wide"])

    for lang, words, z in _one_by_one(batches):
        codes = _codes(z)
        keys = _word_keys(lang, words)
        good = _held(bits[0], keys)
        good[0] = False  # the end of a piece
        number, found = held.setdefault(lang, ({}, []))
        rows = np.zeros((len(words), 1), np.uint32)
        known = np.flatnonzero(good)
        rows[known, 0] = [number.setdefault(words[w], len(number) + 1) for w in known.tolist()]
        at = np.flatnonzero(good[codes])
        here = codes[at].astype(np.uint64)  # the word or window at a place, as a row of ``rows`` and ``keys``
        for level in bits[1:]:
            next_to = np.flatnonzero(np.diff(at) == 1)  # the next place starts a frequent phrase too
            both, here, n = np.unique(
                here[next_to] << np.uint64(32) | here[next_to + 1], return_inverse=True, return_counts=True)
            head, tail = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
            keys = _mix((keys[head] & _UPPER) | (keys[tail] >> np.uint64(32)))
            rows = np.hstack([rows[head], rows[tail, -1:]])
            good = _held(level, keys)
            wide = np.zeros((int(good.sum()), len(bits)), np.uint32)
            wide[:, :rows.shape[1]] = rows[good]
            found.append((wide, n[good], keys[good].view(np.int64) % blocks))
            size += len(wide)
            keep = good[here]
            at, here = at[next_to[keep]], here[keep].astype(np.uint64)
        if size >= BUFFER // 4:  # they are wider here
            yield from (flush(lang, *x) for lang, x in held.items() if sum(len(f[0]) for f in x[1]))
            held.clear()
            size = 0
    yield from (flush(lang, *x) for lang, x in held.items() if sum(len(f[0]) for f in x[1]))


def _counted(phrases: pa.Table, windows: pa.Table) -> pa.Table:
    """Counts (lang, words, a) of the phrases of one block that its windows hold, by their trie."""
    out = np.zeros(phrases.num_rows, np.int64)
    if phrases.num_rows and windows.num_rows:
        trie, symbols, _ = _trie(phrases)
        number = {s: k for k, s in enumerate(symbols.to_pylist(), 1)}
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in windows.to_batches():
            for k, lang in enumerate(batch.column("lang").to_pylist()):
                first = number.get("\n" + lang)
                if first is None:
                    continue
                own = np.array([0, *(number.get(w, -1) for w in batch.column("words")[k].as_py())], np.int32)
                raw = np.frombuffer(open_(batch.column("windows")[k].as_py()), np.uint32).reshape(batch.column("wide")[k].as_py() + 1, -1)
                trie.follow(int(trie.base[0]) + first, own[raw[:-1]], raw[-1].astype(np.int64), out)
    met = np.flatnonzero(out)
    mine = phrases.select(["lang", "words"]).take(pa.array(met))
    return mine.append_column("a", pa.array(out[met]))


def count_phrases(parts: DataFrame, phrases: DataFrame, sieves: list, block: int = BLOCK) -> DataFrame:
    """Exact counts (lang, words, a) of phrases (lang, words, key) in ``parts``, in one pass over the text.

    Phrases are dealt by their keys to blocks of about ``block``, and the windows of the text
    that pass the sieves (of phrases of 1 word and more, by length) to the same blocks.
    """
    spark = parts.sparkSession
    blocks = max(-(-phrases.count() // block), int(spark.conf.get("spark.sql.shuffle.partitions")))
    windows = parts.select("lang", "words", "codes").mapInArrow(
        lambda batches: _dealt(batches, sieves, blocks), "block long, lang string, words array<string>, windows binary, wide long")
    mine = phrases.select(F.pmod("key", F.lit(blocks).cast("long")).alias("block"), "lang", "words")
    return mine.groupBy("block").cogroup(windows.groupBy("block")).applyInArrow(
        _counted, "lang string, words array<string>, a long")


def _said(words: Column) -> Column:
    return F.array_join(words, " ")


def rank_phrases(found: DataFrame, words: DataFrame, top: int = TOP, percent: int = PERCENT) -> DataFrame:
    """The best ``top`` phrases of each language by the score of their weakest cut.

    ``found`` (lang, words, a) are all phrases of two words or more that are frequent,
    ``words`` (lang, word, n) the counts of all words.
    """
    whole = found.select("lang", _said(F.col("words")).alias("phrase"), "words", "a")
    counts = whole.select("lang", "phrase", "a").union(words.select("lang", "word", "n"))
    cuts = whole.select("lang", "phrase", "words", "a", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _said(F.slice("words", F.lit(1), F.col("k"))).alias("head"),
                       _said(F.expr("slice(words, k + 1, size(words) - k)")).alias("tail"))
    # Rows after an explode count as before it in Spark's estimate: unasked it may broadcast them.
    cuts = cuts.hint("merge").join(counts.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["head", "lang"])
    cuts = cuts.hint("merge").join(counts.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r")), ["tail", "lang"])
    score = F.expr(f"cast({SCALE} as decimal(10, 0)) * cast(a as decimal(20, 0)) div (l + r)").cast("long")
    scored = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy(
        "lang", "phrase").agg(F.max("a").alias("a"), F.min("cut").alias("cut"))

    inner = whole.where(F.size("words") > 2).select("lang", "words", "a", F.explode(F.expr("""
        flatten(transform(sequence(2, size(words) - 1), n -> transform(sequence(1, size(words) - n + 1), i -> slice(words, i, n))))
        """)).alias("part"))
    around = inner.groupBy("lang", _said(F.col("part")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = scored.join(around.hint("merge"), ["phrase", "lang"], "left").where(
        F.expr(f"longer is null or cast(100 as decimal(20, 0)) * longer < cast({percent} as decimal(20, 0)) * a"))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine_phrases(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """Collocations of docs (lang, text): lang, rank, phrase, a, l, r, n, score.

    Null language counts as "und"; null and empty texts have no words; repeated rows count
    as often as they stand there; an empty table gives no row.  A text of any length is cut
    at ends of pieces; only a piece of many megabytes without any end is held as one.
    """
    parts = encode(docs)
    words = written(word_counts(parts), "words")
    found = count_phrases(parts, *candidates(parts, words, least, longest), block).where(F.col("a") >= least)
    return rank_phrases(written(found, "frequent"), words, top)
