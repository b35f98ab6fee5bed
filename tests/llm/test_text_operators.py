"""Decontamination, substring dedup, fingerprints, SimHash, language, toxicity, scores, preferences."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from spanloom.llm import (
    backoff, classifier_chain, compact_windows, fm_index, preferences, queries, rare_features, simhash, zstd_language,
)
from spanloom.llm.common import components, ready
from spanloom.llm.fm_index import words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- decontamination ---------------------------------------------------------------------------------------------


def plain_hits(docs, items, window=10):
    phrases = {}
    for i, t in items:
        w = WORD.findall(fold(t))
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            phrases.setdefault(tuple(w[k:k + n]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w = WORD.findall(fold(t))
        hit, met = set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                found = phrases.get(tuple(w[k:k + n]))
                if found:
                    hit.update(range(k, k + n))
                    met |= found
        sha = hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()
        out[d] = (len(w), len(hit), len(met), sha, bool(hit))
    return out


ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Word"), (3, ""), (4, None),
    (5, "the dog that ran"), (6, "one two three four five six seven eight nine ten"), (6, "cat sat"), (7, "!!!"),
]


def test_words_follow_the_pattern():
    for t in ("Über-Größe x_y 3.5 ÀB\x85c\xa0d", "a\x00b", "日本 語", ""):
        assert [w.decode() for w in words(t)] == WORD.findall(fold(t))


@pytest.mark.parametrize("block_bytes", [1 << 20, 30])
def test_phrases_in_awkward_documents(spark, awkward, nothing, monkeypatch, block_bytes):
    ready(spark)
    monkeypatch.setattr(fm_index, "BLOCK_BYTES", block_bytes)  # 30: several blocks of items
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    more = spark.createDataFrame(
        [(100, "x ONE two, three four five six seven eight nine ten eleven twelve z"), (101, "one two three " * 9),
         (102, "one two three four five six seven eight nine ten " * 50)], "doc_id long, text string")
    docs = awkward.select("doc_id", "text").where("doc_id is not null and doc_id <> 3").union(more)
    want = plain_hits([tuple(r) for r in docs.collect()], ITEMS)
    got = fm_index.report(fm_index.find_phrases(docs, items, columns=["doc_id"])).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == want
    assert fm_index.find_phrases(nothing, items).count() == 0
    none = fm_index.report(fm_index.find_phrases(docs, items.limit(0))).collect()
    assert not any(r["contaminated"] for r in none) and len(none) == len(got)
    cut = {r["doc_id"]: r["text"] for r in fm_index.remove_phrases(docs, items).collect()}
    assert cut[100] == "x  z" and cut[5] == dict(docs.collect())[5] and cut[2] is None and cut[101].split() == ["one", "two", "three"] * 9
    assert fm_index.remove_phrases(awkward, items).columns == awkward.columns
    assert fm_index.remove_phrases(awkward, items).count() == awkward.count()


def test_fm_index_finds_what_a_scan_finds():
    rng = np.random.default_rng(5)
    text = rng.integers(0, 4, 600)
    text[-1] = 0
    index = fm_index.FMIndex(text.astype(np.int64))
    phrases = np.array([[0, *rng.integers(1, 6, 2)] for _ in range(40)] + [list(rng.integers(1, 4, 3)) for _ in range(40)])
    sizes = np.array([2] * 40 + [3] * 40)
    low, high = index.search(phrases, sizes)
    for p, n, a, z in zip(phrases, sizes, low, high):
        found = sorted(index.locate(np.arange(a, z)).tolist())
        assert found == [k for k in range(len(text) - n + 1) if (text[k:k + n] == p[3 - n:]).all()]


# --- substring dedup ---------------------------------------------------------------------------------------------


def random_words(rng, n):
    return ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n)]


def test_passages_that_repeat_are_cut_and_first_holders_kept(spark, awkward, nothing):
    ready(spark)
    rng = np.random.default_rng(3)
    passage, long_one, short = random_words(rng, 50), random_words(rng, 180), random_words(rng, 30)
    edited = list(long_one)
    edited[90] = "changed"
    rows = []
    for k in range(60):
        own = random_words(rng, 120)
        if k % 2:
            own[60:60] = passage
        if k in (10, 30):
            own[20:20] = long_one
        if k == 40:
            own[20:20] = edited
        own[5:5] = short  # a line of 30 words that all share is no passage
        rows.append((1000 + k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: r for r in compact_windows.report(docs).collect()}
    text = dict(rows)

    def covered(i):
        out = set()
        for s in got[i]["spans"].split():
            a, z = map(int, s.split("-"))
            out |= set(range(a, z + 1))
        w = text[i].split()
        return [w[k] for k in sorted(out)]

    for k in range(60):
        i = 1000 + k
        cut = covered(i)
        if k in (30, 40):
            assert len(set(long_one) & set(cut)) >= 170 and 1010 in got[i]["repeats"]
        elif k % 2 and k > 1:
            assert set(passage) <= set(cut) and len(cut) <= 60
        else:
            assert not cut
    left = {r["doc_id"]: r["text"] for r in compact_windows.remove_repeats(docs).collect()}
    assert left[1001] == text[1001] and " ".join(passage) not in left[1003]
    assert sum(" ".join(passage) in t for t in left.values()) == 1
    kept = compact_windows.remove_repeats(awkward)
    assert kept.columns == awkward.columns
    key = lambda r: (str(r["doc_id"]), str(r["text"]))
    assert sorted(kept.collect(), key=key) == sorted(awkward.collect(), key=key)  # nothing of 50 words repeats
    assert compact_windows.report(nothing).count() == 0 and compact_windows.remove_repeats(nothing).count() == 0


def test_compact_windows_part_all_subsequences():
    rng = np.random.default_rng(9)
    for values in (rng.integers(0, 1 << 60, 80), rng.integers(0, 4, 80), np.zeros(80, np.int64)):
        found = compact_windows.compact_windows(values.astype(np.uint64), 5)
        for i in range(80):
            for j in range(i + 4, 80):
                owners = [(a, c, z) for a, c, z in found if a <= i <= c <= j <= z]
                assert len(owners) == 1 and values[owners[0][1]] == values[i:j + 1].min()


def test_centres_are_those_of_the_tree():
    rng = np.random.default_rng(10)
    for n in (0, 4, 5, 6, 80, 333):
        values = rng.permutation(n).astype(np.uint64)
        owner = {i: c for a, c, z in compact_windows.compact_windows(values, 5) for i in range(max(a, c - 4), min(c, z - 4) + 1)}
        assert compact_windows.window_centres(values, 5).tolist() == [owner[i] for i in range(max(n - 4, 0))]
    same = np.zeros(50, np.uint64)
    assert compact_windows.window_centres(same, 7).tolist() == list(range(44))


def test_exact_repeats_of_the_driver_tables_are_found(spark, sf, small):
    first, need, total = {}, 0, 0
    w = {i: words(t) for i, t in small.items()}
    got = {r["doc_id"]: r["spans"] for r in queries.QUERIES["op4_compact_windows"](spark, sf).collect()}
    for i in sorted(w):
        mine = np.zeros(len(w[i]), bool)
        for k in range(len(w[i]) - 49):
            if first.setdefault(tuple(w[i][k:k + 50]), i) < i:
                mine[k:k + 50] = True
        for s in got[i].split():
            a, z = map(int, s.split("-"))
            need -= int(mine[a:z + 1].sum())
        need += int(mine.sum())
        total += int(mine.sum())
    assert need <= 0.02 * total


def recall_of_near_windows(docs, spans):
    """Share of the words in windows that are like one of an earlier document which lie in spans; and their number."""
    h = {i: compact_windows.shingles([words(t)])[0] for i, t in sorted(docs.items())}
    holders, need, got = {}, 0, 0
    for i, x in h.items():
        near = set()
        for v in set(x.tolist()):
            near.update(holders.get(v, ()))
            holders.setdefault(v, []).append(i)
        wanted, found = np.zeros(len(x) + 4, bool), np.zeros(len(x) + 4, bool)
        for j in near:
            for k in np.flatnonzero(compact_windows.matching_windows(x, h[j], 46, 0.8)).tolist():
                wanted[k:k + 50] = True
        for s in spans[i].split():
            a, z = map(int, s.split("-"))
            found[a:z + 1] = True
        need += int(wanted.sum())
        got += int((wanted & found).sum())
    return got / max(need, 1), need


def test_near_windows_of_the_driver_tables_are_found(spark, sf, small):
    got = {r["doc_id"]: r["spans"] for r in queries.QUERIES["op4_compact_windows"](spark, sf).collect()}
    share, need = recall_of_near_windows(small, got)
    assert need > 1000 and share >= 0.98


def test_rows_of_one_id(spark):
    """Equal rows count once; of several texts of an id the smallest is compared and cut, the others stay."""
    ready(spark)
    one, two = (" ".join(f"{c}{k}" for k in range(70)) for c in "ab")
    rows = [(1, one), (1, one), (2, two), (3, one + " " + two), (3, one + " " + two), (5, "z " + two), (5, two)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["spans"]) for r in compact_windows.report(docs).collect()}
    assert got == {(1, ""), (2, ""), (3, "0-139"), (5, "0-69")}
    left = sorted((r["doc_id"], r["text"].strip()) for r in compact_windows.remove_repeats(docs).collect())
    assert left == [(1, one), (1, one), (2, two), (3, ""), (3, ""), (5, ""), (5, "z " + two)]


def plain_windows(b, a, least):
    """Windows of b that have one of a at Jaccard 0.8 or more."""
    theirs = [set(a[k:k + least].tolist()) for k in range(len(a) - least + 1)]
    mine = [set(b[k:k + least].tolist()) for k in range(len(b) - least + 1)]
    return np.array([any(5 * len(m & t) >= 4 * len(m | t) for t in theirs) for m in mine], bool)


def edited_copies(rng, n):
    """Pairs of word lists: regular and random edits, large and small vocabularies."""
    for trial in range(n):
        w = [b"%d" % x for x in rng.integers(0, (10 ** 6, 60, 5)[trial % 3], 200)]
        v = list(w)
        if trial % 2:
            for k in range(7, 200, 30 + trial % 11):
                v[k] = b"new%d" % k
        else:
            for k in sorted(rng.choice(200, int(rng.integers(2, 11)), replace=False).tolist(), reverse=True):
                v[k:k + 1] = [[b"new%d" % k], [b"new", v[k]], []][int(rng.integers(3))]
        yield w, [b"own%d" % k for k in range(trial)] + v


def test_every_window_that_is_alike_is_matched():
    for w, v in edited_copies(np.random.default_rng(21), 24):
        b, a = (compact_windows.shingles([x])[0] for x in (w, v))
        need, got = plain_windows(b, a, 46), np.zeros(len(b), bool)
        assert (compact_windows.matching_windows(b, a, 46, 0.8) == need).all()
        for s, e in compact_windows.matching_stretches(b, a, 46, 0.8):
            got[s:e] = True
        assert all(got[i:i + 46].all() for i in np.flatnonzero(need))


def test_near_passages_have_a_signature_in_common():
    rng = np.random.default_rng(4)
    some = lambda n: [b"%d" % x for x in rng.integers(0, 10 ** 8, n)]
    for trial in range(400):
        w = some(50)
        v, k = list(w), int(rng.integers(50))
        v[k:k + 1] = [[b"new"], [b"new", v[k]], []][trial % 3]
        texts = [some(70) + w + some(90), some(30) + v + some(60)]
        h, starts = compact_windows.shingles(texts)
        key, doc, at = compact_windows.signature_cells(h, starts, 46)
        near = plain_windows(*(h[starts[i]:starts[i + 1]] for i in (0, 1)), 46) if trial < 20 else [True]
        assert any(near) and len(np.intersect1d(key[doc == 0], key[doc == 1]))


def test_copies_that_are_unlike_the_first_find_each_other(spark):
    ready(spark)
    rng = np.random.default_rng(12)
    base, rows, starts = random_words(rng, 150), [], {}
    for k in range(36):
        copy = list(base)
        for x in np.flatnonzero(rng.random(150) < 0.05).tolist():
            copy[x] = f"edit{k}x{x}"
        rows.append((k, " ".join(random_words(rng, 40 + k) + copy + random_words(rng, 30))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["spans"] for r in compact_windows.report(docs).collect()}
    h = [compact_windows.shingles([words(t)])[0] for _, t in rows]
    seen = [[set(x[i:i + 46].tolist()) for i in range(len(x) - 45)] for x in h]
    at = [40 + k for k in range(36)]
    need = lost = 0
    for k in range(1, 36):
        found = np.zeros(len(rows[k][1].split()), bool)
        for s in got[k].split():
            a, z = map(int, s.split("-"))
            found[a:z + 1] = True
        for i, w in enumerate(seen[k]):
            near = [t for j in range(k) for t in seen[j][max(0, i - at[k] + at[j] - 5):max(0, i - at[k] + at[j] + 6)]]
            if any(5 * len(w & t) >= 4 * len(w | t) for t in near):
                need += 1
                lost += not found[i:i + 50].all()
    assert need > 300 and not lost


# --- fingerprints ------------------------------------------------------------------------------------------------


def test_entropy_of_every_window():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(0, 256, 150), np.full(90, 7), rng.integers(97, 105, 120)]).astype(np.uint8)
    got = rare_features.entropy_buckets(x)
    for k in range(len(x) - 63):
        p = np.array(list(Counter(x[k:k + 64].tolist()).values())) / 64
        assert abs(got[k] - 1000 * -(p * np.log2(p)).sum() / 6) <= 1.5


def test_digests_do_not_depend_on_neighbours():
    rng = np.random.default_rng(2)
    texts = [b"", b"short", bytes(rng.integers(97, 123, 90, np.uint8)), bytes(rng.integers(97, 123, 30_000, np.uint8)), b"a" * 500]
    rank = rare_features.rarity(rare_features.bucket_counts(texts))
    for t, d in zip(texts, rare_features.digests(texts, rank)):
        alone = rare_features.digests([t], rank)[0]
        assert (alone == d).all() and rare_features.likeness(alone, d) == 1.0
    made = rare_features.digests(texts, rank)
    assert not len(made[0]) and len(made[3]) > 1 and rare_features.likeness(made[3], made[4]) < 0.3


def test_fingerprint_query(spark, sf, small, awkward, nothing):
    ids = sorted(small)
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_rare_features"](spark, sf).collect()}
    assert sorted(got) == ids
    near = []
    for k, i in enumerate(ids):
        t, follow = small[i] or "", small[ids[(k + 1) % len(ids)]] or ""
        n = len(t) // 4
        edited = t[:len(t) - n] + follow[:n]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        near.append((got[i]["near_edited"], got[i]["near_next"]))
    assert np.mean([a for a, _ in near]) > 0.6 and np.mean([b for _, b in near]) < 0.15
    ready(spark)
    odd = rare_features.compare_with_next(awkward).collect()
    assert len(odd) == awkward.count() and {r["fingerprint"] for r in odd if r["n_chars"] == 0} == {""}
    same = [r["fingerprint"] for r in odd if r["doc_id"] in (0, 40, 41)]
    assert len(set(same)) == 1
    assert rare_features.compare_with_next(nothing).count() == 0
    one = rare_features.compare_with_next(spark.createDataFrame([(1, "x" * 9)], "doc_id long, text string")).collect()
    assert one[0]["near_next"] == 1.0


# --- SimHash -----------------------------------------------------------------------------------------------------


def plain_simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    s = [" ".join(w[k:k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def plain_components(fps):
    ids, root = sorted(fps), {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_query(spark, sf, small):
    fps = {i: plain_simhash(t) for i, t in small.items()}
    want = plain_components(fps)
    got = queries.QUERIES["op6_simhash"](spark, sf).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {
        i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_simhash_of_awkward_documents(spark, awkward, nothing):
    ready(spark)
    got = simhash.simhash_components(awkward).collect()
    assert len(got) == awkward.count()
    for r in got:
        if r["doc_id"] in (1, 2):
            assert r["fingerprint"] == "0" * 16 and r["component_id"] == 1
    assert {r["component_id"] for r in got if r["doc_id"] in (0, 40, 41)} == {0}
    assert simhash.simhash_components(nothing).count() == 0


def test_crowded_blocks_lose_no_link(spark, monkeypatch):
    """Many close fingerprints under the same keys, dealt to several block pairs."""
    ready(spark)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(8)
    fps = set()
    for centre in rng.integers(0, 1 << 63, 6).tolist():
        for _ in range(60):
            x = centre
            for b in rng.integers(0, 64, rng.integers(0, 6)).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = dict(enumerate(sorted(fps)))
    rows = [(i, f - (1 << 64) if f >= 1 << 63 else f) for i, f in fps.items()]
    nodes = spark.createDataFrame(rows, "node long, fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.near_links(nodes)).collect()}
    assert {i: roots.get(i, i) for i in fps} == plain_components(fps)


def test_keys_of_fingerprints_are_not_broadcast(spark, tmp_path):
    """Their explode makes 35 rows of one, which Spark's estimate leaves out."""
    spark.range(1000).selectExpr("id as node", "xxhash64(id) as fp").write.parquet(str(tmp_path / "nodes"))
    plan = simhash.near_links(spark.read.parquet(str(tmp_path / "nodes")))._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_paths_and_stars(spark):
    ready(spark)
    edges = [(k, k + 1) for k in range(0, 70)] + [(200, k) for k in range(201, 300)] + [(5, 5), (400, 401), (401, 400)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(71)}, **{k: 200 for k in range(200, 300)}, 400: 400, 401: 400}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- language, toxicity ------------------------------------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_zstd_language"](spark, sf).collect()}
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got.keys() == truth.keys()
    held = [i for i in got if got[i]["held_out"]]
    assert sorted(held) == sorted(i for i in got if zlib.crc32(str(i).encode()) % 3 == 1)
    right = [got[i]["lang_pred"] == truth[i][0] for i in held]
    assert np.mean(right) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = [got[i]["lang_pred"] == truth[i][0] for i in held if not got[i]["rejected"]]
    assert np.mean(kept) >= np.mean(right)


def test_language_of_awkward_documents(spark, awkward, nothing):
    ready(spark)
    made = {"a": b"the cat sat on the mat and looked " * 20, "b": b"der hund lief im hof herum und bellte " * 20}
    got = zstd_language.identify(awkward, made).collect()
    assert len(got) == awkward.count()
    by = {r["doc_id"]: r for r in got}
    assert by[0]["lang_pred"] == "a" and all(by[i]["lang_pred"] == "und" and by[i]["rejected"] for i in (1, 2, 8))
    assert {r["lang_pred"] for r in zstd_language.identify(awkward, {}).collect()} == {"und"}
    assert zstd_language.identify(nothing, made).count() == 0
    assert zstd_language.train(nothing.select("doc_id", "text").selectExpr("*", "'a' as lang")) == {}


def test_toxic_documents_are_found_and_clean_ones_kept(spark, awkward, nothing):
    ready(spark)
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for k in range(600):
        w, bad = random_words(rng, 40), k % 4 == 0
        w += ["the", "of", "and"]
        if bad:
            w[5] = "scum" + ["", "my", "bag"][k % 3]
        if k % 10 == 3:
            w += ["junk"] * 3
        rows.append((k, " ".join(w)))
        if k % 2 == 0 or k % 3 == 0:
            labels.append((k, int(k % 10 != 3), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels, labels[0], (None, 1, 1), (7, None, 1)], "doc_id long, quality int, toxic int")
    chain = classifier_chain.train(docs, known, ["quality", "toxic"])
    got = {r["doc_id"]: r["p_toxic"] >= 0.5 for r in classifier_chain.score(docs, chain, ["quality", "toxic"]).collect()}
    assert got == {k: k % 4 == 0 for k in range(600)}
    odd = classifier_chain.score(awkward, chain, ["quality", "toxic"]).collect()
    assert len(odd) == awkward.count() and all(r["p_toxic"] < 0.5 for r in odd)
    assert classifier_chain.score(nothing, chain, ["quality", "toxic"]).count() == 0
    untaught = classifier_chain.train(docs, known.limit(0), ["quality", "toxic"])
    assert all(r["p_toxic"] < 0.5 for r in classifier_chain.score(docs, untaught, ["quality", "toxic"]).collect())


def test_later_models_train_on_unseen_probabilities():
    docs = [classifier_chain.features(f"x n{k}" if k % 2 else f"n{k}") for k in range(300)]
    y = np.array([[k % 2, k % 2] for k in range(300)], float)
    chain = classifier_chain.fit_chain(docs, y, np.arange(300) % 3)
    assert len(chain) == 2 and len(chain[1].weights) == len(chain[1].names) + 2 and chain[1].weights[-2] > 0


# --- scores, preferences -----------------------------------------------------------------------------------------


def test_scores_equal_counts_by_hand(spark, awkward, nothing):
    ready(spark)
    docs = awkward.select("doc_id", "text").where("doc_id is not null and doc_id <> 3")
    texts = {r["doc_id"]: WORD.findall(fold(r["text"])) for r in docs.collect()}
    c = [Counter(tuple(w[k:k + n]) for w in texts.values() for k in range(len(w) - n + 1)) for n in (1, 2, 3)]
    total = sum(c[0].values())
    want = {}
    for i, w in texts.items():
        s = 0
        for k in range(len(w)):
            for n in (3, 2, 1):
                g = tuple(w[max(0, k - n + 1):k + 1])
                if len(g) == n and (n == 1 or c[n - 1][g] >= 2):
                    below = c[n - 2][g[:-1]] if n > 1 else total
                    s += round(1e6 * (np.log(c[n - 1][g] / below) + (3 - n) * np.log(0.4)))
                    break
        want[i] = (len(w), s)
    for shard_docs in (4096, 2):
        got = {r["doc_id"]: (r["n_words"], r["micro_score"]) for r in backoff.score_documents(docs, shard_docs=shard_docs).collect()}
        assert got.keys() == want.keys()
        for i in want:
            assert got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) <= 2 * want[i][0]
    assert backoff.score_documents(awkward).count() == awkward.count()
    assert backoff.score_documents(nothing).count() == 0


def test_preferences_share_a_prompt(spark):
    turn = "array<struct<role: string, text: string>>"
    rows = [
        (1, [("system", "s"), ("user", "q"), ("assistant", "yes")], [("system", "s"), ("user", "q"), ("assistant", "no"), ("user", "x")]),
        (2, [("user", "a")], [("user", "a")]), (3, None, [("assistant", None)]), (4, [], []),
        (5, [(None, None), ("user", "b")], [(None, None)]), (5, [(None, None), ("user", "b")], [(None, None)]),
        (6, [("user", "a")], [("user", "b")]),
    ]
    pairs = spark.createDataFrame(rows, f"_c long, chosen {turn}, rejected {turn}")
    got = preferences.format_preferences(pairs, ["_c"]).collect()
    assert len(got) == 7
    by = {r["_c"]: r for r in got}
    assert [by[k]["n_shared"] for k in range(1, 7)] == [2, 1, 0, 0, 1, 0]
    assert by[1]["prompt"] == "<|system|>\ns<|end|>\n<|user|>\nq<|end|>\n"
    assert by[1]["chosen_completion"] == "<|assistant|>\nyes<|end|>\n"
    for r in got:
        for side in ("chosen", "rejected"):
            assert sum(m["chars"] for m in r[f"{side}_mask"]) == len(r[f"{side}_completion"])
    assert [m["trained"] for m in by[1]["rejected_mask"]] == [False, True, False, False]
    assert preferences.format_preferences(pairs.limit(0), ["_c"]).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, sf, name):
    from oracle import compare, connect

    problems, _, _ = compare(spark, connect(sf), name, queries.QUERIES[name], queries.ORACLES[name], sf)
    assert not problems


