"""Token ids, plane files and packing against the tokenizers library and exact round trips."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from conftest import TEXTS
from spanloom.llm import bit_planes, packing, queries
from spanloom.llm.common import ready
from spanloom.llm.tokens import Encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    *[t for t in TEXTS if t], "a\n\nb", "a  b", " x", "\n\n  La  \n", "é", "ΣΑΣ Σ", "İx", "a²3 ½b 12ab", "_a_b",
    "\xa0b  c", "ǅ ʰa", "x​ᾼ", "a\r\nb", "x\x85y", "A\U00013460", "b\ua7cc c",
]


def reference(path, special_as_text=False):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = special_as_text
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path,kind", [(BYTE, "byte"), (WORD, "word")])
def test_encoder_equals_library(path, kind):
    for as_text in (True, False):
        enc, want = Encoder(path, kind, as_text), reference(path, as_text)
        names = [f"a {t} b{t}" for t in enc.added] + [f"{t[:-1]} {t[-1]}" for t in enc.added]
        for text, ids in zip(ODD + names, enc.encode(ODD + names)):
            assert np.frombuffer(ids, "<u4").tolist() == want(text), text
    made = settings(max_examples=150, deadline=None)(given(st.text(max_size=40))(
        lambda text: _same(enc, want, text)))
    made()


def _same(enc, want, text):
    assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == want(text)


@pytest.mark.parametrize("planes", ["bit", "byte"])
@pytest.mark.parametrize("n", [1, 7, 64, 1000])
def test_planes_round_trip(planes, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, np.uint32)
    assert (bit_planes.from_planes(bit_planes.to_planes(ids, planes), n, planes) == ids).all()
    assert (bit_planes.from_planes([None] * (32 if planes == "bit" else 4), n, planes) == 0).all()


@pytest.mark.parametrize("planes", ["bit", "byte"])
def test_files_hold_all_ids_in_order(spark, awkward, tmp_path, planes):
    ready(spark)
    path = str(tmp_path / "p")
    bit_planes.write_planes(awkward, path, BYTE, planes=planes, block=512)
    got = bit_planes.read_planes(spark, path, keep_ids=True).orderBy("start").collect()
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    want = reference(BYTE)
    at = 0
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    left = defaultdict(list)
    for i, t in rows:
        left[i].append(np.array([*want(t), 2], "<u4").tobytes())
    for r in got:
        assert r["start"] == at and bytes(r["ids"]) in left[r["doc_id"]]
        left[r["doc_id"]].remove(bytes(r["ids"]))
        assert r["n_tokens"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(r["ids"])
        at += r["n_tokens"]
    index = spark.read.parquet(f"{path}/index").orderBy("first_id").collect()
    assert [r["first_id"] for r in index] == np.cumsum([0, *[r["n_ids"] for r in index]])[:-1].tolist()
    assert index[-1]["first_id"] + index[-1]["n_ids"] == at


def test_files_of_an_empty_table(spark, nothing, tmp_path):
    ready(spark)
    bit_planes.write_planes(nothing, str(tmp_path / "e"), BYTE)
    assert bit_planes.read_planes(spark, str(tmp_path / "e")).count() == 0


def test_plane_query(spark, sf, small):
    want, at = reference(BYTE), 0
    got = {r["doc_id"]: r for r in queries.QUERIES["op2_bit_planes"](spark, sf).collect()}
    assert len(got) == len(small)
    for i in sorted(small):
        ids = [*want(small[i]), 2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), crc)
        at += len(ids)


@given(st.lists(st.integers(1, 2048), max_size=120))
@settings(max_examples=80, deadline=None)
def test_first_fit_decreasing_equals_a_plain_scan(sizes):
    rooms, want = [], [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        b = next((j for j, r in enumerate(rooms) if r >= sizes[k]), None)
        if b is None:
            rooms.append(2048)
            b = len(rooms) - 1
        rooms[b] -= sizes[k]
        want[k] = b
    assert packing.first_fit_decreasing(sizes, 2048)[0] == want


def check_packed(rows, texts, length):
    want = reference(WORD)
    ids = {i: np.array([*want(t), 1], "<u4").tobytes() for i, t in texts.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, raw in ids.items():
        parts = sorted(by_doc[i], key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in parts) == raw
        assert all(r["doc_tokens"] * 4 == len(raw) for r in parts)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
    return len(by_seq)


def test_every_id_is_packed_once(spark, sf, small):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = check_packed(packing.pack_documents(docs, WORD, group_docs=64).collect(), small, 2048)
    total = sum(r["length"] for r in packing.token_pieces(docs, WORD).select("length").collect())
    assert n * 2048 <= total * 1.02 + 4 * 2048  # a last sequence for each of 4 groups


def test_awkward_documents_are_packed(spark, awkward, nothing):
    ready(spark)
    rows = packing.pack_documents(awkward, WORD, length=64, group_docs=4).collect()
    single = {r["doc_id"]: r["text"] for r in awkward.where("doc_id is not null and doc_id <> 3").collect()}
    per = defaultdict(int)
    for r in rows:
        per[r["doc_id"]] += r["length"]
    want = reference(WORD)
    for i, t in single.items():
        assert per[i] == len(want(t)) + 1
    assert per[3] == 2 * (len(want("Word")) + 1)  # repeated rows are packed each
    assert per[None] == len(want("no id here at all")) + 2
    assert packing.pack_documents(nothing, WORD).count() == 0


def test_pieces_without_id_are_spread_over_groups(spark):
    found = spark.createDataFrame(
        [(None, 0, 1, 1, bytes([k, 0, 0, 0])) for k in range(64)],
        "doc_id long, start long, length long, doc_tokens long, ids binary")
    rows = packing.pack(found, groups=8).collect()
    assert len(rows) == 64 and len({r["sequence_id"] >> 32 for r in rows}) > 4


@pytest.mark.parametrize("path,kind", [(BYTE, "byte"), (WORD, "word")])
def test_frequent_words_are_encoded_once_and_blanks_are_no_parts(path, kind):
    enc = Encoder(path, kind, cache_parts=40)
    learned, learn = [], enc._learn
    enc._learn = lambda parts: (learned.extend(parts), learn(parts))
    for k in range(20):
        texts = [f"the cat of {chr(97 + k)}{chr(97 + j)}x, and so" for j in range(10)]
        assert enc.encode(texts) == enc._whole(texts)
    assert learned.count(" cat" if kind == "byte" else "cat") == 1
    assert not {"", " "} & set(learned)
    assert len(enc.cache) + len(enc.older) <= 60  # its bound, and the parts of a batch


def test_read_documents_are_not_shuffled_to_the_starts_of_shards(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(50)], "doc_id long, text string")
    bit_planes.write_planes(docs, str(tmp_path), BYTE)
    plan = bit_planes.read_planes(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan


_BITS = st.sampled_from([
    *"  \n\n\t\r\x85\xa0 　\x1f", *".,;:!?'\"()-", "...", "a", "The", "é", "don't", "²", "12", "日本。", "́", "\U00013460", "<|endoftext|>"])


def test_byte_texts_of_blanks_and_stops_equal_library():
    enc, want = Encoder(BYTE, "byte"), reference(BYTE)

    def same(texts):
        assert [np.frombuffer(ids, "<u4").tolist() for ids in enc.encode(texts)] == [want(t) for t in texts]

    made = st.lists(st.lists(_BITS, max_size=12).map("".join), min_size=1, max_size=6)
    settings(max_examples=400, deadline=None)(given(made)(same))()


def test_byte_words_are_learned_once_with_apostrophes_numerals_and_stops():
    enc = Encoder(BYTE, "byte")
    learned, whole, learn, encode = [], [], enc._learn, enc._whole
    enc._learn = lambda parts: (learned.extend(parts), learn(parts))
    enc._whole = lambda texts: (whole.extend(texts), encode(texts))[1]
    texts = ["It don't cost 5² here.\nThe cat, a cat; that cat", "A cat! No cat.", "two  blanks"]
    assert enc.encode(texts) == encode(texts)
    assert learned.count(" cat") == 1 and " don't" in learned
    assert not set(texts[:2]) & set(whole) and texts[2] in whole
