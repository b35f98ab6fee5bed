"""Each stage of the corpus pipeline on its own input, against brute force."""

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from spanloom.llm.common import ready, written
from spanloom.llm.fm_index import words
from test_text_operators import plain_components, plain_hits, plain_simhash


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_in_order(spark, sf):
    ready(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), name)
        steps[name] = docs
    assert list(steps)[1:] == ["toxicity", "near_duplicates", "substrings", "decontamination", "packing"]
    for name in list(steps)[:-1]:
        assert steps[name].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    whole, kept, single, cut, clean = (texts(steps[n]) for n in list(steps)[:-1])

    # toxicity: what stays is as it was, and of the labelled documents most that go are toxic
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert kept == {i: whole[i] for i in kept}
    gone = [toxic[i] for i in whole.keys() - kept.keys() if i in toxic]
    assert not gone or np.mean(gone) > 0.7
    assert np.mean([i in kept for i, t in toxic.items() if not t]) > 0.97

    # near duplicates: the smallest id of each component
    roots = plain_components({i: plain_simhash(t) for i, t in kept.items()})
    assert single == {i: kept[i] for i in set(roots.values())}

    # substrings: no 50 words stand twice but for what signatures miss; texts without repeats are unchanged
    def repeats(found):
        first, n = {}, 0
        for i in sorted(found):
            w = words(found[i])
            n += sum(first.setdefault(tuple(w[k:k + 50]), i) < i for k in range(len(w) - 49))
        return n

    assert cut.keys() == single.keys() and repeats(cut) <= 0.05 * max(1, repeats(single))
    fives = {}
    for i, t in single.items():
        w = words(t)
        for k in range(len(w) - 4):
            fives.setdefault(tuple(w[k:k + 5]), set()).add(i)
    for i, t in single.items():
        w = words(t)
        if all(len(fives[tuple(w[k:k + 5])]) == 1 for k in range(len(w) - 4)):
            assert cut[i] == t

    # decontamination: only hit documents change, and their hit words are gone
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    before = plain_hits(cut.items(), items)
    assert clean.keys() == cut.keys()
    for i, t in clean.items():
        n, hit = before[i][:2]
        assert (t == cut[i]) if not hit else len(words(t)) == n - hit
    sizes = {r["doc_id"]: r["n_chars"] for r in steps["decontamination"].collect()}
    assert sizes == {i: len(t) for i, t in clean.items()}

    # packing: every id of every document once
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    parts = {}
    for r in steps["packing"].collect():
        parts.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
    for i, t in clean.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert b"".join(x for _, x in sorted(parts[i])) == ids


def test_stages_take_awkward_documents(spark, awkward, sf):
    ready(spark)
    docs = awkward.selectExpr("doc_id", "text", "'en' as lang", "cast(null as string) as source", "length(text) as n_chars", "spans", "_z")
    docs = docs.withColumn("n_chars", docs["n_chars"].cast("long"))
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            frame = written(stage(spark, frame, sf), name)
        assert frame.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]


def test_texts_of_one_id_all_stay(spark, sf):
    ready(spark)
    one, two = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    docs = spark.createDataFrame(
        [(5, t, "en", None, len(t)) for t in (one, two, one)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["text"] for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()) == [one, two]
