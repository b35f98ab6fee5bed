import json

import pytest

TEXTS = [
    "The cat sat on the mat and looked at the dog that ran in the yard all day.",
    "",
    None,
    "Word",
    "Ünïcödé straße naïve café über größe 日本語 テキスト",
    "don't I'll  two  blanks\n\nlines\t tabs ² ½ x²3 <|endoftext|>",
    " ".join(f"w{k % 977}x" for k in range(20_000)),
    "same same same same " * 300,
    "!!! ??? ...",
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and long texts, repeats, and columns whose names the operators use inside."""
    rows = [(k, t) for k, t in enumerate(TEXTS)]
    rows += [(3, "Word"), (None, "no id here at all"), (None, None), (40, TEXTS[0]), (41, TEXTS[0])]
    extra = ["_z", "spans", "items", "fp", "key", "shard", "n_words", "p_toxic", "part", "node"]
    return spark.createDataFrame(
        [(*r, *["x"] * len(extra)) for r in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in extra))


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def plain(row):
    return json.loads(json.dumps(row.asDict(recursive=True), default=str))
