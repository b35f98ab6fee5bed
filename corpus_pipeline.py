"""Cleaning documents for training: five stages, each over all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last return
the columns of ``documents``; where a text was cut, ``n_chars`` follows it.  Rows without
a doc_id pass the stages that compare documents, as nothing can be said about them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import classifier_chain, compact_windows, fm_index, packing, simhash
from spanloom.llm.common import ready, table, written

CATEGORIES = ["quality", "toxic"]
REJECT = 0.5
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain calls toxic go."""
    docs = docs.select(COLUMNS)
    chain = classifier_chain.train(docs, table(ready(spark), sf_dir, "labels"), CATEGORIES)
    return classifier_chain.score(docs, chain, CATEGORIES).where(F.col("p_toxic") < REJECT).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by close fingerprints the one with the smallest id stays.

    Rows that repeat an id and its text are kept once; of an id that stays, each text stays.
    """
    ready(spark)
    found = simhash.simhash_components(docs.select("doc_id", "text"))
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    known = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return known.select(COLUMNS).unionByName(docs.where("doc_id is null").select(COLUMNS))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat an earlier document's are cut."""
    ready(spark)
    return _measured(compact_windows.remove_repeats(docs.select(COLUMNS)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that stand in a window of a benchmark item are cut."""
    return _measured(fm_index.remove_phrases(docs.select(COLUMNS), table(ready(spark), sf_dir, "benchmark")))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids with their place in sequences of 2048."""
    ready(spark)
    return packing.pack_documents(
        docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, length=2048)


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontamination", decontamination),
    ("packing", sequences),
]

# Trained weights, connected components and a tokenizer have no SQL form; tests/llm holds
# the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again."""
    docs = table(ready(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
