"""Language identification by compression.

Every language has a raw-content zstandard dictionary made of texts in that language.  A
text is encoded in pieces with each dictionary; the language whose dictionary makes it
smallest is chosen, and a choice with a narrow margin is rejected.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces

DICTIONARY_BYTES = 96 << 10
SAMPLE_DOCS = 256
MARGIN = 0.01
_PIECE = 2048
_LEVEL = 9
SHARE_BYTES = 1024  # of one document in a dictionary
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Small letters with single blanks: case, digits and marks say little about a language."""
    return _OTHER.sub(" ", text.lower())


def train(
    labelled: DataFrame, *, sample_docs: int = SAMPLE_DOCS, size: int = DICTIONARY_BYTES, share: int = SHARE_BYTES,
) -> dict[str, bytes]:
    """A dictionary of at most ``size`` bytes for each lang of ``labelled`` (doc_id, text, lang).

    Fitted on a bounded sample: of each language the ``sample_docs`` rows with a letter that
    come first in the order of a hash of their id, and of each ``share`` bytes of its
    letters, from a place that the same hash chooses in the whole text.  Rows are ranked
    without their texts; rows without text, letter, language or id teach nothing, repeated
    rows count once, and an empty table gives no dictionary.
    """
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    usable = labelled.where("lang is not null and doc_id is not null").where(F.col("text").rlike(r"\p{L}"))
    ids = usable.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).distinct()
    first = ids.withColumn("n", rank).where(F.col("n") <= sample_docs).select("lang", "doc_id", "n", "h").collect()
    if not first:
        return {}
    spark = labelled.sparkSession
    chosen = spark.createDataFrame(first, "lang string, doc_id long, n int, h long")

    def shares(batches):
        for b in batches:
            parts = []
            for text, h in zip(b.column("text").to_pylist(), b.column("h").to_pylist()):
                raw = letters(text).encode()
                at = (h & (1 << 62) - 1) % max(len(raw) - share + 1, 1)
                parts.append(raw[at:at + share])
            yield pa.RecordBatch.from_arrays(
                [b.column("lang"), b.column("n"), pa.array(parts, pa.binary())], names=["lang", "n", "part"])

    # sample_docs ids a language: small whatever the input
    texts = usable.join(F.broadcast(chosen), ["lang", "doc_id"]).select("lang", "n", "h", "text").mapInArrow(
        shares, "lang string, n int, part binary").distinct().collect()
    out: dict[str, bytes] = {}
    for lang in sorted({r["lang"] for r in texts}):
        held, room = [], size
        for r in sorted((r for r in texts if r["lang"] == lang), key=lambda r: (r["n"], r["part"])):
            part = bytes(r["part"])[:room]
            held.append(part)
            room -= len(part)
        content = b" ".join(held)
        if len(content) >= 8:
            out[lang] = content
    return out


def identify(docs: DataFrame, dictionaries: dict[str, bytes], *, margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of ``docs`` (doc_id, text).

    score is the weight of the choice against all languages, from the sizes in bytes;
    rejected tells that the second best is less than ``margin`` larger.  A null text, a
    text without a letter, and any text when nothing was learned are ``und`` with score 0
    and rejected.  Equal sizes go to the language first in order of name.  Repeated rows are
    judged alike and an empty table gives no row; a text is encoded whole, in pieces.
    """
    langs = sorted(dictionaries)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast([dictionaries[x] for x in langs])

    def run(batches):
        made = []
        for content in shared.value:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=_LEVEL)
            made.append(zstandard.ZstdCompressor(
                dict_data=d, write_content_size=False, write_dict_id=False).compress)
        for b in pieces(batches, "text"):
            out = []
            for text in b.column("text").to_pylist():
                if not made or text is None or not any(map(str.isalpha, text)):
                    out.append(("und", 0.0, True))
                    continue
                raw = letters(text).encode()
                cuts = [raw[k:k + _PIECE] for k in range(0, len(raw), _PIECE)]
                sizes = np.array([sum(len(pack(c)) for c in cuts) for pack in made], float)
                best = int(sizes.argmin())
                second = np.delete(sizes, best).min(initial=np.inf)
                score = 1.0 / np.exp(np.minimum(0, (sizes[best] - sizes) / 4)).sum()
                out.append((langs[best], float(score), bool(second - sizes[best] < margin * sizes[best])))
            lang, score, rejected = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(lang), pa.array(score), pa.array(rejected)],
                names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double, rejected boolean")
