"""Toxicity by a classifier chain.

Categories are predicted one after another by logistic models over word and word-opening
features; each model also reads the probabilities of the categories before it.  While
training, those probabilities are out-of-fold, so that a later model sees them as
uncertain as they are on new documents.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces
from .fm_index import words

SAMPLE_ROWS = 12_000
FEATURES = 384
FOLDS = 3
OPENINGS = (4, 5)
_FLOOR = 4.0  # standard errors by which a feature's shares must differ


def word_features(word: bytes) -> list[int]:
    """Numbers of a word and of its openings of 4 and 5 bytes (told apart by a blank)."""
    return [zlib.crc32(word), *[zlib.crc32(b" " + word[:n]) for n in OPENINGS if len(word) > n]]


def features(text: str | None) -> np.ndarray:
    """Distinct features of a text, ascending."""
    return np.unique(np.array([f for w in set(words(text)) for f in word_features(w)], np.uint32))


@dataclass
class Linear:
    """Logistic model: weights of binary features (ascending), then of earlier probabilities, then a constant."""

    names: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def probability(self, columns: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(columns @ self.weights, -30, 30)))


def _matrix(names: np.ndarray, docs: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
    out = np.zeros((len(docs), len(names) + earlier.shape[1] + 1))
    if len(names) and docs:
        every = np.concatenate(docs)
        at = np.minimum(np.searchsorted(names, every), len(names) - 1)
        known = names[at] == every
        out[np.repeat(np.arange(len(docs)), [len(d) for d in docs])[known], at[known]] = 1
    out[:, len(names):-1] = earlier
    out[:, -1] = 1
    return out


def fit_linear(docs: list[np.ndarray], y: np.ndarray, earlier: np.ndarray, limit: int = FEATURES) -> Linear:
    """Keep the features whose document shares differ most between classes, then Newton steps with a ridge."""
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    model = Linear(weights=np.zeros(earlier.shape[1] + 1))
    if not n1 or not n0:  # one class only, or no row
        model.weights[-1] = 20.0 if n1 else -20.0
        return model
    every, total = np.unique(np.concatenate(docs), return_counts=True)
    ones = np.zeros(len(every))
    mine, count = np.unique(np.concatenate([d for d, one in zip(docs, y) if one]), return_counts=True)
    ones[np.searchsorted(every, mine)] = count
    share = total / (n1 + n0)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    z = np.abs(ones / n1 - (total - ones) / n0) / spread
    fit = np.flatnonzero((z >= _FLOOR) & (total >= 5))
    names = np.sort(every[fit[np.argsort(-z[fit], kind="stable")[:limit]]])
    x = _matrix(names, docs, earlier)
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 1.0)
    ridge[-1] = 1e-3
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    return Linear(names, w)


def fit_chain(docs: list[np.ndarray], labels: np.ndarray, fold: np.ndarray, folds: int = FOLDS) -> list[Linear]:
    """One model per column of ``labels``; ``fold`` deals rows to folds."""
    earlier = np.zeros((len(docs), 0))
    chain = []
    for c in range(labels.shape[1]):
        y = labels[:, c]
        unseen = np.zeros(len(docs))
        for f in range(folds) if c < labels.shape[1] - 1 else ():
            own, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            part = fit_linear([docs[k] for k in rest], y[rest], earlier[rest])
            unseen[own] = part.probability(_matrix(part.names, [docs[k] for k in own], earlier[own]))
        chain.append(fit_linear(docs, y, earlier))
        earlier = np.column_stack([earlier, unseen])
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: list[str], sample_rows: int = SAMPLE_ROWS) -> list[Linear]:
    """Fit on a bounded sample: the ``sample_rows`` labelled ids first in the order of a hash.

    ``labels`` holds doc_id and one 0/1 column per category; rows with a null are left out,
    and an id with several rows counts as positive where any of them is.
    """
    rows = labels.dropna(subset=["doc_id", *categories]).groupBy("doc_id").agg(
        *[F.max(F.col(c).cast("int")).alias(f"_y{k}") for k, c in enumerate(categories)])
    first = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def run(batches):
        for b in pieces(batches, "text"):
            bags = [features(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(bags, pa.binary())], names=["doc_id", "y", "bag"])

    chosen = F.broadcast(docs.sparkSession.createDataFrame(first.collect(), first.schema))
    got = docs.select("doc_id", "text").join(chosen, "doc_id").select(
        "doc_id", F.array(*[f"_y{k}" for k in range(len(categories))]).alias("y"), "text")
    table = got.mapInArrow(run, "doc_id long, y array<int>, bag binary").toArrow().sort_by("doc_id")
    bags = [np.frombuffer(x, np.uint32) for x in table.column("bag").to_pylist()]
    y = np.array(table.column("y").to_pylist(), float).reshape(len(bags), len(categories))
    fold = np.array([zlib.crc32(str(i).encode()) % FOLDS for i in table.column("doc_id").to_pylist()])
    return fit_chain(bags, y, fold)


def score(docs: DataFrame, chain: list[Linear], categories: list[str]) -> DataFrame:
    """``docs`` (with ``text``) and p_<category> for each; a null or empty text has no features.

    Own columns of these names are replaced.  Repeated rows are scored each.
    """
    out = [f"p_{c}" for c in categories]
    docs = docs.drop(*out)
    keep = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        models = shared.value
        memo: dict[bytes, tuple] = {}
        use = {int(f) for m in models for f in m.names}

        def known(w):
            if len(memo) > 150_000:
                memo.clear()
            hit = memo[w] = tuple(f for f in word_features(w) if f in use)
            return hit

        for b in pieces(batches, "text", 2 << 20):
            bags = []
            for t in b.column("text").to_pylist():
                bag: set[int] = set()
                for w in set(words(t)):
                    hit = memo.get(w)
                    bag.update(known(w) if hit is None else hit)
                bags.append(np.array(sorted(bag), np.uint32))
            earlier = np.zeros((len(bags), 0))
            for m in models:
                earlier = np.column_stack([earlier, m.probability(_matrix(m.names, bags, earlier))])
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in keep], *[pa.array(earlier[:, k]) for k in range(len(out))]], names=[*keep, *out])

    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(run, ", ".join([*names, *[f"{c} double" for c in out]]))
