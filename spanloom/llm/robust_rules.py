"""Quality rules by robust multivariate outliers, in DataFrame functions only.

Base rules drop texts that are too short or mostly repeat themselves.  The others give a
vector of four transformed statistics: mean word length, symbols a word, share of repeated
lines, share of repeated words.  Each is smoothed by a fixed number of ordinary words or
lines, so that a short text does not stray by chance.  For each language and source the
minimum covariance determinant (the mean and covariance of the three quarters of documents
that lie closest together) is found by concentration steps from coordinate-wise medians,
followed by one reweighting; documents whose Mahalanobis distance is beyond ``CUTOFF`` are
rejected.  A statistic that most documents share exactly has no spread, so each variance is
raised by the square of a least spread.

A step is one pass: rows are summed by group and by bin of distance, and the bins up to the
one that completes three quarters are added up.  Vectors are whole numbers (thousandths),
so sums do not depend on the order of rows, and equal vectors are one row with a weight; a
source of any size reaches the next step as a few thousand sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WORD = r"[^\\x20\\x09-\\x0D]+"
LEAST_WORDS = 50
REPEATED_PERCENT = 50
SMOOTH_WORDS = 100  # ordinary words of five characters added to each text
SMOOTH_LINES = 10
SPREADS = (20, 50, 50, 50)  # least spread of each statistic, in thousandths
HALF = 0.75  # share of documents that a fit rests on
STEPS = 3
LEAST_DOCS = 200  # groups of fewer take the fit of their language, then the fit of all
# Quantiles of chi-square with 4 degrees of freedom, and how much a covariance of the
# closest part has to grow to be that of the whole: part / P(chi-square with 6 <= quantile).
NEAR = 11.143287  # 0.975
GROW_HALF = 1.4866
GROW_NEAR = 1.0645
CUTOFF = 28.4733  # 0.99999
BINS = 16  # bins of distance to a factor e
DIM = 4
_PAIRS = [(i, j) for i in range(DIM) for j in range(i + 1)]
_ALL = "\0all"

# Words in windows of three that stand twice: hashes of windows with their places are
# sorted, neighbours that are equal keep their places, and places are merged in order.
# transform(array(x), v -> ...)[0] gives x a name, so that it is made once.
_REPEATED = """
if(size(words) < 4, 0L,
 transform(array(transform(sequence(1, size(words) - 2),
   i -> xxhash64(element_at(words, i), element_at(words, i + 1), element_at(words, i + 2)))), g ->
  if(size(array_distinct(g)) = size(g), 0L,
   transform(array(array_sort(transform(g, (h, i) -> struct(h as h, i as i)))), s ->
    aggregate(array_sort(transform(filter(transform(s, (x, k) -> struct(x.i as i,
        coalesce(x.h = get(s, k - 1).h, false) or coalesce(x.h = get(s, k + 1).h, false) as twice)), x -> x.twice), x -> x.i)),
     struct(0L as n, 0 as e),
     (a, i) -> struct(a.n + 3 + i - greatest(a.e, i) as n, i + 3 as e), a -> a.n))[0]))[0])
"""


def base_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang, source) with counts instead of the text.

    Adds n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines,
    n_repeat_words and base_failed.  A null text has no words.  Every row is judged alone,
    so repeated rows and rows without id give rows of their own.  A text is one value in a
    task; work is n log n in its words.  Windows are compared by 64-bit hashes.
    """
    text = F.coalesce("text", F.lit(""))
    cut = docs.select(
        "doc_id", "lang", "source", F.expr(f"regexp_extract_all(coalesce(text, ''), '{WORD}', 0)").alias("words"),
        F.expr("regexp_count(coalesce(text, ''), '[#*$%&|<>]')").cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    counted = cut.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_REPEATED).alias("n_repeat_words"))
    return counted.withColumn(
        "base_failed",
        (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words")))


def transformed() -> list[Column]:
    """The four statistics in thousandths, as whole numbers."""
    n = F.col("n_words") + SMOOTH_WORDS
    share = [
        F.log((F.col("word_chars") + 5 * SMOOTH_WORDS) / n / 5), F.log(1 + F.col("n_symbols") / n),
        F.col("n_dup_lines") / (F.col("n_lines") + SMOOTH_LINES), F.col("n_repeat_words") / n]
    return [F.round(1000 * x).cast("long").alias(f"v{k}") for k, x in enumerate(share)]


def _scope(*parts: Column) -> Column:
    return F.to_json(F.array(*parts))


def _distance(rows: DataFrame) -> DataFrame:
    """Add ``d2``, the squared Mahalanobis distance, by forward substitution in the Cholesky factor."""
    for k in range(DIM):
        rest = F.col(f"v{k}") - F.col(f"m{k}")
        for j in range(k):
            rest = rest - F.col(f"l{k}{j}") * F.col(f"y{j}")
        rows = rows.withColumn(f"y{k}", rest / F.col(f"l{k}{k}"))
    total = F.col("y0") * F.col("y0")
    for k in range(1, DIM):
        total = total + F.col(f"y{k}") * F.col(f"y{k}")
    return rows.withColumn("d2", total).drop(*[f"y{k}" for k in range(DIM)])


def _factor(fit: DataFrame) -> DataFrame:
    """Cholesky factor l of the covariances c, entry after entry along ``_PAIRS``: columns scope, m and l."""
    at = {pair: k for k, pair in enumerate(_PAIRS)}
    entries = []
    for (i, j), k in at.items():
        rest = f"c[{k}]" + "".join(f" - l[{at[i, x]}] * l[{at[j, x]}]" for x in range(j))
        entries.append(f"when {k} then " + (f"sqrt({rest})" if i == j else f"({rest}) / l[{at[j, j]}]"))
    lower = f"aggregate(sequence(0, {len(at) - 1}), cast(array() as array<double>), (l, k) -> array_append(l, case k {' '.join(entries)} end))"
    means = [f"m{k}" for k in range(DIM)]
    made = fit.select("scope", *means, F.array(*[f"c{i}{j}" for i, j in _PAIRS]).alias("c"))
    return made.select("scope", *means, F.expr(lower).alias("l")).select(
        "scope", *means, *[F.col("l")[k].alias(f"l{i}{j}") for (i, j), k in at.items()])


def _medians(rows: DataFrame) -> DataFrame:
    """Weighted lower median of ``v`` by (scope, k) of rows (scope, k, v, n)."""
    counts = rows.groupBy("scope", "k", "v").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("scope", "k")
    upto = w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.select("scope", "k", "v", F.sum("n").over(upto).alias("upto"), F.sum("n").over(w).alias("all"))
    return ranked.where(2 * F.col("upto") >= F.col("all")).groupBy("scope", "k").agg(F.min("v").alias("mid"))


def _start(cells: DataFrame) -> DataFrame:
    """Medians as means, and median deviations on the diagonal."""
    tall = cells.select("scope", "n", F.posexplode(F.array(*[f"v{k}" for k in range(DIM)])).alias("k", "v"))
    mid = written(_medians(tall), "medians")
    off = _medians(tall.join(mid, ["scope", "k"]).select("scope", "k", F.abs(F.col("v") - F.col("mid")).alias("v"), "n"))
    both = mid.join(off.withColumnRenamed("mid", "off"), ["scope", "k"])
    wide = both.groupBy("scope").agg(*[
        F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{to}{k}") for k in range(DIM) for c, to in (("mid", "m"), ("off", "s"))])
    return wide.select(
        "scope", *[F.col(f"m{k}").cast("double").alias(f"m{k}") for k in range(DIM)],
        *[(1.4826 * F.col(f"s{k}") * (1.4826 * F.col(f"s{k}")) + SPREADS[k] ** 2).alias(f"l{k}{k}") for k in range(DIM)]).select(
        "scope", *[f"m{k}" for k in range(DIM)],
        *[F.sqrt(f"l{i}{i}").alias(f"l{i}{i}") if i == j else F.lit(0.0).alias(f"l{i}{j}") for i, j in _PAIRS])


def _sums() -> list[Column]:
    return [F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(f"v{k}")).alias(f"s{k}") for k in range(DIM)],
            *[F.sum(F.col("n") * F.col(f"v{i}") * F.col(f"v{j}")).alias(f"p{i}{j}") for i, j in _PAIRS]]


def _fit(sums: DataFrame, grow: float) -> DataFrame:
    """Mean and raised covariance of summed rows."""
    n = F.col("n").cast("double")
    made = sums.withColumns({f"m{k}": F.col(f"s{k}") / n for k in range(DIM)})
    made = made.withColumns({
        f"c{i}{j}": (F.col(f"p{i}{j}") / n - F.col(f"m{i}") * F.col(f"m{j}")) * grow + (SPREADS[i] ** 2 if i == j else 0)
        for i, j in _PAIRS})
    return _factor(made)


def minimum_covariance(cells: DataFrame) -> DataFrame:
    """Fits (scope, m, l) of weighted vectors (scope, v0..v3, n), one row a scope."""
    names = ["n", *[f"s{k}" for k in range(DIM)], *[f"p{i}{j}" for i, j in _PAIRS]]
    fit = _start(cells)
    for _ in range(STEPS):
        placed = _distance(cells.join(fit, "scope"))
        bins = placed.groupBy("scope", F.floor(F.log(F.col("d2") + 1e-6) * BINS).alias("bin")).agg(*_sums())
        w = Window.partitionBy("scope")
        before = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        ranked = bins.select(
            "*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(w).alias("all"))
        core = ranked.where(F.col("before") < HALF * F.col("all")).groupBy("scope").agg(*[F.sum(c).alias(c) for c in names])
        fit = _fit(core, GROW_HALF)
    near = _distance(cells.join(fit, "scope")).where(F.col("d2") <= NEAR).groupBy("scope").agg(*_sums())
    return _fit(near, GROW_NEAR)


def judge(docs: DataFrame, *, least_docs: int = LEAST_DOCS, cutoff: float = CUTOFF) -> DataFrame:
    """Statistics and verdict of every row: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, d2.

    ``kept`` is false for rows that fail the base rules (``d2`` null) and for outliers.
    Null language and null source are groups of their own.  Fits rest on rows that pass the
    base rules; a copy counts as often as it stands there.  A group of fewer than
    ``least_docs`` such rows takes the fit of its language, or of all.  An empty table
    gives no row.  The counts are written once, so texts are read once.
    """
    stats = base_statistics(docs).select("*", *transformed())
    stats = written(stats.withColumns({
        "by_lang": _scope("lang"), "by_source": _scope("lang", "source")}), "statistics")
    passed = stats.where(~F.col("base_failed"))
    vectors = written(passed.groupBy("by_lang", "by_source", *[f"v{k}" for k in range(DIM)]).agg(
        F.count(F.lit(1)).alias("n")), "vectors")

    # the fit that each group takes
    sizes = vectors.groupBy("by_lang", "by_source").agg(F.sum("n").alias("n"))
    langs = vectors.groupBy("by_lang").agg(F.sum("n").alias("n_lang"))
    chosen = written(sizes.join(langs, "by_lang").select(
        "by_source", F.when(F.col("n") >= least_docs, F.col("by_source"))
        .when(F.col("n_lang") >= least_docs, F.col("by_lang")).otherwise(F.lit(_ALL)).alias("scope")), "chosen")
    # a source is "[lang,source]" and a language "[lang]", so their names never meet
    all_cells = vectors.select(
        F.explode(F.array("by_source", "by_lang", F.lit(_ALL))).alias("scope"), *[f"v{k}" for k in range(DIM)], "n")
    needed = chosen.select("scope").distinct()
    cells = written(all_cells.join(needed, "scope", "left_semi").groupBy(
        "scope", *[f"v{k}" for k in range(DIM)]).agg(F.sum("n").alias("n")), "cells")

    fits = chosen.join(minimum_covariance(cells), "scope").drop("scope")
    found = _distance(stats.join(fits, "by_source", "left"))
    d2 = F.when(~F.col("base_failed"), F.col("d2"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce(d2 <= cutoff, F.lit(False)).alias("kept"), d2.alias("d2"))
