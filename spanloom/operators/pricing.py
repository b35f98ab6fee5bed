"""Price tables, longest-prefix price lookup and token cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRICE_SCHEMA = "model string, input double, output double, cache_write double, cache_read double"

# Default list prices, USD per 1M tokens
# (model, input, output, cache write, cache read).
DEFAULT_PRICES = [
    ("claude-opus-4", 15.0, 75.0, 18.75, 1.5),
    ("claude-opus-4-1", 15.0, 75.0, 18.75, 1.5),
    ("claude-sonnet-4", 3.0, 15.0, 3.75, 0.3),
    ("claude-3-7-sonnet", 3.0, 15.0, 3.75, 0.3),
    ("claude-3-5-sonnet", 3.0, 15.0, 3.75, 0.3),
    ("claude-3-5-haiku", 0.8, 4.0, 1.0, 0.08),
    ("claude-3-haiku", 0.25, 1.25, 0.3, 0.03),
    ("claude-3-opus", 15.0, 75.0, 18.75, 1.5),
    ("gpt-5.1", 1.25, 10.0, 1.25, 0.125),
    ("gpt-5", 1.25, 10.0, 1.25, 0.125),
    ("gpt-4.1", 2.0, 8.0, 2.0, 0.5),
    ("gpt-4o", 2.5, 10.0, 2.5, 1.25),
    ("gpt-4o-mini", 0.15, 0.6, 0.15, 0.075),
    ("o3", 2.0, 8.0, 2.0, 0.5),
    ("o4-mini", 1.1, 4.4, 1.1, 0.275),
]


def default_prices(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{m}', {i}D, {o}D, {w}D, {r}D)" for m, i, o, w, r in DEFAULT_PRICES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(model, input, output, cache_write, cache_read)")


def merge_prices(base: DataFrame, override: DataFrame) -> DataFrame:
    """Entries of ``override`` replace those of ``base`` with the same model."""
    return base.join(override, "model", "left_anti").unionByName(override)


def resolve_prices(models: DataFrame, prices: DataFrame) -> DataFrame:
    """Price of each distinct ``model``: exact, else the longest key prefixing it.

    Every prefix of a model is a join key, so the lookup is an equi-join.
    """
    m = models.select("model").where(F.col("model") != "").distinct()
    lower = F.lower("model")
    prefixes = m.select(
        "model",
        F.explode(
            F.transform(F.sequence(F.lit(1), F.length(lower)), lambda i: F.substring(lower, F.lit(1), i))
        ).alias("prefix"),
    )
    rates = F.struct("input", "output", "cache_write", "cache_read")
    keyed = prices.select(
        F.lower("model").alias("prefix"), F.col("model").alias("key"), rates.alias("rates")
    )
    hits = prefixes.join(keyed, "prefix")
    # An exact key wins, then an exact lower-case key, then the longest prefix.
    rank = (
        F.when(F.col("key") == F.col("model"), 2)
        .when(F.col("key") == F.lower("model"), 1)
        .otherwise(0)
    )
    best = hits.groupBy("model").agg(
        F.max_by("rates", F.struct(rank, F.length("prefix"))).alias("rates")
    )
    return best.select("model", "rates.*")


def with_rates(df: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """Left-join the four rates of each row's model as a struct ``rates``."""
    resolved = resolve_prices(df.select(F.col(model).alias("model")), prices)
    resolved = resolved.select(
        F.col("model").alias(model),
        F.struct("input", "output", "cache_write", "cache_read").alias("rates"),
    )
    return df.join(resolved, model, "left")


def cost(
    prompt: Column | str = "prompt_tokens",
    completion: Column | str = "completion_tokens",
    cache_creation: Column | str = "cache_creation",
    cache_read: Column | str = "cache_read",
) -> Column:
    """USD of the token counts under ``rates``; NULL without a price."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return (
        c(prompt) * F.col("rates.input")
        + c(completion) * F.col("rates.output")
        + c(cache_creation) * F.col("rates.cache_write")
        + c(cache_read) * F.col("rates.cache_read")
    ) / F.lit(1_000_000.0)


def with_cost(df: DataFrame, prices: DataFrame, stored: str | None = None) -> DataFrame:
    """Add ``cost``: fresh price, else the ``stored`` index-time cost."""
    out = with_rates(df, prices)
    fresh = cost()
    return out.withColumn("cost", F.coalesce(fresh, F.col(stored)) if stored else fresh)


def cache_hit_rate(prompt: Column, creation: Column, read: Column) -> Column:
    total = prompt + creation + read
    return F.when(total > 0, read / total).otherwise(F.lit(0.0))
