"""Vendor price lists as a price table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRY = (
    "input_cost_per_token double, output_cost_per_token double, cache_creation_input_token_cost double, "
    "cache_read_input_token_cost double"
)


def convert_prices(raw: DataFrame) -> DataFrame:
    """``raw`` has one JSON map model -> cost per token in ``value``.

    A key with a provider prefix also stands for its base name; a key without
    prefix wins over it.  Missing cache rates fall back to the input rate.
    """
    entries = raw.select(F.posexplode(F.from_json("value", "map<string,string>")).alias("pos", "key", "text"))
    e = entries.where("key <> 'sample_spec'").select("pos", "key", F.from_json("text", _ENTRY).alias("p")).select("pos", "key", "p.*")
    e = e.where("input_cost_per_token is not null and output_cost_per_token is not null")
    e = e.where("input_cost_per_token > 0 or output_cost_per_token > 0")
    rate = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(F.col("input_cost_per_token")) * 1_000_000
    base = F.element_at(F.split("key", "/"), -1)
    rooted = ~F.contains("key", F.lit("/"))
    e = e.withColumn("model", base).where("model <> ''")
    rates = F.struct(
        (F.col("input_cost_per_token") * 1_000_000).alias("input"), (F.col("output_cost_per_token") * 1_000_000).alias("output"),
        rate("cache_creation_input_token_cost").alias("cache_write"), rate("cache_read_input_token_cost").alias("cache_read"),
    )
    return e.groupBy("model").agg(F.max_by(rates, F.struct(rooted, "pos")).alias("r")).select("model", "r.*")


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    return convert_prices(spark.read.option("wholetext", "true").text(path))
