"""Price feed file to rates per million tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import models as mf
from ..operators.responses import first_by

# Cache rates of the first maker as multiples of input.
CACHE_WRITE_RATIO = "1.25"
CACHE_READ_RATIO = "0.1"
RATE = "decimal(28,12)"


def _per_million(name: str) -> Column:
    """Cost per million tokens, null when absent, not a number or negative.

    Kept to twelve significant digits, which drops binary noise.
    """
    text = F.col(f"e.{name}")
    number = F.when(text.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), text).try_cast("double")
    scaled = number * 1e6
    return F.when(number >= 0, F.format_string("%.11e", scaled).cast(RATE))


def rates_from_entries(entries: DataFrame) -> DataFrame:
    """Rates from (key, e) rows of the feed's entries."""
    kept = entries.filter(
        ~F.col("key").contains("/")
        & F.col("e.litellm_provider").isin("anthropic", "openai")
        & F.col("e.mode").isin("chat", "responses")
    )
    own = F.col("e.litellm_provider") == "anthropic"

    def spare(ratio: str) -> Column:
        factor = F.when(own, F.lit(ratio).cast("decimal(4,2)")).otherwise(
            F.lit("1").cast("decimal(4,2)")
        )
        return (F.col("input") * factor).cast(RATE)

    rated = kept.select(
        "key",
        mf.normalize_model(F.lower("key")).alias("model"),
        _per_million("input_cost_per_token").alias("input"),
        _per_million("output_cost_per_token").alias("output"),
        _per_million("cache_creation_input_token_cost").alias("w"),
        _per_million("cache_read_input_token_cost").alias("r"),
        "e",
    ).filter("input IS NOT NULL AND output IS NOT NULL")
    return first_by(
        rated.select(
            "model",
            "key",
            "input",
            "output",
            F.coalesce("w", spare(CACHE_WRITE_RATIO)).alias("cache_write"),
            F.coalesce("r", spare(CACHE_READ_RATIO)).alias("cache_read"),
        ),
        ["model"],
        ["key"],
    ).drop("key")


def scan_price_feed(spark: SparkSession, path: str) -> DataFrame:
    """(model, input, output, cache_write, cache_read) in USD per million."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(
        F.explode(F.from_json("value", schemas.PRICE_FEED)).alias("key", "e")
    )
    return rates_from_entries(entries)
