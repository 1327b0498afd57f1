"""Tolerant reads: any stored scalar becomes a number, list or instant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(value: Column) -> Column:
    """Trimmed number as DOUBLE; anything unreadable or non-finite is 0.

    Only plain decimal and exponent notation counts as a number, so the words
    and type suffixes a cast would also accept read as 0.
    """
    text = F.trim(value.cast("string"))
    plain = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    number = F.when(plain, text).try_cast("double")
    finite = F.abs(number) < float("inf")
    return F.when(finite, number).otherwise(F.lit(0.0))


def to_count(value: Column) -> Column:
    return to_number(value).try_cast("bigint")


def to_models(value: Column) -> Column:
    """List of model ids from a ``;`` or ``,`` separated string."""
    parts = F.split(F.coalesce(value, F.lit("")), "[;,]")
    return F.filter(F.transform(parts, lambda m: F.trim(m)), lambda m: m != "")


def instant_ms(value: Column) -> Column:
    """Epoch milliseconds of an ISO instant, null when it cannot be read."""
    return F.unix_millis(F.try_to_timestamp(value))
