"""Exact money arithmetic.

Rates are whole pico-dollars per token (a list price of 1 USD per million is
1,000,000) and multipliers are whole tenths, so one response costs a BIGINT
number of 1e-13 USD. Sums are DECIMAL and become dollars once, at six places.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

USD = "decimal(18,6)"


def units_sum(units: Column) -> Column:
    """Sum of cost units that cannot overflow."""
    return F.sum(units.cast("decimal(20,0)"))


def to_usd(units: Column) -> Column:
    """Cost units to dollars at six places, half up."""
    unit = F.lit("0.0000000000001").cast("decimal(13,13)")
    return (units.cast("decimal(24,0)") * unit).cast(USD)


def half_up(value: Column, places: int = 0) -> Column:
    """Rounding toward plus infinity on ties."""
    scale = 10.0 ** places
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def ratio(top: Column, bottom: Column, empty: float = 0.0) -> Column:
    """Plain double division with a value for an empty base."""
    base = bottom.cast("double")
    return F.when(base != 0, top.cast("double") / base).otherwise(F.lit(empty))


def nice_max(value: Column) -> Column:
    """Next of 1, 2, 2.5, 5, 7.5, 10 times a power of ten."""
    v = value.cast("double")
    power = F.pow(F.lit(10.0), F.floor(F.log10(v)))
    scaled = v / power
    step = F.when(scaled <= 1, 1.0)
    for bound in (2.0, 2.5, 5.0, 7.5):
        step = step.when(scaled <= bound, bound)
    return F.when(v <= 0, F.lit(1.0)).otherwise(step.otherwise(10.0) * power)


def period_change(current: Column, previous: Column) -> dict[str, Column]:
    """Change against a prior period as (kind, value)."""
    cur, prev = current.cast("double"), previous.cast("double")
    scale = F.abs(prev)
    times = cur / scale
    percent = (cur - prev) / scale * F.lit(100.0)
    none = (prev == 0) | prev.isNull()
    fine = F.abs(percent) < 10
    size = F.when(fine, half_up(F.abs(percent), 1)).otherwise(half_up(F.abs(percent)))
    signed = F.when(percent < 0, -size).otherwise(size)
    return {
        "kind": F.when(none, "none").when(times >= 10, "ratio").otherwise("percent"),
        "value": F.when(none, F.lit(None).cast("double"))
        .when(times >= 10, times)
        .otherwise(signed),
    }
