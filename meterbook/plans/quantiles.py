"""Exact quantiles without sorting everything in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(
    df: DataFrame, value: Column, probs: list[float], cells: int = 1024
) -> DataFrame:
    """One row with a linearly interpolated quantile per probability.

    Equal values are counted first. A histogram of ``cells`` per unit of value
    then locates the few cells that hold the wanted ranks, and only those
    cells' distinct values are ranked. The histogram has one row per occupied
    cell, so the value should span a modest range, such as a logarithm.
    """
    counts = (
        df.select(value.alias("v"))
        .filter(F.col("v").isNotNull())
        .groupBy("v")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("cell", F.floor(F.col("v") * cells))
    )
    by_cell = counts.groupBy("cell").agg(F.sum("n").alias("n"))
    earlier = (
        Window.partitionBy(F.lit(0)).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    )
    every = Window.partitionBy(F.lit(0))
    ranks = {}
    for i, q in enumerate(probs):
        spot = (F.col("total") - 1) * F.lit(q)
        ranks[f"lo{i}"], ranks[f"hi{i}"] = F.floor(spot), F.ceil(spot)
    placed = by_cell.select(
        "cell",
        "n",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("cell_before"),
        F.sum("n").over(every).alias("total"),
    )

    def covers(before, n):
        hit = F.lit(False)
        for rank in ranks.values():
            hit = hit | ((before <= rank) & (rank < before + n))
        return hit

    wanted = placed.filter(covers(F.col("cell_before"), F.col("n"))).drop("n")
    inside = Window.partitionBy("cell").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.join(wanted, "cell").withColumn(
        "before", F.col("cell_before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    )
    found = ranked.agg(
        F.max("total").alias("total"),
        *[
            F.max(F.when((F.col("before") <= r) & (r < F.col("before") + F.col("n")), F.col("v")))
            .alias(name)
            for name, r in ranks.items()
        ],
    )
    out = []
    for i, q in enumerate(probs):
        spot = (F.col("total") - 1) * F.lit(q)
        part = spot - F.floor(spot)
        low, high = F.col(f"lo{i}"), F.col(f"hi{i}")
        out.append((low + (high - low) * part).alias(f"q{i}"))
    assert all(0 <= q <= 1 and not math.isnan(q) for q in probs)
    return found.select(*out)
