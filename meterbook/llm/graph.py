"""Connected components of a link table, by joins and minima."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage


def components(links: DataFrame) -> DataFrame:
    """(id, component): for every id in ``links`` (a, b) the smallest id reachable.

    Alternates two steps until nothing changes: every vertex hands the smallest
    neighbour to its larger neighbours, then to its smaller ones. Each step keeps at
    most one row per link, is written to the shared folder, and the number of rounds
    grows with the logarithm of the longest path. Self-links keep a vertex of its own.
    A step names its input several times, so that two steps in one plan, or a digest
    taken twice, would multiply what the driver has to plan and to keep.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = _digest(edges)
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = staged(_star(both, larger=True), "links")
        small = staged(_star(large.filter("u >= v"), larger=False), "links")
        after = _digest(small)
        unstage(edges)
        unstage(large)
        edges, same, before = small, before == after, after
        if same:
            return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))


def _digest(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h)).first())


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Link each vertex's larger (or smaller) neighbours to the smallest of all."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = edges.join(least, "u")
    if larger:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return out.union(own).distinct()
