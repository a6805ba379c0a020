"""Connected components of a table of links, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.sizing import settle

# So many links at most are one part, which needs no shuffle.
FEW = 200_000


def components(links: DataFrame) -> DataFrame:
    """`node`, `root` (the least node of its component) for all nodes of `links` (`a`, `b`).

    Each round hangs every node's greater neighbours on its least neighbour and then every
    neighbour on the least of the smaller ones; stars are left after about log(longest chain)
    rounds. Every round is two aggregations combined before their shuffle and two joins by
    node, written to the shared folder, so no neighbourhood is ever gathered and lost executors
    cost one round at most. Few links, by their count, stay in one part: a shuffle of them would write
    many more files than rows need.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    few = edges.limit(FEW + 1).count() <= FEW
    while True:
        # No round has more rows than the first: a link becomes one link, or the same as another.
        edges = edges.coalesce(1) if few else edges
        # Large star: the greater neighbours of a node go to the least of it and its neighbours.
        both = _each(edges, ("u", "v"), ("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large.filter("u != v").distinct())
        # Small star: a node and its smaller neighbours go to the least of them.
        large = large.coalesce(1) if few else large
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        fresh = settle(_each(large.join(floor, "u"), ("v", "m"), ("u", "m")).filter("u != v").distinct())
        sign = [F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")]
        if edges.agg(*sign).first() == fresh.agg(*sign).first():
            break
        edges = fresh
    fresh = fresh.coalesce(1) if few else fresh
    roots = fresh.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(roots.select("root").distinct().select(F.col("root").alias("node"), "root"))


def _each(rows: DataFrame, *sides: tuple[str, str]) -> DataFrame:
    """`u`, `v` from each of `sides` of every row."""
    return rows.select(F.inline(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in sides])))
