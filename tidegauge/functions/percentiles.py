"""Exact percentiles (linear interpolation between ranks) over groups of any size.

Spark's own `percentile` keeps every distinct value of a group in one task. Here a
first pass counts values per logarithmic cell - a few hundred rows per group, combined
before the shuffle - and finds the cells that hold a wanted rank. Only the values of
those blocks are counted and ordered in a second pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.segments import BLOCKS_PER_EFOLD, INFINITE_BLOCK, NAN_BLOCK, Edges, counted, deal, find_edges, running_total, value_block
from tidegauge.functions.sizing import BROADCAST_ROWS, settle

# Values one task should order at most; a fuller block is cut finer first.
TASK_VALUES = 5_000_000
FINER = 64
# 2**-52 relative resolution is reached after a few cuts; equal values are counted, not listed.
FINEST_PER_EFOLD = BLOCKS_PER_EFOLD * FINER**5


def _ranks(prob: float) -> tuple[str, str]:
    """Ranks below and above a quantile, from 0, as SQL over `_total`."""
    at = f"{prob!r}D * (_total - 1)"
    return f"cast(floor({at}) as bigint)", f"cast(ceil({at}) as bigint)"


def _holds(rank: str) -> str:
    """The row ends at `_upto` and stands for `_n` values; does it hold the rank?"""
    return f"({rank} >= _upto - _n and {rank} < _upto)"


def _any_rank(probs: Sequence[float]) -> str:
    return " or ".join(_holds(rank) for prob in probs for rank in _ranks(prob))


def _interpolate(cum: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], also: Sequence[Column] = (), names: Sequence[str] = ()) -> DataFrame:
    """Read the values at the wanted ranks off rows with `_upto`, `_n`, `_total`; `also` are further aggregates."""
    picks = ["max(_total) as _total"]
    results = []
    for i, prob in enumerate(probs):
        for name, rank in zip(("low", "high"), _ranks(prob), strict=True):
            picks.append(f"max(case when {_holds(rank)} then {value} end) as _{name}{i}")
        at = f"({prob!r}D * (_total - 1))"
        share = f"({at} - floor({at}))"
        # A value is not multiplied by a share of 0, which would lose an infinity.
        between = f"case when {share} = 0 then _low{i} else _low{i} * (1.0D - {share}) + _high{i} * {share} end"
        results.append(f"case when _nan then double('NaN') else {between} end")
    picks.append(f"coalesce(bool_or(isnan({value})), false) as _nan")
    found = cum.groupBy(*keys).agg(*[F.expr(pick) for pick in picks], *also)
    return found.selectExpr(*keys, f"array({', '.join(results)}) as quantiles", "cast(_total as bigint) as samples", *names)


def ordered_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], weight: str | None = None
) -> DataFrame:
    """One lazy pass: order all counted values. For groups that were narrowed already."""
    counts = counted(df, keys, value, value_block(F.col(value)), weight)
    return _interpolate(running_total(counts, keys, [value], "_n"), keys, value, probs)


def grouped_stats(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    weight: str,
    also: dict[str, Column] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """`(keys, samples, mean, max, quantiles)` and the aggregates `also` over the rows, for very many groups.

    A histogram per group would be about as long as a small group itself. Here the rows of a group
    are ordered once, in its blocks (`find_edges`), and everything is read off that order; groups
    are one block unless they are large. Keys must not be null; null values are ignored. `df` is
    counted first, so it should be settled. With `parts` (of `segments.key_parts`, for these rows or
    more) no group is large: nothing is counted and the rows are dealt out by key once.
    """
    also = also or {}
    rows = deal(df.where(F.col(value).isNotNull()), keys, parts)
    edges = Edges(tuple(keys), None) if parts else find_edges(rows, keys, value)
    n = F.col("_n")
    simple = [(F.sum(F.col(value) * n) / F.sum(n)).alias("mean"), F.max(value).alias("max")]
    if edges.table is not None:
        counts = counted(edges.place(rows, value), keys, value, F.col("_block"), weight)
        found = _interpolate(running_total(counts, keys, [value], "_n"), keys, value, probs, simple, ["mean", "max"])
        return found.join(rows.groupBy(*keys).agg(*[c.alias(name) for name, c in also.items()]), list(keys)) if also else found
    whole = Window.partitionBy(*keys)
    upto = F.sum(weight).over(whole.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = rows.withColumns({"_n": F.col(weight), "_upto": upto, "_total": F.sum(weight).over(whole)})
    more = [c.alias(name) for name, c in also.items()]
    return _interpolate(ranked, keys, value, probs, [*simple, *more], ["mean", "max", *also])


@dataclass(frozen=True)
class _Pass:
    """First pass over the values: settled cell counts and the rows they came from."""

    keys: list[str]
    rows: DataFrame
    cells: DataFrame


def _count_cells(df: DataFrame, keys: Sequence[str], value: str, weight: str | None, moments: bool) -> _Pass:
    rows = df.select(
        *keys,
        F.col(value).cast("double").alias("_value"),
        (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"),
    ).where(F.col("_value").isNotNull())
    data = rows.withColumn("_cell", value_block(F.col("_value")))
    # Weighted moments around the edge of the cell, from which a value is off by a small share.
    edge = F.signum(F.col("_cell").cast("double")) * F.exp(F.abs("_cell") / BLOCKS_PER_EFOLD - 1000)
    edge = F.when(F.col("_cell") == 0, 0.0).when(F.abs("_cell") < INFINITE_BLOCK, edge)
    off = F.coalesce(F.col("_value") - edge, F.col("_value"))
    shift, square = F.sum(off * F.col("_w")) / F.sum("_w"), F.sum(off * off * F.col("_w")) / F.sum("_w")
    deviation = F.sqrt(F.greatest(square - shift * shift, F.lit(0.0)))
    spread = [(F.coalesce(F.first(edge), F.lit(0.0)) + shift).alias("_mean"), deviation.alias("_std")] if moments else []
    edges = [F.min("_value").alias("_min"), F.max("_value").alias("_max")] if moments else []
    cells = settle(data.groupBy(*keys, "_cell").agg(F.sum("_w").alias("_n"), *spread, *edges))
    return _Pass(list(keys), data, cells)


def _quantiles(first: _Pass, probs: Sequence[float], task_values: int, broadcast_rows: int) -> DataFrame:
    """Second pass: count and order only the values of cells that hold a wanted rank."""
    keys, data = first.keys, first.rows
    per_efold = BLOCKS_PER_EFOLD
    running = Window.unboundedPreceding, Window.currentRow
    total = F.sum("_n").over(Window.partitionBy(*keys))
    cells = first.cells.select(*keys, "_cell", "_n", F.lit(0).cast("long").alias("_below"), total.alias("_total"))
    group = keys
    while True:
        ordered = Window.partitionBy(*group).orderBy("_cell").rowsBetween(*running)
        placed = cells.withColumn("_upto", F.col("_below") + F.sum("_n").over(ordered))
        # Not-a-number is read wherever it stands: one makes every percentile of its group one.
        side = placed.where(f"{_any_rank(probs)} or _cell = {NAN_BLOCK}").select(
            *keys, "_cell", (F.col("_upto") - F.col("_n")).alias("_below"), "_total", "_n"
        )
        if group is not keys:
            side = settle(side)
        size, fullest = side.agg(F.count(F.lit(1)), F.max("_n")).first()
        side = side.drop("_n")
        data = data.join(F.broadcast(side) if size <= broadcast_rows else side, [*keys, "_cell"])
        if (fullest or 0) <= task_values or per_efold >= FINEST_PER_EFOLD:
            break
        # A cell is too full for one task: cut the wanted cells finer and look again.
        per_efold *= FINER
        data = data.withColumnRenamed("_cell", "_outer").withColumn("_cell", value_block(F.col("_value"), per_efold))
        cells = data.groupBy(*keys, "_outer", "_below", "_total", "_cell").agg(F.sum("_w").alias("_n"))
        data = data.drop("_outer", "_below", "_total")
        group = [*keys, "_outer"]
    counts = data.groupBy(*keys, "_cell", "_below", "_total", "_value").agg(F.sum("_w").alias("_n"))
    inside = Window.partitionBy(*keys, "_cell").orderBy("_value").rowsBetween(*running)
    return _interpolate(counts.withColumn("_upto", F.col("_below") + F.sum("_n").over(inside)), keys, "_value", probs)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    weight: str | None = None,
    task_values: int = TASK_VALUES,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Exact quantiles per key: `(keys, quantiles ARRAY<DOUBLE>, samples BIGINT)`.

    Keys must not be null; null values are ignored; groups without values are absent.
    `df` is read twice, so pass a table or a settled DataFrame. The histogram is small
    (groups x occupied cells) and is settled; the cells that hold a wanted rank are
    broadcast only when their count is within `broadcast_rows`, else joined by shuffle.
    """
    return _quantiles(_count_cells(df, keys, value, weight, False), probs, task_values, broadcast_rows)


def quantiles_of_cells(keys: Sequence[str], cells: DataFrame, values: DataFrame, probs: Sequence[float]) -> DataFrame:
    """Quantiles as in `exact_quantiles` from stored cell counts and stored values.

    `cells` are `(keys, _cell, _n)`, `values` are `(keys, _cell, _value, _w)`; of the values only those
    in cells that hold a wanted rank are ordered.
    """
    return _quantiles(_Pass(list(keys), values, cells), probs, TASK_VALUES, BROADCAST_ROWS)


def exact_stats(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], weight: str | None = None
) -> DataFrame:
    """`(keys, samples, mean, min, max, std, quantiles)` with the same two passes.

    Count, mean, extremes and population spread come from the cells of the first pass.
    A `weight` is how many equal values a row stands for.
    """
    first = _count_cells(df, keys, value, weight, True)
    whole = Window.partitionBy(*keys)
    n, mean, std = F.col("_n"), F.col("_mean"), F.col("_std")
    centre = F.sum(mean * n).over(whole) / F.sum(n).over(whole)
    simple = (
        first.cells.withColumn("_centre", centre)
        .groupBy(*keys)
        .agg(
            F.max("_centre").alias("mean"),
            F.min("_min").alias("min"),
            F.max("_max").alias("max"),
            F.sqrt(F.sum(n * (std * std + (mean - F.col("_centre")) * (mean - F.col("_centre")))) / F.sum(n)).alias("std"),
        )
    )
    return simple.join(_quantiles(first, probs, TASK_VALUES, BROADCAST_ROWS), list(keys))
