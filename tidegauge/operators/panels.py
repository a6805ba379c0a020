"""Dashboard panels: pivot steady successes of each run into chart series.

All panels of a dashboard are computed by one aggregation and one percentile pass. Results are long rows `(panel, run_id, series, x, x_position,
g_position, value, chart)`; the grid of every x with every group is dense unless asked otherwise.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import fixed, scalars, segments
from tidegauge.functions.percentiles import exact_quantiles
from tidegauge.functions.sizing import settle
from tidegauge.operators.levels import steady_success

NO_GROUP = ""


class PanelError(ValueError):
    """A panel that names an unknown dimension, metric, aggregate or chart."""


@dataclass(frozen=True)
class Value:
    """One series: a metric and how to reduce it (rates ignore the aggregate)."""

    metric: str
    agg: str = "p50"

    def __post_init__(self) -> None:
        if self.metric not in fixed.PANEL_METRICS and self.metric not in fixed.PANEL_RATES:
            raise PanelError(f"unknown metric {self.metric!r}")
        if self.agg not in fixed.PANEL_AGGREGATES:
            raise PanelError(f"unknown aggregate {self.agg!r}")

    @property
    def column(self) -> str:
        return f"{self.metric}_{self.agg}"

    @property
    def label(self) -> str:
        if self.metric in fixed.PANEL_RATES:
            return f"{self.metric} ({fixed.PANEL_RATES[self.metric]})"
        unit = fixed.PANEL_METRICS[self.metric][2]
        return f"{self.metric} {self.agg}" + (f" ({unit})" if unit in fixed.UNITS_IN_SERIES_NAMES else "")


@dataclass(frozen=True)
class Panel:
    title: str
    x: str
    values: tuple[Value, ...]
    group: str | None = None
    chart: str = "auto"

    def __post_init__(self) -> None:
        for name in (self.x, self.group):
            if name is not None and name not in fixed.PANEL_DIMENSIONS:
                raise PanelError(f"panel {self.title!r}: {name!r} is no dimension")
        if self.chart not in ("line", "bar", "auto"):
            raise PanelError(f"panel {self.title!r}: chart must be line, bar or auto")
        if not self.values:
            raise PanelError(f"panel {self.title!r}: at least one value is needed")


# The five starter panels.
STARTER_PANELS = (
    Panel("Latency vs load", "level_or_rate", (Value("ttft", "p50"), Value("ttft", "p99"), Value("e2e", "p50"), Value("e2e", "p99"))),
    Panel("Throughput vs load", "level_or_rate", (Value("system_tok_s", "mean"), Value("rps", "mean"))),
    Panel("E2E latency by output length", "level_or_rate", (Value("e2e", "p50"),), group="osl_bucket"),
    Panel("Tokens per request vs load", "level_or_rate", (Value("input_tokens", "p50"), Value("output_tokens", "p50"))),
    Panel("Quality score vs load", "level_or_rate", (Value("quality_score", "mean"), Value("quality_score", "p50"))),
)


# -- definitions in a table -------------------------------------------------------

def check_definitions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Panel definitions (`schemas.PANEL_DDL`) with defaults filled in, and the rejected ones with the first `reason`.

    A missing title is the panel's number, a missing chart `auto`, a missing aggregate `p50`; an empty
    group is none.
    """
    filled = rows.select(
        "position",
        F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Panel "), F.col("position").cast("string"))).alias("title"),
        F.coalesce("x", F.lit("")).alias("x"),
        F.nullif("group", F.lit("")).alias("group"),
        F.coalesce(F.nullif("chart", F.lit("")), F.lit("auto")).alias("chart"),
        F.transform(
            F.coalesce("values", F.array().cast("array<struct<metric:string,agg:string>>")),
            lambda v: F.struct(F.coalesce(v["metric"], F.lit("")).alias("metric"), F.coalesce(F.nullif(v["agg"], F.lit("")), F.lit("p50")).alias("agg")),
        ).alias("values"),
    )
    metrics = [*fixed.PANEL_METRICS, *fixed.PANEL_RATES]
    reason = (
        F.when(~F.col("x").isin(*fixed.PANEL_DIMENSIONS), "x is no dimension")
        .when(F.col("group").isNotNull() & ~F.col("group").isin(*fixed.PANEL_DIMENSIONS), "group is no dimension")
        .when(~F.col("chart").isin("line", "bar", "auto"), "chart must be line, bar or auto")
        .when(F.size("values") == 0, "at least one value is needed")
        .when(F.exists("values", lambda v: ~v["metric"].isin(*metrics)), "unknown metric")
        .when(F.exists("values", lambda v: ~v["agg"].isin(*fixed.PANEL_AGGREGATES)), "unknown aggregate")
    )
    checked = filled.withColumn("reason", reason)
    return checked.where(F.col("reason").isNull()).drop("reason"), checked.where(F.col("reason").isNotNull())


def panels_of(rows: DataFrame) -> list[Panel]:
    """Panels of a definition table, in order. The first rejected definition is a `PanelError`.

    One row per panel reaches the driver.
    """
    good, bad = check_definitions(rows)
    first = bad.orderBy("position", "title").first()
    if first:
        raise PanelError(f"panel {first['title']!r}: {first['reason']}")
    found = [
        Panel(row["title"], row["x"], tuple(Value(v["metric"], v["agg"]) for v in row["values"]), row["group"], row["chart"])
        for row in good.orderBy("position", "title").collect()
    ]
    if not found:
        raise PanelError("a dashboard needs at least one panel")
    return found


# -- cells -----------------------------------------------------------------------


def _scaled(metric: str) -> Column:
    column, scale, _ = fixed.PANEL_METRICS[metric]
    return F.col(column).cast("double") * scale


def rate(metric: str) -> Column:
    """Aggregate: requests or output tokens per second of the cell's own window; null without one."""
    window = F.max(F.col("t_start") + F.col("e2e")) - F.min("t_start")
    amount = F.count(F.lit(1)) if metric == "rps" else F.coalesce(F.sum("output_tokens"), F.lit(0))
    return F.when(window > 0, amount / window)


def reduce_values(value: Column, agg: str) -> Column:
    """Aggregate of one metric; `count` counts its values."""
    return {"mean": F.avg, "max": F.max, "min": F.min}.get(agg, lambda c: F.count(c).cast("double"))(value)


def _simple(value: Value) -> bool:
    return value.metric in fixed.PANEL_RATES or value.agg not in fixed.PANEL_PERCENTILES


def cells(records: DataFrame, axes: Sequence[tuple[str, str | None, Sequence[Value]]], key: str = "run_id") -> DataFrame:
    """`(key, axes, x, g, <metric>_<agg>...)` of the occupied cells of several axis pairs.

    `axes` lists `(x, group, values)`; the column `axes` is the place in that list. All
    pairs share one aggregation and one percentile pass. Rows with a null x or g only
    mark axis values. A column that a pair did not ask for may be null.
    """
    by = [key, "axes", "x", "g"]
    rows = steady_success(records)

    def place(i: int) -> list[Column]:
        x, group, _ = axes[i]
        g = F.col(group).cast("string") if group else F.lit(NO_GROUP)
        return [F.lit(i).alias("axes"), F.col(x).cast("string").alias("x"), g.alias("g")]

    values = list(dict.fromkeys(v for _, _, vs in axes for v in vs))
    simple = [
        (rate(v.metric) if v.metric in fixed.PANEL_RATES else reduce_values(_scaled(v.metric), v.agg)).alias(v.column)
        for v in values
        if _simple(v)
    ]
    placed = rows.select("*", F.inline(F.array(*[F.struct(*place(i)) for i in range(len(axes))])))
    result = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), *simple).drop("_rows")
    wanted = [v for v in values if not _simple(v)]
    if wanted:
        aggs = sorted({v.agg for v in wanted})
        items = [
            F.struct(*place(i), F.lit(m).alias("metric"), _scaled(m).alias("value"))
            for i, (_, _, vs) in enumerate(axes)
            for m in sorted({v.metric for v in vs if not _simple(v)})
        ]
        long = rows.select(key, F.inline(F.array(*items))).where(F.col("x").isNotNull() & F.col("g").isNotNull())
        quantiles = exact_quantiles(long, [*by, "metric"], "value", [fixed.PANEL_PERCENTILES[a] for a in aggs])
        found = quantiles.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("metric", "quantiles"))).alias("_q"))
        picks = [F.col("_q")[v.metric][aggs.index(v.agg)].alias(v.column) for v in wanted]
        result = result.join(found.select(*by, *picks), by, "left")
    return result


# -- axes ------------------------------------------------------------------------


def distinct_axis(records: DataFrame, dimension: str, key: str = "run_id") -> DataFrame:
    """Distinct values of a dimension per run, nulls dropped."""
    return (
        steady_success(records)
        .select(key, F.col(dimension).cast("string").alias("x"))
        .where(F.col("x").isNotNull())
        .distinct()
    )


def order_axis(axis: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Add `x_position` (from 1) and `numeric` to the distinct axis values of each run.

    Numbers ascend when all values are numbers; otherwise buckets come by size and then
    text. The values are the distinct marks of one chart axis; an axis with more of them than a
    block holds is numbered by ranges, so no axis is ever sorted in one task. `axis` is counted
    first, so it should be settled or cheap.
    """
    rank = F.lit(99)
    for position, name in enumerate(fixed.BUCKETS):
        rank = F.when(F.col("x") == name, position).otherwise(rank)
    longest = axis.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if longest <= segments.BLOCK_ROWS:
        marked = axis.withColumn("numeric", F.min(scalars.is_number(F.col("x"))).over(Window.partitionBy(*keys)))
    else:
        marked = axis.join(axis.groupBy(*keys).agg(F.min(scalars.is_number(F.col("x"))).alias("numeric")), list(keys))
    order = {"_number": F.when(F.col("numeric"), F.col("x").try_cast("double")), "_rank": F.when(~F.col("numeric"), rank)}
    marked = marked.withColumns(order)
    if longest <= segments.BLOCK_ROWS:
        placed = marked.withColumn("x_position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "x")))
    else:
        placed = segments.range_positions(marked, keys, [*order, "x"], "x_position")
    return placed.withColumn("x_position", F.col("x_position").cast("int")).drop(*order)


def dense_grid(occupied: DataFrame, key: str = "run_id", zero: Sequence[str] = (), dense: bool = True) -> DataFrame:
    """Cells with the positions of their x and of their group, both ordered as axes are.

    With `dense`, every x of a run comes with every group of that run; without it, only the occupied
    cells do, as many as there are points. Absent `zero` columns are 0. Pass a settled table.
    """
    keys = [key, "axes"]
    xs = order_axis(occupied.where(F.col("x").isNotNull()).select(*keys, "x").distinct(), keys)
    marks = order_axis(occupied.where(F.col("g").isNotNull()).select(*keys, F.col("g").alias("x")).distinct(), keys)
    groups = marks.select(*keys, F.col("x").alias("g"), F.col("x_position").alias("g_position"))
    if dense:
        grid = groups.join(xs, keys).join(occupied, [*keys, "x", "g"], "left")
    else:
        grid = occupied.join(xs, [*keys, "x"]).join(groups, [*keys, "g"])
    return grid.withColumns({name: F.coalesce(F.col(name), F.lit(0.0)) for name in zero})


def counted_values(values: Iterable[Value]) -> list[str]:
    """Columns in which an empty cell counts 0: counts of metrics, not rates."""
    return list(dict.fromkeys(v.column for v in values if v.agg == "count" and v.metric not in fixed.PANEL_RATES))


def series_name(label: Column, group: Column) -> Column:
    """Legend text; the group, when there is one, in brackets."""
    return F.when(group == NO_GROUP, label).otherwise(F.concat(label, F.lit(" ["), group, F.lit("]")))


def chart_kind(chart: str) -> Column:
    return F.when(F.col("numeric"), "line").otherwise("bar") if chart == "auto" else F.lit(chart)


# -- panels ----------------------------------------------------------------------


def compute_panels(records: DataFrame, panels: Sequence[Panel], key: str = "run_id", dense: bool = True) -> DataFrame:
    """Long series of several panels; `dense` as in `dense_grid`. `records` is read a few times; pass a written table."""
    shared: dict[tuple[str, str | None], list[Panel]] = defaultdict(list)
    for panel in panels:
        shared[(panel.x, panel.group)].append(panel)
    axes = [(x, g, list(dict.fromkeys(v for p in members for v in p.values))) for (x, g), members in shared.items()]
    # Settled, because axes, groups and cells are all read from it; one row per chart point.
    grid = dense_grid(settle(cells(records, axes, key)), key, counted_values(v for _, _, values in axes for v in values), dense)
    rows = [
        F.struct(
            F.lit(i).alias("_axes"),
            F.lit(panel.title).alias("panel"),
            series_name(F.lit(value.label), F.col("g")).alias("series"),
            F.col(value.column).alias("value"),
            chart_kind(panel.chart).alias("chart"),
        )
        for i, members in enumerate(shared.values())
        for panel in members
        for value in panel.values
    ]
    points = grid.select(key, "axes", "x", "x_position", "g_position", F.inline(F.array(*rows)))
    return points.where(F.col("axes") == F.col("_axes")).drop("axes", "_axes")


def compute_panel(records: DataFrame, panel: Panel, key: str = "run_id", dense: bool = True) -> DataFrame:
    return compute_panels(records, [panel], key, dense)
