"""Per-level and per-run aggregates over request records.

Everything that is algebraic is one `groupBy(run, level)` with partial aggregation, so
the shuffle carries one row per task and level. Exact percentiles and the token-gap
pool use the counted-block pass of `functions.percentiles`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import fixed, scalars
from tidegauge.functions.percentiles import exact_stats
from tidegauge.functions.segments import deal, key_parts
from tidegauge.functions.sizing import broadcast_if_small, settle

LEVEL = ("run_id", "level_or_rate")

# Metric in the summary -> record column.
METRICS = {
    "ttft": "ttft",
    "tpot": "tpot",
    "e2e": "e2e",
    "input_tokens": "prompt_tokens",
    "output_tokens": "output_tokens",
}
PROBS = (0.5, 0.9, 0.95, 0.99, 0.999)
STATS = ("mean", "min", "max", "std", "p50", "p90", "p95", "p99", "p999")


# -- filters -------------------------------------------------------------------


def is_steady() -> Column:
    return F.col("phase") == fixed.STEADY


def is_success() -> Column:
    return F.col("outcome") == fixed.SUCCESS


def steady_success(records: DataFrame) -> DataFrame:
    return records.where(is_steady() & is_success())


# -- service-level targets -----------------------------------------------------


def slo_meeting(records: DataFrame, runs: DataFrame, slo: DataFrame) -> DataFrame:
    """Add the targets of the run's profile and `meets_slo`. An unknown profile bounds nothing."""
    profile = slo.withColumnRenamed("name", "slo_profile")
    targets = runs.select("run_id", "slo_profile").join(profile, "slo_profile", "left").drop("slo_profile")
    test = scalars.meets_slo(*[F.col(name) for name in ("ttft", "tpot", "e2e", "ttft_ms", "tpot_ms", "e2e_ms")])
    # One row per run: counted, so that records are not shuffled by run.
    return records.join(broadcast_if_small(targets), "run_id", "left").withColumn("meets_slo", test)


# -- percentile objects --------------------------------------------------------


def _long(df: DataFrame, keys: Sequence[str], metrics: dict[str, str], weight: str | None = None) -> DataFrame:
    """One row per metric value: `(keys, metric, value, n)`."""
    cells = F.array(
        *[F.struct(F.lit(name).alias("metric"), F.col(column).cast("double").alias("value")) for name, column in metrics.items()]
    )
    n = F.col(weight) if weight else F.lit(1).cast("long")
    return df.select(*keys, n.alias("n"), F.inline(cells)).where(F.col("value").isNotNull())


def value_stats(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`(keys, metric, samples, mean, min, max, std, p50..p999)` of long rows.

    A row stands for `n` equal values; only zeros may repeat (gap rows), everything else
    has `n = 1`. The standard deviation is that of the population. p999 needs 1000
    samples of its own metric.
    """
    by = [*keys, "metric"]
    q = F.col("quantiles")
    return exact_stats(long, by, "value", PROBS, weight="n").select(
        *by, "samples", "mean", "min", "max", "std",
        *[q[i].alias(name) for i, name in enumerate(("p50", "p90", "p95", "p99"))],
        F.when(F.col("samples") >= fixed.P999_SAMPLES, q[4]).alias("p999"),
    )


def percentile_objects(records: DataFrame, keys: Sequence[str] = LEVEL) -> DataFrame:
    """Percentile object of every metric over steady successes, one row per key and metric."""
    return value_stats(_long(steady_success(records), keys, METRICS), keys)


def gap_pool(records: DataFrame, keys: Sequence[str] = LEVEL, gaps: DataFrame | None = None) -> DataFrame:
    """All token gaps of steady successes: `(keys, metric='itl', value, n)`, token-weighted.

    With `gaps` (rows of `records.inter_token_gaps`) no record's list is read.
    """
    chosen = steady_success(records)
    if gaps is None:
        pool = chosen.select(*keys, F.explode("itl_list").alias("value"), F.lit(1).cast("long").alias("n"))
    else:
        parts = key_parts(gaps, ["request_id"])
        ours = deal(chosen.select("request_id", *keys), ["request_id"], parts)
        theirs = deal(gaps.select("request_id", F.col("gap").alias("value"), "n"), ["request_id"], parts)
        # The pool is read in several passes; the join is done once.
        pool = settle(ours.join(theirs, "request_id").select(*keys, "value", "n"))
    return pool.select(*keys, F.lit("itl").alias("metric"), "value", "n")


def _wide(stats: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per key with a column per metric and statistic (a key has one row per metric)."""
    objects = F.map_from_entries(F.collect_list(F.struct("metric", F.struct(*STATS)))).alias("_objects")
    rows = stats.groupBy(*keys).agg(objects)
    return rows.selectExpr(*keys, *[f"_objects['{m}'].{s} as {m}_{s}" for m in metrics for s in STATS])


# -- algebraic level aggregates --------------------------------------------------


def _count_if(condition: Column) -> Column:
    return F.coalesce(F.count_if(condition), F.lit(0))


def window_seconds(where: Column) -> Column:
    """Aggregate: from the first start to the last end of the chosen rows, never negative."""
    end = F.max(F.when(where, F.col("t_start") + F.coalesce("e2e", F.lit(0.0))))
    return F.coalesce(F.greatest(end - F.min(F.when(where, F.col("t_start"))), F.lit(0.0)), F.lit(0.0))


def _rate(amount: Column, window: Column) -> Column:
    return F.when(window > 0, amount / window).otherwise(F.lit(0.0))


def _sum_if(where: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(where, value)), F.lit(0).cast("long"))


def reliability_aggregates() -> list[Column]:
    steady, ok = is_steady(), is_success()
    return [
        _count_if(steady).alias("steady_samples"),
        _count_if(steady & ok).alias("completed"),
        _count_if(steady & ~ok).alias("failed"),
        _count_if(steady & (F.col("outcome") == fixed.RATE_LIMITED)).alias("rate_limited"),
    ]


def throughput_aggregates() -> list[Column]:
    chosen = is_steady() & is_success()
    generation = F.col("e2e") - F.col("ttft")
    speed = F.when(chosen & (generation > 0) & (F.col("output_tokens") > 0), F.col("output_tokens") / generation)
    return [
        window_seconds(chosen).alias("steady_window_s"),
        F.coalesce(F.avg(speed), F.lit(0.0)).alias("per_user_tok_s"),
        _sum_if(chosen, F.col("output_tokens")).alias("sum_output"),
        _sum_if(chosen, F.col("output_tokens") + F.col("prompt_tokens")).alias("sum_total"),
    ]


def add_reliability(levels: DataFrame) -> DataFrame:
    share = F.col("rate_limited") / F.greatest("steady_samples", F.lit(1))
    return levels.withColumn("rate_limited_rate", share).withColumn(
        "rate_limited_flagged", F.col("rate_limited_rate") > fixed.RATE_LIMITED_SHARE
    )


def add_rates(levels: DataFrame) -> DataFrame:
    window = F.col("steady_window_s")
    return levels.withColumns(
        {
            "system_tok_s": _rate(F.col("sum_output"), window),
            "total_tok_s": _rate(F.col("sum_total"), window),
            "rps": _rate(F.col("completed"), window),
        }
    ).drop("sum_output", "sum_total")


def add_goodput(levels: DataFrame) -> DataFrame:
    count, window = F.col("goodput_count"), F.col("steady_window_s")
    return levels.withColumns(
        {
            "goodput_attainment": F.when(F.col("completed") > 0, count / F.col("completed")).otherwise(F.lit(0.0)),
            "goodput_rps": _rate(count, window),
        }
    )


def reliability(records: DataFrame, keys: Sequence[str] = LEVEL) -> DataFrame:
    return add_reliability(records.groupBy(*keys).agg(*reliability_aggregates()))


def throughput(records: DataFrame, keys: Sequence[str] = LEVEL) -> DataFrame:
    chosen = is_steady() & is_success()
    return add_rates(records.groupBy(*keys).agg(_count_if(chosen).alias("completed"), *throughput_aggregates()))


def goodput(records: DataFrame, runs: DataFrame, slo: DataFrame, keys: Sequence[str] = LEVEL) -> DataFrame:
    chosen = is_steady() & is_success()
    counts = slo_meeting(records, runs, slo).groupBy(*keys).agg(
        _count_if(chosen).alias("completed"),
        _count_if(chosen & F.col("meets_slo")).alias("goodput_count"),
        window_seconds(chosen).alias("steady_window_s"),
    )
    return add_goodput(counts)


def level_cost(records: DataFrame, keys: Sequence[str] = LEVEL) -> DataFrame:
    """Cost of steady successes; null for a model without prices, 0 for a priced level without any."""
    chosen = is_steady() & is_success()
    count = _count_if(chosen)
    # A priced request has a cost whether it succeeds or not.
    priced = F.count("cost_usd") > 0
    total = F.when(priced, F.coalesce(F.sum(F.when(chosen, F.col("cost_usd"))), F.lit(0.0)))
    per_1k = F.when(priced, F.when(count > 0, total / count * 1000.0).otherwise(0.0))
    return records.groupBy(*keys).agg(count.alias("completed"), total.alias("total_cost_usd"), per_1k.alias("cost_per_1k_requests"))


def counters(records: DataFrame, keys: Sequence[str] = LEVEL) -> DataFrame:
    """Incomplete usage and cache violations, among steady successes and over all phases."""
    chosen = is_steady() & is_success()
    usage, cache = F.col("usage_incomplete"), F.col("cache_violation")
    return records.groupBy(*keys).agg(
        _count_if(chosen & usage).alias("usage_incomplete_count"),
        _count_if(chosen & cache).alias("cache_busting_violations"),
        _count_if(usage).alias("usage_incomplete_all_phases"),
        _count_if(cache).alias("cache_violations_all_phases"),
    )


# -- the summary -----------------------------------------------------------------


def level_summary(
    records: DataFrame,
    run_levels: DataFrame,
    runs: DataFrame,
    models: DataFrame,
    slo: DataFrame,
    gaps: DataFrame | None = None,
) -> DataFrame:
    """One row per configured level: reliability, percentiles, throughput, goodput, cost.

    `records` is read several times; pass a written table (see `sizing.settle`).
    Records at levels that are not configured are ignored; levels without records get
    zero counts and null metrics.
    """
    keys = list(LEVEL)
    chosen = is_steady() & is_success()
    facts = slo_meeting(records, runs, slo).groupBy(*keys).agg(
        *reliability_aggregates(),
        *throughput_aggregates(),
        _count_if(chosen & F.col("meets_slo")).alias("goodput_count"),
        _count_if(chosen & F.col("usage_incomplete")).alias("usage_incomplete_count"),
        _count_if(chosen & F.col("cache_violation")).alias("cache_busting_violations"),
        F.sum(F.when(chosen, F.col("cost_usd"))).alias("_cost"),
    )
    values = _long(steady_success(records), keys, METRICS).unionByName(gap_pool(records, keys, gaps))
    metrics = [*METRICS, "itl"]
    wide = _wide(value_stats(values, keys), keys, metrics)
    return _finish(configured_levels(run_levels), facts, wide, runs, models)


def configured_levels(run_levels: DataFrame) -> DataFrame:
    """A level configured twice is one level."""
    return run_levels.groupBy(*LEVEL).agg(F.max("max_outstanding_events").alias("max_outstanding_events"))


def _finish(levels: DataFrame, facts: DataFrame, wide: DataFrame, runs: DataFrame, models: DataFrame) -> DataFrame:
    keys = list(LEVEL)
    settings = runs.join(models.withColumnRenamed("name", "model_name"), "model_name", "left").select(
        "run_id", "mode", "model", "min_samples",
        (F.col("price_input").isNotNull() & F.col("price_output").isNotNull()).alias("_priced"),
    )
    zero = F.lit(0).cast("long")
    joined = levels.join(settings, "run_id", "left").join(facts, keys, "left").join(wide, keys, "left")
    counts = (
        "steady_samples", "completed", "failed", "rate_limited", "goodput_count", "sum_output",
        "sum_total", "usage_incomplete_count", "cache_busting_violations",
    )
    joined = joined.withColumns(
        {name: F.coalesce(F.col(name), zero) for name in counts}
        | {name: F.coalesce(F.col(name), F.lit(0.0)) for name in ("steady_window_s", "per_user_tok_s")}
    )
    joined = add_goodput(add_rates(add_reliability(joined)))
    cost = F.when(F.col("_priced"), F.coalesce("_cost", F.lit(0.0)))
    per_1k = F.when(
        F.col("_priced"),
        F.when(F.col("completed") > 0, F.coalesce("_cost", F.lit(0.0)) / F.col("completed") * 1000.0).otherwise(0.0),
    )
    return joined.withColumns(
        {
            "latency_sample_count": F.col("completed"),
            "min_samples_met": F.col("steady_samples") >= F.greatest("min_samples", F.lit(1)),
            "total_cost_usd": cost,
            "cost_per_1k_requests": per_1k,
            "max_outstanding_events": F.when(F.col("mode") == fixed.OPEN, F.coalesce("max_outstanding_events", zero)),
        }
    ).drop("min_samples", "_priced", "_cost")


def union_modes(closed: DataFrame, open_: DataFrame) -> DataFrame:
    """Closed levels and open rates share one row shape; only rates carry the guard counter."""
    return closed.unionByName(open_, allowMissingColumns=True)


def run_cost(levels: DataFrame) -> DataFrame:
    """Run cost over its levels; per 1000 completed requests."""
    total, count = F.sum("total_cost_usd"), F.sum("completed")
    return levels.groupBy("run_id").agg(
        total.alias("total_cost_usd"),
        count.alias("completed"),
        F.when(total.isNotNull(), F.when(count > 0, total / count * 1000.0).otherwise(0.0)).alias("cost_per_1k_requests"),
    )


def run_summary(records: DataFrame, runs: DataFrame, models: DataFrame) -> DataFrame:
    """Counters of each run over all phases; a run without records has zeros."""
    counts = records.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("requests"),
        _count_if(F.col("usage_incomplete")).alias("usage_incomplete_count"),
        _count_if(F.col("cache_violation")).alias("cache_busting_violations"),
    )
    names = models.select(F.col("name").alias("model_name"), "model")
    settings = runs.select("run_id", "mode", "model_name").join(names, "model_name", "left").drop("model_name")
    zero = F.lit(0).cast("long")
    return settings.join(counts, "run_id", "left").withColumns(
        {name: F.coalesce(F.col(name), zero) for name in ("requests", "usage_incomplete_count", "cache_busting_violations")}
    )


def run_report(summary: DataFrame, levels: DataFrame, coverage: DataFrame, skipped: DataFrame) -> DataFrame:
    """The run block of a summary: counters, cost, judged share, skipped prompts and the levels.

    `summary` is `run_summary`; the other tables have one row per run or level. Runs without an
    evaluation or without levels have zeros and an empty list.
    """
    counts = ("judged", "total_eligible", "dropped", "tools_unsupported", "vision_unsupported")
    joined = summary.join(run_cost(levels).drop("completed"), "run_id", "left")
    for part in (coverage, skipped, nested_summary(levels).select("run_id", "levels")):
        joined = joined.join(part, "run_id", "left")
    filled = {name: F.coalesce(F.col(name), F.lit(0).cast("long")) for name in counts}
    return joined.withColumns(
        filled | {"coverage": F.coalesce("coverage", F.lit(0.0)), "levels": F.coalesce("levels", F.array().cast(joined.schema["levels"].dataType))}
    )


def summary_rows(levels: DataFrame) -> DataFrame:
    """Display rows of the summary: milliseconds, percentages, a dash for what is absent."""
    samples = F.col("steady_samples")
    success = F.when(samples > 0, F.col("completed") / samples * 100.0).otherwise(0.0)
    cells = {f"{m}_{p}": scalars.summary_cell(F.col(f"{m}_{p}")) for m in ("e2e", "ttft") for p in ("p50", "p99")}
    return levels.select(
        "run_id",
        F.col("level_or_rate").cast("string").alias("level"),
        samples.cast("string").alias("samples"),
        *[cell.alias(name) for name, cell in cells.items()],
        F.format_string("%.1f", success).alias("success_pct"),
        F.format_string("%.1f", F.col("rate_limited_rate") * 100.0).alias("rate_limited_pct"),
    )


def nested_summary(levels: DataFrame) -> DataFrame:
    """One row per run with its levels as an array of structs (levels are few by configuration)."""
    shape = [name for name in levels.columns if name not in ("run_id", "mode", "model")]
    return levels.groupBy("run_id", "mode", "model").agg(
        F.array_sort(F.collect_list(F.struct("level_or_rate", *[c for c in shape if c != "level_or_rate"]))).alias("levels")
    )
