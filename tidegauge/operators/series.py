"""Report series, as data: each is a few columns of the level summary or of the records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import fixed
from tidegauge.functions.percentiles import exact_quantiles
from tidegauge.functions.segments import counted, in_blocks, running_total
from tidegauge.operators.levels import LEVEL, is_steady, steady_success


def system_throughput(levels: DataFrame) -> DataFrame:
    return levels.select(*LEVEL, "system_tok_s")


def ttft_by_level(percentiles: DataFrame) -> DataFrame:
    return percentiles.where(F.col("metric") == "ttft").select(
        *LEVEL, F.col("p50").alias("ttft_p50"), F.col("p95").alias("ttft_p95"), F.col("p99").alias("ttft_p99")
    )


def user_throughput(levels: DataFrame) -> DataFrame:
    return levels.select(*LEVEL, "per_user_tok_s")


def ttft_against_throughput(percentiles: DataFrame, throughput: DataFrame) -> DataFrame:
    return ttft_by_level(percentiles).join(system_throughput(throughput), list(LEVEL))


def ttft_cdf(records: DataFrame) -> DataFrame:
    """Cumulative share at each distinct TTFT of a level."""
    placed = in_blocks(steady_success(records), list(LEVEL), "ttft")
    values = counted(placed, list(LEVEL), "ttft", F.col("_block"))
    return running_total(values, list(LEVEL), ["ttft"], "_n").select(
        *LEVEL, "ttft", (F.col("_upto") / F.col("_total")).alias("cdf")
    )


def ttft_cdf_grid(records: DataFrame, probs: Sequence[float]) -> DataFrame:
    """The same curve read at fixed shares, for levels with very many distinct values."""
    quantiles = exact_quantiles(steady_success(records), list(LEVEL), "ttft", probs)
    shares = F.array(*[F.lit(p) for p in probs])
    return quantiles.select(*LEVEL, F.inline(F.arrays_zip(shares.alias("cdf"), F.col("quantiles").alias("ttft"))))


def outcome_share(records: DataFrame) -> DataFrame:
    """Share of each outcome among the steady requests of a level; absent outcomes have 0."""
    counts = records.where(is_steady()).groupBy(*LEVEL).agg(
        F.count(F.lit(1)).alias("_all"), *[F.count_if(F.col("outcome") == name).alias(name) for name in fixed.OUTCOMES]
    )
    rows = [
        F.struct(F.lit(name).alias("outcome"), F.col(name).alias("requests"), (F.col(name) / F.col("_all")).alias("share"))
        for name in fixed.OUTCOMES
    ]
    return counts.select(*LEVEL, F.inline(F.array(*rows)))


COMPARED = ("rps", "system_tok_s", "ttft_p50", "e2e_p99", "goodput_attainment")


def compare_runs(levels: DataFrame, baseline: str, metrics: Sequence[str] = COMPARED) -> DataFrame:
    """Each run beside the baseline run at the same level, with differences."""
    base = levels.where(F.col("run_id") == baseline).select(
        "level_or_rate", *[F.col(name).alias(f"base_{name}") for name in metrics]
    )
    return levels.select(*LEVEL, "model", *metrics).join(base, "level_or_rate", "left").select(
        *LEVEL, "model", *metrics, *[(F.col(name) - F.col(f"base_{name}")).alias(f"delta_{name}") for name in metrics]
    )
