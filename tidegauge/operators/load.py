"""Shape of the load: arrivals, requests in flight, overlap of levels, replayed order.

Everything ordered works in blocks of start time. Without a `width` (seconds) the blocks of each
level or run follow its own counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import fixed
from tidegauge.functions.segments import consecutive_gaps, gap_moments, in_blocks, positions, running_total
from tidegauge.functions.sizing import broadcast_if_small
from tidegauge.operators.levels import LEVEL


def arrival_gaps(requests: DataFrame, runs: DataFrame, width: float | None = None) -> DataFrame:
    """Mean and coefficient of variation of the gaps between starts, per run and level.

    For open runs `target_mean` is one over the rate; arrivals without burstiness have a
    coefficient near 1.
    """
    gaps = consecutive_gaps(requests, list(LEVEL), "t_start", width)
    mean, std = gap_moments(F.col("gap"), F.col("n"))
    stats = gaps.groupBy(*LEVEL).agg(F.sum("n").alias("gaps"), mean.alias("mean_gap"), std.alias("_std"))
    modes = runs.select("run_id", "mode")
    return stats.join(modes, "run_id", "left").select(
        *LEVEL,
        "gaps",
        "mean_gap",
        F.when(F.col("mean_gap") > 0, F.col("_std") / F.col("mean_gap")).alias("cv"),
        F.when(F.col("mode") == fixed.OPEN, 1.0 / F.col("level_or_rate")).alias("target_mean"),
    )


def _load_steps(records: DataFrame, width: float | None) -> DataFrame:
    """Outstanding requests after each change, with the time of the next change."""
    start = records.select(*LEVEL, F.col("t_start").alias("t"), F.lit(1).alias("kind"), F.lit(1).alias("delta"))
    end = records.select(
        *LEVEL, (F.col("t_start") + F.coalesce("e2e", F.lit(0.0))).alias("t"), F.lit(0).alias("kind"), F.lit(-1).alias("delta")
    )
    # Changes of one kind at one instant are one row; at a tie ends come before starts.
    both = start.unionByName(end)
    changes = in_blocks(both, LEVEL, "t", width).groupBy(*LEVEL, "_block", "t", "kind").agg(F.sum("delta").alias("delta"))
    return running_total(changes, list(LEVEL), ["t", "kind"], "delta", with_next=True)


def in_flight(records: DataFrame, width: float | None = None) -> DataFrame:
    """Requests outstanding after each instant: `(run_id, level_or_rate, t, in_flight)`.

    Ends count before starts at the same instant, so an instant shows the load after both.
    """
    steps = _load_steps(records, width)
    return steps.groupBy(*LEVEL, "t").agg(F.max_by("_upto", "kind").alias("in_flight"))


def load_peaks(records: DataFrame, runs: DataFrame, width: float | None = None) -> DataFrame:
    """Highest load per level and the seconds spent at or above the cap of the run."""
    caps = runs.select("run_id", "max_outstanding")
    held = F.coalesce(F.col("_next") - F.col("t"), F.lit(0.0))
    return (
        _load_steps(records, width)
        .join(broadcast_if_small(caps), "run_id", "left")
        .groupBy(*LEVEL)
        .agg(
            F.max("_upto").alias("peak"),
            F.coalesce(F.sum(F.when(F.col("_upto") >= F.col("max_outstanding"), held)), F.lit(0.0)).alias("seconds_at_cap"),
        )
    )


def level_overlap(records: DataFrame) -> DataFrame:
    """Levels that start before an earlier level of their run has ended.

    Only the level spans (one row per level) are compared, in start order against the
    latest end so far, so no pairs are formed.
    """
    spans = records.groupBy(*LEVEL).agg(
        F.min("t_start").alias("span_start"), F.max(F.col("t_start") + F.coalesce("e2e", F.lit(0.0))).alias("span_end")
    )
    earlier = (
        Window.partitionBy("run_id").orderBy("span_start", "level_or_rate").rowsBetween(Window.unboundedPreceding, -1)
    )
    return spans.withColumn("earlier_end", F.max("span_end").over(earlier)).where(F.col("span_start") < F.col("earlier_end"))


def sequence_positions(requests: DataFrame, width: float | None = None) -> DataFrame:
    """Position of each request in its run, by start time and id."""
    rows = requests.select("run_id", "t_start", "request_id", "prompt_id")
    placed = in_blocks(rows, ["run_id"], "t_start", width)
    return positions(placed, ["run_id"], ["t_start", "request_id"], F.col("_block"))


def replay_prefix(requests: DataFrame, baseline: str, width: float | None = None) -> DataFrame:
    """How far each run sends the same prompts in the same order as the baseline run."""
    ordered = sequence_positions(requests, width).select("run_id", "position", "prompt_id")
    ours = ordered.where(F.col("run_id") != baseline)
    theirs = ordered.where(F.col("run_id") == baseline).select("position", F.col("prompt_id").alias("expected"))
    return (
        ours.join(theirs, "position")
        .groupBy("run_id")
        .agg(
            F.count(F.lit(1)).alias("compared"),
            F.min(F.when(~F.col("prompt_id").eqNullSafe(F.col("expected")), F.col("position"))).alias("first_mismatch"),
        )
        .withColumn("common_prefix", F.coalesce(F.col("first_mismatch") - 1, F.col("compared")))
    )
