"""Dimension tables: models, latency targets, prompts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import fixed, scalars

TARGETS = ("ttft_ms", "tpot_ms", "e2e_ms")


def model_registry(models: DataFrame, name: str | None = None) -> DataFrame:
    """The registry with `is_default` on its first entry, or the one entry called `name`."""
    first = models.agg(F.min("position").alias("position")).withColumn("is_default", F.lit(True))
    flagged = models.join(first, "position", "left").withColumn("is_default", F.coalesce("is_default", F.lit(False)))
    return flagged if name is None else flagged.where(F.col("name") == name)


def built_in_slo(spark: SparkSession) -> DataFrame:
    rows = [(name, *[targets.get(key) for key in TARGETS]) for name, targets in fixed.SLO_PROFILES.items()]
    return spark.createDataFrame(rows, "name string, ttft_ms double, tpot_ms double, e2e_ms double")


def slo_profiles(configured: DataFrame, overrides: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """All known profiles. A configured profile replaces a built-in of its name as a whole.

    `overrides` maps a profile name to single targets that win over both; an unknown
    profile gets a row with only those targets.
    """
    built_in = built_in_slo(configured.sparkSession)
    known = configured.select("name", *TARGETS).unionByName(built_in.join(configured, "name", "left_anti"))
    if not overrides:
        return known
    rows = [(name, *[values.get(key) for key in TARGETS]) for name, values in overrides.items()]
    extra = configured.sparkSession.createDataFrame(rows, "name string, o_ttft_ms double, o_tpot_ms double, o_e2e_ms double")
    return known.join(extra, "name", "full").select(
        "name", *[F.coalesce(F.col(f"o_{key}"), F.col(key)).alias(key) for key in TARGETS]
    )


def validate_prompts(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split prompt rows into valid ones, with defaults filled in, and rejects with a reason."""
    reason = (
        F.when(F.coalesce(F.col("id"), F.lit("")) == "", "missing id")
        .when(F.coalesce(F.size("messages"), F.lit(0)) <= 0, "missing messages")
    )
    checked = raw.withColumn("_reason", reason)
    valid = checked.where(F.col("_reason").isNull()).drop("_reason").withColumns(
        {
            "category": F.coalesce("category", F.lit(fixed.DEFAULT_CATEGORY)),
            "isl_bucket": F.coalesce("isl_bucket", F.lit(fixed.DEFAULT_INPUT_BUCKET)),
            "tools": F.coalesce("tools", F.array().cast("array<string>")),
            "tool_results": F.coalesce("tool_results", F.create_map().cast("map<string,string>")),
        }
    )
    rejects = checked.where(F.col("_reason").isNotNull()).select("id", "library", F.col("_reason").alias("reason"))
    return valid, rejects


def validate_runs(runs: DataFrame) -> DataFrame:
    """One row per broken rule: `(run_id, rule)`.

    Open runs need positive rates, closed runs levels of at least 1; warmup and cooldown
    must fit into the duration; every duration must be readable.
    """
    times = {name: scalars.duration_s(F.col(name)) for name in ("duration", "warmup", "cooldown")}
    timed = runs.select("run_id", "mode", "levels", *[value.alias(name) for name, value in times.items()])
    bad_rate = F.exists("levels", lambda x: x <= 0)
    bad_level = F.exists("levels", lambda x: x < 1)
    unreadable = F.col("duration").isNull() | F.col("warmup").isNull() | F.col("cooldown").isNull()
    rules = F.filter(
        F.array(
            F.when((F.col("mode") == fixed.OPEN) & bad_rate, "rate must be positive"),
            F.when((F.col("mode") != fixed.OPEN) & bad_level, "level must be at least 1"),
            F.when(unreadable, "unreadable duration"),
            F.when(F.col("warmup") + F.col("cooldown") > F.col("duration"), "warmup and cooldown exceed the duration"),
        ),
        lambda rule: rule.isNotNull(),
    )
    return timed.select("run_id", F.explode(rules).alias("rule"))
