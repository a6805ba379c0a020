"""Structured Streaming versions of the record, score and level operators.

All state is algebraic (counts, minima, last values) and keyed by request, window or
cell, never a list of rows. Event time is the column `ts`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegauge.functions import fixed
from tidegauge.functions.sizing import session_folder
from tidegauge.operators.levels import add_reliability
from tidegauge.streaming.assembly import Assembly
from tidegauge.streaming.ledger import Ledger
from tidegauge.streaming.windows import WindowPercentiles

# -- running --------------------------------------------------------------------


def stream_folder(df: DataFrame, name: str = "stream") -> str:
    return f"{session_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


def start_to_files(stream: DataFrame, folder: str) -> StreamingQuery:
    """Process what is there and stop; finished rows are appended to Parquet files."""
    return (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def run_to_table(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Run an append-mode stream over the available input and read its result."""
    folder = folder or stream_folder(stream)
    start_to_files(stream, folder).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


# Event time of the rows that tell a stream its input has ended.
END = "2200-01-01 00:00:00"


def run_whole(
    build: Callable[..., DataFrame], inputs: Sequence[DataFrame], marks: dict[str, object] | None = None, folder: str | None = None
) -> DataFrame:
    """Run an append-mode stream over inputs that end, and return its whole result.

    A watermark holds the newest windows and requests back. When all input is processed, every
    input gets one row with event time `END` (its other columns null, or as in `marks`, so that
    filters before the watermark let it through). The next batch moves the watermark there and
    closes everything that real rows opened; what the end rows opened themselves stays open.
    """
    folder = folder or stream_folder(inputs[0])
    ended, finish = _with_ends(inputs, marks, folder)
    stream = build(*ended)
    start_to_files(stream, folder).awaitTermination()
    finish()
    start_to_files(stream, folder).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def run_in_turns(
    build: Callable[[DataFrame], DataFrame], deliveries: Sequence[DataFrame], folder: str | None = None
) -> tuple[DataFrame, Ledger]:
    """Run an append-mode stream over deliveries that come one after the other.

    Each delivery is written whole, however many files it has, before the stream runs over what is
    new; so each is one batch. The result is whole, as in `run_whole`; the ledger tells what every
    batch delivered (metric `delivered.rows`) and dropped.
    """
    first = deliveries[0]
    spark, folder = first.sparkSession, folder or stream_folder(first)
    first.limit(0).write.parquet(f"{folder}/in")
    source = spark.readStream.schema(first.schema).parquet(f"{folder}/in")
    ended, finish = _with_ends([source.observe("delivered", F.count(F.lit(1)).alias("rows"))], None, folder)
    stream = build(ended[0])
    turns = [lambda each=each: each.write.mode("append").parquet(f"{folder}/in") for each in deliveries]
    with Ledger(spark, f"{folder}/ledger") as ledger:
        for deliver in [*turns, finish]:
            deliver()
            query = start_to_files(stream, folder)
            query.awaitTermination()
            ledger.settle(query)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out"), ledger


def _with_ends(inputs: Sequence[DataFrame], marks: dict[str, object] | None, folder: str) -> tuple[list[DataFrame], Callable[[], None]]:
    """The inputs with an end row each to come, and what delivers these rows."""
    spark = inputs[0].sparkSession
    ends = [f"{folder}/end-{number}" for number in range(len(inputs))]
    rows = [
        spark.range(1).select(
            *[
                (F.lit(END).cast(f.dataType) if f.name == "ts" else F.lit((marks or {}).get(f.name)).cast(f.dataType)).alias(f.name)
                for f in each.schema.fields
            ]
        )
        for each in inputs
    ]
    for row, path in zip(rows, ends, strict=True):
        row.limit(0).write.parquet(path)

    def finish() -> None:
        for row, path in zip(rows, ends, strict=True):
            row.write.mode("append").parquet(path)

    return [each.unionAll(spark.readStream.schema(each.schema).parquet(path)) for each, path in zip(inputs, ends, strict=True)], finish


def run_updates(stream: DataFrame, keys: Sequence[str], folder: str | None = None) -> DataFrame:
    """Run an update-mode stream; the result holds the newest row of each key.

    Every batch overwrites its own folder, so a repeated batch leaves no double rows.
    """
    folder = folder or stream_folder(stream)
    spark = stream.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/part={number}")

    query = (
        stream.writeStream.foreachBatch(save)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    columns = [c for c in stream.columns if c not in keys]
    updates = spark.read.parquet(f"{folder}/out")
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in columns])


# -- records from chunks ----------------------------------------------------------


def run_assembly(chunks: DataFrame, timeout: str, delay: str, folder: str | None = None) -> DataFrame:
    """Fold a stream of chunks that ends into request records; see `assembly.Assembly`."""
    folder = folder or stream_folder(chunks)
    ended, finish = _with_ends([chunks], None, folder)
    assembly = Assembly(chunks.sparkSession, folder, timeout, delay)
    assembly.start(ended[0]).awaitTermination()
    finish()
    assembly.start(ended[0]).awaitTermination()
    return assembly.records()


def deduplicate(requests: DataFrame, delay: str, keys: Sequence[str] = ("run_id", "request_id")) -> DataFrame:
    """Each request once, however often it is delivered within the watermark."""
    return requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


# -- scores ------------------------------------------------------------------------


def backfill(records: DataFrame, results: DataFrame, delay: str, timeout: str) -> DataFrame:
    """Left-join scores that arrive within `timeout` of their record.

    An eligible record without a score in time is `eval_skipped`; it is emitted when the
    watermark has passed its time limit. Of several deliveries of a score the first counts.
    """
    ours = records.withWatermark("ts", delay)
    theirs = (
        results.select(
            F.col("request_id").alias("scored_id"), F.col("ts").alias("scored_at"), F.col("eval_status").alias("_status"), "quality_score"
        )
        .withWatermark("scored_at", delay)
        .dropDuplicatesWithinWatermark(["scored_id"])
    )
    in_time = (
        (F.col("request_id") == F.col("scored_id"))
        & (F.col("scored_at") >= F.col("ts"))
        & (F.col("scored_at") <= F.col("ts") + F.expr(f"interval {timeout}"))
    )
    status = (
        F.when(~F.col("eligible"), fixed.SKIPPED_NO_EXPECTED)
        .when(F.col("_status").isNotNull(), F.col("_status"))
        .otherwise(fixed.EVAL_SKIPPED)
    )
    joined = ours.join(theirs, in_time, "left_outer")
    return joined.select(
        "request_id", "ts", status.alias("eval_status"), F.when(F.col("eligible"), F.col("quality_score")).alias("quality_score")
    )


def progress(records: DataFrame, results: DataFrame) -> DataFrame:
    """Requests to be scored, scores received and their ratio, per run, as they change (update mode)."""
    enqueued = records.where("eligible").select("run_id", F.lit(1).alias("enqueued"), F.lit(0).alias("scored"))
    scored = results.select("run_id", F.lit(0).alias("enqueued"), F.lit(1).alias("scored"))
    sums = enqueued.unionByName(scored).groupBy("run_id").agg(F.sum("enqueued").alias("enqueued"), F.sum("scored").alias("scored"))
    ratio = F.when(F.col("enqueued") > 0, F.col("scored") / F.col("enqueued")).otherwise(F.lit(0.0))
    return sums.withColumn("caught_up", ratio)


# -- levels ------------------------------------------------------------------------


def _windowed(records: DataFrame, size: str, delay: str, slide: str | None) -> tuple[DataFrame, Column]:
    steady = records.where(F.col("phase") == fixed.STEADY).withWatermark("ts", delay)
    return steady, (F.window("ts", size, slide) if slide else F.window("ts", size)).alias("window")


def level_reliability(records: DataFrame, size: str, delay: str, slide: str | None = None) -> DataFrame:
    """Reliability counts of each run and level per (tumbling or sliding) window."""
    steady, window = _windowed(records, size, delay, slide)
    ok = F.col("outcome") == fixed.SUCCESS
    counts = steady.groupBy(window, "run_id", "level_or_rate").agg(
        F.count(F.lit(1)).alias("steady_samples"),
        F.count_if(ok).alias("completed"),
        F.count_if(~ok).alias("failed"),
        F.count_if(F.col("outcome") == fixed.RATE_LIMITED).alias("rate_limited"),
    )
    flat = counts.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *counts.columns[1:])
    return add_reliability(flat)


def run_level_percentiles(
    records: DataFrame, metric: str, size: str, delay: str, probs: Sequence[float], slide: str | None = None, folder: str | None = None
) -> DataFrame:
    """Exact percentiles per window and level of a stream of records that ends; see `windows`."""
    folder = folder or stream_folder(records)
    ended, finish = _with_ends([records], None, folder)
    windows = WindowPercentiles(records.sparkSession, folder, metric, size, delay, slide)
    windows.start(ended[0]).awaitTermination()
    finish()
    windows.start(ended[0]).awaitTermination()
    return windows.percentiles(probs)


def alerts(levels: DataFrame, min_samples: int) -> DataFrame:
    """Windows that are rate-limited too often or have too few samples."""
    few = F.col("steady_samples") < max(1, min_samples)
    return levels.where(F.col("rate_limited_flagged") | few).select(
        "window_start",
        "run_id",
        "level_or_rate",
        "steady_samples",
        "rate_limited_rate",
        F.when(F.col("rate_limited_flagged"), "rate_limited").otherwise("min_samples").alias("alert"),
    )


def arrivals_per_window(requests: DataFrame, size: str, delay: str) -> DataFrame:
    """Requests per window; rows of windows that the watermark has passed are dropped.

    With `run_in_turns`, what was dropped is what the ledger saw delivered less what is counted here.
    """
    counts = requests.withWatermark("ts", delay).groupBy(F.window("ts", size).alias("window")).agg(F.count(F.lit(1)).alias("requests"))
    return counts.select(F.col("window.start").alias("window_start"), "requests")


