"""Where response streams end.

A client stops reading a stream at its first end marker. Whatever a log holds behind it - a
trailer, a keep-alive, a late chunk - is no part of the response: it adds no text, no usage, no
tool call, no parse failure and no time. Facts of the request itself (status, error and the end
time in such a row) count wherever the row stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.sizing import broadcast_if_small, settle

# Columns of a chunk that belong to the stream, and those that belong to the request.
STREAM = ("content", "finish_reason", "usage", "tool_calls", "done", "parse_ok")
REQUEST = ("status_code", "error_kind")


def _any(names: list[str]) -> Column:
    found = F.lit(False)
    for name in names:
        found = found | F.col(name).isNotNull()
    return found


def closing(chunks: DataFrame) -> Column:
    """Rows that tell how the request ended."""
    return _any([name for name in REQUEST if name in chunks.columns])


def stream_ends(chunks: DataFrame) -> DataFrame:
    """`(request_id, end)` of the requests that have rows of a stream behind their first end, settled.

    `end` is the position of the first end marker. One pass over few columns, combined before its
    shuffle: one row per request, whatever its length.
    """
    streamed = ~closing(chunks) | _any([name for name in STREAM if name in chunks.columns])
    marks = chunks.groupBy("request_id").agg(
        F.min(F.when(F.col("done"), F.col("seq"))).alias("end"), F.max(F.when(streamed, F.col("seq"))).alias("last")
    )
    return settle(marks.filter("last > end").select("request_id", "end"))


def until_end(chunks: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """The rows of `chunks` that count: those up to the first end of their stream.

    Of a row behind it that tells how the request ended, only that stays. `ends` is a result of
    `stream_ends` for these rows; without it, it is made here. Responses that nothing follows
    meet no join; the others are joined with one row per request. Rows without a marker column all count.
    """
    if "done" not in chunks.columns:
        return chunks
    ends = stream_ends(chunks) if ends is None else ends
    if ends.isEmpty():
        return chunks
    behind = F.coalesce(F.col("seq") > F.col("_end"), F.lit(False))
    joined = chunks.join(broadcast_if_small(ends.withColumnRenamed("end", "_end")), "request_id", "left")
    kept = joined.filter(~behind | closing(chunks))
    return kept.select(*[F.when(~behind, F.col(name)).alias(name) if name in STREAM else F.col(name) for name in chunks.columns])
