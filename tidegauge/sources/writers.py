"""Writing records, rollups, summaries, tool calls and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge import schemas
from tidegauge.operators.levels import nested_summary

# Columns that hold or carry prompt and response text, or exist only for joins.
TRANSIENT = ("expected_output", "output_text", "cache_violation")

# Lines of one compressed file, which a single task reads.
FILE_LINES = 250_000


def drop_content(records: DataFrame, raw_itl: bool = False) -> DataFrame:
    """What may be persisted: no texts, and the gap array only when asked for."""
    kept = records.drop(*TRANSIENT)
    return kept if raw_itl else kept.drop("itl_list")


def flatten(records: DataFrame) -> DataFrame:
    """Nested columns as JSON text, everything else unchanged."""
    return records.select(
        *[
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else f.name
            for f in records.schema.fields
        ]
    )


def complete(records: DataFrame) -> DataFrame:
    """All columns of the record schema, in its order; missing ones are null."""
    full = schemas.request_record()
    have = set(records.columns)
    return records.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in full.fields
            if f.name != "itl_list" or "itl_list" in have
        ]
    )


def write_raw(records: DataFrame, path: str, raw_itl: bool = False) -> None:
    """JSON lines under `path/run_id=.../`, nulls written out."""
    drop_content(records, raw_itl).write.partitionBy("run_id").option("ignoreNullFields", "false").json(path)


def write_run_raw(records: DataFrame, path: str, raw_itl: bool = False, compression: str | None = None) -> None:
    """JSON lines of one run as `path`, the run id kept in each line.

    With a `compression`, such as `gzip`, the files under `path` have its ending, by which readers
    know it, and at most `FILE_LINES` lines each.
    """
    writer = drop_content(records, raw_itl).write.option("ignoreNullFields", "false")
    if compression:
        writer = writer.options(compression=compression, maxRecordsPerFile=FILE_LINES)
    writer.json(path)


def write_rollup(records: DataFrame, path: str, flat: bool = True, raw_itl: bool = False) -> None:
    """Parquet with the full schema, also when there are no rows."""
    rows = complete(drop_content(records, raw_itl))
    (flatten(rows) if flat else rows).write.parquet(path)


def write_summary(levels: DataFrame, path: str, report: DataFrame | None = None) -> None:
    """One JSON object per run with its levels nested, and the run block when a report is given."""
    (nested_summary(levels) if report is None else report).write.json(path)


def write_tool_calls(calls: DataFrame, path: str) -> None:
    calls.write.partitionBy("run_id").json(path)


def append_spans(spans: DataFrame, path: str) -> None:
    spans.write.mode("append").json(path)
