"""Reading request logs, rollups, runs and spans. All schemas are explicit."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge import schemas
from tidegauge.functions import scalars
from tidegauge.functions.ends import until_end
from tidegauge.sources.json_tables import BARE, json_items, lenient_object, read_json_table

_NUMBER_KINDS = ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL")


def _typed(value: Column, field: T.StructField) -> Column:
    """One field of a JSON object. A number column takes JSON numbers only, never text."""
    path = f"$.{field.name}"
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    if isinstance(field.dataType, (T.NumericType,)):
        number = kind.rlike(f"^({'|'.join(_NUMBER_KINDS)})")
        if isinstance(field.dataType, T.IntegralType):
            # Whole numbers are read exactly; a fraction is cut; what does not fit is null.
            exact = F.try_variant_get(value, path, "bigint")
            cut = F.try_variant_get(value, path, "double")
            whole = F.coalesce(F.when(kind.startswith("BIGINT"), exact), cut.try_cast("bigint"))
            result = F.when(number, whole).try_cast(field.dataType)
        else:
            word = F.when(kind == "STRING", F.try_variant_get(value, path, "string"))
            bare = F.when(word.startswith(BARE), F.substring(word, 2, 9).cast("double"))
            result = F.coalesce(F.when(number, F.try_variant_get(value, path, "double")), bare).cast(field.dataType)
    elif isinstance(field.dataType, T.BooleanType):
        result = F.when(kind == "BOOLEAN", F.try_variant_get(value, path, "boolean"))
    else:
        result = F.try_variant_get(value, path, field.dataType.simpleString())
    return result.alias(field.name)


def parse_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Typed rows of JSON-lines text `value`; blank, broken and non-object lines are left out.

    A field of the wrong type is null and its row stays.
    """
    extra = [name for name in lines.columns if name != "value"]
    # As rows of a generator, objects are parsed once: a filter on them does not parse them again.
    objects = lines.select("value", *extra, F.explode_outer(F.array(lenient_object(F.col("value")))).alias("_object")).where(F.col("_object").isNotNull())
    return objects.select(*extra, *[_typed(F.col("_object"), field) for field in schema.fields if field.name not in extra])


def read_raw(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Request records from JSON lines. A file without lines gives no rows and all columns."""
    return parse_lines(spark.read.text(path), schema or schemas.request_record())


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """Request records from Parquet with nested columns."""
    return spark.read.schema(schemas.request_record()).parquet(path)


def read_flat_rollup(spark: SparkSession, path: str) -> DataFrame:
    """Request records from a Parquet rollup whose nested columns are JSON text."""
    full = schemas.request_record()
    nested = {f.name: f.dataType for f in full.fields if isinstance(f.dataType, (T.StructType, T.ArrayType))}
    flat = T.StructType([T.StructField(f.name, T.StringType() if f.name in nested else f.dataType) for f in full.fields])
    rows = spark.read.schema(flat).parquet(path)
    return rows.select(*[F.from_json(f.name, nested[f.name]).alias(f.name) if f.name in nested else f.name for f in full.fields])


def read_by_suffix(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """`.parquet` files as they are; everything else as JSON lines of `schema`."""
    if path.lower().rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return read_raw(spark, path, schema)


def read_own_columns(spark: SparkSession, path: str) -> DataFrame:
    """`.parquet` files as they are; JSON with the columns it has.

    JSON comes as lines, as an array or as one document per file; its columns and their types come
    from the data (`json_tables`). Broken lines and lines that are no object are left out. Without any
    object the columns are those of request records.
    """
    if path.lower().rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    found = read_json_table(spark, path)
    return read_raw(spark, path) if found is None else found


def read_panel_definitions(spark: SparkSession, path: str) -> DataFrame:
    """Panel definitions (`schemas.PANEL_DDL`) from JSON: an array, one object a line, or an object per file.

    Objects without a `position` of their own take their place in the file.
    """
    items = json_items(spark, path)
    fields = schemas.schema(schemas.PANEL_DDL)
    typed = [F.try_variant_get("_object", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in fields if f.name != "position"]
    return items.select(F.coalesce(F.try_variant_get("_object", "$.position", "int"), F.col("_position").cast("int")).alias("position"), *typed)


def list_runs(spark: SparkSession, root: str, summary: str = "summary.json") -> DataFrame:
    """Names of the runs under `root` that have a summary (a file or a folder of files), newest first."""
    try:
        files = spark.read.format("binaryFile").load(f"{root}/*/{summary}").select("path")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "run string")
    run = F.regexp_extract("path", rf"([^/]+)/{summary.replace('.', '[.]')}(/|$)", 1)
    return files.select(run.alias("run")).distinct().orderBy(F.desc("run"))


def _runs_files(root: str, names: list[str], raw: str) -> str:
    """One pattern for the logs of some runs; names are taken literally."""
    plain = [re.sub(r"([\\{}\[\]*?,])", r"\\\1", name) for name in names]
    return f"{root}/{{{','.join(plain)}}}/{raw}" if len(plain) > 1 else f"{root}/{plain[0]}/{raw}"


def _read_named(spark: SparkSession, root: str, names: list[str], raw: str) -> DataFrame:
    """Records of some runs, with the folder name as `run`; only their files are listed and read."""
    schema = schemas.request_record()
    try:
        lines = spark.read.text(_runs_files(root, names, raw)) if names else None
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = None
    if lines is None:
        return parse_lines(spark.createDataFrame([], "value string, run string"), schema)
    # A run written by Spark has a folder where a single file would be.
    run = F.regexp_extract("_path", rf"([^/]+)/{raw.replace('.', '[.]')}(/|$)", 1)
    named = lines.select("value", F.col("_metadata.file_path").alias("_path")).select("value", F.url_decode(F.replace(run, F.lit("+"), F.lit("%2B"))).alias("run"))
    return parse_lines(named, schema)


def read_runs(spark: SparkSession, root: str, raw: str = "raw.jsonl") -> DataFrame:
    """Records of every run with a summary, with its folder name as `run`.

    Runs are found in the listing, before any log is read: files of runs without a summary are
    never opened. One name per run reaches the driver.
    """
    return _read_named(spark, root, [row["run"] for row in list_runs(spark, root).collect()], raw)


def read_run(spark: SparkSession, root: str, name: str | None = None, raw: str = "raw.jsonl") -> DataFrame:
    """Records of one run, the named one or else the newest with a summary; no other run's files are read."""
    found = list_runs(spark, root)
    one = found.where(F.col("run") == name) if name is not None else found.limit(1)
    return _read_named(spark, root, [row["run"] for row in one.collect()], raw)


def newest_runs(runs: DataFrame, n: int = 1) -> DataFrame:
    """The `n` newest runs by name."""
    return runs.orderBy(F.desc("run")).limit(n)


def resolve_run(rows: DataFrame, runs: DataFrame, name: str | None = None) -> DataFrame:
    """Rows of one run: the named one, else the newest."""
    if name is not None:
        return rows.where(F.col("run") == name)
    # One row by construction.
    return rows.join(F.broadcast(newest_runs(runs)), "run", "left_semi")


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """Spans with `duration_s`."""
    return with_duration(spark.read.schema(schemas.schema(schemas.SPAN_DDL)).json(path))


def with_duration(spans: DataFrame) -> DataFrame:
    return spans.withColumn("duration_s", (F.col("end_time") - F.col("start_time")) / 1e9)


def span_stats(spans: DataFrame) -> DataFrame:
    """Count, time and tokens of the spans by name and model."""
    tokens = F.col("attributes")["llm.output_tokens"].try_cast("bigint")
    return spans.groupBy("name", F.col("attributes")["llm.model"].alias("model")).agg(
        F.count(F.lit(1)).alias("spans"),
        F.avg("duration_s").alias("mean_duration_s"),
        F.max("duration_s").alias("max_duration_s"),
        F.coalesce(F.sum(tokens), F.lit(0).cast("long")).alias("output_tokens"),
    )


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Response chunks from Parquet with the explicit chunk schema."""
    return spark.read.schema(schemas.schema(schemas.CHUNK_DDL)).parquet(path)


def parse_stream_lines(lines: DataFrame) -> DataFrame:
    """Chunks from logged event-stream lines `(request_id, seq, arrival_s, line)`.

    Only `data:` lines count; `[DONE]` is the end marker; other payloads must be JSON objects.
    What follows the first end marker of a request is left out (`functions.ends`).
    """
    payload = F.trim(F.regexp_extract("line", r"^\s*data:(.*)$", 1))
    done = payload == "[DONE]"
    usage, details = "$.usage", ("prompt_tokens_details.cached_tokens", "completion_tokens_details.reasoning_tokens")
    value = F.col("_object")

    def get(path: str, kind: str) -> Column:
        return F.try_variant_get(value, path, kind)

    parsed = (
        lines.where(F.col("line").rlike(r"^\s*data:"))
        .withColumn("_done", done)
        .withColumn("_object", F.when(~done, scalars.json_object(payload)))
    )
    has_usage = F.schema_of_variant(F.try_variant_get(value, usage, "variant")).startswith("OBJECT")
    call = "array<struct<index:int,function:struct<name:string,arguments:string>>>"
    calls = F.transform(
        get("$.choices[0].delta.tool_calls", call),
        lambda c: F.struct(
            F.coalesce(c["index"], F.lit(0)).alias("index"),
            c["function"]["name"].alias("name"),
            c["function"]["arguments"].alias("arguments"),
        ),
    )
    chunks = parsed.select(
        "request_id",
        "seq",
        "arrival_s",
        get("$.choices[0].delta.content", "string").alias("content"),
        get("$.choices[0].finish_reason", "string").alias("finish_reason"),
        F.when(
            has_usage,
            F.struct(
                get(f"{usage}.prompt_tokens", "bigint").alias("prompt_tokens"),
                get(f"{usage}.completion_tokens", "bigint").alias("completion_tokens"),
                get(f"{usage}.{details[0]}", "bigint").alias("cached_tokens"),
                get(f"{usage}.{details[1]}", "bigint").alias("reasoning_tokens"),
            ),
        ).alias("usage"),
        calls.alias("tool_calls"),
        F.col("_done").alias("done"),
        (F.col("_done") | value.isNotNull()).alias("parse_ok"),
    )
    return until_end(chunks)
