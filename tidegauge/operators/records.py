"""From response chunks to one record per request.

The facts of a request are algebraic aggregates (min, max, count, last by position) in one
aggregation with one scan and one shuffle by request, over the rows up to the end of its stream.
Its gaps are rows in blocks, and their summary is read off one order of these rows, so a response
of any length is spread over tasks. Only `itl_list` is one cell per response (8 bytes a token); it hangs on the records by an
outer join that Spark leaves out where nothing reads the column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import fixed, scalars
from tidegauge.functions.ends import stream_ends, until_end
from tidegauge.functions.percentiles import grouped_stats
from tidegauge.functions.segments import consecutive_gaps, counted, deal, in_blocks, key_parts, running_total
from tidegauge.functions.sizing import broadcast_if_small, settle

# Positions of a response that one part of its text covers.
PART_CHUNKS = 10_000

USAGE_KEYS = ("prompt_tokens", "completion_tokens", "cached_tokens", "reasoning_tokens")


def has_text(content: str = "content") -> Column:
    """A chunk counts as a token arrival only with non-empty text."""
    return F.coalesce(F.col(content) != "", F.lit(False))


def content_chunks(chunks: DataFrame) -> DataFrame:
    """Token arrivals among rows that count."""
    return chunks.where(F.col("content") != "")


# -- single facts per request --------------------------------------------------
#
# Every function takes chunks as they were logged and leaves out what stands behind the end of a
# stream. `ends` (of `functions.ends.stream_ends`) saves looking for the ends again.


def first_token(chunks: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Arrival of the first chunk with text; null when there is none."""
    return until_end(chunks, ends).groupBy("request_id").agg(F.min(F.when(has_text(), F.col("arrival_s"))).alias("ttft"))


def inter_token_gaps(chunks: DataFrame, width: float | None = None, ends: DataFrame | None = None) -> DataFrame:
    """Gaps between token arrivals of each request: `(request_id, since, gap, n)`."""
    parts = None if width else key_parts(chunks, ["request_id"])
    return consecutive_gaps(_arrivals(chunks, ends, parts), ["request_id"], "arrival_s", width, parts)


def _arrivals(chunks: DataFrame, ends: DataFrame | None, parts: int | None) -> DataFrame:
    """`request_id`, `arrival_s` of the token arrivals that count; texts are left out before rows are dealt out."""
    rows = content_chunks(chunks)
    if "done" not in chunks.columns:
        return deal(rows.select("request_id", "arrival_s"), ["request_id"], parts)
    ends = stream_ends(chunks) if ends is None else ends
    # Text behind the end is none, also where its row tells how the request ended.
    rows = deal(rows.select("request_id", "seq", "arrival_s", "done"), ["request_id"], parts)
    return until_end(rows, ends).select("request_id", "arrival_s")


def _second_token() -> Column:
    """Aggregate over gap rows: the gap that starts at the first token."""
    zero = F.col("gap") == 0
    repeated = F.min(F.when(zero, F.col("since"))) <= F.min("since")
    return F.when(repeated, 0.0).otherwise(F.min_by("gap", F.when(~zero, F.col("since"))))


def second_token_gap(gaps: DataFrame) -> DataFrame:
    """Gap between the first and the second token."""
    return gaps.groupBy("request_id").agg(_second_token().alias("tt2t"))


def gap_facts(gaps: DataFrame, parts: int | None = None) -> DataFrame:
    """`(request_id, tt2t, itl_summary)` of requests with gaps, from settled gap rows in one pass."""
    stats = grouped_stats(gaps, ["request_id"], "gap", (0.5, 0.95, 0.99), "n", {"tt2t": _second_token()}, parts)
    q = F.col("quantiles")
    summary = F.struct("mean", q[0].alias("p50"), q[1].alias("p95"), q[2].alias("p99"), "max").alias("itl_summary")
    return stats.select("request_id", "tt2t", summary)


def with_lists(frame: DataFrame, gaps: DataFrame) -> DataFrame:
    """Add `itl_list`: empty without gaps, null where `outcome` is there and no success.

    The join is left out of plans that do not read the column.
    """
    found = F.coalesce("itl_list", F.array().cast("array<double>"))
    if "outcome" in frame.columns:
        found = F.when(F.col("outcome") == fixed.SUCCESS, found)
    return frame.join(itl_lists(gaps), "request_id", "left").withColumn("itl_list", found)


def itl_summary(chunks: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """`(request_id, tt2t, itl_list, itl_summary)`; null summary without gaps."""
    ends = stream_ends(chunks) if ends is None else ends
    gaps = settle(inter_token_gaps(chunks, ends=ends))
    parts = key_parts(chunks, ["request_id"])
    facts = _arrivals(chunks, ends, parts).select("request_id").distinct().join(gap_facts(gaps, parts), "request_id", "left")
    return with_lists(facts, gaps).select("request_id", "tt2t", "itl_list", "itl_summary")


def itl_lists(gaps: DataFrame) -> DataFrame:
    """The gaps of each request as one array in arrival order (the optional raw column)."""
    expanded = F.flatten(
        F.transform(
            F.array_sort(F.collect_list(F.struct("since", "gap", "n"))),
            lambda item: F.array_repeat(item["gap"], item["n"].cast("int")),
        )
    )
    return gaps.groupBy("request_id").agg(expanded.alias("itl_list"))


def _last(key: str) -> Column:
    """Last reported value of a usage key."""
    value = F.col(f"usage.{key}")
    return F.max_by(value, F.when(value.isNotNull(), F.col("seq")))


def usage_fold(chunks: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Token counts of each request from its usage objects.

    The last value of every key wins. Without any usage object the output is counted
    in chunks with text and marked incomplete; a usage object without an output count
    leaves it at zero.
    """
    return until_end(chunks, ends).groupBy("request_id").agg(*usage_aggregates()).select("request_id", *usage_columns())


def usage_aggregates() -> list[Column]:
    return [
        F.count(F.when(has_text(), 1)).alias("_deltas"),
        F.count("usage").alias("_usages"),
        *[_last(key).alias(f"_{key}") for key in USAGE_KEYS],
    ]


def usage_columns() -> list[Column]:
    incomplete = F.col("_usages") == 0
    zero = F.lit(0).cast("long")
    return [
        F.coalesce(F.col("_prompt_tokens"), zero).alias("prompt_tokens"),
        F.when(incomplete, F.col("_deltas")).otherwise(F.coalesce(F.col("_completion_tokens"), zero)).alias("output_tokens"),
        F.coalesce(F.col("_cached_tokens"), zero).alias("cached_tokens"),
        F.coalesce(F.col("_reasoning_tokens"), zero).alias("reasoning_tokens"),
        incomplete.alias("usage_incomplete"),
    ]


def outcome_aggregates() -> list[Column]:
    # Numbers instead of names keep the aggregation in the hash path.
    kind = F.col("error_kind")
    rank = F.when(kind == "timeout", 3).when(kind == "protocol", 2).when(kind.isNotNull(), 1)
    return [
        F.max("arrival_s").alias("e2e"),
        F.max("done").alias("_done"),
        F.min("parse_ok").alias("_parse_ok"),
        F.max("status_code").alias("status_code"),
        F.max(rank).alias("_error_rank"),
    ]


def _error_kind() -> Column:
    rank = F.col("_error_rank")
    return F.when(rank == 3, "timeout").when(rank == 2, "protocol").when(rank == 1, "connection")


def outcome_column() -> Column:
    return scalars.outcome(_error_kind(), F.col("status_code"), F.col("_done"), F.col("_parse_ok"))


def classify_outcomes(chunks: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Outcome, status and end time of each request."""
    return (
        until_end(chunks, ends).groupBy("request_id")
        .agg(*outcome_aggregates())
        .select("request_id", outcome_column().alias("outcome"), "status_code", "e2e")
    )


def response_facts(chunks: DataFrame, gaps: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """Outcome, latencies, gaps and tokens. A failed request keeps no stream data.

    `gaps` are the settled rows of `inter_token_gaps`; without them they are made here.
    """
    ends = stream_ends(chunks) if ends is None else ends
    gaps = settle(inter_token_gaps(chunks, ends=ends)) if gaps is None else gaps
    parts = key_parts(chunks, ["request_id"])
    # Only whether there is text counts, so no text is moved.
    rows = chunks.withColumn("content", F.when(has_text(), "+"))
    raw = until_end(deal(rows, ["request_id"], parts), ends).groupBy("request_id").agg(
        F.min(F.when(has_text(), F.col("arrival_s"))).alias("ttft"),
        *usage_aggregates(),
        *outcome_aggregates(),
    )
    return finished_facts(with_lists(raw.join(gap_facts(gaps, parts), "request_id", "left"), gaps))


def finished_facts(raw: DataFrame, *more: str) -> DataFrame:
    """Facts from aggregates (`usage_aggregates`, `outcome_aggregates`, `ttft`) and gap facts; `more` columns stay."""
    lists = [name for name in ("itl_list",) if name in raw.columns]
    facts = raw.select(
        "request_id", "ttft", "tt2t", *lists, "itl_summary", "e2e", "status_code",
        outcome_column().alias("outcome"), *usage_columns(), _error_kind().alias("_error_kind"), *more,
    )
    ok = F.col("outcome") == fixed.SUCCESS
    zero = F.lit(0).cast("long")
    tokens = ("prompt_tokens", "output_tokens", "cached_tokens", "reasoning_tokens")
    return facts.select(
        "request_id",
        "outcome",
        F.when(F.col("_error_kind").isNull(), F.col("status_code")).otherwise(0).alias("status_code"),
        "e2e",
        *[F.when(ok, F.col(name)).alias(name) for name in ("ttft", "tt2t", *lists, "itl_summary")],
        *[F.when(ok, F.col(name)).otherwise(zero).alias(name) for name in tokens],
        (ok & F.col("usage_incomplete")).alias("usage_incomplete"),
        F.when(ok, F.lit(None))
        .when(F.col("_error_kind").isNotNull(), F.col("_error_kind"))
        .when(F.col("outcome") == fixed.MALFORMED_STREAM, F.lit("malformed stream"))
        .otherwise(F.concat(F.lit("HTTP "), F.col("status_code")))
        .alias("error"),
        *more,
    )


# -- dimensions joined to requests ---------------------------------------------


def run_windows(runs: DataFrame) -> DataFrame:
    """Run settings with `duration_s`, `warmup_s`, `cooldown_s` and `steady_end_s`."""
    timed = runs.select(
        "*", *[scalars.duration_s(F.col(name)).alias(f"{name}_s") for name in ("duration", "warmup", "cooldown")]
    )
    return timed.withColumn("steady_end_s", scalars.steady_end(F.col("duration_s"), F.col("warmup_s"), F.col("cooldown_s")))


def tag_phases(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Add `phase` from the start offset within the level."""
    windows = run_windows(runs).select("run_id", "warmup_s", "steady_end_s")
    offset = F.col("t_start") - F.col("level_start")
    return (
        requests.join(broadcast_if_small(windows), "run_id", "left")
        .withColumn("phase", scalars.phase(offset, F.col("warmup_s"), F.col("steady_end_s")))
        .drop("warmup_s", "steady_end_s")
    )


def enrich_prices(requests: DataFrame, runs: DataFrame, models: DataFrame) -> DataFrame:
    """Add `mode`, `model`, prices and the cache-busting switch of the run."""
    settings = runs.join(models.withColumnRenamed("name", "model_name"), "model_name", "left").select(
        "run_id", "mode", "model", "cache_busting", "price_input", "price_output"
    )
    return requests.join(broadcast_if_small(settings), "run_id", "left")


def enrich_prompts(requests: DataFrame, prompts: DataFrame) -> DataFrame:
    """Add prompt metadata. The prompt table may be large, so the join choice is Spark's."""
    meta = prompts.select(
        F.col("id").alias("prompt_id"),
        F.col("category"),
        F.col("isl_bucket").alias("declared_bucket"),
        F.col("expected_output"),
    )
    return requests.join(meta, "prompt_id", "left")


def build_records(
    chunks: DataFrame,
    requests: DataFrame,
    runs: DataFrame,
    models: DataFrame,
    prompts: DataFrame,
    gaps: DataFrame | None = None,
    ends: DataFrame | None = None,
) -> DataFrame:
    """The request record; `gaps` and `ends` as in `response_facts`.

    `itl_list` and `expected_output` are carried for the gap pool and the evaluation
    join; writers drop them unless told otherwise.
    """
    # Settings and prompts meet the short rows of the dispatch log, before the facts.
    known = enrich_prompts(enrich_prices(tag_phases(requests, runs), runs, models), prompts)
    joined = known.join(response_facts(chunks, gaps, ends), "request_id", "left")
    ok = F.col("outcome") == fixed.SUCCESS
    e2e, ttft, out = F.col("e2e"), F.col("ttft"), F.col("output_tokens")
    columns = [
        "run_id", "model", "mode", "level_or_rate", "phase", "seed", "request_id", "prompt_id",
        F.coalesce("category", F.lit(fixed.DEFAULT_CATEGORY)).alias("category"),
        "t_start", "ttft",
        "tt2t",
        "e2e",
        scalars.tpot(ttft, e2e, out).alias("tpot"),
        scalars.normalized_latency(e2e, out).alias("normalized_latency"),
        "itl_summary",
        "itl_list",
        "output_tokens", "prompt_tokens", "cached_tokens", "reasoning_tokens", "usage_incomplete",
        scalars.isl_bucket(
            F.coalesce("declared_bucket", F.lit(fixed.DEFAULT_INPUT_BUCKET)), F.col("prompt_tokens")
        ).alias("isl_bucket"),
        scalars.osl_bucket(out).alias("osl_bucket"),
        scalars.cost_usd(F.col("prompt_tokens"), out, F.col("price_input"), F.col("price_output")).alias("cost_usd"),
        "outcome", "status_code", F.lit(0).alias("retry_count"), "error",
        scalars.cache_violation(F.col("outcome"), F.col("cached_tokens"), F.col("cache_busting")).alias("cache_violation"),
        "expected_output",
    ]
    return joined.select(*columns)


def output_parts(chunks: DataFrame, size: int = PART_CHUNKS, ends: DataFrame | None = None) -> DataFrame:
    """Text of each response in parts of `size` positions: `(request_id, part, text)`; never persisted."""
    text = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda item: item["content"]), ""
    )
    part = F.floor(F.col("seq") / size).alias("part")
    return content_chunks(until_end(chunks, ends)).groupBy("request_id", part).agg(text.alias("text"))


def output_text(chunks: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Text of each response in arrival order: `(request_id, output_text)`; never persisted.

    Chunks are put in order part by part; the whole text is one cell. Use `output_parts` for
    texts that no cell holds.
    """
    text = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda item: item["text"]), ""
    )
    return output_parts(chunks, ends=ends).groupBy("request_id").agg(text.alias("output_text"))


def chunk_order(chunks: DataFrame, width: float | None = None, ends: DataFrame | None = None) -> DataFrame:
    """Rank of each distinct token arrival inside its request and the number of tokens there."""
    rows = content_chunks(until_end(chunks, ends))
    values = counted(in_blocks(rows, ["request_id"], "arrival_s", width), ["request_id"], "arrival_s", F.col("_block"))
    ranked = running_total(values, ["request_id"], ["arrival_s"], "_n")
    return ranked.select(
        "request_id",
        "arrival_s",
        (F.col("_upto") - F.col("_n") + 1).alias("first_position"),
        F.col("_upto").alias("last_position"),
        F.col("_total").alias("tokens"),
    )
