"""Registered queries: one per operator, over the whole given tables."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import fixed, scalars
from tidegauge.functions.sizing import settle
from tidegauge.operators import adhoc, load, panels, quality, series, tools
from tidegauge.operators import levels as lv
from tidegauge.operators import records as rec
from tidegauge.plans.workbench import Workbench, rounded, workbench
from tidegauge.sources import dims, readers, writers
from tidegauge.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(function: Callable[[Workbench], DataFrame]) -> Callable[[Workbench], DataFrame]:
    """Register a function of the workbench under its own name."""
    name = function.__name__.removesuffix("_")

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(function(workbench(spark, folder)))

    QUERIES[name] = run
    return function


LEVEL = list(lv.LEVEL)


# -- sources ------------------------------------------------------------------------

RECORD_CHECK = ("run_id", "request_id", "phase", "outcome", "ttft", "e2e", "output_tokens", "usage_incomplete", "cost_usd")


def _check_columns(records: DataFrame) -> DataFrame:
    return records.select(*RECORD_CHECK, F.col("itl_summary.p95").alias("itl_p95"))


@query
def scan_raw(wb: Workbench) -> DataFrame:
    path = wb.folder("raw")
    writers.write_run_raw(wb.records, path)
    # Blank, broken, array and text lines, one of each per customer.
    junk = wb.fx.table("customer").select(
        F.explode(F.array(F.lit(""), F.lit('{"run_id": '), F.lit("[1, 2]"), F.lit('"text"'))).alias("value")
    )
    junk.write.mode("append").text(path)
    return _check_columns(readers.read_raw(wb.spark, path))


@query
def scan_rollup(wb: Workbench) -> DataFrame:
    path = wb.folder("rollup")
    writers.write_rollup(wb.records, path, flat=False)
    return _check_columns(readers.read_rollup(wb.spark, path))


@query
def scan_by_suffix(wb: Workbench) -> DataFrame:
    parquet, raw = wb.folder("data") + ".parquet", wb.folder("data") + ".jsonl"
    writers.write_rollup(wb.records, parquet)
    # As plain text the lines take nine times the disk of the Parquet files.
    writers.write_run_raw(wb.records, raw, compression="gzip")
    parts = [
        readers.read_by_suffix(wb.spark, path)
        .groupBy(F.lit(kind).alias("kind"), "outcome")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("output_tokens").alias("tokens"))
        for kind, path in (("parquet", parquet), ("jsonl", raw))
    ]
    return parts[0].unionByName(parts[1])


@query
def scan_empty(wb: Workbench) -> DataFrame:
    path = wb.folder("empty") + ".jsonl"
    writers.write_run_raw(wb.records.where(F.col("outcome") == "unknown"), path)
    return adhoc.query_file(wb.spark, path, "select count(*) as n, sum(output_tokens) as tokens from data")


def _write_runs(wb: Workbench) -> str:
    """One folder per run; run 3 gets no summary."""
    root = wb.folder("runs")
    for number in range(5):
        run = f"run-{number}"
        writers.write_run_raw(wb.records.where(F.col("run_id") == run), f"{root}/{run}/raw.jsonl")
        if number != 3:
            writers.write_summary(wb.levels.where(F.col("run_id") == run), f"{root}/{run}/summary.json")
    return root


@query
def scan_runs(wb: Workbench) -> DataFrame:
    rows = readers.read_runs(wb.spark, _write_runs(wb))
    return rows.groupBy("run").agg(F.count(F.lit(1)).alias("requests"), F.avg("e2e").alias("mean_e2e"))


@query
def resolve_run(wb: Workbench) -> DataFrame:
    """The newest run and a named one, each read from its own files."""
    root = _write_runs(wb)
    both = readers.read_run(wb.spark, root).unionByName(readers.read_run(wb.spark, root, "run-1"))
    return both.groupBy("run").agg(F.count(F.lit(1)).alias("requests"))


@query
def newest_runs(wb: Workbench) -> DataFrame:
    return readers.newest_runs(wb.records.select(F.col("run_id").alias("run")).distinct(), 2)


def _prompt_columns(prompts: DataFrame) -> DataFrame:
    return prompts.select(
        "id", "library", "category", "isl_bucket", "expected_output",
        F.size("messages").alias("messages"), F.size("tools").alias("tools"), F.size("tool_results").alias("tool_results"),
    )


@query
def scan_prompts(wb: Workbench) -> DataFrame:
    return _prompt_columns(wb.prompts())


@query
def scan_prompts_rejects(wb: Workbench) -> DataFrame:
    return dims.validate_prompts(wb.fx.raw_prompts())[1]


@query
def dim_models(wb: Workbench) -> DataFrame:
    return dims.model_registry(wb.fx.registry())


@query
def dim_slo(wb: Workbench) -> DataFrame:
    overrides = {"profile-5": {"ttft_ms": 300.0}, "relaxed": {"e2e_ms": 9000.0}, "fresh": {"tpot_ms": 7.0}}
    return dims.slo_profiles(wb.fx.profile_config(), overrides)


@query
def scan_chunks(wb: Workbench) -> DataFrame:
    chunks = readers.parse_stream_lines(wb.fx.call_lines())
    return chunks.select(
        "request_id", "seq", "arrival_s", "content", "done", "parse_ok",
        F.col("usage.prompt_tokens").alias("prompt_tokens"),
        F.col("usage.completion_tokens").alias("completion_tokens"),
        F.col("usage.cached_tokens").alias("cached_tokens"),
    )


@query
def line_records(wb: Workbench) -> DataFrame:
    """From logged lines, trailers included, to the facts of each request."""
    chunks = readers.parse_stream_lines(wb.fx.call_lines()).unionByName(wb.fx.closing_rows(), allowMissingColumns=True)
    return rec.response_facts(chunks).select(
        "request_id", "outcome", "status_code", "ttft", "tt2t", "e2e", "prompt_tokens", "output_tokens", "cached_tokens", "usage_incomplete",
        F.col("itl_summary.p95").alias("itl_p95"), "error",
    )


@query
def scan_chunk_table(wb: Workbench) -> DataFrame:
    path = wb.folder("chunks")
    wb.fx.chunks().write.parquet(path)
    return rec.first_token(readers.read_chunks(wb.spark, path))


@query
def scan_spans(wb: Workbench) -> DataFrame:
    path = wb.folder("spans")
    writers.append_spans(wb.fx.spans(), path)
    return readers.read_spans(wb.spark, path).select(
        "name", "trace_id", "span_id", "start_time", "end_time", "duration_s",
        F.col("attributes")["llm.outcome"].alias("outcome"),
    )


@query
def span_stats(wb: Workbench) -> DataFrame:
    return readers.span_stats(readers.with_duration(wb.fx.spans()))


# -- sinks ----------------------------------------------------------------------------


@query
def sink_raw(wb: Workbench) -> DataFrame:
    path = wb.folder("raw-by-run")
    writers.write_raw(wb.records, path)
    lines = wb.spark.read.text(path)
    return lines.groupBy(F.col("run_id")).agg(F.count(F.lit(1)).alias("lines"))


@query
def drop_content(wb: Workbench) -> DataFrame:
    kept = writers.drop_content(wb.records)
    return kept.select("request_id", F.lit(",".join(sorted(kept.columns))).alias("persisted"))


@query
def flatten_rollup(wb: Workbench) -> DataFrame:
    path = wb.folder("flat")
    writers.write_rollup(wb.records, path)
    flat = readers.read_flat_rollup(wb.spark, path)
    return _check_columns(flat)


def run_reports(wb: Workbench) -> DataFrame:
    summary = lv.run_summary(wb.records, wb.fx.runs(), wb.fx.models())
    return rounded(lv.run_report(summary, wb.levels, quality.coverage(wb.scored), tools.skip_counts(wb.prompts(), wb.fx.runs(), wb.fx.models())))


@query
def sink_summary(wb: Workbench) -> DataFrame:
    path, report = wb.folder("summary"), run_reports(wb)
    writers.write_summary(wb.levels, path, report)
    rows = wb.spark.read.schema(report.schema).json(path)
    return rows.select("run_id", "requests", "tools_unsupported", "judged", F.explode("levels").alias("level")).select(
        "run_id", "requests", "tools_unsupported", "judged", F.col("level.level_or_rate").alias("level_or_rate"),
        F.col("level.completed").alias("completed"), F.col("level.e2e_p99").alias("e2e_p99"),
    )


@query
def sink_tool_calls(wb: Workbench) -> DataFrame:
    path = wb.folder("tool-calls")
    writers.write_tool_calls(tools.distinct_tool_calls(wb.fx.tool_calls()), path)
    ddl = "tool string, arguments string, result string, first_seq bigint, run_id string"
    return wb.spark.read.schema(ddl).json(path).groupBy("run_id").agg(F.count(F.lit(1)).alias("calls"))


@query
def dedup_tool_calls(wb: Workbench) -> DataFrame:
    return tools.distinct_tool_calls(wb.fx.tool_calls())


@query
def sink_spans(wb: Workbench) -> DataFrame:
    path = wb.folder("spans")
    spans = wb.fx.spans()
    failed = F.col("attributes")["llm.outcome"] == "rate_limited"
    writers.append_spans(spans.where(~failed), path)
    writers.append_spans(spans.where(failed), path)
    return readers.span_stats(readers.read_spans(wb.spark, path))


# -- per-request derivation -------------------------------------------------------------


@query
def ttft(wb: Workbench) -> DataFrame:
    return rec.first_token(wb.fx.content_chunks())


@query
def tt2t(wb: Workbench) -> DataFrame:
    return rec.second_token_gap(rec.inter_token_gaps(wb.fx.chunks()))


@query
def itl_gaps(wb: Workbench) -> DataFrame:
    return rec.inter_token_gaps(wb.fx.chunks())


def _flat_summary(df: DataFrame) -> DataFrame:
    names = ("mean", "p50", "p95", "p99", "max")
    return df.select(
        *[c for c in df.columns if c not in ("itl_summary", "itl_list")],
        *[F.col(f"itl_summary.{n}").alias(f"itl_{n}") for n in names],
    )


@query
def itl_summary(wb: Workbench) -> DataFrame:
    return _flat_summary(rec.itl_summary(wb.fx.content_chunks()))


@query
def itl_list(wb: Workbench) -> DataFrame:
    return rec.itl_lists(rec.inter_token_gaps(wb.fx.chunks())).select(
        "request_id",
        F.size("itl_list").alias("gaps"),
        F.get("itl_list", F.lit(0)).alias("first_gap"),
        F.element_at("itl_list", -1).alias("last_gap"),
    )


@query
def tpot(wb: Workbench) -> DataFrame:
    return wb.records.select("request_id", "tpot")


@query
def norm_latency(wb: Workbench) -> DataFrame:
    return wb.records.select("request_id", "normalized_latency")


@query
def cost_usd(wb: Workbench) -> DataFrame:
    return wb.records.select("request_id", "model", "cost_usd")


@query
def isl_bucket(wb: Workbench) -> DataFrame:
    return wb.records.select("request_id", "prompt_tokens", "isl_bucket")


@query
def osl_bucket(wb: Workbench) -> DataFrame:
    return wb.records.select("request_id", "output_tokens", "osl_bucket")


@query
def usage_fold(wb: Workbench) -> DataFrame:
    return rec.usage_fold(wb.fx.content_chunks())


@query
def classify_outcome(wb: Workbench) -> DataFrame:
    return rec.classify_outcomes(wb.fx.chunks())


@query
def phase_tag(wb: Workbench) -> DataFrame:
    return rec.tag_phases(wb.fx.requests(), wb.fx.runs()).select("request_id", "run_id", "t_start", "phase")


@query
def steady_end(wb: Workbench) -> DataFrame:
    return rec.run_windows(wb.fx.run_candidates()).select("run_id", "duration_s", "warmup_s", "cooldown_s", "steady_end_s")


@query
def validate_runs(wb: Workbench) -> DataFrame:
    return dims.validate_runs(wb.fx.run_candidates())


@query
def duration_s(wb: Workbench) -> DataFrame:
    number = (F.col("o_custkey") % 600).cast("string")
    text = (
        F.when(F.col("o_orderkey") % 6 == 0, F.concat(number, F.lit("ms")))
        .when(F.col("o_orderkey") % 6 == 1, F.concat(F.lit(" "), number, F.lit(".5 s ")))
        .when(F.col("o_orderkey") % 6 == 2, F.concat(number, F.lit("m")))
        .when(F.col("o_orderkey") % 6 == 3, F.concat(number, F.lit("h")))
        .when(F.col("o_orderkey") % 6 == 4, number)
        .otherwise(F.concat(number, F.lit(" days")))
    )
    return wb.fx.table("orders").select("o_orderkey", text.alias("text")).withColumn("seconds", scalars.duration_s(F.col("text")))


@query
def unit_scale(wb: Workbench) -> DataFrame:
    names = ("ttft", "e2e", "input_tokens", "output_tokens")
    cells = F.array(
        *[F.struct(F.lit(n).alias("metric"), F.col(fixed.PANEL_METRICS[n][0]).cast("double").alias("stored")) for n in names]
    )
    long = wb.records.select("request_id", F.inline(cells))
    return long.select("request_id", "metric", (F.col("stored") * scalars.unit_scale(F.col("metric"))).alias("shown"))


@query
def cache_violation(wb: Workbench) -> DataFrame:
    return wb.records.select("request_id", "cached_tokens", "cache_violation")


@query
def cache_bust_prefix(wb: Workbench) -> DataFrame:
    return tools.bust_cache(wb.fx.table("conversations"), 7)


@query
def cache_bust_messages(wb: Workbench) -> DataFrame:
    messages = tools.bust_messages(F.col("messages"), tools.marker(F.col("id"), F.lit(7)))
    return wb.prompts().select("id", F.get(messages, F.lit(0))["content"].alias("content"))


@query
def prompt_caps(wb: Workbench) -> DataFrame:
    return tools.prompt_needs(wb.prompts()).select("id", "requires_tools", "requires_vision")


@query
def tool_call_merge(wb: Workbench) -> DataFrame:
    return tools.merge_tool_calls(wb.fx.content_chunks())


@query
def tool_args_parse(wb: Workbench) -> DataFrame:
    broken = F.when(F.col("seq") % 3 == 0, F.col("arguments")).when(F.col("seq") % 3 == 1, "{broken").otherwise("[1]")
    return tools.parse_tool_arguments(wb.fx.tool_calls().withColumn("arguments", broken)).select("seq", "tool", "arguments")


@query
def output_text(wb: Workbench) -> DataFrame:
    return rec.output_text(wb.fx.content_chunks())


@query
def slug(wb: Workbench) -> DataFrame:
    return wb.fx.table("pages").select("page_id", scalars.slug(F.col("url")).alias("slug"))


@query
def self_preference(wb: Workbench) -> DataFrame:
    judge, model = F.concat(F.lit("vendor-"), F.col("s_suppkey") % 25, F.lit("/judge")), F.col("model")
    rows = wb.fx.registry().withColumn("s_suppkey", F.col("position"))
    return rows.select("name", scalars.family(model).alias("family"), scalars.self_preference(judge, model).alias("same_family"))


@query
def summary_row(wb: Workbench) -> DataFrame:
    return lv.summary_rows(wb.levels)


def _flat_record(records: DataFrame) -> DataFrame:
    return _flat_summary(records.drop("expected_output"))


@query
def record_build(wb: Workbench) -> DataFrame:
    return _flat_record(wb.build_records())


# -- filters ------------------------------------------------------------------------------


@query
def steady_success(wb: Workbench) -> DataFrame:
    return lv.steady_success(wb.records).select("request_id", "run_id", "level_or_rate")


@query
def meets_slo(wb: Workbench) -> DataFrame:
    return lv.slo_meeting(wb.records, wb.fx.runs(), wb.slo()).select("request_id", "meets_slo")


@query
def eval_eligible(wb: Workbench) -> DataFrame:
    return quality.eval_eligible(wb.records).select("request_id", "phase")


@query
def numeric_only(wb: Workbench) -> DataFrame:
    """A record log whose metric holds numbers, numbers as text, words and nulls."""
    value = (
        F.when(F.col("o_orderkey") % 4 == 0, F.format_string('{"request_id": "%d", "ttft": %d.5}', "o_orderkey", "o_custkey"))
        .when(F.col("o_orderkey") % 4 == 1, F.format_string('{"request_id": "%d", "ttft": "%d.5"}', "o_orderkey", "o_custkey"))
        .when(F.col("o_orderkey") % 4 == 2, F.format_string('{"request_id": "%d", "ttft": %d}', "o_orderkey", "o_custkey"))
        .otherwise(F.format_string('{"request_id": "%d", "ttft": null}', "o_orderkey"))
    )
    from tidegauge import schemas

    lines = wb.fx.table("orders").select(value.alias("value"))
    return readers.parse_lines(lines, schemas.request_record()).select("request_id", "ttft")


@query
def failures_excluded(wb: Workbench) -> DataFrame:
    return lv.steady_success(wb.records).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("samples"), F.max("e2e").alias("max_e2e"), F.sum("output_tokens").alias("tokens")
    )


# -- joins ---------------------------------------------------------------------------------


@query
def eval_backfill(wb: Workbench) -> DataFrame:
    return quality.backfill(wb.records, wb.fx.eval_results()).select("request_id", "eval_status", *quality.SCORES)


@query
def eval_status(wb: Workbench) -> DataFrame:
    return wb.scored.groupBy("run_id", "eval_status").agg(F.count(F.lit(1)).alias("requests"))


@query
def prompt_enrich(wb: Workbench) -> DataFrame:
    return rec.enrich_prompts(wb.fx.requests(), wb.prompts()).select("request_id", "prompt_id", "category", "expected_output")


@query
def price_enrich(wb: Workbench) -> DataFrame:
    return rec.enrich_prices(wb.fx.requests(), wb.fx.runs(), wb.fx.models()).select(
        "request_id", "mode", "model", "price_input", "price_output"
    )


@query
def slo_enrich(wb: Workbench) -> DataFrame:
    return lv.slo_meeting(wb.records, wb.fx.runs(), wb.slo()).select("request_id", "ttft_ms", "tpot_ms", "e2e_ms")


@query
def capability_gate(wb: Workbench) -> DataFrame:
    return tools.gate_prompts(wb.prompts(), wb.fx.runs(), wb.fx.models())


@query
def skip_counts(wb: Workbench) -> DataFrame:
    return tools.skip_counts(wb.prompts(), wb.fx.runs(), wb.fx.models())


@query
def tool_result_lookup(wb: Workbench) -> DataFrame:
    calls = wb.fx.table("lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "concat('prompt-', cast(l_partkey as string)) as prompt_id",
        "concat('tool-', cast(l_suppkey % 7 as string)) as name",
    )
    found = tools.lookup_tool_results(calls, wb.prompts())
    return found.groupBy("prompt_id", "name", "result").agg(F.count(F.lit(1)).alias("calls"))


@query
def levels_left(wb: Workbench) -> DataFrame:
    counts = lv.reliability(wb.records)
    joined = lv.configured_levels(wb.fx.run_levels()).join(counts, LEVEL, "left")
    return joined.select(*LEVEL, F.coalesce("steady_samples", F.lit(0).cast("long")).alias("steady_samples"))


@query
def pair_cosine(wb: Workbench) -> DataFrame:
    return quality.pair_cosine(wb.fx.vectors())


@query
def level_overlap(wb: Workbench) -> DataFrame:
    return load.level_overlap(wb.records)


@query
def replay_prefix(wb: Workbench) -> DataFrame:
    return load.replay_prefix(wb.fx.requests(), "run-0")


# -- aggregates -------------------------------------------------------------------------------


@query
def pct_object(wb: Workbench) -> DataFrame:
    return lv.percentile_objects(wb.records)


@query
def itl_pool(wb: Workbench) -> DataFrame:
    return lv.value_stats(lv.gap_pool(wb.slim_records, LEVEL, wb.gaps), LEVEL)


@query
def steady_window(wb: Workbench) -> DataFrame:
    return lv.throughput(wb.records).select(*LEVEL, "steady_window_s")


@query
def throughput(wb: Workbench) -> DataFrame:
    return lv.throughput(wb.records).select(*LEVEL, "completed", "system_tok_s", "total_tok_s", "rps")


@query
def per_user_tok_s(wb: Workbench) -> DataFrame:
    return lv.throughput(wb.records).select(*LEVEL, "per_user_tok_s")


@query
def goodput(wb: Workbench) -> DataFrame:
    return lv.goodput(wb.records, wb.fx.runs(), wb.slo()).select(*LEVEL, "goodput_count", "goodput_attainment", "goodput_rps")


@query
def level_cost(wb: Workbench) -> DataFrame:
    return lv.level_cost(wb.records)


@query
def run_cost(wb: Workbench) -> DataFrame:
    return lv.run_cost(wb.levels)


@query
def reliability(wb: Workbench) -> DataFrame:
    return lv.reliability(wb.records)


@query
def level_summary(wb: Workbench) -> DataFrame:
    return wb.build_levels(wb.records)


@query
def run_summary(wb: Workbench) -> DataFrame:
    return run_reports(wb).withColumn("levels", F.size("levels"))


@query
def counters(wb: Workbench) -> DataFrame:
    return lv.counters(wb.records)


@query
def eval_coverage(wb: Workbench) -> DataFrame:
    return quality.coverage(wb.scored)


@query
def cosine(wb: Workbench) -> DataFrame:
    """Each vector against the reversed copy of itself and against zero."""
    v = F.col("embedding")
    zero = F.transform(v, lambda x: F.lit(0.0))
    return wb.fx.table("embeddings").select(
        "vec_id", scalars.cosine(v, F.reverse(v)).alias("to_reverse"), scalars.cosine(v, zero).alias("to_zero")
    )


CATEGORY_VALUES = tuple(panels.Value("e2e", agg) for agg in fixed.PANEL_AGGREGATES)


@query
def panel_agg(wb: Workbench) -> DataFrame:
    found = panels.cells(wb.scored, [("category", None, CATEGORY_VALUES)]).drop("axes", "g")
    return found.withColumnRenamed("x", "category")


@query
def panel_rate(wb: Workbench) -> DataFrame:
    values = (panels.Value("rps"), panels.Value("system_tok_s"))
    found = panels.cells(wb.scored, [("category", "osl_bucket", values)])
    return found.select("run_id", F.col("x").alias("category"), F.col("g").alias("osl_bucket"), "rps_p50", "system_tok_s_p50")


@query
def tool_call_counts(wb: Workbench) -> DataFrame:
    return tools.tool_call_counts(wb.fx.tool_calls())


# -- panels -------------------------------------------------------------------------------------

PIVOT = panels.Panel(
    "E2E by length", "isl_bucket", (panels.Value("e2e", "p50"), panels.Value("rps"), panels.Value("quality_score", "count")), "category"
)


@query
def panel_pivot(wb: Workbench) -> DataFrame:
    return panels.compute_panel(wb.scored, PIVOT)


@query
def panel_dense(wb: Workbench) -> DataFrame:
    values = (panels.Value("cost_usd", "count"),)
    grid = panels.dense_grid(settle(panels.cells(wb.scored, [("prompt_id", "osl_bucket", values)])), zero=panels.counted_values(values))
    return grid.select("run_id", "x", "g", "cost_usd_count")


@query
def axis_order(wb: Workbench) -> DataFrame:
    names = ("level_or_rate", "isl_bucket", "category", "prompt_id")
    parts = [panels.order_axis(panels.distinct_axis(wb.records, n)).withColumn("dimension", F.lit(n)) for n in names]
    return reduce(DataFrame.unionByName, parts)


@query
def dash_from_file(wb: Workbench) -> DataFrame:
    """The starter dashboard from its definitions, written as one JSON array and read again."""
    path = wb.folder("dashboard") + ".json"
    panel = lambda p: {"title": p.title, "x": p.x, "values": [{"metric": v.metric, "agg": v.agg} for v in p.values]} | ({"group": p.group} if p.group else {})
    text = json.dumps([panel(p) for p in panels.STARTER_PANELS], indent=1)
    wb.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return panels.compute_panels(wb.scored, panels.panels_of(readers.read_panel_definitions(wb.spark, path)))


@query
def panel_definitions(wb: Workbench) -> DataFrame:
    """Definitions that may be used and those that may not: one per customer, some wrong."""
    rows = wb.fx.table("customer").selectExpr(
        "cast(c_custkey as int) as position", "case when c_custkey % 3 = 0 then '' else c_name end as title",
        "case c_nationkey % 4 when 0 then 'model' when 1 then 'level_or_rate' when 2 then 'nothing' end as x",
        "case c_custkey % 5 when 0 then 'isl_bucket' when 1 then '' when 2 then 'other' end as `group`",
        "case c_custkey % 7 when 0 then 'line' when 1 then 'pie' end as chart",
        "case when c_custkey % 11 <> 0 then array(named_struct('metric', case when c_custkey % 13 = 0 then 'speed' else 'ttft' end, "
        "'agg', case c_custkey % 17 when 0 then 'median' when 1 then 'p99' end)) end as `values`",
    )
    good, bad = panels.check_definitions(rows)
    agg = F.get("values", F.lit(0))["agg"].alias("agg")
    return good.select("position", "title", "x", "group", "chart", agg, F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select("position", "title", "x", "group", "chart", agg, "reason")
    )


@query
def panel_sparse(wb: Workbench) -> DataFrame:
    """One series per prompt: only the points that exist, in the order of both axes."""
    by_prompt = panels.Panel("Tokens by prompt", "level_or_rate", (panels.Value("output_tokens", "max"), panels.Value("rps")), "prompt_id")
    return panels.compute_panel(wb.scored, by_prompt, dense=False)


@query
def distinct_axis(wb: Workbench) -> DataFrame:
    return panels.distinct_axis(wb.records, "prompt_id")


@query
def series_name(wb: Workbench) -> DataFrame:
    value = panels.Value("ttft", "p99")
    return panels.distinct_axis(wb.records, "level_or_rate").select(
        "run_id", panels.series_name(F.lit(value.label), F.col("x")).alias("series")
    )


@query
def chart_kind(wb: Workbench) -> DataFrame:
    parts = [
        panels.order_axis(panels.distinct_axis(wb.records, n)).select(
            "run_id", F.lit(n).alias("dimension"), panels.chart_kind("auto").alias("chart")
        ).distinct()
        for n in ("level_or_rate", "isl_bucket")
    ]
    return parts[0].unionByName(parts[1])


@query
def dash_default(wb: Workbench) -> DataFrame:
    return panels.compute_panels(wb.scored, panels.STARTER_PANELS)


# -- windows ---------------------------------------------------------------------------------------


@query
def arrival_gaps(wb: Workbench) -> DataFrame:
    return load.arrival_gaps(wb.fx.requests(), wb.fx.runs())


@query
def in_flight(wb: Workbench) -> DataFrame:
    return load.in_flight(wb.records)


@query
def load_peaks(wb: Workbench) -> DataFrame:
    return load.load_peaks(wb.records, wb.fx.runs())


@query
def seq_position(wb: Workbench) -> DataFrame:
    return load.sequence_positions(wb.fx.requests()).select("run_id", "request_id", "position")


@query
def chunk_order(wb: Workbench) -> DataFrame:
    return rec.chunk_order(wb.fx.content_chunks())


@query
def union_modes(wb: Workbench) -> DataFrame:
    is_open = F.col("mode") == fixed.OPEN
    closed = wb.levels.where(~is_open).drop("max_outstanding_events")
    return lv.union_modes(closed, wb.levels.where(is_open)).select(*LEVEL, "mode", "completed", "max_outstanding_events")


# -- quality ------------------------------------------------------------------------------------------


@query
def embed_score(wb: Workbench) -> DataFrame:
    return quality.embed_score(quality.pair_cosine(wb.fx.vectors()), 0.2)


def _replies(wb: Workbench) -> DataFrame:
    return wb.fx.judge_replies().withColumn("content", quality.reply_content(F.col("body")))


@query
def reply_content(wb: Workbench) -> DataFrame:
    return _replies(wb).select("request_id", "content")


@query
def judge_score(wb: Workbench) -> DataFrame:
    scored = _replies(wb).withColumn("s", quality.judge_score(F.col("content")))
    return scored.select("request_id", F.col("s.score").alias("score"), F.col("s.reason").alias("reason"))


@query
def judge_verdict(wb: Workbench) -> DataFrame:
    judged = _replies(wb).withColumn("j", quality.judge_verdict(F.col("content")))
    return judged.select("request_id", F.col("j.verdict").alias("verdict"), F.col("j.reason").alias("reason"))


@query
def verdict_norm(wb: Workbench) -> DataFrame:
    judged = _replies(wb).withColumn("j", quality.judge_verdict(F.col("content")))
    return judged.select("request_id", "rubric", quality.normalize_verdict(F.col("j.verdict"), F.col("rubric")).alias("verdict"))


@query
def verdict_score(wb: Workbench) -> DataFrame:
    verdict = F.when(F.col("quality") == 1, "pass").when(F.col("toxic") == 1, "incorrect").when(
        F.col("doc_id") % 3 == 0, "partial").otherwise("unsure")
    return wb.fx.table("labels").select("doc_id", verdict.alias("verdict")).withColumn(
        "score", quality.verdict_score(F.col("verdict"))
    )


@query
def score_replies(wb: Workbench) -> DataFrame:
    return quality.score_replies(wb.fx.judge_replies()).drop("sim_score")


@query
def text_counts(wb: Workbench) -> DataFrame:
    """Characters, spaces and letters of each text, which need no model."""
    text = F.col("text")
    without = lambda letter: (F.char_length(text) - F.char_length(F.replace(text, F.lit(letter), F.lit("")))).cast("double")
    return wb.fx.table("documents").select(
        "doc_id", F.char_length(text).cast("double").alias("chars"), without(" ").alias("spaces"), without("e").alias("letters_e")
    )


# -- SQL -------------------------------------------------------------------------------------------------

SQL_VIEWS = {
    "adhoc_sql": "select outcome, count(*) as n, sum(output_tokens) as tokens, avg(e2e) as mean_e2e from data group by outcome",
    "adhoc_p99": "select run_id, level_or_rate, percentile_cont(0.99) within group (order by ttft) as p99 from data "
    "where phase = 'steady' and outcome = 'success' group by run_id, level_or_rate",
    "adhoc_self_join": "with c as (select run_id, prompt_id, level_or_rate, count(*) as n from data group by run_id, prompt_id, level_or_rate) "
    "select a.run_id, sum(a.n * b.n) as pairs from c a join c b "
    "on a.prompt_id = b.prompt_id and a.run_id = b.run_id and a.level_or_rate = 1 and b.level_or_rate = 4 group by a.run_id",
    "adhoc_rollup": "select run_id, phase, count(*) as n from data group by rollup(run_id, phase)",
    "adhoc_cube": "select mode, outcome, count(*) as n from data group by cube(mode, outcome)",
    "adhoc_grouping_sets": "select run_id, outcome, sum(output_tokens) as tokens from data "
    "group by grouping sets ((run_id), (outcome), ())",
    "adhoc_rank": "select run_id, category, tokens, rank() over (partition by run_id order by tokens desc) as place from "
    "(select run_id, category, sum(output_tokens) as tokens from data group by run_id, category)",
    "adhoc_union": "select prompt_id from data where run_id = 'run-1' and outcome <> 'success' union "
    "select prompt_id from data where run_id = 'run-2' and outcome <> 'success'",
    "adhoc_intersect": "select prompt_id from data where run_id = 'run-0' and outcome = 'success' intersect "
    "select prompt_id from data where run_id = 'run-0' and outcome <> 'success'",
    "adhoc_except": "select prompt_id from data where outcome = 'success' except "
    "select prompt_id from data where outcome <> 'success'",
    "adhoc_distinct": "select distinct run_id, model, category from data",
}


def _register_sql(name: str, sql: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(adhoc.query_frame(workbench(spark, folder).records, sql))

    QUERIES[name] = run


for _name, _sql in SQL_VIEWS.items():
    _register_sql(_name, _sql)


@query
def adhoc_tool_log(wb: Workbench) -> DataFrame:
    """SQL over a log whose columns are its own."""
    path = wb.folder("tool-log")
    writers.write_tool_calls(tools.distinct_tool_calls(wb.fx.tool_calls()), path)
    sql = "select tool, count(*) as calls, count(distinct arguments) as kinds, min(first_seq) as first_seq from data group by tool"
    return adhoc.query_file(wb.spark, path, sql)


@query
def adhoc_json(wb: Workbench) -> DataFrame:
    """SQL over JSON in the forms that logs and summaries come in: lines, one array, one document per file."""
    lines, array, documents = wb.folder("lines"), wb.folder("array") + ".json", wb.folder("documents")
    number = "case when c_custkey % 7 = 0 then 'NaN' else cast(c_custkey % 100 as string) end"
    wb.fx.table("customer").selectExpr(
        f"""concat('{{"AVOID": ', cast(c_custkey as string), ', "it\\'s": "', c_mktsegment, '", "v": ', {number}, '}}') as value"""
    ).write.text(lines)
    # Twenty-five rows, one text.
    item = """concat('{"AVOID": ', cast(n_nationkey as string), ', "it\\'s": "', n_name, '", "v": ', cast(n_regionkey as string), '}')"""
    wb.fx.table("nation").selectExpr(f"concat('[', array_join(collect_list({item}), ','), ']') as value").write.text(array)
    for number in range(5):
        one = wb.fx.runs().where(F.col("run_id") == f"run-{number}").select(
            F.to_json(F.struct(F.lit(number).alias("AVOID"), F.col("slo_profile").alias("it's"), F.struct(F.col("min_samples").alias("v")).alias("limits")), {"pretty": "true"}).alias("value")
        )
        one.write.mode("append").text(documents)
    sql = "select '{0}' as form, count(*) as n, sum(AVOID) as total, count(distinct `it's`) as kinds, count_if(isnan({1})) as odd, sum(nanvl({1}, 0)) as v from data"
    forms = (("lines", lines, "v"), ("array", array, "cast(v as double)"), ("documents", documents, "cast(limits.v as double)"))
    parts = [adhoc.query_file(wb.spark, path, sql.format(form, value)) for form, path, value in forms]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


# -- report series ------------------------------------------------------------------------------------------


@query
def sys_tput_vs_level(wb: Workbench) -> DataFrame:
    return series.system_throughput(wb.levels)


@query
def ttft_vs_level(wb: Workbench) -> DataFrame:
    return series.ttft_by_level(lv.percentile_objects(wb.records))


@query
def user_tok_vs_level(wb: Workbench) -> DataFrame:
    return series.user_throughput(wb.levels)


@query
def ttft_vs_tput(wb: Workbench) -> DataFrame:
    return series.ttft_against_throughput(lv.percentile_objects(wb.records), lv.throughput(wb.records))


@query
def ttft_cdf(wb: Workbench) -> DataFrame:
    return series.ttft_cdf(wb.records)


@query
def ttft_cdf_grid(wb: Workbench) -> DataFrame:
    return series.ttft_cdf_grid(wb.records, [i / 10 for i in range(11)])


@query
def outcome_share(wb: Workbench) -> DataFrame:
    return series.outcome_share(wb.records)


@query
def compare_models(wb: Workbench) -> DataFrame:
    return series.compare_runs(wb.levels, "run-0")


# -- streams ----------------------------------------------------------------------------------------------------

DELAY = "30 seconds"
# What an end row must hold to pass the filters before the watermark.
STEADY_MARK = {"phase": "steady", "outcome": "success", "e2e": 0.0}


@query
def stream_assemble(wb: Workbench) -> DataFrame:
    """Records of a stream, gaps included; it ends with a row that closes every request."""
    return _flat_summary(jobs.run_assembly(wb.fx.streamed().timed_chunks(), "20 seconds", DELAY))


@query
def stream_backfill(wb: Workbench) -> DataFrame:
    fx = wb.fx.streamed()
    results = fx.timed_results().unionAll(fx.timed_results())  # every score is delivered twice
    return jobs.run_whole(lambda ours, theirs: jobs.backfill(ours, theirs, DELAY, "5 minutes"), [fx.timed_records(), results])


@query
def stream_levels(wb: Workbench) -> DataFrame:
    return jobs.run_whole(lambda r: jobs.level_reliability(r, "10 minutes", DELAY), [wb.fx.streamed().timed_records()], STEADY_MARK)


@query
def stream_levels_sliding(wb: Workbench) -> DataFrame:
    return jobs.run_whole(
        lambda r: jobs.level_reliability(r, "20 minutes", DELAY, "10 minutes"), [wb.fx.streamed().timed_records()], STEADY_MARK
    )


@query
def stream_level_percentiles(wb: Workbench) -> DataFrame:
    found = jobs.run_level_percentiles(wb.fx.streamed().timed_records(), "e2e", "30 minutes", DELAY, (0.5, 0.99))
    return found.select(
        "window_start", *LEVEL, "samples", F.col("quantiles")[0].alias("e2e_p50"), F.col("quantiles")[1].alias("e2e_p99")
    )


@query
def stream_progress(wb: Workbench) -> DataFrame:
    fx = wb.fx.streamed()
    return jobs.run_updates(jobs.progress(fx.timed_records(), fx.timed_results()), ["run_id"])


@query
def stream_alerts(wb: Workbench) -> DataFrame:
    return jobs.run_whole(
        lambda r: jobs.alerts(jobs.level_reliability(r, "10 minutes", DELAY), 20), [wb.fx.streamed().timed_records()], STEADY_MARK
    )


@query
def stream_late(wb: Workbench) -> DataFrame:
    """All requests, then the newest again, then all again: by then the watermark drops the late ones.

    Windows that it has not passed count every delivery. Each delivery is one batch by construction;
    a ledger of the batches tells how many rows were dropped in all.
    """
    rows = wb.fx.timed_records().select("request_id", "ts")
    newest = rows.agg((F.max("ts") - F.expr(f"interval {DELAY}")).alias("from_ts"))
    again = rows.join(F.broadcast(newest), F.col("ts") >= F.col("from_ts"), "left_semi")
    counted, ledger = jobs.run_in_turns(lambda requests: jobs.arrivals_per_window(requests, "10 minutes", DELAY), [rows, again, rows])
    dropped = F.lit(ledger.total("delivered.rows")) - F.col("_counted")
    total = counted.agg(F.sum("requests").alias("_counted"))
    # One row by construction.
    return counted.join(F.broadcast(total)).select("window_start", "requests", dropped.cast("bigint").alias("dropped_in_all"))


@query
def stream_dedup(wb: Workbench) -> DataFrame:
    fx = wb.fx.streamed()
    twice = fx.timed_records().unionByName(fx.timed_records())
    return jobs.run_to_table(jobs.deduplicate(twice, "1 day")).select("run_id", "request_id")
