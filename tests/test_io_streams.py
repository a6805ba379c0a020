from __future__ import annotations

import json
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import adhoc
from tidegauge.operators import records as rec
from tidegauge.plans.workbench import workbench
from tidegauge.sources import readers, writers
from tidegauge.streaming import jobs
from tidegauge.streaming.assembly import Assembly
from tidegauge.streaming.ledger import Ledger
from tidegauge.streaming.windows import WindowPercentiles


@pytest.fixture(scope="module")
def wb(spark, folder):
    return workbench(spark, folder)


def test_raw_lines_survive_junk(spark, tmp_path):
    path = tmp_path / "raw.jsonl"
    rows = [{"request_id": "a", "ttft": 1.5, "output_tokens": 3}, {"request_id": "b", "ttft": "1.5", "output_tokens": 1.5}]
    path.write_text("\n".join([json.dumps(rows[0]), "", "   ", "{bad", "[1]", '"x"', "7", json.dumps(rows[1])]) + "\n")
    found = {r["request_id"]: (r["ttft"], r["output_tokens"]) for r in readers.read_raw(spark, str(path)).collect()}
    assert found == {"a": (1.5, 3), "b": (None, 1)}


def test_adhoc_sql(spark, tmp_path):
    path = tmp_path / "raw.jsonl"
    path.write_text("".join(json.dumps({"request_id": str(i), "output_tokens": 8}) + "\n" for i in range(50)))
    row = adhoc.query_file(spark, str(path), "select count(*) as n, sum(output_tokens) as tok from data").first()
    assert (row["n"], row["tok"]) == (50, 400)
    empty = tmp_path / "empty.jsonl"
    empty.write_text("")
    assert adhoc.query_file(spark, str(empty), "select count(*) as n from data").first()["n"] == 0
    with pytest.raises(adhoc.QueryError, match="data file not found: /nowhere/raw.jsonl"):
        adhoc.query_file(spark, "/nowhere/raw.jsonl", "select 1")
    with pytest.raises(adhoc.QueryError) as error:
        adhoc.query_file(spark, str(path), "selec nonsense")
    assert "\n" not in str(error.value)
    with pytest.raises(adhoc.QueryError):
        adhoc.query_file(spark, str(path), "select no_such_column from data")


def test_rollup_round_trip_and_empty_rollup(spark, tmp_path, wb):
    flat, empty = str(tmp_path / "flat"), str(tmp_path / "empty")
    writers.write_rollup(wb.records, flat)
    writers.write_rollup(wb.records.limit(0), empty)
    assert readers.read_flat_rollup(spark, flat).count() == wb.records.count()
    names = [f.name for f in readers.read_rollup(spark, empty).schema.fields]
    assert readers.read_rollup(spark, empty).count() == 0 and "itl_summary" in names
    assert not {"expected_output", "output_text"} & set(spark.read.parquet(flat).columns)


def test_runs_without_summary_are_not_listed(spark, tmp_path):
    for name, done in (("run-a", True), ("run-c", True), ("run-b", False)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "raw.jsonl").write_text('{"request_id": "x"}\n')
        if done:
            (tmp_path / name / "summary.json").write_text("{}")
    assert [r["run"] for r in readers.list_runs(spark, str(tmp_path)).collect()] == ["run-c", "run-a"]
    rows = readers.read_runs(spark, str(tmp_path))
    assert sorted(r["run"] for r in rows.collect()) == ["run-a", "run-c"]
    newest = readers.resolve_run(rows, readers.list_runs(spark, str(tmp_path)))
    assert [r["run"] for r in newest.collect()] == ["run-c"]
    assert [r["run"] for r in readers.read_run(spark, str(tmp_path)).collect()] == ["run-c"]
    assert [r["run"] for r in readers.read_run(spark, str(tmp_path), "run-a").collect()] == ["run-a"]
    assert readers.read_run(spark, str(tmp_path), "run-b").count() == readers.read_run(spark, str(tmp_path), "gone").count() == 0
    assert readers.read_run(spark, str(tmp_path), "gone").columns == rows.columns
    # Only the chosen run's file is in the plan.
    assert [f.rsplit("/", 2)[1] for f in readers.read_run(spark, str(tmp_path)).inputFiles()] == ["run-c"]
    assert {f.rsplit("/", 2)[1] for f in rows.inputFiles()} == {"run-a", "run-c"}
    (tmp_path / "none").mkdir()
    assert readers.list_runs(spark, str(tmp_path / "none")).count() == 0


def test_event_stream_lines(spark):
    usage = '{"choices": [], "usage": {"prompt_tokens": 5, "completion_tokens": 2, "completion_tokens_details": {"reasoning_tokens": 1}}}'
    call = '{"choices": [{"delta": {"tool_calls": [{"index": 1, "function": {"name": "f", "arguments": "{"}}]}, "finish_reason": "tool_calls"}]}'
    lines = ['data: {"choices": [{"delta": {"content": "hi"}}]}', ": ping", "event: x", "data: " + usage, "data:" + call, "data: {bad", "data: [1]", "data: [DONE]"]
    frame = spark.createDataFrame([("r", i, float(i), line) for i, line in enumerate(lines)], "request_id string, seq bigint, arrival_s double, line string")
    found = {r["seq"]: r for r in readers.parse_stream_lines(frame).collect()}
    assert set(found) == {0, 3, 4, 5, 6, 7}
    assert found[0]["content"] == "hi" and found[3]["usage"]["reasoning_tokens"] == 1
    assert found[4]["tool_calls"][0]["name"] == "f" and found[4]["finish_reason"] == "tool_calls"
    assert [found[i]["parse_ok"] for i in (0, 5, 6, 7)] == [True, False, False, True] and found[7]["done"]


def test_written_records_hold_no_text(wb):
    kept = set(writers.drop_content(wb.records).columns)
    assert "expected_output" not in kept and "itl_list" not in kept
    assert "itl_list" in writers.drop_content(wb.records, raw_itl=True).columns


FACTS = ("request_id", "outcome", "status_code", "ttft", "tt2t", "e2e", "prompt_tokens", "output_tokens", "cached_tokens", "reasoning_tokens",
         "usage_incomplete", "error", "itl_summary")


def rows_of(frame):
    tidy = lambda v: tuple(None if x is None else round(x, 9) for x in v) if isinstance(v, tuple) else round(v, 9) if isinstance(v, float) else v
    return {r["request_id"]: {name: tidy(r[name]) for name in FACTS} for r in frame.collect()}


def test_streamed_records_equal_the_batch(wb):
    streamed = rows_of(jobs.run_assembly(wb.fx.streamed().timed_chunks(), "20 seconds", "30 seconds"))
    assert len(streamed) > 1000 and streamed == rows_of(rec.response_facts(wb.fx.chunks()))


def test_requests_that_span_batches_are_folded_once(spark, wb, tmp_path):
    """Four deliveries cut through every request; one batch is folded twice, as after a failure."""
    chunks = wb.fx.timed_chunks().filter("cast(request_id as bigint) % 7 < 3")
    source = str(tmp_path / "in")
    chunks.limit(0).write.parquet(source)
    stream = spark.readStream.schema(chunks.schema).parquet(source)
    work = Assembly(spark, str(tmp_path / "job"), "20 seconds", "2000 seconds")
    cuts = [0.0, 0.4, 0.9, 1.5, 100.0]
    for number, (low, high) in enumerate(zip(cuts, cuts[1:])):
        # In the order of the log: a request's rows by arrival.
        batch = chunks.filter(f"arrival_s > {low} - 1e-9 and arrival_s <= {high} - 1e-9")
        batch.write.mode("append").parquet(source)
        work.start(stream).awaitTermination()
        if number == 1:
            work.fold(batch, 1)
    assert work.records().count() == 0
    last = chunks.limit(1).withColumns({"request_id": F.lit(None).cast("string"), "ts": F.lit(jobs.END).cast("timestamp")})
    last.write.mode("append").parquet(source)
    work.start(stream).awaitTermination()
    expected = rows_of(rec.response_facts(chunks.drop("ts")))
    assert rows_of(work.records()) == expected and len(expected) > 300
    assert work.records().agg(F.sum("disordered")).first()[0] == 0
    assert work.marks().agg(F.sum("late")).first()[0] == 0


def test_late_and_disordered_chunks_are_counted(spark, make_chunks, tmp_path):
    base = make_chunks({"a": [(0.1, "x", None), (0.2, "y", None), (0.4, "z", None)], "b": [(0.1, "q", None)]}, {"a": (0.5, True, True, 200, None)})
    timed = base.withColumn("ts", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("arrival_s")))
    source = str(tmp_path / "in")
    timed.limit(0).write.parquet(source)
    stream = spark.readStream.schema(timed.schema).parquet(source)
    work = Assembly(spark, str(tmp_path / "job"), "10 seconds", "5 seconds")
    far = timed.filter("request_id = 'b'").withColumns({"request_id": F.lit("c"), "ts": F.col("ts") + F.expr("interval 100 seconds")})
    turns = (timed.filter("request_id = 'a' and seq in (0, 2)"), timed.filter("request_id = 'a' and seq not in (0, 2)"), far, timed.filter("request_id = 'b'"))
    for batch in turns:
        batch.write.mode("append").parquet(source)
        work.start(stream).awaitTermination()
    (row,) = work.records().collect()
    assert (row["request_id"], row["outcome"], row["output_tokens"], row["disordered"]) == ("a", "success", 3, 1)
    assert [r["late"] for r in work.marks().orderBy("watermark", "late").collect()] == [0, 0, 0, 1]
    assert {r["request_id"] for r in work.gaps().collect()} == {"a"}


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    base = 1_704_067_200

    def delivery(name, seconds):
        rows = [(f"{name}{i}", s) for i, s in enumerate(seconds)]
        return spark.createDataFrame(rows, "request_id string, s bigint").selectExpr("request_id", f"timestamp_seconds({base} + s) as ts").repartition(3)

    turns = [delivery("1", [0, 10, 3000]), delivery("2", [3001]), delivery("3", [5, 6, 3002])]
    for number in range(3):
        found, ledger = jobs.run_in_turns(lambda r: jobs.arrivals_per_window(r, "10 minutes", "30 seconds"), turns, str(tmp_path / f"job{number}"))
        assert sorted(r["requests"] for r in found.collect()) == [2, 3]
        assert ledger.total("delivered.rows") == 7 and ledger.total("delivered.none") == 0
        batches = ledger.batches()
        assert batches.select("query_id", "batch_id").distinct().count() == batches.count()
        assert batches.agg(F.sum("dropped_by_state")).first()[0] >= 1


def test_a_ledger_keeps_more_batches_than_a_query(spark, tmp_path):
    source = str(tmp_path / "in")
    for number in range(5):
        spark.range(number, number + 2).selectExpr("id", f"timestamp_seconds({number} * 1000 + id) as ts").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id bigint, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source).observe("seen", F.count(F.lit(1)).alias("rows"))
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        with Ledger(spark, str(tmp_path / "ledger")) as ledger:
            query = jobs.start_to_files(stream, str(tmp_path / "job"))
            query.awaitTermination()
            ledger.settle(query)
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert len(query.recentProgress) <= 2 and ledger.total("seen.rows") == 10
    assert ledger.batches().filter("input_rows > 0").count() == 5


def test_sliding_windows_are_sums_of_their_halves(wb):
    records = wb.fx.streamed().timed_records
    halves = jobs.run_to_table(jobs.level_reliability(records(), "10 minutes", "0 seconds"))
    whole = jobs.run_to_table(jobs.level_reliability(records(), "20 minutes", "0 seconds", "10 minutes")).toPandas()
    parts = {(r["run_id"], r["level_or_rate"], r["window_start"]): r["steady_samples"] for r in halves.collect()}
    assert len(whole) > 0
    for row in whole.itertuples():
        starts = (row.window_start, row.window_start + timedelta(minutes=10))
        assert row.steady_samples == sum(parts.get((row.run_id, row.level_or_rate, s.to_pydatetime()), 0) for s in starts)


def test_raw_numbers_are_read_as_they_are(spark, tmp_path):
    lines = [
        '{"request_id": "a", "seed": 9007199254740993, "sim_score": NaN, "status_code": 200}',
        '{"request_id": "b", "e2e": Infinity, "ttft": -Infinity, "status_code": 3000000000}',
        '{"request_id": "c", "e2e": "NaN", "output_tokens": 1.5, "tpot": 0.25}',
        '{"request_id": "d", "e2e": NaN',
    ]
    (tmp_path / "raw.jsonl").write_text("\n".join(lines))
    found = {r["request_id"]: r for r in readers.read_raw(spark, str(tmp_path / "raw.jsonl")).collect()}
    assert sorted(found) == ["a", "b", "c"]
    assert found["a"]["seed"] == 9007199254740993 and found["a"]["sim_score"] != found["a"]["sim_score"] and found["a"]["status_code"] == 200
    assert found["b"]["e2e"] == float("inf") and found["b"]["ttft"] == float("-inf") and found["b"]["status_code"] is None
    assert found["c"]["e2e"] is None and found["c"]["output_tokens"] == 1 and found["c"]["tpot"] == 0.25


def test_run_names_are_taken_as_they_are(spark, tmp_path):
    names = ["plain", "with space", "a+b", "50%", "x,y", "q?", "s*", "[z]"]
    for name in names:
        (tmp_path / name).mkdir()
        (tmp_path / name / "summary.json").write_text("{}")
        (tmp_path / name / "raw.jsonl").write_text(json.dumps({"request_id": name}) + "\n")
    found = {(r["run"], r["request_id"]) for r in readers.read_runs(spark, str(tmp_path)).collect()}
    assert found == {(name, name) for name in names}
    assert [r["run"] for r in readers.read_run(spark, str(tmp_path), "s*").collect()] == ["s*"]


def test_window_percentiles_keep_cells_not_values(spark, tmp_path):
    rng = np.random.default_rng(4)
    base, rows = 1_704_067_200, []
    for i in range(6000):
        rows.append(("r", float(i % 2), "steady", "success", 5.0 + float(rng.random()) / 20, base + i))
    rows += [("r", 0.0, "warmup", "success", 99.0, base), ("r", 0.0, "steady", "timeout", 99.0, base), ("r", 0.0, "steady", "success", None, base)]
    frame = spark.createDataFrame(rows, "run_id string, level_or_rate double, phase string, outcome string, e2e double, s bigint").selectExpr("*", "timestamp_seconds(s) as ts")
    source = str(tmp_path / "in")
    frame.limit(0).write.parquet(source)
    stream = spark.readStream.schema(frame.schema).parquet(source)
    work = WindowPercentiles(spark, str(tmp_path / "job"), "e2e", "20 minutes", "60 seconds")
    for number, (low, high) in enumerate(((0, 900), (900, 3000), (3000, 6000))):
        part = frame.filter(f"s >= {base + low} and s < {base + high}")
        part.write.mode("append").parquet(source)
        work.start(stream).awaitTermination()
        if number == 1:
            work.fold(part, 1)  # again, as after a failure
        # Thousands of different values of two levels lie in the two cells around them.
        assert 0 < work.state(number).count() <= 2 * 2 * 2
    frame.filter(f"s = {base}").write.mode("append").parquet(source)
    work.start(stream).awaitTermination()
    found = {(r["window_start"].timestamp(), r["level_or_rate"]): r for r in work.percentiles((0.0, 0.5, 0.99)).collect()}
    good = [r for r in rows if r[2] == "steady" and r[3] == "success" and r[4] is not None]
    for (start, level), row in found.items():
        values = [r[4] for r in good if r[1] == level and start <= r[5] < start + 1200]
        assert row["samples"] == len(values) and row["quantiles"] == pytest.approx(np.quantile(values, (0, 0.5, 0.99)).tolist(), rel=1e-12)
    assert len(found) == 2 * 4 and work.marks().agg(F.sum("late")).first()[0] == 1
