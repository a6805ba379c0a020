from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import scalars
from tidegauge.operators import records as rec
from tidegauge.operators import tools

OK = (0.24, True, True, 200, None)


def by_id(frame):
    return {row["request_id"]: row for row in frame.collect()}


def test_first_tokens_and_gaps(make_chunks):
    arrivals = [0.1, 0.12, 0.14, 0.2, 0.22]
    chunks = make_chunks({"a": [(0.05, "", None), *[(t, "w", None) for t in arrivals]], "one": [(0.3, "w", None)], "none": [(0.1, "", None)]})
    facts = by_id(rec.itl_summary(chunks))
    assert facts["a"]["tt2t"] == pytest.approx(0.02)
    assert facts["a"]["itl_list"] == pytest.approx([0.02, 0.02, 0.06, 0.02])
    assert facts["a"]["itl_summary"]["p95"] == pytest.approx(0.054)
    assert facts["a"]["itl_summary"]["p99"] >= 0.05
    assert facts["one"]["itl_summary"] is None and facts["one"]["tt2t"] is None
    assert by_id(rec.first_token(chunks))["a"]["ttft"] == pytest.approx(0.1)
    assert by_id(rec.first_token(chunks))["none"]["ttft"] is None


def test_lists_and_gap_rows_agree_at_every_length(make_chunks):
    rng = np.random.default_rng(1)
    chunks = make_chunks({f"r{i}": [(float(t), "w", None) for t in np.sort(rng.random(n) * 5).round(3)] for i, n in enumerate((2, 5, 40, 400))})
    facts = by_id(rec.itl_summary(chunks))
    lists = by_id(rec.itl_lists(rec.inter_token_gaps(chunks, 0.1)))
    for name, row in facts.items():
        assert lists[name]["itl_list"] == pytest.approx(row["itl_list"])
        assert row["tt2t"] == row["itl_list"][0] and row["itl_summary"]["max"] == max(row["itl_list"])


def test_texts_are_one_row_each(make_chunks):
    chunks = make_chunks({"long": [(i / 10, f"{i};", None) for i in range(30)], "short": [(0.1, "a", None), (0.2, "", None), (0.3, "b", None)]})
    rows = {r["request_id"]: r["output_text"] for r in rec.output_text(chunks).collect()}
    assert rows == {"long": "".join(f"{i};" for i in range(30)), "short": "ab"}


def test_long_responses_need_no_list(make_chunks):
    rng = np.random.default_rng(2)
    times = np.sort(rng.random(3000)).round(4)
    chunks = make_chunks({"long": [(float(t), "w", None) for t in times]}, {"long": OK})
    gaps = rec.inter_token_gaps(chunks, 0.01)
    facts = rec.response_facts(chunks, gaps).drop("itl_list")
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    row, want = by_id(facts)["long"], np.diff(times)
    found = [row["itl_summary"][name] for name in ("mean", "p50", "p95", "p99", "max")]
    assert found == pytest.approx([want.mean(), *np.percentile(want, [50, 95, 99]), want.max()])
    assert row["tt2t"] == pytest.approx(want[0])
    parts = {r["part"]: r["text"] for r in rec.output_parts(chunks, 1000).collect()}
    assert parts == {0: "w" * 1000, 1: "w" * 1000, 2: "w" * 1000}


def test_repeated_arrivals_are_zero_gaps(make_chunks):
    chunks = make_chunks({"a": [(0.5, "x", None), (0.5, "y", None), (2.0, "z", None)]})
    gaps = rec.inter_token_gaps(chunks)
    assert by_id(rec.second_token_gap(gaps))["a"]["tt2t"] == 0.0
    assert sorted((r["gap"], r["n"]) for r in gaps.collect()) == [(0.0, 1), (1.5, 1)]


def test_usage_rules(make_chunks):
    chunks = make_chunks(
        {
            "last": [(0.1, "a", (5, 3, None, None)), (0.2, "b", (None, 8, 4, None))],
            "no-output": [(0.1, "a", (5, None, None, None))],
            "none": [(0.1, "a", None), (0.2, "", None), (0.3, "b", None)],
        }
    )
    found = by_id(rec.usage_fold(chunks))
    assert (found["last"]["prompt_tokens"], found["last"]["output_tokens"], found["last"]["cached_tokens"]) == (5, 8, 4)
    assert (found["no-output"]["output_tokens"], found["no-output"]["usage_incomplete"]) == (0, False)
    assert (found["none"]["output_tokens"], found["none"]["usage_incomplete"]) == (2, True)


def test_outcomes(make_chunks):
    finals = {
        "ok": OK,
        "429": (0.1, None, None, 429, None),
        "503": (0.1, None, None, 503, None),
        "cut": (0.1, False, True, 200, None),
        "bad-json": (0.1, True, False, 200, None),
        "late": (5.0, None, None, None, "timeout"),
        "refused": (0.1, None, None, None, "connection"),
        "broken": (0.1, None, None, None, "protocol"),
    }
    found = {k: r["outcome"] for k, r in by_id(rec.classify_outcomes(make_chunks({}, finals))).items()}
    assert found == {
        "ok": "success", "429": "rate_limited", "503": "connection_error", "cut": "malformed_stream",
        "bad-json": "malformed_stream", "late": "timeout", "refused": "connection_error", "broken": "malformed_stream",
    }


def test_a_malformed_stream_keeps_only_its_end_time(make_chunks):
    chunks = make_chunks({"x": [(0.1, "a", (5, 3, 1, 1)), (0.2, "b", None)]}, {"x": (0.7, False, True, 200, None)})
    row = by_id(rec.response_facts(chunks))["x"]
    assert (row["outcome"], row["e2e"], row["ttft"], row["tt2t"], row["itl_list"]) == ("malformed_stream", 0.7, None, None, None)
    assert (row["output_tokens"], row["prompt_tokens"], row["usage_incomplete"]) == (0, 0, False)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_scalar_golden_values(spark):
    lit = F.lit
    assert value(spark, scalars.tpot(lit(0.1), lit(0.24), lit(8))) == pytest.approx(0.02)
    assert value(spark, scalars.tpot(lit(0.1), lit(0.24), lit(1))) is None
    assert value(spark, scalars.tpot(lit(None).cast("double"), lit(0.24), lit(8))) is None
    assert value(spark, scalars.normalized_latency(lit(0.3), lit(8))) == pytest.approx(0.0375)
    assert value(spark, scalars.normalized_latency(lit(0.3), lit(0))) is None
    assert value(spark, scalars.cost_usd(lit(10), lit(8), lit(1.0), lit(2.0))) == pytest.approx(26e-6)
    assert value(spark, scalars.cost_usd(lit(10), lit(8), lit(None).cast("double"), lit(2.0))) is None
    for tokens, isl, osl in ((0, "short", "short"), (31, "short", "short"), (32, "short", "medium"), (255, "short", "medium"),
                             (256, "medium", "long"), (1023, "medium", "long"), (1024, "long", "long")):
        assert value(spark, scalars.isl_bucket(lit(""), lit(tokens))) == isl
        assert value(spark, scalars.osl_bucket(lit(tokens))) == osl
    assert value(spark, scalars.isl_bucket(lit("medium"), lit(3))) == "medium"


@pytest.mark.parametrize(
    "text,seconds",
    [("500ms", 0.5), ("2m", 120.0), ("1s", 1.0), ("1.5", 1.5), (" 2 h ", 7200.0), ("2 days", None), ("", None), ("-1s", None), ("1.s", None)],
)
def test_durations(spark, text, seconds):
    assert value(spark, scalars.duration_s(F.lit(text))) == (None if seconds is None else pytest.approx(seconds))


@pytest.mark.parametrize("text,slug", [("a b/c", "a-b-c"), ("--x--", "x"), ("///", "run"), ("ok_1.2-3", "ok_1.2-3"), ("é", "run")])
def test_slugs(spark, text, slug):
    assert value(spark, scalars.slug(F.lit(text))) == slug


def test_phases_and_steady_end(spark):
    end = scalars.steady_end(F.lit(2.0), F.lit(0.5), F.lit(0.5))
    assert value(spark, end) == 1.5
    assert value(spark, scalars.steady_end(F.lit(2.0), F.lit(1.0), F.lit(1.0))) == 2.0
    names = [value(spark, scalars.phase(F.lit(t), F.lit(0.5), F.lit(1.5))) for t in (0.49, 0.5, 1.49, 1.5)]
    assert names == ["warmup", "steady", "steady", "cooldown"]


def test_cosine(spark):
    vec = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    assert value(spark, scalars.cosine(vec(1, 0), vec(0.8, 0.6))) == pytest.approx(0.8)
    assert value(spark, scalars.cosine(vec(1, 0), vec(0, 0))) == 0.0
    assert value(spark, scalars.cosine(vec(1, 0), vec(1, 0, 0))) is None


def test_tool_calls(spark):
    piece = "array<struct<index:int,name:string,arguments:string>>"
    rows = [
        ("r", 1, [(0, "get", '{"a"'), (1, "put", "{")]),
        ("r", 2, [(0, "", ": 1}")]),
        ("r", 3, [(1, None, "}"), (None, "last", None)]),
    ]
    calls = {(r["index"]): (r["name"], r["arguments"]) for r in tools.merge_tool_calls(
        spark.createDataFrame(rows, f"request_id string, seq bigint, tool_calls {piece}")).collect()}
    assert calls == {0: ("last", '{"a": 1}'), 1: ("put", "{}")}
    for text, parsed in (('{"b": 1, "a": [2]}', '{"a":[2],"b":1}'), ("{broken", "{}"), ("[1]", "{}"), ("", "{}"), (None, "{}")):
        assert value(spark, scalars.tool_arguments(F.lit(text).cast("string"))) == parsed


def test_distinct_tool_calls_ignore_key_order(spark):
    rows = [("r", 5, "t", '{"a": 1, "b": {"y": 1, "x": 2}}', "1"), ("r", 2, "t", '{"b": {"x": 2, "y": 1}, "a": 1}', "1"), ("r", 3, "t", "{}", "1")]
    found = tools.distinct_tool_calls(spark.createDataFrame(rows, "run_id string, seq bigint, tool string, arguments string, result string"))
    assert sorted((r["first_seq"], r["arguments"]) for r in found.collect()) == [(2, '{"a":1,"b":{"x":2,"y":1}}'), (3, "{}")]


def test_prefix_goes_before_the_last_user_text(spark):
    rows = [(1, 0, "user", "first"), (1, 1, "user", "second"), (1, 2, "assistant", "reply"), (2, 0, "user", None)]
    found = {(r["conv_id"], r["turn"]): r["text"] for r in tools.bust_cache(
        spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), 1).collect()}
    assert found[(1, 0)] == "first" and found[(1, 2)] == "reply" and found[(2, 0)] is None
    assert found[(1, 1)].startswith("[cb-") and found[(1, 1)].endswith("] second")


def test_texts_of_calls_are_parsed_once_each(spark, monkeypatch):
    variants = ['{"a": 1, "b": {"d": 2, "c": 3}}', '{"b":{"c":3,"d":2},"a":1}', '{"a": 1}', "no json", None]
    rows = [("r", i, f"t{i % 2}", variants[i % 5], variants[i % 3]) for i in range(3000)]
    calls = spark.createDataFrame(rows, "run_id string, seq bigint, tool string, arguments string, result string")
    assert tools.canonical_texts(calls.selectExpr("arguments as text")).count() == 4
    fed = []
    whole = tools.canonical_texts
    monkeypatch.setattr(tools, "canonical_texts", lambda texts: fed.append(texts.where("text is not null").distinct().count()) or whole(texts))
    found = tools.distinct_tool_calls(calls).collect()
    assert fed == [4]
    form = {variants[0]: 0, variants[1]: 0, variants[2]: 2, variants[3]: 3, None: None}
    expected = {}
    for _, seq, tool, a, r in rows:
        expected.setdefault((tool, form[a], form[r]), seq)
    assert sorted(r["first_seq"] for r in found) == sorted(expected.values())


def test_the_gate_grows_with_runs_and_prompts(spark):
    prompts = spark.createDataFrame([(f"p{i}", "lib", ["general", "tool-use", "vision"][i % 3], [], ["x"] if i % 4 == 0 else []) for i in range(600)],
        "id string, library string, category string, messages array<struct<role:string,content:string,parts:array<struct<type:string,text:string>>>>, tools array<string>")
    models = spark.createDataFrame([(f"m{i}", f"v/m{i}", i % 2 == 0, i % 3 == 0) for i in range(6)], "name string, model string, supports_tools boolean, supports_vision boolean")
    runs = spark.createDataFrame([(f"r{i}", "lib", f"m{i % 6}") for i in range(50)], "run_id string, library string, model_name string")
    gate = tools.capability_gate(prompts, runs, models)
    assert gate.members.count() == 600 and gate.reasons.count() == 4 * 50
    pairs = gate.expand()
    assert pairs.count() == 600 * 50
    counted = {r["run_id"]: (r["tools_unsupported"], r["vision_unsupported"]) for r in gate.counts().collect()}
    by = {(r["run_id"], r["skip_reason"]): r["count"] for r in pairs.groupBy("run_id", "skip_reason").count().collect()}
    assert counted == {f"r{i}": (by.get((f"r{i}", "tools_unsupported"), 0), by.get((f"r{i}", "vision_unsupported"), 0)) for i in range(50)}
    assert gate.expand("r3").count() == 600


@pytest.mark.parametrize("size", [1, 3, 10_000])
def test_tool_calls_in_parts_of_any_size(spark, size):
    rows = [("a", i, [(i % 2, "" if i % 5 else f"n{i}", f"<{i}>"), (0, None, "x" if i % 3 else None)]) for i in (7, 2, 9, 0, 4, 11, 5)]
    chunks = spark.createDataFrame(rows, "request_id string, seq bigint, tool_calls array<struct<index:int,name:string,arguments:string>>")
    found = {r["index"]: (r["name"], r["arguments"]) for r in tools.merge_tool_calls(chunks, size=size).collect()}
    expected = {0: ["", ""], 1: ["", ""]}
    for _, _, calls in sorted(rows, key=lambda r: r[1]):
        for index, name, text in calls:
            expected[index] = [name or expected[index][0], expected[index][1] + (text or "")]
    assert found == {k: tuple(v) for k, v in expected.items()}


def test_settled_tables_can_be_removed(spark):
    import os

    from tidegauge.functions.sizing import session_folder, settle

    path = session_folder(spark).removeprefix("file:")
    assert settle(spark.range(3)).count() == 3 and os.listdir(path)
