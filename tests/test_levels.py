from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import levels as lv
from tidegauge.operators import load
from tidegauge.sources import dims


def runs_of(spark, slo="interactive", mode="closed", cap=2):
    return spark.createDataFrame(
        [("r", "m", mode, slo, 30, False, cap)],
        "run_id string, model_name string, mode string, slo_profile string, min_samples bigint, cache_busting boolean, max_outstanding bigint",
    )


def models_of(spark, price=1.0):
    return spark.createDataFrame([(0, "m", "acme/m", price, 2.0)], "position int, name string, model string, price_input double, price_output double")


def slo_of(spark):
    return dims.slo_profiles(spark.createDataFrame([], "name string, ttft_ms double, tpot_ms double, e2e_ms double"))


def levels_of(spark, *levels):
    return spark.createDataFrame([("r", float(x), None) for x in levels], "run_id string, level_or_rate double, max_outstanding_events bigint")


def test_goodput_golden(spark, make_records):
    rows = make_records({}, {"ttft": 0.6}, {"tpot": 0.08}, {"tpot": None, "phase": "warmup"})
    row = lv.goodput(rows, runs_of(spark), slo_of(spark)).first()
    assert row["goodput_count"] == 1
    assert row["goodput_attainment"] == pytest.approx(1 / 3)
    assert row["goodput_rps"] == pytest.approx(1 / 0.24)


def test_a_missing_latency_fails_its_bound_and_an_unknown_profile_bounds_nothing(spark, make_records):
    rows = make_records({"tpot": None}, {"ttft": None})
    assert lv.goodput(rows, runs_of(spark), slo_of(spark)).first()["goodput_count"] == 0
    assert lv.goodput(rows, runs_of(spark, "unheard-of"), slo_of(spark)).first()["goodput_count"] == 2


def test_the_limit_itself_passes(spark, make_records):
    rows = make_records({"ttft": 0.5, "tpot": 0.05, "e2e": 5.0})
    assert lv.goodput(rows, runs_of(spark), slo_of(spark)).first()["goodput_count"] == 1


@pytest.mark.parametrize("limited,total,flag", [(1, 100, False), (2, 100, True), (0, 10, False)])
def test_rate_limited_flag_is_strict(make_records, limited, total, flag):
    rows = make_records(*[{"outcome": "rate_limited"}] * limited, *[{}] * (total - limited))
    row = lv.reliability(rows).first()
    assert (row["rate_limited"], row["failed"], row["steady_samples"], row["rate_limited_flagged"]) == (limited, limited, total, flag)


def test_p999_needs_1000_samples_of_its_own_metric(make_records):
    rng = np.random.default_rng(0)
    values = rng.random(1000)
    rows = make_records(*[{"ttft": float(v), "tpot": float(v) if i else None} for i, v in enumerate(values)])
    found = {r["metric"]: r for r in lv.percentile_objects(rows).collect()}
    assert found["ttft"]["p999"] == pytest.approx(np.percentile(values, 99.9))
    assert found["ttft"]["p99"] <= found["ttft"]["p999"] <= found["ttft"]["max"]
    assert found["tpot"]["samples"] == 999 and found["tpot"]["p999"] is None
    assert found["ttft"]["std"] == pytest.approx(values.std())


def test_summary_of_empty_and_unconfigured_levels(spark, make_records):
    rows = make_records({"itl_list": [0.02, 0.04]}, {"level_or_rate": 9.0}, {"outcome": "timeout", "ttft": None, "output_tokens": 0})
    found = {r["level_or_rate"]: r for r in lv.level_summary(
        rows, levels_of(spark, 1, 2, 2), runs_of(spark), models_of(spark), slo_of(spark)).collect()}
    assert set(found) == {1.0, 2.0}
    empty, full = found[2.0], found[1.0]
    assert (empty["steady_samples"], empty["rps"], empty["ttft_p50"], empty["total_cost_usd"]) == (0, 0.0, None, 0.0)
    assert (full["steady_samples"], full["completed"], full["failed"], full["min_samples_met"]) == (2, 1, 1, False)
    assert full["itl_p50"] == pytest.approx(0.03)
    assert full["max_outstanding_events"] is None


def test_cost_golden(spark, make_records):
    rows = make_records(*[{"cost_usd": 26e-6}] * 5)
    levels = lv.level_summary(rows, levels_of(spark, 1), runs_of(spark), models_of(spark), slo_of(spark))
    row = levels.first()
    assert row["total_cost_usd"] == pytest.approx(130e-6) and row["cost_per_1k_requests"] == pytest.approx(0.026)
    assert lv.run_cost(levels).first()["cost_per_1k_requests"] == pytest.approx(0.026)
    unpriced = lv.level_summary(make_records({}), levels_of(spark, 1), runs_of(spark), models_of(spark, None), slo_of(spark))
    assert unpriced.first()["total_cost_usd"] is None


def test_throughput_and_window(make_records):
    rows = make_records({"t_start": 0.0, "e2e": 1.0, "output_tokens": 100}, {"t_start": 1.0, "e2e": 1.0, "output_tokens": 100})
    row = lv.throughput(rows).first()
    assert (row["steady_window_s"], row["rps"], row["system_tok_s"]) == (2.0, 1.0, 100.0)
    single = lv.throughput(make_records({"e2e": None})).first()
    assert (single["steady_window_s"], single["rps"]) == (0.0, 0.0)
    assert lv.throughput(make_records({})).first()["per_user_tok_s"] == pytest.approx(8 / 0.14)


def test_counters_have_two_scopes(make_records):
    rows = make_records({"usage_incomplete": True, "cache_violation": True}, {"usage_incomplete": True, "phase": "warmup", "cache_violation": True})
    row = lv.counters(rows).first()
    assert (row["usage_incomplete_count"], row["usage_incomplete_all_phases"]) == (1, 2)
    assert (row["cache_busting_violations"], row["cache_violations_all_phases"]) == (1, 2)


def test_in_flight_ends_before_starts(spark, make_records):
    rows = make_records({"t_start": 0.0, "e2e": 1.0}, {"t_start": 1.0, "e2e": 1.0}, {"t_start": 1.0, "e2e": 2.0})
    found = {r["t"]: r["in_flight"] for r in load.in_flight(rows, 0.75).collect()}
    assert found == {0.0: 1, 1.0: 2, 2.0: 1, 3.0: 0}
    peak = load.load_peaks(rows, runs_of(spark, cap=2), 0.75).first()
    assert (peak["peak"], peak["seconds_at_cap"]) == (2, 1.0)


def test_replayed_order(spark):
    rows = [("a", float(i), f"a{i}", p) for i, p in enumerate("xyz")] + [("b", float(i), f"b{i}", p) for i, p in enumerate("xyq")] + [
        ("c", float(i), f"c{i}", p) for i, p in enumerate("xy")]
    found = {r["run_id"]: r["common_prefix"] for r in load.replay_prefix(
        spark.createDataFrame(rows, "run_id string, t_start double, request_id string, prompt_id string"), "a", 1.0).collect()}
    assert found == {"b": 2, "c": 2}


def test_levels_that_follow_each_other_do_not_overlap(make_records):
    rows = make_records({"level_or_rate": 1.0, "t_start": 0.0, "e2e": 1.0}, {"level_or_rate": 2.0, "t_start": 1.0, "e2e": 1.0})
    assert load.level_overlap(rows).count() == 0
    rows = make_records({"level_or_rate": 1.0, "t_start": 0.0, "e2e": 2.0}, {"level_or_rate": 2.0, "t_start": 1.0, "e2e": 1.0})
    assert [r["level_or_rate"] for r in load.level_overlap(rows).collect()] == [2.0]


def test_gap_pool_weights_tokens(make_records):
    rows = make_records({"itl_list": [0.1, 0.3]}, {"itl_list": [0.0, 0.0, 0.0, 0.0, 0.0, 2.0]}, {"itl_list": None})
    row = lv.value_stats(lv.gap_pool(rows), lv.LEVEL).first()
    values = np.array([0.1, 0.3, 0, 0, 0, 0, 0, 2.0])
    assert row["samples"] == 8 and row["max"] == 2.0
    assert row["mean"] == pytest.approx(values.mean()) and row["std"] == pytest.approx(values.std())
    assert row["p90"] == pytest.approx(np.percentile(values, 90))


def test_priced_level_without_success_costs_nothing(make_records):
    rows = make_records({"outcome": "server_error", "cost_usd": 0.0}, {"level_or_rate": 2.0, "outcome": "server_error"})
    found = {r["level_or_rate"]: (r["total_cost_usd"], r["cost_per_1k_requests"]) for r in lv.level_cost(rows).collect()}
    assert found == {1.0: (0.0, 0.0), 2.0: (None, None)}


def test_slo_overrides(spark):
    configured = spark.createDataFrame([("relaxed", 1.0, None, None)], "name string, ttft_ms double, tpot_ms double, e2e_ms double")
    found = {r["name"]: tuple(r)[1:] for r in dims.slo_profiles(configured, {"interactive": {"ttft_ms": 300.0}}).collect()}
    assert found == {"relaxed": (1.0, None, None), "interactive": (300.0, 50.0, 5000.0)}
