from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import panels, quality
from tidegauge.operators.panels import Panel, PanelError, Value


def body(content):
    return json.dumps({"choices": [{"message": {"content": content}}]})


@pytest.mark.parametrize(
    "content,score",
    [
        ('{"score": 0.7}', 0.7), ('{"score": 1.5}', 1.0), ('{"score": -1}', 0.0), ('{"score": "x"}', 0.0), ('{"score": null}', 0.0),
        ('{"score": NaN}', 1.0), ('{"score": "0.25"}', 0.25), ('{"score": true}', 1.0), ('{"score": "true"}', 0.0), ("0.4", 0.4),
        ("nan", 1.0), ("1d", 0.0), ("", 0.0), ("[0.5]", 0.0), ('{"reason": "none"}', 0.0), ('{"score": Infinity}', 1.0), ('{"score": [1]}', 0.0),
    ],
)
def test_judge_scores(spark, content, score):
    frame = spark.createDataFrame([(body(content),)], "body string")
    row = frame.select(quality.judge_score(quality.reply_content(F.col("body"))).alias("s")).first()["s"]
    assert row["score"] == score


@pytest.mark.parametrize(
    "content,rubric,verdict",
    [
        ('{"verdict": "pass"}', "binary", "pass"), ('{"verdict": " PASS "}', "binary", "pass"), ('{"verdict": "correct"}', "binary", "pass"),
        ('{"verdict": "partial"}', "binary", "fail"), ('{"verdict": "partial"}', "three_level", "partial"), ('{"verdict": "7"}', "three_level", "incorrect"),
        ("yes", "binary", "pass"), ("correct", "three_level", "correct"), ('"pass"', "binary", "pass"), ("", "binary", "fail"), ("true", "binary", "pass"),
    ],
)
def test_judge_verdicts(spark, content, rubric, verdict):
    frame = spark.createDataFrame([("q", rubric, body(content))], "request_id string, rubric string, body string")
    row = quality.score_replies(frame).first()
    assert row["judge_verdict"] == verdict
    assert row["quality_score"] == {"pass": 1.0, "correct": 1.0, "partial": 0.5}.get(verdict, 0.0)


def test_reply_without_choices_is_empty(spark):
    frame = spark.createDataFrame([('{"choices": []}',), ("junk",), (body("hi"),)], "body string")
    assert [r[0] for r in frame.select(quality.reply_content(F.col("body"))).collect()] == ["", "", "hi"]


def test_backfill_and_coverage(spark, make_records):
    rows = make_records({}, {}, {}, {"expected_output": " "}, {"expected_output": None}, {"outcome": "timeout"})
    scores = spark.createDataFrame(
        [("q0", "judged", 0.5, 0.5, True, None, None), ("q1", "eval_skipped", None, None, None, None, None), ("q3", "judged", 0.9, 0.9, True, None, None)],
        "request_id string, eval_status string, sim_score double, quality_score double, quality_pass boolean, judge_verdict string, judge_reason string",
    )
    joined = quality.backfill(rows, scores)
    found = {r["request_id"]: (r["eval_status"], r["quality_score"]) for r in joined.collect()}
    assert found == {
        "q0": ("judged", 0.5), "q1": ("eval_skipped", None), "q2": ("eval_dropped", None), "q3": ("skipped_no_expected", None),
        "q4": ("skipped_no_expected", None), "q5": ("skipped_no_expected", None),
    }
    row = quality.coverage(joined).first()
    assert (row["judged"], row["total_eligible"], row["dropped"]) == (1, 3, 1)
    assert row["coverage"] == pytest.approx(1 / 3)


def test_embedding_threshold_is_inclusive(spark):
    rows = [(i, "expected", [1.0, 0.0]) for i in range(3)] + [(i, "actual", [c, (1 - c * c) ** 0.5]) for i, c in enumerate((0.5, 0.49, 0.51))]
    scored = quality.embed_score(quality.pair_cosine(spark.createDataFrame(rows, "pair_id bigint, side string, v array<double>")), 0.5)
    assert {r["pair_id"]: r["quality_pass"] for r in scored.collect()} == {0: True, 1: False, 2: True}


def test_model_hooks(spark):
    frame = spark.createDataFrame([("ab", "cd"), (None, "x")], "expected string, actual string")
    vectors = quality.embed_texts(frame, "actual", lambda: lambda texts: [[len(t), 1] for t in texts])
    assert sorted(r["embedding"] for r in vectors.collect()) == [[1.0, 1.0], [2.0, 1.0]]
    replies = quality.judge_texts(frame, lambda: lambda e, a: [f"{len(x)}{len(y)}" for x, y in zip(e, a)])
    assert sorted(r["body"] for r in replies.collect()) == ["01", "22"]


def points(frame):
    return {(r["series"], r["x"]): r["value"] for r in frame.collect()}


def test_median_panel(make_records):
    rows = make_records({"ttft": 1.0}, {"ttft": 3.0}, {"ttft": 2.0, "level_or_rate": 2.0}, {"ttft": 9.0, "phase": "warmup"}, {"ttft": 9.0, "outcome": "timeout"})
    result = panels.compute_panel(rows, Panel("t", "level_or_rate", (Value("ttft"),)))
    assert points(result) == {("ttft p50 (ms)", "1.0"): 2000.0, ("ttft p50 (ms)", "2.0"): 2000.0}
    assert {r["chart"] for r in result.collect()} == {"line"}


def test_bucket_order_and_dense_grid(make_records):
    rows = make_records(
        {"isl_bucket": "long", "category": "a"}, {"isl_bucket": "short", "category": "b"}, {"isl_bucket": "medium", "category": None},
        {"isl_bucket": None, "category": "c"},
    )
    result = panels.compute_panel(rows, Panel("t", "isl_bucket", (Value("e2e", "count"), Value("e2e", "max")), group="category"))
    found = points(result)
    assert len(found) == 3 * 3 * 2
    assert found[("e2e count (ms) [a]", "long")] == 1.0 and found[("e2e count (ms) [a]", "medium")] == 0.0
    assert found[("e2e max (ms) [c]", "short")] is None
    order = {r["x"]: r["x_position"] for r in result.collect()}
    assert order == {"short": 1, "medium": 2, "long": 3}
    assert {r["chart"] for r in result.collect()} == {"bar"}


def test_rates_and_quality(make_records):
    rows = make_records({"t_start": 0.0, "e2e": 1.0, "output_tokens": 100, "quality_score": 1.0}, {"t_start": 1.0, "e2e": 1.0, "output_tokens": 100, "quality_score": 0.0})
    found = points(panels.compute_panel(rows, Panel("t", "level_or_rate", (Value("rps"), Value("system_tok_s"), Value("quality_score", "mean")))))
    assert found == {("rps (req/s)", "1.0"): 1.0, ("system_tok_s (tok/s)", "1.0"): 100.0, ("quality_score mean", "1.0"): 0.5}
    none = points(panels.compute_panel(make_records({"e2e": None}), Panel("t", "level_or_rate", (Value("rps"),))))
    assert none == {("rps (req/s)", "1.0"): None}


def test_panels_are_checked():
    for make in (
        lambda: Value("speed"), lambda: Value("ttft", "p42"), lambda: Panel("t", "color", (Value("ttft"),)), lambda: Panel("t", "model", ()),
        lambda: Panel("t", "model", (Value("ttft"),), group="nope"), lambda: Panel("t", "model", (Value("ttft"),), chart="pie"),
    ):
        with pytest.raises(PanelError):
            make()


@pytest.mark.parametrize("rows", [10**6, 20])
def test_long_axes_are_numbered_by_ranges(spark, monkeypatch, rows):
    from tidegauge.functions import segments
    from tidegauge.operators import panels

    monkeypatch.setattr(segments, "BLOCK_ROWS", rows)
    numbers, words = [str(x / 4) for x in range(-40, 60)], [f"prompt-{i}" for i in range(70)] + ["short", "long", "medium", "10"]
    data = [("a", x) for x in numbers] + [("b", x) for x in words] + [("c", "7"), ("d", "1e3"), ("d", "9")]
    frame = spark.createDataFrame(data, "run_id string, x string").repartition(5)
    found = {(r["run_id"], r["x"]): (r["x_position"], r["numeric"]) for r in panels.order_axis(frame).collect()}
    expected = {"a": sorted(numbers, key=float), "b": ["short", "medium", "long", *sorted(set(words) - {"short", "medium", "long"})], "c": ["7"], "d": ["9", "1e3"]}
    assert found == {(run, x): (place, run != "b") for run, marks in expected.items() for place, x in enumerate(marks, 1)}


def test_sparse_panels_hold_the_points_that_exist(make_records):
    rows = make_records({"level_or_rate": 4.0, "prompt_id": "p9"}, {"level_or_rate": 16.0, "prompt_id": "p10"}, {"level_or_rate": 4.0, "prompt_id": "p10"})
    panel = Panel("t", "level_or_rate", (Value("e2e", "count"),), group="prompt_id")
    found = panels_of(rows, panel, dense=False)
    assert found == {("4.0", "e2e count (ms) [p9]"): (1, 2, 1.0), ("4.0", "e2e count (ms) [p10]"): (1, 1, 1.0), ("16.0", "e2e count (ms) [p10]"): (2, 1, 1.0)}
    assert panels_of(rows, panel, dense=True) == found | {("16.0", "e2e count (ms) [p9]"): (2, 2, 0.0)}


def panels_of(rows, panel, dense):
    from tidegauge.operators import panels

    return {(r["x"], r["series"]): (r["x_position"], r["g_position"], r["value"]) for r in panels.compute_panel(rows, panel, dense=dense).collect()}


def test_panels_from_a_file(spark, tmp_path):
    from tidegauge.sources import readers

    starter = [{"title": p.title, "x": p.x, "group": p.group, "values": [{"metric": v.metric, "agg": v.agg} for v in p.values]} for p in panels.STARTER_PANELS]
    (tmp_path / "array.json").write_text(json.dumps(starter, indent=2))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, starter)))
    for name in ("array.json", "lines.json"):
        assert tuple(panels.panels_of(readers.read_panel_definitions(spark, str(tmp_path / name)))) == panels.STARTER_PANELS
    (tmp_path / "short.json").write_text('[{"x": "model", "values": [{"metric": "rps"}], "chart": "bar"}]')
    (one,) = panels.panels_of(readers.read_panel_definitions(spark, str(tmp_path / "short.json")))
    assert one == Panel("Panel 1", "model", (Value("rps", "p50"),), None, "bar")
    for text, reason in (('[{"x": "model", "values": [{"metric": "speed"}]}]', "unknown metric"), ('[{"x": "model"}]', "at least one value"), ("[]", "at least one panel"), ('[{"values": []}]', "no dimension")):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(PanelError, match=reason):
            panels.panels_of(readers.read_panel_definitions(spark, str(tmp_path / "bad.json")))
