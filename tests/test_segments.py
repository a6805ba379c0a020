from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegauge.functions.segments import consecutive_gaps, counted, find_edges, gap_moments, in_blocks, positions, running_total, time_block, value_block


def brute_gaps(values):
    ordered = np.sort(values)
    return sorted(np.diff(ordered).round(9))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.sampled_from("abc"), st.lists(st.integers(0, 60), min_size=1, max_size=40), min_size=1))
def test_gaps_equal_lag_over_the_whole_key(spark, data):
    rows = [(k, v / 4.0) for k, vs in data.items() for v in vs]
    frame = spark.createDataFrame(rows, "k string, v double")
    found = consecutive_gaps(frame, ["k"], "v", 2.0).toPandas()
    for key, values in data.items():
        part = found[found.k == key]
        gaps = sorted(np.repeat(part.gap.to_numpy(), part.n.to_numpy()).round(9))
        assert gaps == brute_gaps(np.array(values) / 4.0)


def test_positions_number_every_row_once(spark):
    frame = spark.range(500).selectExpr("id", "case when id % 3 = 0 then 'x' else 'y' end as k", "cast(id * 37 % 101 as double) as v")
    found = positions(frame, ["k"], ["v", "id"], time_block("v", 7.0)).toPandas().sort_values(["k", "v", "id"])
    for _, part in found.groupby("k"):
        assert part.position.tolist() == list(range(1, len(part) + 1))


def test_running_total_and_next(spark):
    rng = np.random.default_rng(3)
    data = pd.DataFrame({"k": rng.choice(["a", "b"], 300), "v": np.arange(300) / 3.0, "d": rng.integers(-3, 4, 300)})
    frame = spark.createDataFrame(data).withColumn("_block", time_block("v", 5.0))
    found = running_total(frame, ["k"], ["v"], "d", with_next=True).toPandas().sort_values(["k", "v"])
    for key, part in found.groupby("k"):
        expected = data[data.k == key].sort_values("v")
        assert part._upto.tolist() == expected.d.cumsum().tolist()
        assert part._next.tolist()[:-1] == expected.v.tolist()[1:]
        assert np.isnan(part._next.tolist()[-1])


def test_value_blocks_keep_the_order(spark):
    values = sorted([0.0, -0.0, 1e-300, -1e-300, 1e300, -1e300, 1.0, 1.0000001, -2.0, 3.5, 1e-9])
    frame = spark.createDataFrame([(v,) for v in values], "v double").withColumn("b", value_block(F.col("v")))
    blocks = [r["b"] for r in sorted(frame.collect(), key=lambda r: r["v"])]
    assert blocks == sorted(blocks)


def test_equal_values_are_counted_before_the_shuffle(spark):
    frame = spark.createDataFrame([("hot", 1.5)] * 100 + [("hot", 2.5)], "k string, v double")
    assert {(r["v"], r["_n"]) for r in counted(frame, ["k"], "v", time_block("v", 1.0)).collect()} == {(1.5, 100), (2.5, 1)}


def test_gap_moments(spark):
    values = [0.0] * 30 + [1.0, 2.0, 4.0]
    frame = spark.createDataFrame([(0.0, 30), (1.0, 1), (2.0, 1), (4.0, 1)], "g double, n bigint")
    mean, std = gap_moments(F.col("g"), F.col("n"))
    row = frame.agg(mean.alias("m"), std.alias("s")).first()
    assert row["m"] == pytest.approx(np.mean(values))
    assert row["s"] == pytest.approx(np.std(values))


def shapes():
    """Keys of awkward shapes: an outlier, a dense one beside a wide one, values within 1 %, one value, few rows."""
    rng = np.random.default_rng(5)
    return {
        "outlier": np.concatenate([rng.random(20_000), [1e12]]),
        "dense": rng.random(20_000) / 1e6,
        "wide": rng.random(2_000) * 1e15,
        "narrow": 1e9 * (1 + rng.random(20_000) / 1e5),
        "repeated": np.concatenate([np.full(9_000, 2.5), rng.random(1_000)]),
        "steps": rng.integers(0, 30, 20_000).astype(float),
        "odd": np.concatenate([rng.random(5_000), [np.inf, -np.inf, np.nan]]),
        "few": rng.random(400),
        None: rng.random(3_000),
    }


def test_blocks_follow_the_counts(spark):
    data = shapes()
    frame = spark.createDataFrame(pd.DataFrame({"k": np.repeat(np.array(list(data), dtype=object), [len(v) for v in data.values()]), "v": np.concatenate(list(data.values()))}), "k string, v double")
    rows = 1_000
    placed = find_edges(frame, ["k"], "v", rows=rows, cells=16).place(frame, "v").toPandas()
    for key, values in data.items():
        part = placed[placed.k.isna() if key is None else placed.k == key]
        assert len(part) == len(values)
        sizes = part.groupby("_block").size()
        single = max(np.unique(values, return_counts=True)[1])
        assert sizes.max() <= 2 * max(rows, single) + 3 and len(sizes) <= len(values) / rows + 2, key
        ordered = part.sort_values("v", na_position="last")
        assert ordered["_block"].is_monotonic_increasing
        if key == "few":
            assert len(sizes) == 1


def test_gaps_between_found_edges(spark, monkeypatch):
    from tidegauge.functions import segments

    monkeypatch.setattr(segments, "BLOCK_ROWS", 200)
    data = {k: v[:3_000] for k, v in shapes().items() if k in ("outlier", "narrow", "steps")}
    data["outlier"] = np.concatenate([data["outlier"], [1e12]])
    frame = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v], "k string, v double")
    assert in_blocks(frame, ["k"], "v").agg(F.max("_block")).first()[0] >= 10
    found = consecutive_gaps(frame, ["k"], "v").toPandas()
    for key, values in data.items():
        part = found[found.k == key]
        gaps = np.sort(np.repeat(part.gap.to_numpy(), part.n.to_numpy()))
        assert np.array_equal(gaps, np.sort(np.diff(np.sort(values))))
    numbers = positions(in_blocks(frame, ["k"], "v"), ["k"], ["v"], F.col("_block")).toPandas()
    for key, values in data.items():
        part = numbers[numbers.k == key].sort_values("position")
        assert part.position.tolist() == list(range(1, len(values) + 1)) and part.v.is_monotonic_increasing
