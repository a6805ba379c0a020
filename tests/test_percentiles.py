from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.functions.percentiles import exact_quantiles, exact_stats, ordered_quantiles

PROBS = [0.0, 0.25, 0.5, 0.9, 0.99, 0.999, 1.0]


def groups():
    rng = np.random.default_rng(7)
    return {
        "lognormal": rng.lognormal(size=3001),
        "negative": -rng.lognormal(size=500),
        "mixed": rng.normal(size=999),
        "constant": np.full(50, 3.25),
        "zeros": np.concatenate([np.zeros(200), rng.random(3)]),
        "narrow": 0.1 + rng.random(2000) * 1e-7,
        "tiny": np.array([5e-324, 1e-300, 1e300]),
        "one": np.array([2.5]),
        "integers": rng.integers(0, 20, size=1000).astype(float),
    }


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(k, float(v)) for k, vs in groups().items() for v in vs] + [("lognormal", None), ("absent", None)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["k", "v"])).selectExpr("k", "case when isnan(v) then null else v end as v").cache()


def check(result, rel=1e-12):
    found = {r["k"]: r for r in result.collect()}
    assert set(found) == set(groups())
    for name, values in groups().items():
        assert found[name]["samples"] == len(values)
        np.testing.assert_allclose(found[name]["quantiles"], np.percentile(values, [p * 100 for p in PROBS]), rtol=rel, atol=1e-300)


def test_matches_numpy(frame):
    check(exact_quantiles(frame, ["k"], "v", PROBS))


def test_lazy_form_matches_numpy(frame):
    check(ordered_quantiles(frame, ["k"], "v", PROBS))


def test_full_cells_are_cut_finer_and_joined_by_shuffle(frame):
    check(exact_quantiles(frame, ["k"], "v", PROBS, task_values=5, broadcast_rows=0))


def test_weights(spark):
    rows = spark.createDataFrame([("a", 0.0, 90), ("a", 1.0, 1), ("a", 2.0, 1)], "k string, v double, n bigint")
    found = exact_stats(rows, ["k"], "v", [0.5, 0.99], weight="n").first()
    values = np.array([0.0] * 90 + [1.0, 2.0])
    np.testing.assert_allclose(found["quantiles"], np.percentile(values, [50, 99]))
    assert found["samples"] == 92
    assert found["mean"] == pytest.approx(values.mean())
    assert found["std"] == pytest.approx(values.std())


def test_statistics_match_numpy(frame):
    found = {r["k"]: r for r in exact_stats(frame, ["k"], "v", [0.5]).collect()}
    for name, values in groups().items():
        if name == "tiny":
            continue
        row = found[name]
        assert row["mean"] == pytest.approx(values.mean(), rel=1e-12)
        assert row["std"] == pytest.approx(values.std(), rel=1e-6, abs=1e-12)
        assert (row["min"], row["max"]) == (values.min(), values.max())


def test_a_hot_group_is_not_ordered_in_one_task(spark):
    """Two thirds of the rows in one group: the second pass touches only a small share of them."""
    rows = spark.range(60_000).selectExpr("case when id % 3 < 2 then 'hot' else cast(id % 100 as string) end as k", "(id * 7919 % 60000) / 60000.0D as v")
    found = {r["k"]: r["quantiles"][0] for r in exact_quantiles(rows, ["k"], "v", [0.99]).collect()}
    data = rows.toPandas()
    for name, part in data.groupby("k"):
        assert found[name] == pytest.approx(np.percentile(part.v, 99), rel=1e-12)


def test_weights_infinities_and_nan(spark):
    rows = [("w", 2.0, 3), ("w", 2.01, 2), ("w", -7.0, 4), ("w", 0.0, 1), ("i", 1.0, 1), ("i", float("inf"), 1), ("i", float("-inf"), 1)]
    rows += [("n", 10.0, 1), ("n", float("nan"), 1), ("n", 20.0, 1), ("n", 30.0, 1)]
    frame = spark.createDataFrame(rows, "k string, v double, n long")
    found = {r["k"]: r for r in exact_stats(frame, ["k"], "v", (0.0, 0.5, 1.0), weight="n").collect()}
    values = np.array([2.0] * 3 + [2.01] * 2 + [-7.0] * 4 + [0.0])
    assert found["w"]["mean"] == pytest.approx(values.mean()) and found["w"]["std"] == pytest.approx(values.std())
    assert found["w"]["quantiles"] == pytest.approx(np.percentile(values, [0, 50, 100]))
    assert found["i"]["quantiles"] == [float("-inf"), 1.0, float("inf")]
    assert all(np.isnan(q) for q in found["n"]["quantiles"]) and found["n"]["samples"] == 4


@pytest.mark.parametrize("rows", [10**6, 40])
def test_grouped_stats_at_every_size(spark, monkeypatch, rows):
    from tidegauge.functions import segments
    from tidegauge.functions.percentiles import grouped_stats

    monkeypatch.setattr(segments, "BLOCK_ROWS", rows)
    rng = np.random.default_rng(2)
    data = {f"k{i}": rng.random(n).round(2) * 10.0 ** rng.integers(-3, 6) for i, n in enumerate((1, 2, 7, 90, 900, 300))}
    data["k5"][0] = 1e12
    frame = spark.createDataFrame([(k, float(x), 1 + i % 3) for k, v in data.items() for i, x in enumerate(v)] + [("k0", None, 1)], "k string, v double, n bigint")
    found = {r["k"]: r for r in grouped_stats(frame, ["k"], "v", (0.0, 0.5, 0.99, 1.0), "n", {"rows": F.count("*")}).collect()}
    for key, values in data.items():
        whole = np.repeat(values, [1 + i % 3 for i in range(len(values))])
        row = found[key]
        assert row["samples"] == len(whole) and row["rows"] == len(values) and row["max"] == whole.max()
        assert row["mean"] == pytest.approx(whole.mean(), rel=1e-12)
        assert row["quantiles"] == pytest.approx(np.quantile(whole, (0, 0.5, 0.99, 1)).tolist(), rel=1e-12)
