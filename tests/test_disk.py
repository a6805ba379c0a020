"""What queries leave on disk: compressed lines, no shuffle files behind the records."""

from __future__ import annotations

import time
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidegauge.functions.sizing import CLEANUP, shuffles_removed
from tidegauge.plans import catalog
from tidegauge.plans.workbench import Workbench
from tidegauge.sources import readers, writers


def data_bytes(path):
    return sum(f.stat().st_size for f in Path(path).glob("part-*"))


def test_both_files_of_scan_by_suffix_take_little_disk(spark, make_records, tmp_path):
    outcomes = ("success", "timeout", "rate_limited")
    records = make_records(*[{"e2e": i / 257, "output_tokens": i % 90, "outcome": outcomes[i % 3]} for i in range(3000)])
    writers.write_run_raw(records, str(tmp_path / "plain"))
    bench = SimpleNamespace(spark=spark, records=records, folder=lambda name: str(tmp_path / name))
    found = {tuple(r) for r in catalog.scan_by_suffix(bench).collect()}
    tokens = {o: sum(i % 90 for i in range(3000) if i % 3 == k) for k, o in enumerate(outcomes)}
    assert found == {(kind, o, 1000, tokens[o]) for kind in ("parquet", "jsonl") for o in outcomes}
    assert data_bytes(tmp_path / "data.jsonl") < data_bytes(tmp_path / "plain") / 4


def test_compressed_lines_are_the_same_rows_in_bounded_files(spark, make_records, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "FILE_LINES", 50)
    records = make_records(*[{"e2e": i / 257, "error": "ü \" \n" if i % 2 else None} for i in range(240)]).coalesce(1)
    plain, packed = str(tmp_path / "plain.jsonl"), str(tmp_path / "packed.jsonl")
    writers.write_run_raw(records, plain)
    writers.write_run_raw(records, packed, compression="gzip")
    files = list(Path(packed).glob("part-*"))
    assert len(files) == 5 and all(f.name.endswith(".json.gz") for f in files)
    assert len(list(Path(plain).glob("part-*.json"))) == 1
    rows = [sorted(map(str, readers.read_by_suffix(spark, path).collect())) for path in (plain, packed)]
    assert len(rows[0]) == 240 and rows[0] == rows[1]
    assert sorted(r["value"] for r in spark.read.text(plain).collect()) == sorted(r["value"] for r in spark.read.text(packed).collect())


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def small_tables(spark, path):
    """Forty requests of up to three chunks each."""
    lines = [(o, o % 9, o % 4, n, 1.0 + n, 9.5, 0.0, 0.02, "AN"[o % 2], "O", "p") for o in range(40) for n in range(1, 2 + o % 3)]
    rows = {
        "lineitem": (lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                     "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_comment string"),
        "orders": ([(o, o % 7) for o in range(40)], "o_orderkey bigint, o_custkey bigint"),
        "region": ([(0, "AFRICA"), (1, "ASIA")], "r_regionkey int, r_name string"),
        "part": ([(p, f"name {p}", "Brand#1", p) for p in range(7)], "p_partkey bigint, p_name string, p_brand string, p_size int"),
    }
    for name, (data, ddl) in rows.items():
        table = spark.createDataFrame(data, ddl)
        table = table.withColumn("o_orderdate", F.lit("1996-01-02").cast("timestamp")) if name == "orders" else table
        table.write.parquet(f"{path}/{name}.parquet")


def test_records_leave_no_shuffle_files(spark, tmp_path):
    small_tables(spark, str(tmp_path))
    before = shuffle_files(spark)
    bench = Workbench(spark, str(tmp_path))
    records = bench.records
    # Removed by a message to each executor.
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left
    assert records.count() == 40 and bench.gaps.agg(F.sum("n")).first()[0] == 13 * 1 + 13 * 2


def test_the_session_keeps_its_own_setting(spark):
    assert spark.conf.get(CLEANUP, None) is None
    with pytest.raises(ValueError), shuffles_removed(spark):
        assert spark.conf.get(CLEANUP) == "true"
        raise ValueError
    assert spark.conf.get(CLEANUP, None) is None
    spark.conf.set(CLEANUP, "false")
    with shuffles_removed(spark):
        assert spark.conf.get(CLEANUP) == "true"
    assert spark.conf.get(CLEANUP) == "false"
    spark.conf.unset(CLEANUP)
