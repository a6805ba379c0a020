from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    from tidegauge.functions.sizing import remove_settled

    remove_settled(session)
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


CHUNK = (
    "request_id string, seq bigint, arrival_s double, content string, finish_reason string, "
    "usage struct<prompt_tokens:bigint,completion_tokens:bigint,cached_tokens:bigint,reasoning_tokens:bigint>, "
    "tool_calls array<struct<index:int,name:string,arguments:string>>, done boolean, parse_ok boolean, status_code int, error_kind string"
)


@pytest.fixture(scope="session")
def make_chunks(spark):
    """Chunks from `{request: [(arrival, content, usage or None)...]}` plus a final row per request."""

    def build(requests, finals=None):
        rows = []
        for request, chunks in requests.items():
            for seq, (arrival, content, usage) in enumerate(chunks):
                rows.append((request, seq, arrival, content, None, usage, None, None, None, None, None))
        for request, (arrival, done, parse_ok, status, error) in (finals or {}).items():
            rows.append((request, 10**9, arrival, None, None, None, None, done, parse_ok, status, error))
        return spark.createDataFrame(rows, CHUNK)

    return build


RECORD = (
    "run_id string, model string, mode string, level_or_rate double, phase string, request_id string, prompt_id string, "
    "category string, t_start double, ttft double, tt2t double, e2e double, tpot double, normalized_latency double, "
    "itl_summary struct<mean:double,p50:double,p95:double,p99:double,max:double>, itl_list array<double>, output_tokens bigint, "
    "prompt_tokens bigint, cached_tokens bigint, reasoning_tokens bigint, usage_incomplete boolean, isl_bucket string, osl_bucket string, "
    "cost_usd double, outcome string, cache_violation boolean, sim_score double, quality_score double, expected_output string"
)
DEFAULTS = dict(
    run_id="r", model="acme/m", mode="closed", level_or_rate=1.0, phase="steady", request_id="x", prompt_id="p", category="coding",
    t_start=0.0, ttft=0.1, tt2t=0.02, e2e=0.24, tpot=0.02, normalized_latency=0.03, itl_summary=None, itl_list=None, output_tokens=8,
    prompt_tokens=10, cached_tokens=0, reasoning_tokens=0, usage_incomplete=False, isl_bucket="short", osl_bucket="short", cost_usd=None,
    outcome="success", cache_violation=False, sim_score=None, quality_score=None, expected_output="text",
)


@pytest.fixture(scope="session")
def make_records(spark):
    def build(*rows):
        names = [part.split()[0] for part in RECORD.replace("struct<mean:double,p50:double,p95:double,p99:double,max:double>", "s").split(", ")]
        data = []
        for number, row in enumerate(rows):
            full = {**DEFAULTS, "request_id": f"q{number}", **row}
            data.append(tuple(full[name] for name in names))
        return spark.createDataFrame(data, RECORD)

    return build
