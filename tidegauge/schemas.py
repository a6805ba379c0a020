"""Explicit schemas of all tables. Nothing is ever inferred from data."""

from pyspark.sql import types as T

ITL_SUMMARY = "struct<mean:double,p50:double,p95:double,p99:double,max:double>"

REQUEST_RECORD_DDL = f"""
run_id string, model string, mode string, level_or_rate double, phase string, seed bigint,
request_id string, prompt_id string, category string, t_start double, ttft double, tt2t double,
e2e double, tpot double, normalized_latency double, itl_summary {ITL_SUMMARY},
itl_list array<double>, output_tokens bigint, prompt_tokens bigint, cached_tokens bigint,
reasoning_tokens bigint, usage_incomplete boolean, isl_bucket string, osl_bucket string,
cost_usd double, outcome string, status_code int, retry_count int, error string,
sim_score double, quality_score double, quality_pass boolean, judge_verdict string,
judge_reason string, eval_status string
"""

CHUNK_DDL = """
request_id string, seq bigint, arrival_s double, content string, finish_reason string,
usage struct<prompt_tokens:bigint,completion_tokens:bigint,cached_tokens:bigint,reasoning_tokens:bigint>,
tool_calls array<struct<index:int,name:string,arguments:string>>,
done boolean, parse_ok boolean, status_code int, error_kind string
"""

REQUEST_DDL = """
request_id string, run_id string, level_or_rate double, level_start double, t_start double,
prompt_id string, seed bigint
"""

EVAL_RESULT_DDL = """
request_id string, eval_status string, sim_score double, quality_score double,
quality_pass boolean, judge_verdict string, judge_reason string
"""

PROMPT_DDL = """
id string, library string, category string, isl_bucket string, expected_output string,
messages array<struct<role:string,content:string,parts:array<struct<type:string,text:string>>>>,
tools array<string>, tool_results map<string,string>
"""

TOOL_CALL_DDL = "run_id string, seq bigint, tool string, arguments string, result string"

# One row per panel; `position` orders them.
PANEL_DDL = "position int, title string, x string, `group` string, chart string, `values` array<struct<metric:string,agg:string>>"

SPAN_DDL = """
name string, trace_id string, span_id string, parent_span_id string, start_time bigint,
end_time bigint, status string, attributes map<string,string>
"""


def schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def request_record() -> T.StructType:
    return schema(REQUEST_RECORD_DDL)
