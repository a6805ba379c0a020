from __future__ import annotations

import pytest

from tidegauge.functions.ends import stream_ends, until_end
from tidegauge.operators import records as rec
from tidegauge.operators import tools
from tidegauge.sources import readers

USAGE = (5, 9, None, None)
LATE = (50, 90, 7, 8)
CALL = [(0, "find", "{}")]
LATE_CALL = [(0, "other", "late")]
ROWS = [
    # request, seq, arrival, content, finish, usage, calls, done, parse_ok, status, error
    ("trailer", 1, 0.1, "h", None, None, CALL, None, True, None, None),
    ("trailer", 2, 0.2, "i", None, USAGE, None, None, True, None, None),
    ("trailer", 3, 0.3, None, None, None, None, True, True, None, None),
    ("trailer", 4, 0.4, "late", None, LATE, LATE_CALL, None, True, None, None),
    ("trailer", 5, 0.5, None, None, None, None, None, False, None, None),
    ("trailer", 6, 0.45, None, None, None, None, False, False, 200, None),
    ("plain", 1, 0.1, "a", None, None, None, None, True, None, None),
    ("plain", 2, 0.2, None, None, None, None, True, True, None, None),
    ("plain", 3, 0.25, None, None, None, None, None, None, 200, None),
    ("twice", 2, 0.2, None, None, None, None, True, True, None, None),
    ("twice", 1, 0.1, "x", None, None, None, None, True, None, None),
    ("twice", 3, 0.3, "y", None, None, None, None, True, None, None),
    ("twice", 4, 0.4, None, None, None, None, True, True, None, None),
    ("twice", 9, 0.35, None, None, None, None, None, None, 503, None),
    ("late text", 1, 0.1, None, None, None, None, True, True, None, None),
    ("late text", 2, 0.2, "t", None, None, None, None, True, 200, None),
    ("broken", 1, 0.1, "b", None, None, None, None, False, None, None),
    ("broken", 2, 0.2, None, None, None, None, True, True, 200, None),
    ("open", 1, 0.1, "o", None, None, None, None, True, 200, None),
]


@pytest.fixture(scope="module")
def chunks(spark):
    from tests.conftest import CHUNK

    return spark.createDataFrame(ROWS, CHUNK)


def test_only_requests_with_rows_behind_their_end_are_looked_at(chunks):
    assert {r["request_id"]: r["end"] for r in stream_ends(chunks).collect()} == {"trailer": 3, "twice": 2, "late text": 1}
    kept = until_end(chunks).groupBy("request_id").count().collect()
    assert {r["request_id"]: r["count"] for r in kept} == {"trailer": 4, "plain": 3, "twice": 3, "late text": 2, "broken": 2, "open": 1}
    assert until_end(chunks.drop("done")).count() == len(ROWS)
    quiet = chunks.filter("request_id = 'plain'")
    assert until_end(quiet).collect() == quiet.collect()


def test_facts_stop_at_the_end(chunks):
    facts = {r["request_id"]: r for r in rec.response_facts(chunks).collect()}
    row = facts["trailer"]
    assert (row["outcome"], row["ttft"], row["e2e"], row["prompt_tokens"], row["output_tokens"], row["cached_tokens"]) == ("success", 0.1, 0.45, 5, 9, 0)
    assert row["tt2t"] == pytest.approx(0.1) and row["itl_list"] == pytest.approx([0.1])
    assert (facts["plain"]["outcome"], facts["plain"]["output_tokens"]) == ("success", 1)
    assert (facts["twice"]["outcome"], facts["twice"]["status_code"], facts["twice"]["e2e"]) == ("connection_error", 503, 0.35)
    assert (facts["late text"]["outcome"], facts["late text"]["ttft"], facts["late text"]["output_tokens"]) == ("success", None, 0)
    assert facts["broken"]["outcome"] == facts["open"]["outcome"] == "malformed_stream"


def test_every_single_fact_stops_at_the_end(chunks):
    one = lambda frame, name: {r["request_id"]: r[name] for r in frame.collect()}
    assert one(rec.output_text(chunks), "output_text") == {"trailer": "hi", "plain": "a", "twice": "x", "broken": "b", "open": "o"}
    assert one(rec.first_token(chunks), "ttft")["late text"] is None
    assert one(rec.usage_fold(chunks), "output_tokens")["trailer"] == 9
    assert one(rec.classify_outcomes(chunks), "outcome")["trailer"] == "success"
    assert one(rec.itl_summary(chunks), "tt2t")["twice"] is None
    assert [(r["name"], r["arguments"]) for r in tools.merge_tool_calls(chunks).collect()] == [("find", "{}")]
    assert one(rec.chunk_order(chunks), "tokens") == {"trailer": 2, "plain": 1, "twice": 1, "broken": 1, "open": 1}


def test_lines_after_the_marker(spark):
    text = lambda t: 'data: {"choices": [{"delta": {"content": "%s"}}]}' % t
    lines = [("a", 1, 0.1, text("hi")), ("a", 2, 0.2, "data: [DONE]"), ("a", 3, 0.3, ": keep-alive"), ("a", 4, 0.4, "data: {broken"), ("a", 5, 0.5, text("late"))]
    found = readers.parse_stream_lines(spark.createDataFrame(lines, "request_id string, seq bigint, arrival_s double, line string"))
    assert [(r["seq"], r["content"], r["done"], r["parse_ok"]) for r in found.orderBy("seq").collect()] == [(1, "hi", False, True), (2, None, True, True)]


def test_parts_of_a_response_log_grow_with_its_rows(chunks, monkeypatch):
    """Gaps are dealt out by request in as many parts as rows ask for, and come out the same if a request is too large for that."""
    from tidegauge.functions import segments

    row = lambda r: (r["request_id"], r["since"], r["gap"], r["n"])
    monkeypatch.setattr(segments, "PART_ROWS", 2)
    assert segments.key_parts(chunks, ["request_id"]) == 10
    found = rec.inter_token_gaps(chunks)
    assert found.rdd.getNumPartitions() == 10
    assert rec.response_facts(chunks).rdd.getNumPartitions() == 10
    facts = sorted(map(str, rec.response_facts(chunks).collect()))
    assert segments.key_parts(chunks, ["request_id"], 3) is None
    monkeypatch.setattr(segments, "BLOCK_ROWS", 1)
    assert sorted(map(row, rec.inter_token_gaps(chunks).collect())) == sorted(map(row, found.collect()))
    assert sorted(map(str, rec.response_facts(chunks).collect())) == facts
