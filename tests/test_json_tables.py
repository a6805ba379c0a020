from __future__ import annotations

import json
import math

from tidegauge.operators import adhoc
from tidegauge.sources import readers
from tidegauge.sources.json_tables import read_json_table


def table(spark, tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return read_json_table(spark, str(path))


def test_names_are_never_parsed(spark, tmp_path):
    rows = [{"AVOID": 1, "it's": "x", "q\"d'": 2, "a.b": True, "`tick`": 1.5, "VOID": None, "STRUCT<x>": "y"}, {"AVOID": 2}]
    found = table(spark, tmp_path, "names.jsonl", "\n".join(map(json.dumps, rows)))
    assert dict(found.dtypes) == {"AVOID": "bigint", "it's": "string", "q\"d'": "bigint", "a.b": "boolean", "`tick`": "double", "VOID": "string", "STRUCT<x>": "string"}
    assert sorted((r["AVOID"], r["it's"], r["q\"d'"], r["a.b"], r["`tick`"], r["STRUCT<x>"]) for r in found.collect()) == [
        (1, "x", 2, True, 1.5, "y"), (2, None, None, None, None, None)]
    (row,) = adhoc.query_file(spark, str(tmp_path / "names.jsonl"), "select sum(AVOID) as n, max(`it's`) as t from data").collect()
    assert (row["n"], row["t"]) == (3, "x")


def test_bare_numbers_and_broken_lines(spark, tmp_path):
    found = table(spark, tmp_path, "bare.jsonl", '{"v": NaN, "s": {"p": Infinity}}\n\nbroken {\n{"v": 2}\n{"v": -Infinity, "s": {"p": 1}}\n[1, 2]\n"text"\n')
    values = [(r["v"], r["s"] and r["s"]["p"]) for r in found.collect()]
    assert len(values) == 3 and sum(math.isnan(v) for v, _ in values) == 1
    assert (2.0, None) in values and (-math.inf, 1.0) in values


def test_nesting_and_mixed_kinds(spark, tmp_path):
    rows = [{"k": 1, "o": {"a": [{"x": 1}, {"y": [True]}], "b": 2}, "m": 5}, {"k": 2.5, "o": None, "m": {"z": 1}}, {"k": None, "m": "t"}]
    found = table(spark, tmp_path, "nested.jsonl", "\n".join(map(json.dumps, rows)))
    assert dict(found.dtypes) == {"k": "double", "m": "string", "o": "struct<a:array<struct<x:bigint,y:array<boolean>>>,b:bigint>"}
    by = {r["m"]: r for r in found.collect()}
    assert set(by) == {"5", '{"z":1}', "t"} and by['{"z":1}']["o"] is None
    assert [(e["x"], e["y"]) for e in by["5"]["o"]["a"]] == [(1, None), (None, [True])]


def test_documents_arrays_and_lines(spark, tmp_path):
    rows = [{"a": 1, "b": {"c": 2}}, {"a": 2}]
    for name, text in (("one.json", json.dumps(rows)), ("pretty.json", json.dumps(rows, indent=2)), ("loose.json", '[\n{"a": 1, "b": {"c": 2}},\n{"a": 2}\n]\n'), ("lines.json", "\n".join(map(json.dumps, rows)))):
        found = table(spark, tmp_path, name, text)
        assert sorted((r["a"], r["b"] and r["b"]["c"]) for r in found.collect()) == [(1, 2), (2, None)], name
    summary = {"levels": [{"level": 1, "ttft": {"p50": 0.5}}, {"level": 4, "ttft": None}], "requests": 3}
    (row,) = table(spark, tmp_path, "summary.json", json.dumps(summary, indent=2)).collect()
    assert row["requests"] == 3 and [(x["level"], x["ttft"] and x["ttft"]["p50"]) for x in row["levels"]] == [(1, 0.5), (4, None)]
    # A line that is an array, or a broken first line, makes no document of a file of lines.
    assert [r["a"] for r in table(spark, tmp_path, "mixed.jsonl", '[1]\n{"a": 1}\n').collect()] == [1]
    assert sorted(r["a"] for r in table(spark, tmp_path, "cut.jsonl", '{"run": \n{"a": 1}\n{"a": 2}\n').collect()) == [1, 2]
    # A folder may hold files of every kind.
    (tmp_path / "all").mkdir()
    for name in ("pretty.json", "lines.json", "summary.json"):
        (tmp_path / "all" / name).write_text((tmp_path / name).read_text())
    everything = read_json_table(spark, str(tmp_path / "all"))
    assert everything.count() == 5 and sorted(everything.columns) == ["a", "b", "levels", "requests"]


def test_names_that_differ_in_case_and_empty_files(spark, tmp_path):
    found = table(spark, tmp_path, "case.jsonl", '{"k": 1, "K": 2, "k_1": 3}\n')
    assert len({name.lower() for name in found.columns}) == 3 and sorted(found.collect()[0]) == [1, 2, 3]
    assert table(spark, tmp_path, "empty.jsonl", "") is None
    assert "request_id" in readers.read_own_columns(spark, str(tmp_path / "empty.jsonl")).columns
