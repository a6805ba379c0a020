"""Log lines are parsed once, and every line that is an object is a row."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge import schemas
from tidegauge.functions import scalars
from tidegauge.sources import readers

SCHEMA = "request_id string, e2e double, output_tokens bigint"


def test_lines_are_parsed_once(spark):
    lines = spark.createDataFrame([('{"request_id": "a", "e2e": 1.5}',)], "value string")
    plan = readers.parse_lines(lines, schemas.schema(SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    # Once as it is and, where that is no object, once with its bare numbers quoted.
    assert plan.count("parseJson(") == 2


def test_objects_are_told_by_their_text(spark):
    kept = ['{"request_id": "a", "e2e": 1}', ' \t{"request_id": "b", "e2e": NaN, "output_tokens": 2.5}', "{}", '{"request_id": 7, "e2e": "1.5"}']
    lost = ["", " ", "[1, 2]", '[{"request_id": "c"}]', '"{"', "null", "3", '{"request_id": ', '{"e2e": 1, "e2e": 2}', None]
    lines = spark.createDataFrame([(v, i) for i, v in enumerate(kept + lost)], "value string, line int")
    rows = readers.parse_lines(lines, schemas.schema(SCHEMA)).orderBy("line").collect()
    assert [tuple(r) for r in rows if r["line"] != 1] == [(0, "a", 1.0, None), (2, None, None, None), (3, "7", None, None)]
    bare = next(r for r in rows if r["line"] == 1)
    assert (bare["request_id"], bare["output_tokens"]) == ("b", 2) and bare["e2e"] != bare["e2e"]
    # The same lines by the kind that their value has.
    value = F.try_parse_json("value")
    kind = F.when(F.schema_of_variant(value).startswith("OBJECT"), F.to_json(value))
    assert lines.where(~F.to_json(scalars.json_object(F.col("value"))).eqNullSafe(kind)).count() == 0
