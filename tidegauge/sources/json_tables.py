"""Tables from JSON files whose columns are their own: lines, arrays and whole documents.

Columns and their types come from the data: values are counted by path and kind, level by level,
so a name is only ever a key of the data and never part of a text that is parsed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import scalars

# Marks a bare not-a-number or infinity; no text of a log begins with it.
BARE = "\0"

_MAP, _ARRAY = "map<string,variant>", "array<variant>"
_WHOLE = ("BIGINT", "TINYINT", "SMALLINT", "INT")
_NUMBERS = (*_WHOLE, "DOUBLE", "FLOAT", "DECIMAL")


def _quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"([:\[,]\s*)(NaN|-?Infinity)(?=\s*[,}\]])", r'$1"\\u0000$2"')


def lenient_object(text: Column) -> Column:
    """Variant of a JSON object; bare NaN and Infinity values, which are no JSON, are kept as marked text."""
    return F.coalesce(scalars.json_object(text), scalars.json_object(_quoted(text)))


def _lenient(text: Column) -> Column:
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(_quoted(text)))


def _kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID or a number type; marked text is a DOUBLE."""
    name = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    bare = F.coalesce(F.try_variant_get(value, "$", "string").startswith(BARE), F.lit(False))
    return F.when((name == "STRING") & bare, "DOUBLE").otherwise(name)


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """One variant column `_object`, the objects of the JSON files at `path`; see `json_items`."""
    return json_items(spark, path).select("_object")


def json_items(spark: SparkSession, path: str) -> DataFrame:
    """`_object` and `_position`: the objects of the JSON files at `path`, and numbers that rise in a file.

    In a file of lines every line that is an object is a row, and other lines are left out. A file
    without such a line, or with lines that only open, close or continue something, may be one
    document: if it parses as a whole, an object is one row and an array has a row per object in it.
    Such a document is read in one piece; files of lines are read in splits.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_path"))
    text = F.trim(F.regexp_replace("value", r"\s+", " "))
    alone = text.rlike(r"^[\[\]{}],?$|^\[.*[^\]]$|[\[{,]$")
    parsed = lines.select("_path", lenient_object(F.col("value")).alias("_object"), alone.alias("_alone"), (text != "").alias("_filled"))
    facts = parsed.groupBy("_path").agg(
        F.count_if(F.col("_object").isNotNull()).alias("objects"), F.count_if(F.col("_alone") & F.col("_object").isNull()).alias("open"), F.count_if("_filled").alias("filled")
    )
    # Names of files that may be single documents; there is one value to read from each.
    maybe = [row["_path"] for row in facts.filter("filled > 0 and (objects = 0 or open > 0)").select("_path").collect()]
    rows = parsed.filter(F.col("_object").isNotNull()).select("_path", "_object").withColumn("_position", F.monotonically_increasing_id() + 1)
    if not maybe:
        return rows.select("_object", "_position")
    # A parser stops after the first value of a text, so a first line that is one itself must be the only one.
    body = F.regexp_replace("value", r"^\s+|\s+$", "")
    single = _lenient(F.regexp_extract(body, r"^[^\n]*", 0)).isNull() | ~body.contains("\n")
    files = spark.read.text(maybe, wholetext=True).select(single.alias("_single"), _lenient(body).alias("_value"), F.col("_metadata.file_path").alias("_path"))
    shape = F.regexp_extract(F.schema_of_variant("_value"), "^[A-Z]+", 0)
    documents = files.filter("_single").filter(shape.isin("OBJECT", "ARRAY"))
    elements = F.when(shape == "ARRAY", F.try_variant_get("_value", "$", _ARRAY)).otherwise(F.array("_value"))
    found = documents.select(F.posexplode(elements).alias("_at", "_object")).filter(F.schema_of_variant("_object").startswith("OBJECT"))
    found = found.select("_object", (F.col("_at") + 1).cast("long").alias("_position"))
    names = [row["_path"] for row in documents.select("_path").collect()]
    rest = rows.filter(~F.col("_path").isin(names)) if names else rows
    return rest.select("_object", "_position").unionAll(found)


@dataclass
class Tree:
    """Kinds of the values at a path, fields by name, and the elements of arrays."""

    kinds: set[str] = field(default_factory=set)
    fields: dict[str, Tree] = field(default_factory=dict)
    elements: Tree | None = None

    @property
    def type(self) -> str:
        kinds = self.kinds - {"VOID", ""}
        if kinds and kinds <= set(_WHOLE):
            return "bigint"
        if kinds and kinds <= set(_NUMBERS):
            return "double"
        for kind, name in (("OBJECT", "object"), ("ARRAY", "array"), ("BOOLEAN", "boolean")):
            if kinds == {kind}:
                return name
        return "string"


def tree_of(objects: DataFrame, column: str = "_object") -> Tree:
    """Paths and kinds of all values: one pass per level of nesting, combined before its shuffle.

    What reaches the driver is one row per path, which is what the columns are.
    """
    root = Tree({"OBJECT"})
    level = objects.select(F.array().cast("array<string>").alias("path"), F.col(column).alias("v"))
    while True:
        # Keys begin with a dot and elements have none, so no name is taken for an element.
        inner = level.select(
            "path",
            F.explode(
                F.coalesce(
                    F.map_entries(F.try_variant_get("v", "$", _MAP)),
                    F.transform(F.try_variant_get("v", "$", _ARRAY), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value"))),
                )
            ).alias("e"),
        ).select(F.array_append("path", F.coalesce(F.concat(F.lit("."), F.col("e.key")), F.lit("[]"))).alias("path"), F.col("e.value").alias("v"))
        found = inner.groupBy("path").agg(F.collect_set(_kind(F.col("v"))).alias("kinds")).collect()
        deeper = False
        for row in sorted(found, key=lambda row: row["path"]):
            node = root
            for step in row["path"]:
                if step == "[]":
                    node.elements = node.elements or Tree()
                    node = node.elements
                else:
                    node = node.fields.setdefault(step[1:], Tree())
            node.kinds |= set(row["kinds"])
            deeper = deeper or bool({"OBJECT", "ARRAY"} & node.kinds)
        if not deeper:
            return root
        level = inner.filter(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)"))


def value_of(value: Column, tree: Tree) -> Column:
    """The typed column of a variant: numbers, text, truth values, structs and arrays of them."""
    kind = tree.type
    if kind == "object" and tree.fields:
        held = F.try_variant_get(value, "$", _MAP)
        parts = [value_of(F.get(F.array(F.element_at(held, F.lit(name))), F.lit(0)), child).alias(name) for name, child in sorted(tree.fields.items())]
        return F.when(held.isNotNull(), F.struct(*parts))
    if kind == "array" and tree.elements is not None:
        return F.transform(F.try_variant_get(value, "$", _ARRAY), lambda x: value_of(x, tree.elements))
    text = F.try_variant_get(value, "$", "string")
    if kind == "double":
        return F.coalesce(F.when(text.startswith(BARE), F.substring(text, 2, 9).cast("double")), F.try_variant_get(value, "$", "double"))
    if kind in ("bigint", "boolean"):
        return F.try_variant_get(value, "$", kind)
    # Values of several kinds are text; what is no text is its JSON.
    plain = F.schema_of_variant(value) == "STRING"
    bare = F.when(text.startswith(BARE), F.substring(text, 2, 9)).otherwise(text)
    return F.when(plain, bare).when(F.schema_of_variant(value) != "VOID", F.to_json(value))


def unique_names(names: list[str]) -> list[str]:
    """Column names that differ in more than their case: later ones get a number."""
    taken, out = set(), []
    for name in names:
        fresh, number = name, 0
        while fresh.lower() in taken:
            number += 1
            fresh = f"{name}_{number}"
        taken.add(fresh.lower())
        out.append(fresh)
    return out


def read_json_table(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of the JSON files at `path` with the columns they have; None if there is no object."""
    objects = json_objects(spark, path)
    tree = tree_of(objects)
    if not tree.fields:
        return None if objects.isEmpty() else objects.select()
    names = sorted(tree.fields)
    held = objects.select(F.try_variant_get("_object", "$", _MAP).alias("_fields"))
    return held.select(
        *[value_of(F.element_at("_fields", F.lit(name)), tree.fields[name]).alias(fresh) for name, fresh in zip(names, unique_names(names), strict=True)]
    )
