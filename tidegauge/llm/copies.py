"""Exact copies of whole texts, found before any finer comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """`doc_id`, `copied`, `later`: text hashes of its rows that another `doc_id` has too.

    One row per `doc_id` that has any; hashes are xxhash64 of the text, compared with a second
    hash and the length. `later` holds those that a smaller `doc_id` has. Groups of any size:
    their least and largest id come from a combined aggregation, and the join back has one row
    per text on that side.
    """
    marks = docs.filter(F.col("doc_id").isNotNull() & F.col(text).isNotNull()).select(
        "doc_id", F.xxhash64(text).alias("code"), F.hash(text).alias("second"), F.octet_length(text).alias("size")
    )
    keys = ["code", "second", "size"]
    groups = marks.groupBy(keys).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    found = marks.join(groups, keys)
    behind = F.when(F.col("doc_id") > F.col("first"), F.col("code"))
    return found.groupBy("doc_id").agg(F.collect_set("code").alias("copied"), F.collect_set(behind).alias("later"))


def holds(hashes: str, text: str = "text") -> Column:
    """Whether the text of a row is among `hashes`; false where there are none."""
    return F.coalesce(F.array_contains(hashes, F.xxhash64(text)), F.lit(False))
