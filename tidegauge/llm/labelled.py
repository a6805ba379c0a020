"""Bounded, documented samples of rows that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null for a null id."""
    return F.crc32(doc_id.cast("string")) % parts


def sample_ids(ids: DataFrame, rows: int) -> DataFrame:
    """At most `rows` rows in the order of a hash of `doc_id`: the bound of what is fitted."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def with_texts(ids: DataFrame, docs: DataFrame, longest: int) -> DataFrame:
    """The sampled ids with their texts of at most `longest` bytes, one row per id.

    `ids` has a bound of its own, so it is broadcast and the texts are not shuffled.
    """
    texts = docs.select("doc_id", "text").filter(F.octet_length("text") <= longest)
    joined = texts.join(F.broadcast(ids), "doc_id")
    return joined.groupBy("doc_id").agg(
        F.min("text").alias("text"), *[F.max(name).alias(name) for name in ids.columns if name != "doc_id"]
    )
