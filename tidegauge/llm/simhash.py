"""SimHash near-duplicates by anchor-point covering (operator 6).

A fingerprint has 64 bits. Two that differ in at most 3 bits differ in at most 1 bit in their
upper or in their lower 32 bits, so either half is searched with threshold 1, and a pair is
compared on all 64 bits.

In a half, 31 bits are covered by the Hamming code [31, 26]: its codewords are the anchors, and
its covering radius is 1 (every value is a codeword or 1 bit off one). A fingerprint's home is
the anchor within the covering radius. A partner's half is at most 1 bit away, so it lies within
2 = radius + threshold of that home: every fingerprint is replicated to all anchors within 2
bits (16 at most: its home, and if it is off the home, the 15 others that one more flip reaches;
a half that differs in its 32nd bit has the same home). Home rows meet replicas per anchor. No
link is lost, and there are 2^26 anchors per half, so few fingerprints share one by chance.

Equal fingerprints are one before any comparison, so copies make no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.sizing import settle
from tidegauge.llm.components import components

SHINGLE = 3
SEED = 42
DISTANCE = 3
RADIUS = 1
_CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of `text` (A-Z lowered); repeats count; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), _CHUNK):
        values = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])], dtype="<u8")
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """`doc_id` and `bits` (64 as a signed long) of every row; null and empty texts have 0."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            values = [fingerprint(b"" if not x.is_valid else x.as_buffer().to_pybytes(), shingle) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, dtype=np.uint64).view(np.int64))], names=["doc_id", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(compute, f"doc_id {kind}, bits bigint")


def _syndrome(half: np.ndarray) -> np.ndarray:
    """Of the low 31 bits: 0 for a codeword, else the (1-based) bit that is off."""
    out = np.zeros(half.shape, dtype=np.uint64)
    for bit in range(31):
        out ^= ((half >> np.uint64(bit)) & np.uint64(1)) * np.uint64(bit + 1)
    return out


def _home(half: np.ndarray) -> np.ndarray:
    """The codeword within the covering radius of each value; the 32nd bit is left out."""
    half = half & np.uint64(0x7FFFFFFF)
    off = _syndrome(half)
    return np.where(off > 0, half ^ (np.uint64(1) << (np.maximum(off, np.uint64(1)) - np.uint64(1))), half)


def anchors(distinct: DataFrame, bits: str = "bits") -> DataFrame:
    """Rows `anchor`, `home`, `bits`: one home per half, and the replicas within 2 bits.

    `anchor` holds the codeword and which half it is of. A home is one of its own replicas.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column(0)).view(np.uint64)
            for side in (0, 1):
                half = (values >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)
                home = _home(half)
                near = np.stack([home, *(_home(half ^ (np.uint64(1) << np.uint64(bit))) for bit in range(31))])
                near.sort(axis=0)
                fresh = np.ones(near.shape, dtype=bool)
                fresh[1:] = near[1:] != near[:-1]
                _, column = np.nonzero(fresh)
                codes = np.concatenate([home, near[fresh]]) | np.uint64(side << 32)
                owner = np.concatenate([values, values[column]])
                flag = np.arange(len(codes)) < len(values)
                yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(flag), pa.array(owner.view(np.int64))], names=["anchor", "home", "bits"])

    return distinct.select(bits).mapInArrow(place, "anchor bigint, home boolean, bits bigint")


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs `a < b` of different fingerprints at `distance` (3 at most) or fewer bits.

    Homes meet replicas by anchor in an equi-join, which Spark splits where one anchor is
    crowded; the distance is tested inside the join, so only links come out of it.
    """
    if distance > 3:
        raise ValueError("halves with threshold 1 cover distances up to 3")
    placed = settle(anchors(distinct))
    home = placed.filter("home").select("anchor", F.col("bits").alias("p"))
    near = placed.filter("not home").select("anchor", F.col("bits").alias("q"))
    close = (F.col("p") != F.col("q")) & (F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= distance)
    met = home.join(near, (home["anchor"] == near["anchor"]) & close)
    return met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """`doc_id`, `fingerprint` (16 hex digits), `component_id`, `links` of every row.

    `component_id` is the smallest `doc_id` that chains of links reach, the row's own included;
    `links` counts the other fingerprints linked to the row's. Repeated rows stay; a row with a
    null id takes part under its fingerprint and never names a component (a component of null
    ids only is null). An empty table gives an empty result.
    """
    marks = settle(fingerprints(docs, text))
    nodes = settle(marks.groupBy("bits").agg(F.min("doc_id").alias("first")))
    pairs = settle(links(nodes, distance))
    reach = components(pairs)
    named = nodes.join(reach, F.col("bits") == F.col("node"), "left").select(
        "bits", "first", F.coalesce("root", "bits").alias("root")
    )
    both = pairs.select(F.col("a").alias("bits")).unionAll(pairs.select(F.col("b").alias("bits")))
    degree = both.groupBy("bits").agg(F.count("*").alias("links"))
    lead = named.groupBy("root").agg(F.min("first").alias("component_id"))
    table = named.join(lead, "root").join(degree, "bits", "left").select(
        "bits", "component_id", F.coalesce("links", F.lit(0)).alias("links")
    )
    return marks.join(table, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id", "links"
    )
