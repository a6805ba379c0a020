"""Nearest neighbours by inner product over shifted space-filling curves (operator 1).

Every vector is projected by several random orthonormal bases of few dimensions. Each projection
is shifted by a random offset and ordered along a Hilbert curve, which keeps what is close in the
projection close in the order. Spark range-partitions and numbers each order. A query's
candidates are the vectors within `window` places of it on any curve; they are scored in double
precision on the original vectors, merged over the curves and ranked.

The window is fitted, not guessed: a bounded sample of queries is compared with all vectors, in
blocks, and the window is the least one that finds the `target` share of the sample's true
neighbours. On clustered vectors it is short; where no direction is better than another (random
vectors on a sphere) no order can bring neighbours together, and it grows to about a hundredth
of the table per curve.

Equal vectors are one point on the curves and carry their smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.sizing import settle

CURVES, DIMENSIONS, BITS = 32, 8, 7
TARGET = 0.95
# Bounds of what is fitted: vectors that scale the projections, and queries that set the window.
SCALE_ROWS, FIT_QUERIES = 4096, 64
# Neighbouring places of a curve that one task holds at a time.
BLOCK = 4096
_CHUNK = 64


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of integer cells (rows of `bits`-bit coordinates)."""
    axes = [column.copy() for column in cells.astype(np.uint64).T]
    one, zero = np.uint64(1), np.uint64(0)
    for bit in range(bits - 1, 0, -1):  # undo the rotations of each level, coarse to fine
        level = one << np.uint64(bit)
        below = level - one
        for axis in range(len(axes)):
            high = (axes[axis] & level) > 0
            swap = np.where(high, zero, (axes[0] ^ axes[axis]) & below)
            axes[0] = np.where(high, axes[0] ^ below, axes[0] ^ swap)
            if axis:
                axes[axis] = axes[axis] ^ swap
    for axis in range(1, len(axes)):  # Gray code
        axes[axis] = axes[axis] ^ axes[axis - 1]
    turn = np.zeros_like(axes[0])
    for bit in range(bits - 1, 0, -1):
        level = one << np.uint64(bit)
        turn = np.where((axes[-1] & level) > 0, turn ^ (level - one), turn)
    key = np.zeros_like(axes[0])
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << one) | (((axis ^ turn) >> np.uint64(bit)) & one)
    return key


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def points(vectors: DataFrame, asks: Column, k: int, id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame, int]:
    """Distinct vectors (`rep`, `ids`, `asks`, `v`), the queries (`query_id`, `rep`), the length.

    Null vectors, zero vectors and vectors with null or non-finite components take no part, nor
    do those of another length than the most frequent one, nor rows with a null id. A point
    keeps the `k + 1` smallest ids of its copies, all that any query can need of it.
    """
    rows = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), asks.alias("asks"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0)).distinct()
    lead = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = lead["n"] if lead else 0
    rows = rows.filter(F.size("v") == width)
    # Copies are thinned in 64 parts each before any of their ids come together.
    part = Window.partitionBy("v", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    few = rows.withColumn("n", F.row_number().over(part)).filter(F.col("n") <= k + 1)
    ids = few.groupBy("v").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"))
    asked = rows.groupBy("v").agg(F.max(F.coalesce("asks", F.lit(False))).alias("asks"))
    reps = settle(ids.join(asked, "v").select(F.col("ids")[0].alias("rep"), "ids", "asks", "v"))
    queries = rows.filter("asks").select(F.col("id").alias("query_id"), "v").join(reps.filter("asks").select("rep", "v"), "v")
    return reps, settle(queries.select("query_id", "rep").distinct()), width


def orders(reps: DataFrame, width: int, curves: int, dimensions: int, bits: int, seed: int) -> DataFrame:
    """`curve`, `place`, `rep`: every point's number along every curve."""
    dimensions = min(dimensions, width)
    bits = min(bits, 63 // dimensions)
    random = np.random.default_rng(seed)
    bases = np.stack([np.linalg.qr(random.standard_normal((width, dimensions)))[0] for _ in range(curves)])
    shifts = random.random((curves, dimensions))
    sample = reps.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(SCALE_ROWS).select("v").toPandas()
    held = np.stack(sample["v"].to_numpy())
    held = held / np.linalg.norm(held, axis=1, keepdims=True)
    middle = np.stack([(held @ base).mean(axis=0) for base in bases])
    spread = np.stack([(held @ base).std(axis=0) for base in bases]) + 1e-12
    model = reps.sparkSession.sparkContext.broadcast((bases, shifts, middle, spread))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases, shifts, middle, spread = model.value
        for batch in batches:
            vectors = _matrix(batch.column(1), width)
            vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
            for curve in range(curves):
                z = (vectors @ bases[curve] - middle[curve]) / spread[curve]
                cells = (1 / (1 + np.exp(-1.702 * z)) + shifts[curve]) / 2 * (1 << bits)
                keys = hilbert_keys(np.minimum(cells, (1 << bits) - 1).astype(np.uint64), bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), curve, dtype=np.int32)), pa.array(keys.astype(np.int64)), batch.column(0)], names=["curve", "key", "rep"]
                )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(curves, dtype=np.int64)
        for batch in batches:
            curve = np.asarray(batch.column(0))
            first = np.flatnonzero(np.diff(curve, prepend=-1))
            at = np.arange(len(curve)) - np.repeat(first, np.diff([*first, len(curve)])) + seen[curve]
            np.add.at(seen, curve, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(curve), part, dtype=np.int32)), pa.array(at), batch.column(2)], names=["curve", "part", "at", "rep"]
            )

    keyed = reps.select("rep", "v").mapInArrow(place, "curve int, key bigint, rep bigint")
    ranged = keyed.repartitionByRange("curve", "key", "rep").sortWithinPartitions("curve", "key", "rep")
    numbered = settle(ranged.mapInArrow(number, "curve int, part int, at bigint, rep bigint"))
    # One row per curve and range partition: as many as there are partitions, whatever the data.
    sizes = numbered.groupBy("curve", "part").agg((F.max("at") + 1).alias("n")).toPandas().sort_values(["curve", "part"])
    sizes["before"] = sizes.groupby("curve")["n"].cumsum() - sizes["n"]
    before = reps.sparkSession.createDataFrame(sizes[["curve", "part", "before"]], "curve int, part int, before bigint")
    return numbered.join(F.broadcast(before), ["curve", "part"]).select("curve", (F.col("before") + F.col("at")).alias("place"), "rep")


def _best(scores: np.ndarray, reps: np.ndarray, k: int) -> np.ndarray:
    """Columns of the `k` largest scores, ties to the smaller id; -inf never counts."""
    real = np.flatnonzero(scores > -np.inf)
    if len(real) > k:
        real = real[scores[real] >= np.partition(scores[real], len(real) - k)[len(real) - k]]
    return real[np.lexsort((reps[real], -scores[real]))[:k]]


def fitted_window(reps: DataFrame, placed: DataFrame, width: int, k: int, target: float) -> int:
    """The least window that finds `target` of the true neighbours of a bounded query sample."""
    asked = reps.filter("asks").select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(FIT_QUERIES).toPandas()
    if asked.empty:
        return 0
    model = reps.sparkSession.sparkContext.broadcast((asked["rep"].to_numpy(), np.stack(asked["v"].to_numpy())))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, vectors = model.value
        for batch in batches:
            ids = np.asarray(batch.column(0))
            scores = vectors @ _matrix(batch.column(1), width).T
            scores[own[:, None] == ids[None, :]] = -np.inf
            best = [_best(row, ids, k) for row in scores]
            made = [np.repeat(own, [len(x) for x in best]), np.concatenate([ids[x] for x in best]), np.concatenate([row[x] for row, x in zip(scores, best)])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["q", "rep", "score"])

    found = reps.select("rep", "v").mapInArrow(compare, "q bigint, rep bigint, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))
    pairs = found.withColumn("n", rank).filter(F.col("n") <= k).select("q", "rep").toPandas()
    if pairs.empty:
        return 0
    wanted = reps.sparkSession.createDataFrame(pd.DataFrame({"rep": np.unique(np.concatenate([pairs["q"], pairs["rep"]]))}), "rep bigint")
    at = placed.join(F.broadcast(wanted), "rep").toPandas().pivot(index="rep", columns="curve", values="place")
    distance = np.abs(at.loc[pairs["q"]].to_numpy() - at.loc[pairs["rep"]].to_numpy()).min(axis=1)
    return int(np.sort(distance)[min(len(distance) - 1, int(np.ceil(target * len(distance))) - 1)])


def candidates(reps: DataFrame, placed: DataFrame, width: int, k: int, window: int) -> DataFrame:
    """`q`, `rep`: the best `k + 1` points per query, curve and block within `window` places."""
    block = F.floor(F.col("place") / BLOCK)
    rows = placed.join(reps.select("rep", "v", "asks"), "rep")
    own = rows.select("curve", block.cast("bigint").alias("block"), F.lit(False).alias("query"), "place", "rep", "v")
    first = F.greatest(F.floor((F.col("place") - window) / BLOCK), F.lit(0)).cast("bigint")
    last = F.floor((F.col("place") + window) / BLOCK).cast("bigint")
    asked = rows.filter("asks").select("curve", F.explode(F.sequence(first, last)).alias("block"), F.lit(True).alias("query"), "place", "rep", "v")

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        place, ids = np.asarray(table["place"].combine_chunks()), np.asarray(table["rep"].combine_chunks())
        vectors = _matrix(table["v"].combine_chunks(), width)
        query = np.asarray(table["query"].combine_chunks().cast(pa.int8())).astype(bool)
        order = np.argsort(place, kind="stable")
        points, asking = order[~query[order]], order[query[order]]
        q, rep = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for start in range(0, len(asking), _CHUNK):
            some = asking[start : start + _CHUNK]
            low = np.searchsorted(place[points], place[some[0]] - window)
            high = np.searchsorted(place[points], place[some[-1]] + window, side="right")
            near = points[low:high]
            scores = vectors[some] @ vectors[near].T
            scores[np.abs(place[some][:, None] - place[near][None, :]) > window] = -np.inf
            for row, line in zip(some, scores):
                best = near[_best(line, ids[near], k + 1)]
                q.append(np.full(len(best), ids[row]))
                rep.append(ids[best])
        return pa.table({"q": np.concatenate(q), "rep": np.concatenate(rep)})

    return own.unionAll(asked).groupBy("curve", "block").applyInArrow(meet, "q bigint, rep bigint").distinct()


def nearest(
    vectors: DataFrame,
    asks: Column,
    k: int = 20,
    id: str = "vec_id",
    vector: str = "embedding",
    curves: int = CURVES,
    dimensions: int = DIMENSIONS,
    bits: int = BITS,
    target: float = TARGET,
    window: int | None = None,
    seed: int = 11,
) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score` of the `k` nearest found of each query (`asks`).

    `score` is the inner product of the original components in double precision; ranks go by
    it, ties to the smaller id, and a query's own id is no candidate. Which rows take no part is
    told at `points`; equal rows count once. Every other row is indexed and may be found; with
    fewer candidates than `k`, all of them are. No rows, no valid query: an empty result.
    """
    reps, queries, width = points(vectors, asks, k, id, vector)
    if not width or queries.isEmpty():
        return queries.selectExpr("query_id", "cast(1 as int) as rank", "rep as vec_id", "cast(0 as double) as score").filter("false")
    placed = settle(orders(reps, width, curves, dimensions, bits, seed))
    if window is None:
        # A table of few points is one window.
        window = max(fitted_window(reps, placed, width, k, target), 4 * k)
    found = candidates(reps, placed, width, k, window)
    paired = found.join(reps.select(F.col("rep").alias("q"), F.col("v").alias("u")), "q").join(reps.select("rep", "ids", "v"), "rep")
    score = F.aggregate(F.zip_with("u", "v", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    scored = paired.select("q", score.alias("score"), "ids")
    points_rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0]))
    best = scored.withColumn("n", points_rank).filter(F.col("n") <= k + 1)
    row_rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    listed = best.select("q", "score", F.explode("ids").alias("vec_id")).withColumn("n", row_rank).filter(F.col("n") <= k + 1)
    answers = queries.join(listed, queries["rep"] == listed["q"]).filter("query_id != vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
