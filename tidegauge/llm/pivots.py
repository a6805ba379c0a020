"""Exact top-k by inner product with a pivot table (operator 12).

Components become integers, floor(scale * x), and scores are integer inner products. For vectors
q and v, 2 q.v = |q|^2 + |v|^2 - |q - v|^2, and for every pivot p the distance |q - v| is at least
| |q - p| - |v - p| |. The table of distances to all pivots is computed once and stored; the
greatest of these lower bounds gives each candidate the least upper bound of its score.

Candidates lie in blocks of bounded size by their nearest pivot. A query first gets a floor: its
k-th best score among a few rows. It visits only blocks whose range of pivot distances allows
the floor. There, candidates are evaluated in the order of their bounds until the next bound is
below the k-th best score so far; what a block found is merged per query. Stopping is exact: a
bound equal to the k-th score is still evaluated, and rounding is on the safe side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.sizing import settle

K = 10
SCALE = 1024.0
PIVOTS = 32
# Rows that pivots and floors are taken from, in the order of a hash; fewer where vectors are long.
SAMPLE_ROWS = 2_048
SAMPLE_BYTES = 16 << 20
# Bytes of vectors of one block, and queries that meet it at a time.
BLOCK_BYTES = 8 << 20
QUERIES = 2_048
_TILE = 32
_FIRST = 256
# Scores stay within a long, with a bit to spare.
_LONGEST = float(2**62)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(-1, width)


def _whole(column: pa.Array | pa.ChunkedArray, width: int, scale: float) -> np.ndarray:
    """Integer components, as doubles."""
    return np.floor(scale * _matrix(column, width).astype(np.float64))


def _squares(vectors: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", vectors, vectors)


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    # Differences, not the expanded square: equal vectors have distance 0.
    return np.stack([np.sqrt(_squares(vectors - pivot)) for pivot in pivots], axis=1)


def _products(vectors: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; doubles hold every partial sum where lengths allow it."""
    if exact:
        return (vectors @ query).astype(np.int64)
    return vectors.astype(np.int64) @ query.astype(np.int64)


def points(vectors: DataFrame, asks: Column, id: str, vector: str, scale: float) -> tuple[DataFrame, int]:
    """Settled rows that take part (`row`, `id`, `asks`, `v`) and their length.

    Null vectors and vectors with null or non-finite components take no part, nor do rows with a
    null id, which no result could name, vectors of another length than the most frequent one,
    and vectors so long (squared, after scaling) that scores don't fit into a long.
    """
    kind = vectors.schema[vector].dataType.simpleString()
    v = F.col(f"`{vector}`").cast(kind if kind in ("array<float>", "array<double>") else "array<double>")
    rows = vectors.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + F.pow(F.floor(F.lit(scale) * x.cast("double")).cast("double"), F.lit(2.0)))
    held = settle(rows.filter(F.col("id").isNotNull() & finite & (square < _LONGEST)).withColumn("row", F.monotonically_increasing_id()))
    lead = held.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = lead["n"] if lead else 0
    return held.filter(F.size("v") == width), width


def choose(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Up to `pivots` rows, each the farthest from those before it."""
    chosen, near = [0], _squares(sample - sample[0])
    while len(chosen) < pivots and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _squares(sample - sample[chosen[-1]]))
    return sample[chosen]


def pivot_table(rows: DataFrame, pivots: np.ndarray, width: int, scale: float) -> DataFrame:
    """`rows` with `d` (distances to all pivots), `home` (the nearest one) and `square`."""
    held = rows.sparkSession.sparkContext.broadcast(pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _whole(batch.column("v"), width, scale)
            d = _distances(vectors, held.value) if len(vectors) else np.zeros((0, len(held.value)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32)), pa.array(d.ravel().astype(np.float32)))
            made = [lists, pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(_squares(vectors))]
            yield pa.RecordBatch.from_arrays([batch.column(name) for name in ("row", "id", "asks", "v")] + made, names=["row", "id", "asks", "v", "d", "home", "square"])

    kind = rows.schema["v"].dataType.simpleString()
    return settle(rows.select("row", "id", "asks", "v").mapInArrow(measure, f"row bigint, id bigint, asks boolean, v {kind}, d array<float>, home int, square double"))


def _bound(lower: np.ndarray, reach: np.ndarray | float, squares: np.ndarray) -> np.ndarray:
    """Upper bound of scores from lower bounds of distances.

    Stored distances are single floats: each is off by less than 1.2e-7 of itself, and `reach`
    is at least the sum of the two compared.
    """
    safe = np.maximum(lower - 2.4e-7 * reach, 0)
    return (squares - safe * safe) / 2 * (1 + 1e-12) + 1


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the `k` largest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def eliminate(query: np.ndarray, order: np.ndarray, bound: np.ndarray, vectors: np.ndarray, ids: np.ndarray, floor: int, k: int, exact: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Best ids and scores of the candidates `order` (by falling bound), and how many were evaluated."""
    best, scores, least, at, step = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), floor, 0, _FIRST
    while at < len(order) and bound[order[at]] >= least:
        some = order[at : at + step]
        some = some[bound[some] >= least]
        found = _products(vectors[some], query, exact)
        good = found >= least
        best, scores = np.concatenate([best, ids[some][good]]), np.concatenate([scores, found[good]])
        kept = top(scores, best, k)
        best, scores = best[kept], scores[kept]
        if len(scores) == k:
            least = max(least, int(scores[-1]))
        at, step = at + step, step * 2
    return best, scores, at


def exact_top_k(
    vectors: DataFrame,
    asks: Column,
    k: int = K,
    id: str = "vec_id",
    vector: str = "embedding",
    scale: float = SCALE,
    pivots: int = PIVOTS,
    block_rows: int | None = None,
    queries: int = QUERIES,
) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score` of the `k` largest scores of each query row (`asks`).

    Candidates are all rows that take part (see `points`) but those of the query's own id; with
    fewer than `k`, all of them are returned. Ties go to the smaller id. Repeated rows are
    candidates each and queries each, so a repeated query id has its ranks repeated. Vectors
    without components have score 0. No rows, or no valid query: an empty result. Other columns
    of `vectors` play no part.
    """
    spark = vectors.sparkSession
    rows, width = points(vectors, asks, id, vector, scale)
    if rows.filter("asks").isEmpty():
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("bigint").alias("score")).filter("false")
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(width, 1))))
    sample = rows.select("id", "row", "v").orderBy(F.xxhash64("row"), "row").limit(most).toArrow()
    base = _whole(sample["v"], width, scale) if width else np.zeros((sample.num_rows, 0))
    chosen = choose(base, pivots)
    table = pivot_table(rows, chosen, width, scale) if width else None
    if table is None:  # nothing to compare: all scores are 0
        chosen = np.zeros((1, 0))
        table = settle(rows.withColumns({"d": F.array(F.lit(0.0).cast("float")), "home": F.lit(0), "square": F.lit(0.0)}))

    # One row per pivot: its size and the ranges of its candidates' distances and lengths.
    ranges = [f(F.col("d")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(len(chosen))]
    homes = table.groupBy("home").agg(F.count("*").alias("n"), F.max("square").alias("square"), *ranges).orderBy("home").toPandas()
    size = block_rows or max(256, BLOCK_BYTES // (8 * width + 4 * len(chosen) + 64))
    parts = {int(home): -(-int(n) // size) for home, n in zip(homes["home"], homes["n"])}
    low = homes[[f"low{i}" for i in range(len(chosen))]].to_numpy(dtype=np.float64)
    high = homes[[f"high{i}" for i in range(len(chosen))]].to_numpy(dtype=np.float64)
    asked = table.filter("asks").count()
    turns = -(-asked // queries)
    longest = float(homes["square"].max())
    exact = longest < 2**53
    model = spark.sparkContext.broadcast((np.asarray(sample["id"]), base, homes["home"].to_numpy(), low, high, homes["square"].to_numpy(dtype=np.float64)))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, base, home, low, high, squares = model.value
        for batch in batches:
            own, d = np.asarray(batch.column("id")), _matrix(batch.column("d"), low.shape[1]).astype(np.float64)
            whole = _whole(batch.column("v"), width, scale) if width else np.zeros((len(own), 0))
            floors, visited = [], []
            for i in range(len(own)):
                scores = _products(base[ids != own[i]], whole[i], exact)
                floor = int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else -(2**63)
                lower = np.maximum(np.maximum(low - d[i], d[i] - high), 0).max(axis=1)
                bound = _bound(lower, d[i].max() + high.max(), batch.column("square")[i].as_py() + squares)
                floors.append(floor)
                visited.append(home[bound >= floor].tolist())
            made = [pa.array(floors, type=pa.int64()), pa.array(visited, type=pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(name) for name in ("row", "id", "v", "d", "square")] + made, names=["row", "id", "v", "d", "square", "floor", "homes"])

    kind = table.schema["v"].dataType.simpleString()
    visits = table.filter("asks").select("row", "id", "v", "d", "square").mapInArrow(
        visit, f"row bigint, id bigint, v {kind}, d array<float>, square double, floor bigint, homes array<int>"
    )
    blocks = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])
    share = F.pmod(F.xxhash64("row"), F.lit(turns)).cast("int")
    met = visits.withColumn("turn", share).withColumn("home", F.explode("homes")).drop("homes")
    met = met.withColumn("part", F.explode(F.sequence(F.lit(0), blocks[F.col("home")] - 1)))
    placed = table.select("home", F.pmod(F.xxhash64("row"), blocks[F.col("home")]).cast("int").alias("part"), "id", "v", "d", "square")
    placed = placed.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))) if turns > 1 else F.lit(0))

    def search(asking: pa.Table, held: pa.Table) -> pa.Table:
        found = [[], [], [], []]
        if asking.num_rows and held.num_rows:
            ids = np.asarray(held["id"].combine_chunks())
            whole = _whole(held["v"], width, scale) if width else np.zeros((len(ids), 0))
            wanted = _whole(asking["v"], width, scale) if width else np.zeros((asking.num_rows, 0))
            count = len(chosen)
            d = np.ascontiguousarray(_matrix(held["d"], count).astype(np.float64).T)
            q = _matrix(asking["d"], count).astype(np.float64)
            squares, lengths = np.asarray(held["square"].combine_chunks()), np.asarray(asking["square"].combine_chunks())
            row, own, floor = (np.asarray(asking[name].combine_chunks()) for name in ("row", "id", "floor"))
            for start in range(0, len(row), _TILE):
                tile = slice(start, start + _TILE)
                lower, gap = np.zeros((len(row[tile]), len(ids))), np.empty((len(row[tile]), len(ids)))
                for i in range(count):
                    np.abs(np.subtract(q[tile, i][:, None], d[i][None, :], out=gap), out=gap)
                    np.maximum(lower, gap, out=lower)
                bounds = _bound(lower, q[tile].max() + d.max(), lengths[tile][:, None] + squares[None, :])
                for i, bound in enumerate(bounds, start):
                    some = np.flatnonzero((bound >= floor[i]) & (ids != own[i]))
                    order = some[np.argsort(-bound[some], kind="stable")]
                    best, scores, _ = eliminate(wanted[i], order, bound, whole, ids, int(floor[i]), k, exact)
                    for column, values in zip(found, (np.full(len(best), row[i]), np.full(len(best), own[i]), best, scores)):
                        column.append(values)
        made = [np.concatenate(column) if column else np.zeros(0, dtype=np.int64) for column in found]
        return pa.table(dict(zip(("row", "query_id", "vec_id", "score"), made)))

    keys = ("home", "part", "turn")
    answers = met.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInArrow(search, "row bigint, query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
