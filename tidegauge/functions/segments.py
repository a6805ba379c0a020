"""Ordered computations over groups of any size.

A plain `Window.partitionBy(key)` sorts one whole key in one task. These helpers
cut each key into *blocks* (a monotone, coarse function of the ordering value), work
inside `(key, block)`, and carry only one row per block across block borders. Equal
ordering values are counted before any shuffle, so a key that holds a third of all
rows is spread like every other.

Where the blocks of a key begin is found by counting (`find_edges`): a key of few rows is one
block, a larger one gets edges of its own, whatever the shape of its values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidegauge.functions.sizing import broadcast_if_small, settle

# Rows of one key that one block should hold.
BLOCK_ROWS = 500_000

# Rows of one part when a table is dealt out by key, and crowds of keys that are counted before.
PART_ROWS = 150_000
CROWDS = 1 << 16

# Logarithmic value blocks per e-fold; a double then has at most about 91,000 blocks.
BLOCKS_PER_EFOLD = 64
INFINITE_BLOCK, NAN_BLOCK = 2**61, 2**62


def key_parts(df: DataFrame, keys: Sequence[str], rows: int | None = None) -> int | None:
    """How many parts hold `df` dealt out by `keys`; none if a key may have more than `rows` rows.

    Rows are counted by crowd, a hash of the keys, of which there are no more however long the table
    is. No key has more rows than its crowd. The number of parts grows with the table, so what a
    task holds does not.
    """
    crowd = F.pmod(F.xxhash64(*keys), F.lit(CROWDS)).alias("_crowd")
    held = df.groupBy(crowd).agg(F.count(F.lit(1)).alias("_n"))
    total, most = held.agg(F.sum("_n"), F.max("_n")).first()
    return None if (most or 0) > (rows or BLOCK_ROWS) else max(1, -(-(total or 0) // PART_ROWS))


def deal(df: DataFrame, keys: Sequence[str], parts: int | None) -> DataFrame:
    """`df` dealt out by `keys` in `parts` parts (of `key_parts`), or as it is without them."""
    return df.repartition(parts, *keys) if parts else df


def time_block(value: str, width: float) -> Column:
    """Block of `width` seconds that `value` falls in."""
    return F.floor(F.col(value) / F.lit(width)).cast("long")


# Pieces that a range of one key is cut into by one counting pass.
CELLS = 1024


@dataclass(frozen=True)
class Edges:
    """Lower bounds of the blocks of the keys that have more than one: `(keys, _edges)`, sorted."""

    keys: tuple[str, ...]
    table: DataFrame | None

    def place(self, df: DataFrame, value: str) -> DataFrame:
        """Add `_block`: how many edges of its key lie at or below `value`; 0 for keys without any."""
        if self.table is None:
            return df.withColumn("_block", F.lit(0).cast("long"))
        names = [f"_key{i}" for i in range(len(self.keys))]
        edges = broadcast_if_small(self.table.toDF(*names, "_edges"))
        same = F.lit(True)
        for key, name in zip(self.keys, names, strict=True):
            same = same & F.col(key).eqNullSafe(F.col(name))
        # Bisection of the sorted edges.
        at = F.expr(
            f"aggregate(sequence(0, cast(ceil(log2(size(_edges) + 1)) as int)), named_struct('low', 0, 'high', size(_edges)), "
            f"(s, x) -> if(s.low >= s.high, s, if(_edges[(s.low + s.high) div 2] <= cast(`{value}` as double), "
            "named_struct('low', cast((s.low + s.high) div 2 + 1 as int), 'high', s.high), "
            "named_struct('low', s.low, 'high', cast((s.low + s.high) div 2 as int)))), s -> cast(s.low as bigint))"
        )
        return df.join(edges, same, "left").withColumn("_block", F.coalesce(F.when(F.col("_edges").isNotNull(), at), F.lit(0).cast("long"))).drop(*names, "_edges")


def find_edges(df: DataFrame, keys: Sequence[str], value: str, rows: int | None = None, cells: int = CELLS) -> Edges:
    """Edges that put at most about `rows` rows of a key into a block, at most twice as many.

    One combined pass counts the keys. Those with more rows than `rows` are counted in `cells`
    equal parts of their range; parts that are still too full are counted again in as many parts
    of what they really span, until each holds few rows or one value. Neighbouring parts then make
    up the blocks, so a key of n rows has no more than n / rows + 1 of them. Infinite values and
    not-a-number fall in the outer blocks. `df` is read once more per round, and only if some key is
    too large, so it should be settled or cheap.
    """
    rows = rows or BLOCK_ROWS
    number = F.col(value).cast("double")
    finite = ~F.isnan(number) & (F.abs(number) < float("inf"))
    span = [F.count(number).alias("_n"), F.min(F.when(finite, number)).alias("_from"), F.max(F.when(finite, number)).alias("_to")]
    large = settle(df.groupBy(*keys).agg(*span).filter(f"_n > {rows} and _from < _to"))
    if large.isEmpty():
        return Edges(tuple(keys), None)
    data = df.filter(finite).select(*keys, number.alias("_v"))
    group, open_, leaves = list(keys), large.drop("_n"), None
    while True:
        sides = open_.toDF(*[f"_side{i}" for i in range(len(group))], "_from", "_to")
        same = F.lit(True)
        for i, key in enumerate(group):
            same = same & F.col(key).eqNullSafe(F.col(f"_side{i}"))
        # One row per range that is too full: as many as blocks, at most.
        data = data.join(broadcast_if_small(sides), same).drop(*[f"_side{i}" for i in range(len(group))])
        cell = f"_cell{len(group) - len(keys)}"
        part = F.floor((F.col("_v") / 2 - F.col("_from") / 2) / (F.col("_to") / 2 - F.col("_from") / 2) * cells)
        data = data.withColumn(cell, F.least(part, F.lit(cells - 1)).cast("int")).drop("_from", "_to")
        group = [*group, cell]
        counts = settle(data.groupBy(*group).agg(F.count("*").alias("_n"), F.min("_v").alias("_from"), F.max("_v").alias("_to")))
        full = F.expr(f"_n > {rows} and _from < _to")
        done = counts.filter(~full).select(*keys, "_n", "_from")
        leaves = done if leaves is None else leaves.unionAll(done)
        open_ = counts.filter(full).drop("_n")
        if open_.isEmpty():
            break
    # As many rows as parts: some thousands for each large key.
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_from").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    placed = leaves.withColumn("_block", F.floor(before / rows))
    first = placed.filter("_block > 0").groupBy(*keys, "_block").agg(F.min("_from").alias("_from"))
    return Edges(tuple(keys), settle(first.groupBy(*keys).agg(F.sort_array(F.collect_list("_from")).alias("_edges"))))


def value_block(value: Column, per_efold: int = BLOCKS_PER_EFOLD) -> Column:
    """Order-preserving block of any double: logarithmic, signed, zero in the middle.

    The infinities and not-a-number have blocks of their own; not-a-number comes last.
    """
    # ln() of a double lies within +-745, so the shift keeps positive blocks above zero.
    size = F.floor(F.ln(F.abs(value)) * per_efold) + 1000 * per_efold
    infinite = F.abs(value) == float("inf")
    sign = F.when(value > 0, 1).otherwise(-1)
    return (
        F.when(F.isnan(value), F.lit(NAN_BLOCK))
        .when(infinite, sign * F.lit(INFINITE_BLOCK))
        .when(value > 0, size)
        .when(value < 0, -size)
        .otherwise(F.lit(0))
        .cast("long")
    )


def counted(df: DataFrame, keys: Sequence[str], order: str, block: Column, weight: str | None = None) -> DataFrame:
    """One row per distinct `(keys, order)` with its block `_block` and count `_n`.

    The block is a function of the ordering value, so grouping by both is grouping by
    the value; partial aggregation combines equal values before the shuffle.
    """
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    return (
        df.where(F.col(order).isNotNull())
        .groupBy(*keys, block.alias("_block"), F.col(order))
        .agg(amount.alias("_n"))
    )


def in_blocks(df: DataFrame, keys: Sequence[str], value: str, width: float | None = None) -> DataFrame:
    """`df` with `_block`: of `width`, or between edges that are found by counting."""
    if width:
        return df.withColumn("_block", time_block(value, width))
    return find_edges(df, keys, value).place(df, value)


def consecutive_gaps(df: DataFrame, keys: Sequence[str], order: str, width: float | None = None, parts: int | None = None) -> DataFrame:
    """Gaps between consecutive `order` values of each key: `(keys, since, gap, n)`.

    `since` is the value the gap starts from; `n` equal gaps from one start are one
    row (repeated values give zero gaps). The multiset of gaps is exactly that of
    `order - lag(order)` over the whole key. Without a `width`, blocks follow the counts.
    With `parts` (of `key_parts`, for these rows or more) no key is large: the rows are dealt out
    by key once and each key is one block.
    """
    if parts and not width:
        values = counted(deal(df, keys, parts), keys, order, F.lit(0).cast("long"))
        return _local_gaps(values, keys, order, Window.partitionBy(*keys).orderBy(order))
    values = counted(in_blocks(df, keys, order, width), keys, order, F.col("_block"))
    local = _local_gaps(values, keys, order, Window.partitionBy(*keys, "_block").orderBy(order))
    edges = values.groupBy(*keys, "_block").agg(F.min(order).alias("_first"), F.max(order).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_block")
    borders = (
        edges.withColumn("since", F.lag("_last").over(across))
        .where(F.col("since").isNotNull())
        .select(*keys, "since", (F.col("_first") - F.col("since")).alias("gap"), F.lit(1).cast("long").alias("n"))
    )
    return local.unionByName(borders)


def _local_gaps(values: DataFrame, keys: Sequence[str], order: str, inside: WindowSpec) -> DataFrame:
    """Gaps between the counted values of each window, and between equal ones."""
    value = F.col(order)
    return values.withColumn("_prev", F.lag(order).over(inside)).select(
        *keys,
        F.inline(
            F.filter(
                F.array(
                    F.struct(value.alias("since"), F.lit(0.0).alias("gap"), (F.col("_n") - 1).alias("n")),
                    F.struct(
                        F.col("_prev").alias("since"),
                        (value - F.col("_prev")).alias("gap"),
                        F.when(F.col("_prev").isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("n"),
                    ),
                ),
                lambda item: item["n"] > 0,
            )
        ),
    )


def running_total(
    blocks: DataFrame, keys: Sequence[str], order: Sequence[str], amount: str, with_next: bool = False
) -> DataFrame:
    """Add `_upto` (running sum through this row) and `_total` (sum of the key).

    `blocks` carries `_block`; `order` orders rows inside a block. Per block only one row
    crosses to the other blocks of the key. `with_next` adds `_next`, the `order[0]` value
    of the following row of the key.
    """
    sums = blocks.groupBy(*keys, "_block").agg(F.sum(amount).alias("_sum"), F.min(order[0]).alias("_first"))
    across = Window.partitionBy(*keys).orderBy("_block")
    running = across.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sums.select(
        *keys,
        "_block",
        (F.sum("_sum").over(running) - F.col("_sum")).alias("_before"),
        F.sum("_sum").over(Window.partitionBy(*keys)).alias("_total"),
        F.lead("_first").over(across).alias("_next_first"),
    )
    ordered = Window.partitionBy(*keys, "_block").orderBy(*order)
    local = {"_local": F.sum(amount).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))}
    if with_next:
        local["_next"] = F.lead(order[0]).over(ordered)
    result = blocks.withColumns(local).join(offsets, [*keys, "_block"])
    if with_next:
        result = result.withColumn("_next", F.coalesce("_next", "_next_first"))
    return result.withColumn("_upto", F.col("_before") + F.col("_local")).drop("_before", "_local", "_next_first")


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str = "position") -> DataFrame:
    """Number the rows of each key from 1 in `order`; `block` must grow with `order[0]`."""
    rows = df.withColumn("_block", block).withColumn("_one", F.lit(1).cast("long"))
    return running_total(rows, keys, order, "_one").withColumnRenamed("_upto", name).drop("_block", "_one", "_total")


def range_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """Number the rows of each key from 1 in `order` (nulls first), for values that no number stands for.

    The table is range-partitioned and sorted as a whole; a row's number is its place in the partition
    and an offset per partition and key, of which there are no more than partitions and keys together.
    Rows that agree in all of `order` should be few.
    """
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    held = settle(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", at))
    parts = held.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    running = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    side = settle(parts.withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0))).drop("_n"))
    names = [f"_key{i}" for i in range(len(keys))]
    side = side.select(*[F.col(key).alias(fresh) for key, fresh in zip(keys, names, strict=True)], F.col("_part").alias("_of"), "_first", "_before")
    same = F.col("_part") == F.col("_of")
    for key, fresh in zip(keys, names, strict=True):
        same = same & F.col(key).eqNullSafe(F.col(fresh))
    placed = held.join(broadcast_if_small(side), same)
    return placed.withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop(*names, "_part", "_at", "_of", "_first", "_before")


def gap_moments(value: Column, n: Column) -> tuple[Column, Column]:
    """Aggregates `(mean, population std)` of rows that stand for `n` equal values.

    Only zeros may repeat, which is what gap rows give: the spread of the rows is merged
    with that of the further zeros, without sums of squares.
    """
    rows, total, mean, std = F.count(value), F.sum(n), F.avg(value), F.stddev_pop(value)
    repeats = total - rows
    merged = F.sqrt((std * std * rows + mean * mean * rows * repeats / total) / total)
    return mean * rows / total, F.when(repeats == 0, std).otherwise(merged)
