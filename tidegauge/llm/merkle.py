"""Merkle manifest of a table, proved leaf by leaf by a recursive query (operator 11).

Every row is a leaf, H of its fields; the leaves of one `lang` in the order of `doc_id` are a
tree of runs of eight, and the trees' roots, in the order of `lang`, are a tree again.

Leaves get their places from one range-partitioned sort, so no language is ever in one task. The
levels are built upwards, each a grouping into runs of at most eight, and every inner node is
stored as one row: its key, the digests of its children one after the other, and the key and
place that link it to its parent. A recursive query then starts from all leaves and ascends:
each step joins the parent's row, puts the own digest between its siblings, hashes, and goes on
with the parent's link until a node has none. A step's siblings stay in the row of that step, so
nothing that was gathered below is moved again; the rows of a leaf meet once, at the end.

Levels that are counted to hold few nodes are broadcast to the recursion; the wide levels below
them join by key in a recursion of their own. All of it is DataFrames and SQL.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.sizing import broadcast_if_small, settle

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Nodes of the levels that the recursion broadcasts (about 350 bytes each).
BROADCAST_NODES = 100_000
_TOP = -1
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def leaf_digest(values: dict[str, Column]) -> Column:
    """H of the fields in order: `-` for null, else the UTF-8 length, a colon and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values.values()]
    return _digest(F.concat(*parts))


def leaves(docs: DataFrame) -> DataFrame:
    """`doc_id`, `lang`, `digest` and `tampered` (the digest after tampering, null where it is the same) of every row."""
    values = {name: F.col(f"`{name}`").cast("string") for name in FIELDS}
    chosen = F.coalesce(F.crc32(values["doc_id"]) % 3 == 0, F.lit(False))
    lower = F.translate(values["text"], _UPPER, _LOWER)
    tampered = F.when(chosen & (lower != values["text"]), leaf_digest(values | {"text": lower}))
    return docs.select("doc_id", "lang", leaf_digest(values).alias("digest"), tampered.alias("tampered"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Settled `rows` with `place`: their number from 0 in `order` (nulls first) over the whole table.

    Rows are range-partitioned and sorted; a number within the partition and one offset per
    partition make the place. Equal rows are told apart by where they lie, so that many of them
    are no single range.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    held = settle(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", at))
    # One row per range partition.
    sizes = sorted((r["_part"], r["count"]) for r in held.groupBy("_part").count().collect())
    before, offsets = 0, []
    for part, size in sizes:
        offsets.append((part, before))
        before += size
    table = rows.sparkSession.createDataFrame(offsets, "_part int, _before bigint")
    return held.join(F.broadcast(table), "_part").withColumn("place", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def build(nodes: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """Inner nodes and roots of trees given by their lowest nodes (`tree`, `place`, `n`, `digest`).

    `n` is the number of nodes of the tree on that level. Inner nodes are `tree`, `level`, `run`,
    `n` (nodes on their level), `kids` (the digests below, one after the other) and `digest`;
    roots are `tree`, `level`, `run`, `digest`. There are no inner nodes when no tree has two nodes.
    """
    widest = nodes.agg(F.max("n").alias("n")).first()["n"] or 0
    current, level = nodes.withColumnRenamed("place", "run").withColumn("level", F.lit(0)), 0
    inner, roots = None, None
    while True:
        done = current.filter("n = 1").select("tree", "level", "run", "digest")
        roots = done if roots is None else roots.unionAll(done)
        if widest <= 1:
            return inner, roots
        level, widest = level + 1, -(-widest // ARITY)
        child = F.struct("run", _text(F.col("digest")).alias("text"))
        up = current.filter("n > 1").groupBy("tree", F.expr(f"run div {ARITY}").alias("run"), F.ceil(F.col("n") / ARITY).cast("bigint").alias("n"))
        text = up.agg(F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda x: x["text"]), "").alias("text"))
        current = settle(text.select("tree", F.lit(level).alias("level"), "run", "n", F.unhex("text").alias("kids"), _digest(F.col("text")).alias("digest")))
        inner = current if inner is None else inner.unionAll(current)


def _link(level: Column, run: Column, tree: Column) -> list[Column]:
    """Key of the parent of node (`tree`, `level`, `run`) and the place among its children."""
    return [
        tree.alias("up_tree"), (level + 1).cast("int").alias("up_level"),
        F.floor(run / ARITY).cast("bigint").alias("up_run"), (run % ARITY).cast("int").alias("place"),
    ]


def manifest(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """Leaves, inner nodes, trees and the root of a table that has rows.

    Leaves: `leaf` (its number), `doc_id`, `tree`, `digest`, `tampered` and the parent's key
    `up_tree`, `up_level`, `up_run` with the `place` in it (null without a parent). Inner nodes:
    `tree`, `level`, `run`, `kids` and the same link. Trees: `tree`, `subroot`.
    """
    rows = numbered(settle(leaves(docs)), "lang", "doc_id", "digest")
    trees = settle(rows.groupBy("lang").agg(F.min("place").alias("tree"), F.count("*").alias("n")))
    few = trees.select(F.col("lang").alias("_lang"), "tree", "n")
    placed = rows.join(broadcast_if_small(few), F.col("lang").eqNullSafe(F.col("_lang")))
    lowest = settle(placed.select(F.col("place").alias("leaf"), "doc_id", "tree", (F.col("place") - F.col("tree")).alias("place"), "n", "digest", "tampered"))
    inner, roots = build(lowest.select("tree", "place", "n", "digest"))

    count = trees.count()
    tops = numbered(settle(roots), "tree").select("tree", "level", "run", "digest", F.col("place").alias("top"))
    upper, last = build(tops.select(F.lit(_TOP).cast("bigint").alias("tree"), F.col("top").alias("place"), F.lit(count).cast("bigint").alias("n"), "digest"))
    root = last.select(_text(F.col("digest")).alias("root")).first()["root"]

    # A tree's root hangs in the tree of roots, if there is one.
    hung = _link(F.lit(0), F.col("top"), F.lit(_TOP).cast("bigint")) if count > 1 else [F.lit(None).cast(x).alias(y) for x, y in (("bigint", "up_tree"), ("int", "up_level"), ("bigint", "up_run"), ("int", "place"))]
    joint = settle(tops.select("tree", "level", *hung))
    own = ("tree", "level", "run", "kids")
    below = _link(F.col("level"), F.col("run"), F.col("tree"))
    linked = []
    if inner is not None:
        linked.append(inner.filter("n > 1").select(*own, *below))
        linked.append(inner.filter("n = 1").select(*own).join(broadcast_if_small(joint), ["tree", "level"]).select(*own, "up_tree", "up_level", "up_run", "place"))
    if upper is not None:
        linked.append(upper.filter("n > 1").select(*own, *below))
        linked.append(upper.filter("n = 1").select(*own, *[F.lit(None).cast(x).alias(y) for x, y in (("bigint", "up_tree"), ("int", "up_level"), ("bigint", "up_run"), ("int", "place"))]))
    nodes = None
    for part in linked:
        nodes = part if nodes is None else nodes.unionAll(part)
    facts = ("leaf", "doc_id", "tree", "digest", "tampered")
    link = ("up_tree", "up_level", "up_run", "place")
    many = lowest.filter("n > 1").withColumn("level", F.lit(0)).withColumnRenamed("place", "run").select(*facts, *below)
    lone = lowest.filter("n = 1").drop("place").join(broadcast_if_small(joint.filter("level = 0")), "tree").select(*facts, *link)
    subroots = tops.select("tree", _text(F.col("digest")).alias("subroot"))
    return many.unionAll(lone), None if nodes is None else settle(nodes), settle(subroots), root


_CLIMB = """
    with recursive climb (leaf, step, tree, level, run, place, fold, siblings) as (
        select leaf, step, up_tree, up_level, up_run, place, fold, cast(null as binary) from {start}
        union all
        select c.leaf, c.step + 1, n.up_tree, n.up_level, n.up_run, n.place,
            unhex(sha2(lower(hex(concat(substring(n.kids, 1, 32 * c.place), c.fold, substring(n.kids, 32 * c.place + 33)))), 256)),
            concat(substring(n.kids, 1, 32 * c.place), substring(n.kids, 32 * c.place + 33))
        from climb c join {nodes} n on c.tree = n.tree and c.level = n.level and c.run = n.run
    )
    select * from climb
"""


@contextmanager
def unlimited(spark: SparkSession) -> Iterator[None]:
    """While recursive queries run: no limit to their rows, for every leaf has one per level."""
    limit = spark.conf.get(_ROW_LIMIT)
    spark.conf.set(_ROW_LIMIT, "-1")
    try:
        yield
    finally:
        spark.conf.set(_ROW_LIMIT, limit)


def climb(start: DataFrame, nodes: DataFrame) -> DataFrame:
    """All steps of the rows `start` (`leaf`, `step`, parent link, `fold`) up through `nodes`.

    It must run while `unlimited` holds. A step has `leaf`, `step`, the link to go on with, `fold` (the digest so far) and `siblings`
    (the digests of its run's other nodes, left to right; null where the climb starts).
    """
    return start.sparkSession.sql(_CLIMB, start=start, nodes=nodes)


def paths(start: DataFrame, nodes: DataFrame, broadcast_nodes: int) -> DataFrame:
    """`leaf`, `step`, `fold`, `siblings` of all steps; to run while `unlimited` holds."""
    # The levels above `cut` hold few nodes all together and are broadcast.
    sizes = {(r["top"], r["level"]): r["count"] for r in nodes.groupBy((F.col("tree") == _TOP).alias("top"), "level").count().collect()}
    highest = max([level for top, level in sizes if not top], default=0)
    tops = sum(count for (top, _), count in sizes.items() if top)
    above = lambda cut: tops + sum(count for (top, level), count in sizes.items() if not top and level > cut)
    cut = next((cut for cut in range(highest + 1) if above(cut) <= broadcast_nodes), None)
    wanted = ("leaf", "step", "fold", "siblings")
    if cut is None:
        return climb(start, nodes).select(*wanted)
    high = (F.col("tree") == _TOP) | (F.col("level") > cut)
    if cut == 0:
        return climb(start, F.broadcast(nodes)).select(*wanted)
    lower = settle(climb(start, nodes.filter(~high)))
    rest = lower.filter(F.col("tree").isNull() | high).select(
        "leaf", "step", F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("run").alias("up_run"), "place", "fold"
    )
    return lower.select(*wanted).unionAll(climb(rest, F.broadcast(nodes.filter(high))).select(*wanted))


def prove(docs: DataFrame, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """`doc_id`, `leaf`, `subroot`, `root`, `proof_sha256`, `folded_root`, `verified` of every row.

    Nulls in any column are `-` in the leaf; rows with a null `lang` are a tree of their own and
    come first, and so do null ids within a tree. Rows that share `lang` and `doc_id` stand in the
    order of their digests; repeated rows are leaves each. Rows with a null id are not tampered
    with. A tree of one leaf is that leaf; a table of one tree has its subroot as root. Texts of
    any length are hashed whole. An empty table has an empty result. Other columns of `docs`
    play no part.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame(
            [], f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        )
    rows, nodes, subroots, root = manifest(docs)
    start = rows.select("leaf", F.lit(0).alias("step"), "up_tree", "up_level", "up_run", "place", F.coalesce("tampered", "digest").alias("fold"))
    with unlimited(docs.sparkSession):
        if nodes is None:
            steps = start.select("leaf", "step", "fold", F.lit(None).cast("binary").alias("siblings"))
        else:
            steps = paths(start, nodes, broadcast_nodes)
        # The steps of one leaf are as many as its tree has levels.
        path = F.transform(F.array_sort(F.collect_list(F.struct("step", "siblings"))), lambda x: _text(x["siblings"]))
        proofs = settle(steps.groupBy("leaf").agg(
            F.unhex(F.sha2(F.array_join(path, ""), 256)).alias("proof"), F.max_by("fold", "step").alias("folded")
        ))
    named = rows.select("leaf", "doc_id", "tree", _text(F.col("digest")).alias("own")).join(proofs, "leaf").join(broadcast_if_small(subroots), "tree")
    return named.select(
        "doc_id", F.col("own").alias("leaf"), "subroot", F.lit(root).alias("root"), _text(F.col("proof")).alias("proof_sha256"),
        _text(F.col("folded")).alias("folded_root"), (_text(F.col("folded")) == root).alias("verified"),
    )
