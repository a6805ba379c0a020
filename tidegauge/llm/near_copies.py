"""Texts that share four fifths of their word shingles, for the pipeline's near-duplicate stage.

Two texts are linked when the sets of their 5-word shingles (A-Z lowered; a shorter text is one
shingle) have a Jaccard similarity of 0.8 or more, which is counted on the whole sets. What is
compared comes from SimHash first and then from MinHash: 32 bands of 8 least values each, of which a pair at 0.8 shares one
with a probability of 1 - (1 - 0.8^8)^32 = 0.997, a pair at 0.5 with 0.12. Two bits of each least
value are a sketch of 512 bits; pairs that differ in more than 80 of them are not counted, three
and a half standard deviations more than a similarity of 0.8 gives.

Equal sets are one node before any comparison. The first links are those of SimHash (`simhash.py`,
operator 6, over 5-word shingles): nodes whose fingerprints differ in at most 3 bits, found by
anchor-point covering and each counted exactly. Pairs at 0.8 differ in about 10 bits, where no
covering of 64 bits is short, so what SimHash leaves apart is looked for by MinHash.

Only components are asked for, so nodes that are
in one component already are not compared. In rounds, each band has one leader, a node of the
band's largest component (another one per round), and the band's nodes of other components meet
it; the closest leader of a node's bands is compared. A round is linear, and rounds go on while
one joins a tenth of what was apart. Then an exact prefix filter thins what is left: with
shingles in the order of how many nodes have them, two sets at 0.8 share one of their first
fifth and one more, so a node whose first shingles no other component has is done. The nodes
that remain meet, band by band, only those of other components, the largest component of a band
never itself, and only where a finer sketch (1,024 bits of other least values, a bound of three
standard deviations) allows it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.sizing import settle
from tidegauge.llm import simhash
from tidegauge.llm.components import components
from tidegauge.llm.words import M1, U, Words, chain, mix, signed, steps

SHINGLE = 5
# Bytes of text (or of shingle sets) of one numpy step.
STEP = 2 << 20
BANDS, ROWS = 32, 8
APART = 80
# A round of leaders is followed by another while it joins this share of the bands' rows.
WORTH = 0.1
FINE, FINE_APART = 1024, 131
_LANES = BANDS * ROWS // 32
_FLIP = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
_TIMES = mix(_FLIP + U(1)) | U(1)
_SKETCH = [f"s{i}" for i in range(_LANES)]
_FINE_FLIP = mix(np.arange(1, FINE + 1, dtype=np.uint64) + U(1 << 32))
_FINE_TIMES = mix(_FINE_FLIP + U(1)) | U(1)
_FINE_SKETCH = [f"f{i}" for i in range(FINE // 64)]


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, and where each text's begin (and all end)."""
    words = Words(texts, lower=True)
    hashes, counts, owners = words.hashes(), words.counts(), words.owners()
    grams = chain(hashes, SHINGLE)
    spot = np.flatnonzero(words.windows(SHINGLE)[: len(grams)])
    keys, owner = [grams[spot]], [owners[spot]]
    for size in range(1, SHINGLE):
        rows = np.flatnonzero(counts == size)
        if len(rows):
            keys.append(chain(hashes, size, size)[words.firsts[rows]])
            owner.append(rows)
    key, owner = np.concatenate(keys), np.concatenate(owner)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return key[fresh], np.searchsorted(owner[fresh], np.arange(len(counts) + 1))


def marks(docs: DataFrame) -> DataFrame:
    """`doc_id`, `code`, `node` (a hash of the shingle set), `n` (its size), `bits` (SimHash), bands and sketch of each row with words."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, size=STEP):
            keys, at = shingles(batch.column("text"))
            batch = batch.filter(pa.array(np.diff(at) > 0))
            starts = at[:-1][np.diff(at) > 0]
            if not len(starts):
                continue
            size = np.diff([*starts, len(keys)])
            node = mix(np.add.reduceat(mix(keys), starts) + size.astype(np.uint64) * M1)
            bands = np.zeros((len(starts), BANDS), dtype=np.uint64)
            sketch = np.zeros((_LANES, len(starts)), dtype=np.uint64)
            for number in range(BANDS * ROWS):
                band, lane = number // ROWS, number // 32
                least = mix(np.minimum.reduceat((keys ^ _FLIP[number]) * _TIMES[number], starts))
                bands[:, band] = mix(bands[:, band] * M1 + least + U(band))
                sketch[lane] |= (least & U(3)) << U(2 * (number % 32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), signed(bands.ravel()))
            prints = [simhash.fingerprint(text.as_buffer().to_pybytes(), SHINGLE) for text in batch.column("text")]
            bits = signed(np.array(prints, dtype=np.uint64))
            columns = [batch.column("doc_id"), batch.column("code"), signed(node), pa.array(size.astype(np.int64)), bits, lists, *map(signed, sketch)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "code", "node", "n", "bits", "bands", *_SKETCH])

    kind = docs.schema["doc_id"].dataType.simpleString()
    lanes = ", ".join(f"{name} bigint" for name in _SKETCH)
    return docs.select("doc_id", "text", F.xxhash64("text").alias("code")).mapInArrow(
        find, f"doc_id {kind}, code bigint, node bigint, n bigint, bits bigint, bands array<bigint>, {lanes}"
    )


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Rows of one `doc_id` and text; only the id is a key of the join, so its order is kept."""
    return (left["doc_id"] == right["doc_id"]) & (left["code"].bitwiseXOR(right["code"]) == 0)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`node`, `held` (its sorted shingle hashes) of the nodes `wanted` (`doc_id`, `code`, `node`)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, size=STEP):
            keys, at = shingles(batch.column("text"))
            held = [keys[a:b].tobytes() for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(held, type=pa.binary())], names=["node", "held"])

    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("code"))
    found = texts.join(wanted, same_row(texts, wanted)).select("node", "text")
    return found.mapInArrow(find, "node bigint, held binary").dropDuplicates(["node"])


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of `pairs` (`a`, `b`) whose sets have a Jaccard similarity of 0.8 or more."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                good.append(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(good, type=pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("held").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("held").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint")


def _fine(sets: DataFrame) -> DataFrame:
    """`node` and its fine sketch: the lowest bit of each of 1,024 further least values."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "held", STEP):
            held = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column("held")]
            keys, starts = np.concatenate(held), np.cumsum([0, *map(len, held[:-1])])
            lanes = np.zeros((len(_FINE_SKETCH), len(held)), dtype=np.uint64)
            for number in range(FINE):
                least = mix(np.minimum.reduceat((keys ^ _FINE_FLIP[number]) * _FINE_TIMES[number], starts))
                lanes[number // 64] |= (least & U(1)) << U(number % 64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), *map(signed, lanes)], names=["node", *_FINE_SKETCH])

    return sets.select("node", "held").mapInArrow(find, "node bigint, " + ", ".join(f"{name} bigint" for name in _FINE_SKETCH))


def _promising(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """`node` of those of `roots` (`node`, `root`) that share one of their first shingles with another root.

    Shingles are ordered by how many of these nodes have them, so the first are the rarest.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "held", STEP):
            held = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column("held")]
            owner = pa.array(np.repeat(np.arange(len(held)), [len(x) for x in held]))
            first = pa.array(np.array([len(x) - -(-4 * len(x) // 5) + 1 for x in held], dtype=np.int64))
            columns = [batch.column("node").take(owner), batch.column("root").take(owner), first.take(owner), signed(np.concatenate(held))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "root", "first", "shingle"])

    rows = settle(sets.join(roots, "node").select("node", "root", "held").mapInArrow(spread, "node bigint, root bigint, first bigint, shingle bigint"))
    # A shingle of one root only can join nothing, wherever it stands in the order.
    often = rows.groupBy("shingle").agg(F.count("*").alias("often"), F.min("root").alias("low"), F.max("root").alias("high"))
    order = F.row_number().over(Window.partitionBy("node").orderBy("often", "shingle"))
    ranked = rows.join(often, "shingle").withColumn("at", order).filter(F.col("at") <= F.col("first"))
    tokens = settle(ranked.filter("low < high").select("node", "root", "shingle"))
    live = tokens.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("shingle")
    return tokens.join(live, "shingle", "left_semi").select("node").distinct()


def _by_simhash(nodes: DataFrame) -> DataFrame:
    """`a`, `b`: nodes whose fingerprints differ in at most 3 bits, those of one fingerprint by its least node.

    `nodes` has `node` and `bits`.
    """
    firsts = settle(nodes.groupBy("bits").agg(F.min("node").alias("first")))
    same = nodes.join(firsts, "bits").filter("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    left = firsts.select(F.col("bits").alias("a"), F.col("first").alias("x"))
    right = firsts.select(F.col("bits").alias("b"), F.col("first").alias("y"))
    near = simhash.links(firsts).join(left, "a").join(right, "b")
    return same.unionAll(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


_FACTS = ("node", "n", "root", *_SKETCH)


def _close(left: str, right: str, sketch: list[str]) -> Column:
    return sum((F.bit_count(F.col(f"{left}{name}").bitwiseXOR(F.col(f"{right}{name}"))) for name in sketch), F.lit(0))


def _mixed(held: DataFrame) -> DataFrame:
    """Rows of bands that hold more than one root, with `main`: the root that most of the band's rows have."""
    sizes = held.groupBy("band", "root").agg(F.count("*").alias("many"))
    main = sizes.groupBy("band").agg(F.max(F.struct("many", "root")).alias("most"), F.count("*").alias("roots")).filter("roots > 1")
    return held.join(main.select("band", F.col("most.root").alias("main")), "band")


def _by_leaders(held: DataFrame, turn: int) -> DataFrame:
    """`a`, `b`: each node outside its bands' main roots with the closest of their leaders."""
    order = F.xxhash64("node", "band", F.lit(turn)).alias("order")
    leads = held.filter("root = main").groupBy("band").agg(F.min(F.struct(order, *_FACTS)).alias("lead"))
    q = leads.select("band", *[F.col(f"lead.{name}").alias(f"q_{name}") for name in _FACTS])
    sized = F.least("n", "q_n") * 5 >= F.greatest("n", "q_n") * 4
    bits = _close("", "q_", _SKETCH)
    met = held.filter("root != main").join(q, "band").filter(sized & (bits <= APART))
    best = met.groupBy("node").agg(F.min(F.struct(bits.alias("bits"), "q_node")).alias("best"))
    return best.select(F.least("node", "best.q_node").alias("a"), F.greatest("node", "best.q_node").alias("b")).distinct()


def _the_rest(held: DataFrame, sets: DataFrame) -> DataFrame:
    """`a`, `b`: pairs of different roots that share a band, pass the prefix filter and may be linked."""
    wanted = settle(_promising(sets, held.select("node", "root").distinct()))
    left = _mixed(held.join(wanted, "node", "left_semi").drop("main"))
    rows = settle(left.join(_fine(sets.join(wanted, "node", "left_semi")), "node").select("band", "main", "node", "n", "root", *_FINE_SKETCH))
    q = rows.select("band", *[F.col(name).alias(f"q_{name}") for name in ("node", "n", "root", *_FINE_SKETCH)])
    once = (F.col("q_root") == F.col("main")) | (F.col("node") < F.col("q_node"))
    sized = F.least("n", "q_n") * 5 >= F.greatest("n", "q_n") * 4
    may = (F.col("root") != F.col("q_root")) & once & sized & (_close("", "q_", _FINE_SKETCH) <= FINE_APART)
    outside = rows.filter("root != main").alias("o")
    met = outside.join(q.withColumnRenamed("band", "q_band"), (F.col("band") == F.col("q_band")) & may)
    return met.select(F.least("node", "q_node").alias("a"), F.greatest("node", "q_node").alias("b")).distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """`doc_id`, `code`, `root` of every row with words: its component.

    `docs` has `doc_id` (not null) and `text`; `code` is the xxhash64 of the text, by which rows
    that share a `doc_id` are told apart. An empty table has an empty result. A text is read
    whole, however long; its set of shingles is one cell.
    """
    rows = settle(marks(docs))
    nodes = settle(rows.groupBy("node").agg(
        F.min(F.struct("doc_id", "code", "bits")).alias("lead"), *[F.first(name).alias(name) for name in ("n", "bands", *_SKETCH)]
    ))
    # Only bands that two nodes share matter from here on.
    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("held")).filter("held > 1").select("band")
    live = settle(banded.join(shared, "band", "left_semi").join(nodes.select("node", "n", *_SKETCH), "node"))
    alike = settle(_by_simhash(nodes.select("node", F.col("lead.bits").alias("bits"))))
    compared = live.select("node").unionAll(alike.select("a")).unionAll(alike.select("b")).distinct()
    wanted = nodes.join(compared, "node", "left_semi").select("lead.doc_id", "lead.code", "node")
    sets = settle(_sets(docs, wanted))

    links = [settle(_alike(alike, sets))]
    reach, before, turn = settle(components(links[0])), None, 0
    while True:
        held = settle(_mixed(live.join(reach, "node", "left").withColumn("root", F.coalesce("root", "node"))))
        apart = held.filter("root != main").count()
        last = before is not None and apart > (1 - WORTH) * before
        if not apart:
            break
        pairs = _the_rest(held, sets) if last else _by_leaders(held, turn)
        links.append(settle(_alike(pairs, sets)))
        every = links[0]
        for more in links[1:]:
            every = every.unionAll(more)
        reach = settle(components(every))
        if last:
            break
        before, turn = apart, turn + 1
    named = rows.select("doc_id", "code", "node").join(reach, "node", "left")
    return named.select("doc_id", "code", F.coalesce("root", "node").alias("root"))
