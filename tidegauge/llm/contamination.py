"""Benchmark decontamination by greedy string tiling (operator 7).

Words are compared in lower case without punctuation at their edges. A document and a benchmark
item meet on shared seeds of `least` words. Their common word sequences are then tiled: the
longest one of unmarked words is marked in both, again and again, until none of `least` words is
left. Matches start from equal hashes of `least` words, kept by a running hash over either side
(Karp-Rabin), and grow word by word. The tiles may stand in any order, so a passage whose
sentences were moved around is covered like one that was copied as it is; an item counts as
leaked when the tiles cover `threshold` of its words.

The benchmark is a query set: it is cut into blocks with a bound on their words, and each block
is broadcast over one pass of all documents. Nothing but the few documents that share seeds goes
beyond the hashing, and nothing is shuffled.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.sizing import settle
from tidegauge.llm.words import MARKS, U, Words, chain, steps

LEAST = 4
THRESHOLD = 0.5
# The bound of one broadcast block, in words of the benchmark (an item longer than it stands alone).
BLOCK_WORDS = 2_000_000
_FILTER_BITS = 24


@dataclass
class Block:
    """Items of one block: ids, word hashes one after the other, and the seeds in order."""

    items: list
    borders: np.ndarray
    words: np.ndarray
    seeds: np.ndarray
    seed_item: np.ndarray
    present: np.ndarray
    least: int

    @classmethod
    def of(cls, rows: list, least: int) -> Block:
        words = Words(pa.array([row["text"].encode() for row in rows], type=pa.large_binary()), lower=True)
        words.trim(MARKS)
        hashes = words.hashes()
        grams = chain(hashes, least)
        inside = np.flatnonzero(words.windows(least)[: len(grams)])
        seed, owner = grams[inside], words.owners()[inside]
        order = np.argsort(seed, kind="stable")
        present = np.zeros(1 << _FILTER_BITS, dtype=bool)
        present[(seed >> U(64 - _FILTER_BITS)).astype(np.int64)] = True
        return cls([row["item_id"] for row in rows], words.firsts, hashes, seed[order], owner[order], present, least)

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Which of `grams` are seeds."""
        maybe = np.flatnonzero(self.present[(grams >> U(64 - _FILTER_BITS)).astype(np.int64)])
        at = np.searchsorted(self.seeds, grams[maybe])
        at[at == len(self.seeds)] = 0
        return maybe[self.seeds[at] == grams[maybe]] if len(self.seeds) else maybe[:0]


def agreement(item: np.ndarray, text: np.ndarray, here: np.ndarray, there: np.ndarray) -> np.ndarray:
    """How many words agree from each pair of places on, by running hashes of 2^k words, longest first."""
    size = np.zeros(len(here), dtype=np.int64)
    for power in range(int(min(len(item), len(text))).bit_length() - 1, -1, -1):
        step = 1 << power
        a, b = chain(item, step), chain(text, step)
        x, y = here + size, there + size
        fits = np.flatnonzero((x < len(a)) & (y < len(b)))
        size[fits[a[x[fits]] == b[y[fits]]]] += step
    return size


def tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of two hashed word sequences: (start in item, start in text, words).

    The longest common run of unmarked words comes first; of equally long ones the first in the
    item, then in the text. No word of either side is in two tiles.
    """
    if len(item) < least or len(text) < least:
        return []
    # Where runs of `least` words agree, but not the words before them: there a longest run begins.
    # Places of a gram are grouped by the word before, so a word repeated n times in either side
    # makes pairs in proportion to n, not to its square.
    starts: dict[int, dict[int | None, list[int]]] = defaultdict(lambda: defaultdict(list))
    a, b = item.tolist(), text.tolist()
    for place, gram in enumerate(chain(item, least).tolist()):
        starts[gram][a[place - 1] if place else None].append(place)
    here, there = [], []
    for place, gram in enumerate(chain(text, least).tolist()):
        if gram in starts:
            last = b[place - 1] if place else None
            for before, places in starts[gram].items():
                if last is None or before != last:
                    here += places
                    there += [place] * len(places)
    size = agreement(item, text, np.array(here, dtype=np.int64), np.array(there, dtype=np.int64))
    heap = [(-n, x, y) for n, x, y in zip(size.tolist(), here, there) if n >= least]
    heapq.heapify(heap)
    used_a, used_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
    found = []
    while heap and not used_a.all():
        size, here, there = heapq.heappop(heap)
        free = ~(used_a[here : here - size] | used_b[there : there - size])
        if free.all():
            used_a[here : here - size] = used_b[there : there - size] = True
            found.append((here, there, -size))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for begin, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if end - begin >= least:
                heapq.heappush(heap, (begin - end, here + begin, there + begin))
    return found


def _leaks(block: Block, words: np.ndarray, places: np.ndarray, grams: np.ndarray, threshold: float) -> Iterator[tuple]:
    """Items that the word hashes of one document leak, given its seeds and their places."""
    near: dict[int, list[int]] = defaultdict(list)
    low, high = np.searchsorted(block.seeds, grams, side="left"), np.searchsorted(block.seeds, grams, side="right")
    for place, a, b in zip(places.tolist(), low.tolist(), high.tolist()):
        for owner in np.unique(block.seed_item[a:b]).tolist():
            near[owner].append(place)
    for owner, found in sorted(near.items()):
        item = block.words[block.borders[owner] : block.borders[owner + 1]]
        held = np.zeros(len(words), dtype=bool)
        for step in range(block.least):
            held[np.add(found, step)] = True
        if held.sum() < threshold * len(item):
            continue  # tiles lie within these words, so they can't cover enough
        # Runs of other words in between become one word that no item has.
        kept = held | np.concatenate([[False], held[:-1]])
        text = np.where(held, words, U(0))[kept]
        found = tiles(item, text, block.least)
        covered = sum(n for _, _, n in found)
        if covered >= threshold * len(item):
            yield block.items[owner], len(item), covered, covered / len(item), len(found)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", least: int = LEAST, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """`doc_id`, `item_id`, `n_item_words`, `covered`, `coverage`, `tiles` of each leaked item.

    `benchmark` has `item_id` and `text`. Items of fewer than `least` words (or null) prove
    nothing and leak nowhere. Null and empty documents leak nothing. Repeated
    documents and repeated items give a row each. Ties between equally long tiles go to the first
    place in the item, then in the text. An empty table of either kind gives an empty result. Texts
    of any length are read whole, in one piece. Other columns of either table play no part.
    """
    # One block after the other: its leaks are written before the next block is held.
    found = [settle(_block_leaks(docs, rows, benchmark, text, least, threshold)) for rows in _blocks(benchmark, block_words)]
    return reduce(DataFrame.unionAll, found)


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", least: int = LEAST, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """The rows of `docs`, all columns, that leak no item of `benchmark`.

    Each row is judged by its own text, whatever its id, in the pass that finds the leaks:
    nothing is joined or shuffled. What leaks is told at `contaminated`.
    """
    for number, rows in enumerate(_blocks(benchmark, block_words)):
        docs = _block_clean(settle(docs) if number else docs, rows, text, least, threshold)
    return docs


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list]:
    """Items in blocks of about `block_words` words, one at a time."""
    items = benchmark.select("item_id", F.col("text").alias("text")).filter("text is not null")
    volume = F.size(F.split("text", "[\\x20\\x09-\\x0D]+"))
    total = items.agg(F.sum(volume).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_words))
    for number in range(blocks):
        yield items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).orderBy("item_id", "text").collect()


def _found(block: Block, texts: pa.Array, threshold: float) -> list[tuple]:
    """(row, item, words, covered, coverage, tiles) of the leaks of a batch of texts."""
    words = Words(texts, lower=True)
    words.trim(MARKS)
    hashes = words.hashes()
    grams = chain(hashes, block.least)
    at = block.hits(grams)
    at = at[words.windows(block.least)[at]]
    owner = np.searchsorted(words.firsts, at, side="right") - 1
    edges = [*np.flatnonzero(np.diff(owner, prepend=-1)).tolist(), len(at)]
    found = []
    for start, end in zip(edges, edges[1:]):
        row, hit = int(owner[start]), at[start:end]
        base = words.firsts[row]
        for leak in _leaks(block, hashes[base : words.firsts[row + 1]], hit - base, grams[hit], threshold):
            found.append((row, *leak))
    return found


def _block_clean(docs: DataFrame, rows: list, text: str, least: int, threshold: float) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(Block.of(rows, least))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text):
            clean = np.ones(batch.num_rows, dtype=bool)
            clean[[row for row, *_ in _found(held.value, batch.column(text), threshold)]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)


def _block_leaks(docs: DataFrame, rows: list, items: DataFrame, text: str, least: int, threshold: float) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(Block.of(rows, least))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text):
            found = _found(held.value, batch.column(text), threshold)
            columns = list(zip(*found)) or [()] * 6
            ids = batch.column("doc_id").take(pa.array(columns[0], type=pa.int64()))
            kinds = (item_type, pa.int64(), pa.int64(), pa.float64(), pa.int64())
            made = [pa.array(values, type=kind) for values, kind in zip(columns[1:], kinds)]
            yield pa.RecordBatch.from_arrays([ids, *made], names=["doc_id", "item_id", "n_item_words", "covered", "coverage", "tiles"])

    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(items.schema["item_id"].dataType)
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    out = f"doc_id {kind}, item_id {item_kind}, n_item_words bigint, covered bigint, coverage double, tiles bigint"
    return docs.select("doc_id", text).mapInArrow(search, out)
