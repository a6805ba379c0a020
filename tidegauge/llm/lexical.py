"""Ranked lexical search of many queries at once over shared sub-expressions (operator 13).

A document's score for an item is a sum of one weight per term, so items that share terms share
parts of their sums. Term sets that several items have are mined by pairing: the pair that most
items hold becomes a node of its own, in rounds, until no pair of neighbours is shared. The nodes
make a directed graph: a term is a leaf, a node is the sum of two others, an item the sum of the
few nodes that are left of it. Per document every node's accumulator is computed once, from below
upwards, and every item that holds the node takes it.

Documents are read once and reduced to their length and the counts of the terms that any item
has; that table is stored. Its document frequencies give the weights; a second pass over it fills
the accumulators of many documents at a time (a node is a row of a matrix) and keeps the best
documents of each item per task. Nothing but these is shuffled. The items are a stated query
set: they come in blocks with a bound on their words, one after the other.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.sizing import settle
from tidegauge.llm.words import STEP_BYTES, U, Words, steps

K = 10
# The bound of one block of items, in words (a longer item stands alone).
BLOCK_WORDS = 100_000
# Neighbours of an item's list, in the order of how many items share them, that may become a pair.
REACH = 8
_CELLS = 1 << 22
_FILTER_BITS = 20

# Letters and digits of ASCII, and all bytes of other characters, make terms; A-Z become a-z.
_TERM = np.full(256, 32, dtype=np.uint8)
_TERM[0x80:] = np.arange(0x80, 256)
for _first, _last in ((0x30, 0x3A), (0x61, 0x7B)):
    _TERM[_first:_last] = np.arange(_first, _last)
_TERM[0x41:0x5B] = np.arange(0x61, 0x7B)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of `texts` as terms and spaces, and where each text begins (and all end)."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, at, data = texts.buffers()
    at = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, dtype=np.uint8)
    return _TERM[held], at - at[0]


def _words(data: np.ndarray, at: np.ndarray) -> Words:
    return Words(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]))


def terms(text: str | None) -> list[bytes]:
    """Terms of one text, with repeats."""
    return _TERM[np.frombuffer((text or "").encode(), dtype=np.uint8)].tobytes().split()


@dataclass
class Graph:
    """Terms (bytes), pairs of rows that make the further rows, and the rows of each item."""

    ids: list
    terms: list[bytes]
    pairs: list[tuple[int, int]]
    items: list[list[int]]

    @property
    def rows(self) -> int:
        return len(self.terms) + len(self.pairs)


def mine(lists: list[list[int]], first: int, reach: int = REACH) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Pairs of elements that two or more of `lists` share, and the lists with pairs in their place.

    New elements are numbered from `first`. In a round the most shared pairs come first, and no
    element of a list takes part in two; pairs that are left with one list are not made.
    """
    lists, pairs = [list(x) for x in lists], []
    while True:
        where: dict[tuple[int, int], list[int]] = defaultdict(list)
        for number, held in enumerate(lists):
            for at, a in enumerate(held):
                for b in held[at + 1 : at + 1 + reach]:
                    where[a, b].append(number)
        shared = sorted((pair for pair, owners in where.items() if len(owners) > 1), key=lambda p: (-len(where[p]), p))
        became: list[dict[int, int | None]] = [{} for _ in lists]
        made = len(pairs)
        for a, b in shared:
            owners = [x for x in where[a, b] if a not in became[x] and b not in became[x]]
            if len(owners) > 1:
                for x in owners:
                    became[x][a], became[x][b] = first + len(pairs), None
                pairs.append((a, b))
        if made == len(pairs):
            return pairs, lists
        lists = [[y for x in held if (y := new.get(x, x)) is not None] for held, new in zip(lists, became)]


def share(ids: list, texts: list[str | None], reach: int = REACH) -> Graph:
    """The graph of some items. A term that an item repeats stands in it as often."""
    counts = [Counter(terms(text)) for text in texts]
    held = Counter(term for count in counts for term in count)
    known = sorted(held, key=lambda t: (-held[t], t))
    row = {term: number for number, term in enumerate(known)}
    # The copies of a term are elements of their own while pairs are mined.
    element = {(row[term], 0): row[term] for term in known}
    for count in counts:
        for term, n in count.items():
            for copy in range(1, n):
                element.setdefault((row[term], copy), len(element))
    term_of = {number: term for (term, _), number in element.items()}
    lists = [[element[row[term], copy] for term in sorted(count, key=row.get) for copy in range(count[term])] for count in counts]
    pairs, lists = mine(lists, len(element), reach)
    at = lambda x: term_of[x] if x < len(element) else x - len(element) + len(known)
    return Graph(ids, known, [(at(a), at(b)) for a, b in pairs], [[at(x) for x in held] for held in lists])


def term_counts(docs: DataFrame, known: list[bytes], id: str = "doc_id", text: str = "text", step: int = STEP_BYTES) -> DataFrame:
    """`doc_id`, `n` (all terms), `terms` (numbers within `known`) and `counts` of each document.

    Texts longer than a step are read in pieces that end between terms; counts add up.
    """
    book = _words(*_bytes(pa.array(known, type=pa.large_binary()))).hashes()
    order = np.argsort(book)
    present = np.zeros(1 << _FILTER_BITS, dtype=bool)
    present[(book >> U(64 - _FILTER_BITS)).astype(np.int64)] = True
    model = docs.sparkSession.sparkContext.broadcast((book[order], order, present))

    def pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        data, at = _bytes(batch.column("text"))
        if batch.num_rows > 1 or len(data) <= 2 * step:
            yield data, at, np.arange(batch.num_rows)
            return
        start = 0
        while start < len(data):
            end = min(start + step, len(data))
            while end < len(data):  # on to the next space
                gap = np.flatnonzero(data[end : end + step] == 32)
                end = end + int(gap[0]) if len(gap) else min(end + step, len(data))
                if len(gap):
                    break
            yield data[start:end], np.array([0, end - start]), np.zeros(1, dtype=np.int64)
            start = end

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, order, present = model.value
        for batch in steps(batches, "text", step):
            size, keys, amounts = np.zeros(batch.num_rows, dtype=np.int64), [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for data, at, rows in pieces(batch):
                words = _words(data, at)
                size[rows] += words.counts()
                found = words.hashes()
                maybe = np.flatnonzero(present[(found >> U(64 - _FILTER_BITS)).astype(np.int64)])
                place = np.searchsorted(hashes, found[maybe])
                place[place == len(hashes)] = 0
                good = hashes[place] == found[maybe] if len(hashes) else np.zeros(0, dtype=bool)
                owner = rows[np.searchsorted(words.firsts, maybe[good], side="right") - 1]
                key, amount = np.unique(owner * len(hashes) + order[place[good]], return_counts=True)
                keys.append(key)
                amounts.append(amount)
            key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            amount = np.bincount(inverse, np.concatenate(amounts), len(key)).astype(np.int32)
            many = max(len(hashes), 1)
            at = pa.array(np.searchsorted(key // many, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in ((key % many).astype(np.int32), amount)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), *lists], names=["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col(f"`{id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(count, "doc_id bigint, n bigint, terms array<int>, counts array<int>")


def frequencies(counted: DataFrame, known: int) -> np.ndarray:
    """Documents that hold each term: counted per task, then added up."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(known, dtype=np.int64)
        for batch in batches:
            total += np.bincount(np.asarray(batch.column(0).flatten()), minlength=known)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["term", "df"])

    out = np.zeros(known, dtype=np.int64)
    for row in counted.select("terms").mapInArrow(add, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[row["term"]] = row["df"]
    return out


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], dtype=np.int64)


def accumulate(graph: Graph, rows: np.ndarray) -> np.ndarray:
    """Scores (item, document): every node once, then the items.

    `rows` (`graph.rows`, document) holds the terms' impacts in its first rows; the others are filled.
    """
    for row, (a, b) in enumerate(graph.pairs, len(graph.terms)):
        np.add(rows[a], rows[b], out=rows[row])
    scores = np.zeros((len(graph.items), rows.shape[1]), dtype=np.int64)
    for number, held in enumerate(graph.items):
        for row in held:
            scores[number] += rows[row]
    return scores


def best_of(counted: DataFrame, graph: Graph, weight: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """`item` (its number), `doc_id`, `score`: the `k` best documents of each item in every task."""
    model = counted.sparkSession.sparkContext.broadcast((graph, weight))
    width = max(16, _CELLS // max(1, graph.rows + len(graph.items)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, weight = model.value
        best = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for _ in graph.items]
        least = np.ones(len(graph.items), dtype=np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, width):
                batch = whole.slice(start, width)
                ids, n = np.asarray(batch.column("doc_id")), np.asarray(batch.column("n"))
                term, tf = np.asarray(batch.column("terms").flatten()), np.asarray(batch.column("counts").flatten()).astype(np.int64)
                owner = np.repeat(np.arange(len(n)), np.asarray(batch.column("terms").value_lengths()))
                m = 100 - 75 + (75 * n * documents) // length
                rows = np.zeros((graph.rows, len(n)), dtype=np.int64)
                rows[term, owner] = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[owner]))
                scores = accumulate(graph, rows)
                better = scores >= least[:, None]
                for item in np.flatnonzero(better.any(axis=1)).tolist():
                    some = np.flatnonzero(better[item])
                    doc = np.concatenate([best[item][0], ids[some]])
                    score = np.concatenate([best[item][1], scores[item, some]])
                    kept = np.lexsort((doc, -score))[:k]
                    best[item] = doc[kept], score[kept]
                    if len(kept) == k:
                        least[item] = score[kept[-1]]
        made = [np.repeat(np.arange(len(best)), [len(x) for x, _ in best]), *(np.concatenate([x[i] for x in best] or [np.zeros(0, dtype=np.int64)]) for i in (0, 1))]
        yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in made], names=["item", "doc_id", "score"])

    named = counted.filter("doc_id is not null and size(terms) > 0")
    return named.mapInArrow(search, "item bigint, doc_id bigint, score bigint")


def ranked(
    docs: DataFrame, items: DataFrame, k: int = K, id: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS, reach: int = REACH
) -> DataFrame:
    """`item_id`, `rank`, `doc_id`, `score` of the `k` best documents of each item, scores above 0.

    `items` has `item_id` and `text`. Null and empty texts have no terms: such an item finds
    nothing, such a document is not found and doesn't count. Repeated documents are documents
    each. A document with a null id counts in all statistics but is not reported. Equal item
    rows are one item; rows of one `item_id` with different texts are items each, so its ranks
    repeat. Equal scores go by ascending id. An empty table has an empty result. Long texts are
    read whole, in pieces. Other columns of either table play no part. Terms are matched by 64 bits of hash.
    """
    spark = docs.sparkSession
    asked = items.select("item_id", F.col("text").alias("text")).distinct()
    volume = asked.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))).alias("n")).first()["n"] or 0
    blocks = max(1, -(-volume // block_words))
    kind = items.schema["item_id"].dataType.simpleString()
    answers = None
    for number in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).orderBy("item_id", "text").collect()
        graph = share([row["item_id"] for row in rows], [row["text"] for row in rows], reach)
        counted = settle(term_counts(docs, graph.terms, id, text))
        facts = counted.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("length")).first()
        documents, length = facts["documents"], max(facts["length"] or 0, 1)
        weight = weights(frequencies(counted, len(graph.terms)), documents)
        found = best_of(counted, graph, weight, documents, length, k)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
        few = found.withColumn("rank", rank).filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(graph.ids)), f"item bigint, item_id {kind}")
        # The block's items bound the result of a block and the table of their names.
        answer = settle(few.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
        answers = answer if answers is None else answers.unionAll(answer)
    return answers
