"""Passages that documents share, by sparse suffix arrays (operator 5).

Of all word suffixes only those are retained that start at a minimiser: the least `gram`-word
hash of `width` neighbouring ones. The choice depends on the words alone, so two documents that
share a passage retain the same suffixes of it; with the defaults one word in ten starts one.

The retained suffixes are ordered by their first `depth` words (the block's hash serves as the
letter, which is a lexicographic order too, just not the alphabet's). Each is compared with its neighbours in that order: suffixes that agree in
`depth` words stand side by side, and those that agree with one of another document are
matches. `depth + width + gram - 2 <= length`, so every shared passage of `length` words holds
a retained suffix that agrees in `depth` words within it.

A match is then extended to both sides, to all windows of `length` words around its `depth`
words; sorted in their turn, neighbours tell which of them another document has too.
Overlapping windows form the passage. Both sorts are streams over sorted partitions which hold
a few rows at a time. Within a task, suffixes and windows that its batch already decides leave
as verdicts, and one row per batch and text is sorted with the others, so a passage that a third
of all documents share never gathers in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.copies import exact_copies, holds
from tidegauge.llm.words import U, Words, alike_in_text, chain, first_of_text, mix, selected, signed, steps

LENGTH, DEPTH, GRAM, WIDTH = 50, 25, 8, 18
# A place is one long: 16 bits of a second hash, 40 bits of word number, "repeats", "has an earlier copy".
_FLAGS, _WORD = 2, 40
_NUMBER = U((1 << _WORD) - 1)
_ROWS = "k bigint, doc_id bigint, at bigint"


def _numbers(flat: np.ndarray) -> np.ndarray:
    return ((flat >> U(_FLAGS)) & _NUMBER).astype(np.int64)


def _changes(*keys: np.ndarray) -> np.ndarray:
    fresh = np.ones(len(keys[0]), dtype=bool)
    if len(fresh):
        fresh[1:] = np.any([key[1:] != key[:-1] for key in keys], axis=0)
    return fresh


def _decided(key: np.ndarray, other: np.ndarray, ids: np.ndarray, word: np.ndarray) -> pa.RecordBatch:
    """Rows of one batch; what it decides alone gets its flags and a key of its own.

    The first row of a text stays under the text's key, for the other batches.
    """
    order = np.lexsort((ids, other, key))
    fresh = _changes(key[order], other[order])
    begin, group, in_order = np.flatnonzero(fresh), np.cumsum(fresh) - 1, ids[order]
    shared, later = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    if len(key):
        shared[order] = (in_order[begin] != in_order[np.append(begin[1:], len(key)) - 1])[group]
        later[order] = in_order > in_order[begin][group]
    place = (other << U(_WORD + _FLAGS)) | (word.astype(np.uint64) << U(_FLAGS)) | (later.astype(np.uint64) << U(1)) | shared
    key = np.where(later, mix(place ^ mix(ids.view(np.uint64))), key)
    return pa.RecordBatch.from_arrays([signed(key), pa.array(ids), signed(place)], names=["k", "doc_id", "at"])


def retained(docs: DataFrame, length: int, depth: int, gram: int, width: int) -> DataFrame:
    """The sparse suffixes: the hash of their first `depth` words, document and place."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            batch = batch.filter(batch.column("doc_id").is_valid())
            words = Words(batch.column("text"))
            if len(words) < length:
                continue
            hashes = words.hashes()
            grams = chain(hashes, gram)
            inside = words.windows(gram)[: len(grams)]
            lead = np.where(inside, grams, U(2**64 - 1))
            spot = selected(lead, width)
            spot = spot[words.windows(depth)[spot]]
            owner = np.searchsorted(words.firsts, spot, side="right") - 1
            long = words.counts()[owner] >= length
            spot, owner = spot[long], owner[long]
            key, other = chain(hashes, depth)[spot], _second(hashes, depth)[spot]
            # A suffix that a text repeats is told once: `windows` finds the others in the text.
            once = first_of_text(owner, key, other)
            spot, owner, key, other = spot[once], owner[once], key[once], other[once]
            ids, word = np.asarray(batch.column("doc_id"))[owner], spot - words.firsts[owner]
            yield _decided(key, other, ids, word)

    return docs.mapInArrow(find, _ROWS)


def windows(matched: DataFrame, length: int, depth: int) -> DataFrame:
    """The windows of `length` words around each matched suffix's `depth` words."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(x.filter(x.column("places").is_valid()) for x in batches):
            words = Words(batch.column("text"))
            places = batch.column("places")
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(places)))
            word = _numbers(np.asarray(places.flatten()).view(np.uint64))
            inside = word + depth <= words.counts()[owner]
            owner, word = owner[inside], word[inside]
            hashes = words.hashes()
            whole = chain(hashes, length)
            if not len(word) or not len(whole):
                continue
            spot = alike_in_text(words, hashes, depth, word + words.firsts[owner])
            owner = words.owners()[spot]
            wanted = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(wanted, np.maximum(spot - (length - depth), words.firsts[owner]), 1)
            np.add.at(wanted, spot + 1, -1)
            start = np.flatnonzero((np.cumsum(wanted)[: len(whole)] > 0) & words.windows(length)[: len(whole)])
            owner = np.searchsorted(words.firsts, start, side="right") - 1
            key, other = whole[start], _second(hashes, length)[start]
            once = first_of_text(owner, key, other)
            start, owner, key, other = start[once], owner[once], key[once], other[once]
            ids, word = np.asarray(batch.column("doc_id"))[owner], start - words.firsts[owner]
            yield _decided(key, other, ids, word)

    return matched.mapInArrow(extend, _ROWS)


def _second(hashes: np.ndarray, length: int) -> np.ndarray:
    """16 bits of another hash of each run of `length` words."""
    return chain(hashes, length, seed=1) >> U(48)


def agreeing(rows: DataFrame) -> DataFrame:
    """Sort by text and keep what agrees with a neighbour of another document.

    Of a run of equal texts only the first `doc_id` and a flag are remembered once two documents
    are known to have it; until then its rows, all of one document, are held back.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        open_key, open_first, open_shared = None, 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            key, other, ids, place = (np.asarray(batch.column(i)) for i in range(4))
            if held is not None:
                key, other, ids, place = (np.concatenate(x) for x in zip(held, (key, other, ids, place)))
            fresh = _changes(key, other)
            first = np.flatnonzero(fresh)
            group = np.cumsum(fresh) - 1
            lead = ids[first].copy()
            shared = (ids[first] != ids[np.append(first[1:], len(ids)) - 1]) | (np.maximum.reduceat(place & 1, first) > 0)
            if held is None and open_key == (key[0], other[0]):
                lead[0] = open_first
                shared[0] |= open_shared or open_first != ids[0]
            open_key, open_first, open_shared = (key[-1], other[-1]), lead[-1], bool(shared[-1])
            tail = first[-1]
            held = None if open_shared else [x[tail:].copy() for x in (key, other, ids, place)]
            keep = np.flatnonzero(shared[group])
            found = place[keep] | 1 | ((ids[keep] > lead[group[keep]]).astype(np.int64) << 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(found)], names=["doc_id", "at"])

    ordered = rows.repartition("k").select("k", F.shiftrightunsigned("at", _WORD + _FLAGS).alias("g"), "doc_id", "at")
    return ordered.sortWithinPartitions("k", "g", "doc_id").mapInArrow(compare, "doc_id bigint, at bigint")


def shared_passages(
    docs: DataFrame, text: str = "text", length: int = LENGTH, depth: int = DEPTH, gram: int = GRAM, width: int = WIDTH
) -> DataFrame:
    """`docs` with `n_words`, `n_shared`, `n_later` and `passages`.

    A word is shared if a window of `length` words over it occurs in a document with another
    `doc_id`, and later if one occurs in a document with a smaller one (what a dedup would cut).
    `passages` lists the maximal runs of shared words: `start`, `end` (excluded), `later` (words
    of it). Null and short texts share nothing. Rows of one `doc_id` are no copies of each
    other; rows with a null `doc_id` take no part and share nothing. Repeated rows each keep
    their row. Columns of the same names are replaced.
    """
    if depth + width + gram - 2 > length or depth <= gram or width > 64:
        raise ValueError("a passage of `length` words must hold a suffix that agrees in `depth` words")
    names = ("n_words", "n_shared", "n_later", "passages")
    rest = docs.drop(*names, "places", "starts", "copied", "later")
    # All joins with the texts read this one exchange.
    dealt = rest.filter("doc_id is not null").repartition("doc_id")
    marked = dealt.join(exact_copies(rest, text), "doc_id", "left")
    marked = marked.withColumns({"copied": holds("copied", text), "later": holds("later", text)})
    needed = [F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text")]
    matches = agreeing(retained(marked.filter("not later").select(needed), length, depth, gram, width))
    places = matches.groupBy("doc_id").agg(F.collect_list("at").alias("places"))
    matched = dealt.select(needed).join(places, "doc_id", "left").select("doc_id", "text", "places")
    found = agreeing(windows(matched, length, depth))
    starts = found.groupBy("doc_id").agg(F.collect_list("at").alias("starts"))
    kept = rest.columns
    run = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("later", pa.int64())]))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text):
            words = Words(batch.column(text))
            starts = batch.column("starts")
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(pc.fill_null(pc.list_value_length(starts), 0)))
            flat = np.asarray(starts.flatten()).view(np.uint64)
            begin = _numbers(flat)
            # The second hash tells which of several texts under one id a window is of.
            inside = begin + length <= words.counts()[owner]
            begin, flat = begin[inside] + words.firsts[owner[inside]], flat[inside]
            hashes = words.hashes()
            if len(begin):
                mine = _second(hashes, length)[begin] == flat >> U(_WORD + _FLAGS)
                begin, flat = begin[mine], flat[mine]
            long = words.counts() >= length
            masks = []
            for spots, whole in ((begin, "copied"), (begin[(flat & U(2)) > 0], "later")):
                spots = alike_in_text(words, hashes, length, spots)
                edges = np.bincount(spots, minlength=len(words) + 1) - np.bincount(spots + length, minlength=len(words) + 1)
                all_of = (np.asarray(batch.column(whole).cast(pa.int8())) > 0) & long
                masks.append((np.cumsum(edges)[: len(words)] > 0) | np.repeat(all_of, words.counts()))
            owners = words.owners()
            fresh = masks[0] & np.concatenate([[True], ~masks[0][:-1] | (owners[1:] != owners[:-1])])[: len(words)]
            froms = np.flatnonzero(fresh)
            number = np.cumsum(fresh) - 1
            sizes = np.bincount(number[masks[0]], minlength=len(froms)).astype(np.int64)
            later = np.bincount(number[masks[1]], minlength=len(froms)).astype(np.int64)
            home = owners[froms]
            local = froms - words.firsts[home]
            runs = pa.StructArray.from_arrays([pa.array(local), pa.array(local + sizes), pa.array(later)], names=["start", "end", "later"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(home, np.arange(batch.num_rows + 1)).astype(np.int32)), runs)
            sums = [pa.array(np.bincount(owners, weights=mask, minlength=batch.num_rows).astype(np.int64)) for mask in masks]
            made = [pa.array(words.counts()), *sums, lists.cast(run)]
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in kept), *made], names=[*kept, *names])

    out = "n_words bigint, n_shared bigint, n_later bigint, passages array<struct<start:bigint,end:bigint,later:bigint>>"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), out])
    # Rows without an id stay where they are read; apart, so that the joins share their exchange.
    alone = rest.filter("doc_id is null").withColumns({"copied": F.lit(False), "later": F.lit(False), "starts": F.lit(None).cast("array<bigint>")})
    return marked.join(starts, "doc_id", "left").mapInArrow(cover, schema).unionAll(alone.mapInArrow(cover, schema))
