"""Words that repeat an earlier document, by seed and extend (operator 8).

Documents meet on winnowed anchors: of every run of neighbouring `seed`-word hashes that a
window of `length` words holds, the least is kept, so two equal windows keep an equal anchor.
Anchors of a single document are dropped. Around the others the match is extended to both
sides: each window of `length` words that holds the anchor is an extension by some words to the
left and the rest to the right, and two extensions match when their hashes do. Overlapping
extensions merge into maximal repeats, which are never shorter than `length`.

Only the first document of a text keeps it, so instead of pairs each extension asks for the
least `doc_id` that has it. Within a task everything that a smaller `doc_id` of the same batch
already has is settled on the spot and leaves as a verdict; one row per batch and extension is
compared over the shuffle, so a passage that a third of all documents share is a few rows there.

A text that is an exact copy of a smaller `doc_id`'s is settled first: it loses all its words and
shows nothing to others that the first one does not. Windows are compared by 80 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.copies import exact_copies, holds
from tidegauge.llm.words import U, Words, alike_in_text, chain, first_of_text, mix, selected, signed, sliding_least, steps

LENGTH = 13
SEED = 5
# A place is one long: 16 bits of a second hash, 40 bits the number of the word, 1 bit is a verdict.
_WORD = 40
_NUMBER = U((1 << _WORD) - 1)


def _spread(places: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Keys that spread settled rows over all tasks."""
    return mix(places ^ mix(docs.view(np.uint64)))


def _borders(*keys: np.ndarray) -> np.ndarray:
    """Where any of the sorted `keys` changes."""
    fresh = np.ones(len(keys[0]), dtype=bool)
    if len(fresh):
        fresh[1:] = np.any([key[1:] != key[:-1] for key in keys], axis=0)
    return fresh


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("doc_id").cast(pa.int64()))


def anchors(docs: DataFrame, text: str, length: int, seed: int) -> DataFrame:
    """`k` (anchor hash), `doc_id`, `at`: one row per anchor, those known to repeat spread out."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text):
            batch = batch.filter(batch.column("doc_id").is_valid())
            words = Words(batch.column(text))
            if len(words) < length:
                continue
            grams = chain(words.hashes(), seed)
            inside = words.windows(seed)[: len(grams)]
            grams[~inside] = U(2**64 - 1)
            spot = selected(grams, length - seed + 1)
            spot = spot[inside[spot]]
            owner = np.searchsorted(words.firsts, spot, side="right") - 1
            long = words.counts()[owner] >= length
            spot, owner = spot[long], owner[long]
            # An anchor that a text repeats is told once: `extensions` finds the others in the text.
            once = first_of_text(owner, grams[spot])
            spot, owner = spot[once], owner[once]
            ids = _ids(batch)[owner]
            place = (spot - words.firsts[owner]).astype(np.uint64) << U(1)
            key = grams[spot]
            order = np.lexsort((ids, key))
            first, shared = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
            fresh = _borders(key[order])
            group, begin = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
            sorted_ids = ids[order]
            last = np.append(begin[1:], len(key)) - 1
            shared[order] = (sorted_ids[begin] != sorted_ids[last])[group] if len(key) else shared
            first[order] = fresh
            place |= shared.astype(np.uint64)
            key = np.where(shared & ~first, _spread(place, ids), key)
            yield pa.RecordBatch.from_arrays([signed(key), pa.array(ids), signed(place)], names=["k", "doc_id", "at"])

    return docs.mapInArrow(find, "k bigint, doc_id bigint, at bigint")


def shared_anchors(docs: DataFrame, text: str, length: int, seed: int) -> DataFrame:
    """`doc_id`, `places`: the anchors of a document that another one has too."""
    one = Window.partitionBy("k")
    found = anchors(docs, text, length, seed).select(
        "doc_id",
        "at",
        (F.max(F.col("at").bitwiseAND(F.lit(1))).over(one) == 1).alias("settled"),
        (F.min("doc_id").over(one) < F.max("doc_id").over(one)).alias("met"),
    )
    kept = found.filter("settled or met").groupBy("doc_id")
    return kept.agg(F.collect_list(F.shiftrightunsigned("at", 1)).alias("places"))


def extensions(matched: DataFrame, text: str, length: int, seed: int) -> DataFrame:
    """`k`, `doc_id`, `at` of each window whose anchor is shared.

    A window that a smaller `doc_id` of the batch has as well is known to be a repeat.
    """

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps((x.filter(x.column("places").is_valid()) for x in batches), text):
            words = Words(batch.column(text))
            places = batch.column("places")
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(places)))
            word = np.asarray(places.flatten())
            inside = word + seed <= words.counts()[owner]
            owner, word = owner[inside], word[inside]
            hashes = words.hashes()
            whole = chain(hashes, length)
            if not len(word) or not len(whole):
                continue
            # A repeated window's own anchor, its least seed, is shared; the others are not tried.
            grams = chain(hashes, seed)
            shared = np.isin(grams, np.unique(grams[word + words.firsts[owner]]))
            least = sliding_least(grams, length - seed + 1)
            own = np.arange(len(least)) + (((least & U(63)).astype(np.int64) - np.arange(len(least))) & 63)
            start = np.flatnonzero(shared[own] & words.windows(length)[: len(own)])
            owner = np.searchsorted(words.firsts, start, side="right") - 1
            other = _second(hashes, length)
            # So is a window that a text repeats: the verdict holds for all of them.
            once = first_of_text(owner, whole[start], other[start])
            start, owner = start[once], owner[once]
            key, ids, other = whole[start], _ids(batch)[owner], other[start]
            place = (other << U(_WORD + 1)) | ((start - words.firsts[owner]).astype(np.uint64) << U(1))
            order = np.lexsort((ids, other, key))
            group = _borders(key[order], other[order])
            sorted_ids, known = ids[order], np.zeros(len(key), dtype=bool)
            known[order] = sorted_ids > sorted_ids[np.flatnonzero(group)][np.cumsum(group) - 1]
            place |= known.astype(np.uint64)
            key = np.where(known, _spread(place, ids), key)
            yield pa.RecordBatch.from_arrays([signed(key), pa.array(ids), signed(place)], names=["k", "doc_id", "at"])

    return matched.mapInArrow(extend, "k bigint, doc_id bigint, at bigint")


def _second(hashes: np.ndarray, length: int) -> np.ndarray:
    """16 bits of another hash of each window."""
    return chain(hashes, length, seed=1) >> U(48)


def repeated_windows(originals: DataFrame, dealt: DataFrame, text: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """`doc_id`, `starts`: windows of `length` words that also start in a smaller `doc_id`.

    Each entry has 16 bits of the window's second hash above the number of its first word.
    `dealt` has all rows, `originals` those that are no copies. Both go to Python with all their
    columns, so that they and the last join can read one exchange of the texts.
    """
    matched = dealt.join(shared_anchors(originals, text, length, seed), "doc_id", "left")
    met = extensions(matched, text, length, seed).repartition("k").withColumn("g", F.shiftrightunsigned("at", _WORD + 1))
    one = Window.partitionBy("k", "g")
    found = met.select("doc_id", "at", (F.min("doc_id").over(one) < F.col("doc_id")).alias("later"))
    kept = found.filter((F.col("at").bitwiseAND(F.lit(1)) == 1) | F.col("later")).groupBy("doc_id")
    return kept.agg(F.collect_list(F.shiftrightunsigned("at", 1)).alias("starts"))


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """`docs` with `n_words`, `n_removed`, `removed` and `kept_text`.

    Every word that a window of `length` words covers is removed if those words also start in a
    document with a smaller `doc_id`; windows are judged on the input. `removed` has the maximal
    runs of removed words (`start`, `end`, end excluded) and `kept_text` the other words joined
    by one space. Texts shorter than `length` words lose nothing; null texts have no words and
    an empty `kept_text`. Rows that share a `doc_id` do not remove each other's words: equal
    rows give equal results, different texts under one id are judged one by one. Rows with a
    null `doc_id` lose nothing and remove nothing. Columns of the same names are replaced.
    """
    names = ("n_words", "n_removed", "removed", "kept_text")
    rest = docs.drop(*names, "starts", "places", "copied", "later")
    # All joins with the texts read this one exchange.
    dealt = rest.filter("doc_id is not null").repartition("doc_id")
    marked = dealt.join(exact_copies(rest, text), "doc_id", "left").withColumn("later", holds("later", text))
    starts = repeated_windows(marked.filter("not later"), dealt, text, length, seed)
    joined = marked.join(starts, "doc_id", "left")
    # Rows without an id stay where they are read; apart, so that the joins share their exchange.
    alone = rest.filter("doc_id is null").withColumns({"later": F.lit(False), "starts": F.lit(None).cast("array<bigint>")})
    kept, out = rest.columns, "n_words bigint, n_removed bigint, removed array<struct<start:bigint,end:bigint>>, kept_text string"
    run = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text):
            words = Words(batch.column(text))
            places = batch.column("starts")
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(pc.fill_null(pc.list_value_length(places), 0)))
            flat = np.asarray(places.flatten()).view(np.uint64)
            begin = (flat & _NUMBER).astype(np.int64)
            # The second hash tells which of several texts under one id a window is of.
            inside = begin + length <= words.counts()[owner]
            begin = begin[inside] + words.firsts[owner[inside]]
            if len(begin):
                hashes = words.hashes()
                begin = alike_in_text(words, hashes, length, begin[_second(hashes, length)[begin] == flat[inside] >> U(_WORD)])
            cover = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + length, -1)
            copied = np.asarray(batch.column("later").cast(pa.int8())) > 0
            gone = (np.cumsum(cover)[:-1] > 0) | np.repeat(copied & (words.counts() >= length), words.counts())
            edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            # A run that crosses into the next text is two runs.
            inner = words.firsts[1:-1]
            inner = inner[(inner > 0) & (inner < len(words))]
            inner = np.unique(inner[gone[inner] & gone[inner - 1]]) if len(inner) else inner
            froms = np.sort(np.concatenate([np.flatnonzero(edge > 0), inner]))
            tos = np.sort(np.concatenate([np.flatnonzero(edge < 0), inner]))
            home = np.searchsorted(words.firsts, froms, side="right") - 1
            runs = pa.StructArray.from_arrays([pa.array(froms - words.firsts[home]), pa.array(tos - words.firsts[home])], names=["start", "end"])
            removed = pa.ListArray.from_arrays(pa.array(np.searchsorted(home, np.arange(batch.num_rows + 1)).astype(np.int32)), runs)
            lost = np.bincount(words.owners(), weights=gone, minlength=batch.num_rows).astype(np.int64)
            text_out = []
            for row in range(batch.num_rows):
                a, b = words.firsts[row], words.firsts[row + 1]
                own = words.data[words.offsets[row] : words.offsets[row + 1]].tobytes().split()
                text_out.append(b" ".join(own if not lost[row] else [w for w, g in zip(own, gone[a:b].tolist()) if not g]))
            made = [pa.array(words.counts()), pa.array(lost), removed.cast(run), pa.array(text_out, type=pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in kept), *made], names=[*kept, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), out])
    return joined.mapInArrow(cut, schema).unionAll(alone.mapInArrow(cut, schema))
