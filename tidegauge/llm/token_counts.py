"""Token counts of whole texts with a SentencePiece model (operator 3).

Only lengths leave the Arrow function. Texts are packed into batches of bounded bytes; a long
text is split into parts whose counts add up to its own.

Why parts add up: the model turns each space into the mark that starts a word and puts one such
mark before the text. No piece of the model holds a mark after another character, so nothing is
merged across "letter, space, letter". A cut there drops that one space, and the mark that the
next part gets in front stands for it. This needs a model without its own normalisation of
letters that keeps runs of spaces; `cut_points` returns none otherwise, and texts stay whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
BATCH_BYTES = 1 << 20
PART_BYTES = 1 << 16

LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


@lru_cache(maxsize=4)
def processor(path: str):
    """The model of a file, loaded once per worker."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def separable(path: str) -> bool:
    """Whether counts add up over cuts at a space between two ASCII letters or digits."""
    model = processor(path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    if any(MARK in piece.lstrip(MARK) for piece in pieces):
        return False
    probe = "a  b Aﬁ é"
    return model.normalize(probe) == MARK + probe.replace(" ", MARK)


def cut_points(text: bytes, size: int) -> list[int]:
    """Positions of spaces, at least `size` bytes apart, at which `text` may be cut."""
    data = np.frombuffer(text, dtype=np.uint8)
    safe = np.flatnonzero((data[1:-1] == 32) & LETTER[data[:-2]] & LETTER[data[2:]]) + 1
    cuts, last = [], 0
    while True:
        at = np.searchsorted(safe, last + size)
        if at >= len(safe):
            return cuts
        cuts.append(last := int(safe[at]))


def parts(text: bytes, size: int) -> list[bytes]:
    """`text` without the spaces at its cuts, as one piece per part."""
    if len(text) <= size + 2:
        return [text]
    edges = [-1, *cut_points(text, size), len(text)]
    return [text[a + 1 : b] for a, b in zip(edges, edges[1:])]


def lengths(path: str, texts: list[bytes], batch_bytes: int = BATCH_BYTES, part_bytes: int = PART_BYTES) -> np.ndarray:
    """The number of tokens of each text."""
    model = processor(path)
    split = separable(path)
    counts = np.zeros(len(texts), dtype=np.int64)
    queue: list[str] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        if queue:
            np.add.at(counts, owners, [len(ids) for ids in model.encode(queue, num_threads=1)])
        queue.clear()
        owners.clear()

    for row, text in enumerate(texts):
        for part in parts(text, part_bytes) if split else [text]:
            queue.append(part.decode("utf-8", "replace"))
            owners.append(row)
            held += len(part)
            if held >= batch_bytes:
                flush()
                held = 0
    flush()
    return counts


def token_count(text: Column, path: str, batch_bytes: int = BATCH_BYTES, part_bytes: int = PART_BYTES) -> Column:
    """Tokens of `text` without begin, end or other added tokens; 0 for null and empty texts.

    `path` names the model file, which every executor must have. Nothing is truncated or padded.
    """

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [b"" if x is None else x for x in batch.cast(pa.binary() if pa.types.is_string(batch.type) else pa.large_binary()).to_pylist()]
            yield pa.array(lengths(path, texts, batch_bytes, part_bytes), type=pa.int64())

    return count(text)


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """`docs` with `n_bytes` (UTF-8), `n_tokens` and `over_limit` of each whole text.

    One pass without a shuffle: rows stay where Spark read them, in splits of equal bytes. Null
    and empty texts count 0; repeated rows each keep their row; an empty table stays empty;
    other columns stay, but one named like a result is replaced.
    """
    return (
        docs.withColumn("n_bytes", F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long"))
        .withColumn("n_tokens", token_count(F.col(text), path))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
