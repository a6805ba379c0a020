"""Words, hashes and anchors of text batches, as vectorised numpy steps inside Spark tasks.

A word is `[^\\x20\\x09-\\x0D]+` of the UTF-8 bytes. Hashes have 64 bits and are well mixed;
operators that must not confuse two sequences use a second hash beside them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# ASCII punctuation.
MARKS = np.zeros(256, dtype=bool)
MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True

U = np.uint64
M1, M2, M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], dtype=np.uint64)
_LONG_WORD = 256

# Bytes of text that one numpy step works on; more only for a single longer text.
STEP_BYTES = 4 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    h = (h ^ (h >> U(30))) * M2
    h = (h ^ (h >> U(27))) * M3
    return h ^ (h >> U(31))


class Words:
    """Words of some texts: bytes, word borders, and the first word of each text."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        texts = texts.fill_null(b"") if texts.null_count else texts
        _, at, data = texts.buffers()
        at = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        size = int(at[-1] - at[0]) if len(at) else 0
        self.data = np.zeros(size + 8, dtype=np.uint8)
        if size:
            self.data[:size] = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]
        if lower:
            self.data = LOWER[self.data]
        self.offsets = at - at[0] if len(at) else np.zeros(1, dtype=np.int64)
        solid = ~SPACE[self.data[:size]]
        border = np.zeros(size + 1, dtype=bool)
        border[self.offsets] = True
        before = np.concatenate([[False], solid[:-1]]) if size else solid
        after = np.concatenate([solid[1:], [False]]) if size else solid
        self.starts = np.flatnonzero(solid & (~before | border[:-1]))
        self.ends = np.flatnonzero(solid & (~after | border[1:])) + 1
        self.firsts = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(self.firsts)

    def owners(self) -> np.ndarray:
        """The text of each word, as its index."""
        return np.repeat(np.arange(len(self.firsts) - 1), self.counts())

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A hash of each word, or of its first `most` bytes."""
        sizes = self.ends - self.starts
        if most is not None:
            sizes = np.minimum(sizes, most)
        lanes = np.ndarray((len(self.data) - 7,), dtype="<u8", buffer=self.data, strides=(1,))
        out = sizes.astype(np.uint64) * M1 + U(0x5851F42D4C957F2D)
        rows, lane = np.flatnonzero(sizes <= _LONG_WORD), 0
        while rows.size:
            left = sizes[rows] - 8 * lane
            part = lanes[self.starts[rows] + 8 * lane] & _MASK[np.minimum(left, 8)]
            out[rows] = mix(out[rows] ^ (part * M1 + U(lane)))
            rows, lane = rows[left > 8], lane + 1
        view = memoryview(self.data)
        for row in np.flatnonzero(sizes > _LONG_WORD):
            out[row] = xxhash.xxh64_intdigest(view[self.starts[row] : self.starts[row] + sizes[row]], 7)
        return out

    def trim(self, marks: np.ndarray, most: int = 3) -> None:
        """Take up to `most` bytes of kind `marks` off either end; at least one byte stays."""
        for _ in range(most):
            self.starts = self.starts + ((self.ends - self.starts > 1) & marks[self.data[self.starts]])
            self.ends = self.ends - ((self.ends - self.starts > 1) & marks[self.data[self.ends - 1]])

    def windows(self, size: int) -> np.ndarray:
        """For each word, whether `size` words from it on lie in its own text."""
        last = np.repeat(self.firsts[1:], self.counts())
        return np.arange(len(self)) + size <= last


def chain(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of `size` neighbours; shorter than `hashes` by `size - 1`."""
    count = max(len(hashes) - size + 1, 0)
    out = np.full(count, (seed * int(M1) + size) & (2**64 - 1), dtype=np.uint64)
    for step in range(size):
        out ^= hashes[step : step + count]
        out *= M2
        out ^= out >> U(29)
    return mix(out)


def first_of_text(owners: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """The first row of each text and key, in the order of the rows."""
    order = np.lexsort((np.arange(len(owners)), *keys, owners))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = np.any([key[order][1:] != key[order][:-1] for key in (owners, *keys)], axis=0)
    return np.sort(order[fresh])


def alike_in_text(words: Words, hashes: np.ndarray, size: int, starts: np.ndarray) -> np.ndarray:
    """All starts of runs of `size` words that equal one of those at `starts` within the same text."""
    if not len(starts):
        return starts
    whole = chain(hashes, size)
    own = whole ^ mix(words.owners()[: len(whole)].astype(np.uint64) + U(1))
    inside = words.windows(size)[: len(whole)]
    return np.flatnonzero(np.isin(own, np.unique(own[starts])) & inside)


def sliding_least(hashes: np.ndarray, width: int) -> np.ndarray:
    """The least of any `width` (64 at most) neighbours; its low 6 bits tell the place modulo 64."""
    if len(hashes) < width:
        return np.zeros(0, dtype=np.uint64)
    least = (hashes & ~U(63)) | (np.arange(len(hashes), dtype=np.uint64) & U(63))
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        least = np.minimum(least[: len(least) - step], least[step:])
        reach += step
    return least


def selected(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the least hash of any `width` (64 at most) neighbouring ones.

    Whether a value is selected depends on the content around it alone: two texts that share
    `width` values select an equal value in them. Of equal values in a window any may stand.
    """
    least = sliding_least(hashes, width)
    base = np.arange(len(least), dtype=np.int64)
    return np.unique(base + (((least & U(63)).astype(np.int64) - base) & 63))


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in slices of about `size` bytes of `column`."""
    for batch in batches:
        held = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        slot = np.cumsum(held) // size
        edges = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            if end > start:
                yield batch.slice(start, end - start)


def signed(values: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's signed long."""
    return pa.array(values.view(np.int64))
