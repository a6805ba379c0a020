"""SentencePiece encoding and decoding by suffix-array matching (operator 2).

A batch of texts is encoded at once. Its texts fall apart at safe cuts - between two characters
that no piece of the model holds side by side, nothing can ever be joined - and equal parts
count once. The concatenated distinct parts are indexed by a suffix array (prefix doubling up to
the longest piece); every piece of the vocabulary is binary-searched in it, all pieces in step,
and its range of suffixes are its occurrences. They are the edges of the batch: sorted by
position and length they say at once which spans are pieces. On these edges the segmentation is
relaxed as the model asks:

* BPE: each part joins, of its neighbouring spans whose union is an edge, the one of the best
  score (the leftmost of equals), until none is left;
* unigram: the best path over the edges, position by position.

Characters that are no piece become the pieces of their UTF-8 bytes. Decoding looks up the bytes
of each piece and drops the space that encoding put in front.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.token_counts import parts, separable
from tidegauge.llm.words import U, mix, steps

MARK = 0x2581
BATCH_BYTES = 1 << 20
# Long texts are cut into parts of about this size where ids stay those of the whole text.
PART_BYTES = 1 << 16
# Longer parts are relaxed one by one, so that rounds over all parts stay few.
LONG_PART = 200
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6
_UNIGRAM, _BPE = 1, 2


@dataclass
class Pieces:
    """A model's vocabulary as arrays: code points per piece, lengths, ids, scores, bytes.

    `letters` numbers the characters of longer pieces; `together` tells which stand side by side.
    """

    processor: object
    kind: int
    codes: np.ndarray
    sizes: np.ndarray
    ids: np.ndarray
    rank: np.ndarray
    score: np.ndarray
    bytes_of: list[bytes]
    byte_ids: np.ndarray
    letters: np.ndarray
    together: np.ndarray
    blob: np.ndarray
    blob_at: np.ndarray
    dropped: np.ndarray
    prefix: bool


@lru_cache(maxsize=4)
def load(path: str) -> Pieces:
    """Read a model file. Models with user-defined or unused pieces or without byte fallback are refused."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    kind = model.trainer_spec.model_type
    types = np.array([p.type for p in model.pieces])
    if kind not in (_UNIGRAM, _BPE) or np.isin(types, (4, 5)).any() or (types == _BYTE).sum() != 256:
        raise ValueError("BPE and unigram models with byte fallback and without user-defined or unused pieces are supported")
    ids = np.flatnonzero(types == _NORMAL)
    texts = [model.pieces[i].piece for i in ids]
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    codes = np.zeros((len(ids), sizes.max()), dtype=np.uint32)
    for row, text in enumerate(texts):
        codes[row, : len(text)] = [ord(c) for c in text]
    score = np.array([model.pieces[i].score for i in ids], dtype=np.float64)
    rank = np.unique(-score, return_inverse=True)[1].astype(np.int64)
    left, right = codes[:, :-1].astype(np.uint64), codes[:, 1:].astype(np.uint64)
    pairs = np.unique((left << U(32) | right)[(left > 0) & (right > 0)])
    first, second = (pairs >> U(32)).astype(np.int64), (pairs & U(0xFFFFFFFF)).astype(np.int64)
    known = np.unique(np.concatenate([first, second]))
    letters = np.zeros(0x110000, dtype=np.int32)
    letters[known] = np.arange(1, len(known) + 1)
    together = np.zeros((len(known) + 1, len(known) + 1), dtype=bool)
    together[letters[first], letters[second]] = True
    bytes_of = []
    for piece in model.pieces:
        if piece.type == _BYTE:
            bytes_of.append(bytes([int(piece.piece[3:5], 16)]))
        elif piece.type == _NORMAL:
            bytes_of.append(piece.piece.replace(chr(MARK), " ").encode())
        else:
            bytes_of.append(" ⁇ ".encode() if piece.type == _UNKNOWN else b"")
    byte_ids = np.zeros(256, dtype=np.int32)
    for i in np.flatnonzero(types == _BYTE):
        byte_ids[int(model.pieces[i].piece[3:5], 16)] = i
    blob_at = np.concatenate([[0], np.cumsum([len(x) for x in bytes_of])])
    blob = np.frombuffer(b"".join(bytes_of), dtype=np.uint8)
    starts_marked = np.array([p.type == _NORMAL and p.piece.startswith(chr(MARK)) for p in model.pieces])
    return Pieces(processor, kind, codes, sizes, ids.astype(np.int32), rank, score, bytes_of, byte_ids, letters, together, blob, blob_at, starts_marked, model.normalizer_spec.add_dummy_prefix)


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of `codes` in the order of their first `depth` values (or more)."""
    seen = np.bincount(codes)
    letter = np.cumsum(seen > 0)[codes].astype(np.uint64)
    bits = int(letter.max()).bit_length()
    # The first key has as many letters as fit a number; ranks of it are doubled from there.
    reach = min(63 // bits, depth)
    key = np.zeros(len(codes), dtype=np.uint64)
    for step in range(reach):
        key <<= U(bits)
        key[: len(codes) - step] |= letter[step:]
    order = np.argsort(key)
    while reach < depth:
        fresh = np.ones(len(key), dtype=np.uint64)
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty_like(key)
        rank[order] = np.cumsum(fresh)
        key = rank << U(32)
        key[:-reach] |= rank[reach:]
        order = np.argsort(key)
        reach *= 2
    return order


def occurrences(codes: np.ndarray, order: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The range of `order` whose suffixes begin with each piece: two binary searches in step."""
    padded = np.concatenate([codes, np.zeros(pieces.codes.shape[1], dtype=codes.dtype)])
    found = []
    for upper in (False, True):
        low, high = np.zeros(len(pieces.ids), dtype=np.int64), np.full(len(pieces.ids), len(order), dtype=np.int64)
        while True:
            active = np.flatnonzero(low < high)
            if not len(active):
                break
            middle = (low[active] + high[active]) // 2
            at = order[middle]
            # -1, 0, 1: the suffix is before, begins with, or is after the piece.
            side = np.zeros(len(active), dtype=np.int8)
            rows = np.arange(len(active))
            for step in range(pieces.codes.shape[1]):
                rows = rows[(side[rows] == 0) & (pieces.sizes[active[rows]] > step)]
                if not len(rows):
                    break
                have, want = padded[at[rows] + step], pieces.codes[active[rows], step]
                side[rows] = (have > want).astype(np.int8) - (have < want)
            below = side < 0 if not upper else side <= 0
            low[active[below]] = middle[below] + 1
            high[active[~below]] = middle[~below]
        found.append(low)
    return found[0], found[1]


def edge_table(codes: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Piece (its row plus one) of each span, by start and length less one; 0 where none is."""
    table = np.zeros((len(codes), pieces.codes.shape[1]), dtype=np.int32)
    low, high = occurrences(codes, order := suffix_order(codes, pieces.codes.shape[1]), pieces)
    count = high - low
    piece = np.repeat(np.arange(len(count)), count)
    spot = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    table[order[spot], pieces.sizes[piece] - 1] = piece + 1
    return table


def _join_long(first: int, last: int, edges: np.ndarray, pieces: Pieces) -> tuple[list[int], list[int]]:
    """Borders of one long part's BPE symbols, with a heap instead of rounds."""
    widest = edges.shape[1]
    ends = {at: at + 1 for at in range(first, last)}
    before = {at: at - 1 for at in range(first, last)}
    heap: list[tuple[int, int, int, int]] = []

    def offer(a: int) -> None:
        b = ends[a]
        if b < last and ends[b] - a <= widest and (piece := edges[a, ends[b] - a - 1]):
            heapq.heappush(heap, (int(pieces.rank[piece - 1]), a, b, ends[b]))

    for at in range(first, last):
        offer(at)
    while heap:
        _, a, b, end = heapq.heappop(heap)
        if ends.get(a) != b or ends.get(b) != end:
            continue
        ends[a] = end
        del ends[b], before[b]
        if end < last:
            before[end] = a
            offer(a)
        if a > first:
            offer(before[a])
    return list(ends.keys()), list(ends.values())


def _join(part_at: np.ndarray, edges: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the BPE symbols of all parts: one join per part and round."""
    total, widest = int(part_at[-1]), edges.shape[1]
    sizes = np.diff(part_at)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    quick = sizes <= LONG_PART
    start = np.flatnonzero(quick[owner])
    end = start + 1
    part = owner[start]
    done_start, done_end = [], []
    none = np.int64(2**62)
    while len(start):
        key = np.full(len(start), none)
        span = end[1:] - start[:-1]
        pair = np.flatnonzero((part[1:] == part[:-1]) & (span <= widest))
        piece = edges[start[pair], span[pair] - 1]
        hit = piece > 0
        key[pair[hit]] = pieces.rank[piece[hit] - 1] << 32 | start[pair[hit]]
        first = np.flatnonzero(np.diff(part, prepend=-1))
        best = np.minimum.reduceat(key, first)
        group = np.repeat(np.arange(len(first)), np.diff([*first, len(start)]))
        over = best[group] == none
        done_start.append(start[over])
        done_end.append(end[over])
        chosen = np.flatnonzero((key == best[group]) & ~over)
        end[chosen] = end[chosen + 1]
        keep = ~over
        keep[chosen + 1] = False
        start, end, part = start[keep], end[keep], part[keep]
    for row in np.flatnonzero(~quick):
        a, b = _join_long(int(part_at[row]), int(part_at[row + 1]), edges, pieces)
        done_start.append(np.array(a))
        done_end.append(np.array(b))
    start = np.concatenate([*done_start, np.zeros(0, dtype=np.int64)]).astype(np.int64)
    end = np.concatenate([*done_end, np.zeros(0, dtype=np.int64)]).astype(np.int64)
    order = np.argsort(start)
    assert not total or (start[order[0]] == 0 and (end[order[:-1]] == start[order[1:]]).all())
    return start[order], end[order]


def _best_path(part_at: np.ndarray, edges: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the unigram symbols: relax all edges, all parts one position at a time.

    A character that is no piece has an edge of the least score less 10.
    """
    sizes, widest = np.diff(part_at), edges.shape[1]
    best = np.full(int(part_at[-1]) + 1, -np.inf)
    back = np.zeros(int(part_at[-1]) + 1, dtype=np.int64)
    unknown = pieces.score.min() - 10
    # `best[p]` is of the cut before p + 1 within a part; the cut before a part is worth 0.
    by_size = np.argsort(-sizes, kind="stable")
    live = len(by_size)
    for step in range(1, int(sizes.max(initial=0)) + 1):
        while live and sizes[by_size[live - 1]] < step:
            live -= 1
        base = part_at[by_size[:live]]
        top, origin = np.full(live, -np.inf), np.zeros(live, dtype=np.int64)
        for width in range(1, min(step, widest) + 1):
            at = base + step - width
            piece = edges[at, width - 1]
            gain = np.where(piece > 0, pieces.score[np.maximum(piece, 1) - 1], unknown if width == 1 else -np.inf)
            value = gain + (best[at - 1] if step > width else 0.0)
            better = value > top
            top[better], origin[better] = value[better], at[better]
        best[base + step - 1], back[base + step - 1] = top, origin
    starts, ends = [], []
    for row in range(len(sizes)):
        at = int(part_at[row + 1])
        while at > part_at[row]:
            starts.append(int(back[at - 1]))
            ends.append(at)
            at = starts[-1]
    order = np.argsort(starts)
    return np.array(starts, dtype=np.int64)[order], np.array(ends, dtype=np.int64)[order]


def _ids(codes: np.ndarray, start: np.ndarray, end: np.ndarray, edges: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the symbols and how many each has: one, or those of its bytes."""
    piece = edges[start, end - start - 1]
    count = np.ones(len(start), dtype=np.int64)
    odd = np.flatnonzero(piece == 0)
    spelled = {int(c): pieces.byte_ids[list(chr(c).encode("utf-8", "replace"))] for c in np.unique(codes[start[odd]])}
    count[odd] = [len(spelled[int(c)]) for c in codes[start[odd]]]
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(at[-1]), dtype=np.int32)
    plain = np.flatnonzero(piece > 0)
    out[at[plain]] = pieces.ids[piece[plain] - 1]
    for row in odd:
        out[at[row] : at[row + 1]] = spelled[int(codes[start[row]])]
    return out, count


def encode(texts: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and the borders of each text's ids."""
    if not texts:
        return np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
    normal = pieces.processor.normalize(texts)
    codes = np.frombuffer("".join(normal).encode("utf-32-le", "replace"), dtype=np.uint32)
    text_at = np.concatenate([[0], np.cumsum([len(x) for x in normal])]).astype(np.int64)
    if not len(codes):
        return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
    # Parts between safe cuts, and the distinct ones among them.
    letter = pieces.letters[codes]
    cut = np.ones(len(codes), dtype=bool)
    cut[1:] = ~pieces.together[letter[:-1], letter[1:]]
    cut[text_at[:-1][text_at[:-1] < len(codes)]] = True
    begin = np.flatnonzero(cut)
    size = np.diff(np.append(begin, len(codes)))
    place = np.arange(len(codes)) - np.repeat(begin, size)
    sums = np.add.reduceat(mix(codes.astype(np.uint64) + (place.astype(np.uint64) << U(32))), begin)
    sums = mix(sums ^ size.astype(np.uint64))
    order = np.argsort(sums)
    fresh = np.ones(len(sums), dtype=bool)
    fresh[1:] = sums[order[1:]] != sums[order[:-1]]
    lead, same = order[fresh], np.empty(len(sums), dtype=np.int64)
    same[order] = np.cumsum(fresh) - 1
    if (size[lead][same] != size).any() or (codes[np.repeat(begin[lead][same], size) + place] != codes).any():
        lead, same = np.arange(len(begin)), np.arange(len(begin))  # two parts share a hash
    parts, part_size = begin[lead], size[lead]
    # The distinct parts, a separator after each for the index, but borders without it.
    spaced = np.concatenate([[0], np.cumsum(part_size + 1)])
    held = np.zeros(int(spaced[-1]), dtype=np.uint32)
    target = np.repeat(spaced[:-1] - np.concatenate([[0], np.cumsum(part_size)[:-1]]), part_size) + np.arange(part_size.sum())
    held[target] = codes[np.repeat(parts - np.concatenate([[0], np.cumsum(part_size)[:-1]]), part_size) + np.arange(part_size.sum())]
    del normal, letter, cut, place, sums, order, fresh
    edges = edge_table(held, pieces)[target]
    packed, part_at = held[target], np.concatenate([[0], np.cumsum(part_size)])
    start, end = (_join if pieces.kind == _BPE else _best_path)(part_at, edges, pieces)
    flat, count = _ids(packed, start, end, edges, pieces)
    symbol_at = np.concatenate([[0], np.cumsum(count)])
    part_ids = symbol_at[np.searchsorted(start, part_at)]
    # Put the parts' ids back in the order of the texts.
    length = np.diff(part_ids)[same]
    out_at = np.concatenate([[0], np.cumsum(length)])
    gather = np.repeat(part_ids[:-1][same] - out_at[:-1], length) + np.arange(int(out_at[-1]))
    return flat[gather], out_at[np.searchsorted(begin, text_at)]


def decode(ids: np.ndarray, borders: np.ndarray, pieces: Pieces) -> list[str]:
    """Texts of id sequences; ids outside the vocabulary raise IndexError."""
    size = np.diff(pieces.blob_at)[ids]
    at = np.concatenate([[0], np.cumsum(size)])
    data = pieces.blob[np.repeat(pieces.blob_at[ids] - at[:-1], size) + np.arange(int(at[-1]))].tobytes()
    out = []
    for first, last in zip(borders[:-1].tolist(), borders[1:].tolist()):
        skip = int(pieces.prefix and last > first and pieces.dropped[ids[first]])
        out.append(data[at[first] + skip : at[last]].decode("utf-8", "replace"))
    return out


def encode_long(text: str, pieces: Pieces, batch_bytes: int, part_bytes: int) -> tuple[np.ndarray, bool]:
    """Ids of one text, encoded some parts at a time, and whether they decode to it.

    Parts end at spaces over which nothing joins (`token_counts`): the mark that encoding puts in
    front of a part stands for the space that the cut took, so the parts' ids are those of the text.
    """
    found, same, held, size = [], True, [], 0
    cuts = parts(text.encode("utf-8", "replace"), part_bytes)
    for number, part in enumerate(cuts, 1):
        held.append(part.decode("utf-8", "replace"))
        size += len(part)
        if size >= batch_bytes or number == len(cuts):
            ids, borders = encode(held, pieces)
            found.append(ids)
            same = same and decode(ids, borders, pieces) == held
            held, size = [], 0
    return np.concatenate(found), same


def encode_texts(
    docs: DataFrame, path: str, text: str = "text", check: bool = True, batch_bytes: int = BATCH_BYTES, part_bytes: int = PART_BYTES
) -> DataFrame:
    """`docs` with `ids`, `n_tokens` and, with `check`, `round_trip`.

    `ids` are those of the library's own encoder for the whole text, without begin or end
    tokens. `round_trip` tells whether decoding them gives the text back (a text that holds the
    model's own space mark, or that the model normalises, does not come back). Null and empty
    texts have no ids and, as an empty text, round_trip. Repeated rows each keep theirs; an empty
    table stays empty; columns of the same names are replaced. `path` is a file every executor has.
    A text longer than `batch_bytes` is encoded in parts of about `part_bytes`, so its length does
    not set the memory of a task; a text without safe places to cut, or a model that has none, is
    encoded whole.
    """
    names = ["ids", "n_tokens"] + ["round_trip"] * check
    rest = docs.drop(*names)
    kept = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        cuttable = separable(path)
        for batch in steps(batches, text, batch_bytes):
            texts = ["" if x is None else x for x in batch.column(text).to_pylist()]
            if cuttable and len(texts) == 1 and len(texts[0]) > batch_bytes:
                ids, same = encode_long(texts[0], pieces, batch_bytes, part_bytes)
                borders, whole = np.array([0, len(ids)]), [same]
            else:
                ids, borders = encode(texts, pieces)
                whole = [a == b for a, b in zip(decode(ids, borders, pieces), texts)] if check else []
            lists = pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(ids))
            made = [lists, pa.array(np.diff(borders))]
            if check:
                made.append(pa.array(whole, type=pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in kept), *made], names=[*kept, *names])

    out = ["ids array<int>", "n_tokens bigint"] + ["round_trip boolean"] * check
    return rest.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), *out]))


def decode_ids(table: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """`table` with `decoded`, the text of each id list; null lists decode to null."""
    rest = table.drop("decoded")
    kept = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in batches:
            lists = batch.column(ids)
            sizes = [0 if x is None else x for x in pc.list_value_length(lists).to_pylist()]
            texts = decode(np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), pieces)
            made = pa.array([t if valid else None for t, valid in zip(texts, lists.is_valid().to_pylist())], type=pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in kept), made], names=[*kept, "decoded"])

    return rest.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), "decoded string"]))
