"""Katz backoff language model of words and its scores of whole texts (operator 4).

P(w | v) = d(c) c(v w) / c(v) for word sequences seen in training, and alpha(v) P(w) for others,
recursively down to single words. d(c) are Good-Turing discounts for counts up to 5 (Katz's
formula); alpha(v) spreads exactly what is left of 1 over what was not seen after v, so every
context's probabilities add up to 1. At the end of the recursion all unknown words share one
class, whose probability is what discounting the single words left. A context without discounted
counts has one more in its denominator, which keeps something for the unseen.

How it runs. Texts are dealt once into batches of bounded bytes, by hash. A batch sends the
distinct n-grams of its texts, with their training counts, to the partitioned count tables:
partition = leading bits of the context's hash, so that a context's sums meet in one place. The
tables count over all batches and answer each with counts in the order it asked, and with what
the contexts' alphas need. Only distinct n-grams travel, as packed arrays, never tokens with their
documents. The tables of longer n-grams need the lower order's probabilities, which a batch knows
by then. All rounds read the texts from the one exchange that dealt them.

A context with a very high count is cut into parts by its next word, each a context of its own in
the tables; a batch adds the parts up. Words and contexts are 64-bit hashes, a next word within
its context 48 bits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.words import M1, U, Words, mix

ORDER = 2
DISCOUNTED = 5
BATCH_BYTES = 12 << 20
# Training tokens of a context from which on it is cut into parts.
PART_TOKENS = 1 << 20
_END, _START = U(0x1F83D9ABFB41BD6B), U(0x5BE0CD19137E2179)
_REQUEST = "batch int, bucket int, ctx binary, per binary, key binary, seen binary, code binary, lower binary"
_REPLY = "batch int, n int, bucket int, seen binary, few binary, mass binary, stats binary"


def discounts(stats: np.ndarray) -> np.ndarray:
    """d(0..k + 1) from count-of-counts n_1..n_(k+1); the last is that of all higher counts, 1.

    Good-Turing over the largest k whose discounts lie in (0, 1]; without one, absolute
    discounting by n_1 / (n_1 + 2 n_2) of the same counts, or by one half if no count is 1.
    """
    most = len(stats) - 1
    out = np.ones(most + 2)
    for k in range(most, 0, -1):
        n = stats[: k + 1].astype(np.float64)
        if (n <= 0).any():
            continue
        common = (k + 1) * n[k] / n[0]
        if common >= 1:
            continue
        r = np.arange(1, k + 1)
        d = ((r + 1) * n[1:] / (r * n[:-1]) - common) / (1 - common)
        if ((d > 0) & (d <= 1)).all() and d[0] < 1:
            out[1 : k + 1] = d
            return out
    step = stats[0] / (stats[0] + 2 * stats[1]) if stats[0] > 0 else 0.5
    step = min(step, 0.9)
    out[1 : most + 1] = 1 - step / np.arange(1, most + 1)
    return out


def _factor(discount: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return discount[np.minimum(counts, len(discount) - 1)]


def _pack(values: np.ndarray) -> bytes:
    """An array as compressed bytes; whole numbers in as few bytes as they need."""
    if values.dtype.kind == "i":
        most = int(values.max(initial=0))
        values = values.astype(next(kind for kind in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(kind).max))
    return values.dtype.str[1:].encode() + zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    values = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[2:]), dtype=blob[:2].decode())
    return values.astype(np.int64) if values.dtype.itemsize < 8 else values


@dataclass
class Tokens:
    """Tokens of a batch's texts, each text's end included: word numbers, owners, training rows."""

    words: np.ndarray
    word: np.ndarray
    owner: np.ndarray
    first: np.ndarray
    train: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Tokens:
        texts = table["text"].combine_chunks()
        texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
        found = Words(texts, lower=True)
        rows, owners = len(found.firsts) - 1, found.owners()
        size = len(found) + rows
        hashes, owner = np.full(size, _END), np.zeros(size, dtype=np.int64)
        at = np.arange(len(found)) + owners
        hashes[at] = found.hashes()
        owner[at] = owners
        owner[found.firsts[1:] + np.arange(rows)] = np.arange(rows)
        words, word = np.unique(hashes, return_inverse=True)
        return cls(words, word, owner, found.firsts[:-1] + np.arange(rows), np.asarray(table["train"].combine_chunks().cast(pa.int8())) > 0)

    def contexts(self, n: int) -> np.ndarray:
        """A hash of the n - 1 tokens before each token; texts begin with start marks."""
        hashes = self.words[self.word]
        place = np.arange(len(hashes)) - self.first[self.owner]
        out = np.zeros(len(hashes), dtype=np.uint64)
        for back in range(n - 1, 0, -1):
            before = np.where(place >= back, np.roll(hashes, back), _START)
            out = mix(out * M1 + before)
        return out


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def _narrow(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _wide(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :6] = raw
    return out.reshape(-1).view("<u8").astype(np.uint64)


@dataclass
class Grams:
    """The distinct n-grams of a batch as it asks for them, ordered by context and next word."""

    contexts: np.ndarray
    per: np.ndarray
    key: np.ndarray
    seen: np.ndarray
    lower: np.ndarray
    gram: np.ndarray
    whole: np.ndarray
    whole_of: np.ndarray

    @classmethod
    def of(cls, tokens: Tokens, n: int, held: np.ndarray, lower: np.ndarray, part_tokens: int) -> Grams:
        """`held`: training count of each token's context; `lower`: its probability one order down."""
        if n == 1:
            contexts, context = np.zeros(0, dtype=np.uint64), None
            seen = np.bincount(tokens.word, weights=tokens.train[tokens.owner], minlength=len(tokens.words))
            return cls(contexts, contexts, tokens.words, seen.astype(np.int64), contexts, tokens.word, contexts, contexts)
        whole, first, whole_inv = np.unique(tokens.contexts(n), return_index=True, return_inverse=True)
        parts = 1 + held[first] // part_tokens
        small = mix(tokens.words) >> U(16)
        part = small[tokens.word] % parts[whole_inv].astype(np.uint64)
        split = np.flatnonzero(parts > 1)
        asked = np.where(parts[whole_inv] > 1, mix(whole[whole_inv] + (part + U(1)) * M1), whole[whole_inv])
        number = np.repeat(split, parts[split])
        step = np.arange(len(number)) - np.repeat(np.cumsum(parts[split]) - parts[split], parts[split])
        every = mix(whole[number] + (step.astype(np.uint64) + U(1)) * M1)
        contexts, inverse = np.unique(np.concatenate([asked, every]), return_inverse=True)
        of = np.zeros(len(contexts), dtype=np.int64)
        of[inverse[: len(asked)]] = whole_inv
        of[inverse[len(asked) :]] = number
        pair = inverse[: len(asked)] * len(tokens.words) + tokens.word
        pairs, spot, gram = np.unique(pair, return_index=True, return_inverse=True)
        seen = np.bincount(gram, weights=tokens.train[tokens.owner], minlength=len(pairs)).astype(np.int64)
        per = np.bincount(pairs // len(tokens.words), minlength=len(contexts)) if len(pairs) else np.zeros(len(contexts), dtype=np.int64)
        return cls(contexts, per, small[pairs % len(tokens.words)], seen, lower[spot], gram, whole_inv, of)

    def requests(self, batch: int, n: int, buckets: int) -> pa.Table:
        """One row per bucket, empty ones included: every bucket answers with its statistics."""
        lead = self.key if n == 1 else self.contexts
        edges = np.searchsorted(_bucket(lead, buckets), np.arange(buckets + 1))
        at = np.concatenate([[0], np.cumsum(self.per)]).astype(np.int64)
        rows = []
        for bucket in range(buckets):
            a, b = edges[bucket], edges[bucket + 1]
            x, y = (a, b) if n == 1 else (at[a], at[b])
            key, lower, code = self.key[x:y], np.zeros(0), np.zeros(0, dtype=np.int64)
            if n > 1:  # next words, with what is known of them, once per row
                mark = mix(key ^ mix(self.lower[x:y].view(np.uint64)))
                _, spot, code = np.unique(mark, return_index=True, return_inverse=True)
                key, lower = key[spot], self.lower[x:y][spot]
            rows.append((batch, bucket, self.contexts[a:b].tobytes(), _pack(self.per[a:b]), key.tobytes() if n == 1 else _narrow(key), _pack(self.seen[x:y]), _pack(code), _pack(lower)))
        names = [part.split()[0] for part in _REQUEST.split(", ")]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
        return pa.table({name: pa.array(column, type=kind) for name, column, kind in zip(names, zip(*rows), kinds)})


def _serve(n: int) -> Callable[[pa.Table], pa.Table]:
    """Count the n-grams that all batches sent to one bucket and answer each batch."""

    def serve(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        names = [part.split()[0] for part in _REPLY.split(", ")]
        codes = [_unpack(r["code"]) for r in rows]
        keys = [np.frombuffer(r["key"], dtype=np.uint64) if n == 1 else _wide(r["key"])[code] for r, code in zip(rows, codes)]
        seen = np.concatenate([_unpack(r["seen"]) for r in rows]).astype(np.int64)
        edges = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        key = np.concatenate(keys)
        if n > 1:
            contexts = [np.frombuffer(r["ctx"], dtype=np.uint64) for r in rows]
            pers = [_unpack(r["per"]) for r in rows]
            known, number = np.unique(np.concatenate(contexts), return_inverse=True)
            context_edges = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
            of = np.repeat(number, np.concatenate(pers).astype(np.int64))
            key = mix(mix(key + U(1)) ^ known[of]) if len(key) else key
            lower = np.concatenate([_unpack(r["lower"])[code] for r, code in zip(rows, codes)])
        _, spot, gram = np.unique(key, return_index=True, return_inverse=True)
        count = np.bincount(gram, weights=seen, minlength=len(spot)).astype(np.int64)
        stats = np.array([(count == r).sum() for r in range(1, DISCOUNTED + 2)] + [(count > 0).sum(), count.sum()], dtype=np.int64)
        if n > 1:
            real = count > 0
            home = of[spot]
            mass = np.bincount(home[real], weights=lower[spot][real], minlength=len(known))
            few = np.stack([np.bincount(home[count == r], minlength=len(known)) for r in range(1, DISCOUNTED + 1)], axis=1).astype(np.int32)
        out = []
        for i, r in enumerate(rows):
            answer = [r["batch"], n, r["bucket"], _pack(count[gram[edges[i] : edges[i + 1]]])]
            if n > 1:
                mine = number[context_edges[i] : context_edges[i + 1]]
                answer += [_pack(few[mine].T.ravel().astype(np.int64)), _pack(mass[mine])]
            else:
                answer += [b"", b""]
            out.append((*answer, stats.tobytes()))
        kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.table({name: pa.array(column, type=kind) for name, column, kind in zip(names, zip(*out), kinds)})

    return serve


@dataclass
class State:
    """What a batch knows of each token after some orders."""

    tokens: Tokens
    probability: np.ndarray
    known: np.ndarray
    base: np.ndarray
    total: int
    seen: np.ndarray
    starts: int


def _replies(table: pa.Table, n: int) -> tuple[list[dict], np.ndarray]:
    rows = sorted((r for r in table.to_pylist() if r["n"] == n), key=lambda r: r["bucket"])
    return rows, np.sum([np.frombuffer(r["stats"], dtype=np.int64) for r in rows], axis=0)


def resolve(docs: pa.Table, replies: pa.Table, upto: int, part_tokens: int) -> State:
    """Evaluate order by order: each token's probability from the tables' answers so far."""
    tokens = Tokens.of(docs)
    rows, stats = _replies(replies, 1)
    count = np.concatenate([_unpack(r["seen"]) for r in rows]).astype(np.int64)
    kinds, total = int(stats[-2]), int(stats[-1])
    discount = discounts(stats[: DISCOUNTED + 1])
    r = np.arange(1, DISCOUNTED + 1)
    lost = float((stats[:DISCOUNTED] * r * (1 - discount[1 : DISCOUNTED + 1])).sum())
    if total and not lost:  # nothing is discounted: one more in the denominator is the unknown class
        single, unknown = count / (total + 1), 1 / (total + 1)
    else:
        single, unknown = _factor(discount, count) * count / max(total, 1), lost / total if total else 1.0
    single = np.where(count > 0, single, unknown)
    mine = count[tokens.word]
    base = np.log10((mine + 0.5) / (total + 0.5 * (kinds + 1)))
    # Training texts are as many as training ends.
    end = np.searchsorted(tokens.words, _END)
    starts = int(count[end]) if end < len(count) else 0
    state = State(tokens, single[tokens.word], mine > 0, base, total, mine, starts)
    for n in range(2, upto + 1):
        held = context_counts(state, n)
        grams = Grams.of(tokens, n, held, state.probability, part_tokens)
        rows, stats = _replies(replies, n)
        discount = discounts(stats[: DISCOUNTED + 1])
        count = np.concatenate([_unpack(x["seen"]) for x in rows]).astype(np.int64)
        few = np.concatenate([_unpack(x["few"]).reshape(DISCOUNTED, -1) for x in rows], axis=1).astype(np.int64)
        mass = np.concatenate([_unpack(x["mass"]) for x in rows])
        size = int(grams.whole.max()) + 1 if len(grams.whole) else 0
        lost = np.bincount(grams.whole_of, weights=(few * (r * (1 - discount[1 : DISCOUNTED + 1]))[:, None]).sum(axis=0), minlength=size)
        covered = np.bincount(grams.whole_of, weights=mass, minlength=size)
        lost, covered = lost[grams.whole], covered[grams.whole]
        mine = count[grams.gram]
        below = held + (lost <= 0)
        direct = _factor(discount, mine) * mine / np.maximum(below, 1)
        left = np.where(lost > 0, lost, 1.0) / np.maximum(below, 1)
        alpha = np.where(held > 0, left / np.maximum(1 - covered, 1e-300), 1.0)
        state.probability = np.where(mine > 0, direct, alpha * state.probability)
        state.seen = mine
    return state


def context_counts(state: State, n: int) -> np.ndarray:
    """Training count of each token's n - 1 predecessors: the count of the sequence that ends there."""
    before = np.roll(state.seen, 1)
    before[state.tokens.first[state.tokens.first < len(before)]] = state.starts
    return before


def score_texts(
    docs: DataFrame, train: str = "train", text: str = "text", order: int = ORDER, batch_bytes: int = BATCH_BYTES, part_tokens: int = PART_TOKENS
) -> DataFrame:
    """`doc_id`, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score` per row.

    `docs` has `doc_id`, `held_out` and the boolean `train` (rows to learn from; null: not). Scores
    are log10 probabilities of the whole text with its end, after lowering A-Z. Null and empty
    texts are their end alone. Repeated rows count and score each. Without training rows every
    probability is 1. An empty table gives an empty result; other columns play no part.
    """
    volume = docs.agg(F.sum(F.octet_length(text) + 1).alias("n")).first()["n"] or 0
    batches = max(1, -(-volume // batch_bytes))
    buckets = -(-batches // 2)
    dealt = docs.select(
        F.pmod(F.xxhash64("doc_id", text), F.lit(batches)).cast("int").alias("batch"),
        "doc_id",
        "held_out",
        F.coalesce(F.col(train), F.lit(False)).alias("train"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).repartition("batch")

    def ordered(table: pa.Table) -> pa.Table:
        return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])

    def first(key: tuple, table: pa.Table) -> pa.Table:
        grams = Grams.of(Tokens.of(ordered(table)), 1, np.zeros(0), np.zeros(0), part_tokens)
        return grams.requests(key[0].as_py(), 1, buckets)

    replies = dealt.groupBy("batch").applyInArrow(first, _REQUEST).groupBy("bucket").applyInArrow(_serve(1), _REPLY)

    def longer(n: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
        def ask(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
            state = resolve(ordered(table), answers, n - 1, part_tokens)
            grams = Grams.of(state.tokens, n, context_counts(state, n), state.probability, part_tokens)
            return grams.requests(key[0].as_py(), n, buckets)

        return ask

    for n in range(2, order + 1):
        asked = dealt.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(longer(n), _REQUEST)
        replies = replies.unionAll(asked.groupBy("bucket").applyInArrow(_serve(n), _REPLY))

    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        table = ordered(table)
        state = resolve(table, answers, order, part_tokens)
        rows, owner = table.num_rows, state.tokens.owner

        def per_row(values: np.ndarray) -> np.ndarray:
            return np.bincount(owner, weights=values, minlength=rows)

        return pa.table(
            {
                "doc_id": table["doc_id"],
                "held_out": table["held_out"],
                "n_tokens": per_row(np.ones(len(owner))).astype(np.int64),
                "n_known": per_row(state.known).astype(np.int64),
                "train_tokens": np.full(rows, state.total),
                "base_score": per_row(state.base),
                "score": per_row(np.log10(state.probability)),
            }
        )

    out = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return dealt.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(score, out)
