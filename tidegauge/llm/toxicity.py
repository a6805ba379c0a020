"""Toxicity by multiple-instance learning (operator 9).

Only documents carry labels; sentences are the instances. A sentence with features f has
p = sigmoid(bias + sum of weights[f]), and a document is toxic unless all its sentences are
clean: P = 1 - prod(1 - p) (noisy-or). The weights are fitted by minimising the log loss of the
*document* labels through the noisy-or, and the sentence scores that come out say where.

Features of a sentence: hashed words in lower case without edge punctuation, and hashed
beginnings of 4 and 6 bytes, which carry over to word forms not seen before. A sentence ends
after `.`, `!` or `?` and at a line break.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.labelled import sample_ids, with_texts
from tidegauge.llm.words import U, Words, mix, steps

BITS = 18
# The bounds of the fitted sample: labelled rows, and bytes of a text in it.
FIT_ROWS = 6000
FIT_BYTES = 1 << 16
# Bytes of text that are scored at once.
STEP = 2 << 20
ROUNDS = 200
SHRINK = 0.1
# Share of the strict (one false feature in all) threshold that a feature must pass.
SCREEN = 0.6

_EDGE = np.zeros(256, dtype=bool)
_EDGE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[33, 46, 63]] = True


@dataclass
class Sentences:
    """Sentences of some texts: first word of each, owner text of each, features per word."""

    words: Words
    first: np.ndarray
    owner: np.ndarray
    features: np.ndarray


def sentences(texts: pa.Array, bits: int = BITS) -> Sentences:
    words = Words(texts, lower=True)
    stop = _STOP[words.data[words.ends - 1]] if len(words) else np.zeros(0, dtype=bool)
    lines = np.flatnonzero(words.data == 10)
    line = np.searchsorted(lines, words.starts)
    owners = words.owners()
    fresh = np.ones(len(words), dtype=bool)
    fresh[1:] = stop[:-1] | (line[1:] != line[:-1]) | (owners[1:] != owners[:-1])
    for _ in range(3):  # punctuation at the edges of a word, up to three marks on either side
        head = (words.ends - words.starts > 1) & _EDGE[words.data[words.starts]]
        words.starts = words.starts + head
        tail = (words.ends - words.starts > 1) & _EDGE[words.data[words.ends - 1]]
        words.ends = words.ends - tail
    shift = U(64 - bits)
    features = np.stack(
        [mix(words.hashes(most) ^ U(salt)) >> shift for salt, most in ((1, None), (2, 4), (3, 6))], axis=1
    ).astype(np.int32)
    first = np.flatnonzero(fresh)
    return Sentences(words, first, owners[first], features)


def sentence_scores(found: Sentences, weights: np.ndarray, bias: float) -> np.ndarray:
    """log(1 - p) of each sentence: minus softplus of its linear score."""
    if not len(found.first):
        return np.zeros(0)
    per_word = weights[found.features].sum(axis=1, dtype=np.float64)
    return -np.logaddexp(0, np.add.reduceat(per_word, found.first) + bias)


def fit(texts: list[str], labels: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, shrink: float = SHRINK) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the documents' log loss through the noisy-or (Adam).

    Features are screened first: one stays if its association with label 1 over the documents
    is stronger than chance would give any of them (`excess`), which leaves out the many words
    that are rare by accident. Without both labels nothing is learnt and every document scores
    the share of label 1 that was seen (0.5 without rows).
    """
    weights = np.zeros(1 << bits, dtype=np.float32)
    if len(labels) == 0 or labels.min() == labels.max():
        return weights, np.nan
    found = sentences(pa.array(texts, type=pa.large_binary()), bits)
    share, count = labels.mean(), len(found.first)
    pairs = np.unique(found.words.owners()[:, None].astype(np.int64) << bits | found.features)
    feature = pairs & ((1 << bits) - 1)
    held = np.bincount(feature, minlength=1 << bits)
    toxic = np.bincount(feature, weights=labels[pairs >> bits], minlength=1 << bits)
    kept = np.flatnonzero(excess(toxic, held, share) >= SCREEN * np.log(max((held > 0).sum(), 1)))
    place = np.full(1 << bits, -1, dtype=np.int32)
    place[kept] = np.arange(len(kept))
    entry = place[found.features]
    word, _ = at = np.nonzero(entry >= 0)
    entry = entry[at]
    spot = np.searchsorted(found.first, word, side="right") - 1
    theta = np.zeros(len(kept) + 1)
    theta[-1] = np.log(share) - np.log(max(count / len(labels), 1))
    mean, spread = np.zeros_like(theta), np.zeros_like(theta)
    for turn in range(1, rounds + 1):
        linear = np.bincount(spot, weights=theta[entry], minlength=count) + theta[-1]
        safe = np.bincount(found.owner, weights=np.logaddexp(0, linear), minlength=len(labels))
        # d loss / d safe: -(1 - P) / P for label 1, +1 for label 0
        slope = np.where(labels > 0, -np.exp(-safe) / np.maximum(-np.expm1(-safe), 1e-9), 1.0) / len(labels)
        pull = slope[found.owner] / (1 + np.exp(-np.clip(linear, -500, 500)))
        grad = np.append(np.bincount(entry, weights=pull[spot], minlength=len(kept)), pull.sum())
        grad[:-1] += shrink * theta[:-1] / len(labels)
        mean = 0.9 * mean + 0.1 * grad
        spread = 0.99 * spread + 0.01 * grad**2
        rate = 0.1 * min(1, 2 - 2 * turn / rounds)
        theta -= rate * (mean / (1 - 0.9**turn)) / (np.sqrt(spread / (1 - 0.99**turn)) + 1e-8)
    weights[kept] = theta[:-1]
    return weights, float(theta[-1])


def excess(positive: np.ndarray, held: np.ndarray, share: float) -> np.ndarray:
    """Minus the log of a bound on the chance of so many positives among `held` documents."""
    rate = positive / np.maximum(held, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = rate * np.log(rate / share) + np.where(rate < 1, (1 - rate) * np.log((1 - rate) / (1 - share)), 0)
    return np.where((held > 0) & (rate > share), held * gain, 0)


@dataclass
class ToxicityModel:
    """A fitted model: `1 << bits` weights, so its size has a bound whatever it was fitted on."""

    weights: np.ndarray
    bias: float
    base: float

    def documents(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """`docs` with `score` and the worst sentence: `worst_score`, `worst_from`, `worst_to`.

        `worst_from` and `worst_to` bound its words (0-based, end excluded), null where there
        are none. Null and empty texts score 0, or the base rate for a model without both
        labels. Repeated rows score alike; columns of the same names are replaced.
        """
        names = ("score", "worst_score", "worst_from", "worst_to")
        rest = docs.drop(*names)
        out = pa.schema([("score", pa.float64()), ("worst_score", pa.float64()), ("worst_from", pa.int64()), ("worst_to", pa.int64())])
        model, kept = docs.sparkSession.sparkContext.broadcast((self.weights, self.bias, self.base)), rest.columns

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, bias, base = model.value
            for batch in steps(batches, text, STEP):
                arrays = [batch.column(name) for name in kept]
                texts, count = batch.column(text), batch.num_rows
                if np.isnan(bias):
                    none = pa.nulls(count)
                    made = [pa.array(np.full(count, base)), none.cast(pa.float64()), none.cast(pa.int64()), none.cast(pa.int64())]
                else:
                    found = sentences(texts, int(np.log2(len(weights))))
                    safe = sentence_scores(found, weights, bias)
                    total = np.bincount(found.owner, weights=safe, minlength=count)
                    order = np.lexsort((found.first, safe, found.owner))
                    lead = order[np.flatnonzero(np.diff(found.owner[order], prepend=-1))]
                    ends = np.append(found.first[1:], len(found.words))
                    worst, start, end = np.full(count, np.nan), np.zeros(count, dtype=np.int64), np.zeros(count, dtype=np.int64)
                    rows = found.owner[lead]
                    worst[rows] = -np.expm1(safe[lead])
                    start[rows] = found.first[lead] - found.words.firsts[rows]
                    end[rows] = ends[lead] - found.words.firsts[rows]
                    empty = np.isnan(worst)
                    made = [pa.array(-np.expm1(total)), *(pa.array(x, mask=empty) for x in (worst, start, end))]
                yield pa.RecordBatch.from_arrays([*arrays, *made], names=[*kept, *out.names])

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), "score double", "worst_score double", "worst_from bigint", "worst_to bigint"])
        return rest.mapInArrow(score, schema)

    def sentences(self, docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
        """The offending sentences: `doc_id`, `from_word`, `to_word`, `score` of at least `least`."""
        model = docs.sparkSession.sparkContext.broadcast((self.weights, self.bias))

        def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, bias = model.value
            for batch in steps(batches, text, STEP):
                if np.isnan(bias):
                    continue
                found = sentences(batch.column(text), int(np.log2(len(weights))))
                scores = -np.expm1(sentence_scores(found, weights, bias))
                hit = np.flatnonzero(scores >= least)
                owner, ends = found.owner[hit], np.append(found.first[1:], len(found.words))
                base = found.words.firsts[owner]
                made = [batch.column("doc_id").take(pa.array(owner)), pa.array(found.first[hit] - base), pa.array(ends[hit] - base), pa.array(scores[hit])]
                yield pa.RecordBatch.from_arrays(made, names=["doc_id", "from_word", "to_word", "score"])

        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.select("doc_id", text).mapInArrow(locate, f"doc_id {kind}, from_word bigint, to_word bigint, score double")


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, longest: int = FIT_BYTES) -> ToxicityModel:
    """Fit on at most `rows` labelled documents of at most `longest` bytes each.

    `labels` has `doc_id` and `toxic`; rows with a null in either are left out and a document
    labelled twice counts as toxic if one label says so. The sample is the first `rows` ids in
    the order of their hash; it is fitted in one task.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    sample = with_texts(sample_ids(known, rows), docs, longest)

    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = pd.concat([*frames, pd.DataFrame({"doc_id": [], "text": [], "label": []})]).sort_values("doc_id")
        target = (table["label"].to_numpy(dtype=np.float64) > 0).astype(np.float64)
        weights, bias = fit([text.encode() for text in table["text"]], target)
        yield pd.DataFrame({"weights": [weights.tobytes()], "bias": [bias], "base": [float(target.mean()) if len(target) else 0.5]})

    row = sample.repartition(1).mapInPandas(train, "weights binary, bias double, base double").first()
    return ToxicityModel(np.frombuffer(row["weights"], dtype=np.float32), float("nan") if row["bias"] is None else row["bias"], row["base"])
