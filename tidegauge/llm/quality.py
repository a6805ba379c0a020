"""Quality by positive-unlabelled learning (operator 10).

Trusted positives are labelled good documents; the unlabelled set is web text of unknown mix.
With class prior pi the classification risk is estimated without any negatives as
pi * R_P(+) + [R_U(-) - pi * R_P(-)], and the bracket - the risk of the unseen negatives, which
cannot be negative - is kept at 0 or above (the non-negative risk estimator). The loss is
logistic, the model linear in features of a text's surface, so its score is a probability.

Features never look at ids, languages or sources: shares of kinds of characters, word lengths
and repetitions, and a hashed histogram of word shapes (`Xx`, `XX!`, `x#`).
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

SHAPES = 512
# The bounds of the fitted sample: rows of either set, and bytes of a text in it.
FIT_ROWS = 6000
FIT_BYTES = 1 << 16
# Bytes of text whose features are computed at once.
STEP = 1 << 20
ROUNDS = 400
SHRINK = 1e-3

# Kinds of bytes: 0 other, 1 lower, 2 upper, 3 digit, 4 sentence marks, 5 exclamation, 6 symbols, 7 beyond ASCII
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 7
_KIND[[39, 44, 45, 46, 58, 59, 63]] = 4
_KIND[33] = 5
_KIND[[*range(34, 39), 40, 41, 42, 43, 47, 60, 61, 62, 64, *range(91, 97), *range(123, 127)]] = 6
# Symbols keep their own code in a word's shape; letters beyond ASCII count as lower case.
_SHAPE = np.arange(256, dtype=np.uint64) + U(16)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 1, 2, 3, 1


def _per_text(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of `values` between neighbouring `edges`."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[edges[1:]] - total[edges[:-1]]


def features(texts: pa.Array) -> np.ndarray:
    """One row per text: shares and ratios, then the histogram of word shapes."""
    words = Words(texts)
    rows = len(words.offsets) - 1
    size = np.diff(words.offsets).astype(np.float64)
    kind = _KIND[words.data[: words.offsets[-1]]]
    share = [_per_text(kind == k, words.offsets) / np.maximum(size, 1) for k in range(1, 8)]
    count = words.counts().astype(np.float64)
    some = np.maximum(count, 1)
    lengths = (words.ends - words.starts).astype(np.float64)
    hashes = words.hashes()
    owners = words.owners()
    pairs = hashes ^ mix(owners.astype(np.uint64) + U(1))
    order = np.argsort(pairs, kind="stable")
    fresh = np.ones(len(words), dtype=bool)
    fresh[order[1:]] = pairs[order[1:]] != pairs[order[:-1]]
    same = np.zeros(len(words), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owners[1:] == owners[:-1])
    first, last = words.data[words.starts], words.data[words.ends - 1]
    upper = np.concatenate([[0], np.cumsum(kind == 2)])
    lower = np.concatenate([[0], np.cumsum((kind == 1))])
    shout = (upper[words.ends] > upper[words.starts]) & (lower[words.ends] == lower[words.starts])
    breaks = _per_text(words.data[: words.offsets[-1]] == 10, words.offsets)
    each = [
        np.log1p(count) / 8,
        _per_text(lengths, words.firsts) / some / 8,
        np.sqrt(np.maximum(_per_text(lengths**2, words.firsts) / some - (_per_text(lengths, words.firsts) / some) ** 2, 0)) / 8,
        _per_text(fresh, words.firsts) / some,
        np.log(np.maximum(_per_text(fresh, words.firsts), 1) / some),
        repeats := _per_text(same, words.firsts) / some,
        np.sqrt(repeats),
        np.minimum(repeats * 20, 1),
        loud := _per_text(shout, words.firsts) / some,
        np.sqrt(loud),
        _per_text(_KIND[last] == 4, words.firsts) / some,
        _per_text(_KIND[last] >= 5, words.firsts) / some,
        _per_text((lengths == 1) & (_KIND[first] == 6), words.firsts) / some,
        breaks / some,
        np.minimum(some, 50) / 50,
        (count == 0).astype(np.float64),
    ]
    # The shape of a word: its run-collapsed character codes, as a chained hash of the runs.
    code = _SHAPE[words.data[: words.offsets[-1]]]
    fresh_run = np.ones(len(code), dtype=bool)
    fresh_run[1:] = code[1:] != code[:-1]
    fresh_run[words.starts] = True
    runs = np.concatenate([[0], np.cumsum(fresh_run)])
    spot = np.arange(len(code), dtype=np.int64)
    begin = np.zeros(len(code) + 1, dtype=np.int64)
    begin[words.starts] = words.starts
    inside = np.maximum.accumulate(begin[:-1]) if len(code) else begin[:-1]
    place = (runs[spot] - runs[inside]).astype(np.uint64)
    mark = np.where(fresh_run, mix(code * U(67) + np.minimum(place, U(6))), U(0))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mark, dtype=np.uint64)])
    shape = (mix(sums[words.ends] - sums[words.starts]) % U(SHAPES)).astype(np.int64)
    table = np.bincount(owners * SHAPES + shape, minlength=rows * SHAPES).reshape(rows, SHAPES)
    return np.concatenate([np.stack([*share, *each], axis=1), np.sqrt(table / some[:, None])], axis=1)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = ROUNDS, shrink: float = SHRINK) -> np.ndarray:
    """Weights, then the bias, that minimise the non-negative risk (Adam on the full sample).

    When the estimated risk of the negatives falls below 0, the step goes against its gradient
    instead, which is how the estimator keeps a flexible model from fitting noise.
    """
    with_one = [np.concatenate([x, np.ones((len(x), 1))], axis=1) for x in (positive, unlabelled)]
    theta = np.zeros(positive.shape[1] + 1)
    theta[-1] = np.log(prior) - np.log1p(-prior)
    mean, spread = np.zeros_like(theta), np.zeros_like(theta)
    for turn in range(1, rounds + 1):
        zp, zu = (x @ theta for x in with_one)
        p_up, p_down = 1 / (1 + np.exp(zp)), 1 / (1 + np.exp(-zp))
        u_down = 1 / (1 + np.exp(-zu))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_positive = -prior * (with_one[0].T @ p_up) / len(zp)
        g_negative = (with_one[1].T @ u_down) / len(zu) - prior * (with_one[0].T @ p_down) / len(zp)
        grad = g_positive + g_negative if negative >= 0 else -g_negative
        grad[:-1] += shrink * theta[:-1]
        mean = 0.9 * mean + 0.1 * grad
        spread = 0.99 * spread + 0.01 * grad**2
        rate = 0.1 * min(1, 2 - 2 * turn / rounds)
        theta -= rate * (mean / (1 - 0.9**turn)) / (np.sqrt(spread / (1 - 0.99**turn)) + 1e-8)
    return theta


@dataclass
class QualityModel:
    """A fitted model of fixed size: the scales and weights of the features, and the bias."""

    middle: np.ndarray
    scale: np.ndarray
    theta: np.ndarray
    prior: float

    def documents(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """`docs` with `score`, the probability of a good document.

        Null and empty texts are scored by their features like any other (no words, no
        characters); repeated rows score alike; a column named `score` is replaced.
        """
        rest = docs.drop("score")
        model, kept = docs.sparkSession.sparkContext.broadcast((self.middle, self.scale, self.theta)), rest.columns

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            middle, scale, theta = model.value
            for batch in steps(batches, text, STEP):
                linear = np.clip((features(batch.column(text)) - middle) / scale, -8, 8) @ theta[:-1] + theta[-1]
                yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in kept), pa.array(1 / (1 + np.exp(-linear)))], names=[*kept, "score"])

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), "score double"])
        return rest.mapInArrow(score, schema)


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, longest: int = FIT_BYTES, prior: float | None = None) -> QualityModel:
    """Fit on at most `rows` trusted positives and `rows` unlabelled documents.

    `labels` has `doc_id` and `quality` of the rows that may be learnt from; nulls are left out.
    The positives are those with 1. The unlabelled documents come from all of `docs`, whatever
    is known of them. The class prior is the share of 1 among `labels` (add-one smoothed),
    unless it is given. Texts over `longest` bytes are left out of the sample, not of the
    scores. The samples are the first ids in the order of a hash and are fitted in one task.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
    if prior is None:
        seen = known.agg(F.count("*").alias("n"), F.sum(F.when(F.col("label") > 0, 1).otherwise(0)).alias("good")).first()
        prior = ((seen["good"] or 0) + 1) / (seen["n"] + 2)
    good = sample_ids(known.filter("label > 0").select("doc_id"), rows).withColumn("side", F.lit(1))
    every = sample_ids(docs.select("doc_id").filter("doc_id is not null").distinct(), rows).withColumn("side", F.lit(0))
    sample = with_texts(good, docs, longest).unionByName(with_texts(every, docs, longest))

    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = pd.concat([*frames, pd.DataFrame({"doc_id": [], "text": [], "side": []})]).sort_values(["side", "doc_id"])
        texts = pa.RecordBatch.from_arrays([pa.array(table["text"].tolist(), type=pa.string())], names=["text"])
        found = np.concatenate([features(pa.array([], type=pa.string())), *(features(x.column(0)) for x in steps([texts], size=STEP))])
        side = table["side"].to_numpy(dtype=np.int64)
        if not (side == 1).any() or not (side == 0).any():
            middle, scale, theta = np.zeros(found.shape[1]), np.ones(found.shape[1]), np.zeros(found.shape[1] + 1)
            theta[-1] = np.log(prior) - np.log1p(-prior)
        else:
            middle, scale = found.mean(axis=0), found.std(axis=0) + 0.02
            scaled = np.clip((found - middle) / scale, -8, 8)
            theta = fit(scaled[side == 1], scaled[side == 0], prior)
        yield pd.DataFrame({"middle": [middle.tobytes()], "scale": [scale.tobytes()], "theta": [theta.tobytes()]})

    row = sample.repartition(1).mapInPandas(train, "middle binary, scale binary, theta binary").first()
    return QualityModel(*(np.frombuffer(row[name], dtype=np.float64) for name in ("middle", "scale", "theta")), prior)
