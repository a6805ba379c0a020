"""Quality scores: joining them to records, coverage, and scoring replies and vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import fixed, scalars
from tidegauge.functions.segments import deal, key_parts

SCORES = ("sim_score", "quality_score", "quality_pass", "judge_verdict", "judge_reason")


# -- joining scores to records ----------------------------------------------------


def eval_eligible(records: DataFrame) -> DataFrame:
    """Requests to be scored, in any phase: successes with a reference text."""
    return records.where(scalars.eval_eligible(F.col("outcome"), F.col("expected_output")))


def eval_status(eligible: Column, result_status: Column) -> Column:
    """Status after the join: no reference, then the result's own, then dropped."""
    return (
        F.when(~eligible, fixed.SKIPPED_NO_EXPECTED)
        .when(result_status.isNotNull(), result_status)
        .otherwise(fixed.EVAL_DROPPED)
    )


def one_result(results: DataFrame, newest: str | None = None) -> DataFrame:
    """One result per request: the newest by `newest`, else (and among equals) the greatest values."""
    values = [name for name in results.columns if name != "request_id"]
    order = ([newest] if newest else []) + [name for name in values if name != newest]
    best = results.groupBy("request_id").agg(F.max(F.struct(*order)).alias("_best"))
    return best.select("request_id", *[F.col("_best")[name].alias(name) for name in values])


def backfill(records: DataFrame, results: DataFrame, newest: str | None = None) -> DataFrame:
    """Left-join scores by request. Only eligible requests take scores.

    A request with several results takes one (see `one_result`), so records never multiply.
    """
    parts = key_parts(records, ["request_id"])
    ours = deal(records.drop(*SCORES, "eval_status"), ["request_id"], parts)
    theirs = one_result(deal(results, ["request_id"], parts), newest).select("request_id", F.col("eval_status").alias("_status"), *SCORES)
    eligible = scalars.eval_eligible(F.col("outcome"), F.col("expected_output"))
    joined = ours.join(theirs, "request_id", "left")
    return joined.withColumns(
        {name: F.when(eligible, F.col(name)) for name in SCORES}
        | {"eval_status": eval_status(eligible, F.col("_status"))}
    ).drop("_status")


def coverage(records: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Judged share of the eligible requests, and how many were dropped."""
    status = F.col("eval_status")
    counts = records.groupBy(*keys).agg(
        F.count_if(status == fixed.JUDGED).alias("judged"),
        F.count_if(status.isNotNull() & (status != fixed.SKIPPED_NO_EXPECTED)).alias("total_eligible"),
        F.count_if(status == fixed.EVAL_DROPPED).alias("dropped"),
    )
    share = F.when(F.col("total_eligible") > 0, F.col("judged") / F.col("total_eligible")).otherwise(F.lit(0.0))
    return counts.withColumn("coverage", share)


# -- embeddings ----------------------------------------------------------------------


def pair_cosine(vectors: DataFrame) -> DataFrame:
    """Cosine of the expected and the actual vector of each pair."""
    expected = vectors.where(F.col("side") == "expected").select("pair_id", F.col("v").alias("expected"))
    actual = vectors.where(F.col("side") == "actual").select("pair_id", F.col("v").alias("actual"))
    return expected.join(actual, "pair_id").select("pair_id", scalars.cosine(F.col("expected"), F.col("actual")).alias("sim_score"))


def embed_score(pairs: DataFrame, threshold: float) -> DataFrame:
    """Similarity as quality; it passes at the threshold or above."""
    return pairs.withColumns(
        {
            "quality_score": F.col("sim_score"),
            "quality_pass": F.col("sim_score") >= threshold,
            "eval_status": F.lit(fixed.JUDGED),
        }
    )


def embed_texts(texts: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> DataFrame:
    """Add `embedding` from a model. `load` runs once per task and returns texts -> vectors.

    No model comes with this package; the vectors usually exist already.
    """
    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series([[float(x) for x in v] for v in model(batch.fillna("").tolist())])

    return texts.withColumn("embedding", embed(F.col(text)))


def judge_texts(pairs: DataFrame, load: Callable[[], Callable[[list[str], list[str]], list[str]]]) -> DataFrame:
    """Add the judge's reply `body` to `(expected, actual)` rows, scored natively afterwards."""
    @F.pandas_udf("string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for expected, actual in batches:
            yield pd.Series(model(expected.fillna("").tolist(), actual.fillna("").tolist()))

    return pairs.withColumn("body", judge("expected", "actual"))


# -- judge replies ---------------------------------------------------------------------


def reply_content(body: Column) -> Column:
    """Text of the first choice of a chat reply, empty when there is none."""
    return F.coalesce(F.get_json_object(body, "$.choices[0].message.content"), F.lit(""))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^(?U)\s+|(?U)\s+$", "")


def _lenient_json(content: Column) -> Column:
    """Variant of the content. Bare NaN and Infinity values are read as text, so they survive."""
    quoted = F.regexp_replace(content, r":\s*(NaN|-?Infinity)(?=\s*[,}])", r': "$1"')
    return F.coalesce(F.try_parse_json(content), F.try_parse_json(quoted))


def _field(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def _shown(value: Column, path: str) -> Column:
    """A JSON value as text: fractions as doubles, `True`, `False` and `None` as words; null if missing."""
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    fraction = kind.startswith("DECIMAL") | kind.startswith("DOUBLE") | kind.startswith("FLOAT")
    text = _field(value, path)
    return (
        F.when(kind == "VOID", "None")
        .when(kind == "BOOLEAN", F.initcap(text))
        .when(fraction, F.try_variant_get(value, path, "double").cast("string"))
        .otherwise(text)
    )


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def judge_score(content: Column) -> Column:
    """Struct `{score, reason}` of a score reply.

    An object gives its `score` field, anything else is read whole as a number. What is no
    number scores 0 (it is replaced before clamping, because `least` skips nulls).
    """

    def parse(value: Column) -> Column:
        raw = _field(value, "$.score")
        kind = F.schema_of_variant(F.try_variant_get(value, "$.score", "variant"))
        truth = F.when(raw == "true", 1.0).otherwise(0.0)
        number = F.when(
            _is_object(value), F.when(kind == "BOOLEAN", truth).otherwise(scalars.number_or_zero(raw))
        ).otherwise(scalars.number_or_zero(content))
        reason = F.when(_is_object(value), F.coalesce(_shown(value, "$.reason"), F.lit(""))).otherwise(content)
        return F.struct(scalars.clamp_unit(number).alias("score"), _strip(reason).alias("reason"))

    return scalars.bind(_lenient_json(content), parse)


def judge_verdict(content: Column) -> Column:
    """Struct `{verdict, reason}` of a verdict reply; a reply that is no object is both."""

    def parse(value: Column) -> Column:
        whole = F.coalesce(_shown(value, "$"), _strip(content))
        verdict = _strip(F.coalesce(_shown(value, "$.verdict"), F.lit("")))
        reason = _strip(F.coalesce(_shown(value, "$.reason"), verdict))
        parsed = _is_object(value)
        return F.struct(
            F.when(parsed, verdict).otherwise(whole).alias("verdict"), F.when(parsed, reason).otherwise(whole).alias("reason")
        )

    return scalars.bind(_lenient_json(content), parse)


def normalize_verdict(verdict: Column, rubric: Column) -> Column:
    """Into the words of the rubric; what is outside becomes its negative pole."""

    def words(token: Column) -> Column:
        three = F.when(token.isin(*fixed.THREE_LEVEL_VERDICTS), token).otherwise("incorrect")
        passed = F.when(token.isin(*fixed.PASS_SYNONYMS), "pass").otherwise("fail")
        binary = F.when(token.isin(*fixed.BINARY_VERDICTS), token).otherwise(passed)
        return F.when(rubric == "three_level", three).otherwise(binary)

    return scalars.bind(F.lower(_strip(verdict)), words)


def verdict_score(verdict: Column) -> Column:
    score = F.lit(0.0)
    for name, points in fixed.VERDICT_SCORES.items():
        score = F.when(verdict == name, points).otherwise(score)
    return score


def score_replies(replies: DataFrame) -> DataFrame:
    """Score a table of judge replies `(request_id, rubric, body)` into evaluation results."""
    content = reply_content(F.col("body"))
    parsed = replies.withColumn("_content", content).withColumns(
        {"_scored": judge_score(F.col("_content")), "_judged": judge_verdict(F.col("_content"))}
    )
    by_score = F.col("rubric") == "score"
    verdict = normalize_verdict(F.col("_judged.verdict"), F.col("rubric"))
    quality = F.when(by_score, F.col("_scored.score")).otherwise(verdict_score(verdict))
    return parsed.select(
        "request_id",
        F.lit(fixed.JUDGED).alias("eval_status"),
        F.lit(None).cast("double").alias("sim_score"),
        quality.alias("quality_score"),
        F.when(~by_score, verdict).alias("judge_verdict"),
        F.when(by_score, F.col("_scored.reason")).otherwise(F.col("_judged.reason")).alias("judge_reason"),
    )
