"""Column expressions for single values. All are native Spark expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.functions import fixed

# A number as text: decimal or exponent form, infinity or not-a-number, no type suffix.
NUMBER_TEXT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)\s*$"


def tpot(ttft: Column, e2e: Column, output_tokens: Column) -> Column:
    """Seconds per output token after the first; null below two tokens."""
    return F.when(output_tokens > 1, (e2e - ttft) / (output_tokens - 1))


def normalized_latency(e2e: Column, output_tokens: Column) -> Column:
    """Seconds per output token; null without tokens."""
    return F.when(output_tokens > 0, e2e / output_tokens)


def cost_usd(prompt_tokens: Column, output_tokens: Column, price_input: Column, price_output: Column) -> Column:
    """Cost of one request; null unless both prices are known."""
    return (prompt_tokens * price_input + output_tokens * price_output) / F.lit(fixed.PRICE_UNIT_TOKENS)


def _bucket(tokens: Column, limits: Sequence[int]) -> Column:
    short, medium, long = fixed.BUCKETS
    return F.when(tokens < limits[0], short).when(tokens < limits[1], medium).otherwise(long)


def isl_bucket(declared: Column, prompt_tokens: Column) -> Column:
    """Declared input bucket; the token count decides only when it is empty."""
    return F.coalesce(F.nullif(declared, F.lit("")), _bucket(prompt_tokens, fixed.INPUT_BUCKET_LIMITS))


def osl_bucket(output_tokens: Column) -> Column:
    return _bucket(output_tokens, fixed.OUTPUT_BUCKET_LIMITS)


def duration_s(text: Column) -> Column:
    """Seconds of a duration such as `500ms`, `2m` or `1.5`; null when it is none."""
    unit = F.regexp_extract(text, fixed.DURATION_PATTERN, 2)
    scale = F.lit(None).cast("double")
    for name, seconds in fixed.DURATION_UNITS.items():
        scale = F.when(unit == name, seconds).otherwise(scale)
    scale = F.when(unit == "", 1.0).otherwise(scale)
    number = F.regexp_extract(text, fixed.DURATION_PATTERN, 1).try_cast("double")
    return F.when(text.rlike(fixed.DURATION_PATTERN), number * scale)


def steady_end(duration: Column, warmup: Column, cooldown: Column) -> Column:
    """End of the steady window; the cooldown gives way when nothing would be left."""
    return F.when(duration - cooldown <= warmup, duration).otherwise(duration - cooldown)


def phase(offset: Column, warmup: Column, end: Column) -> Column:
    return F.when(offset < warmup, fixed.WARMUP).when(offset < end, fixed.STEADY).otherwise(fixed.COOLDOWN)


def outcome(error_kind: Column, status_code: Column, done: Column, parse_ok: Column) -> Column:
    """Outcome of a request from its transport error, status and stream markers.

    Without a transport error the status decides first; only an accepted request has a
    stream, which must parse throughout and end with its done marker.
    """
    return (
        F.when(error_kind == "timeout", fixed.TIMEOUT)
        .when(error_kind == "protocol", fixed.MALFORMED_STREAM)
        .when(error_kind.isNotNull(), fixed.CONNECTION_ERROR)
        .when(status_code == fixed.HTTP_TOO_MANY_REQUESTS, fixed.RATE_LIMITED)
        .when(status_code != fixed.HTTP_OK, fixed.CONNECTION_ERROR)
        .when(F.coalesce(done, F.lit(False)) & F.coalesce(parse_ok, F.lit(True)), fixed.SUCCESS)
        .otherwise(fixed.MALFORMED_STREAM)
    )


def cache_violation(outcome_: Column, cached_tokens: Column, cache_busting: Column) -> Column:
    return (outcome_ == fixed.SUCCESS) & (cached_tokens > 0) & F.coalesce(cache_busting, F.lit(False))


def within(latency_s: Column, bound_ms: Column) -> Column:
    """A missing bound passes; a missing latency fails a bound."""
    return F.coalesce(latency_s * 1000.0 <= bound_ms, bound_ms.isNull())


def meets_slo(ttft: Column, tpot_: Column, e2e: Column, ttft_ms: Column, tpot_ms: Column, e2e_ms: Column) -> Column:
    return within(ttft, ttft_ms) & within(tpot_, tpot_ms) & within(e2e, e2e_ms)


def eval_eligible(outcome_: Column, expected: Column) -> Column:
    """A success with a reference text that is not blank (any white space counts as blank)."""
    return (outcome_ == fixed.SUCCESS) & F.coalesce(expected.rlike(r"(?U)\S"), F.lit(False))


def slug(text: Column) -> Column:
    cleaned = F.btrim(F.regexp_replace(text, fixed.SLUG_PATTERN, "-"), F.lit("-"))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(fixed.DEFAULT_SLUG))


def family(model: Column) -> Column:
    """Vendor part of a model name: the text before the first slash."""
    return F.split_part(model, F.lit("/"), F.lit(1))


def self_preference(judge_model: Column, model: Column) -> Column:
    """The judge comes from the family it judges."""
    return family(judge_model) == family(model)


def unit_scale(metric: Column) -> Column:
    """Factor from the stored unit of a panel metric to the shown one."""
    scale = F.lit(None).cast("double")
    for name, (_, factor, _) in fixed.PANEL_METRICS.items():
        scale = F.when(metric == name, factor).otherwise(scale)
    return scale


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 for a zero vector, null when the lengths differ."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    zero = F.lit(0.0)

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, zero, lambda acc, x: acc + x * x))

    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), zero, lambda acc, x: acc + x)
    size = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(size == 0.0, zero).otherwise(dot / size))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def between(low: Column, high: Column, share: Column) -> Column:
    """Linear interpolation."""
    return low * (1.0 - share) + high * share


def list_quantile(ordered: Column, prob: float) -> Column:
    """Exact quantile of one sorted array (linear between ranks)."""
    at = F.lit(prob) * (F.size(ordered) - 1)
    low = F.get(ordered, F.floor(at).cast("int"))
    high = F.get(ordered, F.ceil(at).cast("int"))
    return between(low, high, at - F.floor(at))


def list_summary(values: Column) -> Column:
    """`{mean,p50,p95,p99,max}` of one array column; null when it is empty or null."""

    def summary(ordered: Column) -> Column:
        total = F.aggregate(ordered, F.lit(0.0), lambda acc, x: acc + x)
        return F.when(
            F.size(ordered) > 0,
            F.struct(
                (total / F.size(ordered)).alias("mean"),
                list_quantile(ordered, 0.5).alias("p50"),
                list_quantile(ordered, 0.95).alias("p95"),
                list_quantile(ordered, 0.99).alias("p99"),
                F.element_at(ordered, -1).alias("max"),
            ),
        )

    return bind(F.array_sort(values), summary)


def number_or_zero(text: Column) -> Column:
    """Text as a double, 0 when it is no number. Never null."""
    return F.coalesce(F.when(text.rlike(NUMBER_TEXT), text.try_cast("double")), F.lit(0.0))


def clamp_unit(value: Column) -> Column:
    """Into [0, 1]; not-a-number becomes 1. `value` must not be null."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def is_number(text: Column) -> Column:
    return text.rlike(NUMBER_TEXT)


def json_object(text: Column) -> Column:
    """Variant of a JSON object; null for bad JSON and for any other JSON value.

    JSON that begins with a brace is an object, so a text is parsed once and other texts are not.
    """
    return F.when(text.rlike(r"^\x{FEFF}?\s*\{"), F.try_parse_json(text))


def tool_arguments(text: Column) -> Column:
    """Tool-call arguments as canonical JSON; `{}` unless the text is a JSON object."""
    return F.coalesce(F.to_json(json_object(text)), F.lit("{}"))


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys at every depth; other text is kept as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def summary_cell(seconds: Column) -> Column:
    """Seconds shown as milliseconds with one decimal; a dash when absent."""
    return F.when(seconds.isNull(), "-").otherwise(F.format_string("%.1fms", seconds * 1000.0))
