"""Fixed values of the data model.

These are part of the meaning of the data (names, limits, units, prices per
million, built-in latency targets). Every module takes them from here.
"""

# Outcomes of one request.
SUCCESS = "success"
RATE_LIMITED = "rate_limited"
TIMEOUT = "timeout"
MALFORMED_STREAM = "malformed_stream"
CONNECTION_ERROR = "connection_error"
OUTCOMES = (SUCCESS, RATE_LIMITED, TIMEOUT, MALFORMED_STREAM, CONNECTION_ERROR)

# Phases of one load level.
WARMUP = "warmup"
STEADY = "steady"
COOLDOWN = "cooldown"

# The load mode with rules of its own.
OPEN = "open"

# HTTP status codes with a meaning of their own.
HTTP_OK = 200
HTTP_TOO_MANY_REQUESTS = 429

# Share of rate-limited steady requests above which a level is flagged (strictly above).
RATE_LIMITED_SHARE = 0.01

# Samples a metric needs before its 99.9th percentile is reported.
P999_SAMPLES = 1000

# Prices are per this many tokens.
PRICE_UNIT_TOKENS = 1_000_000.0

# Length buckets: below the first limit short, below the second medium, else long.
INPUT_BUCKET_LIMITS = (256, 1024)
OUTPUT_BUCKET_LIMITS = (32, 256)
BUCKETS = ("short", "medium", "long")

# Prompt defaults.
DEFAULT_CATEGORY = "general"
DEFAULT_INPUT_BUCKET = "short"

# Durations: a number with an optional unit, seconds when there is none.
DURATION_PATTERN = r"^\s*(\d+(?:\.\d+)?)\s*(ms|s|m|h)?\s*$"
DURATION_UNITS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0}

# Built-in latency targets in milliseconds.
SLO_PROFILES = {
    "interactive": {"ttft_ms": 500.0, "tpot_ms": 50.0, "e2e_ms": 5000.0},
    "relaxed": {"ttft_ms": 2000.0, "tpot_ms": 200.0, "e2e_ms": 30000.0},
}

# Evaluation statuses.
JUDGED = "judged"
EVAL_SKIPPED = "eval_skipped"
SKIPPED_NO_EXPECTED = "skipped_no_expected"
EVAL_DROPPED = "eval_dropped"

# Verdict vocabularies, synonyms of a pass, and scores.
BINARY_VERDICTS = ("pass", "fail")
THREE_LEVEL_VERDICTS = ("correct", "partial", "incorrect")
PASS_SYNONYMS = ("yes", "true", "correct")
VERDICT_SCORES = {"pass": 1.0, "fail": 0.0, "correct": 1.0, "partial": 0.5, "incorrect": 0.0}

# Reasons for skipping a prompt a model cannot serve.
TOOLS_UNSUPPORTED = "tools_unsupported"
VISION_UNSUPPORTED = "vision_unsupported"

# File names: characters outside this class become one dash; an empty name is "run".
SLUG_PATTERN = "[^A-Za-z0-9._-]+"
DEFAULT_SLUG = "run"

# Panel fields: metric -> (record column, scale, unit); rates -> unit; aggregates.
PANEL_DIMENSIONS = (
    "level_or_rate", "model", "category", "isl_bucket",
    "osl_bucket", "mode", "outcome", "prompt_id",
)
PANEL_METRICS = {
    "ttft": ("ttft", 1000.0, "ms"),
    "tpot": ("tpot", 1000.0, "ms"),
    "e2e": ("e2e", 1000.0, "ms"),
    "tt2t": ("tt2t", 1000.0, "ms"),
    "normalized_latency": ("normalized_latency", 1000.0, "ms"),
    "input_tokens": ("prompt_tokens", 1.0, "tok"),
    "output_tokens": ("output_tokens", 1.0, "tok"),
    "cached_tokens": ("cached_tokens", 1.0, "tok"),
    "reasoning_tokens": ("reasoning_tokens", 1.0, "tok"),
    "cost_usd": ("cost_usd", 1.0, "usd"),
    "quality_score": ("quality_score", 1.0, "score"),
    "sim_score": ("sim_score", 1.0, "score"),
}
PANEL_RATES = {"rps": "req/s", "system_tok_s": "tok/s"}
PANEL_PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
PANEL_AGGREGATES = ("p50", "p90", "p95", "p99", "mean", "max", "min", "count")
UNITS_IN_SERIES_NAMES = ("ms", "usd")
