"""Request records and token gaps from a stream of chunks, with state of a constant size per request.

Every batch is folded with Spark's own joins and windows into the open requests, which are a
table with one row each: last arrival, counts, last usage values, where the stream ended. Gaps go
out as rows in the batch that brings their second arrival, the first gap of a batch reaching back
to the last arrival in the state. A request is closed when the watermark - the newest event time
seen, less the delay - has passed its last chunk by `timeout`.

How batches keep their state and what happens after a failure is told in `streaming.folded`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions import scalars
from tidegauge.functions.ends import closing
from tidegauge.operators import records as rec
from tidegauge.streaming.folded import Folded

_STATE = """
request_id string, newest bigint, seq bigint, stop bigint, ttft double, last double, _deltas bigint, _usages bigint,
_prompt_tokens bigint, _completion_tokens bigint, _cached_tokens bigint, _reasoning_tokens bigint,
_done boolean, _parse_ok boolean, status_code int, _error_rank int, e2e double, disordered bigint
"""
_GAPS = "request_id string, since double, gap double, n bigint"


class Assembly(Folded):
    """The fold of one stream into `folder`.

    Rows of a batch may come in any order; from batch to batch the chunks of a request come in the
    order of `seq`, as a log is written. A chunk that comes behind a later one of an earlier batch
    still counts, with its gap to the last arrival so far, and is counted in `disordered`. Rows older
    than the watermark whose request is not open are late: they are left out and counted (`marks`).
    """

    def __init__(self, spark: SparkSession, folder: str, timeout: str, delay: str):
        super().__init__(spark, folder, delay)
        self.timeout = self.milliseconds(timeout)

    def fold(self, batch: DataFrame, number: int) -> None:
        """One batch: gaps and closed requests out, open requests to the next state."""
        state = self._read("open", _STATE, number - 1)
        passed = self.passed(number)
        ms = F.unix_millis("ts")
        known = state.select("request_id", F.col("stop").alias("_stop"), F.col("last").alias("_last"), F.col("seq").alias("_seq"))
        rows = batch.withColumn("ms", ms).join(known, "request_id", "left")
        late = F.col("_seq").isNull() & (F.col("ms") < passed)
        figures = rows.agg(F.max("ms").alias("newest"), F.count_if(late & F.col("request_id").isNotNull()).alias("late")).first()
        watermark = self.watermark(passed, figures["newest"])

        rows = rows.filter(~late & F.col("request_id").isNotNull())
        whole = Window.partitionBy("request_id")
        # Up to the first end marker, of this batch or of the state.
        stop = F.least("_stop", F.min(F.when(F.col("done"), F.col("seq"))).over(whole))
        rows = rows.withColumn("stop", stop).withColumn("_counts", F.coalesce(F.col("seq") <= F.col("stop"), F.lit(True)))
        texts = rows.filter(F.col("_counts") & rec.has_text())
        since = F.coalesce(F.lag("arrival_s").over(whole.orderBy("seq", "arrival_s")), F.col("_last"))
        gaps = texts.select("request_id", since.alias("since"), (F.col("arrival_s") - since).alias("gap"), F.lit(1).cast("long").alias("n"))
        self._write(gaps.filter("since is not null"), "gaps", number)

        merged = self._write(self._merge(state, rows), "merged", number)
        closed = F.col("newest") + self.timeout < watermark
        self._write(merged.filter(closed), "closed", number)
        self._write(merged.filter(~closed), "open", number)
        self.mark(number, watermark, figures["late"])

    def _merge(self, state: DataFrame, rows: DataFrame) -> DataFrame:
        """The state after the rows of a batch: one row per request."""
        stream = [F.when(F.col("_counts"), F.col(name)).alias(name) for name in ("content", "usage", "done", "parse_ok")]
        # The end time is that of a closing row or of the stream, not of what follows it.
        ends = F.when(F.col("_counts") | closing(rows), F.col("arrival_s")).alias("arrival_s")
        text_at = F.when(F.col("_counts") & rec.has_text(), F.col("arrival_s")).alias("text_at")
        counted = rows.select("request_id", "ms", "seq", "stop", "status_code", "error_kind", ends, text_at, (F.col("seq") < F.col("_seq")).alias("_back"), *stream)
        place = F.when(F.col("text_at").isNotNull(), F.struct("seq", "text_at"))
        fresh = counted.groupBy("request_id").agg(
            F.max("ms").alias("newest"), F.max("seq").alias("seq"), F.min("stop").alias("stop"),
            F.min_by("text_at", place).alias("ttft"), F.max_by("text_at", place).alias("last"),
            *rec.usage_aggregates(), *rec.outcome_aggregates(), F.count_if("_back").alias("disordered"),
        )
        old, new = state.alias("old"), fresh.alias("new")
        both = old.join(new, F.col("old.request_id") == F.col("new.request_id"), "full")
        a, b = (lambda name: F.col(f"old.{name}")), (lambda name: F.col(f"new.{name}"))
        zero = F.lit(0).cast("long")
        rules = {
            "request_id": lambda n: F.coalesce(a(n), b(n)), "ttft": lambda n: F.coalesce(a(n), b(n)),
            **{n: lambda n: F.greatest(a(n), b(n)) for n in ("newest", "seq", "status_code", "_error_rank", "e2e", "_done")},
            **{n: lambda n: F.least(a(n), b(n)) for n in ("stop", "_parse_ok")},
            **{n: lambda n: F.coalesce(a(n), zero) + F.coalesce(b(n), zero) for n in ("_deltas", "_usages", "disordered")},
            **{n: lambda n: F.coalesce(b(n), a(n)) for n in ("last", *(f"_{key}" for key in rec.USAGE_KEYS))},
        }
        return both.select(*[rules[f.name](f.name).cast(f.dataType).alias(f.name) for f in state.schema])

    def gaps(self) -> DataFrame:
        """`(request_id, since, gap, n)` of all requests so far, open ones included."""
        return self._all("gaps", _GAPS)

    def records(self) -> DataFrame:
        """Closed requests: the columns of `records.response_facts` without `itl_list`, both rates, `disordered`."""
        closed = self._all("closed", _STATE)
        ended = self.gaps().join(closed.select("request_id"), "request_id", "left_semi")
        facts = rec.finished_facts(closed.join(rec.gap_facts(ended), "request_id", "left"), "disordered")
        return facts.withColumns({
            "tpot": scalars.tpot(F.col("ttft"), F.col("e2e"), F.col("output_tokens")),
            "normalized_latency": scalars.normalized_latency(F.col("e2e"), F.col("output_tokens")),
        })
