"""Exact percentiles of event-time windows with a state that does not grow with the values.

The state counts values per window, level and logarithmic cell, so it has as many rows as cells
are occupied, however many different values come. The values land as rows, batch by batch, and
only those of the cells that hold a wanted rank are ever ordered, once their window is closed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import fixed
from tidegauge.functions.percentiles import quantiles_of_cells
from tidegauge.functions.segments import value_block
from tidegauge.streaming.folded import Folded

_KEYS = ("window_start", "run_id", "level_or_rate")
_CELLS = "window_start timestamp, run_id string, level_or_rate double, _cell bigint, _n bigint"
_VALUES = "window_start timestamp, run_id string, level_or_rate double, _cell bigint, _value double, _w bigint"


class WindowPercentiles(Folded):
    """The fold of steady successes: `open` cells, `closed` cells and landed `values` of one metric.

    A row whose window the watermark has passed is late: it is left out and counted. `slide` makes
    windows overlap; a row is then in several.
    """

    def __init__(self, spark: SparkSession, folder: str, metric: str, size: str, delay: str, slide: str | None = None):
        super().__init__(spark, folder, delay)
        self.metric, self.size, self.slide = metric, size, slide

    def fold(self, batch: DataFrame, number: int) -> None:
        passed = self.passed(number)
        newest = batch.agg(F.max(F.unix_millis("ts"))).first()[0]
        watermark = self.watermark(passed, newest)
        value = F.col(self.metric).cast("double")
        good = (F.col("phase") == fixed.STEADY) & (F.col("outcome") == fixed.SUCCESS) & value.isNotNull()
        window = F.window("ts", self.size, self.slide) if self.slide else F.window("ts", self.size)
        rows = batch.filter(good).select(window.alias("w"), "run_id", "level_or_rate", value.alias("_value"))
        late = F.unix_millis("w.end") <= passed
        missed = rows.filter(late).count()
        kept = rows.filter(~late).select(F.col("w.start").alias("window_start"), *_KEYS[1:], value_block(F.col("_value")).alias("_cell"), "_value")
        values = self._write(kept.groupBy(*_KEYS, "_cell", "_value").agg(F.count("*").alias("_w")), "values", number)
        fresh = values.groupBy(*_KEYS, "_cell").agg(F.sum("_w").alias("_n"))
        both = self._read("open", _CELLS, number - 1).unionByName(fresh).groupBy(*_KEYS, "_cell").agg(F.sum("_n").alias("_n"))
        merged = self._write(both, "merged", number)
        closed = F.unix_millis("window_start") + self.milliseconds(self.size) <= watermark
        self._write(merged.filter(closed), "closed", number)
        self._write(merged.filter(~closed), "open", number)
        self.mark(number, watermark, missed)

    def state(self, number: int) -> DataFrame:
        """The open cells after batch `number`."""
        return self._read("open", _CELLS, number)

    def percentiles(self, probs: Sequence[float]) -> DataFrame:
        """`(window_start, run_id, level_or_rate, quantiles, samples)` of all closed windows."""
        return quantiles_of_cells(_KEYS, self._all("closed", _CELLS), self._all("values", _VALUES), probs)
