"""What every batch of a stream did, kept beyond the few progress reports a query remembers.

A query's own `recentProgress` forgets all but its newest batches. A ledger hears every report of
the session's queries and stores it by query and batch; a batch that ran again replaces its row.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

_SCHEMA = "query_id string, run_id string, batch_id bigint, reported string, input_rows bigint, dropped_by_state bigint, observed map<string,bigint>"


class Ledger(StreamingQueryListener):
    """Batches of all queries that start while it listens (`with Ledger(spark, folder) as ledger`).

    `input_rows` is what the sources delivered; `dropped_by_state` what stateful operators dropped as
    late, which are rows of their input: groups, where they aggregate; `observed` the metrics that
    the stream observes itself (whole numbers), by `name.metric`.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._rows: dict[tuple[str, int], tuple] = {}
        self._ended: set[str] = set()
        self._news = threading.Condition()

    def __enter__(self) -> Ledger:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        report = event.progress
        observed = {f"{name}.{key}": int(value) for name, row in report.observedMetrics.items() for key, value in row.asDict().items() if value is not None}
        dropped = sum(state.numRowsDroppedByWatermark for state in report.stateOperators)
        row = (str(report.id), str(report.runId), report.batchId, report.timestamp, report.numInputRows, dropped, observed)
        with self._news:
            # A batch without new rows may be reported again while the query waits.
            old = self._rows.get(row[0:1] + (row[2],))
            if old is None or old[1] != row[1] or row[4] or row[5]:
                self._rows[row[0], row[2]] = row

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self._news:
            self._ended.add(str(event.runId))
            self._news.notify_all()

    def settle(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Wait until all reports of a query that has ended are in, and store what is new."""
        with self._news:
            if not self._news.wait_for(lambda: str(query.runId) in self._ended, seconds):
                raise TimeoutError("the reports of the query did not come")
            rows = list(self._rows.values())
            self._rows.clear()
        if rows:
            self.spark.createDataFrame(rows, _SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)

    def batches(self) -> DataFrame:
        """One row per query and batch of all that was stored, the newest report of each."""
        newest = Window.partitionBy("query_id", "batch_id").orderBy(F.desc("reported"))
        rows = self.spark.read.schema(_SCHEMA).parquet(self.folder)
        return rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")

    def total(self, metric: str) -> int:
        """Sum of an observed metric (`name.metric`) over all stored batches."""
        found = self.batches().agg(F.sum(F.col("observed")[metric])).first()[0]
        return found or 0
