"""Streams folded batch by batch into a state that is a table.

A batch writes to folders of its own number and reads the state its predecessor left. A batch
that is repeated after a failure starts from the same state and overwrites what it had written,
so nothing counts twice. The folder is shared by all executors. The watermark is the newest event
time of all batches, less the delay; it is stored with each batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_MARKS = "watermark bigint, late bigint"
# Before any event.
_NEVER = -(2**62)


class Folded:
    """What folds have in common; a subclass has `fold(batch, number)`."""

    def __init__(self, spark: SparkSession, folder: str, delay: str):
        self.spark, self.folder = spark, folder
        self.delay = self.milliseconds(delay)

    def milliseconds(self, interval: str) -> int:
        epoch = "timestamp '1970-01-01 00:00:00+00:00'"
        return self.spark.range(1).select(F.expr(f"unix_millis({epoch} + interval {interval})")).first()[0]

    def fold(self, batch: DataFrame, number: int) -> None:
        raise NotImplementedError

    def start(self, stream: DataFrame) -> StreamingQuery:
        """Fold what is there and stop; a later start goes on where this one ended."""
        query = stream.writeStream.foreachBatch(self.fold).option("checkpointLocation", f"{self.folder}/checkpoint")
        return query.trigger(availableNow=True).start()

    def _read(self, name: str, schema: str, number: int) -> DataFrame:
        if number < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/batch={number}")

    def _write(self, rows: DataFrame, name: str, number: int) -> DataFrame:
        path = f"{self.folder}/{name}/batch={number}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _all(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.folder}/{name}")

    def passed(self, number: int) -> int:
        """The watermark before batch `number`."""
        row = self._read("marks", _MARKS, number - 1).first()
        return row["watermark"] if row else _NEVER

    def watermark(self, passed: int, newest: int | None) -> int:
        return passed if newest is None else max(passed, newest - self.delay)

    def mark(self, number: int, watermark: int, late: int) -> None:
        self._write(self.spark.createDataFrame([(watermark, late)], _MARKS).coalesce(1), "marks", number)

    def marks(self) -> DataFrame:
        """`watermark` (milliseconds) and `late` (rows left out) of every batch."""
        return self._all("marks", _MARKS)
