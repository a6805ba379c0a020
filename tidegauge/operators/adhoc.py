"""Ad-hoc SQL over one data file."""

from __future__ import annotations

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidegauge.sources.readers import read_by_suffix, read_own_columns


class QueryError(ValueError):
    """A missing data file or SQL that Spark refuses, as one line."""


def one_line(message: str) -> str:
    return " ".join(message.split("\n\n")[0].split())


def query_frame(data: DataFrame, sql: str) -> DataFrame:
    """Run `sql` with `data` registered as the view of that name."""
    data.createOrReplaceTempView("data")
    try:
        return data.sparkSession.sql(sql)
    except (AnalysisException, ParseException) as error:
        raise QueryError(one_line(str(error))) from error


def query_file(spark: SparkSession, path: str, sql: str, schema: T.StructType | None = None) -> DataFrame:
    """Run `sql` over a `.parquet` file or JSON lines; the result is a lazy DataFrame.

    JSON lines have their own columns, or those of `schema` when it is given.
    """
    try:
        data = read_by_suffix(spark, path, schema) if schema else read_own_columns(spark, path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise QueryError(f"data file not found: {path}") from error
        raise
    return query_frame(data, sql)
