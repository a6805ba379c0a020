"""Tables a user of the engine writes once and then queries many times."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tidegauge.functions.ends import stream_ends
from tidegauge.functions.sizing import session_folder, settle, shuffles_removed
from tidegauge.operators import levels as lv
from tidegauge.operators import quality
from tidegauge.operators import records as rec
from tidegauge.plans.fixtures import Fixtures
from tidegauge.sources import dims


class Workbench:
    """Fixtures of one folder with the record tables settled on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.fx = Fixtures(spark, folder)

    def prompts(self) -> DataFrame:
        return dims.validate_prompts(self.fx.raw_prompts())[0]

    def slo(self) -> DataFrame:
        return dims.slo_profiles(self.fx.slo_config())

    def build_records(self) -> DataFrame:
        fx = self.fx
        return rec.build_records(fx.chunks(), fx.requests(), fx.runs(), fx.models(), self.prompts(), self.gaps, self.ends)

    @cached_property
    def gaps(self) -> DataFrame:
        """Gap rows of all responses, written once."""
        with shuffles_removed(self.spark):
            return settle(rec.inter_token_gaps(self.fx.chunks(), ends=self.ends))

    @cached_property
    def ends(self) -> DataFrame:
        """Where the streams end that have lines behind their end marker, written once."""
        with shuffles_removed(self.spark):
            return stream_ends(self.fx.chunks())

    @cached_property
    def slim_records(self) -> DataFrame:
        """Request records without the lists of their gaps, written once."""
        with shuffles_removed(self.spark):
            return settle(self.build_records().drop("itl_list"))

    @cached_property
    def records(self) -> DataFrame:
        """Request records; a list of gaps is built only where a plan reads it."""
        return rec.with_lists(self.slim_records, self.gaps)

    @cached_property
    def scored(self) -> DataFrame:
        """Request records with their evaluation, written once."""
        return settle(quality.backfill(self.slim_records, self.fx.eval_results()))

    def build_levels(self, records: DataFrame) -> DataFrame:
        fx = self.fx
        return lv.level_summary(records, fx.run_levels(), fx.runs(), fx.models(), self.slo(), self.gaps)

    @cached_property
    def levels(self) -> DataFrame:
        """Level summary, written once."""
        return settle(self.build_levels(self.records))

    def folder(self, name: str) -> str:
        """A fresh path in the shared folder."""
        import uuid

        return f"{session_folder(self.spark)}/{name}-{uuid.uuid4().hex}"


_benches: dict[tuple[str, str], Workbench] = {}


def workbench(spark: SparkSession, folder: str) -> Workbench:
    """One workbench per session and folder, so that the settled tables are shared."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _benches:
        _benches[key] = Workbench(spark, folder)
    return _benches[key]


def rounded(df: DataFrame, digits: int = 6, cost_digits: int = 9) -> DataFrame:
    """Round doubles for comparison; costs have more places because they are small."""
    return df.selectExpr(
        *[
            f"round({name}, {cost_digits if 'cost' in name else digits}) + 0.0D as {name}" if kind == "double" else name
            for name, kind in df.dtypes
        ]
    )
