"""What reviewers change: facts, cells and payloads, and the filings that must be evaluated again because of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def latest(changes: DataFrame, keys: list[str]) -> DataFrame:
    """keys and value: of each key the change said last (at; of one moment the greatest value)."""
    return changes.groupBy(*keys).agg(F.max_by("value", F.struct("at", "value")).alias("value"))


def reviewed(facts: DataFrame, changes: DataFrame) -> DataFrame:
    """filing_id, field and value: what the reviewer said last, else the fact; a change of a field without a fact is one. A null change takes a fact away."""
    said = latest(changes, ["filing_id", "field"]).withColumnRenamed("value", "said").withColumn("changed", F.lit(True))
    met = facts.select("filing_id", "field", "value").join(said, ["filing_id", "field"], "full")
    return met.select("filing_id", "field", F.when(F.col("changed"), F.col("said")).otherwise(F.col("value")).alias("value")).filter("value is not null")


def patched(cells: DataFrame, patches: DataFrame) -> DataFrame:
    """filing_id, sheet, cell and value of a grid with its patches: the last one counts, a null one empties the cell, one of a new cell adds it."""
    keys = ["filing_id", "sheet", "cell"]
    said = latest(patches, keys).withColumnRenamed("value", "said").withColumn("changed", F.lit(True))
    return cells.select(*keys, "value").join(said, keys, "full").select(*keys, F.when(F.col("changed"), F.coalesce("said", F.lit(""))).otherwise(F.col("value")).alias("value"))


def payload(fields: DataFrame, rules: DataFrame, values: DataFrame) -> DataFrame:
    """filing_id, field and value of a template's fields: the value found under the key that the field's rule names, else that key itself; a field without a rule is empty.

    fields: filing_id, template and field. rules: template, field and extracted_key. values: filing_id, key and value.
    """
    named = fields.join(rules.select("template", "field", "extracted_key"), ["template", "field"], "left")
    met = named.join(values.select("filing_id", F.col("key").alias("extracted_key"), "value"), ["filing_id", "extracted_key"], "left")
    return met.select("filing_id", "field", F.coalesce("value", "extracted_key", F.lit("")).alias("value"))


class Evaluations:
    """Results of filings under a folder, in buckets of filings. A rerun writes only the buckets of filings that changed."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64("filing_id"), F.lit(self.buckets)).cast("int")

    def _write(self, results: DataFrame) -> None:
        rows = results.withColumn("bucket", self._bucket())
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def results(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket")

    def run(self, facts: DataFrame, evaluate: Callable[[DataFrame], DataFrame]) -> None:
        """Evaluate all filings of facts."""
        self._write(evaluate(facts))

    def rerun(self, facts: DataFrame, changes: DataFrame, evaluate: Callable[[DataFrame], DataFrame]) -> None:
        """Evaluate the filings that changes speak of, with what reviewers said in place of the facts.

        evaluate must give rows of filing_id from the facts of a filing alone. Facts of other filings
        are not evaluated; results of those in a bucket that is written again are carried over. A
        bucket that loses all its results keeps its old ones: its filings then have no fact left.
        """
        touched = changes.select("filing_id").distinct()
        fresh = evaluate(reviewed(facts.join(touched, "filing_id", "left_semi"), changes))
        try:
            stored = self.spark.read.parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self._write(fresh)
        buckets = touched.select(self._bucket().alias("bucket")).distinct()
        others = stored.join(buckets, "bucket", "left_semi").join(touched, "filing_id", "left_anti")
        self._write(fresh.unionByName(others.drop("bucket")))
