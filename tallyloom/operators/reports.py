"""Boards and audit lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The status that an event stands for.
STATUS = {"signup": "uploaded", "view": "processing", "click": "review_needed", "purchase": "completed", "error": "error"}


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, company, status, created_at and completed_at (the user's next event) of tasks that the events stand for."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "ts")
    status = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("event_id").alias("id"), F.col("user_id").alias("company"), F.try_element_at(status, F.col("event_type")).alias("status"), F.col("ts").alias("created_at"), F.lead("ts").over(by).alias("completed_at"))


def task_board(tasks_: DataFrame, by: str = "company") -> DataFrame:
    """Tasks, completed ones, their share in whole percent, and mean duration in seconds of completed tasks."""
    done = F.col("status") == "completed"
    seconds = F.when(done, F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1_000_000
    return tasks_.groupBy(by).agg(F.count("*").alias("n_tasks"), F.count_if(done).alias("n_completed"), F.bround(F.count_if(done) * 100 / F.count("*"), 0).cast("long").alias("success_percent"), F.round(F.avg(seconds), 3).alias("mean_seconds"))


def review_progress(flags: DataFrame, by: str = "rule_id") -> DataFrame:
    """Flags, failed ones (Failed or Manual) and the share that is resolved."""
    failed = F.col("status").isin("Failed", "Manual")
    return flags.groupBy(by).agg(F.count("*").alias("n_flags"), F.count_if(failed).alias("n_failed"), F.round(1 - F.count_if(failed) / F.count("*"), 6).alias("resolved"))


def extraction_audit(mapping: DataFrame, facts: DataFrame) -> DataFrame:
    """Every mapped field of every filing as found, with its value, or missing, with its default. The result has filings x mapped fields rows, so each filing meets the mapping, which is gathered in one row."""
    filings = facts.select("filing_id").distinct()
    all_fields = mapping.agg(F.collect_list(F.struct("field", "default")).alias("m"))
    wanted = filings.crossJoin(all_fields).select("filing_id", F.explode("m").alias("m")).select("filing_id", "m.*")
    rows = wanted.join(facts, ["filing_id", "field"], "left")
    return rows.select("filing_id", "field", F.when(F.col("value").isNull(), "missing").otherwise("found").alias("state"), F.coalesce("value", "default").alias("value"))
