"""Totals of request records: counts, latencies, tokens and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Numbers that a record may hold; those that a table lacks count as nil.
NUMBERS = ("latency_ms", "model_calls", "input_tokens", "output_tokens", "total_tokens", "prompt_tokens", "completion_tokens", "estimated_cost", "llm_ms", "non_llm_ms")
#: Fixed value: the share of requests that are as fast as the reported slow one, by its place among n - 1.
SLOW = 0.95


def slow_latency(records: DataFrame) -> DataFrame:
    """One row, p95_latency_ms: the latency at place floor(0.95 (n - 1)) in order; nil without records.

    Records are counted by whole milliseconds first, so what is sorted has one row for each latency, not for each record."""
    counts = records.select(F.coalesce(F.col("latency_ms").cast("long"), F.lit(0)).alias("latency")).groupBy("latency").agg(F.count(F.lit(1)).alias("n"))
    by_latency = Window.orderBy("latency")
    placed = counts.select("latency", F.sum("n").over(by_latency).alias("upto"), F.sum("n").over(by_latency.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"))
    return placed.where(F.col("upto") > F.floor((F.col("all") - 1) * SLOW)).agg(F.coalesce(F.min("latency"), F.lit(0)).alias("p95_latency_ms"))


def summary(records: DataFrame) -> DataFrame:
    """One row over all records. Nulls count as nil and a record whose status is not success as failed. Where no record
    names prompt or completion tokens, the input and output tokens take their place; means without records are nil."""
    rows = records.select("status", *[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in records.columns else F.lit(0).alias(c) for c in NUMBERS])
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("status") == "success", 1)).alias("good"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in NUMBERS])
    mean = lambda c, places=0: F.coalesce(F.bround(F.try_divide(F.col(c), F.col("n")), places), F.lit(0.0))
    instead = lambda c, other: F.when(F.col(c) != 0, F.col(c)).otherwise(F.col(other))
    found = sums.select(
        F.col("n").alias("total_requests"), F.col("good").alias("successful_requests"), (F.col("n") - F.col("good")).alias("failed_requests"), mean("latency_ms").alias("average_latency_ms"),
        F.col("model_calls").alias("total_model_calls"), mean("model_calls", 2).alias("average_model_calls"), F.col("input_tokens").alias("total_input_tokens"), F.col("output_tokens").alias("total_output_tokens"), F.col("total_tokens"),
        instead("prompt_tokens", "input_tokens").alias("total_prompt_tokens"), instead("completion_tokens", "output_tokens").alias("total_completion_tokens"),
        mean("input_tokens").alias("average_input_tokens"), mean("output_tokens").alias("average_output_tokens"), mean("total_tokens").alias("average_total_tokens"),
        F.bround("estimated_cost", 6).alias("estimated_total_cost"), mean("estimated_cost", 6).alias("average_cost_per_request"), F.col("llm_ms").alias("total_llm_duration_ms"), F.col("non_llm_ms").alias("total_non_llm_duration_ms"),
    )
    return found.crossJoin(slow_latency(records))
