"""KPIs over a stream: sums, which can be added up, by event-time window; late rows until the watermark count."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.plans.kpi import Kpi


def windowed_sums(stream: DataFrame, kpis: Iterable[Kpi], date: str = "date", window: str = "1 day", watermark: str = "2 days", group: Iterable[str] = ()) -> DataFrame:
    """(window_start, group..., sums, rows) of a streaming or a plain frame; ratios keep both sums, so windows can be added up."""
    kpis, group = list(kpis), list(group)
    rows = stream.withColumn("_at", F.col(date).cast("timestamp"))
    rows = rows.withWatermark("_at", watermark) if stream.isStreaming else rows
    sums = rows.groupBy(F.window("_at", window).alias("w"), *group).agg(*[s for k in kpis for s in k.sums()], F.count(F.lit(1)).alias("rows"))
    return sums.select(F.col("w.start").alias("window_start"), *group, *[n for k in kpis for n in k.sum_names()], "rows")


def finish(sums: DataFrame, kpis: Iterable[Kpi], group: Iterable[str] = ()) -> DataFrame:
    """KPI values of groups of windows, from their added sums."""
    kpis, group = list(kpis), list(group)
    added = sums.groupBy(*group).agg(*[F.sum(n).alias(n) for k in kpis for n in k.sum_names()], F.sum("rows").alias("rows"))
    return added.select(*group, *[k.finish().alias(k.key) for k in kpis], "rows")
