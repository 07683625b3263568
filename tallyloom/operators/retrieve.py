"""Retrieval: grouped KPIs, series with explicit gaps, ranks, distributions, cross tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.errors import InvalidArgument
from tallyloom.functions import robust
from tallyloom.operators.order import MOST_AT_ONCE, counted, placed, quantiles, spread, totals
from tallyloom.plans import timefilter as tf
from tallyloom.sources.facts import PERIODS, Facts
from tallyloom.sources.scratch import kept

ALL = tf.TimeFilter("all", "all")


def query_kpi(f: Facts, kpi_keys: list[str], time_filter=ALL, filters: dict | None = None, group_by: list[str] | None = None, sort_by: str | None = None, order: str = "desc", limit: int | None = None) -> DataFrame:
    """One row for each group: group labels, one value for each KPI, rows. Undefined values sort last either way."""
    kpis, group = [f.kpi(k) for k in kpi_keys], list(group_by or [])
    for g in group:
        if g not in PERIODS:
            f.dimension(g)
    if order not in ("asc", "desc"):
        raise InvalidArgument(f"order is asc or desc, not {order!r}")
    if sort_by and sort_by not in kpi_keys + group:
        raise InvalidArgument(f"can't sort by {sort_by!r}")
    out = f.sums(kpis, group, tf.parse(time_filter), filters).select(*group, *[k.finish().alias(k.key) for k in kpis], "rows")
    keys = [F.col(g).cast("string").asc_nulls_last() for g in group]
    if sort_by in kpi_keys:
        keys.insert(0, F.col(sort_by).asc_nulls_last() if order == "asc" else F.col(sort_by).desc_nulls_last())
    elif sort_by and order == "desc":
        keys.insert(0, F.col(sort_by).cast("string").desc_nulls_last())
    if limit is not None:
        return out.orderBy(*keys).limit(limit)
    return out.orderBy(*keys) if keys else out


def timeframes(f: Facts) -> DataFrame:
    rows = f.rows(set()).select(F.year("date").alias("year"), F.quarter("date").alias("quarter"), "date")
    return rows.groupBy("year", "quarter").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("start"), F.max("date").alias("end"))


def series(f: Facts, kpi_keys: list[str], grain: str = "quarter", time_filter=ALL, filters: dict | None = None, group: str | None = None) -> DataFrame:
    """(ord, period, values, rows) of the periods held, and of members' if ``group`` is given; one scan for all KPIs."""
    if grain not in tf.GRAINS:
        raise InvalidArgument(f"no grain {grain!r}")
    kpis = [f.kpi(k) for k in kpi_keys]
    need = f.needed(kpis) | ({group} if group else set())
    keys = ([group] if group else []) + ["ord"]
    rows = f.rows(need, tf.parse(time_filter), filters).withColumn("ord", tf.ordinal(F.col("date"), grain))
    sums = rows.groupBy(*keys).agg(*[s for k in kpis for s in k.sums()], f.count().alias("rows"))
    return sums.select(*keys, tf.ordinal_name(F.col("ord"), grain).alias("period"), *[k.finish().alias(k.key) for k in kpis], "rows")


def gaps(points: DataFrame, grain: str) -> DataFrame:
    """The calendar's periods between the first and last of a series that hold no row; values are never made up."""
    span = points.agg(F.min("ord").alias("a"), F.max("ord").alias("b")).where("a is not null")
    missing = span.select(F.explode(F.sequence("a", "b")).alias("ord")).join(points.select("ord"), "ord", "left_anti")
    return missing.select(tf.ordinal_name(F.col("ord"), grain).alias("period"))


def rank_entities(f: Facts, kpi_key: str, dimension: str, time_filter=ALL, order: str = "desc", limit: int | None = 10, filters: dict | None = None, most: int | None = None) -> DataFrame:
    """Dense rank of members with share and running share of the total, which only additive KPIs have; members without a value come last, one by one."""
    k = f.kpi(kpi_key)
    if order in ("best", "worst"):
        order = "desc" if (order == "best") == k.higher_is_better else "asc"
    values = f.sums([k], [f.dimension(dimension)], tf.parse(time_filter), filters).select(F.col(dimension).alias("member"), k.finish().alias("value"))
    values = totals(values, [], whole=F.sum("value"), known=F.count("value"))
    by = F.col("value").desc_nulls_last() if order == "desc" else F.col("value").asc_nulls_last()
    share = F.when(F.col("whole") != 0, F.try_divide(F.col("value"), F.col("whole")) * 100) if k.additive else F.lit(None).cast("double")
    out = placed(values.withColumn("share", share), [by, F.col("member")], running={"cumulative_share": "share"}, dense=("rank", "value"), most=most, cheap=True)
    rank = F.col("rank") + F.when(F.col("value").isNull(), F.col("place") - F.col("known") - 1).otherwise(0)
    out = out.select("member", "value", rank.cast("int").alias("rank"), "share", "cumulative_share")
    return out.where(F.col("rank") <= limit) if limit is not None else out


def other_entities(f: Facts, kpi_key: str, dimension: str, time_filter=ALL, order: str = "desc", limit: int = 10, filters: dict | None = None) -> DataFrame:
    """One row: members that ``rank_entities`` leaves out at ``limit``, with their value and share, which only additive KPIs have."""
    rest = rank_entities(f, kpi_key, dimension, time_filter, order, None, filters).where(F.col("rank") > limit)
    value = F.sum("value") if f.kpi(kpi_key).additive else F.lit(None).cast("double")
    return rest.agg(F.count(F.lit(1)).alias("members"), value.alias("value"), F.sum("share").alias("share"))


def dimension_members(f: Facts, scope: tf.TimeFilter | None = None, dimensions: list[str] | None = None, filters: dict | None = None) -> DataFrame:
    """(dimension, member) distinct, for all dimensions in one scan; repeated members go before the shuffle."""
    dims = list(dimensions or f.dimensions)
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("member")) for d in map(f.dimension, dims)])
    return f.rows(set(dims), scope, filters).select(F.explode(pairs).alias("x")).select("x.dimension", "x.member").distinct()


def dimension_sizes(f: Facts) -> DataFrame:
    """(dimension, members): how many members each dimension has; null is none."""
    return dimension_members(f).groupBy("dimension").agg(F.count("member").alias("members"))


def distribution(f: Facts, kpi_key: str, dimension: str, time_filter=ALL, filters: dict | None = None, percentiles: tuple[int, ...] = (10, 25, 50, 75, 90), most: int | None = None) -> DataFrame:
    """One row over members' values: count, extremes, mean, median, robust sigma, spread and exact percentiles."""
    k = f.kpi(kpi_key)
    values = f.sums([k], [f.dimension(dimension)], tf.parse(time_filter), filters).select(k.finish().alias("value")).where("value is not null")
    values, most = kept(values), MOST_AT_ONCE if most is None else most
    cuts = {"median": 0.5, **{f"p{p}": p / 100 for p in percentiles}}
    plain = [F.count(F.lit(1)).alias("members"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean")]
    if values.count() <= most:
        out = values.agg(*plain, F.collect_list("value").alias("all"), *[F.percentile("value", F.lit(p)).alias(k) for k, p in cuts.items()]).withColumn("sigma", robust.sigma(F.col("all"))).drop("all")
    else:
        out = values.agg(*plain).join(quantiles(counted(values, {"value": F.col("value")}), cuts, most), F.lit(True), "left").drop("field")
        out = out.join(spread(values, "value", most, cheap=True).select("sigma"), F.lit(True), "left")
    return out.withColumn("spread", F.col("max") - F.col("min"))


def histogram(f: Facts, kpi_key: str, dimension: str, time_filter=ALL, filters: dict | None = None, bins: int = 10) -> DataFrame:
    """(bin, low, high, members): equal widths from the least to the greatest value, the last bin closed; a constant widens by a half each way."""
    k = f.kpi(kpi_key)
    values = f.sums([k], [f.dimension(dimension)], tf.parse(time_filter), filters).select(k.finish().alias("value")).where("value is not null")
    ends = values.agg(F.min("value").alias("a"), F.max("value").alias("b"))
    ends = ends.select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b")).where("a is not null")
    width = (F.col("b") - F.col("a")) / bins
    counts = values.crossJoin(F.broadcast(ends)).select(F.least(F.floor((F.col("value") - F.col("a")) / width), F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("members"))
    frame = ends.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return frame.join(counts, "bin", "left").select("bin", (F.col("a") + F.col("bin") * width).alias("low"), (F.col("a") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("members", F.lit(0)).alias("members"))


def cross_tabulate(f: Facts, kpi_key: str, dim_a: str, dim_b: str, time_filter=ALL, filters: dict | None = None, limit_a: int | None = None, limit_b: int | None = None) -> DataFrame:
    """(a, b, level, value, rows): cells, row and column totals and the grand total, each finished from its own sums.

    With ``limit_a`` and ``limit_b`` only the rows and columns of the greatest totals stay, by size whatever the sign;
    totals are those of all. The facts are grouped once; the cube is over that grid, and which keys are totals is told by grouping, not by null.
    """
    k = f.kpi(kpi_key)
    grid = f.sums([k], [f.dimension(dim_a), f.dimension(dim_b)], tf.parse(time_filter), filters).select(F.col(dim_a).alias("a"), F.col(dim_b).alias("b"), *k.sum_names(), "rows")
    cube = grid.cube("a", "b").agg(*[F.sum(n).alias(n) for n in k.sum_names()], F.sum("rows").alias("rows"), F.grouping_id().alias("g"))
    level = F.element_at(F.array(*map(F.lit, ("cell", "total_a", "total_b", "total"))), (F.col("g") + 1).cast("int"))
    out = cube.select("a", "b", level.alias("level"), k.finish().alias("value"), "rows")
    for side, limit in (("a", limit_a), ("b", limit_b)):
        if limit is not None:
            totals = out.where(F.col("level") == f"total_{side}").orderBy(F.abs("value").desc_nulls_last(), F.col(side).asc_nulls_last()).limit(limit).select(F.col(side).alias("kept"))
            out = out.join(F.broadcast(totals), F.col(side).eqNullSafe(F.col("kept")), "left").where(F.col("kept").isNotNull() | ~F.col("level").isin("cell", f"total_{side}")).drop("kept")
    return out


def preview(f: Facts, kpi_key: str, last: int = 8) -> DataFrame:
    """(period, value): a KPI in the last quarters held, to four decimals; null where it is undefined."""
    return series(f, [kpi_key]).orderBy(F.desc("ord")).limit(last).select("period", F.round(F.col(kpi_key).cast("double"), 4).alias("value"))
