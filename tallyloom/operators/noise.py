"""Whether a move is more than noise: comparison, significance, ranges, materiality, data quality, trend, changepoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions import robust
from tallyloom.operators.retrieve import ALL, dimension_members, series
from tallyloom.operators.slopes import slopes
from tallyloom.plans import timefilter as tf
from tallyloom.plans.kpi import Kpi
from tallyloom.sources.facts import Facts

#: Robust z and per cent that make a change notable, and earlier changes needed to judge one.
Z, MATERIAL, HISTORY = 2.0, 3.0, 4


def direction(change: Column) -> Column:
    return F.when(change > 0, "up").when(change < 0, "down").when(change == 0, "flat")


def unfavourable(change: Column, k: Kpi) -> Column:
    return F.coalesce(change < 0 if k.higher_is_better else change > 0, F.lit(False))


def compare(f: Facts, kpi_key: str, period_a, period_b, filters: dict | None = None) -> DataFrame:
    """One row: a KPI in two scopes, absolute and relative change, direction. One scan."""
    k = f.kpi(kpi_key)
    sums = f.pair(k, tf.parse(period_a), tf.parse(period_b), filters=filters).select(k.finish("_c").alias("current"), k.finish("_b").alias("baseline"), F.col("rows_c").alias("current_rows"), F.col("rows_b").alias("baseline_rows"))
    change = F.col("current") - F.col("baseline")
    return sums.select("*", change.alias("change"), robust.pct(F.col("current"), F.col("baseline")).alias("change_pct"), direction(change).alias("direction"), unfavourable(change, k).alias("unfavourable"))


def long_series(f: Facts, keys: list[str], grain: str, filters: dict | None = None, time_filter=ALL) -> DataFrame:
    """(kpi, higher_is_better, ord, period, value, rows): the batched series of many KPIs, one below the other."""
    wide = series(f, keys, grain, time_filter, filters)
    pairs = F.array(*[F.struct(F.lit(key).alias("kpi"), F.lit(f.kpi(key).higher_is_better).alias("higher_is_better"), F.col(key).alias("value")) for key in keys])
    return wide.select("ord", "period", "rows", F.explode(pairs).alias("x")).select("x.kpi", "x.higher_is_better", "ord", "period", "x.value", "rows")


def significance(f: Facts, keys: list[str], period: str, grain: str = "quarter", filters: dict | None = None) -> DataFrame:
    """For each KPI, whether its change in a quarter or year is unusual against its own earlier changes.

    Changes are against the period held before; the base value is that of the calendar's previous period. With three or
    more earlier changes of the same quarter, these make the seasonal norm, whose sigma has a floor. Sigmas widen by
    sqrt(1 + 1/n) for a new observation. One scan for all KPIs; the rest is arrays of a KPI's periods.
    """
    now = {"quarter": lambda: (lambda y, q: int(y) * 4 + int(q))(*period.split("-Q")), "year": lambda: int(period)}[grain]()
    points = long_series(f, keys, grain, filters)
    by_time = Window.partitionBy("kpi").orderBy("ord")
    points = points.withColumn("change", robust.pct(F.col("value"), F.lag("value").over(by_time)))
    cycle = 4 if grain == "quarter" else 1
    past = (F.col("ord") < now) & F.col("change").isNotNull()
    same = F.pmod(F.col("ord"), F.lit(cycle)) == now % cycle
    rows = points.groupBy("kpi", "higher_is_better").agg(
        F.collect_list(F.when(past, F.col("change"))).alias("hist"), F.collect_list(F.when(past & same & F.lit(grain == "quarter"), F.col("change"))).alias("season"),
        F.max(F.when(F.col("ord") == now, F.col("value"))).alias("current"), F.max(F.when(F.col("ord") == now - 1, F.col("value"))).alias("baseline"), F.max(F.when(F.col("ord") == now, F.col("change"))).alias("change_pct"),
    )
    rows = rows.withColumns({"s_all": robust.sigma(F.col("hist")), "s_season": robust.sigma(F.col("season"))})
    seasonal = (F.size("season") >= 3) & (F.col("s_season") > 0)
    rows = rows.withColumn("seasonal", F.coalesce(seasonal, F.lit(False)))
    n = F.when(F.col("seasonal"), F.size("season")).otherwise(F.size("hist"))
    wide = F.when(F.col("seasonal"), F.col("s_season")).otherwise(F.col("s_all")) * F.sqrt(1 + F.try_divide(F.lit(1.0), n))
    floor = F.greatest(F.lit(0.75), 0.5 * F.col("s_all"))
    rows = rows.withColumn("norm", F.when(F.col("seasonal"), robust.median(F.col("season"))).otherwise(robust.median(F.col("hist")))).withColumn("sigma", F.when(F.col("seasonal"), F.greatest(wide, floor)).otherwise(wide))
    enough = F.col("current").isNotNull() & (F.size("hist") >= HISTORY)
    z = F.when(enough, F.try_divide(F.col("change_pct") - F.col("norm"), F.col("sigma")))
    rows = rows.withColumns({"z": z, "expected": F.when(enough, F.col("baseline") * (1 + F.col("norm") / 100))})
    unusual, material = F.abs("z") >= Z, F.abs("change_pct") >= MATERIAL
    verdict = F.when(F.col("current").isNull(), "newly_launched").when(F.size("hist") < HISTORY, "sparse_history").when(unusual & material, "meaningful_signal").when(unusual, "statistically_unusual_but_immaterial").otherwise("within_normal_variation")
    method = F.when(~enough, "insufficient_history").when(F.col("seasonal"), "seasonal").otherwise("sequential")
    return rows.select("kpi", "current", "baseline", "change_pct", F.size("hist").cast("long").alias("history"), "seasonal", F.when(enough, F.col("norm")).alias("norm"), F.when(enough, F.col("sigma")).alias("sigma"), "z", "expected", verdict.alias("verdict"), method.alias("method"), "higher_is_better")


def normal_range(f: Facts, keys: list[str], grain: str = "week", filters: dict | None = None, k_sigma: float = 2.0, min_points: int = 8) -> DataFrame:
    """For each KPI the bands, median plus and minus k robust sigmas, of its levels and of its changes."""
    points = long_series(f, keys, grain, filters).where("value is not null")
    points = points.withColumn("change", robust.pct(F.col("value"), F.lag("value").over(Window.partitionBy("kpi").orderBy("ord"))))
    rows = points.groupBy("kpi").agg(F.count(F.lit(1)).alias("points"), F.collect_list("value").alias("v"), F.collect_list("change").alias("c"))
    enough = F.col("points") >= min_points
    out = {}
    for name, column in (("level", "v"), ("change", "c")):
        centre, spread = robust.median(F.col(column)), robust.sigma(F.col(column))
        out |= {f"{name}_median": F.when(enough, centre), f"{name}_sigma": F.when(enough, spread), f"{name}_low": F.when(enough, centre - k_sigma * spread), f"{name}_high": F.when(enough, centre + k_sigma * spread)}
    return rows.select("kpi", "points", *[c.alias(a) for a, c in out.items()], F.when(enough, "ok").otherwise("insufficient_history").alias("status"))


def filter_material(changes: DataFrame, min_pct: float = MATERIAL, min_z: float = Z) -> DataFrame:
    """``changes(change_pct, z, ...)`` with material, basis and, for what is not, the reason."""
    small, weak = F.abs("change_pct") < min_pct, F.col("z").isNotNull() & (F.abs("z") < min_z)
    reason = F.when(F.col("change_pct").isNull(), "no_change").when(small, "below_pct").when(weak, "below_z")
    basis = F.when(F.col("z").isNotNull(), "magnitude_and_significance").otherwise("magnitude_only")
    return changes.withColumn("reason", reason).withColumn("material", F.col("reason").isNull()).withColumn("basis", basis)


def data_quality(f: Facts, time_filter, baseline=None, dimension: str | None = None, filters: dict | None = None) -> DataFrame:
    """One row: rows and distinct dates of a scope and its baseline, their ratio, and members that came or went."""
    a = tf.parse(time_filter).bind(f.load(set()))
    b = tf.parse(baseline).bind(f.load(set())) if baseline is not None else tf.previous(a) or a
    tests = {"current": a.predicate(F.col("date")), "baseline": b.predicate(F.col("date"))}
    rows = f.rows({dimension} if dimension else set(), tests["current"] | tests["baseline"], filters)
    days = [F.count_distinct(F.when(t, F.col("date").cast("date"))).alias(f"{n}_dates") for n, t in tests.items()]
    counts = [F.count(F.when(t, 1)).alias(f"{n}_rows") for n, t in tests.items()]
    out = rows.agg(*counts, *days).withColumn("window_ratio", F.try_divide(F.col("current_dates"), F.col("baseline_dates"))).withColumn("balanced", F.coalesce(F.abs(F.col("window_ratio") - 1) <= 0.1, F.lit(False))).withColumn("row_change_pct", robust.pct(F.col("current_rows"), F.col("baseline_rows")))
    if dimension:
        held = rows.groupBy(dimension).agg(*[F.count(F.when(t, 1)).alias(n) for n, t in tests.items()])
        moved = held.agg(F.count(F.when((F.col("current") > 0) & (F.col("baseline") == 0), 1)).alias("appeared"), F.count(F.when((F.col("current") == 0) & (F.col("baseline") > 0), 1)).alias("disappeared"))
        out = out.crossJoin(moved)
    return out


def quality_columns(f: Facts, time_filter=ALL, filters: dict | None = None) -> DataFrame:
    """(column, rows, zero_rows, null_rows) of every measure in a scope, from one scan."""
    wide = f.rows(set(f.measures), tf.parse(time_filter), filters).agg(F.count(F.lit(1)).alias("rows"), *[F.struct(F.count(F.when(F.col(m) == 0, 1)).alias("z"), F.count(F.when(F.col(m).isNull(), 1)).alias("n")).alias(m) for m in f.measures])
    return wide.select("rows", F.explode(F.array(*[F.struct(F.lit(m).alias("column"), F.col(m).alias("c")) for m in f.measures])).alias("x")).select("x.column", "rows", F.col("x.c.z").alias("zero_rows"), F.col("x.c.n").alias("null_rows"))


def quality_dimensions(f: Facts, time_filter, baseline, filters: dict | None = None, named: int = 10) -> DataFrame:
    """(dimension, current_members, baseline_members, appeared, disappeared): members of every dimension in two scopes,
    and the first ``named`` by name of those that came and went. One scan; what is gathered is the names shown."""
    held = {}
    for side, scope in (("current", time_filter), ("baseline", baseline)):
        held[side] = dimension_members(f, tf.parse(scope), None, filters).where("member is not null").withColumn(side, F.lit(1))
    met = held["current"].join(held["baseline"], ["dimension", "member"], "full_outer")
    state = F.when(F.col("baseline").isNull(), "appeared").when(F.col("current").isNull(), "disappeared").otherwise("both")
    placed = met.withColumn("state", state).withColumn("place", F.row_number().over(Window.partitionBy("dimension", "state").orderBy("member")))
    names = lambda s: F.sort_array(F.collect_list(F.when((F.col("state") == s) & (F.col("place") <= named), F.col("member")))).alias(s)
    return placed.groupBy("dimension").agg(F.count("current").alias("current_members"), F.count("baseline").alias("baseline_members"), names("appeared"), names("disappeared"))


def trend(f: Facts, keys: list[str], grain: str = "quarter", time_filter=ALL, filters: dict | None = None, min_points: int = 5) -> DataFrame:
    """Theil and Sen's line for each KPI: the median slope over all pairs of periods, without listing them for weeks and days."""
    points = long_series(f, keys, grain, filters, time_filter).where("value is not null").select("kpi", "higher_is_better", "ord", "value")
    met = points.join(slopes(points, grain), "kpi", "left")
    rows = met.groupBy("kpi", "higher_is_better", "slope").agg(F.count(F.lit(1)).alias("points"), F.median(F.col("value") - F.col("slope") * F.col("ord")).alias("intercept"), F.median("value").alias("level"), F.min("ord").alias("a"), F.max("ord").alias("b"), F.sort_array(F.collect_list(F.struct("ord", "value"))).alias("all"))
    away = F.transform("all", lambda p: p["value"] - F.col("slope") * p["ord"])
    total = F.try_divide(F.col("slope") * (F.col("b") - F.col("a")), F.abs("level")) * 100
    rising = F.when(F.abs(total) < MATERIAL, "flat").when(total > 0, "rising").otherwise("falling")
    good = F.when(rising == "flat", F.lit(None)).otherwise((rising == "rising") == F.col("higher_is_better"))
    enough = F.col("points") >= min_points
    return rows.select("kpi", "points", *[F.when(enough, c).alias(n) for n, c in (("slope", F.col("slope")), ("intercept", F.col("intercept")), ("residual_sigma", robust.sigma(away)), ("total_pct", total), ("direction", rising), ("improving", good))], F.when(enough, "ok").otherwise("insufficient").alias("status"))


def changepoint(f: Facts, keys: list[str], grain: str = "week", time_filter=ALL, filters: dict | None = None, direction: str = "any", baseline_periods: int = 8, persistence: int = 2, k_sigma: float = 1.0) -> DataFrame:
    """For each KPI the first of ``persistence`` periods in a row outside its first periods' median by k sigmas, up or down.

    Sigma is the scaled deviation, else the standard deviation, else a twentieth of the median's size.
    """
    points = long_series(f, keys, grain, filters, time_filter).where("value is not null")
    by_time = Window.partitionBy("kpi").orderBy("ord")
    points = points.withColumn("i", F.row_number().over(by_time))
    base = points.where(F.col("i") <= baseline_periods).groupBy("kpi").agg(F.collect_list("value").alias("v"))
    scaled, plain = robust.mad(F.col("v")) * robust.MAD_SCALE, F.coalesce(robust.deviation(F.col("v")), F.lit(0.0))
    base = base.select("kpi", robust.median(F.col("v")).alias("centre"), F.when(scaled > robust.TINY, scaled).when(plain > robust.TINY, plain).otherwise(0.05 * F.abs(robust.median(F.col("v")))).alias("spread"))
    ahead = by_time.rowsBetween(0, persistence - 1)
    met = points.join(base, "kpi")
    for name, test in (("up", F.col("value") > F.col("centre") + k_sigma * F.col("spread")), ("down", F.col("value") < F.col("centre") - k_sigma * F.col("spread"))):
        met = met.withColumn(name, (F.min(test.cast("int")).over(ahead) == 1) & (F.count(F.lit(1)).over(ahead) == persistence) & (F.col("i") > baseline_periods) & F.lit(direction in ("any", name)))
    first = lambda name: F.min(F.when(F.col(name), F.struct("ord", "period")))
    rows = met.groupBy("kpi", "centre", "spread").agg(F.count(F.lit(1)).alias("points"), first("up").alias("u"), first("down").alias("d"))
    onset = F.when(F.col("u").isNull() | (F.col("d.ord") < F.col("u.ord")), F.col("d")).otherwise(F.col("u"))
    way = F.when(onset.isNull(), None).when(F.col("u").isNull() | (F.col("d.ord") < F.col("u.ord")), "down").otherwise("up")
    status = F.when(F.col("points") <= baseline_periods, "insufficient_history").when(F.col("spread") <= 0, "degenerate_dispersion").when(onset.isNull(), "no_changepoint").otherwise("ok")
    return rows.select("kpi", "points", "centre", "spread", onset["period"].alias("onset"), onset["ord"].alias("onset_ord"), way.alias("direction"), status.alias("status"))
