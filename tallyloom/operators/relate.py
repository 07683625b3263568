"""How two KPIs move together: correlation, lags, onsets, consistency, holdouts, seasonality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.errors import InvalidArgument
from tallyloom.functions import robust
from tallyloom.operators import moments
from tallyloom.operators.noise import MATERIAL, changepoint, long_series
from tallyloom.operators.retrieve import ALL, series
from tallyloom.operators.slopes import slopes
from tallyloom.plans import timefilter as tf
from tallyloom.sources.facts import Facts

#: Fixed value: periods in a year of each grain that seasonality is looked for in.
CYCLES = {"quarter": 4, "month": 12, "week": 52}
#: The autocorrelation at a year from which a series counts as seasonal, years of history that a season
#: takes, and points of a phase that it is compared with.
LEAST_ACF, LEAST_CYCLES, LEAST_POINTS = 0.30, 2, 3
#: Members in both periods that a dimension has to have to be picked, and the part of what was searched in
#: which an onset is at the edge.
SHARED, AT_EDGE = (3, 200), 0.2


def member_changes(f: Facts, keys: list[str], dimension: str, period_a, period_b, filters: dict | None = None) -> DataFrame:
    """(member, key...): each KPI's change in per cent by member, all KPIs in one scan."""
    kpis = [f.kpi(k) for k in keys]
    wide = f.pair(kpis[0], tf.parse(period_a), tf.parse(period_b), [f.dimension(dimension)], filters, kpis[1:])
    return wide.select(F.col(dimension).alias("member"), *[robust.pct(k.finish("_c"), k.finish("_b")).alias(k.key) for k in kpis])


def period_changes(f: Facts, keys: list[str], grain: str = "quarter", time_filter=ALL, filters: dict | None = None) -> DataFrame:
    """(ord, period, key...): each KPI's change in per cent from the calendar's previous period, where that is held."""
    points, by_time = series(f, keys, grain, time_filter, filters), Window.orderBy("ord")
    next_door = F.col("ord") - F.lag("ord").over(by_time) == 1
    return points.select("ord", "period", *[F.when(next_door, robust.pct(F.col(k), F.lag(k).over(by_time))).alias(k) for k in keys])


def sample(f: Facts, keys: list[str], mode: str = "cross_sectional", period_a=None, period_b=None, dimension: str | None = None, time_filter=ALL, grain: str = "quarter", filters: dict | None = None) -> DataFrame:
    """Aligned changes of several KPIs, over members or over periods."""
    if mode == "time_series":
        return period_changes(f, keys, grain, time_filter, filters).drop("period").withColumnRenamed("ord", "entity")
    return member_changes(f, keys, dimension or f.dimensions[0], period_a, period_b, filters).withColumnRenamed("member", "entity")


def correlations(f: Facts, kpi_key: str, others: list[str], min_n: int = 6, **scope) -> DataFrame:
    """(other, n, r, status): Pearson's r of a KPI's changes with each of the others', over pairs where both are known."""
    rows = sample(f, [kpi_key, *others], **scope)
    pairs = F.array(*[F.struct(F.lit(o).alias("other"), F.col(kpi_key).alias("x"), F.col(o).alias("y")) for o in others])
    pairs = rows.select(F.explode(pairs).alias("p")).select("p.other", "p.x", "p.y").where("x is not null and y is not null")
    found = pairs.groupBy("other").agg(F.count(F.lit(1)).alias("n"), robust.correlation(F.col("x"), F.col("y")).alias("r"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    status = F.when(F.col("n") < min_n, "insufficient_n").when(F.col("vx") <= 1e-12, "constant_a").when(F.col("vy") <= 1e-12, "constant_b").otherwise("ok")
    return found.select("other", "n", F.when(status == "ok", F.col("r")).alias("r"), status.alias("status"))


def lagged(f: Facts, kpi_key: str, cause_kpi: str, grain: str = "week", max_lag: int = 5, time_filter=ALL, filters: dict | None = None, min_n: int = 8) -> DataFrame:
    """(lag, n, r): correlation of first differences of a KPI and of a cause ``lag`` periods before; positive lags: the cause leads."""
    points, by_time = series(f, [kpi_key, cause_kpi], grain, time_filter, filters), Window.orderBy("ord")
    near = F.col("ord") - F.lag("ord").over(by_time) == 1
    moves = points.select("ord", *[F.when(near, F.col(k) - F.lag(k).over(by_time)).alias(a) for k, a in ((kpi_key, "y"), (cause_kpi, "x"))])
    causes = moves.where("x is not null").select("ord", "x", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag")).select((F.col("ord") + F.col("lag")).alias("t"), F.col("lag").cast("long").alias("lag"), "x")
    met = moves.where("y is not null").select(F.col("ord").alias("t"), "y").join(causes, "t")
    found = met.groupBy("lag").agg(F.count(F.lit(1)).alias("n"), robust.correlation(F.col("x"), F.col("y")).alias("r"))
    return found.select("lag", "n", F.when(F.col("n") >= min_n, F.col("r")).alias("r"))


def best_lag(lags: DataFrame) -> DataFrame:
    """The lag of the strongest correlation; of ties the shorter, then the earlier."""
    known = lags.where("r is not null").orderBy(F.abs("r").desc(), F.abs("lag"), "lag").limit(1)
    verdict = F.when(F.col("lag") > 0, "cause_leads").when(F.col("lag") < 0, "kpi_leads").otherwise("simultaneous")
    return known.select("lag", "n", "r", verdict.alias("verdict"))


def shared_members(f: Facts, period_a, period_b, filters: dict | None = None) -> DataFrame:
    """(dimension, shared): how many members each dimension has in both of two periods, within filters; one scan for all dimensions.

    Null is no member; a dimension without a shared one has a row of 0 as long as it has any member in the two periods.
    """
    anchor = f.load(set())
    tests = [tf.parse(p).bind(anchor).predicate(F.col("date")) for p in (period_a, period_b)]
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("member")) for d in f.dimensions])
    rows = f.rows(set(f.dimensions), tests[0] | tests[1], filters).withColumn("x", F.explode(pairs)).select("date", "x.dimension", "x.member").where("member is not null")
    held = rows.groupBy("dimension", "member").agg(*[F.max(t.cast("int")).alias(f"in_{k}") for k, t in enumerate(tests)])
    return held.groupBy("dimension").agg(F.sum(F.col("in_0") * F.col("in_1")).cast("long").alias("shared"))


def usable_dimension(f: Facts, period_a, period_b, filters: dict | None = None) -> str:
    """The dimension of most members shared by two periods, of equal ones the first by name; it has to have some and not very many."""
    found = shared_members(f, period_a, period_b, filters).where(F.col("shared").between(*SHARED)).orderBy(F.desc("shared"), "dimension").first()
    if found is None:
        raise InvalidArgument(f"no dimension has from {SHARED[0]} to {SHARED[1]} members in both periods, within the filters")
    return found["dimension"]


def precedence(f: Facts, kpi_key: str, cause_kpi: str, grain: str = "week", time_filter=ALL, filters: dict | None = None, kpi_direction: str = "any", cause_direction: str = "any", baseline_periods: int = 8, persistence: int = 2, k_sigma: float = 1.0) -> DataFrame:
    """One row: when each of two KPIs first left its early range, and by how many periods the cause was ahead.

    ``gaps_between``: periods between the two that hold no rows. ``kpi_at_edge`` and ``cause_at_edge``: the onset comes so
    early in what was searched that the move may have begun before it. ``searched``: periods that hold rows.
    """
    ways = {kpi_key: kpi_direction, cause_kpi: cause_direction}
    if not set(ways.values()) <= {"any", "up", "down"}:
        raise InvalidArgument("a direction is any, up or down")
    of = lambda way: changepoint(f, [k for k in ways if ways[k] == way], grain, time_filter, filters, way, baseline_periods, persistence, k_sigma)
    found = reduce(DataFrame.unionByName, [of(way) for way in sorted(set(ways.values()))])
    at = lambda key, c: F.max(F.when(F.col("kpi") == key, F.col(c)))
    rows = found.agg(at(kpi_key, "onset").alias("kpi_onset"), at(cause_kpi, "onset").alias("cause_onset"), at(kpi_key, "onset_ord").alias("k"), at(cause_kpi, "onset_ord").alias("c"))
    lo, hi = F.least("k", "c"), F.greatest("k", "c")
    periods = series(f, [kpi_key, cause_kpi], grain, time_filter, filters).crossJoin(F.broadcast(rows.select("k", "c")))
    first = lambda key: F.min(F.when(F.col(key).isNotNull(), F.col("ord")))
    span = periods.agg(F.count(F.lit(1)).alias("searched"), first(kpi_key).alias("k0"), first(cause_kpi).alias("c0"), F.count(F.when((F.col("ord") > lo) & (F.col("ord") < hi), 1)).alias("between"))
    rows = rows.crossJoin(F.broadcast(span)).withColumn("lag", F.col("k") - F.col("c"))
    edge = lambda o, start: (F.col(o) - F.col(start) < baseline_periods + persistence) | (F.col(o) - F.col(start) < AT_EDGE * F.col("searched"))
    none = F.col("kpi_onset").isNull(), F.col("cause_onset").isNull()
    status = F.when(none[0] & none[1], "both_undetermined").when(none[0], "kpi_undetermined").when(none[1], "cause_undetermined").otherwise("ok")
    verdict = F.when(F.col("lag") > 0, "cause_precedes_kpi").when(F.col("lag") < 0, "kpi_precedes_cause").when(F.col("lag") == 0, "simultaneous")
    gaps = F.when(F.coalesce(F.col("lag") != 0, F.lit(False)), F.abs("lag") - 1 - F.col("between")).otherwise(0).cast("long")
    return rows.select("kpi_onset", "cause_onset", "lag", status.alias("status"), verdict.alias("verdict"), gaps.alias("gaps_between"), edge("k", "k0").alias("kpi_at_edge"), edge("c", "c0").alias("cause_at_edge"), "searched")


def consistency(f: Facts, kpi_key: str, cause_kpi: str, dimension: str, period_a, period_b, filters: dict | None = None, move_pct: float = MATERIAL) -> DataFrame:
    """(member, kpi_pct, cause_pct, bucket): whether a KPI and a cause moved the same way in each member."""
    rows = member_changes(f, [kpi_key, cause_kpi], dimension, period_a, period_b, filters).select("member", F.col(kpi_key).alias("kpi_pct"), F.col(cause_kpi).alias("cause_pct"))
    still = lambda c: F.abs(c) < move_pct
    bucket = F.when(F.col("kpi_pct").isNull() | F.col("cause_pct").isNull(), "undetermined").when(still("cause_pct"), "cause_flat").when(still("kpi_pct"), "kpi_flat").when(F.signum("kpi_pct") == F.signum("cause_pct"), "same_sign").otherwise("opposite_sign")
    return rows.withColumn("bucket", bucket)


def consistency_rate(members: DataFrame, min_n: int = 3) -> DataFrame:
    """One row: members that moved the same and the opposite way, the rate, its strength |2 rate - 1|, and r over all."""
    count = lambda b: F.count(F.when(F.col("bucket") == b, 1))
    rows = members.agg(count("same_sign").alias("same"), count("opposite_sign").alias("opposite"), robust.correlation(F.col("kpi_pct"), F.col("cause_pct")).alias("r"))
    n = F.col("same") + F.col("opposite")
    rate = F.try_divide(F.col("same"), n)
    return rows.select("same", "opposite", rate.alias("rate"), F.abs(2 * rate - 1).alias("strength"), "r", F.when(n < min_n, "insufficient_members").otherwise("ok").alias("status"))


def _moved(change: Column, direction: str, least: float) -> Column:
    return {"any": F.abs(change) >= least, "up": change >= least, "down": change <= -least}[direction]


def counterexamples(f: Facts, kpi_key: str, cause_kpi: str, dimension: str, period_a, period_b, filters: dict | None = None, kpi_move_pct: float = MATERIAL, cause_move_pct: float = MATERIAL, cause_direction: str = "any") -> DataFrame:
    """Members whose KPI got worse although the cause did not move."""
    rows = member_changes(f, [kpi_key, cause_kpi], dimension, period_a, period_b, filters).select("member", F.col(kpi_key).alias("kpi_pct"), F.col(cause_kpi).alias("cause_pct"))
    worse = F.col("kpi_pct") <= -kpi_move_pct if f.kpi(kpi_key).higher_is_better else F.col("kpi_pct") >= kpi_move_pct
    return rows.where(worse & F.col("cause_pct").isNotNull() & ~_moved(F.col("cause_pct"), cause_direction, cause_move_pct))


def holdout(f: Facts, kpi_key: str, cause_kpi: str, dimension: str, period_a, period_b, filters: dict | None = None, cause_move_pct: float = MATERIAL, cause_direction: str = "any") -> DataFrame:
    """One row: the KPI's change in members where the cause moved and where it did not, and the difference of the two.

    Both sides are finished from summed components, so a ratio is that of the whole side."""
    k, c = f.kpi(kpi_key), f.kpi(cause_kpi)
    sums = f.pair(k, tf.parse(period_a), tf.parse(period_b), [f.dimension(dimension)], filters, [c])
    hit = F.coalesce(_moved(robust.pct(c.finish("_c"), c.finish("_b")), cause_direction, cause_move_pct), F.lit(False))
    names = [n for s in ("_c", "_b") for n in k.sum_names(s)]
    sides = sums.withColumn("hit", hit).groupBy("hit").agg(*[F.sum(n).alias(n) for n in names], F.count(F.lit(1)).alias("members"))
    sides = sides.select("hit", "members", robust.pct(k.finish("_c"), k.finish("_b")).alias("change_pct"))
    of = lambda h, n: F.max(F.when(F.col("hit") == h, F.col(n)))
    rows = sides.agg(F.coalesce(of(True, "members"), F.lit(0)).alias("affected"), F.coalesce(of(False, "members"), F.lit(0)).alias("unaffected"), of(True, "change_pct").alias("affected_pct"), of(False, "change_pct").alias("unaffected_pct"))
    gap = F.col("affected_pct") - F.col("unaffected_pct")
    status = F.when(F.col("affected") == 0, "no_affected_members").when(F.col("unaffected") == 0, "no_unaffected_members").otherwise("ok")
    bad = F.col("affected_pct") <= -MATERIAL if k.higher_is_better else F.col("affected_pct") >= MATERIAL
    also = F.col("unaffected_pct") <= -MATERIAL if k.higher_is_better else F.col("unaffected_pct") >= MATERIAL
    verdict = F.when(status != "ok", "undetermined").when(bad & ~also, "cause_explains_the_gap").when(also, "kpi_moved_regardless").otherwise("undetermined")
    return rows.select("*", gap.alias("difference_pct"), status.alias("status"), verdict.alias("verdict"))


def line(points: DataFrame, grain: str = "quarter") -> DataFrame:
    """``points(ord, value)`` with slope and intercept of Theil and Sen's line."""
    slope = slopes(points.select(F.lit("").alias("kpi"), "ord", "value"), grain).agg(F.max("slope").alias("slope"))
    met = points.crossJoin(F.broadcast(slope))
    level = met.agg(F.median(F.col("value") - F.col("slope") * F.col("ord")).alias("intercept"))
    return met.crossJoin(F.broadcast(level))


def _phase(grain: str) -> Column:
    return (F.weekofyear(F.to_date("period")) if grain == "week" else F.pmod(F.col("ord") - 1, F.lit(CYCLES[grain])) + 1).cast("int")


def seasonal_points(f: Facts, kpi_key: str, grain: str = "quarter", filters: dict | None = None) -> DataFrame:
    """(ord, period, value, phase, trend, away, points, effect, left_out) of every period held: the trend, what is away
    from it, its phase's number of points and effect, and that effect from the phase's other points alone.

    Effects are the phases' medians, centred on the median of these.
    """
    points = line(long_series(f, [kpi_key], grain, filters).where("value is not null").select("ord", "period", "value"), grain)
    trend = F.col("intercept") + F.col("slope") * F.col("ord")
    away = points.select("ord", "period", "value", _phase(grain).alias("phase"), trend.alias("trend"), (F.col("value") - trend).alias("away"))
    medians = away.groupBy("phase").agg(F.count(F.lit(1)).alias("points"), F.median("away").alias("m"), F.collect_list(F.struct("ord", "away")).alias("peers"))
    met = away.join(medians, "phase").crossJoin(F.broadcast(medians.agg(F.median("m").alias("centre"))))
    others = F.transform(F.filter("peers", lambda p: p["ord"] != F.col("ord")), lambda p: p["away"])
    return met.select("ord", "period", "value", "phase", "trend", "away", "points", (F.col("m") - F.col("centre")).alias("effect"), F.coalesce(robust.median(others) - F.col("centre"), F.lit(0.0)).alias("left_out"))


def seasonal_phases(f: Facts, kpi_key: str, grain: str = "quarter", filters: dict | None = None) -> DataFrame:
    """(phase, points, effect): the medians of a detrended series by phase of the year, centred on their median."""
    return seasonal_points(f, kpi_key, grain, filters).select("phase", "points", "effect").distinct()


def seasonal_strength(f: Facts, kpi_key: str, grain: str = "quarter", filters: dict | None = None) -> DataFrame:
    """One row: points, robust sigma about the trend and about trend and season, and the season's strength.

    Strength is 1 less what remains of the trend's sigma when each point's season comes from the other points of its
    phase, so that noise does not look like a season; never below nil."""
    listed = seasonal_points(f, kpi_key, grain, filters).agg(F.count(F.lit(1)).alias("points"), F.collect_list("away").alias("a"), F.collect_list(F.col("away") - F.col("left_out")).alias("o"), F.collect_list(F.col("away") - F.col("effect")).alias("r"))
    sigmas = listed.select("points", robust.sigma(F.col("a")).alias("trend_sigma"), robust.sigma(F.col("o")).alias("out_sigma"), robust.sigma(F.col("r")).alias("residual_sigma"))
    return sigmas.select("points", "trend_sigma", "residual_sigma", F.greatest(F.lit(0.0), 1 - F.try_divide(F.col("out_sigma"), F.col("trend_sigma"))).alias("strength"))


def seasonal_norm(f: Facts, kpi_key: str, time_filter, grain: str = "quarter", filters: dict | None = None, k_sigma: float = 2.0) -> DataFrame:
    """A row for each period of ``time_filter``, which should be one: its value against trend and season over all periods held."""
    wanted = series(f, [kpi_key], grain, time_filter, filters).select("ord")
    strength, acf = seasonal_strength(f, kpi_key, grain, filters), autocorrelation(f, kpi_key, grain, filters).select("acf")
    rows = seasonal_points(f, kpi_key, grain, filters).join(F.broadcast(wanted), "ord", "left_semi").crossJoin(F.broadcast(strength.select("residual_sigma", "strength"))).crossJoin(F.broadcast(acf))
    expected, sigma = F.col("trend") + F.col("effect"), F.col("residual_sigma")
    rows = rows.withColumn("expected", expected).withColumn("deviation_abs", F.col("value") - F.col("expected"))
    z = F.when(sigma > 0, F.col("deviation_abs") / sigma)
    normal = F.when(sigma > 0, F.abs(z) < k_sigma).otherwise(F.abs("deviation_abs") < 1e-9)
    return rows.select(
        "period", "phase", F.col("points").alias("phase_points"), F.col("value").alias("actual"), F.col("trend").alias("trend_level"), F.col("effect").alias("seasonal_index"), "expected", "deviation_abs",
        robust.pct(F.col("value"), F.col("expected")).alias("deviation_pct"), z.alias("robust_z"), (F.col("expected") - k_sigma * sigma).alias("lower"), (F.col("expected") + k_sigma * sigma).alias("upper"),
        normal.alias("is_normal_for_phase"), (F.col("acf") >= LEAST_ACF).alias("is_seasonal"), F.col("strength").alias("seasonal_strength"),
    )


def autocorrelation(f: Facts, kpi_key: str, grain: str = "quarter", filters: dict | None = None) -> DataFrame:
    """One row: the autocorrelation at one year of the detrended series."""
    points = line(long_series(f, [kpi_key], grain, filters).where("value is not null").select("ord", "value"), grain)
    away = points.select("ord", (F.col("value") - F.col("slope") * F.col("ord")).alias("away"))
    away = away.withColumn("away", F.col("away") - F.avg("away").over(Window.partitionBy()))
    lag = away.alias("p").join(away.alias("q"), F.col("q.ord") == F.col("p.ord") - CYCLES[grain], "left")
    return lag.agg(F.count(F.lit(1)).alias("points"), F.try_divide(F.sum(F.col("p.away") * F.col("q.away")), F.sum(F.col("p.away") * F.col("p.away"))).alias("acf"))


def left_out(f: Facts, kpi_key: str, cause_kpi: str, dimension: str, period_a, period_b, filters: dict | None = None) -> DataFrame:
    """(member, r_without): the correlation over all members but one, from the sums less its own terms."""
    rows = sample(f, [kpi_key, cause_kpi], dimension=dimension, period_a=period_a, period_b=period_b, filters=filters)
    return moments.left_out(rows, cause_kpi, kpi_key).withColumnRenamed("entity", "member")


def short(series_like: DataFrame, key: str) -> list[tuple[int, float]]:
    """A series of one KPI on the driver: a few hundred periods at most."""
    return sorted((r["ord"], r[key]) for r in series_like.select("ord", key).collect() if r[key] is not None)
