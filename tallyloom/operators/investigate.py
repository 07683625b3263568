"""What a move is made of: decomposition, attribution, bridges, concentration, segments and cohorts."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.errors import InvalidArgument
from tallyloom.functions import formula, robust
from tallyloom.operators.noise import MATERIAL, unfavourable
from tallyloom.operators.order import placed, spread, totals
from tallyloom.operators.retrieve import ALL
from tallyloom.plans import timefilter as tf
from tallyloom.sources.facts import Facts
from tallyloom.sources.scratch import kept

#: Over-index and contribution that make a member stand out, and dimensions of an exact attribution.
OVER_INDEX, MOST_DIMENSIONS = 1.2, 8


def by_member(f: Facts, kpi_key: str, dimension: str, period_a, period_b, filters: dict | None = None) -> DataFrame:
    """(member, current, baseline, change, change_pct, effect, rate, mix, contribution_pct, baseline_share, over_index).

    Additive KPIs: a member's effect is its change. Ratios: rate effect at the current weight plus mix effect at the
    baseline's value; both add up to the total change exactly, and a side that is missing counts as 0. Means have a
    change for each member but no effects. One scan for both periods; totals are aggregated apart.
    """
    k = f.kpi(kpi_key)
    sums = f.pair(k, tf.parse(period_a), tf.parse(period_b), [f.dimension(dimension)], filters).withColumnRenamed(dimension, "member")
    return _decomposed(k, sums, [])


def by_members(f: Facts, kpi_key: str, dimensions: list[str], period_a, period_b, filters: dict | None = None) -> DataFrame:
    """(dimension, ...): ``by_member`` of several dimensions, from one scan however many they are."""
    k, anchor = f.kpi(kpi_key), f.load(set())
    tests = {s: tf.parse(p).bind(anchor).predicate(F.col("date")) for s, p in (("_c", period_a), ("_b", period_b))}
    rows = _by_dimension(f, k, dimensions, tests["_c"] | tests["_b"], filters)
    sums = rows.groupBy("dimension", "member").agg(*[x for s, t in tests.items() for x in k.sums(t, s)])
    return _decomposed(k, sums, ["dimension"])


def _by_dimension(f: Facts, k, dimensions: list[str], scope, filters: dict | None = None) -> DataFrame:
    """The facts once for each dimension with its name and member; partial sums shrink them before any shuffle."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("member")) for d in map(f.dimension, dimensions)])
    return f.rows(set(dimensions) | k.fields(), scope, filters).withColumn("x", F.explode(pairs)).select("date", *sorted(k.fields()), "x.dimension", "x.member")


def _decomposed(k, sums: DataFrame, within: list[str]) -> DataFrame:
    sums = sums.withColumns({"current": k.finish("_c"), "baseline": k.finish("_b")})
    if k.additive:
        effect = F.coalesce("current", F.lit(0.0)) - F.coalesce("baseline", F.lit(0.0))
        sums = sums.withColumns({"rate": F.lit(None).cast("double"), "mix": F.lit(None).cast("double"), "effect": effect})
        sums = totals(sums, within, whole_b=F.sum("baseline"), moved=F.sum("effect")).withColumn("share_b", F.try_divide(F.col("baseline"), F.col("whole_b")) * 100)
    elif k.kind == "ratio":
        d = {s: F.coalesce(F.col(f"{k.key}__d{s}"), F.lit(0.0)) for s in ("_c", "_b")}
        sums = totals(sums, within, whole_c=F.sum(d["_c"]), whole_b=F.sum(d["_b"]))
        weight = {s: F.coalesce(F.try_divide(d[s], F.col(f"whole{s}")), F.lit(0.0)) for s in d}
        r = {"_c": F.coalesce("current", F.lit(0.0)), "_b": F.coalesce("baseline", F.lit(0.0))}
        sums = sums.withColumns({"rate": weight["_c"] * (r["_c"] - r["_b"]), "mix": r["_b"] * (weight["_c"] - weight["_b"]), "share_b": weight["_b"] * 100})
        sums = totals(sums.withColumn("effect", F.col("rate") + F.col("mix")), within, moved=F.sum("effect"))
    else:
        none = F.lit(None).cast("double")
        sums = sums.withColumns({"rate": none, "mix": none, "effect": none, "share_b": none, "moved": none})
    contribution = F.try_divide(F.col("effect"), F.col("moved")) * 100
    out = sums.withColumn("contribution_pct", contribution).withColumn("over_index", F.try_divide(F.col("contribution_pct"), F.col("share_b")))
    change = F.col("current") - F.col("baseline")
    return out.select(*within, "member", "current", "baseline", change.alias("change"), robust.pct(F.col("current"), F.col("baseline")).alias("change_pct"), "effect", "rate", "mix", "contribution_pct", F.col("share_b").alias("baseline_share"), "over_index")


def nested(f: Facts, kpi_key: str, outer_dimension: str, outer_member: str, inner_dimension: str, period_a, period_b, filters: dict | None = None) -> DataFrame:
    """The decomposition by an inner dimension within one member of an outer one."""
    return by_member(f, kpi_key, inner_dimension, period_a, period_b, (filters or {}) | {outer_dimension: outer_member})


def rate_mix(f: Facts, kpi_key: str, dimension: str, period_a, period_b, filters: dict | None = None) -> DataFrame:
    """One row: the summed rate and mix effects of a ratio and its total change."""
    if f.kpi(kpi_key).kind != "ratio":
        raise InvalidArgument(f"{kpi_key} is not a ratio", status="not_a_ratio")
    rows = by_member(f, kpi_key, dimension, period_a, period_b, filters)
    return rows.agg(F.sum("rate").alias("rate_effect"), F.sum("mix").alias("mix_effect"), F.sum("effect").alias("total_change"), F.count(F.lit(1)).alias("members"))


def by_formula(f: Facts, kpi_key: str, period_a, period_b, filters: dict | None = None) -> DataFrame:
    """(component, current, baseline, effect): what each part of the formula does to the change; parts and 'unexplained' add up to it.

    Ratios: numerator at the baseline's denominator, denominator at the baseline's numerator, and their interaction. Sums
    of terms: each term's signed change. Products: each factor at the other's baseline, and the interaction; as the
    KPI sums row products, what the sums of the factors don't explain stays explicit.
    """
    k = f.kpi(kpi_key)
    a, b = tf.parse(period_a), tf.parse(period_b)

    def parts(trees: list[tuple[str, formula.Node]]) -> DataFrame:
        anchor, need = f.load(set()), {c for _, t in trees for c in formula.fields(t)} | k.fields()
        tests = {"c": a.bind(anchor).predicate(F.col("date")), "b": b.bind(anchor).predicate(F.col("date"))}
        own = reduce(lambda x, y: x & y, [x.predicate() for x in k.filters], F.lit(True))
        sums = [F.sum(F.when(t & own, formula.column(tree))).alias(f"{name}_{s}") for s, t in tests.items() for name, tree in trees]
        value = [x for s, t in tests.items() for x in k.sums(t, f"_{s}")]
        return f.rows(need, tests["c"] | tests["b"], filters).agg(*sums, *value)

    def rows(frame: DataFrame, named: list[tuple[str, Column, Column, Column]]) -> DataFrame:
        total = k.finish("_c") - k.finish("_b")
        rest = total - sum((e for *_, e in named[1:]), named[0][3])
        none = F.lit(None).cast("double")
        all_rows = [*named, ("unexplained", none, none, rest)]
        return frame.select(F.explode(F.array(*[F.struct(F.lit(n).alias("component"), c.alias("current"), p.alias("baseline"), e.alias("effect")) for n, c, p, e in all_rows])).alias("x")).select("x.*")

    at = lambda name, s: F.col(f"{name}_{s}")
    if k.kind == "mean":
        raise InvalidArgument("a mean has no additive formula", status="unsupported_formula")
    if k.kind == "ratio":
        frame = parts([("top", k.numerator), ("bottom", k.denominator)])
        ratio = lambda n, d: F.try_divide(at("top", n), at("bottom", d)) * k.scale
        base = ratio("b", "b")
        top, bottom = ratio("c", "b") - base, ratio("b", "c") - base
        return rows(frame, [("numerator", at("top", "c"), at("top", "b"), top), ("denominator", at("bottom", "c"), at("bottom", "b"), bottom), ("interaction", F.lit(None).cast("double"), F.lit(None).cast("double"), ratio("c", "c") - base - top - bottom)])
    own = formula.terms(k.numerator)
    if len(own) > 1:
        frame = parts([(f"t{i}", t) for i, (_, t) in enumerate(own)])
        name = lambda sign, t: ("-" if sign < 0 else "") + "_".join(sorted(formula.fields(t)))
        return rows(frame, [(name(s, t), at(f"t{i}", "c"), at(f"t{i}", "b"), s * (F.coalesce(at(f"t{i}", "c"), F.lit(0.0)) - F.coalesce(at(f"t{i}", "b"), F.lit(0.0)))) for i, (s, t) in enumerate(own)])
    tree = own[0][1]
    if isinstance(tree, formula.Op) and tree.sign == "*":
        frame = parts([("left", tree.left), ("right", tree.right)])
        left, right = at("left", "c") - at("left", "b"), at("right", "c") - at("right", "b")
        none = F.lit(None).cast("double")
        return rows(frame, [("left", at("left", "c"), at("left", "b"), left * at("right", "b")), ("right", at("right", "c"), at("right", "b"), right * at("left", "b")), ("interaction", none, none, left * right)])
    raise InvalidArgument("the formula is a single term", status="single_term")


def price_volume(f: Facts, value: str, volume: str, period_a, period_b, filters: dict | None = None) -> DataFrame:
    """One row: volume effect at the baseline's price, price effect at the current volume; they add up to the change."""
    a, b = f.kpi(value), f.kpi(volume)
    rows = f.pair(a, tf.parse(period_a), tf.parse(period_b), filters=filters, others=[b])
    v = {s: F.col(f"{a.key}__n{s}") for s in ("_c", "_b")}
    q = {s: F.col(f"{b.key}__n{s}") for s in ("_c", "_b")}
    p = {s: F.try_divide(v[s], q[s]) for s in v}
    return rows.select((p["_b"] * (q["_c"] - q["_b"])).alias("volume_effect"), (q["_c"] * (p["_c"] - p["_b"])).alias("price_effect"), (v["_c"] - v["_b"]).alias("change"))


def shapley(f: Facts, kpi_key: str, period_a, period_b, dimensions: list[str] | None = None, filters: dict | None = None) -> DataFrame:
    """(dimension, phi, share_pct): exact Shapley values of the between-group sum of squares of the cells' changes.

    The facts are grouped once into cells over all dimensions; the cube, whose input grows by 2 to the dimensions, is
    over that grid alone. A subset's worth is how far its groups' mean changes spread. All kept and dropped keys are
    told by grouping_id. The 2^n worths are joined with themselves by bit.
    """
    k, dims = f.kpi(kpi_key), [f.dimension(d) for d in (dimensions or f.dimensions)]
    if len(dims) > MOST_DIMENSIONS:
        raise InvalidArgument(f"at most {MOST_DIMENSIONS} dimensions", status="too_many_dimensions")
    cells = f.pair(k, tf.parse(period_a), tf.parse(period_b), dims, filters).select(*dims, (F.coalesce(k.finish("_c"), F.lit(0.0)) - F.coalesce(k.finish("_b"), F.lit(0.0))).alias("delta"))
    return shapley_of(cells, dims)


def shapley_of(cells: DataFrame, dims: list[str]) -> DataFrame:
    """``shapley`` over cells(dims..., delta)."""
    n = len(dims)
    grand = cells.agg(F.avg("delta").alias("mu"))
    groups = cells.cube(*dims).agg(F.count(F.lit(1)).alias("n"), F.avg("delta").alias("mean"), F.grouping_id().alias("gid")).select("gid", "n", "mean")
    kept = F.lit((1 << n) - 1).cast("long") - F.col("gid")
    worth = groups.crossJoin(F.broadcast(grand)).groupBy(kept.alias("kept")).agg(F.sum(F.col("n") * (F.col("mean") - F.col("mu")) * (F.col("mean") - F.col("mu"))).alias("v"))
    bits = F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(1 << (n - 1 - i)).cast("long").alias("bit")) for i, d in enumerate(dims)])
    without = worth.select("kept", "v", F.explode(bits).alias("x")).select("kept", "v", "x.dimension", "x.bit").where(F.col("kept").bitwiseAND(F.col("bit")) == 0)
    weights = F.array(*[F.lit(math.factorial(s) * math.factorial(n - s - 1) / math.factorial(n)) for s in range(n)])
    met = without.withColumn("with", F.col("kept").bitwiseOR(F.col("bit"))).join(worth.select(F.col("kept").alias("with"), F.col("v").alias("w")), "with")
    phi = met.groupBy("dimension").agg(F.sum(F.element_at(weights, F.bit_count("kept") + 1) * (F.col("w") - F.col("v"))).alias("phi"))
    return phi.select("dimension", "phi", (F.try_divide(F.col("phi"), F.sum("phi").over(Window.partitionBy())) * 100).alias("share_pct"))


def bridge(f: Facts, kpi_key: str, period_a, period_b, by: str = "formula", filters: dict | None = None, max_items: int | None = 5, most: int | None = None) -> DataFrame:
    """(step, label, kind, effect, running): a waterfall from the baseline to the current value that closes exactly.

    By formula or by a dimension, its largest effects first and the rest as one step; a mean can't be bridged by members.
    """
    k = f.kpi(kpi_key)
    ends = kept(f.pair(k, tf.parse(period_a), tf.parse(period_b), filters=filters).select(k.finish("_c").alias("current"), k.finish("_b").alias("baseline")))
    if by == "formula":
        parts = by_formula(f, kpi_key, period_a, period_b, filters).where("component <> 'unexplained'").select(F.col("component").alias("label"), "effect").withColumn("kind", F.lit("component"))
    else:
        if k.kind == "mean":
            raise InvalidArgument("a mean can't be bridged by members", status="unsupported_kind")
        parts = by_member(f, kpi_key, by, period_a, period_b, filters).select(F.col("member").alias("label"), "effect").withColumn("kind", F.lit("member"))
        if max_items is not None:
            parts = placed(parts, [F.abs("effect").desc_nulls_last(), F.col("label")], most=most, cheap=True)
            own = F.col("place") <= max_items
            parts = parts.select(F.when(own, F.col("label")).otherwise("others").alias("label"), F.when(own, "member").otherwise("others").alias("kind"), "effect").groupBy("label", "kind").agg(F.sum("effect").alias("effect"))
    order = F.when(F.col("kind") == "others", 1).otherwise(0)
    steps = placed(parts, [order, F.abs("effect").desc_nulls_last(), F.col("label")], "step", running={"upto": "effect"}, most=most, cheap=by != "formula")
    last = steps.agg(F.max("step").alias("n"), F.coalesce(F.sum("effect"), F.lit(0.0)).alias("sum")).crossJoin(ends)
    steps = steps.crossJoin(F.broadcast(ends)).select("step", "label", "kind", "effect", (F.coalesce("baseline", F.lit(0.0)) + F.coalesce("upto", F.lit(0.0))).alias("running"))
    start = ends.select(F.lit(0).cast("long").alias("step"), F.lit("baseline").alias("label"), F.lit("start").alias("kind"), F.col("baseline").alias("effect"), F.col("baseline").alias("running"))
    rest = F.col("current") - F.col("baseline") - F.col("sum")
    ended = last.select((F.coalesce("n", F.lit(0)) + 1).alias("step"), F.lit("unexplained").alias("label"), F.lit("unexplained").alias("kind"), rest.alias("effect"), (F.coalesce("baseline", F.lit(0.0)) + F.col("sum") + F.coalesce(rest, F.lit(0.0))).alias("running"))
    return start.unionByName(steps).unionByName(ended)


def concentration(f: Facts, kpi_key: str, dimension: str, time_filter=ALL, filters: dict | None = None, top_k: tuple[int, ...] = (1, 3, 5, 10), coverage: tuple[int, ...] = (50, 80, 90), most: int | None = None) -> DataFrame:
    """One row: members, Herfindahl index plain and normalised, effective number, sample Gini, shares of the top, and members for a share."""
    k = f.kpi(kpi_key)
    if not k.additive:
        raise InvalidArgument(f"{kpi_key} is not additive", status="not_additive")
    values = f.sums([k], [f.dimension(dimension)], tf.parse(time_filter), filters).select(F.col(dimension).alias("member"), F.coalesce(k.finish(), F.lit(0.0)).alias("value"))
    values = totals(values, [], whole=F.sum("value"), of=F.count(F.lit(1))).withColumn("share", F.try_divide(F.col("value"), F.col("whole")))
    ranked = placed(values, [F.desc("value"), F.col("member")], running={"running": "share"}, most=most, cheap=True)
    # places from below are those from above turned round: members of one value share the same places either way
    ranked = ranked.withColumn("up", F.col("of") + 1 - F.col("place"))
    n = F.count(F.lit(1))
    out = ranked.agg(
        n.alias("members"), F.sum(F.col("share") * F.col("share")).alias("hhi"), F.sum(F.col("up") * F.col("value")).alias("w"), F.sum("value").alias("total"), F.min("value").alias("least"),
        *[F.sum(F.when(F.col("place") <= t, F.col("share") * 100)).alias(f"top_{t}_pct") for t in top_k], *[F.min(F.when(F.col("running") * 100 >= c - 1e-9, F.col("place"))).alias(f"members_for_{c}") for c in coverage],
    )
    m = F.col("members")
    gini = (F.try_divide(2 * F.col("w"), m * F.col("total")) - (m + 1) / m) * F.try_divide(m, m - 1)
    status = F.when(m == 0, "empty").when(F.col("least") < 0, "has_negative_members").otherwise("ok")
    return out.select("members", "hhi", F.try_divide(F.col("hhi") - 1 / m, 1 - 1 / m).alias("hhi_normalised"), F.try_divide(F.lit(1.0), F.col("hhi")).alias("effective_members"), gini.alias("gini"), *[f"top_{t}_pct" for t in top_k], *[f"members_for_{c}" for c in coverage], status.alias("status"))


def outlier_contributors(f: Facts, kpi_key: str, dimension: str, period_a, period_b, filters: dict | None = None, min_members: int = 4, most: int | None = None) -> DataFrame:
    """Members with the robust z of their over-index among all members."""
    rows = by_member(f, kpi_key, dimension, period_a, period_b, filters)  # over kept sums
    norm = spread(rows, "over_index", most, cheap=True)
    z = F.when(F.col("members") >= min_members, F.try_divide(F.col("over_index") - F.col("centre"), F.col("sigma")))
    return rows.crossJoin(F.broadcast(norm)).select("member", "effect", "contribution_pct", "over_index", z.alias("z"), F.coalesce(F.abs(z) >= 2, F.lit(False)).alias("outlier"))


def _two_groups(f: Facts, kpi_key: str, tests: dict[str, Column], need: set[str], period_a, period_b) -> DataFrame:
    k = f.kpi(kpi_key)
    anchor = f.load(set())
    a = tf.parse(period_a).bind(anchor).predicate(F.col("date"))
    b = tf.parse(period_b).bind(anchor).predicate(F.col("date")) if period_b is not None else F.lit(False)
    sums = [s for g, t in tests.items() for p, scope in (("c", a), ("b", b)) for s in k.sums(t & scope, f"_{g}{p}")]
    rows = f.rows(need | k.fields(), a | b).agg(*sums)
    v = {n: k.finish(f"_{n}").alias(n) for n in ("ac", "ab", "bc", "bb")}
    rows = rows.select(*v.values())
    gap, before = F.col("ac") - F.col("bc"), F.col("ab") - F.col("bb")
    return rows.select(F.col("ac").alias("value_a"), F.col("bc").alias("value_b"), gap.alias("gap"), robust.pct(F.col("ac"), F.col("bc")).alias("gap_pct"), F.try_divide(F.col("ac"), F.col("bc")).alias("ratio"), F.col("ab").alias("baseline_a"), F.col("bb").alias("baseline_b"), (gap - before).alias("divergence"))


def compare_segments(f: Facts, kpi_key: str, dimension: str, member_a: str, member_b: str, period_a, period_b=None) -> DataFrame:
    """One row: a KPI of two members, their gap absolute, relative and as a ratio, and how the gap has changed."""
    d = f.dimension(dimension)
    tests = {"a": F.col(d) == f.member(d, member_a), "b": F.col(d) == f.member(d, member_b)}
    return _two_groups(f, kpi_key, tests, {d}, period_a, period_b)


def compare_cohorts(f: Facts, kpi_key: str, filter_a: dict, filter_b: dict, period_a, period_b=None) -> DataFrame:
    """One row as of ``compare_segments`` for two groups that filters define; the groups must not share a row."""
    tests, need = {"a": f.filter(filter_a), "b": f.filter(filter_b)}, set(filter_a) | set(filter_b)
    if tests["a"] is None or tests["b"] is None:
        raise InvalidArgument("both cohorts need a filter")
    if f.rows(need).where(tests["a"] & tests["b"]).limit(1).count():
        raise InvalidArgument("the cohorts overlap", status="overlap")
    return _two_groups(f, kpi_key, tests, need, period_a, period_b)


def behaviour(f: Facts, kpi_key: str, dimension: str, period_a, period_b, threshold_pct: float = MATERIAL, filters: dict | None = None) -> DataFrame:
    """(member, band, current, baseline, change, change_pct): how each member moved."""
    k = f.kpi(kpi_key)
    rows = f.pair(k, tf.parse(period_a), tf.parse(period_b), [f.dimension(dimension)], filters).select(F.col(dimension).alias("member"), k.finish("_c").alias("current"), k.finish("_b").alias("baseline"), "rows_c", "rows_b")
    change = robust.pct(F.col("current"), F.col("baseline"))
    band = F.when(F.col("rows_b") == 0, "appeared").when(F.col("rows_c") == 0, "disappeared").when(change.isNull(), "undetermined").when(change >= threshold_pct, "grew").when(change <= -threshold_pct, "declined").otherwise("flat")
    return rows.select("member", band.alias("band"), "current", "baseline", (F.col("current") - F.col("baseline")).alias("change"), change.alias("change_pct"))


def behaviour_bands(f: Facts, *args, **kwargs) -> DataFrame:
    """Members and summed values of each band."""
    return behaviour(f, *args, **kwargs).groupBy("band").agg(F.count(F.lit(1)).alias("members"), F.sum("current").alias("current"), F.sum("baseline").alias("baseline"))


def dispersion(f: Facts, kpi_key: str, dimension: str, period_a, grain: str = "quarter", filters: dict | None = None) -> DataFrame:
    """(member, change_pct, history, z): each member's latest change against its own earlier ones, three at least."""
    from tallyloom.operators.retrieve import series

    k, now = f.kpi(kpi_key), tf.parse(period_a)
    start = F.lit(str(now.ranges[0][0])).cast("timestamp_ntz")
    points = series(f, [k.key], grain, ALL, filters, f.dimension(dimension)).withColumnRenamed(dimension, "member").withColumnRenamed(k.key, "value")
    first = tf.ordinal(start, grain)
    points = points.withColumn("change", robust.pct(F.col("value"), F.lag("value").over(Window.partitionBy("member").orderBy("ord"))))
    rows = points.groupBy("member").agg(F.max(F.when(F.col("ord") == first, F.col("change"))).alias("change_pct"), F.collect_list(F.when((F.col("ord") < first) & F.col("change").isNotNull(), F.col("change"))).alias("h"))
    spread = robust.sigma(F.col("h")) * F.sqrt(1 + F.try_divide(F.lit(1.0), F.size("h")))
    z = F.when(F.size("h") >= 3, F.try_divide(F.col("change_pct") - robust.median(F.col("h")), spread))
    return rows.select("member", "change_pct", F.size("h").cast("long").alias("history"), z.alias("z"))


#: The robust z that starts to count and the one that counts in full, and the weights of a driver's size,
#: over-index, unusualness and persistence.
Z_FLOOR, Z_FULL, WEIGHTS = 1.0, 3.0, (0.40, 0.25, 0.20, 0.15)
#: Periods before the asked one whose weeks are looked at, weeks in a row that make an onset, share and
#: over-index of a member in focus, and dimensions in focus.
LOOKBACK, IN_A_ROW, FOCUS_SHARE, FOCUS_DIMENSIONS = 3, 2, 25.0, 2


def scored(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``rows(contribution_pct, over_index, z, persistence, axis)`` with their driver score: the weighted mean of the
    clipped parts that are known, times the axis weight. Only members that push the way of the change stay."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    parts = [clip(F.abs("contribution_pct") / 100), clip(F.col("over_index") - 1), clip((F.abs("z") - Z_FLOOR) / (Z_FULL - Z_FLOOR)), clip(F.col("persistence"))]
    known = [F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in zip((F.col("contribution_pct"), F.col("over_index"), F.col("z"), F.col("persistence")), weights, strict=True)]
    top = sum((F.when(w > 0, w * p).otherwise(0.0) for p, w in zip(parts[1:], known[1:], strict=True)), F.when(known[0] > 0, known[0] * parts[0]).otherwise(0.0))
    return rows.where("contribution_pct > 0").withColumn("score", F.try_divide(top, sum(known[1:], known[0])) * F.coalesce("axis", F.lit(1.0)))


def member_history(f: Facts, kpi_key: str, dimensions: list[str], period_a) -> DataFrame:
    """(dimension, member, norm, spread, history): median and robust sigma of each member's changes between the quarters
    it holds, before the first quarter of ``period_a``; null with fewer than three. Sigma widens by sqrt(1 + 1/n)."""
    k, now = f.kpi(kpi_key), tf.parse(period_a).bind(f.load(set()))
    first = f.rows(set(), now).agg(F.min(tf.ordinal(F.col("date"), "quarter"))).first()[0]
    rows = _by_dimension(f, k, dimensions, None).withColumn("ord", tf.ordinal(F.col("date"), "quarter"))
    points = rows.groupBy("dimension", "member", "ord").agg(*k.sums()).select("dimension", "member", "ord", k.finish().alias("value"))
    change = robust.pct(F.col("value"), F.lag("value").over(Window.partitionBy("dimension", "member").orderBy("ord")))
    lists = points.withColumn("change", change).groupBy("dimension", "member").agg(F.collect_list(F.when(F.col("ord") < F.lit(first), F.col("change"))).alias("h"))
    enough = F.size("h") >= 3
    spread = robust.sigma(F.col("h")) * F.sqrt(1 + F.try_divide(F.lit(1.0), F.size("h")))
    return lists.select("dimension", "member", F.when(enough, robust.median(F.col("h"))).alias("norm"), F.when(enough & (spread > 0), spread).alias("spread"), F.size("h").cast("long").alias("history"))


def member_persistence(f: Facts, kpi_key: str, dimensions: list[str], period_a, directions: DataFrame) -> DataFrame | None:
    """(dimension, member, onset, outside, weeks): when each member left its earlier weeks' range the way of its change,
    and how many of the period's weeks it stayed outside; none if the period is no single quarter or year.

    The weeks looked at start LOOKBACK periods before. All of them but about the last make the range: median and one
    robust sigma, else the standard deviation, else a twentieth of the median. ``directions(dimension, member, down)``.
    """
    now = tf.parse(period_a)
    if now.kind not in ("quarter", "year"):
        return None
    k, start = f.kpi(kpi_key), now
    for _ in range(LOOKBACK):
        start = tf.previous(start)
    anchor = f.load(set())
    first, own = start.bind(anchor).predicate(F.col("date")), now.bind(anchor).predicate(F.col("date"))
    ends = f.rows(set(), first | own).agg(F.min(F.when(first, F.col("date"))).alias("low"), F.min(F.when(own, F.col("date"))).alias("begin"), F.max(F.when(own, F.col("date"))).alias("high")).first()
    if None in ends:
        return None
    base = max(4, (ends["begin"] - ends["low"]).days // 7 - 1)
    rows = _by_dimension(f, k, dimensions, (F.col("date") >= F.lit(ends["low"])) & (F.col("date") <= F.lit(ends["high"]))).withColumn("week", tf.label(F.col("date"), "week"))
    points = rows.groupBy("dimension", "member", "week").agg(*k.sums()).select("dimension", "member", F.struct("week", k.finish().alias("value")).alias("p"))
    lists = points.groupBy("dimension", "member").agg(F.sort_array(F.collect_list("p")).alias("p")).join(directions, ["dimension", "member"])
    held = F.filter(F.transform(F.slice("p", 1, base), lambda x: x["value"]), lambda v: v.isNotNull())
    scaled, plain = robust.mad(F.col("held")) * robust.MAD_SCALE, F.coalesce(robust.deviation(F.col("held")), F.lit(0.0))
    centre = robust.median(F.col("held"))
    lists = lists.withColumn("held", held).withColumn("centre", centre).withColumn("spread", F.when(scaled != 0, scaled).when(plain != 0, plain).otherwise(F.abs("centre") * 0.05))
    beyond = lambda v: F.coalesce(F.when(F.col("down"), v < F.col("centre") - F.col("spread")).otherwise(v > F.col("centre") + F.col("spread")), F.lit(False))
    lists = lists.withColumn("out", F.transform("p", lambda x: beyond(x["value"])))
    at = F.filter(F.sequence(F.lit(1), F.size("p")), lambda i: (i > base) & F.forall(F.slice("out", i, F.lit(IN_A_ROW)), lambda x: x) & (i + IN_A_ROW - 1 <= F.size("p")))
    usable = (F.size("held") >= 3) & (F.col("spread") > 0) & (F.size("p") >= base + IN_A_ROW + 1)
    lists = lists.withColumn("place", F.when(usable, F.get(at, F.lit(0))))
    begin = str(ends["begin"].date())
    weeks = F.size(F.filter("p", lambda x: x["week"] >= begin))
    outside = F.size(F.filter(F.arrays_zip("p", "out"), lambda x: (x["p"]["week"] >= begin) & x["out"]))
    return lists.select("dimension", "member", F.get("p", F.col("place") - 1)["week"].alias("onset"), F.when(F.col("place").isNull(), 0).otherwise(outside).cast("long").alias("outside"), weeks.cast("long").alias("weeks"))


def rank_drivers(f: Facts, kpi_key: str, period_a, period_b, dimensions: list[str] | None = None, filters: dict | None = None, limit: int | None = 6, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Members of all dimensions by driver score: size, over-index, unusualness, persistence, and how much the dimension explains.

    Four scans, however many dimensions: the two periods' sums, the cells of the attribution, and each member's history
    by quarter and by week, which ``filters`` do not narrow. z is that of the change between the two periods asked for.
    """
    dims = list(dimensions or f.dimensions)
    rows = by_members(f, kpi_key, dims, period_a, period_b, filters)
    past = member_history(f, kpi_key, dims, period_a)
    rows = rows.join(past, ["dimension", "member"], "left").withColumn("z", F.try_divide(F.col("change_pct") - F.col("norm"), F.col("spread")))
    held = member_persistence(f, kpi_key, dims, period_a, rows.select("dimension", "member", (F.coalesce("change", F.lit(0.0)) < 0).alias("down")))
    if held is None:
        none = {"onset": F.lit(None).cast("string"), "outside": F.lit(None).cast("long"), "weeks": F.lit(None).cast("long")}
        rows = rows.withColumns(none)
    else:
        rows = rows.join(held, ["dimension", "member"], "left")
    rows = rows.withColumn("persistence", F.when(F.col("weeks") > 0, F.col("outside") / F.col("weeks")))
    if len(dims) > 1 and f.kpi(kpi_key).kind != "mean":
        axis = shapley(f, kpi_key, period_a, period_b, dims, filters)
        rows = rows.join(axis.select("dimension", F.try_divide(F.col("phi"), F.max("phi").over(Window.partitionBy())).alias("axis")), "dimension", "left")
    else:
        rows = rows.withColumn("axis", F.lit(1.0))
    out = scored(rows, weights).select("dimension", "member", "effect", "contribution_pct", "over_index", "z", "onset", "outside", "weeks", "axis", "score").orderBy(F.round("score", 4).desc(), F.desc("contribution_pct"), "dimension", "member")
    return out.limit(limit) if limit is not None else out


def focus(f: Facts, kpi_key: str, period_a, period_b, dimensions: list[str] | None = None) -> DataFrame:
    """The member in focus of at most two dimensions: with a quarter or more of the change and an over-index of 1.2 or
    more, or an unknown one, which counts as 1; the greatest over-index first, then the greatest share."""
    rows = by_members(f, kpi_key, list(dimensions or f.dimensions), period_a, period_b)
    rows = rows.where((F.col("contribution_pct") >= FOCUS_SHARE) & F.coalesce(F.col("over_index") >= OVER_INDEX, F.lit(True)))
    by = [F.desc("weight"), F.desc("contribution_pct"), F.desc("dimension"), F.desc("member")]
    first = rows.withColumn("weight", F.coalesce("over_index", F.lit(1.0))).withColumn("place", F.row_number().over(Window.partitionBy("dimension").orderBy(*by))).where("place = 1")
    return first.orderBy(*by).limit(FOCUS_DIMENSIONS).select("dimension", "member", "contribution_pct", "over_index")


def movement(f: Facts, keys: list[str], period_a, period_b, filters: dict | None = None) -> DataFrame:
    """(kpi, current, baseline, change_pct, unfavourable) of many KPIs, in one scan."""
    kpis = [f.kpi(k) for k in keys]
    wide = f.pair(kpis[0], tf.parse(period_a), tf.parse(period_b), filters=filters, others=kpis[1:])
    rows = F.array(*[F.struct(F.lit(k.key).alias("kpi"), k.finish("_c").alias("current"), k.finish("_b").alias("baseline"), unfavourable(k.finish("_c") - k.finish("_b"), k).alias("unfavourable")) for k in kpis])
    return wide.select(F.explode(rows).alias("x")).select("x.kpi", "x.current", "x.baseline", robust.pct(F.col("x.current"), F.col("x.baseline")).alias("change_pct"), "x.unfavourable")


def rank_movement(f: Facts, keys: list[str], period_a, period_b, filters: dict | None = None, order_by: str = "unfavourability", limit: int | None = 10) -> DataFrame:
    """KPIs by how they moved: unfavourable ones first, or by size alone; undefined changes last."""
    by = [F.abs("change_pct").desc_nulls_last(), F.asc("kpi")]
    if order_by == "unfavourability":
        by.insert(0, F.desc("unfavourable"))
    out = movement(f, keys, period_a, period_b, filters).withColumn("place", F.row_number().over(Window.orderBy(*by)))
    return out.where(F.col("place") <= limit) if limit is not None else out
