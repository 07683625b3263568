"""Tests of an explanation on aligned samples: significance, confounders, spurious trends, outliers, effect size.

A sample, a KPI's changes over members or periods, stays in Spark however large it is: one aggregate gives its co-moments,
and what the driver works on is the small matrix of these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.errors import InvalidArgument
from tallyloom.functions import stats, tails
from tallyloom.operators import relate
from tallyloom.operators.moments import Moments, bca_interval, left_out, moments
from tallyloom.operators.retrieve import ALL, series
from tallyloom.sources.facts import Facts
from tallyloom.sources.scratch import kept

#: Causes compared and controls held at most, and how much weaker an r must get to count as changed.
MOST_CAUSES, MOST_CONTROLS, ATTENUATED, EXPLAINED, NEGLIGIBLE = 8, 10, 15.0, 50.0, 0.05
#: Members named in the report on outliers, those first that matter most.
MOST_NAMED = 500


def judged(own: Moments, min_n: int = 6, alpha: float = 0.05) -> dict:
    """r, p, interval and status of a pair. r is rounded to three places before its p, as it is reported."""
    if own.n < min_n:
        return {"status": "no_overlap" if own.n == 0 else "insufficient_n", "n": own.n, "r": None, "p_value": None, "ci": None, "significant": None}
    r = own.r()
    if r is None:
        return {"status": "constant_a" if own.constant(0) else "constant_b", "n": own.n, "r": None, "p_value": None, "ci": None, "significant": None}
    r = round(r, 3)
    p = stats.correlation_p(r, own.n)
    return {"status": "ok", "n": own.n, "r": r, "p_value": p, "ci": stats.fisher_interval(r, own.n, alpha), "significant": None if p is None else p < alpha}


def significance(f: Facts, kpi_key: str, causes: list[str], min_n: int = 6, alpha: float = 0.05, **scope) -> DataFrame:
    """(cause, n, r, p_value, q_value, low, high, least_detectable_r, status) of each cause, q over all of them; r has three places."""
    found = relate.correlations(f, kpi_key, causes, min_n, **scope).withColumn("r", F.round("r", 3))
    low, high = tails.fisher_interval(F.col("r"), F.col("n"), alpha)
    found = found.select(F.col("other").alias("cause"), "n", "r", tails.correlation_p(F.col("r"), F.col("n")).alias("p_value"), low.alias("low"), high.alias("high"), tails.least_detectable(F.col("n"), alpha).alias("least_detectable_r"), "status")
    return tails.with_q(found)


def statistical_significance(f: Facts, kpi_key: str, cause_kpi: str | None = None, candidates: list[str] | None = None, min_n: int = 6, alpha: float = 0.05, **scope) -> dict:
    """p, interval and least detectable r of one cause, or of several with q over their family."""
    if (cause_kpi is None) == (candidates is None):
        raise InvalidArgument("give either cause_kpi or candidates")
    causes = [cause_kpi] if cause_kpi else list(candidates)
    found = {r["cause"]: r for r in significance(f, kpi_key, causes, min_n, alpha, **scope).collect()}
    tests = []
    for c in causes:
        own = found[c].asDict() if c in found else dict.fromkeys(("r", "p_value", "q_value", "low", "high", "least_detectable_r")) | {"n": 0, "status": "no_overlap"}
        p, ends = own["p_value"], (own["low"], own["high"])
        tests.append({"cause": c, "status": own["status"], "n": own["n"], "r": own["r"], "p_value": p, "ci": None if None in ends else ends, "significant": None if p is None else p < alpha, "q_value": own["q_value"] if candidates else None, "least_detectable_r": own["least_detectable_r"]})
    return {"status": "ok", "tests": tests, "family": len(causes)}


def confounders(f: Facts, kpi_key: str, cause_kpi: str, candidates: list[str], min_n: int = 6, alpha: float = 0.05, **scope) -> dict:
    """r of KPI and cause, what remains of it given each candidate alone, and given all of them; more than MOST_CONTROLS are refused."""
    controls = [c for c in dict.fromkeys(candidates) if c not in (kpi_key, cause_kpi)]
    if len(controls) > MOST_CONTROLS:
        raise InvalidArgument(f"at most {MOST_CONTROLS} candidates may be tested at once, not {len(controls)}")
    held = [[], *[[c] for c in controls], *([controls] if len(controls) > 1 else [])]
    base, *others = moments(relate.sample(f, [kpi_key, cause_kpi, *controls], **scope), [(kpi_key, cause_kpi, *h) for h in held])

    def given(held: list[str], own: Moments) -> dict:
        none = {"controls": held, "n": own.n, "partial_r": None, "p_value": None, "effect": None}
        if own.n < min_n or own.n - 2 - len(held) < 1:
            return none | {"status": "insufficient_n" if own.n < min_n else "insufficient_n_for_controls"}
        if any(own.constant(k, relative=False) for k in range(len(held) + 2)):
            return none | {"status": "undefined_sample"}
        r, plain = own.partial(), own.r()
        if r is None or plain is None:
            return none | {"status": "collinear_controls"}
        weaker = (1 - abs(r) / abs(plain)) * 100 if abs(plain) >= NEGLIGIBLE else None
        if weaker is None:
            effect = "unchanged" if abs(r) < NEGLIGIBLE else "strengthened"
        elif r * plain < 0 and abs(r) >= NEGLIGIBLE:
            effect = "sign_flipped"
        else:
            effect = "explained_away" if weaker >= EXPLAINED else "attenuated" if weaker >= ATTENUATED else "strengthened" if weaker <= -ATTENUATED else "unchanged"
        return none | {"status": "ok", "partial_r": round(r, 3), "attenuation_pct": weaker, "p_value": stats.correlation_p(r, own.n, len(held)), "ci": stats.fisher_interval(r, own.n, alpha, len(held)), "effect": effect}

    plain = judged(base, min_n, alpha)
    each = [given(h, m) for h, m in zip(held[1:], others, strict=True)]
    return {"status": plain["status"], "baseline": plain, "each": each[: len(controls)], "joint": each[-1] if len(controls) > 1 else None}


def spurious(f: Facts, kpi_key: str, cause_kpi: str, grain: str = "quarter", time_filter=ALL, filters: dict | None = None, min_n: int = 6, alpha: float = 0.05) -> dict:
    """r of the levels, of the levels without each series' own line, and of first differences."""
    points = kept(series(f, [kpi_key, cause_kpi], grain, time_filter, filters).select("ord", F.col(kpi_key).cast("double").alias("y"), F.col(cause_kpi).cast("double").alias("x")).where("y is not null and x is not null"))
    if (n := points.count()) < min_n:
        return {"status": "ok", "verdict": "insufficient", "n": n}
    lines = {c: relate.line(points.select("ord", F.col(c).alias("value")), grain).select("slope", "intercept").first() for c in ("y", "x")}
    by_time = Window.orderBy("ord")
    near = F.col("ord") - F.lag("ord").over(by_time) == 1
    away = {f"{c}_flat": F.col(c) - F.lit(s["slope"]) * F.col("ord") - F.lit(s["intercept"]) for c, s in lines.items()}
    moves = {f"{c}_move": F.when(near, F.col(c) - F.lag(c).over(by_time)) for c in ("y", "x")}
    level, flat, moved = (judged(m, min_n, alpha) for m in moments(points.withColumns(away | moves), [("y", "x"), ("y_flat", "x_flat"), ("y_move", "x_move")]))
    if level["r"] is None or flat["r"] is None:
        verdict = "insufficient"
    else:
        verdict = "survives_detrending" if flat["significant"] else "trend_driven" if level["significant"] else "insufficient"
    return {"status": "ok", "verdict": verdict, "level": level, "detrended": flat, "difference": moved, "slopes": [lines["y"]["slope"], lines["x"]["slope"]]}


def without_one(f: Facts, kpi_key: str, cause_kpi: str, dimension: str, period_a, period_b, base: dict, filters: dict | None = None, alpha: float = 0.05) -> DataFrame:
    """(member, r_without, drives): the correlation without each member, and whether that member makes it what ``base`` says.

    It does if without it r is undefined, changes sign, loses half, or is no longer significant."""
    rows = left_out(relate.sample(f, [kpi_key, cause_kpi], dimension=dimension, period_a=period_a, period_b=period_b, filters=filters), kpi_key, cause_kpi)
    r, p = F.col("r_without"), tails.correlation_p(F.round("r_without", 3), F.lit(base["n"] - 1))
    lost = F.lit(bool(base["significant"])) & F.coalesce(p >= alpha, F.lit(False))
    return rows.select(F.col("entity").alias("member"), "r_without", (r.isNull() | (r * base["r"] < 0) | (F.abs(r) <= abs(base["r"]) / 2) | lost).alias("drives"))


def outlier_sensitivity(f: Facts, kpi_key: str, cause_kpi: str, period_a, period_b, dimension: str | None = None, filters: dict | None = None, min_n: int = 6, alpha: float = 0.05) -> dict:
    """Whether one member makes the correlation: its sign turns, half of it goes, or it is no longer significant without it.

    ``without`` names the MOST_NAMED members without which r moves most; all are judged."""
    d = dimension or f.dimensions[0]
    sample = relate.sample(f, [kpi_key, cause_kpi], dimension=d, period_a=period_a, period_b=period_b, filters=filters)
    base = judged(moments(sample, [(kpi_key, cause_kpi)])[0], min_n, alpha)
    if base["r"] is None:
        return {"status": "ok", "verdict": "insufficient", "baseline": base}
    rows = kept(without_one(f, kpi_key, cause_kpi, d, period_a, period_b, base, filters, alpha))
    most = rows.orderBy(F.abs(F.col("r_without") - base["r"]).desc_nulls_first(), "member").limit(MOST_NAMED).collect()
    without = sorted(({"member": r["member"], "r": r["r_without"]} for r in most), key=lambda w: (w["member"] is not None, w["member"]))
    if not base["significant"] and abs(base["r"]) < NEGLIGIBLE:
        verdict = "no_association"
    else:
        verdict = "robust" if rows.where("drives").isEmpty() else "outlier_driven"
    return {"status": "ok", "verdict": verdict, "baseline": base, "without": without, "members": base["n"]}


def effect_size(f: Facts, kpi_key: str, cause_kpi: str, min_n: int = 6, alpha: float = 0.05, **scope) -> dict:
    """r, its square, Fisher's interval and a bootstrap one by digest weights, for eight values or more."""
    sample = kept(relate.sample(f, [kpi_key, cause_kpi], **scope))
    base = judged(moments(sample, [(kpi_key, cause_kpi)])[0], min_n, alpha)
    if base["r"] is None:
        return {**base, "r_squared": None, "bootstrap": None, "bootstrap_status": "insufficient_for_bootstrap"}
    interval = bca_interval(sample, kpi_key, cause_kpi, alpha) if base["n"] >= 8 else None
    return {**base, "r_squared": base["r"] ** 2, "bootstrap": interval, "bootstrap_status": "insufficient_for_bootstrap" if base["n"] < 8 else "ok" if interval else "degenerate"}


def adequacy(f: Facts, kpi_key: str, dimension: str | None = None, time_filter=ALL, grain: str = "quarter", filters: dict | None = None, min_n: int = 6, alpha: float = 0.05, power: float = 0.8) -> dict:
    """How many members and periods there are to test on, and the least r that they could show."""
    out = []
    for d in [dimension] if dimension else f.dimensions:
        out.append(("dimension", d, f.sums([f.kpi(kpi_key)], [f.dimension(d)], None, filters).count()))
    for g in [grain] if grain else ("quarter", "month", "week"):
        out.append(("grain", g, max(0, series(f, [kpi_key], g, time_filter, filters).count() - 1)))

    def verdict(n: int) -> str:
        least = stats.least_detectable(n, alpha, power)
        return "inadequate" if n < min_n or least is None else "adequate" if least <= 0.5 else "marginal"

    return {"status": "ok", "samples": [{"axis": a, "name": b, "n": n, "least_detectable_r": stats.least_detectable(n, alpha, power), "verdict": verdict(n)} for a, b, n in out]}


def competing(f: Facts, kpi_key: str, candidate_causes: list[str], ordered_by: str = "abs_partial_r", precedence_grain: str = "week", min_n: int = 6, alpha: float = 0.05, include_precedence: bool = True, include_consistency: bool = True, **scope) -> dict:
    """Up to eight causes with r, p, q, what remains given all rivals, onset order and consistency, by a declared key."""
    causes = list(dict.fromkeys(candidate_causes))
    if not 1 <= len(causes) <= MOST_CAUSES:
        raise InvalidArgument(f"1 to {MOST_CAUSES} causes")
    everything = [(kpi_key, c, *[o for o in causes if o != c]) for c in causes]
    found = moments(relate.sample(f, [kpi_key, *causes], **scope), [(kpi_key, c) for c in causes] + everything)
    rows = []
    for c, pair, whole in zip(causes, found[: len(causes)], found[len(causes) :], strict=True):
        test = judged(pair, min_n, alpha)
        usable = whole.n - 2 - (len(causes) - 1) >= 1 and not any(whole.constant(k, relative=False) for k in range(len(causes) + 1))
        partial = whole.partial() if usable else None
        row = {"cause": c, **test, "partial_r": None if partial is None else round(partial, 3)}
        if include_precedence:
            row["precedence"] = relate.precedence(f, kpi_key, c, precedence_grain).first().asDict()
        if include_consistency and scope.get("dimension") and scope.get("period_a") is not None:
            row["consistency"] = relate.consistency_rate(relate.consistency(f, kpi_key, c, scope["dimension"], scope["period_a"], scope["period_b"])).first().asDict()
        rows.append(row)
    for row, q in zip(rows, stats.q_values([r["p_value"] for r in rows]), strict=True):
        row["q_value"] = q
    size = lambda v: -1.0 if v is None else abs(v)
    keys = {"abs_partial_r": lambda r: (-size(r["partial_r"]), r["cause"]), "abs_r": lambda r: (-size(r["r"]), r["cause"]), "p_value": lambda r: (2.0 if r["p_value"] is None else r["p_value"], r["cause"])}
    if ordered_by not in keys:
        raise InvalidArgument(f"no order {ordered_by!r}")
    return {"status": "ok", "ordered_by": ordered_by, "causes": sorted(rows, key=keys[ordered_by])}
