"""What could account for a KPI's move: relatives by formula and meaning, and proposed causes once the data bears them out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions import robust
from tallyloom.operators import investigate
from tallyloom.operators.retrieve import series
from tallyloom.plans import catalogue
from tallyloom.plans.contract import Basis, comparability
from tallyloom.sources.facts import Facts

#: The correlation and the changes that a proposed cause needs, pairs that any correlation needs, and the
#: most that a proposal may weigh.
LEAST_R, LEAST_CHANGES, LEAST_PAIRS, MOST_WEIGHT = 0.5, 6, 3, 0.8


def edges(f: Facts, kpi_key: str, bases: dict[str, Basis] | None = None) -> list[dict]:
    """Causes to consider, the weightiest first; KPIs on another basis are named with weight 0, as evidence against."""
    found = [{"source": r.source, "target": kpi_key, "relation": r.relation, "weight": r.weight, "fields": list(r.fields), "reasons": []} for r in catalogue.related(f.catalog, kpi_key, f.measures)]
    for pair in comparability(bases or {}):
        if pair["kpi"] == kpi_key and not pair["comparable"]:
            found.append({"source": pair["other"], "target": kpi_key, "relation": "not_comparable", "weight": 0.0, "fields": [], "reasons": pair["reasons"]})
    return sorted(found, key=lambda e: (-e["weight"], e["source"], e["relation"]))


def dimension_drivers(f: Facts, kpi_key: str, period_a, period_b, dimensions: list[str] | None = None) -> DataFrame:
    """Members that carry a large share of a move, and more than their own size explains."""
    return investigate.focus(f, kpi_key, period_a, period_b, list(dimensions or f.dimensions))


def held_changes(f: Facts, keys: list[str], grain: str = "quarter") -> DataFrame:
    """(ord, period, key...): each KPI's change in per cent from the period held before, whether or not it is the calendar's."""
    by_time = Window.orderBy("ord")
    points = series(f, keys, grain)
    changes = points.select("ord", "period", F.lag("ord").over(by_time).alias("before"), *[robust.pct(F.col(k), F.lag(k).over(by_time)).alias(k) for k in keys])
    return changes.where("before is not null").drop("before")


def verify(f: Facts, kpi_key: str, causes: list[str]) -> DataFrame:
    """(cause, n, r, leads, trails, status, lag, weight): whether each proposed cause moves with a KPI and not after it.

    All causes come from one scan; what is sorted is one row for each period. n counts the changes, r is over those that
    both KPIs have, leads and trails are r with the cause and with the KPI one period earlier."""
    changes = held_changes(f, [kpi_key, *causes])
    pairs = F.array(*[F.struct(F.lit(c).alias("cause"), F.col(kpi_key).alias("y"), F.col(c).alias("x")) for c in causes])
    by_time = Window.partitionBy("cause").orderBy("ord")
    rows = changes.select("ord", F.explode(pairs).alias("p")).select("ord", "p.*").withColumns({"x_before": F.lag("x").over(by_time), "y_before": F.lag("y").over(by_time)})

    def r(a: str, b: str):
        return F.when(F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)) >= LEAST_PAIRS, robust.correlation(F.col(a), F.col(b)))

    found = rows.groupBy("cause").agg(F.count(F.lit(1)).alias("n"), F.round(r("y", "x"), 3).alias("r"), r("y", "x_before").alias("leads"), r("x", "y_before").alias("trails"))
    same, ahead, behind = F.abs("r"), F.abs("leads"), F.abs("trails")
    status = F.when(F.col("n") < LEAST_CHANGES, "insufficient_history").when(F.coalesce(same, F.lit(0.0)) < LEAST_R, "no_association").when((behind > same) & (behind > F.coalesce(ahead, F.lit(0.0))), "wrong_order").otherwise("verified")
    lag = F.when(F.col("status") == "wrong_order", -1).when(F.col("status") == "verified", F.when(ahead > same, 1).otherwise(0))
    weight = F.when(F.col("status") == "verified", F.round(F.least(F.lit(MOST_WEIGHT), same), 3)).otherwise(0.0)
    return found.withColumn("status", status).withColumn("lag", lag).withColumn("weight", weight)


def attach(f: Facts, kpi_key: str, known: list[dict], proposed: list[str]) -> tuple[list[dict], list[dict]]:
    """Edges with the proposed causes that hold, and the proposed ones that don't."""
    new = [c for c in dict.fromkeys(proposed) if c != kpi_key and c not in {e["source"] for e in known}]
    tests = [{"source": r["cause"], "target": kpi_key, "relation": "proposed", "weight": r["weight"], "fields": [], "reasons": [r["status"]]} for r in verify(f, kpi_key, new).collect()] if new else []
    held = [t for t in tests if t["reasons"] == ["verified"]]
    return sorted([*known, *held], key=lambda e: (-e["weight"], e["source"], e["relation"])), [t for t in tests if t not in held]
