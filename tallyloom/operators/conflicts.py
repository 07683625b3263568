"""What a table holds against the definitions of KPIs over it: six kinds of conflicts, from two aggregates and the hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import formula
from tallyloom.operators.profile import hierarchies
from tallyloom.plans.contract import HISTORY, Basis, Conflict, Entry, definitions

#: The share of rows in which a part has to lie within its whole, and how far a percentage may stray.
WITHIN, STRAY = 0.95, 0.001


def _shares(entries: list[Entry]) -> dict[str, tuple[str, str]]:
    """Percentages of one field in another, by key; a numerator that subtracts is a margin and no share."""
    out = {}
    for e in entries:
        own = e.compiled()
        if own.kind != "ratio" or e.unit != "percent" or "-" in e.numerator:
            continue
        top, bottom = sorted(formula.fields(own.numerator)), sorted(formula.fields(own.denominator))
        if len(top) == len(bottom) == 1 and top != bottom:
            out[e.key] = (top[0], bottom[0])
    return out


def breaches(df: DataFrame, entries: list[Entry], date: str = "date") -> DataFrame:
    """(kind, key, fields, measured) of what the rows hold against percentages and against too short a history; one aggregate.

    subset_check_failed: the share of rows in which part and whole are known and the part is at most the whole, if that is too
    low or the part is no less in sum; unit_mismatch: a percentage's value over all rows, if beyond 0 to 100;
    insufficient_history: the quarters that hold rows, if too few. A table without rows breaks the last only.
    """
    shares, percents = _shares(entries), {e.key: e.compiled() for e in entries if e.unit == "percent"}
    at = F.col(f"`{date}`").cast("timestamp")
    aggs: list[Column] = [F.count_distinct(F.year(at) * 4 + F.quarter(at)).alias("quarters")]
    for i, (a, b) in enumerate(shares.values()):
        x, y = F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")
        both = x.isNotNull() & y.isNotNull()
        aggs += [F.avg(F.when(both, (x <= y).cast("double"))).alias(f"w{i}"), (F.sum(F.when(both, x)) < F.sum(F.when(both, y))).alias(f"l{i}")]
    aggs += [s for k in percents.values() for s in k.sums()]
    found = df.agg(*aggs)
    none = F.lit(None).cast("string")
    row = lambda kind, key, fields, measured, holds: F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.array(*map(F.lit, fields)).cast("array<string>").alias("fields"), measured.cast("double").alias("measured"), F.coalesce(holds, F.lit(False)).alias("holds"))
    rows = [row("insufficient_history", none, [], F.col("quarters"), F.col("quarters") < HISTORY)]
    rows += [row("subset_check_failed", F.lit(k), [a, b], F.col(f"w{i}"), (F.col(f"w{i}") < WITHIN) | ~F.col(f"l{i}")) for i, (k, (a, b)) in enumerate(shares.items())]
    rows += [row("unit_mismatch", F.lit(key), [], k.finish(), ~k.finish().between(-STRAY, 100 + STRAY)) for key, k in percents.items()]
    return found.select(F.explode(F.array(*rows)).alias("x")).select("x.*").where("holds").drop("holds")


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """One row (groups, rows): values of a key that several rows share, and how many rows these are."""
    shared = df.groupBy(*[F.col(f"`{c}`") for c in key]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return shared.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def detect(df: DataFrame, entries: list[Entry], dimensions: list[str] = (), key: list[str] = (), bases: dict[str, Basis] | None = None, date: str = "date") -> list[Conflict]:
    """All conflicts of definitions with each other and with the rows of a table.

    Between definitions: formula_disagreement, duplicate_definition, calendar_mismatch. With the rows: subset_check_failed,
    unit_mismatch, insufficient_history (``breaches``), hierarchy_violation of ``dimensions``, grain_mismatch of ``key``.
    """
    out = definitions(entries)
    calendars = {k: b.calendar for k, b in (bases or {}).items()}
    if len(set(calendars.values())) > 1:
        out.append(Conflict("calendar_mismatch", sorted(calendars), f"{len(set(calendars.values()))} calendars: {', '.join(sorted(set(calendars.values())))}"))
    says = {"subset_check_failed": "the part lies within the whole in {:.0%} of the rows only, so the share passes 100 %", "unit_mismatch": "a percentage of {:,.1f} over the whole table", "insufficient_history": "{:.0f} quarters are too few to judge changes by"}
    for r in breaches(df, entries, date).collect():
        keys = [r["key"]] if r["key"] else sorted(e.key for e in entries)
        out.append(Conflict(r["kind"], keys, says[r["kind"]].format(r["measured"] if r["measured"] is not None else 0), r["kind"] == "subset_check_failed", fields=list(r["fields"]), measured=r["measured"]))
    if len(dimensions) > 1:
        for r in hierarchies(df, list(dimensions)).where("violations > 0").orderBy("child", "parent").collect():
            out.append(Conflict("hierarchy_violation", [], f"{r['violations']} of {r['members']} members of {r['child']} lie in several of {r['parent']}", fields=[r["child"], r["parent"]], measured=float(r["violations"])))
    if key:
        shared = repeated_keys(df, list(key)).first()
        if shared["groups"]:
            out.append(Conflict("grain_mismatch", [], f"{shared['groups']} values of the key are in several rows", False, fields=list(key), measured=float(shared["groups"])))
    return out
