"""Several sources of one fact: what they agree on is taken, what they dispute is withheld unless one has the say."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.errors import InvalidArgument
from tallyloom.operators import profile
from tallyloom.plans import timefilter as tf

#: Fixed value: spread in per cent of the greatest size up to which sources agree.
AGREE_PCT = 0.5
#: Grains from fine to coarse, the grain of rows that come at a cadence, and hours that a cadence may be late.
GRAINS = ("day", "week", "month", "quarter", "year")
CADENCES = {"daily": "day", "weekly": "week", "monthly": "month", "quarterly": "quarter", "yearly": "year"}
TOLERANCE = {"hourly": 2, "daily": 36, "weekly": 240, "monthly": 960}


@dataclass(frozen=True)
class Source:
    """One table of several: what it holds, how finely its rows lie, and what is known of when it was refreshed."""

    name: str
    frame: DataFrame
    schema: profile.Schema
    grain: str
    refreshed: str = ""
    basis: str = "unknown"
    cadence: str = "unknown"


def row_grain(cadence: str) -> str:
    """The grain of rows at a cadence; of rows some days apart the nearest one that holds them."""
    days = re.fullmatch(r"(\d+)(?:\.\d+)?-day", cadence)
    if cadence in CADENCES or not days:
        return CADENCES.get(cadence, "day")
    n = int(days[1])
    return "day" if n <= 3 else "week" if n <= 10 else "month" if n <= 45 else "quarter"


def describe_source(file_name: str, df: DataFrame, refreshed: str = "", cadence: str = "unknown", uploaded: str = "") -> Source:
    """A table with its schema and grain. When it was refreshed is what its system reports, else its last date, else, as
    a guess, when it came; how often it is refreshed is only what was declared."""
    schema = profile.detect_schema(df)
    if schema.date_column is None:
        raise InvalidArgument(f"{file_name} has no dates")
    dated = df.withColumn("_at", F.expr(f"try_cast(`{schema.date_column}` AS timestamp)")).where("_at is not null")
    last = dated.agg(F.max(F.col("_at").cast("date")).alias("last")).first()["last"]
    stamp, basis = next(((s, b) for s, b in ((refreshed, "source_reported"), (str(last or ""), "data_max"), (uploaded, "upload_time")) if s), ("", "unknown"))
    stem = re.sub(r"\.[^.]*$", "", file_name.replace("\\", "/").rsplit("/", 1)[-1])
    name = re.sub(r"[^a-z0-9]+", "_", stem.strip().lower()).strip("_") or "source"
    return Source(name, df, schema, row_grain(profile.grain(dated, "_at")), stamp, basis, cadence)


def compatibility(sources: list[Source]) -> tuple[list[str], list[str], list[dict]]:
    """The keys that sources can be joined by, their measures, and what stands against it: other date columns, a name that
    is a measure here and a dimension there, no measures. Columns are matched by name alone."""
    if len(sources) < 2:
        raise InvalidArgument("at least two sources are needed")
    issues: list[dict] = []
    if len({s.schema.date_column for s in sources}) > 1:
        issues.append({"kind": "grain_mismatch", "fields": sorted({s.schema.date_column for s in sources}), "blocking": True})
    measures = sorted({m for s in sources for m in s.schema.measures})
    dimensions = [set(s.schema.dimensions) for s in sources]
    issues += [{"kind": "unit_mismatch", "fields": [m], "blocking": True} for m in measures if any(m in d for d in dimensions)]
    if not measures:
        issues.append({"kind": "subset_check_failed", "fields": [], "blocking": True})
    keys = [set(profile.row_grain(s.frame, s.schema.dimensions, [s.schema.date_column])) - {s.schema.date_column} for s in sources]
    shared = set.intersection(*keys) or set.intersection(*dimensions)
    return sorted(shared), measures, issues


def target_grain(sources: list[Source], declared: list[str] = ()) -> tuple[str, str, list[str]]:
    """The grain to build at, why, and sources too coarse for what was declared: the finest declared one, but none finer
    than the coarsest source, as rows are never split up."""
    floor = max((s.grain for s in sources), key=GRAINS.index, default="day")
    known = [g for g in declared if g in GRAINS]
    if not known:
        return floor, "bootstrap_floor", []
    wanted = min(known, key=GRAINS.index)
    coarse = [s.name for s in sources if GRAINS.index(s.grain) > GRAINS.index(wanted)]
    return max(wanted, floor, key=GRAINS.index), "contract_floored" if coarse else "contract", coarse


def modes(decided: DataFrame) -> DataFrame:
    """(measure, mode, single, overlapping, corroborated, disputed): how a measure's sources met, by one aggregate."""
    n = lambda test: F.count(F.when(test, 1))
    found = decided.groupBy("measure").agg(n(F.col("sources") == 1).alias("single"), n(F.col("sources") > 1).alias("overlapping"), n(F.col("state") == "corroborated").alias("corroborated"), n(F.col("state") == "disputed").alias("disputed"))
    mode = F.when((F.col("overlapping") > 0) & (F.col("single") > 0), "mixed").when(F.col("overlapping") > 0, "overlap").otherwise("partition_or_complementary")
    return found.select("measure", mode.alias("mode"), "single", "overlapping", "corroborated", "disputed")


def freshness_of(age_hours: Column, cadence: Column, trusted: Column, rows: Column) -> Column:
    """As ``freshness``, for a frame of sources; one without rows is missing, one without an age or a cadence unknown."""
    allowed = F.try_element_at(F.create_map(*[F.lit(x) for kv in TOLERANCE.items() for x in kv]), cadence)
    return F.when(F.coalesce(rows, F.lit(0)) == 0, "missing").when(age_hours.isNull() | allowed.isNull() | ~F.coalesce(trusted, F.lit(False)), "freshness_unknown").when(age_hours > allowed, "stale").otherwise("current")


def roll_up(source: DataFrame, name: str, place: int, keys: list[str], measures: dict[str, str], grain: str = "week", as_of: str | None = None) -> DataFrame:
    """(keys..., period, measure, source, place, value): a source's measures by period; flows are summed, stocks and rates averaged.

    Sums of nothing stay null. Rows dated after the source's as-of day are dropped, by day."""
    rows = source.where(F.col("date").cast("date") <= F.lit(as_of).cast("date")) if as_of else source
    aggs = [(F.sum(m) if kind == "flow" else F.avg(m)).alias(m) for m, kind in measures.items()]
    wide = rows.withColumn("period", tf.label(F.col("date"), grain)).groupBy(*keys, "period").agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
    return wide.select(*keys, "period", F.explode(pairs).alias("x")).select(*keys, "period", "x.measure", F.lit(name).alias("source"), F.lit(place).alias("place"), "x.value")


def cells(sources: list[DataFrame], keys: list[str], authority: dict[str, str] | None = None, agree_pct: float = AGREE_PCT) -> DataFrame:
    """(keys..., period, measure, sources, spread_pct, value, state): one decision for each cell, by one aggregate over all sources.

    A single value is taken; agreeing ones corroborate each other and the first source's is taken; a dispute leaves
    the cell empty unless the measure's authority has a value.
    """
    long = reduce(DataFrame.unionByName, sources)
    named = F.create_map(*[F.lit(x) for kv in (authority or {"": ""}).items() for x in kv])
    long = long.withColumn("ruled", F.when(F.col("source") == F.try_element_at(named, F.col("measure")), F.col("value")))
    known = F.when(F.col("value").isNotNull(), F.col("place"))
    found = long.groupBy(*keys, "period", "measure").agg(F.count("value").alias("sources"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.max(F.abs("value")).alias("size"), F.min_by("value", known).alias("first"), F.max("ruled").alias("ruled"))
    spread = F.when(F.col("size") == 0, 0.0).otherwise(F.try_divide(F.col("hi") - F.col("lo"), F.col("size")) * 100)
    state = F.when(F.col("sources") == 0, "missing").when(F.col("sources") == 1, "single").when(spread <= agree_pct, "corroborated").when(F.col("ruled").isNotNull(), "resolved").otherwise("disputed")
    value = F.when(state.isin("single", "corroborated"), F.col("first")).when(state == "resolved", F.col("ruled"))
    return found.select(*keys, "period", "measure", "sources", F.when(F.col("sources") > 0, spread).alias("spread_pct"), value.alias("value"), state.alias("state"))


def coverage(decided: DataFrame, needs: dict[str, list[str]]) -> DataFrame:
    """(kpi, periods, covered, withheld): a KPI is withheld unless each of its measures has a value in every period."""
    pairs = decided.sparkSession.createDataFrame([(k, m) for k, ms in needs.items() for m in ms], "kpi string, measure string")
    periods = decided.agg(F.count_distinct("period").alias("periods"))
    held = decided.where("value is not null").groupBy("measure").agg(F.count_distinct("period").alias("covered"))
    met = F.broadcast(pairs).join(held, "measure", "left").groupBy("kpi").agg(F.min(F.coalesce("covered", F.lit(0))).alias("covered"))
    return met.crossJoin(periods).select("kpi", "periods", "covered", (F.col("covered") < F.col("periods")).alias("withheld"))


def pending(decided: DataFrame) -> DataFrame:
    """(measure, period): periods after the last that a measure covers."""
    last = decided.groupBy("measure").agg(F.max(F.when(F.col("value").isNotNull(), F.col("period"))).alias("last"))
    return decided.select("period").distinct().crossJoin(last).where("last is null or period > last").select("measure", "period")


def freshness(age_hours: float | None, cadence: str, trusted: bool = True, rows: int = 1) -> str:
    """current, stale, missing or freshness_unknown by the age that each cadence allows; only a source without rows is missing."""
    allowed = TOLERANCE.get(cadence)
    if rows == 0:
        return "missing"
    return "freshness_unknown" if age_hours is None or allowed is None or not trusted else "stale" if age_hours > allowed else "current"


def disagreement(decided: DataFrame) -> DataFrame:
    """(measure, cells, disputed, disputed_pct)."""
    n, d = F.count(F.lit(1)), F.count(F.when(F.col("state") == "disputed", 1))
    return decided.groupBy("measure").agg(n.alias("cells"), d.alias("disputed")).withColumn("disputed_pct", F.try_divide(F.col("disputed"), F.col("cells")) * 100)


