"""Fact frames: one date, text dimensions, numeric measures, and the KPIs over them."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.errors import EmptyPeriod, InvalidArgument, UnknownDimension, UnknownMember
from tallyloom.functions import formula
from tallyloom.functions.text import normalise, normalised
from tallyloom.plans import timefilter as tf
from tallyloom.plans.kpi import Catalog, Kpi, kpi
from tallyloom.sources.scratch import kept

#: Members of a dimension that are indexed on the driver, for search in free text and for suggestions.
MOST_INDEXED = 10_000
PERIODS = {"_year": "year", "_period": "quarter", "_month": "month", "_week": "week", "_day": "day"}


@dataclass
class Facts:
    """A fact frame that is read for the columns a query needs.

    ``load`` returns the frame with at least the given columns and ``date``; joins that only bring other columns are
    left out of the plan. ``weight`` is the column that says how many rows one stands for, where rows are sums already.
    ``parts``, where dates come from a join, gives named sums of the same rows by the join's key, with ``date``, summed
    before the join, or None where a column is joined too.
    """

    load: Callable[[set[str]], DataFrame]
    dimensions: list[str]
    measures: list[str]
    catalog: Catalog
    weight: str | None = None
    parts: Callable[[set[str], dict[str, Column], Column | None], DataFrame | None] | None = None
    _members: dict[str, dict[str, str]] = field(default_factory=dict)
    _sought: dict[str, dict[str, str]] = field(default_factory=dict)

    def kpi(self, key: str) -> Kpi:
        return self.catalog.resolve(key, self.measures)

    def dimension(self, name: str) -> str:
        if name not in self.dimensions:
            raise UnknownDimension(f"no dimension {name!r}", alternatives=sorted(self.dimensions))
        return name

    def members(self, dimension: str) -> dict[str, str]:
        """Normal form to smallest spelling of a dimension's members, up to MOST_INDEXED of them; for search in free text."""
        if dimension not in self._members:
            rows = self._spellings(dimension).distinct().orderBy("m").limit(MOST_INDEXED).collect()
            self._members[dimension] = {normalise(r["m"]): r["m"] for r in reversed(rows)}
        return self._members[dimension]

    def _spellings(self, dimension: str) -> DataFrame:
        return self.load({self.dimension(dimension)}).select(F.col(dimension).cast("string").alias("m")).where("m is not null")

    def held(self, dimension: str, forms: Iterable[str]) -> dict[str, str]:
        """Those of the normal forms that are members, with the frame's smallest spelling; sought in the frame, and remembered."""
        asked, known = set(forms), self._sought.setdefault(self.dimension(dimension), {})
        if rest := sorted(asked - known.keys()):
            found = self._spellings(dimension).select(normalised(F.col("m")).alias("n"), "m").where(F.col("n").isin(rest)).groupBy("n").agg(F.min("m").alias("m")).collect()
            known |= dict.fromkeys(rest) | {r["n"]: r["m"] for r in found}
        return {form: known[form] for form in asked if known[form] is not None}

    def spellings(self, dimension: str, texts: Iterable[str]) -> list[str]:
        """The frame's own spelling of each member, the smallest of several."""
        wanted = {str(t): normalise(str(t)) for t in texts}
        known = self.held(dimension, wanted.values())
        for text, form in wanted.items():
            if form not in known:
                raise UnknownMember(dimension, text, list(self.members(dimension).values()))
        return [known[form] for form in wanted.values()]

    def member(self, dimension: str, text: str) -> str:
        """The frame's own spelling of a member."""
        return self.spellings(dimension, [text])[0]

    def filter(self, filters: dict | None) -> Column | None:
        test = None
        for name, wanted in (filters or {}).items():
            own = self.spellings(self.dimension(name), wanted if isinstance(wanted, (list, tuple)) else [wanted])
            here = F.col(name).isin(own) if len(own) > 1 else F.col(name) == own[0]
            test = here if test is None else test & here
        return test

    def rows(self, columns: Iterable[str], scope: tf.TimeFilter | Column | None = None, filters: dict | None = None) -> DataFrame:
        """Rows in scope with the given columns; period keys among them are derived."""
        columns = set(columns)
        base = {c for c in columns if c not in PERIODS} | set(filters or {})
        frame = self.load(base)
        if isinstance(scope, tf.TimeFilter):
            scope = scope.bind(self.load(set())).predicate(F.col("date"))
        if scope is not None:
            frame = frame.where(scope)
        if (test := self.filter(filters)) is not None:
            frame = frame.where(test)
        return frame.withColumns({k: tf.label(F.col("date"), grain) for k, grain in PERIODS.items() if k in columns})

    def count(self, when: Column | None = None) -> Column:
        """How many rows there are, or how many of them pass a test."""
        one = F.lit(1) if self.weight is None else F.col(self.weight)
        own = one if when is None else F.when(when, one)
        return F.count(own) if self.weight is None else F.coalesce(F.sum(own), F.lit(0))

    def needed(self, kpis: Iterable[Kpi]) -> set[str]:
        """The columns that KPIs' sums and counts take."""
        return {c for k in kpis for c in k.fields()} | ({self.weight} if self.weight else set())

    def sums(self, kpis: Iterable[Kpi], group: Iterable[str] = (), scope: tf.TimeFilter | Column | None = None, filters: dict | None = None) -> DataFrame:
        """The sums of each KPI and the rows by group: one scan, one shuffle of partial sums."""
        kpis, group = list(kpis), list(group)
        need = set(group) | self.needed(kpis)
        return self.rows(need, scope, filters).groupBy(*group).agg(*[s for k in kpis for s in k.sums()], self.count().alias("rows"))

    def pair(self, k: Kpi, current: tf.TimeFilter, baseline: tf.TimeFilter, group: Iterable[str] = (), filters: dict | None = None, others: Iterable[Kpi] = ()) -> DataFrame:
        """Sums of a KPI in two scopes side by side (suffixes _c and _b) by group, in one scan and without a join."""
        group, kpis = list(group), [k, *others]
        anchor = self.load(set())
        tests = {"_c": current.bind(anchor).predicate(F.col("date")), "_b": baseline.bind(anchor).predicate(F.col("date"))}
        need = set(group) | self.needed(kpis)
        frame = self.rows(need, tests["_c"] | tests["_b"], filters)
        sums = [s for suffix, test in tests.items() for x in kpis for s in x.sums(test, suffix)]
        counts = [self.count(test).alias(f"rows{suffix}") for suffix, test in tests.items()]
        return frame.groupBy(*group).agg(*sums, *counts)

    def daily(self, keys: Iterable[str], filters: dict | None = None) -> Facts:
        """Facts of the KPIs' sums by day: one scan, kept, a row for each day held, from which series of any grain come.

        KPIs have their keys, values and counts of rows. Means are ratios here. A join that only brings the date takes a
        row for each of its keys, not one for each fact, so less is shuffled.
        """
        kpis = [self.kpi(k) for k in keys]
        fields = {c for k in kpis for c in k.fields()}
        aggs = {n: s for k in kpis for n, s in zip(k.sum_names(), k.sums(), strict=True)} | {"_rows": F.count(F.lit(1))}
        rows = self.parts(fields | set(filters or {}), aggs, self.filter(filters)) if self.parts else None
        if rows is None:
            rows = self.rows(fields, None, filters)
        else:
            aggs = {n: F.sum(n) for n in aggs}
        sums = kept(rows.groupBy(F.date_trunc("day", F.col("date")).alias("date")).agg(*[s.alias(n) for n, s in aggs.items()]), "daily")
        tops = {k.key: k.sum_names() for k in kpis}
        own = [replace(k, kind="sum" if k.additive else "ratio", numerator=formula.Ref(tops[k.key][0]), denominator=None if k.additive else formula.Ref(tops[k.key][1]), filters=()) for k in kpis]
        return replace(from_frame(sums, [], [n for names in tops.values() for n in names], own), weight="_rows")

    def scope(self, spec: object) -> tf.TimeFilter:
        return tf.parse(spec)

    def selection(self, scope: tf.TimeFilter) -> dict:
        """What a scope covers: rows, first and last date, and which wanted periods hold none. Raises on an empty one."""
        bound = scope.bind(self.load(set()))
        row = self.rows({"_period"}, bound).agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("start"), F.max("date").alias("end"), F.collect_set(tf.label(F.col("date"), bound.grain if bound.wanted else "quarter")).alias("held")).first()
        if not row["rows"]:
            held = [r[0] for r in self.rows({"_period"}).select("_period").distinct().collect()]
            raise EmptyPeriod(scope.name, held)
        return {"label": scope.name, "rows": row["rows"], "start": str(row["start"]), "end": str(row["end"]), "periods": sorted(row["held"]), "missing": sorted(set(bound.wanted) - set(row["held"]))}


def from_frame(frame: DataFrame, dimensions: list[str], measures: list[str], kpis: Iterable[Kpi] = ()) -> Facts:
    """Facts over a frame that has a ``date`` column already."""
    if "date" not in frame.columns:
        raise InvalidArgument("a fact frame has a column named date")
    frame = frame.withColumn("date", F.col("date").cast("timestamp_ntz"))
    return Facts(lambda columns: frame.select("date", *sorted(columns & set(frame.columns) - {"date"})), list(dimensions), list(measures), Catalog.of(kpis))


SALES_KPIS = (
    kpi("revenue", "sum", "{net}", unit="currency", description="Price paid after discount.", tags=("sales", "money")),
    kpi("gross", "sum", "{gross_amt}", unit="currency", description="Price before discount.", tags=("sales", "money")),
    kpi("discount_given", "sum", "{gross_amt} - {net}", unit="currency", higher_is_better=False, description="Discount in money.", tags=("price", "money")),
    kpi("units_sold", "sum", "{quantity}", description="Units shipped.", tags=("sales", "volume")),
    kpi("returned_units", "sum", "{returned_qty}", higher_is_better=False, description="Units returned.", tags=("quality",)),
    kpi("net_price_pct", "ratio", "{net}", "{gross_amt}", scale=100.0, unit="percent", description="Net over gross price.", tags=("price",)),
    kpi("avg_selling_price", "ratio", "{net}", "{quantity}", unit="currency", description="Revenue for each unit.", tags=("price",)),
    kpi("return_rate", "ratio", "{returned_qty}", "{quantity}", scale=100.0, unit="percent", higher_is_better=False, description="Returned units over units.", tags=("quality",)),
    kpi("avg_discount", "mean", "{discount}", unit="ratio", higher_is_better=False, description="Mean discount of a line.", tags=("price",)),
)


def sales(spark: SparkSession, sf_dir: str) -> Facts:
    """Order lines as facts. Tables are joined only for the dimensions that a query names; their keys are declared unique and complete."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    own = {"gross_amt": price, "net": price * (1 - discount), "discount": discount, "quantity": F.col("l_quantity"), "tax_amt": price * (1 - discount) * F.col("l_tax"), "returned_qty": F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0), "returnflag": F.col("l_returnflag")}

    def load(columns: set[str]) -> DataFrame:
        frame = table("lineitem").join(table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        extra = {"priority": F.col("o_orderpriority")}
        if columns & {"segment", "nation", "region"}:
            frame = frame.join(table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            extra["segment"] = F.col("c_mktsegment")
        if columns & {"nation", "region"}:
            frame = frame.join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            extra["nation"] = F.col("n_name")
        if "region" in columns:
            frame = frame.join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            extra["region"] = F.col("r_name")
        if "brand" in columns:
            frame = frame.join(table("part"), F.col("l_partkey") == F.col("p_partkey"))
            extra["brand"] = F.col("p_brand")
        found = own | extra
        return frame.select(F.col("o_orderdate").alias("date"), *[found[c].alias(c) for c in sorted(columns & set(found))])

    def parts(columns: set[str], sums: dict[str, Column], test: Column | None) -> DataFrame | None:
        if not columns <= own.keys():
            return None
        lines = table("lineitem").select("l_orderkey", *[own[c].alias(c) for c in sorted(columns)])
        by_order = (lines if test is None else lines.where(test)).groupBy("l_orderkey").agg(*[s.alias(n) for n, s in sums.items()])
        return by_order.join(table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderdate").alias("date"), *sums)

    return Facts(load, ["region", "nation", "segment", "brand", "priority", "returnflag"], ["gross_amt", "net", "discount", "quantity", "tax_amt", "returned_qty"], Catalog.of(SALES_KPIS), parts=parts)


def events(spark: SparkSession, sf_dir: str) -> Facts:
    """Events as facts: one month of daily values, a short history."""
    frame = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").alias("date"), "event_type", "value", F.lit(1.0).alias("one"))
    return from_frame(frame, ["event_type"], ["value", "one"], [kpi("event_value", "sum", "{value}"), kpi("events", "sum", "{one}"), kpi("mean_value", "mean", "{value}")])
