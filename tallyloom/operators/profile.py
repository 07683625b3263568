"""What a table holds: field profiles, subset relations, the grain of a row, hierarchies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.errors import InvalidArgument
from tallyloom.functions.text import words
from tallyloom.operators.order import counted, quantiles
from tallyloom.plans.kpi import Catalog
from tallyloom.sources.scratch import kept

#: Names of date columns, and words in a name that tell a measure's type, in order.
DATE_NAMES = ("date", "period", "week", "day", "month", "timestamp", "order_date")
SEMANTIC = (("flag", ("is", "has", "flag")), ("rate_pct", ("rate", "pct", "percent", "ratio", "share")), ("duration", ("hours", "days", "minutes", "duration", "time", "stay")), ("money", ("revenue", "cost", "price", "spend", "amount", "amt", "gross", "net", "profit", "value", "discount", "tax")), ("score", ("score", "rating", "nps")), ("count", ("count", "units", "orders", "customers", "qty", "quantity", "events", "number", "tickets", "returns")))
#: Years that a column without a date's name must mostly lie in, and quarters that a history should have.
YEARS, QUARTERS = (1990, 2100), 5
#: Words in a name that tell a level at a time.
STOCK = ("inventory", "balance", "headcount", "occupied", "backlog", "stock")


def semantic_type(name: str) -> str:
    own = set(words(name.replace("_", " ")))
    return next((kind for kind, marks in SEMANTIC if own & set(marks)), "unknown")


def additivity(name: str) -> str:
    own, kind = set(words(name.replace("_", " "))), semantic_type(name)
    return "rate" if kind in ("rate_pct",) else "non_additive" if kind in ("duration", "score", "flag") else "stock" if own & set(STOCK) else "flow"


def _number(c: str, kind: str) -> Column:
    return F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) if kind != "string" else F.expr(f"try_cast(`{c}` AS double)")


def _dates(c: str, i: int, kind: str) -> list[Column]:
    """How many values are dates, and how many lie in a plausible year."""
    if kind != "string" and not kind.startswith(("date", "timestamp")):
        return [F.lit(0).alias(f"t{i}"), F.lit(0).alias(f"y{i}")]
    at = F.expr(f"try_cast(`{c}` AS timestamp)")
    return [F.count(at).alias(f"t{i}"), F.count(F.when(F.year(at).between(*YEARS), 1)).alias(f"y{i}")]


@dataclass(frozen=True)
class Schema:
    date_column: str | None
    dimensions: list[str]
    measures: list[str]
    dropped: list[str]
    rows: int


def detect_schema(df: DataFrame) -> Schema:
    """Roles of columns: the date by its name, or because nine in ten values parse as one and nine in ten of these lie
    in a plausible year; measures are mostly numbers; dimensions have few values for the table. One aggregate, and one of (column, value) pairs
    over what is neither number nor date."""
    kinds = dict(df.dtypes)
    first = df.agg(F.count(F.lit(1)).alias("rows"), *[x for i, c in enumerate(df.columns) for x in (F.count(F.col(f"`{c}`")).alias(f"n{i}"), F.count(_number(c, kinds[c])).alias(f"m{i}") if kinds[c] in ("string", "double", "float", "int", "bigint", "smallint", "tinyint") or kinds[c].startswith("decimal") else F.lit(0).alias(f"m{i}"), *_dates(c, i, kinds[c]))]).first()
    numeric = {c for i, c in enumerate(df.columns) if first[f"n{i}"] and first[f"m{i}"] > 0.8 * first[f"n{i}"]}
    dated = [c for i, c in enumerate(df.columns) if c not in numeric and first["rows"] and first[f"t{i}"] > 0.9 * first["rows"] and first[f"y{i}"] > 0.9 * first[f"t{i}"]]
    date = next((c for c in DATE_NAMES if c in df.columns), dated[0] if dated else None)
    numeric.discard(date)
    texts = [c for c in df.columns if c != date and c not in numeric]
    values = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(texts)])).alias("x")).select("x.i", "x.v").where("v is not null").distinct() if texts else None
    distinct = {texts[r["i"]]: r["count"] for r in values.groupBy("i").count().collect()} if texts else {}
    few = {c for c in texts if distinct.get(c, 0) <= max(60, 0.2 * first["rows"])}
    dims = [c for c in texts if c in few]
    return Schema(date, dims, [c for c in df.columns if c in numeric], [c for c in df.columns if c != date and c not in numeric and c not in dims], first["rows"])


def validate(df: DataFrame, catalog: Catalog | None = None) -> tuple[Schema, list[str], list[str]]:
    """An upload's schema, the KPIs that it supports and warnings. A table without rows, dates or measures is refused."""
    schema = detect_schema(df)
    if not schema.rows:
        raise InvalidArgument("the table has no rows")
    if schema.date_column is None:
        raise InvalidArgument("no column holds dates; add one named date, as YYYY-MM-DD")
    at = F.expr(f"try_cast(`{schema.date_column}` AS timestamp)")
    quarters = df.select((F.year(at) * 4 + F.quarter(at)).alias("q")).where("q is not null").agg(F.count_distinct("q").alias("n")).first()["n"]
    if not quarters:
        raise InvalidArgument(f"{schema.date_column} holds no dates")
    own = catalog.available(schema.measures) if catalog else []
    used = {c for k in own for c in catalog.resolve(k, schema.measures).fields()}
    kpis = own + sorted(m for m in schema.measures if m not in used and m not in own)
    if not kpis:
        raise InvalidArgument("no column holds numbers")
    notes = [(quarters < QUARTERS, f"only {quarters} quarters of history; {QUARTERS} are needed to tell a signal from noise"), (not schema.dimensions, "no dimensions, so nothing can be broken down"), ("revenue" not in kpis, "no revenue, so the first KPI takes its place")]
    return schema, kpis, [text for holds, text in notes if holds]


def prepare(df: DataFrame, schema: Schema, preserve_missing: bool = False) -> DataFrame:
    """The fact frame: date, text dimensions with Unknown for null, numeric measures with nil for null unless kept, and
    _imputed, the number of measures filled in a row. Rows without a date go."""
    kinds = dict(df.dtypes)
    date = F.expr(f"try_cast(`{schema.date_column}` AS timestamp)").cast("timestamp_ntz").alias("date")
    numbers = {m: _number(m, kinds[m]) for m in schema.measures}
    filled = [(n if preserve_missing else F.coalesce(n, F.lit(0.0))).alias(m) for m, n in numbers.items()]
    imputed = sum((n.isNull().cast("int") for n in numbers.values()), F.lit(0)).alias("_imputed")
    return df.select(date, *[F.coalesce(F.col(f"`{d}`").cast("string"), F.lit("Unknown")).alias(d) for d in schema.dimensions], *filled, imputed).where("date is not null")


def grain(df: DataFrame, date: str = "date") -> str:
    """Daily, weekly or monthly by the median gap between distinct dates, else n-day."""
    from pyspark.sql.window import Window

    days = df.select(F.col(date).cast("date").alias("d")).distinct()
    gap = days.select(F.datediff("d", F.lag("d").over(Window.orderBy("d"))).alias("g")).agg(F.median("g").alias("m")).first()["m"]
    return "unknown" if gap is None else "daily" if gap == 1 else "weekly" if gap == 7 else "monthly" if 28 <= gap <= 31 else f"{gap:g}-day"


def profile(df: DataFrame, columns: list[str], most: int | None = None) -> DataFrame:
    """(field, rows, nulls, distinct, min, max, median, whole): numeric fields' profiles from one scan.

    The scan counts each field's values; distinct counts, extremes and the exact median come from these counts, a range of
    values at a time, so no task holds a column. A table without rows gives each field a row of nil and null.
    """
    kinds = dict(df.dtypes)
    counts = counted(df, {c: _number(c, kinds[c]) for c in columns})
    facts = counts.groupBy("field").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("value").alias("distinct"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.bool_and(F.col("value") == F.floor("value")).alias("whole"),
    )
    fields = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("field"))
    met = fields.join(facts, "field", "left").join(quantiles(counts, {"median": 0.5}, most), "field", "left")
    nil = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return met.select("field", nil("rows"), nil("nulls"), nil("distinct"), "min", "max", "median", F.coalesce("whole", F.lit(False)).alias("whole"))


def subset_relations(df: DataFrame, measures: list[str], least: float = 0.95) -> DataFrame:
    """(part, whole, share): measures that are at most another's in nearly all rows and less in sum; one aggregate for all pairs."""
    pairs = [(a, b) for a in measures for b in measures if a != b]
    aggs = [F.avg((F.col(a) <= F.col(b)).cast("double")).alias(f"s{i}") for i, (a, b) in enumerate(pairs)] + [F.sum(m).alias(f"t_{m}") for m in measures]
    rows = F.array(*[F.struct(F.lit(a).alias("part"), F.lit(b).alias("whole"), F.col(f"s{i}").alias("share"), (F.col(f"t_{a}") < F.col(f"t_{b}")).alias("less")) for i, (a, b) in enumerate(pairs)])
    return df.agg(*aggs).select(F.explode(rows).alias("x")).select("x.*").where((F.col("share") >= least) & F.col("less")).drop("less")


def containment(df: DataFrame, measures: list[str], least: float = 0.95) -> DataFrame:
    """(part, whole, n, rows_within, contained): of each two flows of one family, money or counts, how often one is at most the other.

    Rows in which both are known count; contained: in nearly all of them, and less in sum. One aggregate for all pairs; pairs
    that never meet have no row.
    """
    family = {m: "money" if semantic_type(m) == "money" else "count" for m in measures if semantic_type(m) in ("money", "count", "flag") and additivity(m) == "flow"}
    pairs = [(a, b) for a in family for b in family if a != b and family[a] == family[b]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "part string, whole string, n long, rows_within double, contained boolean")
    aggs = []
    for i, (a, b) in enumerate(pairs):
        x, y = F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")
        both = x.isNotNull() & y.isNotNull()
        aggs += [F.count(F.when(both, 1)).alias(f"n{i}"), F.avg(F.when(both, (x <= y).cast("double"))).alias(f"w{i}"), (F.sum(F.when(both, x)) < F.sum(F.when(both, y))).alias(f"l{i}")]
    rows = F.array(*[F.struct(F.lit(a).alias("part"), F.lit(b).alias("whole"), F.col(f"n{i}").alias("n"), F.col(f"w{i}").alias("rows_within"), ((F.col(f"w{i}") >= least) & F.col(f"l{i}")).alias("contained")) for i, (a, b) in enumerate(pairs)])
    return df.agg(*aggs).select(F.explode(rows).alias("x")).select("x.*").where("n > 0")


def hierarchies(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """(child, parent, members, violations): dimensions whose members nearly all lie in one member of a coarser one.

    All pairs come from one aggregate over the combinations that occur; a null member is one of its own as a child, none as a parent.
    """
    combos = kept(df.select(*[F.col(d).cast("string").alias(d) for d in dimensions]).distinct())
    pairs = F.array(*[F.struct(F.lit(c).alias("child"), F.lit(p).alias("parent"), F.col(c).alias("c"), F.col(p).alias("p")) for c in dimensions for p in dimensions if c != p])
    if len(dimensions) < 2:
        return df.sparkSession.createDataFrame([], "child string, parent string, members long, violations long")
    of = combos.select(F.explode(pairs).alias("x")).groupBy("x.child", "x.parent", "x.c").agg(F.count_distinct("x.p").alias("n"))
    of = of.groupBy("child", "parent").agg(F.count(F.lit(1)).alias("members"), F.count(F.when(F.col("n") > 1, 1)).alias("violations"))
    each = F.array(*[F.struct(F.lit(d).alias("parent"), F.col(d).alias("p")) for d in dimensions])
    coarse = combos.select(F.explode(each).alias("x")).groupBy("x.parent").agg(F.count_distinct("x.p").alias("parents"))
    met = of.join(F.broadcast(coarse), "parent").where((F.col("violations") <= F.greatest(F.lit(2), 0.25 * F.col("members"))) & (F.col("parents") < F.col("members")))
    return met.select("child", "parent", "members", "violations")


def row_grain(df: DataFrame, candidates: list[str], start: list[str] | None = None) -> list[str]:
    """A key of few columns, each chosen because it leaves the fewest repeated rows; ``start`` is in it in any case."""
    rows, key, repeated = df.count(), list(start or []), None
    if key:
        repeated = rows - df.select(*key).distinct().count()
    while True:
        rest = [c for c in candidates if c not in key]
        if not rest or repeated == 0:
            return key
        found = df.agg(*[F.count_distinct(F.struct(*[F.col(x) for x in [*key, c]])).alias(c) for c in rest]).first().asDict()
        best = max(rest, key=lambda c: (found[c], -candidates.index(c)))
        if repeated is not None and rows - found[best] >= repeated:
            return key
        key, repeated = [*key, best], rows - found[best]
