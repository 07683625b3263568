"""Places, running sums, totals and order statistics over whole columns, range by range where one task would hold too much."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions import robust
from tallyloom.sources.scratch import kept

#: Rows up to which one window takes a whole column. Beyond it a column is cut into ranges of about a quarter of that.
MOST_AT_ONCE = 200_000
#: Ranges at most; sums of ranges are that many rows.
MOST_RANGES = 20_000


def totals(df: DataFrame, within: list[str], **sums: Column) -> DataFrame:
    """``df`` with aggregates of all its rows, or of the rows of each group of the few that ``within`` has.

    Aggregated apart and broadcast, so that no task gathers the rows; these are computed once, and kept, for both.
    """
    table = kept(df)
    if not within:
        return table.crossJoin(F.broadcast(table.agg(*[v.alias(k) for k, v in sums.items()])))
    own = table.groupBy(*[F.col(c).alias(f"of_{c}") for c in within]).agg(*[v.alias(k) for k, v in sums.items()])
    met = table.join(F.broadcast(own), [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in within])
    return met.drop(*[f"of_{c}" for c in within])


def _ranges(rows: int, most: int) -> int:
    return min(MOST_RANGES, max(2, -(-4 * rows // max(1, most))))


def placed(df: DataFrame, order: list[Column], place: str = "place", running: dict[str, str] | None = None, dense: tuple[str, str] | None = None, most: int | None = None, cheap: bool = False) -> DataFrame:
    """``df`` with each row's place in an order, from 1; running sums (name: column) up to it; and the dense rank of a column.

    ``order`` has to tell all rows apart. ``dense`` names the rank and its column, which has to be the first of ``order``;
    nulls are one value. More than ``most`` rows are dealt to ranges of the order: rows are placed and summed inside
    each, and what lies before a range, a row for each range, is added. Equal values may lie in several ranges.

    ``df`` is kept first, as it is counted and read; not if it is ``cheap``, reading a kept table itself.
    """
    table, running, most = df if cheap else kept(df), running or {}, MOST_AT_ONCE if most is None else most
    rows = table.count()

    def columns(over: list[str]) -> dict[str, Column]:
        by = Window.partitionBy(*over).orderBy(*order)
        so_far = by.rowsBetween(Window.unboundedPreceding, 0)
        rank = {dense[0]: F.dense_rank().over(Window.partitionBy(*over).orderBy(order[0])).cast("long")} if dense else {}
        return {place: F.row_number().over(by).cast("long"), **{k: F.sum(c).over(so_far) for k, c in running.items()}, **rank}

    if rows <= most:
        return table.withColumns(columns([]))
    dealt = table.repartitionByRange(_ranges(rows, most), *order).withColumn("_range", F.spark_partition_id())
    inner = kept(dealt.withColumns(columns(["_range"])))
    ends = [F.max(place).alias("_n"), *[F.sum(c).alias(f"_{k}") for k, c in running.items()]]
    if dense:
        ends += [F.max(dense[0]).alias("_values"), F.min_by(dense[1], place).alias("_first"), F.max_by(dense[1], place).alias("_last")]
    by_range = Window.orderBy("_range")
    before = lambda c: F.sum(c).over(by_range.rowsBetween(Window.unboundedPreceding, -1))
    offsets = inner.groupBy("_range").agg(*ends)
    out = {place: before("_n"), **{k: before(f"_{k}") for k in running}}
    if dense:
        offsets = offsets.withColumn("_goes_on", F.when(F.lag("_n").over(by_range).isNotNull() & F.col("_first").eqNullSafe(F.lag("_last").over(by_range)), 1).otherwise(0))
        out[dense[0]] = F.coalesce(before("_values"), F.lit(0)) - F.sum("_goes_on").over(by_range.rowsBetween(Window.unboundedPreceding, 0))
    offsets = offsets.select("_range", *[v.alias(f"_before_{k}") for k, v in out.items()])
    # a running sum is null as long as only nulls came, as it is in one window
    added = {k: F.coalesce(F.col(k) + F.col(f"_before_{k}"), F.col(k), F.col(f"_before_{k}")) for k in out}
    return inner.join(F.broadcast(offsets), "_range").withColumns(added).select(*table.columns, *out)


def counted(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(field, value, n): how often each number occurs in each field, nulls too; one scan, summed before the shuffle, and kept."""
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), v.cast("double").alias("value")) for k, v in fields.items()])
    return kept(df.select(F.explode(pairs).alias("x")).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n")))


def _below(cuts: Column, value: Column, most: int) -> Column:
    """How many of at most ``most`` ascending cuts are below a value: first of every so many, then of those between two of
    these. Some twice the square root of ``most`` comparisons a row, which are compiled; a loop over an array is not."""
    step = math.isqrt(most) + 1
    under = lambda at: F.coalesce((F.get(cuts, at) < value).cast("int"), F.lit(0))
    first = sum((under(F.lit(at)) for at in range(step - 1, most, step)), F.lit(0)) * step
    return sum((under(first + k) for k in range(step - 1)), first)


def quantiles(counts: DataFrame, fractions: dict[str, float], most: int | None = None) -> DataFrame:
    """(field, names of fractions): exact quantiles of each field of ``counts``, between two values by linear interpolation.

    Over ``most`` rows, values are cut into ranges of about equal numbers of values by a sketch of fixed size; counts of the
    ranges tell which of them hold the wanted ranks, and only their values are put in order. Nulls don't count; a field
    without values has no row.
    """
    most = MOST_AT_ONCE if most is None else most
    own, rows = counts.where("value is not null"), counts.count()
    if rows <= most:
        return own.groupBy("field").agg(*[F.percentile("value", F.lit(float(p)), F.col("n")).alias(k) for k, p in fractions.items()])
    parts = min(1024, _ranges(rows, most))
    cuts = own.groupBy("field").agg(F.percentile_approx("value", [k / parts for k in range(1, parts)], 10 * parts).alias("cuts"), F.sum("n").alias("total"))
    cuts = kept(cuts)
    ranged = own.join(F.broadcast(cuts.select("field", "cuts")), "field").withColumn("range", _below(F.col("cuts"), F.col("value"), parts - 1)).drop("cuts")
    held = ranged.groupBy("field", "range").agg(F.sum("n").alias("held"))
    held = held.withColumn("before", F.sum("held").over(Window.partitionBy("field").orderBy("range")) - F.col("held"))
    at = lambda p: F.lit(float(p)) * (F.col("total") - 1)
    ends = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(e).alias("end"), f(at(p)).cast("long").alias("rank"), at(p).alias("at")) for k, p in fractions.items() for e, f in (("low", F.floor), ("high", F.ceil))]))
    wanted = cuts.select("field", "cuts", ends.alias("w")).select("field", "cuts", "w.*").join(held, "field").where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("held")))
    over, last = F.get("cuts", F.col("range") - 1).alias("over"), F.get("cuts", F.col("range")).alias("last")
    wanted = F.broadcast(kept(wanted.select("field", "range", over, last, "name", "end", "at", (F.col("rank") - F.col("before")).alias("rank"))))
    # the few ranges wanted are told by their ends, so that no value's range is sought again
    within = F.coalesce(F.col("value") > F.col("over"), F.lit(True)) & F.coalesce(F.col("value") <= F.col("last"), F.lit(True))
    inside = own.join(F.broadcast(wanted.select("field", "range", "over", "last").distinct()), "field").where(within).select("field", "range", "value", "n")
    inside = inside.withColumn("upto", F.sum("n").over(Window.partitionBy("field", "range").orderBy("value")))
    hit = inside.join(wanted, ["field", "range"]).where((F.col("upto") - F.col("n") <= F.col("rank")) & (F.col("rank") < F.col("upto")))

    def quantile(name: str) -> Column:
        end = lambda e, c: F.max(F.when((F.col("name") == name) & (F.col("end") == e), F.col(c)))
        low, high, where = end("low", "value"), end("high", "value"), end("low", "at")
        return F.when(low == high, low).otherwise(low + (high - low) * (where - F.floor(where))).alias(name)  # equal ends may be infinite

    return hit.groupBy("field").agg(*[quantile(k) for k in fractions])


def spread(values: DataFrame, value: str = "value", most: int | None = None, cheap: bool = False) -> DataFrame:
    """One row (members, centre, sigma) over the values that aren't null: median and robust sigma, as of ``robust`` for any number of rows."""
    most = MOST_AT_ONCE if most is None else most
    own = values.select(F.col(value).cast("double").alias("value")).where("value is not null")
    own = own if cheap else kept(own)
    if own.count() <= most:
        listed = own.agg(F.collect_list("value").alias("v"))
        return listed.select(F.size("v").cast("long").alias("members"), robust.median(F.col("v")).alias("centre"), robust.sigma(F.col("v")).alias("sigma"))
    counts = counted(own, {"value": F.col("value")})
    centre = kept(quantiles(counts, {"centre": 0.5}, most).select("centre"))
    away = counts.crossJoin(F.broadcast(centre)).groupBy("field", F.abs(F.col("value") - F.col("centre")).alias("value")).agg(F.sum("n").alias("n"))
    scaled = quantiles(kept(away), {"mad": 0.5}, most).select((F.col("mad") * robust.MAD_SCALE).alias("scaled"))
    plain = own.agg(F.count(F.lit(1)).alias("members"), F.coalesce(F.stddev("value"), F.lit(0.0)).alias("deviation"))
    sigma = F.when(F.col("scaled") <= robust.TINY, F.col("deviation")).otherwise(F.col("scaled"))
    return plain.crossJoin(F.broadcast(centre)).crossJoin(F.broadcast(scaled)).select("members", "centre", sigma.alias("sigma"))
