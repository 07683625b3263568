"""Places, running sums, order statistics and totals by ranges against plain arithmetic."""

import bisect
import random
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import investigate, order, profile, retrieve
from tallyloom.plans.kpi import kpi
from tallyloom.sources.facts import from_frame

RANDOM = random.Random(8)


def frame(spark, values):
    return spark.createDataFrame([(f"m{k:04}", v) for k, v in enumerate(values)], "member string, value double").repartition(5)


VALUES = [RANDOM.choice([0.0, 0.0, 0.0, 1.5, -2.0, None, RANDOM.gauss(0, 9)]) for _ in range(700)]


@pytest.mark.parametrize("most", [1000, 60, 1])
@pytest.mark.parametrize("values", [VALUES, [None] * 5, [7.0] * 90, [1.0], []])
def test_places_and_running_sums(spark, values, most):
    got = order.placed(frame(spark, values), [F.col("value").desc_nulls_last(), F.col("member")], running={"upto": "value"}, dense=("rank", "value"), most=most)
    got = sorted(((r["place"], r["member"], r["upto"], r["rank"]) for r in got.collect()))
    rows = sorted(((v is None, -(v or 0), f"m{k:04}", v) for k, v in enumerate(values)))
    upto = list(accumulate((v or 0.0) for *_, v in rows))
    distinct = list(accumulate(k == 0 or rows[k][:2] != rows[k - 1][:2] for k in range(len(rows))))
    assert [(p, m) for p, m, *_ in got] == [(k + 1, r[2]) for k, r in enumerate(rows)]
    assert [u or 0.0 for _, _, u, _ in got] == pytest.approx(upto, abs=1e-9) and [r for *_, r in got] == distinct


def test_no_range_holds_a_hot_value_alone(spark):
    """A third of all rows have one value; they are dealt to several ranges by what tells them apart."""
    values = [5.0] * 2000 + [RANDOM.random() for _ in range(4000)]
    table = frame(spark, values).repartitionByRange(order._ranges(6000, 1000), F.col("value"), F.col("member")).groupBy(F.spark_partition_id().alias("p")).count()
    assert max(r["count"] for r in table.collect()) < 1000


@pytest.mark.parametrize("most", [10_000, 50, 1])
def test_quantiles(spark, most):
    fields = {"a": VALUES, "b": [3.0] * 700, "c": [None] * 700, "d": [float(k % 7) for k in range(700)]}
    table = spark.createDataFrame(list(zip(*fields.values(), strict=True)), "a double, b double, c double, d double")
    counts = order.counted(table, {c: F.col(c) for c in fields})
    wanted = {"low": 0.0, "tenth": 0.1, "half": 0.5, "odd": 0.777, "high": 1.0}
    got = {r["field"]: [r[k] for k in wanted] for r in order.quantiles(counts, wanted, most).collect()}
    known = {k: [x for x in v if x is not None] for k, v in fields.items()}
    assert got.keys() == {"a", "b", "d"}
    for k, own in got.items():
        assert own == pytest.approx(np.quantile(known[k], list(wanted.values())).tolist(), abs=1e-9)


@pytest.mark.parametrize("most", [10_000, 20])
@pytest.mark.parametrize("values", [VALUES, [4.0] * 100, [4.0] * 99 + [9.0], [None], [2.0]])
def test_spread(spark, values, most):
    got = order.spread(frame(spark, values), most=most).first()
    known = np.array([v for v in values if v is not None])
    if not len(known):
        assert got["members"] == 0 and got["centre"] is None
        return
    centre = np.median(known)
    mad = 1.4826 * np.median(np.abs(known - centre))
    sigma = mad if mad > 1e-9 else known.std(ddof=1) if len(known) > 1 else 0.0
    assert (got["members"], got["centre"], got["sigma"]) == (len(known), pytest.approx(centre), pytest.approx(sigma))


def test_totals(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 5.0), (None, None)], "g string, v double")
    assert {r["whole"] for r in order.totals(rows, [], whole=F.sum("v")).collect()} == {8.0}
    assert sorted((str(r["g"]), r["whole"]) for r in order.totals(rows, ["g"], whole=F.sum("v")).collect()) == [("None", 5.0), ("None", 5.0), ("a", 3.0), ("a", 3.0)]


def members(spark):
    rows = [("2026-05-04" if p else "2026-02-02", f"m{k:03}", float(RANDOM.choice([0, 1, 5, 5, 5, 40, -3])) + (k if k % 11 == 0 else 0)) for k in range(160) for p in (0, 1)]
    return from_frame(spark.createDataFrame(rows, "date string, m string, v double"), ["m"], ["v"], [kpi("v", "sum", "{v}")])


def test_operators_are_alike_by_ranges(spark):
    f, a, b = members(spark), "2026-Q2", "2026-Q1"
    for run in (
        lambda most: retrieve.rank_entities(f, "v", "m", a, limit=None, most=most),
        lambda most: retrieve.rank_entities(f, "v", "m", a, order="asc", limit=3, most=most),
        lambda most: retrieve.distribution(f, "v", "m", a, most=most),
        lambda most: investigate.concentration(f, "v", "m", a, most=most),
        lambda most: investigate.bridge(f, "v", a, b, "m", max_items=7, most=most),
        lambda most: investigate.bridge(f, "v", a, b, "m", max_items=None, most=most),
        lambda most: investigate.outlier_contributors(f, "v", "m", a, b, most=most),
        lambda most: profile.profile(f.load({"v"}), ["v"], most=most),
    ):
        small, large = (sorted(map(tuple, run(most).collect()), key=str) for most in (10_000, 9))
        assert len(small) == len(large) > 0
        for x, y in zip(small, large, strict=True):
            assert x == pytest.approx(y, abs=1e-9) if all(isinstance(v, (int, float, type(None))) for v in x) else [v if not isinstance(v, float) else pytest.approx(v, abs=1e-9) for v in x] == list(y)


def test_profile_of_a_table_without_rows(spark):
    got = profile.profile(spark.createDataFrame([], "a double, b string"), ["a", "b"]).collect()
    assert sorted((r["field"], r["rows"], r["nulls"], r["distinct"], r["median"], r["whole"]) for r in got) == [("a", 0, 0, 0, None, False), ("b", 0, 0, 0, None, False)]


def test_ranges_of_values_are_found_by_halving(spark):
    cuts = [sorted(RANDOM.choices(range(40), k=k)) for k in (0, 1, 2, 3, 7, 8, 40)]
    rows = [(list(map(float, c)), v / 2) for c in cuts for v in range(-2, 84)]
    df = spark.createDataFrame(rows, "cuts array<double>, value double").withColumn("below", order._below(F.col("cuts"), F.col("value"), 40))
    assert all(r["below"] == bisect.bisect_left(r["cuts"], r["value"]) for r in df.collect())


def test_wanted_ranges_are_told_by_their_ends(spark):
    """A value's range is sought once, to count the ranges; the rows of the wanted ones come from comparisons with two ends."""
    values = [float("-inf"), -0.0, 0.0, 0.0, None, float("inf"), *[float(k // 3) for k in range(300)]]
    counts = order.counted(spark.createDataFrame([(v,) for v in values], "v double"), {"v": F.col("v")})
    found = order.quantiles(counts, {"low": 0.0, "half": 0.5, "high": 1.0}, 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "cuts" not in plan
    row = found.first()
    assert (row["low"], row["high"]) == (float("-inf"), float("inf")) and row["half"] == np.quantile([v for v in values if v is not None and abs(v) < 1e9], 0.5)
