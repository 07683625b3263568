"""Formulas, KPI sums, time scopes, names, catalogue: driver-side pieces."""

import datetime as dt

import pytest

from tallyloom.errors import EmptyPeriod, MalformedFormula, MalformedTimeFilter, UnknownDimension, UnknownKpi, UnknownMember
from tallyloom.functions import formula
from tallyloom.functions.text import contains_phrase, ngrams, normalise
from tallyloom.plans import catalogue
from tallyloom.plans import timefilter as tf
from tallyloom.plans.kpi import Catalog, RowFilter, kpi
from tallyloom.sources.facts import from_frame


def value(node, row):
    if isinstance(node, formula.Num):
        return node.value
    if isinstance(node, formula.Ref):
        return row[node.name]
    a, b = value(node.left, row), value(node.right, row)
    return {"+": a + b, "-": a - b, "*": a * b, "/": a / b if b else None}[node.sign]


@pytest.mark.parametrize("text", ["({a}-{b})/{a}*100", "-{a} + 2*{b}", "{a}-{b}-1", "{a}/({b}*2)/2", "2e1*a", "-(a-b)*-2"])
def test_parsing_keeps_the_usual_order(text):
    row = {"a": 7.0, "b": 3.0}
    assert value(formula.parse(text), row) == pytest.approx(eval(text.replace("{", "").replace("}", ""), {}, row))


@pytest.mark.parametrize("text", ["{alpha} +", "{alpha} @@ {beta}", "", "(1", "1)", "{a} {b}", "*2", "__import__('os')"])
def test_malformed_formulas_are_refused(text):
    with pytest.raises(MalformedFormula):
        formula.parse(text)


def shapes():
    return Catalog.of([kpi("alpha", "sum", "{alpha}"), kpi("beta", "sum", "{beta}"), kpi("gamma", "sum", "{alpha}-{beta}"), kpi("chi", "ratio", "{gamma}", "{alpha}"), kpi("ping", "sum", "{pong}+1"), kpi("pong", "sum", "{ping}+1")])


def test_names_of_kpis_are_expanded_and_cycles_refused():
    own = shapes()
    assert own.resolve("chi", ["alpha", "beta"]).fields() == {"alpha", "beta"}
    with pytest.raises(MalformedFormula):
        own.resolve("ping", ["alpha"])
    with pytest.raises(UnknownKpi):
        own.resolve("none", [])
    assert own.resolve("extra", ["extra"]).kind == "sum"


def test_structure_components_and_relatives():
    own, columns = Catalog.of([k for k in shapes().kpis.values() if k.key not in ("ping", "pong")]), ["alpha", "beta"]
    assert {(t["field"], t["place"], t["sign"]) for t in catalogue.structure(own, "chi", columns)["terms"]} == {("alpha", "numerator", 1), ("beta", "numerator", -1), ("alpha", "denominator", 1)}
    assert ("gamma", "numerator") in {(r.source, r.relation) for r in catalogue.components(own, "chi", columns)}
    assert "gamma" in catalogue.neighbours(own, "chi", columns)
    assert {r.relation for r in catalogue.related(own, "gamma", columns)} >= {"derivation", "shared_source_field"}
    assert catalogue.mechanical(own, "chi", "gamma", columns) == "kpi_derived_from_cause"


def test_search_ranks_by_evidence():
    own = Catalog.of([kpi("readmissions", "sum", "{readmissions}"), kpi("admissions", "sum", "{admissions}"), kpi("bed_occupancy_rate", "ratio", "{occupied}", "{beds}", tags=("capacity",))])
    assert [m["kpi"] for m in catalogue.search(own, "admissions")] == ["admissions"]
    assert catalogue.search(own, "bed occupancy")[0]["score"] == 0.85
    assert catalogue.search(own, "capacity")[0]["basis"] == "semantic_tag"
    assert catalogue.search(own, "zzz") == []


def test_names():
    assert normalise("  Product-A (new)") == "product_a_new" and contains_phrase("Total admissions", "admissions") and not contains_phrase("readmissions", "admissions")
    assert ngrams("a b c", 2) == ["a b", "b c", "a", "b", "c"]


@pytest.mark.parametrize("spec", [None, 5, {}, {"type": "era"}, {"type": "quarter", "year": 2001}, {"type": "quarter", "year": 2001, "quarter": 5}, {"type": "range", "start": "x", "end": "y"}, {"type": "latest", "grain": "era", "n": 2}, {"type": "latest", "grain": "week", "n": 0}, {"type": "months", "start": "2001", "end": 5}, "2001-Q9"])
def test_malformed_scopes_are_refused(spec):
    with pytest.raises(MalformedTimeFilter):
        tf.parse(spec)


def test_scopes_and_labels():
    assert tf.parse("2001-Q2").ranges == ((dt.date(2001, 4, 1), dt.date(2001, 7, 1)),)
    assert tf.parse({"type": "months", "start": "2000-12", "end": "2001-01"}).ranges == ((dt.date(2000, 12, 1), dt.date(2001, 2, 1)),)
    assert tf.previous(tf.parse("2001-Q1")).name == "2000-Q4" and tf.previous(tf.parse("2001")).name == "2000"
    assert tf.ordinal_label(2001 * 4 + 4, "quarter") == "2001-Q4" and tf.ordinal_label(2001 * 12 + 12, "month") == "2001-12"


@pytest.fixture(scope="module")
def small(spark):
    day = lambda k: dt.datetime(2024, 1, 1, 23, 59) + dt.timedelta(days=k)
    rows = [(day(k), ["North", "South West"][k % 2], float(k), None if k == 3 else 2.0) for k in range(200)]
    frame = spark.createDataFrame(rows, "date timestamp_ntz, region string, a double, b double")
    return from_frame(frame, ["region"], ["a", "b"], [kpi("a", "sum", "{a}"), kpi("share", "ratio", "{a}", "{b}", scale=100), kpi("late", "sum", "{a}", filters=(RowFilter("a", "gte", 100),)), kpi("nil", "ratio", "{a}", "{b}-{b}")])


def test_labels_agree_with_ordinals(small):
    for grain in tf.GRAINS:
        from pyspark.sql import functions as F

        got = small.load(set()).select(tf.label(F.col("date"), grain).alias("l"), tf.ordinal(F.col("date"), grain).alias("o"), tf.ordinal_name(tf.ordinal(F.col("date"), grain), grain).alias("n")).distinct().collect()
        assert all(r["l"] == r["n"] == tf.ordinal_label(r["o"], grain) for r in got)
        numbers = sorted(r["o"] for r in got)
        assert numbers == list(range(numbers[0], numbers[-1] + 1))


def test_a_range_takes_in_its_last_day(small):
    from tallyloom.operators.retrieve import query_kpi

    got = query_kpi(small, ["a"], {"type": "range", "start": "2024-01-01", "end": "2024-01-02"}).first()
    assert (got["a"], got["rows"]) == (1.0, 2)


def test_ratios_are_of_sums_and_undefined_ones_null(small):
    from tallyloom.operators.retrieve import query_kpi

    got = query_kpi(small, ["share", "late", "nil"], "all").first()
    assert got["share"] == pytest.approx(sum(range(200)) / (199 * 2.0) * 100) and got["late"] == sum(range(100, 200)) and got["nil"] is None


def test_members_dimensions_and_empty_periods(small):
    assert small.member("region", "south-west") == "South West"
    with pytest.raises(UnknownMember):
        small.member("region", "east")
    with pytest.raises(UnknownDimension):
        small.dimension("nation")
    with pytest.raises(EmptyPeriod):
        small.selection(tf.parse("1999"))
    assert small.selection(tf.parse({"type": "years", "values": [2023, 2024]}))["missing"] == ["2023"]


def test_a_quarter_reaches_the_scan_as_a_range(spark, sf_dir):
    from tallyloom.operators.retrieve import query_kpi
    from tallyloom.sources.facts import sales

    plan = query_kpi(sales(spark, sf_dir), ["revenue"], "2001-Q2", group_by=["priority"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    assert "customer" not in plan and "r_name" not in plan
