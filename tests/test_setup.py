"""Uploads, sources before they are reconciled, request records and the graph of drivers."""

import pytest

from tallyloom.errors import InvalidArgument
from tallyloom.operators import profile, reconcile, telemetry
from tallyloom.plans import driver_graph
from tallyloom.plans.contract import Basis, comparability
from tallyloom.plans.kpi import Catalog, kpi
from tallyloom.sources import files
from tallyloom.sources.facts import from_frame

DAYS = [f"2024-0{m}-0{d}" for m in range(1, 4) for d in range(1, 10)]


def upload(spark, rows, schema="date string, region string, net string"):
    return spark.createDataFrame(rows, schema)


def test_an_upload_is_described_or_refused(spark):
    df = upload(spark, [(d, "a" if k % 2 else "b", str(k)) for k, d in enumerate(DAYS)])
    schema, kpis, notes = profile.validate(df, Catalog.of([kpi("revenue", "sum", "{net}")]))
    assert (schema.date_column, schema.dimensions, schema.measures, kpis) == ("date", ["region"], ["net"], ["revenue"])
    assert len(notes) == 1 and "1 quarters" in notes[0]
    with pytest.raises(InvalidArgument, match="no rows"):
        profile.validate(df.limit(0))
    with pytest.raises(InvalidArgument, match="no column holds dates"):
        profile.validate(df.select("region", "net"))
    with pytest.raises(InvalidArgument, match="holds no dates"):
        profile.validate(upload(spark, [("x", "a", "1")]))
    with pytest.raises(InvalidArgument, match="no column holds numbers"):
        profile.validate(df.select("date", "region"))


def test_a_date_without_a_dates_name_has_plausible_years(spark):
    df = upload(spark, [("1850-01-01", "2024-01-01", "1"), ("1850-01-02", "2024-01-02", "2")], "founded string, booked string, net string")
    assert profile.detect_schema(df).date_column == "booked"
    assert profile.detect_schema(df.select("founded", "net")).date_column is None


def test_latin_and_utf16_files_are_read(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("date,city\n2024-01-01,Köln\n".encode("latin-1"))
    assert files.read_csv(spark, str(tmp_path / "x.csv")).first()["city"] == "Köln"
    (tmp_path / "u.csv").write_text("date,city\n2024-01-01,Köln\n", encoding="utf-8")
    assert files.read_csv(spark, str(tmp_path / "u.csv")).first()["city"] == "Köln"
    folder = tmp_path / "docs"
    folder.mkdir()
    for name, encoding in (("a.txt", "utf-8"), ("b.txt", "latin-1"), ("c.txt", "utf-16")):
        (folder / name).write_bytes("Überblick\nZeile".encode(encoding))
    (folder / "d.txt").write_bytes(b"")
    got = {r["document_name"]: r["text"] for r in files.read_documents(spark, str(folder)).collect()}
    assert got == {"a.txt": "Überblick\nZeile", "b.txt": "Überblick\nZeile", "c.txt": "Überblick\nZeile"}


def test_sources_are_described_compared_and_given_a_grain(spark):
    daily = reconcile.describe_source("Shop Sales-2024.csv", upload(spark, [(d, r, "1") for d in DAYS for r in "ab"]), cadence="daily")
    weekly = reconcile.describe_source("/x/Ledger.csv", upload(spark, [(d, r, "2") for d in ("2024-01-01", "2024-01-08", "2024-01-15") for r in "ab"]), refreshed="2024-02-01")
    assert (daily.name, daily.grain, daily.refreshed, daily.basis, daily.cadence) == ("shop_sales_2024", "day", "2024-03-09", "data_max", "daily")
    assert (weekly.name, weekly.grain, weekly.refreshed, weekly.basis) == ("ledger", "week", "2024-02-01", "source_reported")
    assert reconcile.compatibility([daily, weekly]) == (["region"], ["net"], [])
    assert reconcile.target_grain([daily, weekly]) == ("week", "bootstrap_floor", [])
    assert reconcile.target_grain([daily, weekly], ["quarter", "month"]) == ("month", "contract", [])
    assert reconcile.target_grain([daily, weekly], ["day"]) == ("week", "contract_floored", ["ledger"])
    with pytest.raises(InvalidArgument):
        reconcile.compatibility([daily])
    other = reconcile.describe_source("o.csv", upload(spark, [("2024-01-01", "x", "y")], "day string, region string, net string"))
    kinds = {i["kind"]: i["fields"] for i in reconcile.compatibility([daily, other])[2]}
    assert kinds == {"grain_mismatch": ["date", "day"], "unit_mismatch": ["net"]}
    assert [reconcile.row_grain(g) for g in ("daily", "3-day", "10-day", "14-day", "91-day", "unknown")] == ["day", "day", "week", "month", "quarter", "day"]


def test_records_are_summed(spark):
    rows = [("success", 10, 5, None), ("failed", None, 7, 3), ("success", 1000, None, None)]
    got = telemetry.summary(spark.createDataFrame(rows, "status string, latency_ms long, input_tokens long, prompt_tokens long")).first()
    assert (got["total_requests"], got["failed_requests"], got["average_latency_ms"], got["p95_latency_ms"]) == (3, 1, 337, 10)
    assert (got["total_input_tokens"], got["total_prompt_tokens"], got["total_completion_tokens"]) == (12, 3, 0)
    none = telemetry.summary(spark.createDataFrame([], "status string, latency_ms long")).first()
    assert (none["total_requests"], none["p95_latency_ms"], none["average_latency_ms"], none["estimated_total_cost"]) == (0, 0, 0, 0)


def test_slow_latency_is_the_one_at_its_place(spark):
    for n in (1, 2, 19, 20, 21, 100):
        rows = [((k * 37) % n,) for k in range(n)]
        got = telemetry.slow_latency(spark.createDataFrame(rows, "latency_ms long")).first()[0]
        assert got == sorted(r[0] for r in rows)[max(0, int((n - 1) * 0.95))]


def quarters(spark, pairs):
    dates = [f"{2020 + k // 4}-{1 + 3 * (k % 4):02d}-15 00:00:00" for k in range(len(pairs))]
    df = spark.createDataFrame([(d, "m", float(y), float(x)) for d, (y, x) in zip(dates, pairs, strict=True)], "date string, g string, y double, x double")
    return from_frame(df, ["g"], ["y", "x"], [kpi("out", "sum", "{y}", tags=("t",)), kpi("cause", "sum", "{x}", tags=("t",))])


def test_proposed_causes_count_only_if_the_data_bears_them_out(spark):
    wave = [100, 130, 90, 150, 80, 160, 110, 95, 140, 70, 120]
    together = driver_graph.verify(quarters(spark, [(v, 2 * v) for v in wave]), "out", ["cause"]).first()
    assert (together["status"], together["r"], together["lag"], together["weight"], together["n"]) == ("verified", 1.0, 0, 0.8, 10)
    noise = driver_graph.verify(quarters(spark, list(zip(wave, [5, 6, 5, 5, 6, 6, 5, 6, 6, 5, 5], strict=True))), "out", ["cause"]).first()
    assert (noise["status"], noise["weight"]) == ("no_association", 0.0)
    few = driver_graph.verify(quarters(spark, [(v, v) for v in wave[:4]]), "out", ["cause"]).first()
    assert (few["status"], few["n"], few["weight"]) == ("insufficient_history", 3, 0.0)
    late = [(v, w) for v, w in zip(wave[1:], wave[:-1], strict=True)]
    assert driver_graph.verify(quarters(spark, late), "out", ["cause"]).first()["status"] in ("wrong_order", "no_association")


def test_edges_name_relatives_and_what_may_not_be_compared(spark):
    f = quarters(spark, [(1, 1), (2, 2)])
    bases = {"out": Basis("quarter"), "cause": Basis("month", cadence="daily")}
    assert [(e["source"], e["relation"], e["reasons"]) for e in driver_graph.edges(f, "out", bases)] == [("cause", "semantic_tag", []), ("cause", "not_comparable", ["time_grain", "cadence"])]
    assert comparability({"a": Basis(), "b": Basis()}) == [{"kpi": "a", "other": "b", "reasons": [], "comparable": True}, {"kpi": "b", "other": "a", "reasons": [], "comparable": True}]
    known, refused = driver_graph.attach(f, "out", [], ["cause", "out"])
    assert known == [] and [r["source"] for r in refused] == ["cause"]


def test_phrases_are_found_as_whole_words_in_columns(spark):
    from tallyloom.functions.text import contains_phrase, has_phrase

    texts = ["Net revenue, by region", "net_revenue", "netrevenue", "internet revenue", "", "  ", "für die NET  --revenue", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for phrase in ("net revenue", "Für die", "revenue", "", "--"):
        got = [r[0] for r in df.select(has_phrase(df["t"], phrase)).collect()]
        assert got == [None if t is None else bool(phrase.strip("-")) and contains_phrase(t, phrase) for t in texts]


def test_members_are_sought_in_the_frame_and_remembered(spark):
    from tallyloom.plans.grounding import members
    from tallyloom.sources.facts import from_frame

    rows = spark.createDataFrame([("2026-01-01", "New York", "north", 1.0), ("2026-01-02", "York", "new york", 2.0)], "date string, city string, area string, net double").selectExpr("CAST(date AS timestamp_ntz) AS date", "city", "area", "net")
    f = from_frame(rows, ["city", "area"], ["net"])
    assert members(f, "sales in new york and York") == [{"text": "new york", "dimension": "city", "member": "New York", "ambiguous": ["area"]}]
    assert f.held("city", ["york", "paris"]) == {"york": "York"} and f.held("city", ["paris"]) == {}
    assert members(f, "") == []
