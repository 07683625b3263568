"""Operators against hand-computed values, independent arithmetic, and invariants; the tools by name."""

import datetime as dt
import json
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.errors import InvalidArgument, UnknownMember
from tallyloom.functions import stats
from tallyloom.operators import documents, investigate, noise, postings, profile, reconcile, relate, retrieve
from tallyloom.plans.kpi import kpi
from tallyloom.plans.registry import TOOLS, Engine
from tallyloom.sources.facts import from_frame, sales
from tallyloom.sources.scratch import scratch_path

A, B = "2026-Q2", "2026-Q1"


def theil_sen(x, y):
    i, j = np.triu_indices(len(x), 1)
    slope = float(np.median((y[j] - y[i]) / (x[j] - x[i])))
    return slope, float(np.median(y - slope * x))


def robust_sigma(x):
    scaled = 1.4826 * float(np.median(np.abs(x - np.median(x))))
    return scaled if scaled > 1e-9 else float(np.std(x, ddof=1)) if len(x) > 1 else 0.0


def grid(spark, deltas):
    return spark.createDataFrame([(f"a{i}", f"b{j}", float(v)) for i, line in enumerate(deltas) for j, v in enumerate(line)], "A string, B string, delta double")


@pytest.mark.parametrize(("deltas", "want"), [(((-10, -10), (2, 2)), {"A": 144.0, "B": 0.0}), (((-12, 0), (0, 0)), {"A": 54.0, "B": 54.0})])
def test_shapley_by_hand(spark, deltas, want):
    got = {r["dimension"]: r["phi"] for r in investigate.shapley_of(grid(spark, deltas), ["A", "B"]).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("seed", range(3))
def test_shapley_values_add_up_to_the_whole_spread(spark, seed):
    own = random.Random(seed)
    cells = spark.createDataFrame([(str(i), str(j), str(k) if k else None, own.gauss(0, 5)) for i in range(3) for j in range(2) for k in range(2)], "A string, B string, C string, delta double")
    values = np.array([r["delta"] for r in cells.collect()])
    phi = [r["phi"] for r in investigate.shapley_of(cells, ["A", "B", "C"]).collect()]
    assert sum(phi) == pytest.approx(((values - values.mean()) ** 2).sum()) and min(phi) >= -1e-9


@pytest.fixture(scope="module")
def weekly(spark):
    """Three years of weeks by region and product, with a fall of one region in the last quarter."""
    own, rows = random.Random(1), []
    for w in range(170):
        day = dt.datetime(2023, 4, 3) + dt.timedelta(weeks=w)
        for region in ("North", "South", "East"):
            for product in ("A", "B"):
                units = 100 + 6 * math.sin(2 * math.pi * w / 52) + own.gauss(0, 1)
                if region == "North" and day >= dt.datetime(2026, 4, 1):
                    units *= 0.5
                rows.append((day, region, product, units * 10, units, own.uniform(1, 2) * 50))
    frame = spark.createDataFrame(rows, "date timestamp_ntz, region string, product string, revenue double, units double, spend double").cache()
    return from_frame(frame, ["region", "product"], ["revenue", "units", "spend"], [kpi("revenue", "sum", "{revenue}", tags=("money",)), kpi("units", "sum", "{units}"), kpi("spend", "sum", "{spend}", higher_is_better=False, tags=("money",)), kpi("price", "ratio", "{revenue}", "{units}"), kpi("profit", "sum", "{revenue}-{spend}"), kpi("level", "mean", "{units}"), kpi("margin", "ratio", "{profit}", "{revenue}", scale=100)])


def test_contributions_add_up(weekly):
    for key in ("revenue", "margin"):
        rows = investigate.by_member(weekly, key, "region", A, B).collect()
        total = noise.compare(weekly, key, A, B).first()
        assert sum(r["contribution_pct"] for r in rows) == pytest.approx(100)
        assert sum(r["effect"] for r in rows) == pytest.approx(total["change"])
    assert max(rows, key=lambda r: abs(r["contribution_pct"]))["member"] == "North"


@pytest.mark.parametrize(("key", "by"), [("revenue", "region"), ("margin", "region"), ("margin", "formula"), ("profit", "formula"), ("price", "product")])
def test_bridges_close(weekly, key, by):
    steps = investigate.bridge(weekly, key, A, B, by).orderBy("step").collect()
    end = noise.compare(weekly, key, A, B).first()
    assert steps[-1]["running"] == pytest.approx(end["current"]) and steps[0]["effect"] == pytest.approx(end["baseline"])
    assert steps[-1]["effect"] == pytest.approx(0, abs=1e-6 * abs(end["current"]))


def test_cross_table_totals_are_of_their_own_slice(weekly):
    rows = retrieve.cross_tabulate(weekly, "margin", "region", "product", A).collect()
    whole = retrieve.query_kpi(weekly, ["margin"], A).first()["margin"]
    assert next(r["value"] for r in rows if r["level"] == "total") == pytest.approx(whole)
    by_region = {r["region"]: r["margin"] for r in retrieve.query_kpi(weekly, ["margin"], A, group_by=["region"]).collect()}
    assert {r["a"]: r["value"] for r in rows if r["level"] == "total_a"} == pytest.approx(by_region)
    assert len(rows) == 3 * 2 + 3 + 2 + 1


def test_the_planted_fall_is_found(weekly):
    drivers = investigate.rank_drivers(weekly, "revenue", A, B).collect()
    assert (drivers[0]["dimension"], drivers[0]["member"]) == ("region", "North")
    assert drivers[0]["outside"] > 0 and "2026-03-23" <= drivers[0]["onset"] <= "2026-04-13"
    got = noise.significance(weekly, ["revenue"], A).first()
    assert got["verdict"] in ("meaningful_signal", "within_normal_variation") and got["history"] >= 4
    north = investigate.dispersion(weekly, "revenue", "region", A).where("member = 'North'").first()
    assert north["z"] < -2
    onset = noise.changepoint(weekly, ["revenue"], "week", {"type": "range", "start": "2026-01-05", "end": "2026-06-30"}, direction="down", filters={"region": "north"}).first()
    assert onset["status"] == "ok" and "2026-03-23" <= onset["onset"] <= "2026-04-13"


def test_trend_equals_an_independent_line(weekly):
    points = relate.short(retrieve.series(weekly, ["revenue"], "month"), "revenue")
    slope, start = theil_sen(np.array([o for o, _ in points], float), np.array([v for _, v in points]))
    got = noise.trend(weekly, ["revenue"], "month").first()
    assert got["slope"] == pytest.approx(slope) and got["intercept"] == pytest.approx(start)


def test_means_are_refused_where_they_do_not_add_up(weekly):
    for call in (lambda: investigate.bridge(weekly, "level", A, B, "region"), lambda: investigate.concentration(weekly, "level", "region", A), lambda: investigate.rate_mix(weekly, "revenue", "region", A, B), lambda: investigate.compare_cohorts(weekly, "revenue", {"region": "north"}, {"product": "a"}, A, B)):
        with pytest.raises(InvalidArgument):
            call()


def test_seasonality_of_a_yearly_wave(weekly):
    phases = {r["phase"]: r["effect"] for r in relate.seasonal_phases(weekly, "units", "quarter", {"region": "south"}).collect()}
    assert min(phases[2], phases[3]) > 0 > max(phases[1], phases[4]) and np.median(list(phases.values())) == pytest.approx(0, abs=1e-6)
    assert relate.autocorrelation(weekly, "level", "month", {"region": "south"}).first()["acf"] > 0.3


def test_gaps_are_the_calendar_s(spark):
    frame = spark.createDataFrame([(dt.datetime(2024, m, 5), 1.0) for m in (1, 2, 5)], "date timestamp_ntz, v double")
    f = from_frame(frame, [], ["v"], [kpi("v", "sum", "{v}")])
    assert sorted(r["period"] for r in retrieve.gaps(retrieve.series(f, ["v"], "month"), "month").collect()) == ["2024-03", "2024-04"]


def test_histogram_of_a_constant(spark):
    frame = spark.createDataFrame([(dt.datetime(2024, 1, 5), d, 3.0) for d in "abc"], "date timestamp_ntz, d string, v double")
    rows = retrieve.histogram(from_frame(frame, ["d"], ["v"], [kpi("v", "sum", "{v}")]), "v", "d", bins=4).orderBy("bin").collect()
    assert (rows[0]["low"], rows[-1]["high"], sum(r["members"] for r in rows)) == (2.5, 3.5, 3)


# -- statistics --------------------------------------------------------------------------------------------------------


def test_tails_and_intervals():
    assert stats.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=2e-4) and stats.t_two_sided(12.706, 1) == pytest.approx(0.05, abs=1e-4) and stats.t_two_sided(0, 5) == pytest.approx(1)
    low, high = stats.fisher_interval(0.5, 28)
    assert (low, high) == (pytest.approx(0.1561, abs=1e-3), pytest.approx(0.7357, abs=1e-3))
    assert stats.q_values([0.01, 0.04, 0.03, None]) == [pytest.approx(0.03), pytest.approx(0.04), pytest.approx(0.04), None]


# -- sources, profiles, text -------------------------------------------------------------------------------------------


def test_schema_and_preparation(spark):
    rows = [("2024-01-01", "North", "5", "x1"), ("2024-01-08", None, None, "x2"), ("2024-01-15", "South", "7.5", "x3"), (None, "South", "1", "x4")] + [(f"2024-02-{d:02d}", "North", str(d), f"y{d}") for d in range(1, 29)]
    df = spark.createDataFrame(rows, "week string, region string, revenue string, note string")
    schema = profile.detect_schema(df)
    assert (schema.date_column, schema.dimensions, schema.measures, schema.rows) == ("week", ["region", "note"], ["revenue"], 32)
    ready = profile.prepare(df, schema)
    assert ready.count() == 31 and ready.where("region = 'Unknown' and revenue = 0 and _imputed = 1").count() == 1
    assert profile.prepare(df, schema, preserve_missing=True).where("revenue is null").count() == 1
    assert profile.grain(ready) == "daily" and profile.semantic_type("stockout_rate") == "rate_pct" and profile.additivity("inventory_units") == "stock"
    assert profile.row_grain(ready, ["date", "region", "note"]) == ["date"]


def test_cells_agree_dispute_and_resolve(spark):
    src = lambda name, place, rows: spark.createDataFrame([(*r, name, place) for r in rows], "k string, period string, measure string, value double, source string, place int")
    one = src("sales", 0, [("a", "p1", "m", 100.0), ("b", "p1", "m", 100.0), ("c", "p1", "m", 5.0), ("d", "p1", "m", None)])
    two = src("finance", 1, [("a", "p1", "m", 100.4), ("b", "p1", "m", 120.0), ("d", "p1", "m", None)])
    got = {r["k"]: (r["value"], r["state"]) for r in reconcile.cells([one, two], ["k"]).collect()}
    assert got == {"a": (100.0, "corroborated"), "b": (None, "disputed"), "c": (5.0, "single"), "d": (None, "missing")}
    ruled = {r["k"]: (r["value"], r["state"]) for r in reconcile.cells([one, two], ["k"], {"m": "finance"}).collect()}
    assert ruled["b"] == (120.0, "resolved") and ruled["a"] == (100.0, "corroborated")
    assert [reconcile.freshness(*x) for x in ((None, "daily"), (1, "daily"), (40, "daily"), (1, "yearly"), (1, "daily", True, 0), (1, "daily", False))] == ["freshness_unknown", "current", "stale", "freshness_unknown", "missing", "freshness_unknown"]


def test_chunks_overlap_and_short_tails_go(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(300))), (2, "only these"), (3, None), (4, "# One\nbody here\n# Two\nmore body")], "doc_id long, text string")
    got = {}
    for r in documents.chunks(docs).orderBy("chunk").collect():
        got.setdefault(r["doc_id"], []).append(r["text"].split())
    assert [len(c) for c in got[1]] == [170, 170, 40] and got[1][0][-40:] == got[1][1][:40]
    assert got[2] == [["only", "these"]] and 3 not in got and got[4] == [["body", "here"], ["more", "body"]]
    assert [r["heading"] for r in documents.chunks(docs).where("doc_id = 4").orderBy("chunk").collect()] == ["One", "Two"]
    edge = spark.createDataFrame([(1, "w " * 170), (2, "w " * 194), (3, "w " * 195), (4, "## Only\n# Headings")], "doc_id long, text string")
    assert {r["doc_id"]: r["count"] for r in documents.chunks(edge).groupBy("doc_id").count().collect()} == {1: 1, 2: 2, 3: 2, 4: 1}


def test_a_heading_ends_with_its_line_whatever_breaks_it(spark):
    breaks = ["\n", "\r\n", "\r", "\x85", "\u2028", "\u2029"]
    docs = spark.createDataFrame([(k, f"before{b}# One two{b}body here{b}  ## Three {b}more{b}{b}body") for k, b in enumerate(breaks)], "doc_id int, text string")
    got = {}
    for r in documents.chunks(docs).orderBy("chunk").collect():
        got.setdefault(r["doc_id"], []).append((r["heading"], r["text"].split()))
    assert got == {k: [("", ["before"]), ("One two", ["body", "here"]), ("Three", ["more", "body"])] for k in range(len(breaks))}


def test_long_blanks_and_hostile_headings_stay_linear(spark):
    hostile = ["x" + " " * 5_000_000 + "y", "\n" * 3_000_000, "#" * 2_000_000, "# " * 2_000_000, "a\n   # " + " " * 3_000_000]
    docs = spark.createDataFrame(list(enumerate(hostile)), "doc_id int, text string")
    began = time.monotonic()
    got = documents.chunks(docs).groupBy("doc_id").count().collect()
    assert time.monotonic() - began < 20 and {r["doc_id"] for r in got} >= {0, 2, 3}


def brute_bm25(texts, query, phrases=()):
    """Scores by the definition, over (ids, heading, text)."""
    cut = lambda t: [x for x in re.findall(r"[a-z0-9][a-z0-9_%.\-]*", t.lower()) if len(x) > 1 and x not in documents.STOP_WORDS]
    docs = {ids: cut(f"{h or ''} {t or ''}") for ids, h, t in texts}
    average, out = sum(map(len, docs.values())) / max(1, len(docs)), {}
    for ids, h, t in texts:
        own, score = docs[ids], 0.0
        for word in cut(query):
            df, tf = sum(word in d for d in docs.values()), own.count(word)
            if tf:
                score += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(own) / average))
        held = sum(p.lower() in f"{h or ''} {t or ''}".lower() for p in phrases)
        if score > 0 and (held or not phrases):
            out[ids] = score * (1 + 0.45 * held)
    return out


def index(pieces, spark, **more):
    return postings.build(pieces, scratch_path(spark, "postings"), **more)


def test_bm25_by_brute_force(spark):
    picks = random.Random(4)
    words = ["stock", "level", "the", "north", "q3", "x", "5%", "out-of-stock", "Stock", "fell", "é"]
    texts = [((d, c), picks.choice([None, "", "Stock levels", "North"]), picks.choice([None, "", " ".join(picks.choice(words) for _ in range(picks.randint(0, 60)))])) for d in range(60) for c in range(3)]
    texts += [((900 + k, 0), None, "stock") for k in range(200)]  # one word in most pieces
    pieces = spark.createDataFrame([(*ids, h, t) for ids, h, t in texts], "doc_id long, chunk long, heading string, text string")
    for buckets in (1, 7):
        found = index(pieces, spark, buckets=buckets)
        for query, phrases in (("stock level level", []), ("north 5% nowhere", ["q3", "stock"]), ("out-of-stock", ["missing"]), ("the x", []), ("", [])):
            got = {(r["doc_id"], r["chunk"]): r["score"] for r in found.search(query, must_include=phrases, limit=None).collect()}
            assert got == pytest.approx(brute_bm25(texts, query, phrases), abs=6e-5), (query, phrases)
        top = [(r["doc_id"], r["chunk"]) for r in found.search("stock north", limit=5).collect()]
        want = brute_bm25(texts, "stock north")
        assert top == sorted(want, key=lambda k: (round(want[k], 9), k), reverse=True)[:5]


def test_bm25_reads_the_buckets_of_its_terms_only(spark):
    pieces = spark.createDataFrame([(k, 0, "", f"word{k} common") for k in range(500)], "doc_id long, chunk long, heading string, text string")
    found = index(pieces, spark)
    plan = found.postings(["word7"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,word7)]" in plan
    assert [(r["doc_id"], r["tf"], r["dl"]) for r in found.postings(["word7"]).collect()] == [(7, 1, 2)]
    again = postings.read(spark, found.path)
    assert again == found and again.n == 500 and again.average == 2.0 and again.frequencies(["common", "none"]) == {"common": 500}


def test_bm25_of_nothing(spark):
    none = index(spark.createDataFrame([], "doc_id long, chunk long, heading string, text string"), spark)
    assert none.n == 0 and none.search("stock").collect() == [] and none.search("").columns == ["doc_id", "chunk", "score", "hits", "relevance", "strength"]
    empty = index(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), spark, ids=("doc_id",), heading_col=None)
    assert empty.n == 2 and empty.search("stock").collect() == []


def test_bm25_counts_a_word_asked_twice_twice(spark):
    docs = spark.createDataFrame([(1, "stock stock level"), (2, "level of service"), (3, "nothing here")], "doc_id long, text string")
    found = index(documents.chunks(docs), spark)
    one = {r["doc_id"]: r["score"] for r in found.search("level").collect()}
    two = {r["doc_id"]: r["score"] for r in found.search("level level").collect()}
    assert set(one) == {1, 2} and two == pytest.approx({k: 2 * v for k, v in one.items()}, abs=1e-4)
    assert found.search("the of").count() == 0


def test_bm25_phrases_headings_floor_and_shares(spark):
    docs = index(documents.chunks(spark.createDataFrame([(1, "# Stock levels\nlow in the north"), (2, "stock was low\n## South\nstock fine"), (3, "Low stock in the NORTH")], "doc_id long, text string")), spark)
    found = docs.search("stock", must_include=["the north", "low"]).collect()
    assert {(r["doc_id"], r["chunk"]) for r in found} == {(1, 0), (2, 0), (3, 0)} and found[0]["relevance"] == 1
    plain = {(r["doc_id"], r["chunk"]): r["score"] for r in docs.search("stock").collect()}
    for r in found:
        assert r["score"] == pytest.approx(plain[r["doc_id"], r["chunk"]] * (1.9 if r["doc_id"] != 2 else 1.45), abs=2e-4)
        assert r["strength"] == pytest.approx(r["score"] / 9, abs=1e-3)
    assert docs.search("stock", min_score=postings.LEAST_SCORE).count() == 0
    assert docs.search("stock", exclude=F.col("doc_id") == 2).count() == 2


def test_document_types(spark):
    cases = [("q3_sales_report.md", "", "sales_report"), ("x", "The board met", "management_commentary"), ("cfo_budget.txt", None, "management_commentary"), ("a", "p&l for June", "financial_report"), ("NPS.csv", "sales", "customer_feedback"), ("devops", "x", "business_document"), ("ops ", "", "operations_report"), ("n", "z" * 1500 + "survey", "business_document"), (None, None, "business_document")]
    frame = spark.createDataFrame([(n, t, w) for n, t, w in cases], "name string, text string, want string")
    assert all(r["got"] == r["want"] for r in frame.select("want", documents.doc_type(F.col("name"), F.col("text")).alias("got")).collect())


# -- tools by name -----------------------------------------------------------------------------------------------------

GOOD = {"kpi": "revenue", "kpis": ["units", "spend"], "dimension": "region", "dimensions": ["region", "product"], "time": A, "filters": {"product": "a"}, "text": "north", "integer": 3, "number": 2.0, "flag": True, "list": [], "grain": "month", "mode": "time_series", "order": "asc"}
SPECIAL = {"kpi_b": "units", "cause_kpi": "units", "period_b": B, "member_b": "south", "inner_dimension": "product", "dim_b": "product", "filter_a": {"region": "north"}, "filter_b": {"region": "south"}, "candidates": ["spend", "price"]}


def arguments(tool, all_of_them):
    own = {}
    for a, kind in tool.arguments.items():
        if a in tool.required or (all_of_them and a in ("period_a", "period_b", "dimension", "filters")):
            own[a] = SPECIAL.get(a, GOOD[kind])
    if tool.name == "filter_material_changes":
        own["candidates"] = [{"change_pct": 5.0, "z": 3.0}, {"change_pct": 1.0}, {"change_pct": None}, {"change_pct": 9.0, "z": 0.1}]
    if tool.name == "test_statistical_significance":
        own["candidates"] = ["units", "spend"]
    if tool.name == "decompose_rate_mix":
        own["kpi_key"] = "margin"
    if tool.name == "decompose_formula":
        own["kpi_key"] = "profit"
    if "filters" in own and own.get("dimension") == "product":
        del own["filters"]
    return own


def test_there_are_58_tools_with_schemas(weekly):
    engine = Engine(weekly)
    assert len(TOOLS) == 58
    for name in TOOLS:
        json.dumps(engine.schema(name))


@pytest.mark.parametrize("name", sorted(TOOLS))
def test_each_tool_answers(weekly, name):
    engine, t = Engine(weekly), TOOLS[name]
    got = engine.call(name, arguments(t, True))
    json.dumps(got, allow_nan=False)
    assert got["status"] != "error", got


def test_material_changes_say_why_not(weekly):
    got = Engine(weekly).call("filter_material_changes", arguments(TOOLS["filter_material_changes"], False))["candidates"]
    assert [c["reason"] for c in got] == [None, "below_pct", "no_change", "below_z"]


@pytest.mark.parametrize("seed", range(4))
def test_no_arguments_make_a_tool_raise(weekly, seed):
    own, engine = random.Random(seed), Engine(weekly)
    junk = [None, 5, -1, "x", "", [], {}, {"type": "era"}, ["revenue"], {"region": "nowhere"}, float("nan"), True, "revenue", "2026-Q2"]
    for name in sorted(TOOLS):
        t = TOOLS[name]
        given = {a: own.choice(junk) for a in t.arguments if own.random() < 0.7} | ({"bogus": 1} if own.random() < 0.3 else {})
        if all(a in given and isinstance(given[a], str) for a in t.required) and not given.get("bogus"):
            given["bogus"] = 1  # keep the fuzz to refusals: what is valid is run above
        got = engine.call(name, given)
        json.dumps(got, allow_nan=False)
        assert got["tool"] == name
    assert engine.call("no_such_tool")["error"]["code"] == "invalid_argument" and engine.call("query_kpi", 5)["status"] == "error"


@pytest.fixture(scope="module")
def wide(spark):
    rows = spark.range(24_000).select((F.col("id") % 12_000).alias("k"), (F.col("id") < 12_000).alias("before"))
    days = F.when(F.col("before"), F.lit("2026-02-01")).otherwise(F.lit("2026-05-01")).cast("timestamp_ntz")
    amount = F.when(F.col("before"), 1.0).otherwise(2.0 + F.col("k") % 7)
    frame = rows.select(days.alias("date"), F.format_string("Item %05d", "k").alias("item"), amount.alias("amount"))
    return from_frame(frame.cache(), ["item"], ["amount"], [kpi("total", "sum", "{amount}")])


@pytest.mark.parametrize("most", [None, 0, 3])
def test_folded_members_are_all_of_the_rest(wide, most):
    got = Engine(wide).call("decompose_by_dimension", {"kpi_key": "total", "dimension": "item", "period_a": A, "period_b": B} | ({} if most is None else {"max_items": most}))
    shown = 5 if most is None else most
    assert len(got["members"]) == shown and got["others"]["members"] == 12_000 - shown
    assert sum(r["effect"] for r in got["members"]) + got["others"]["effect"] == pytest.approx(sum(1.0 + k % 7 for k in range(12_000)))


def test_members_beyond_the_index_are_found(wide):
    assert wide.member("item", "item-11999") == "Item 11999"
    assert wide.rows(["amount"], filters={"item": ["item 00001", "ITEM 11998"]}).count() == 4
    with pytest.raises(UnknownMember):
        wide.member("item", "item 12000")


def test_candidates_are_not_cut_unseen(spark):
    days = F.when(F.col("id") < 8, F.lit("2026-02-01")).otherwise(F.lit("2026-05-01")).cast("timestamp_ntz")
    frame = spark.range(16).select(days.alias("date"), F.format_string("m%d", F.col("id") % 8).alias("item"), (1 + F.col("id") * F.col("id") % 11).cast("double").alias("amount"))
    engine = Engine(from_frame(frame, ["item"], ["amount"], [kpi(f"k{n}", "sum", "{amount}") for n in range(34)]))
    scope = {"mode": "cross_sectional", "dimension": "item", "period_a": A, "period_b": B}
    refused = engine.call("test_confounders", {"kpi_key": "k0", "cause_kpi": "k1", "candidates": [f"k{n}" for n in range(2, 13)], **scope})
    assert refused["error"]["code"] == "invalid_argument"
    asked = [f"k{n}" for n in range(2, 12)]
    assert len(engine.call("test_confounders", {"kpi_key": "k0", "cause_kpi": "k1", "candidates": ["k0", *asked, *asked], **scope})["each"]) == 10
    cut = engine.call("correlate_kpi_matrix", {"kpi_key": "k0", "candidates": [f"k{n}" for n in range(1, 33)], **scope})
    assert (cut["considered"], cut["truncated"], len(cut["rows"])) == (32, True, 30)
    whole = engine.call("correlate_kpi_matrix", {"kpi_key": "k0", "candidates": [f"k{n}" for n in range(1, 5)], **scope})
    assert (whole["considered"], whole["truncated"], len(whole["rows"])) == (4, False, 4)


def test_matrix_leaves_the_kpi_out_and_caps_candidates_first(spark):
    frame = spark.createDataFrame([(d, m, float(k + 1) * v) for k, m in enumerate("abcdefgh") for d, v in (("2026-02-01", 1.0), ("2026-05-01", 1.0 + (k * k % 5) / 10))], "date string, item string, amount double")
    engine = Engine(from_frame(frame, ["item"], ["amount"], [kpi(f"k{n}", "sum", "{amount}") for n in range(6)]))
    found = engine.call("correlate_kpi_matrix", {"kpi_key": "k0", "candidates": ["k5", "k0", "k1", "k2"], "limit": 2, "period_a": A, "period_b": B})
    assert {r["other"] for r in found["rows"]} == {"k5", "k1"} and (found["considered"], found["truncated"], found["dimension"]) == (3, True, "item")


def test_the_dimension_of_most_shared_members_is_picked(spark):
    rows = [(d, f"z{k % 6}", f"b{k % 4}", f"only{k}{d}", "one", float(k)) for d in ("2026-02-01", "2026-05-01") for k in range(24)] + [("2026-05-01", "new", None, "x", "one", 1.0)]
    f = from_frame(spark.createDataFrame(rows, "date string, z string, b string, apart string, same string, v double"), ["z", "b", "apart", "same"], ["v"], [kpi("v", "sum", "{v}")])
    assert {r["dimension"]: r["shared"] for r in relate.shared_members(f, A, B).collect()} == {"z": 6, "b": 4, "apart": 0, "same": 1}
    assert relate.usable_dimension(f, A, B) == "z"
    with pytest.raises(InvalidArgument, match="no dimension"):
        relate.usable_dimension(f, A, B, {"z": ["z0"]})
    wide = from_frame(spark.createDataFrame([(d, f"m{k}", f"n{k % 3}", 1.0) for d in ("2026-02-01", "2026-05-01") for k in range(201)], "date string, m string, n string, v double"), ["m", "n"], ["v"], [kpi("v", "sum", "{v}")])
    assert relate.usable_dimension(wide, A, B) == "n"


def test_precedence_names_edges_gaps_and_directions(spark):
    weeks = [dt.date(2025, 1, 6) + dt.timedelta(weeks=k) for k in range(60)]
    value = lambda k, at, up: 100.0 + k % 3 + (30.0 if up else -30.0) * (k >= at)
    rows = [(str(w), value(k, 40, True), value(k, 30, False), value(k, 11, True)) for k, w in enumerate(weeks) if k not in (33, 36, 50)]
    f = from_frame(spark.createDataFrame(rows, "date string, y double, x double, z double"), [], ["y", "x", "z"], [kpi(k, "sum", "{" + k + "}") for k in "yxz"])
    got = relate.precedence(f, "y", "x").first()
    assert (got["lag"], got["verdict"], got["gaps_between"], got["kpi_at_edge"], got["cause_at_edge"], got["searched"]) == (10, "cause_precedes_kpi", 2, False, False, 57)
    early = relate.precedence(f, "y", "z").first()
    assert early["cause_at_edge"] and not early["kpi_at_edge"] and early["lag"] == 29
    assert relate.precedence(f, "y", "x", cause_direction="up").first()["status"] == "cause_undetermined"
    assert relate.precedence(f, "x", "y", kpi_direction="down").first()["verdict"] == "kpi_precedes_cause"
    with pytest.raises(InvalidArgument):
        relate.precedence(f, "y", "x", kpi_direction="sideways")


def test_typed_errors(weekly):
    engine = Engine(weekly)
    code = lambda name, **a: engine.call(name, a)["error"]["code"]
    assert code("query_kpi", kpi_keys=["nope"], time_filter=A) == "unknown_kpi"
    assert code("rank_entities", kpi_key="revenue", dimension="nope", time_filter=A) == "unknown_dimension"
    assert code("query_kpi", kpi_keys=["revenue"], time_filter="1999-Q1") == "empty_period"
    assert code("query_kpi", kpi_keys=["revenue"], time_filter={"type": "era"}) == "malformed_time_filter"
    assert code("compare_segments", kpi_key="revenue", dimension="region", member_a="west", member_b="south", period_a=A) == "unknown_member"
    assert engine.call("assess_significance", {"kpi_key": "revenue", "period_a": "2026-05"})["status"] == "unsupported_baseline"
    assert engine.call("measure_concentration", {"kpi_key": "margin", "dimension": "region", "time_filter": A})["status"] == "not_additive"
    assert engine.call("detect_seasonality", {"kpi_key": "revenue", "grain": "day"})["status"] == "unsupported_grain"


def test_sales_facts_lose_no_row(spark, sf_dir):
    f = sales(spark, sf_dir)
    assert f.load(set(f.dimensions)).count() == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()


def test_the_overview_holds_together(weekly):
    from tallyloom.operators.observe import default_kpi, observe

    assert default_kpi(weekly) == "revenue"
    got = observe(weekly, "revenue", A)
    value = got["value"].first()
    assert value["change"] == pytest.approx(sum(r["effect"] for r in got["members_region"].collect()))
    assert {r["kpi"] for r in got["scoreboard"].collect()} == set(weekly.catalog.kpis)
    assert got["focus"].where("member = 'North'").count() == 1 and got["weeks"].count() <= 41


def test_one_frame_of_the_overview_runs_no_other(weekly, monkeypatch):
    from tallyloom.operators import observe

    def refused(*args, **kwargs):
        raise AssertionError("nobody asked for this")

    for name in ("rank_drivers", "shapley", "focus", "by_member", "movement"):
        monkeypatch.setattr(observe.investigate, name, refused)
    got = observe.observe(weekly)
    assert got["quarters"].count() > 1 and got["weeks"].count() <= 41 and got["value"].count() == 1
    assert {"attribution", "drivers", "focus", "members_region", "scoreboard"} <= set(got)
    with pytest.raises(AssertionError):
        got["drivers"]


def test_anomalies_come_from_one_scan(weekly):
    from dataclasses import replace

    from tallyloom.plans.registry import Engine

    keys, loads = list(weekly.catalog.kpis), []
    for grain in ("day", "week", "quarter"):
        names = ["ord", *keys]
        want, got = (sorted(map(tuple, noise.series(f, keys, grain).select(*names).collect())) for f in (weekly, weekly.daily(keys)))
        assert len(want) == len(got) and all(a == pytest.approx(b) for a, b in zip(want, got, strict=True))
    counting = replace(weekly, load=lambda columns: (loads.append(columns), weekly.load(columns))[1])
    assert Engine(counting).call("scan_anomalies", {"time_filter": A})["anomalies"] is not None
    assert len(loads) == 1


def test_questions_are_grounded(weekly):
    from tallyloom.plans.grounding import ground, periods

    got = ground(weekly, "Why did revenue in the north fall in Q2 2026 versus Q1 2026?")
    assert got["kpi"] == "revenue" and got["members"][0]["member"] == "North" and [p["quarter"] for p in got["periods"]] == [2, 1] and len(got["sides"]) == 2
    assert periods("from 1999 to 2001, May 2000 and the last 3 weeks") == [{"type": "years", "values": [1999, 2000, 2001]}, {"type": "months", "start": "2000-05", "end": "2000-05"}, {"type": "latest", "grain": "week", "n": 3}]
    assert ground(weekly, "nothing known here")["kpi"] is None


def test_values_and_histories_of_the_overview_come_from_one_scan(weekly):
    from dataclasses import replace

    from tallyloom.operators.observe import latest, observe
    from tallyloom.plans import timefilter as tf

    loads = []
    counting = replace(weekly, load=lambda columns: (loads.append(columns), weekly.load(columns))[1])
    got = observe(counting)
    names = ("quarters", "weeks", "value", "significance")
    found = {n: got[n].collect() for n in names}
    assert len(loads) == 1
    now = latest(weekly)
    want = {"quarters": retrieve.series(weekly, ["revenue"], "quarter"), "weeks": retrieve.series(weekly, ["revenue"], "week", {"type": "latest", "grain": "quarter", "n": 3}), "value": noise.compare(weekly, "revenue", now, tf.previous(now)), "significance": noise.significance(weekly, ["revenue"], now.name)}
    for n in names:
        rows, plain = (sorted(x, key=str) for x in (found[n], want[n].collect()))
        assert want[n].columns == got[n].columns and len(rows) == len(plain) > 0
        for a, b in zip(rows, plain, strict=True):
            assert all(x == pytest.approx(y) if isinstance(y, float) else x == y for x, y in zip(a, b, strict=True)), n


def test_bm25_shuffles_and_sorts_a_row_for_each_term_of_a_batch(spark):
    """A term's pieces of one Arrow batch are one row of lists, from the counting on; null and text ids come back as they are."""
    rows = [(None if k == 7 else f"d{k}", f"word{k % 50} common common") for k in range(400)]
    found = index(spark.createDataFrame(rows, "name string, text string").coalesce(1), spark, ids=("name",), heading_col=None)
    held = spark.read.parquet(f"{found.path}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("rows"), F.sum("df").alias("df"), F.sum("words").alias("words")).collect()
    assert {r["term"]: (r["rows"], r["df"], r["words"]) for r in held} == {"common": (1, 400, 800), **{f"word{k}": (1, 8, 8) for k in range(50)}}
    got = found.postings(["common", "word7"]).collect()
    assert sorted((r["term"], str(r["name"]), r["tf"], r["dl"]) for r in got) == sorted([("common", str(n), 2, 3) for n, _ in rows] + [("word7", str(n), 1, 3) for n, t in rows if t.startswith("word7 ")])
    assert found.n == 400 and found.average == 3.0 and found.frequencies(["common", "word7"]) == {"common": 400, "word7": 8}


def test_bm25_reads_the_pieces_once_for_scores_and_best(spark):
    found = index(spark.createDataFrame([(k, f"word{k % 5} common thing") for k in range(40)], "doc_id long, text string"), spark, ids=("doc_id",), heading_col=None)
    got = found.search("word3", must_include=["common thing"], limit=None)
    assert not any("/pieces/" in f for f in got.inputFiles())  # they were read before, into what is shown
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(3, 40, 5)) and {r["relevance"] for r in got.collect()} == {1.0}


def test_sums_by_day_join_orders_once_their_lines_are_summed(spark, sf_dir, tmp_path, monkeypatch):
    """The join that brings the date takes a row of sums for each order; nulls, lines without an order and filters count as they do line by line."""
    from dataclasses import replace

    from tallyloom.operators.observe import observe
    from tallyloom.plans.kpi import Catalog, RowFilter
    from tallyloom.sources import facts

    planned = []
    with monkeypatch.context() as m:
        m.setattr(facts, "kept", lambda df, name: (planned.append(df._jdf.queryExecution().optimizedPlan().toString()), df)[1])
        observe(sales(spark, sf_dir))["value"]
    plan = planned[0]
    assert len(planned) == 1 and plan.count("Join ") == 1 and plan.index("Join ") < plan.index("Aggregate [l_orderkey")

    for table in ("customer", "nation", "region"):
        (tmp_path / f"{table}.parquet").symlink_to(f"{sf_dir}/{table}.parquet")
    days = [dt.datetime(2026, 1, 31, 23), dt.datetime(2026, 1, 31), dt.datetime(2026, 4, 1), None]
    orders = [(k, k % 3, days[k], "1-URGENT") for k in range(4)]
    lines = [(key, price, rate, quantity, flag) for key in (0, 1, 2, 3, 9, None) for price, rate, quantity, flag in ((100.0, 0.5, 3.0, "R"), (None, 0.1, 2.0, "N"), (8.0, None, None, "A"), (7.0, 0.0, 1.0, None))][:-1] + [(2, None, None, None, "R")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_extendedprice double, l_discount double, l_quantity double, l_returnflag string").withColumn("l_tax", F.lit(0.1)).write.parquet(str(tmp_path / "lineitem.parquet"))
    f = sales(spark, str(tmp_path))
    f = replace(f, catalog=Catalog.of([*f.catalog.kpis.values(), kpi("kept_units", "sum", "{quantity}", filters=(RowFilter("returnflag", "ne", "R"),)), kpi("urgent", "mean", "{net}", filters=(RowFilter("priority", "eq", "1-URGENT"),))]))
    own = [k for k in f.catalog.kpis if k != "urgent"]
    for keys, filters in ((own, None), (own, {"returnflag": ["r", "N"]}), (own, {"region": f.load({"region"}).first()["region"]}), ([*own, "urgent"], None)):
        got, plain = (sorted(x.daily(keys, filters).load({"_rows", *(n for k in keys for n in f.kpi(k).sum_names())}).collect(), key=str) for x in (f, replace(f, parts=None)))
        assert len(got) == len(plain) > 1
        for a, b in zip(got, plain, strict=True):
            assert a.asDict().keys() == b.asDict().keys() and all(a[c] == (pytest.approx(b[c]) if isinstance(b[c], float) else b[c]) for c in b.asDict()), (keys, filters)
