"""Discovery and the life of a contract."""

import pytest

from tallyloom.errors import InvalidArgument, MalformedFormula, UnknownKpi
from tallyloom.operators import conflicts, profile
from tallyloom.plans import contract

RETAIL = ["revenue", "units_sold", "orders", "customers", "fulfilled_orders", "stockout_events", "inventory_units", "cost_of_goods", "marketing_spend", "returns", "support_tickets"]
HOSPITAL = ["admissions", "discharges", "recovered_patients", "readmissions", "deaths", "bed_days", "length_of_stay_days", "treatment_cost", "beds_occupied"]


def test_library_has_40_kpis_in_6_packs():
    assert len(contract.PACKS) == 6 and sum(map(len, contract.PACKS.values())) == 40
    for pack in contract.PACKS.values():
        for _, _, top, bottom, *_ in pack:
            assert contract.formula.fields(contract.formula.parse(top + (f"+({bottom})" if bottom else ""))) <= set(contract.CONCEPTS)


@pytest.mark.parametrize(("measures", "domain", "keys"), [(RETAIL, "retail_ecommerce", {"gross_margin_pct", "fulfillment_rate", "inventory_units", "customer_acquisition_cost"}), (HOSPITAL, "healthcare", {"readmission_rate", "mortality_rate", "cost_per_admission", "avg_length_of_stay"})])
def test_binding_finds_the_domain(measures, domain, keys):
    found, missed = contract.bind_library(measures)
    assert keys <= set(found) and contract.domain(found) == {"domain": domain, "certain": True, "bound": contract.domain(found)["bound"]}
    assert "defects" in missed["defect_rate"]


def test_scores_of_names():
    assert contract.alias_score("revenue", "revenue") == 1 and contract.alias_score("net_sales", "Net Sales") == 0.95
    assert contract.alias_score("revenue", "revenue_target") == pytest.approx(0.77) and contract.alias_score("admissions", "readmissions") == 0
    assert contract.bind("admissions", ["readmissions", "admissions"]) == [("admissions", 1.0)]


def test_only_approved_kpis_are_offered_and_changes_reset(tmp_path):
    own = contract.Contract.discover(RETAIL, [("fulfilled_orders", "orders")])
    assert own.catalog(RETAIL).kpis == {}
    own.approve("revenue")
    own.approve("fulfillment_rate")
    assert set(own.catalog(RETAIL).kpis) == {"revenue", "fulfillment_rate"} and set(own.catalog(["revenue"]).kpis) == {"revenue"}
    before = own.version
    own.update("revenue", numerator="{revenue} * 2")
    assert own.entries["revenue"].state == "proposed" and own.version == before + 1
    own.add(contract.Entry("net", "sum", "{revenue} - {returns}"))
    for call in (lambda: own.add(contract.Entry("bad", "sum", "{revenue} +")), lambda: own.update("net", numerator="(")):
        with pytest.raises(MalformedFormula):
            call()
    with pytest.raises(InvalidArgument):
        own.add(contract.Entry("net", "sum", "{revenue}"))
    own.delete("net")
    with pytest.raises(UnknownKpi):
        own.approve("net")
    own.save(str(tmp_path / "c.json"))
    assert contract.Contract.load(str(tmp_path / "c.json")) == own


def test_an_open_conflict_blocks_approval_until_it_is_settled():
    own = contract.Contract.discover(["revenue", "sales_units", "qty_units"], quarters=2)
    assert any(c.kind == "short_history" and not c.blocking for c in own.conflicts)
    number, found = next((k, c) for k, c in enumerate(own.conflicts) if c.kind == "ambiguous_binding")
    with pytest.raises(InvalidArgument):
        own.approve(found.keys[0])
    own.resolve(number, "keep")
    own.approve(found.keys[0])
    own.conflicts.append(contract.Conflict("ambiguous_binding", ["avg_selling_price"], ""))
    own.resolve(len(own.conflicts) - 1, "reject")
    assert own.entries["avg_selling_price"].state == "rejected"


def test_derived_kpis_do_not_repeat_the_library():
    own = contract.Contract.discover(RETAIL, [("fulfilled_orders", "orders"), ("returns", "orders")])
    meanings = [e.meaning() for e in own.entries.values()]
    assert len(meanings) == len(set(meanings))


def test_derivation_follows_the_order_of_parts_and_wholes():
    measures = ["revenue_amount", "discount_cost", "orders", "customers_count", "returns_count", "tickets_count", "stay_days", "defect_rate", "fill_pct"]
    subsets = [("returns_count", "customers_count"), ("customers_count", "orders"), ("discount_cost", "revenue_amount")]
    assert contract.closure(subsets) == {*subsets, ("returns_count", "orders")}
    found, rejected = contract.derive(measures, subsets, {"orders": 90.0, "customers_count": 70.0})
    by_rule = {}
    for d in found:
        by_rule.setdefault(d["rule"], []).append((d["key"], d["verdict"]))
    assert by_rule["outcome_rate"] == [("customers_count_per_orders_rate", "valid"), ("returns_count_per_orders_rate", "valid")]  # through customers, and the broadest
    assert by_rule["unit_economics"] == [("revenue_amount_per_orders", "valid"), ("discount_cost_per_orders", "valid")] and by_rule["mean_duration"] == [("avg_stay_days", "valid")]
    assert by_rule["inflow_less_outflow"] == [("revenue_amount_less_discount_cost", "questionable")] and "margin" not in by_rule
    assert {(r["numerator"], r["denominator"], r["rule"]) for r in rejected} == {("tickets_count", "orders", "outcome_rate"), ("tickets_count", "customers_count", "outcome_rate"), ("fill_pct", "defect_rate", "rate_over_rate")}
    within, _ = contract.derive(["revenue", "total_cost"], [("revenue", "total_cost")])
    assert [(d["rule"], d["verdict"]) for d in within] == [("inflow_less_outflow", "valid"), ("margin", "valid")]
    _, none = contract.derive(["revenue", "total_cost"], [])
    assert [r["rule"] for r in none] == ["money_over_money"]


@pytest.mark.parametrize(("one", "other", "same"), [
    ("{a} + {b}", "{b} + {a}", True), ("{a} - ({b} - {c})", "{a} - {b} + {c}", True), ("2 * {a} * 3", "6 * {a}", True), ("{a} * {b} / {c}", "{b} / {c} * {a}", True), ("{a} + {a}", "{a} * 2", True),
    ("-{a} + {b}", "{b} - {a}", True), ("({a} + {b}) * {c}", "{c} * ({b} + {a})", True), ("{a} / 4", "0.25 * {a}", True), ("{a} - {a}", "0", True), ("{a} / ({b} / {c})", "{a} * {c} / {b}", True),
    ("{a} - {b}", "{b} - {a}", False), ("{a} / {b}", "{b} / {a}", False), ("{a} + 1", "{a} + 2", False), ("{a} / 0", "{a}", False), ("({a} + {b}) / {c}", "({a} - {b}) / {c}", False),
])
def test_canonical_formulas(one, other, same):
    form = lambda t: contract.formula.canonical(contract.formula.parse(t))
    assert (form(one) == form(other)) is same


def entries():
    e = contract.Entry
    return [
        e("margin_a", "ratio", "{net} - {cost}", "{net}", 100.0, "percent", label="Margin"), e("margin_b", "ratio", "{net}", "{net} + {cost}", 100.0, "percent", label="margin "),
        e("total", "sum", "{net} + {cost}"), e("sum_up", "sum", "{cost} + {net}"), e("share", "ratio", "{part}", "{whole}", 100.0, "percent"), e("over", "ratio", "{whole}", "{part}", 100.0, "percent"), e("plain", "ratio", "{whole}", "{part}"),
    ]


def test_every_kind_of_conflict_is_found(spark):
    rows = [(f"2026-0{1 + k % 6}-03", f"town{k % 8}", "north" if k % 8 < 4 else "south", "x" if k == 9 else ("north" if k % 8 < 4 else "south"), 10.0, 4.0, float(k % 5), 5.0 + k) for k in range(40)] + [("2026-01-03", "town0", "north", "north", None, None, None, 1.0)]
    df = spark.createDataFrame(rows, "date string, town string, area string, zone string, net double, cost double, part double, whole double")
    bases = {"share": contract.Basis(), "over": contract.Basis(calendar="4-4-5")}
    found = {(c.kind, *c.keys): c for c in conflicts.detect(df, entries(), ["town", "area", "zone"], ["date", "town"], bases)}
    assert set(found) == {
        ("formula_disagreement", "margin_a", "margin_b"), ("duplicate_definition", "sum_up", "total"), ("calendar_mismatch", "over", "share"), ("subset_check_failed", "over"), ("unit_mismatch", "over"),
        ("insufficient_history", *sorted(e.key for e in entries())), ("hierarchy_violation",), ("grain_mismatch",),
    }
    assert found["hierarchy_violation",].fields == ["town", "zone"] and found["hierarchy_violation",].measured == 1
    assert found["subset_check_failed", "over"].measured == 0 and found["subset_check_failed", "over"].fields == ["whole", "part"] and found["subset_check_failed", "over"].blocking
    assert found["unit_mismatch", "over"].measured == pytest.approx(100 * sum(5 + k for k in range(40)) / sum(k % 5 for k in range(40)), rel=0.01) and not found["unit_mismatch", "over"].blocking
    assert found["insufficient_history", *sorted(e.key for e in entries())].measured == 2


def test_a_table_without_rows_breaks_nothing_but_history(spark):
    df = spark.createDataFrame([], "date string, town string, area string, net double, cost double, part double, whole double")
    assert {c.kind for c in conflicts.detect(df, entries()[4:], ["town", "area"], ["date"])} == {"insufficient_history"}


def test_containment_is_within_a_family(spark):
    df = spark.createDataFrame([(float(k), float(k % 7), 1000.0, None if k else 5.0, 3.0) for k in range(40)], "orders double, returns_count double, net_price double, tax_amount double, stock_count double")
    got = {(r["part"], r["whole"]): (r["n"], r["rows_within"], r["contained"]) for r in profile.containment(df, df.columns).collect()}
    assert got == {("orders", "returns_count"): (40, 7 / 40, False), ("returns_count", "orders"): (40, 1.0, True), ("net_price", "tax_amount"): (1, 0.0, False), ("tax_amount", "net_price"): (1, 1.0, True)}
    assert profile.containment(df, ["orders"]).collect() == []
