"""KPI contracts: finding out which KPIs a table supports, what is unclear about them, and keeping what was approved."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from pathlib import Path

from tallyloom.errors import InvalidArgument, UnknownKpi
from tallyloom.functions import formula
from tallyloom.functions.text import words
from tallyloom.operators.profile import additivity, semantic_type
from tallyloom.plans.kpi import Catalog, Kpi, kpi

# Concepts with their type, additivity and the names that columns give them.
CONCEPTS = {
    "revenue": ("money", "flow", ("revenue", "sales", "net_sales", "gross_revenue", "turnover", "income", "billed_amount", "gmv", "total_revenue")),
    "cost": ("money", "flow", ("cost_of_goods", "cogs", "cost", "total_cost", "operating_cost", "direct_cost", "cost_of_sales")),
    "marketing_spend": ("money", "flow", ("marketing_spend", "marketing_cost", "ad_spend", "advertising_spend", "campaign_spend", "media_spend")),
    "orders": ("count", "flow", ("orders", "order_count", "transactions", "purchases", "bookings")),
    "customers": ("count", "flow", ("customers", "customer_count", "buyers", "accounts", "clients")),
    "units_sold": ("count", "flow", ("units_sold", "units", "quantity", "qty", "volume", "items_sold")),
    "fulfilled_orders": ("count", "flow", ("fulfilled_orders", "shipped_orders", "delivered_orders", "completed_orders")),
    "stockout_events": ("count", "flow", ("stockout_events", "stockouts", "out_of_stock", "oos_events")),
    "inventory_units": ("count", "stock", ("inventory_units", "inventory", "stock_on_hand", "on_hand", "stock_level")),
    "returns": ("count", "flow", ("returns", "returned_orders", "refunds", "returned_units")),
    "support_tickets": ("count", "flow", ("support_tickets", "tickets", "support_contacts", "cases", "complaints")),
    "admissions": ("count", "flow", ("admissions", "admitted", "admits", "patient_admissions")),
    "discharges": ("count", "flow", ("discharges", "discharged", "patient_discharges")),
    "recovered": ("count", "flow", ("recovered_patients", "recovered", "recoveries", "cured")),
    "readmissions": ("count", "flow", ("readmissions", "readmitted", "readmission_count")),
    "deaths": ("count", "flow", ("deaths", "mortalities", "deceased", "fatalities")),
    "bed_days": ("count", "flow", ("bed_days", "patient_days", "occupied_bed_days")),
    "length_of_stay": ("duration", "", ("length_of_stay_days", "length_of_stay", "los", "stay_days")),
    "beds_available": ("count", "stock", ("beds_available", "available_beds", "bed_capacity", "capacity", "total_beds")),
    "treatment_cost": ("money", "flow", ("treatment_cost", "care_cost", "clinical_cost", "cost_of_care")),
    "shipments": ("count", "flow", ("shipments", "deliveries", "consignments", "loads")),
    "on_time_deliveries": ("count", "flow", ("on_time_deliveries", "on_time", "ontime_deliveries")),
    "damaged_shipments": ("count", "flow", ("damaged_shipments", "damaged", "damages")),
    "freight_cost": ("money", "flow", ("freight_cost", "shipping_cost", "transport_cost", "delivery_cost", "logistics_cost")),
    "subscribers": ("count", "flow", ("subscribers", "active_subscribers", "active_users", "seats", "subscriptions")),
    "churned": ("count", "flow", ("churned", "churned_customers", "cancellations", "cancelled_subscriptions", "churn_count")),
    "new_customers": ("count", "flow", ("new_customers", "signups", "new_subscribers", "acquisitions", "activations")),
    "recurring_revenue": ("money", "flow", ("mrr", "arr", "recurring_revenue", "subscription_revenue")),
    "units_produced": ("count", "flow", ("units_produced", "produced", "output_units", "production")),
    "defects": ("count", "flow", ("defects", "defective_units", "rejects", "scrap_units")),
    "downtime": ("duration", "", ("downtime_hours", "downtime", "unplanned_downtime")),
}
# Words in names of money that goes out or comes in, and of what a business counts its activity by.
OUTFLOW = set("cost costs cogs expense expenses spend spending fee fees charge charges salary wage wages budget payment payments refund refunds discount discounts tax taxes".split())
INFLOW = set("revenue sales income turnover gmv billed billing receipts collections premium reimbursement value amount".split())
POPULATIONS = set("orders customers transactions purchases bookings admissions discharges patients shipments subscribers visits sessions users cases applications claims employees students enrolments enrollments accounts clients trips calls".split())
# Library KPIs by pack: key, kind, numerator, denominator, scale, unit, whether higher is better.
PACKS = {
    "general": (
        ("revenue", "sum", "{revenue}", "", 1, "currency", True), ("cost_of_goods", "sum", "{cost}", "", 1, "currency", False), ("gross_profit", "sum", "{revenue} - {cost}", "", 1, "currency", True),
        ("gross_margin_pct", "ratio", "{revenue} - {cost}", "{revenue}", 100, "percent", True), ("orders", "sum", "{orders}", "", 1, "count", True), ("customers", "sum", "{customers}", "", 1, "count", True),
        ("units_sold", "sum", "{units_sold}", "", 1, "count", True), ("marketing_spend", "sum", "{marketing_spend}", "", 1, "currency", False), ("avg_order_value", "ratio", "{revenue}", "{orders}", 1, "currency", True),
        ("avg_selling_price", "ratio", "{revenue}", "{units_sold}", 1, "currency", True), ("units_per_order", "ratio", "{units_sold}", "{orders}", 1, "ratio", True), ("customer_acquisition_cost", "ratio", "{marketing_spend}", "{customers}", 1, "currency", False),
    ),
    "retail_ecommerce": (
        ("stockout_events", "sum", "{stockout_events}", "", 1, "count", False), ("inventory_units", "mean", "{inventory_units}", "", 1, "count", True), ("returns", "sum", "{returns}", "", 1, "count", False),
        ("support_tickets", "sum", "{support_tickets}", "", 1, "count", False), ("fulfillment_rate", "ratio", "{fulfilled_orders}", "{orders}", 100, "percent", True), ("stockout_rate", "ratio", "{stockout_events}", "{orders}", 100, "percent", False),
        ("return_rate", "ratio", "{returns}", "{orders}", 100, "percent", False), ("tickets_per_1k_orders", "ratio", "{support_tickets}", "{orders}", 1000, "ratio", False),
    ),
    "healthcare": (
        ("admissions", "sum", "{admissions}", "", 1, "count", True), ("discharges", "sum", "{discharges}", "", 1, "count", True), ("recovery_rate", "ratio", "{recovered}", "{discharges}", 100, "percent", True),
        ("readmission_rate", "ratio", "{readmissions}", "{discharges}", 100, "percent", False), ("mortality_rate", "ratio", "{deaths}", "{admissions}", 100, "percent", False), ("avg_length_of_stay", "mean", "{length_of_stay}", "", 1, "duration", False),
        ("bed_days", "sum", "{bed_days}", "", 1, "count", True), ("bed_occupancy_rate", "ratio", "{bed_days}", "{beds_available}", 100, "percent", True), ("cost_per_admission", "ratio", "{treatment_cost}", "{admissions}", 1, "currency", False),
    ),
    "logistics": (
        ("shipments", "sum", "{shipments}", "", 1, "count", True), ("on_time_delivery_rate", "ratio", "{on_time_deliveries}", "{shipments}", 100, "percent", True),
        ("damage_rate", "ratio", "{damaged_shipments}", "{shipments}", 100, "percent", False), ("cost_per_shipment", "ratio", "{freight_cost}", "{shipments}", 1, "currency", False),
    ),
    "saas_subscription": (
        ("active_subscribers", "sum", "{subscribers}", "", 1, "count", True), ("recurring_revenue", "sum", "{recurring_revenue}", "", 1, "currency", True),
        ("churn_rate", "ratio", "{churned}", "{subscribers}", 100, "percent", False), ("new_customers", "sum", "{new_customers}", "", 1, "count", True),
    ),
    "manufacturing": (
        ("units_produced", "sum", "{units_produced}", "", 1, "count", True), ("defect_rate", "ratio", "{defects}", "{units_produced}", 100, "percent", False), ("downtime_hours", "sum", "{downtime}", "", 1, "duration", False),
    ),
}
#: Least score of a binding, lead of a domain over the next, and history in quarters to judge changes by.
LEAST_BINDING, LEAD, HISTORY = 0.6, 2, 5


def alias_score(alias: str, name: str) -> float:
    """1 for the name itself, 0.95 for the same words, less the more other words the name has, 0 otherwise."""
    if name.lower() == alias:
        return 1.0
    split = lambda x: words(x.replace("_", " "))
    a, b = split(alias), split(name)
    if a == b:
        return 0.95
    return max(LEAST_BINDING, 0.85 - 0.08 * (len(b) - len(a))) if a and set(a) <= set(b) else 0.0


def bind(concept: str, measures: list[str]) -> list[tuple[str, float]]:
    """The measures that may stand for a concept, best first; type and additivity must agree."""
    kind, adds, aliases = CONCEPTS[concept]
    found = [(m, max(alias_score(a, m) for a in aliases)) for m in measures if semantic_type(m) in (kind, "unknown") and (not adds or additivity(m) == adds)]
    return sorted([(m, s) for m, s in found if s >= LEAST_BINDING], key=lambda t: (-t[1], t[0]))


def bind_library(measures: list[str], packs: list[str] | None = None) -> tuple[dict[str, dict], dict[str, list[str]]]:
    """Library KPIs that the measures support, with their bindings, and for the others the concepts that are missing."""
    found, missed = {}, {}
    for pack in packs or PACKS:
        for key, kind, top, bottom, scale, unit, better in PACKS[pack]:
            needs = formula.fields(formula.parse(top)) | (formula.fields(formula.parse(bottom)) if bottom else set())
            bound = {c: bind(c, measures) for c in sorted(needs)}
            if missing := [c for c, b in bound.items() if not b]:
                missed[key] = missing
                continue
            put = lambda text, b=bound: text.format(**{c: "{" + v[0][0] + "}" for c, v in b.items()})
            ties = [c for c, v in bound.items() if len(v) > 1 and v[0][1] - v[1][1] < 1e-9]
            found[key] = {"key": key, "pack": pack, "kind": kind, "numerator": put(top), "denominator": put(bottom) if bottom else "", "scale": float(scale), "unit": unit, "higher_is_better": better, "confidence": min(v[0][1] for v in bound.values()), "ambiguous": ties}
    return found, missed


def domain(found: dict[str, dict]) -> dict:
    """The pack that most KPIs were bound in; uncertain if it leads by too little."""
    counts = sorted(((sum(f["pack"] == p for f in found.values()), p) for p in PACKS if p != "general"), reverse=True)
    (first, name), (second, _) = counts[:2]
    return {"domain": name if first else "general", "certain": first >= LEAD and first - second >= LEAD, "bound": {p: n for n, p in counts}}


def direction(measure: str) -> str | None:
    """Whether money comes in or goes out, by the name."""
    own = set(words(measure.replace("_", " ")))
    return "outflow" if own & OUTFLOW else "inflow" if own & INFLOW else None


def closure(subsets: Iterable[tuple[str, str]]) -> set[tuple[str, str]]:
    """The order that part-and-whole pairs make: what lies in a part of a whole lies in the whole."""
    inside = set(subsets)
    while more := {(a, d) for a, b in inside for c, d in inside if b == c and a != d} - inside:
        inside |= more
    return inside


def derive(measures: list[str], subsets: Iterable[tuple[str, str]], most: dict[str, float] | None = None) -> tuple[list[dict], list[dict]]:
    """(KPIs that follow from a table, those that seem to and don't, with the reason).

    ``subsets`` are (part, whole) as ``profile.containment`` finds them, ``most`` each measure's greatest value. Money in less
    money out; a margin where the first lies within the second; an outcome over the broadest primary population that it lies
    in; money for each of the broadest population of all; mean durations. A rate wants its part inside its whole.
    """
    inside, size = closure(subsets), lambda m: ((most or {}).get(m) or 0.0, m)
    tokens = {m: set(words(m.replace("_", " "))) for m in measures}
    money = [m for m in measures if semantic_type(m) == "money" and additivity(m) == "flow"]
    counts = [m for m in measures if semantic_type(m) in ("count", "flag") and additivity(m) == "flow"]
    primary = [m for m in counts if tokens[m] & POPULATIONS]
    out, rejected = [], []

    def emit(key: str, kind: str, top: str, bottom: str, scale: float, rule: str, verdict: str = "valid") -> None:
        out.append({"key": key, "kind": kind, "numerator": top, "denominator": bottom, "scale": scale, "rule": rule, "verdict": verdict})

    def reject(a: str, b: str, rule: str, reason: str) -> None:
        rejected.append({"numerator": a, "denominator": b, "rule": rule, "reason": reason})

    flows = [(a, b) for a in money for b in money if a != b and direction(a) == "inflow" and direction(b) == "outflow"]
    for a, b in flows:
        emit(f"{a}_less_{b}", "sum", f"{{{a}}} - {{{b}}}", "", 1.0, "inflow_less_outflow", "valid" if (a, b) in inside else "questionable")
        if (a, b) in inside:
            emit(f"{a}_less_{b}_pct", "ratio", f"{{{a}}} - {{{b}}}", f"{{{a}}}", 100.0, "margin")
        elif (b, a) not in inside:
            reject(a, b, "money_over_money", f"{b} is no part of {a} on the rows, so their ratio is no margin")
    for a in counts:
        for b in primary:
            if a != b and (a, b) not in inside and a not in primary:
                reject(a, b, "outcome_rate", f"{a} does not lie within {b} on the rows, so their quotient is no rate")
        if wholes := [b for b in primary if b != a and (a, b) in inside]:
            whole = max(wholes, key=size)
            emit(f"{a}_per_{whole}_rate", "ratio", f"{{{a}}}", f"{{{whole}}}", 100.0, "outcome_rate")
    if primary:
        base = max(primary, key=size)
        for m in money:
            emit(f"{m}_per_{base}", "ratio", f"{{{m}}}", f"{{{base}}}", 1.0, "unit_economics")
    for m in measures:
        if semantic_type(m) == "duration":
            emit(f"avg_{m}", "mean", f"{{{m}}}", "", 1.0, "mean_duration")
    rates = [m for m in measures if additivity(m) == "rate"]
    for m in rates[1:]:
        reject(m, rates[0], "rate_over_rate", "one rate over another has no meaning")
    return out, rejected


@dataclass(frozen=True)
class Basis:
    """What a KPI's values are of: the grain in time and of entities, the calendar, how often its source is refreshed."""

    time_grain: str = "quarter"
    entity_grain: tuple[str, ...] = ()
    calendar: str = "gregorian"
    cadence: str = "unknown"


def comparability(bases: dict[str, Basis]) -> list[dict]:
    """For each two KPIs of a contract, whether they may be compared, and if not in what their bases differ."""
    parts = ("time_grain", "entity_grain", "calendar", "cadence")
    differ = lambda a, b: [p for p in parts if getattr(bases[a], p) != getattr(bases[b], p)]
    return [{"kpi": a, "other": b, "reasons": differ(a, b), "comparable": not differ(a, b)} for a in bases for b in bases if a != b]


@dataclass
class Entry:
    """A KPI of a contract: its definition and where its approval stands (proposed, needs_confirmation, approved, rejected)."""

    key: str
    kind: str
    numerator: str
    denominator: str = ""
    scale: float = 1.0
    unit: str = "count"
    higher_is_better: bool = True
    label: str = ""
    origin: str = "library"
    state: str = "proposed"

    def compiled(self) -> Kpi:
        return kpi(self.key, self.kind, self.numerator, self.denominator or None, scale=self.scale, unit=self.unit, higher_is_better=self.higher_is_better, label=self.label or self.key.replace("_", " ").capitalize())

    def meaning(self) -> tuple:
        """What is computed, alike for all ways to write it."""
        own = self.compiled()
        return own.kind, formula.canonical(own.numerator), own.denominator and formula.canonical(own.denominator), own.scale


@dataclass
class Conflict:
    kind: str
    keys: list[str]
    message: str
    blocking: bool = True
    resolved: str = ""
    fields: list[str] = field(default_factory=list)
    measured: float | None = None


def definitions(entries: Iterable[Entry]) -> list[Conflict]:
    """Names that several computations claim, and computations that have several keys, compared in their canonical form."""
    by_name: dict[str, list[Entry]] = {}
    by_meaning: dict[tuple, list[Entry]] = {}
    for e in entries:
        by_name.setdefault(e.compiled().label.strip().lower(), []).append(e)
        by_meaning.setdefault(e.meaning(), []).append(e)
    keys = lambda group: sorted(e.key for e in group)
    out = [Conflict("formula_disagreement", keys(g), f"{len(g)} KPIs named {n!r} are computed differently") for n, g in by_name.items() if len({e.meaning() for e in g}) > 1]
    return out + [Conflict("duplicate_definition", keys(g), "the same formula under several keys", blocking=False) for g in by_meaning.values() if len(g) > 1]


@dataclass
class Contract:
    """A versioned set of KPI definitions. Only approved ones are offered; every change makes a new version."""

    entries: dict[str, Entry] = field(default_factory=dict)
    conflicts: list[Conflict] = field(default_factory=list)
    version: int = 1
    state: str = "draft"
    log: list[str] = field(default_factory=list)

    @classmethod
    def discover(cls, measures: list[str], subsets: list[tuple[str, str]] = (), quarters: int = HISTORY, most: dict[str, float] | None = None) -> Contract:
        """Library KPIs that bind and KPIs that follow from the table, with what is unclear about them."""
        own, (found, _) = cls(state="proposed"), bind_library(measures)
        for f in found.values():
            own.entries[f["key"]] = Entry(f["key"], f["kind"], f["numerator"], f["denominator"], f["scale"], f["unit"], f["higher_is_better"], state="needs_confirmation" if f["ambiguous"] else "proposed")
            if f["ambiguous"]:
                own.conflicts.append(Conflict("ambiguous_binding", [f["key"]], f"several columns fit {', '.join(f['ambiguous'])}"))
        known = {e.meaning() for e in own.entries.values()}
        for d in derive(measures, subsets, most)[0]:
            entry = Entry(d["key"], d["kind"], d["numerator"], d["denominator"], d["scale"], origin=d["rule"], state="needs_confirmation")
            if entry.meaning() not in known:
                own.entries[entry.key] = entry
                known.add(entry.meaning())
        if quarters < HISTORY:
            own.conflicts.append(Conflict("short_history", [], f"{quarters} quarters are too few to judge changes by", blocking=False))
        own.conflicts += own.duplicates()
        return own

    def duplicates(self) -> list[Conflict]:
        """The same computation under several keys, and one name for several computations; the latter blocks."""
        return definitions(self.entries.values())

    def _of(self, key: str) -> Entry:
        if key not in self.entries:
            raise UnknownKpi(f"no KPI {key!r} in the contract")
        return self.entries[key]

    def _changed(self, what: str) -> None:
        self.version += 1
        self.log.append(f"{self.version}: {what}")

    def add(self, entry: Entry) -> None:
        entry.compiled()  # a malformed formula is refused here
        if entry.key in self.entries:
            raise InvalidArgument(f"{entry.key} exists")
        self.entries[entry.key] = entry
        self._changed(f"add {entry.key}")

    def update(self, key: str, **changes) -> None:
        """Changes a definition; what it meant before is no longer approved."""
        own = Entry(**(asdict(self._of(key)) | changes | {"key": key}))
        own.compiled()
        own.state = "proposed"
        self.entries[key] = own
        self._changed(f"update {key}")

    def delete(self, key: str) -> None:
        self._of(key)
        del self.entries[key]
        self._changed(f"delete {key}")

    def approve(self, key: str) -> None:
        own = self._of(key)
        if open_ := [c.kind for c in self.conflicts if c.blocking and not c.resolved and key in c.keys]:
            raise InvalidArgument(f"{key} has open conflicts: {', '.join(open_)}")
        own.state = "approved"
        self._changed(f"approve {key}")

    def reject(self, key: str) -> None:
        self._of(key).state = "rejected"
        self._changed(f"reject {key}")

    def resolve(self, number: int, effect: str, keys: list[str] | None = None) -> None:
        """Settles a conflict: reject drops the named KPIs, or all of its own; bind:<concept>=<column> is written into their formulas; keep leaves them."""
        if not 0 <= number < len(self.conflicts):
            raise InvalidArgument(f"no conflict {number}")
        own = self.conflicts[number]
        for key in keys or own.keys:
            if effect == "reject":
                self.reject(key)
            elif effect.startswith("bind:"):
                old, _, new = effect[5:].partition("=")
                e = self._of(key)
                self.update(key, numerator=e.numerator.replace(f"{{{old}}}", f"{{{new}}}"), denominator=e.denominator.replace(f"{{{old}}}", f"{{{new}}}"))
            elif effect != "keep":
                raise InvalidArgument(f"no effect {effect!r}")
        own.resolved = effect
        self._changed(f"resolve {own.kind}")

    def catalog(self, columns: list[str]) -> Catalog:
        """The approved KPIs whose columns are all there."""
        own = Catalog.of([e.compiled() for e in self.entries.values() if e.state == "approved"])
        return Catalog({k: own.kpis[k] for k in own.available(columns)})

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=1))

    @classmethod
    def load(cls, path: str) -> Contract:
        raw = json.loads(Path(path).read_text())
        return cls({k: Entry(**e) for k, e in raw["entries"].items()}, [Conflict(**c) for c in raw["conflicts"]], raw["version"], raw["state"], raw["log"])
