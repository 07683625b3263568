"""The closed set of named tools: their arguments, checked before any data is read, and calls that never raise."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.errors import AnalyticsError, InvalidArgument
from tallyloom.operators import contest, investigate, noise, relate, retrieve
from tallyloom.operators.order import placed
from tallyloom.plans import catalogue
from tallyloom.plans import timefilter as tf
from tallyloom.sources.facts import Facts

#: Rows that a payload carries at most; operators themselves have no cap.
MOST_ROWS = 500
#: KPIs that one is correlated with at most; a payload says how many were considered and whether some were left out.
MOST_CANDIDATES = 30
#: Periods that a cause may be ahead or behind at most; more is refused.
MOST_LAG = 60
#: Kinds of arguments and what they accept.
KINDS = {"kpi": str, "kpis": list, "dimension": str, "dimensions": list, "time": (str, dict), "filters": dict, "text": str, "integer": int, "number": (int, float), "flag": bool, "list": list, "grain": str, "mode": str, "order": str}


@dataclass(frozen=True)
class Tool:
    name: str
    category: str
    arguments: dict[str, str]
    required: tuple[str, ...]
    run: Callable[..., Any]
    about: str


TOOLS: dict[str, Tool] = {}


def tool(category: str, about: str, **arguments: str):
    """Registers a function; an argument's kind ends in ! if it is required."""

    def add(run: Callable[..., Any]) -> Callable[..., Any]:
        name = run.__name__
        TOOLS[name] = Tool(name, category, {a: k.rstrip("!") for a, k in arguments.items()}, tuple(a for a, k in arguments.items() if k.endswith("!")), run, about)
        return run

    return add


def plain(value: Any) -> Any:
    """A value that JSON can hold; what is not a number becomes null."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, (dt.date, dt.datetime)):
        return str(value)
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if hasattr(value, "item") and not isinstance(value, str):
        return plain(value.item())
    return value


def rows(df: DataFrame, most: int = MOST_ROWS) -> dict:
    found = df.limit(most + 1).collect()
    return {"rows": [r.asDict(recursive=True) for r in found[:most]], "truncated": len(found) > most}


def row(df: DataFrame) -> dict:
    found = df.first()
    return found.asDict(recursive=True) if found else {"status": "empty"}


class Engine:
    """Facts and the tools over them. ``call`` returns a payload or a typed error, whatever it is given."""

    def __init__(self, facts: Facts):
        self.facts = facts

    @property
    def keys(self) -> list[str]:
        return self.facts.catalog.available(self.facts.measures)

    def schema(self, name: str) -> dict:
        """The JSON schema of a tool's arguments, with the KPIs and dimensions of these facts as choices."""
        t = TOOLS[name]
        own = {"kpi": {"type": "string", "enum": self.keys}, "kpis": {"type": "array", "items": {"type": "string", "enum": self.keys}}, "dimension": {"type": "string", "enum": self.facts.dimensions}, "dimensions": {"type": "array", "items": {"type": "string", "enum": self.facts.dimensions}}, "time": {"type": ["string", "object"]}, "filters": {"type": "object"}, "integer": {"type": "integer"}, "number": {"type": "number"}, "flag": {"type": "boolean"}, "list": {"type": "array"}, "grain": {"type": "string", "enum": list(tf.GRAINS)}, "mode": {"type": "string", "enum": ["cross_sectional", "time_series"]}}
        return {"name": name, "description": t.about, "input_schema": {"type": "object", "properties": {a: own.get(k, {"type": "string"}) for a, k in t.arguments.items()}, "required": list(t.required), "additionalProperties": False}}

    def check(self, t: Tool, arguments: dict) -> dict:
        """The arguments, or an error that names the first that is wrong."""
        if not isinstance(arguments, dict):
            raise InvalidArgument("arguments are a dictionary")
        if unknown := sorted(set(map(str, arguments)) - set(t.arguments)):
            raise InvalidArgument(f"{t.name} has no argument {unknown[0]!r}", allowed=sorted(t.arguments))
        given = {a: v for a, v in arguments.items() if v is not None}
        if missing := [a for a in t.required if a not in given]:
            raise InvalidArgument(f"{t.name} needs {missing[0]!r}")
        for a, v in given.items():
            kind = t.arguments[a]
            if not isinstance(v, KINDS[kind]) or (isinstance(v, bool) and kind != "flag"):
                raise InvalidArgument(f"{a} is not of kind {kind}")
            if kind in ("kpi", "kpis"):
                for key in [v] if kind == "kpi" else v:
                    self.facts.kpi(key)
            if kind in ("dimension", "dimensions"):
                for d in [v] if kind == "dimension" else v:
                    self.facts.dimension(d)
            if kind == "time":
                tf.parse(v)
            if kind == "grain" and v not in tf.GRAINS:
                raise InvalidArgument(f"no grain {v!r}")
            if kind == "mode" and v not in ("cross_sectional", "time_series"):
                raise InvalidArgument(f"no mode {v!r}")
            if kind == "filters":
                for d in v:
                    self.facts.dimension(d)
        return given

    def call(self, name: str, arguments: dict | None = None) -> dict:
        try:
            if name not in TOOLS:
                raise InvalidArgument(f"no tool {name!r}", tools=sorted(TOOLS))
            t = TOOLS[name]
            out = t.run(self, **self.check(t, arguments or {}))
            return plain({"tool": name, **({"status": "ok"} | out)})
        except AnalyticsError as e:
            status = e.details.get("status")
            return plain({"tool": name, **({"status": status, "message": str(e)} if status else e.payload())})
        except Exception as e:  # noqa: BLE001  a tool call never raises
            return {"tool": str(name), "status": "error", "error": {"code": "tool_error", "message": str(e)[:300]}}


PAIR = {"period_a": "time!", "period_b": "time!", "filters": "filters"}
SAMPLE = {"mode": "mode", "period_a": "time", "period_b": "time", "dimension": "dimension", "time_filter": "time", "grain": "grain", "filters": "filters"}

# -- orient -----------------------------------------------------------------------------------------------------------


@tool("orient", "Rows, dates, periods, KPIs and dimensions of the facts.")
def describe_dataset(e: Engine) -> dict:
    frames = retrieve.timeframes(e.facts).orderBy("year", "quarter").collect()
    return {"rows": sum(r["rows"] for r in frames), "start": min((r["start"] for r in frames), default=None), "end": max((r["end"] for r in frames), default=None), "quarters": [f"{r['year']}-Q{r['quarter']}" for r in frames], "kpis": e.keys, "dimensions": e.facts.dimensions}


@tool("orient", "Every KPI of the facts.")
def list_kpis(e: Engine) -> dict:
    return {"kpis": [catalogue.definition(e.facts.kpi(k)) for k in e.keys]}


@tool("orient", "What a KPI means.", kpi_key="kpi!")
def get_kpi_definition(e: Engine, kpi_key: str) -> dict:
    return catalogue.definition(e.facts.kpi(kpi_key))


@tool("orient", "Every dimension and its number of members.")
def list_dimensions(e: Engine) -> dict:
    return {"dimensions": {r["dimension"]: r["members"] for r in retrieve.dimension_sizes(e.facts).collect()}}


@tool("orient", "A page of a dimension's members.", dimension="dimension!", offset="integer", limit="integer")
def list_dimension_members(e: Engine, dimension: str, offset: int = 0, limit: int = 50) -> dict:
    own = e.facts.load({dimension}).select(F.col(dimension).alias("member")).distinct()
    page = own.orderBy("member").offset(max(0, offset)).limit(max(0, min(limit, MOST_ROWS)))
    return {"members": [r["member"] for r in page.collect()], "total": own.count()}


@tool("orient", "The columns that a KPI reads.", kpi_key="kpi!")
def get_kpi_inputs(e: Engine, kpi_key: str) -> dict:
    return {"fields": sorted(e.facts.kpi(kpi_key).fields())}


@tool("orient", "A KPI's formula as signed and placed terms.", kpi_key="kpi!", expand="flag", max_depth="integer")
def get_formula_structure(e: Engine, kpi_key: str, expand: bool = True, max_depth: int = 4) -> dict:
    return catalogue.structure(e.facts.catalog, kpi_key, e.facts.measures, expand, max_depth)


@tool("orient", "KPIs that a phrase may mean.", text="text!", limit="integer", min_score="number")
def search_kpis(e: Engine, text: str, limit: int = 8, min_score: float = 0.0) -> dict:
    return {"matches": catalogue.search(e.facts.catalog, text, limit, min_score)}


@tool("orient", "KPIs related to one, with the evidence.", kpi_key="kpi!", relations="list", depth="integer")
def find_related_kpis(e: Engine, kpi_key: str, relations: list | None = None, depth: int = 1) -> dict:
    return {"related": catalogue.payload(catalogue.related(e.facts.catalog, kpi_key, e.facts.measures, relations, depth))}


@tool("orient", "KPIs that a KPI's formula is made of.", kpi_key="kpi!")
def get_formula_components(e: Engine, kpi_key: str) -> dict:
    return {"components": catalogue.payload(catalogue.components(e.facts.catalog, kpi_key, e.facts.measures))}


@tool("orient", "Keys of KPIs related to one.", kpi_key="kpi!", depth="integer")
def get_kpi_neighbours(e: Engine, kpi_key: str, depth: int = 1) -> dict:
    return {"kpis": catalogue.neighbours(e.facts.catalog, kpi_key, e.facts.measures, depth)}


# -- retrieve ---------------------------------------------------------------------------------------------------------


@tool("retrieve", "KPIs over a time scope, filtered, grouped, sorted, limited.", kpi_keys="kpis!", time_filter="time!", filters="filters", group_by="list", sort_by="text", order="order", limit="integer")
def query_kpi(e: Engine, kpi_keys: list, time_filter, filters=None, group_by=None, sort_by=None, order="desc", limit=None) -> dict:
    df = retrieve.query_kpi(e.facts, kpi_keys, time_filter, filters, group_by, sort_by, order, limit)
    return {"selection": e.facts.selection(tf.parse(time_filter)), **rows(df)}


def _series(e: Engine, keys: list, grain: str, time_filter, filters) -> dict:
    points = retrieve.series(e.facts, keys, grain, time_filter or "all", filters)
    missing = rows(retrieve.gaps(points, grain).orderBy("period"))
    return {"grain": grain, "gaps": [r["period"] for r in missing["rows"]], "gaps_truncated": missing["truncated"], **rows(points.orderBy("ord"))}


@tool("retrieve", "A KPI's history with its gaps.", kpi_key="kpi!", grain="grain", time_filter="time", filters="filters")
def get_timeseries(e: Engine, kpi_key: str, grain="quarter", time_filter=None, filters=None) -> dict:
    return _series(e, [kpi_key], grain, time_filter, filters)


@tool("retrieve", "Several KPIs' histories at once.", kpi_keys="kpis!", grain="grain", time_filter="time", filters="filters")
def get_timeseries_multi(e: Engine, kpi_keys: list, grain="quarter", time_filter=None, filters=None) -> dict:
    return _series(e, kpi_keys, grain, time_filter, filters)


@tool("retrieve", "Members of a dimension by a KPI.", kpi_key="kpi!", dimension="dimension!", time_filter="time!", order="order", limit="integer", filters="filters")
def rank_entities(e: Engine, kpi_key: str, dimension: str, time_filter, order="desc", limit=10, filters=None) -> dict:
    out = rows(retrieve.rank_entities(e.facts, kpi_key, dimension, time_filter, order, limit, filters).orderBy("rank", "member"))
    others = row(retrieve.other_entities(e.facts, kpi_key, dimension, time_filter, order, limit, filters)) if limit is not None else {"members": 0}
    return {**out, "others": others if others["members"] else None}


@tool("retrieve", "Spread of a KPI over members.", kpi_key="kpi!", dimension="dimension!", time_filter="time!", filters="filters", bins="integer", min_members="integer")
def get_distribution(e: Engine, kpi_key: str, dimension: str, time_filter, filters=None, bins=10, min_members=3) -> dict:
    own = row(retrieve.distribution(e.facts, kpi_key, dimension, time_filter, filters))
    if own["members"] < min_members:
        return {"status": "insufficient", "members": own["members"]}
    return {**own, "histogram": rows(retrieve.histogram(e.facts, kpi_key, dimension, time_filter, filters, bins).orderBy("bin"))["rows"]}


@tool("retrieve", "A KPI by two dimensions with totals.", kpi_key="kpi!", dim_a="dimension!", dim_b="dimension!", time_filter="time!", filters="filters", limit_a="integer", limit_b="integer")
def cross_tabulate(e: Engine, kpi_key: str, dim_a: str, dim_b: str, time_filter, filters=None, limit_a=None, limit_b=None) -> dict:
    return rows(retrieve.cross_tabulate(e.facts, kpi_key, dim_a, dim_b, time_filter, filters, limit_a, limit_b).orderBy("level", "a", "b"))


# -- noise ------------------------------------------------------------------------------------------------------------


@tool("noise", "A KPI in two scopes.", kpi_key="kpi!", **PAIR)
def compare_periods(e: Engine, kpi_key: str, period_a, period_b, filters=None) -> dict:
    return row(noise.compare(e.facts, kpi_key, period_a, period_b, filters))


def _single(scope) -> tuple[str, str] | None:
    own = tf.parse(scope)
    return (own.name, own.kind) if own.kind in ("quarter", "year") else None


@tool("noise", "Whether a move is unusual against the KPI's own history.", kpi_key="kpi!", period_a="time!", period_b="time", filters="filters")
def assess_significance(e: Engine, kpi_key: str, period_a, period_b=None, filters=None) -> dict:
    own = _single(period_a)
    before = tf.previous(tf.parse(period_a)) if own else None
    if own is None or (period_b is not None and (before is None or tf.parse(period_b).name != before.name)):
        return {"status": "unsupported_baseline"}
    return row(noise.significance(e.facts, [kpi_key], own[0], own[1], filters))


@tool("noise", "The band that a KPI normally moves in.", kpi_key="kpi!", grain="grain", filters="filters", k="number", min_points="integer")
def get_normal_range(e: Engine, kpi_key: str, grain="week", filters=None, k=2.0, min_points=8) -> dict:
    return row(noise.normal_range(e.facts, [kpi_key], grain, filters, k, min_points))


@tool("noise", "Which of the given changes are large and unusual enough.", candidates="list!", min_pct="number", min_z="number")
def filter_material_changes(e: Engine, candidates: list, min_pct=noise.MATERIAL, min_z=noise.Z) -> dict:
    if not all(isinstance(c, dict) for c in candidates):
        raise InvalidArgument("each candidate is a dictionary with change_pct and z")
    number = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) else None
    out = []
    for c in candidates:
        change, z = number(c.get("change_pct")), number(c.get("z"))
        reason = "no_change" if change is None else "below_pct" if abs(change) < min_pct else "below_z" if z is not None and abs(z) < min_z else None
        out.append({**c, "reason": reason, "material": reason is None, "basis": "magnitude_only" if z is None else "magnitude_and_significance"})
    return {"candidates": out}


@tool("noise", "Rows, dates and members of a scope against its baseline.", time_filter="time!", baseline="time", dimension="dimension", filters="filters")
def check_data_quality(e: Engine, time_filter, baseline=None, dimension=None, filters=None) -> dict:
    out = row(noise.data_quality(e.facts, time_filter, baseline, dimension, filters)) | {"columns": rows(noise.quality_columns(e.facts, time_filter, filters).orderBy("column"))["rows"]}
    if baseline is not None:
        out["dimensions"] = rows(noise.quality_dimensions(e.facts, time_filter, baseline, filters).orderBy("dimension"))["rows"]
    return out


@tool("noise", "The line through a KPI's history.", kpi_key="kpi!", grain="grain", time_filter="time", filters="filters", min_points="integer")
def detect_trend(e: Engine, kpi_key: str, grain="quarter", time_filter=None, filters=None, min_points=5) -> dict:
    return row(noise.trend(e.facts, [kpi_key], grain, time_filter or "all", filters, min_points))


ONSET = {"baseline_periods": "integer", "persistence": "integer", "k_sigma": "number"}


@tool("noise", "When a KPI left its early range.", kpi_key="kpi!", grain="grain", time_filter="time", filters="filters", direction="text", **ONSET)
def detect_changepoint(e: Engine, kpi_key: str, grain="week", time_filter=None, filters=None, direction="any", **onset) -> dict:
    if direction not in ("any", "up", "down"):
        raise InvalidArgument("direction is any, up or down")
    return row(noise.changepoint(e.facts, [kpi_key], grain, time_filter or "all", filters, direction, **onset))


# -- scan -------------------------------------------------------------------------------------------------------------


def _scan(e: Engine, time_filter, filters) -> DataFrame | None:
    own = _single(time_filter)
    return noise.significance(e.facts, e.keys, own[0], own[1], filters) if own else None


@tool("scan", "Significance of every KPI's move, from one scan.", time_filter="time!", filters="filters")
def scan_kpis(e: Engine, time_filter, filters=None) -> dict:
    found = _scan(e, time_filter, filters)
    return {"status": "unsupported_baseline"} if found is None else rows(found.orderBy("kpi"))


@tool("scan", "KPIs by how they moved.", time_filter="time!", baseline="time", filters="filters", order_by="text", limit="integer")
def rank_kpis_by_movement(e: Engine, time_filter, baseline=None, filters=None, order_by="unfavourability", limit=10) -> dict:
    before = tf.parse(baseline) if baseline is not None else tf.previous(tf.parse(time_filter))
    if before is None:
        return {"status": "unsupported_baseline"}
    return rows(investigate.rank_movement(e.facts, e.keys, time_filter, before, filters, order_by, limit).orderBy("place"))


@tool("scan", "Moves that are material and unusual, with their trend and onset.", time_filter="time!", filters="filters", grain="grain", max_followups="integer")
def scan_anomalies(e: Engine, time_filter, filters=None, grain="quarter", max_followups=5) -> dict:
    own = _single(time_filter)
    if own is None:
        return {"status": "unsupported_baseline"}
    daily = e.facts.daily(e.keys, filters)
    found = noise.significance(daily, e.keys, own[0], own[1])
    marked = noise.filter_material(found).where("material").orderBy(F.abs("z").desc_nulls_last(), "kpi").limit(max(0, max_followups)).collect()
    keys = [r["kpi"] for r in marked]
    trends = {r["kpi"]: r.asDict() for r in noise.trend(daily, keys, grain).collect()} if keys else {}
    onsets = {r["kpi"]: r.asDict() for r in noise.changepoint(daily, keys, "week").collect()} if keys else {}
    return {"anomalies": [{**r.asDict(), "trend": trends.get(r["kpi"]), "changepoint": onsets.get(r["kpi"])} for r in marked]}


@tool("scan", "Members whose latest change is unusual for them.", kpi_key="kpi!", dimension="dimension!", time_filter="time!", filters="filters")
def scan_dimension_outliers(e: Engine, kpi_key: str, dimension: str, time_filter, filters=None) -> dict:
    own = _single(time_filter)
    if own is None:
        return {"status": "unsupported_baseline"}
    return rows(investigate.dispersion(e.facts, kpi_key, dimension, time_filter, own[1], filters).orderBy(F.abs("z").desc_nulls_last(), "member"))


# -- investigate ------------------------------------------------------------------------------------------------------


def _folded(df: DataFrame, most: int | None) -> dict:
    """The largest effects, and the rest as one; Spark folds them, so what is collected is a row more than asked for."""
    most = 5 if most is None else min(max(most, 0), 2**31 - 2)
    own = placed(df.select(F.struct(*df.columns).alias("member"), "effect", F.col("member").alias("label")), [F.abs("effect").desc_nulls_last(), F.col("label")])
    own = own.select("member", "effect", F.least("place", F.lit(most + 1).cast("long")).alias("place"))
    found = own.groupBy("place").agg(F.first("member").alias("member"), F.count(F.lit(1)).alias("members"), F.coalesce(F.sum("effect"), F.lit(0.0)).alias("effect")).orderBy("place").collect()
    rest = found[most] if len(found) > most else None
    return {"members": [r["member"].asDict(recursive=True) for r in found[:most]], "others": {"members": rest["members"], "effect": rest["effect"]} if rest else None}


@tool("investigate", "A move by members of a dimension.", kpi_key="kpi!", dimension="dimension!", max_items="integer", **PAIR)
def decompose_by_dimension(e: Engine, kpi_key: str, dimension: str, period_a, period_b, filters=None, max_items=None) -> dict:
    return _folded(investigate.by_member(e.facts, kpi_key, dimension, period_a, period_b, filters), max_items)


@tool("investigate", "A ratio's move as rate and mix effects.", kpi_key="kpi!", dimension="dimension!", max_items="integer", **PAIR)
def decompose_rate_mix(e: Engine, kpi_key: str, dimension: str, period_a, period_b, filters=None, max_items=None) -> dict:
    total = row(investigate.rate_mix(e.facts, kpi_key, dimension, period_a, period_b, filters))
    return {**total, **_folded(investigate.by_member(e.facts, kpi_key, dimension, period_a, period_b, filters), max_items)}


@tool("investigate", "A move within one member by another dimension.", kpi_key="kpi!", outer_dimension="dimension!", outer_member="text!", inner_dimension="dimension!", max_items="integer", **PAIR)
def decompose_nested(e: Engine, kpi_key: str, outer_dimension: str, outer_member: str, inner_dimension: str, period_a, period_b, filters=None, max_items=None) -> dict:
    return _folded(investigate.nested(e.facts, kpi_key, outer_dimension, outer_member, inner_dimension, period_a, period_b, filters), max_items)


@tool("investigate", "A move by the parts of the formula.", kpi_key="kpi!", **PAIR)
def decompose_formula(e: Engine, kpi_key: str, period_a, period_b, filters=None) -> dict:
    return rows(investigate.by_formula(e.facts, kpi_key, period_a, period_b, filters))


@tool("investigate", "How much of a move each dimension explains.", kpi_key="kpi!", dimensions="dimensions", **PAIR)
def attribute_dimensions(e: Engine, kpi_key: str, period_a, period_b, filters=None, dimensions=None) -> dict:
    if dimensions == []:
        return {"status": "no_dimensions"}
    found = rows(investigate.shapley(e.facts, kpi_key, period_a, period_b, dimensions, filters).orderBy(F.desc("phi"), "dimension"))
    return found | {"status": "no_usable_cells" if not found["rows"] else "no_variation" if not any(r["phi"] for r in found["rows"]) else "ok"}


@tool("investigate", "Members' share of a move over their share of the baseline.", kpi_key="kpi!", dimension="dimension!", limit="integer", **PAIR)
def compute_over_index(e: Engine, kpi_key: str, dimension: str, period_a, period_b, filters=None, limit=None) -> dict:
    own = investigate.by_member(e.facts, kpi_key, dimension, period_a, period_b, filters).select("member", "contribution_pct", "baseline_share", "over_index")
    return rows(own.withColumn("over_indexed", F.abs("over_index") >= investigate.OVER_INDEX).orderBy(F.desc_nulls_last("over_index"), "member"), limit or MOST_ROWS)


@tool("investigate", "Members of all dimensions by how much they drive a move.", kpi_key="kpi!", dimensions="dimensions", limit="integer", **PAIR)
def rank_drivers(e: Engine, kpi_key: str, period_a, period_b, filters=None, dimensions=None, limit=6) -> dict:
    return rows(investigate.rank_drivers(e.facts, kpi_key, period_a, period_b, dimensions, filters, limit))


@tool("investigate", "A waterfall from baseline to current value.", kpi_key="kpi!", by="text", max_items="integer", **PAIR)
def bridge_periods(e: Engine, kpi_key: str, period_a, period_b, filters=None, by="formula", max_items=5) -> dict:
    if by != "formula":
        e.facts.dimension(by)
    return rows(investigate.bridge(e.facts, kpi_key, period_a, period_b, by, filters, max_items).orderBy("step"))


@tool("investigate", "How concentrated a KPI is.", kpi_key="kpi!", dimension="dimension!", time_filter="time!", filters="filters")
def measure_concentration(e: Engine, kpi_key: str, dimension: str, time_filter, filters=None) -> dict:
    return row(investigate.concentration(e.facts, kpi_key, dimension, time_filter, filters))


@tool("investigate", "Members whose over-index is unusual.", kpi_key="kpi!", dimension="dimension!", **PAIR)
def find_outlier_contributors(e: Engine, kpi_key: str, dimension: str, period_a, period_b, filters=None) -> dict:
    return rows(investigate.outlier_contributors(e.facts, kpi_key, dimension, period_a, period_b, filters).orderBy(F.abs("z").desc_nulls_last(), "member"))


def _absent(own: dict, a: str, b: str, both: str) -> dict:
    gone = own["value_a"] is None, own["value_b"] is None
    return own | {"status": both if all(gone) else a if gone[0] else b if gone[1] else "ok"}


@tool("investigate", "Two members of a dimension.", kpi_key="kpi!", dimension="dimension!", member_a="text!", member_b="text!", period_a="time!", period_b="time")
def compare_segments(e: Engine, kpi_key: str, dimension: str, member_a: str, member_b: str, period_a, period_b=None) -> dict:
    return _absent(row(investigate.compare_segments(e.facts, kpi_key, dimension, member_a, member_b, period_a, period_b)), "member_absent_a", "member_absent_b", "both_absent")


@tool("investigate", "Two groups that filters define.", kpi_key="kpi!", filter_a="filters!", filter_b="filters!", period_a="time!", period_b="time")
def compare_cohorts(e: Engine, kpi_key: str, filter_a: dict, filter_b: dict, period_a, period_b=None) -> dict:
    return _absent(row(investigate.compare_cohorts(e.facts, kpi_key, filter_a, filter_b, period_a, period_b)), "cohort_a_empty", "cohort_b_empty", "both_empty")


@tool("investigate", "How each member moved, in bands.", kpi_key="kpi!", dimension="dimension!", threshold_pct="number", **PAIR)
def segment_by_behavior(e: Engine, kpi_key: str, dimension: str, period_a, period_b, filters=None, threshold_pct=noise.MATERIAL) -> dict:
    own = dict(period_a=period_a, period_b=period_b, threshold_pct=threshold_pct, filters=filters)
    return {"bands": rows(investigate.behaviour_bands(e.facts, kpi_key, dimension, **own).orderBy("band"))["rows"], **rows(investigate.behaviour(e.facts, kpi_key, dimension, **own).orderBy("member"))}


@tool("investigate", "Whether a KPI has a season, and its shape.", kpi_key="kpi!", grain="grain", time_filter="time", filters="filters")
def detect_seasonality(e: Engine, kpi_key: str, grain="quarter", time_filter=None, filters=None) -> dict:
    if grain not in relate.CYCLES:
        return {"status": "unsupported_grain"}
    phases = rows(relate.seasonal_phases(e.facts, kpi_key, grain, filters).orderBy("phase"))["rows"]
    if sum(p["points"] for p in phases) < relate.LEAST_CYCLES * relate.CYCLES[grain]:
        return {"status": "insufficient_cycles", "phases": phases}
    fit = row(relate.seasonal_strength(e.facts, kpi_key, grain, filters))
    if not fit["trend_sigma"]:
        return {"status": "degenerate_dispersion", "phases": phases}
    acf = row(relate.autocorrelation(e.facts, kpi_key, grain, filters))["acf"]
    return {"phases": phases, "acf": acf, "seasonal": acf is not None and acf >= relate.LEAST_ACF, **fit}


@tool("investigate", "A KPI against its trend and season.", kpi_key="kpi!", time_filter="time!", grain="grain", filters="filters", k="number")
def compare_to_seasonal_norm(e: Engine, kpi_key: str, time_filter, grain="quarter", filters=None, k=2.0) -> dict:
    fit = detect_seasonality(e, kpi_key, grain, None, filters)
    if fit.get("status", "ok") != "ok":
        return {"status": fit["status"]}
    found = relate.seasonal_norm(e.facts, kpi_key, time_filter, grain, filters, k).limit(2).collect()
    if len(found) != 1:
        raise InvalidArgument(f"time_filter must resolve to exactly one {grain}")
    own = found[0].asDict()
    return own if own["phase_points"] >= relate.LEAST_POINTS else {"status": "phase_not_covered", "period": own["period"], "phase": own["phase"], "phase_points": own["phase_points"]}


@tool("investigate", "How two KPIs' changes go together.", kpi_a="kpi!", kpi_b="kpi!", min_n="integer", **SAMPLE)
def correlate_kpis(e: Engine, kpi_a: str, kpi_b: str, min_n=6, **scope) -> dict:
    found = rows(relate.correlations(e.facts, kpi_a, [kpi_b], min_n, **_scope(e, scope)))["rows"]
    return found[0] if found else {"status": "no_overlap", "n": 0, "r": None}


@tool("investigate", "How a KPI's changes go with those of many.", kpi_key="kpi!", candidates="kpis", min_n="integer", limit="integer", **SAMPLE)
def correlate_kpi_matrix(e: Engine, kpi_key: str, candidates=None, min_n=6, limit=None, **scope) -> dict:
    own = [c for c in candidates if c != kpi_key] if candidates is not None else catalogue.neighbours(e.facts.catalog, kpi_key, e.facts.measures) or [k for k in e.keys if k != kpi_key]
    most = MOST_CANDIDATES if limit is None else min(MOST_CANDIDATES, max(0, limit))
    scope = _scope(e, scope)
    found = rows(relate.correlations(e.facts, kpi_key, own[:most], min_n, **scope).orderBy(F.abs("r").desc_nulls_last(), "other")) if own[:most] else {"rows": [], "truncated": False}
    return found | {"considered": len(own), "truncated": found["truncated"] or len(own) > most, "dimension": scope.get("dimension")}


def _scope(e: Engine, scope: dict) -> dict:
    """Sample arguments: a cross-section needs two periods, and takes the dimension of most members that both hold if none is given."""
    if scope.get("mode", "cross_sectional") == "cross_sectional":
        if scope.get("period_a") is None or scope.get("period_b") is None:
            raise InvalidArgument("a cross-section needs period_a and period_b")
        return {k: v for k, v in scope.items() if k in ("mode", "period_a", "period_b", "filters")} | {"dimension": scope.get("dimension") or relate.usable_dimension(e.facts, scope["period_a"], scope["period_b"], scope.get("filters"))}
    return {k: v for k, v in scope.items() if k in ("mode", "time_filter", "grain", "filters")}


# -- contest ----------------------------------------------------------------------------------------------------------


@tool("contest", "Which of two KPIs left its range first.", kpi_key="kpi!", cause_kpi="kpi!", grain="grain", time_filter="time", filters="filters", kpi_direction="text", cause_direction="text", **ONSET)
def check_temporal_precedence(e: Engine, kpi_key: str, cause_kpi: str, grain="week", time_filter=None, filters=None, **onset) -> dict:
    return row(relate.precedence(e.facts, kpi_key, cause_kpi, grain, time_filter or "all", filters, **onset))


LAGS = {"grain": "grain", "max_lag": "integer", "time_filter": "time", "filters": "filters", "min_n": "integer"}


@tool("contest", "Correlation of two KPIs at lags.", kpi_key="kpi!", cause_kpi="kpi!", **LAGS)
def cross_correlate_lagged(e: Engine, kpi_key: str, cause_kpi: str, grain="week", max_lag=5, time_filter=None, filters=None, min_n=8) -> dict:
    if not 0 <= max_lag <= MOST_LAG:
        raise InvalidArgument(f"max_lag is from 0 to {MOST_LAG}")
    lags = relate.lagged(e.facts, kpi_key, cause_kpi, grain, max_lag, time_filter or "all", filters, min_n)
    found = rows(lags.orderBy("lag"))["rows"]
    best = relate.best_lag(lags).first()
    status = "ok" if best else "no_overlap" if not found else "insufficient_history" if all(r["n"] < min_n for r in found) else "no_usable_lag"
    return {"status": status, "lags": found, "best": best.asDict() if best else None}


@tool("contest", "Whether the effect may be the cause.", kpi_key="kpi!", cause_kpi="kpi!", **LAGS)
def test_reverse_causation(e: Engine, kpi_key: str, cause_kpi: str, **lags) -> dict:
    tie = catalogue.mechanical(e.facts.catalog, kpi_key, cause_kpi, e.facts.measures)
    if tie in ("mutual", "kpi_derived_from_cause", "cause_derived_from_kpi"):
        return {"mechanical": tie, "verdict": "definitional"}
    found = cross_correlate_lagged(e, kpi_key, cause_kpi, **lags)
    ahead = {"cause_leads": "forward_supported", "kpi_leads": "reverse_supported"}
    return {"mechanical": tie, "verdict": ahead.get(found["best"]["verdict"], "undetermined") if found["best"] else "undetermined", "lagged": found}


@tool("contest", "Members that got worse though the cause did not move.", kpi_key="kpi!", cause_kpi="kpi!", dimension="dimension!", cause_direction="text", limit="integer", **PAIR)
def find_counterexamples(e: Engine, kpi_key: str, cause_kpi: str, dimension: str, period_a, period_b, filters=None, cause_direction="any", limit=20) -> dict:
    if cause_direction not in ("any", "up", "down"):
        raise InvalidArgument("cause_direction is any, up or down")
    return rows(relate.counterexamples(e.facts, kpi_key, cause_kpi, dimension, period_a, period_b, filters, cause_direction=cause_direction).orderBy("member"), limit)


@tool("contest", "Whether KPI and cause move alike in each member.", kpi_key="kpi!", cause_kpi="kpi!", dimension="dimension!", min_n="integer", **PAIR)
def test_consistency_across_dimension(e: Engine, kpi_key: str, cause_kpi: str, dimension: str, period_a, period_b, filters=None, min_n=3) -> dict:
    own = relate.consistency(e.facts, kpi_key, cause_kpi, dimension, period_a, period_b, filters)
    return {**row(relate.consistency_rate(own, min_n)), **rows(own.orderBy("member"))}


@tool("contest", "The KPI where the cause moved and where it did not.", kpi_key="kpi!", cause_kpi="kpi!", dimension="dimension!", **PAIR)
def test_holdout_segments(e: Engine, kpi_key: str, cause_kpi: str, dimension: str, period_a, period_b, filters=None) -> dict:
    return row(relate.holdout(e.facts, kpi_key, cause_kpi, dimension, period_a, period_b, filters))


@tool("contest", "What remains of a correlation given others.", kpi_key="kpi!", cause_kpi="kpi!", candidates="kpis!", min_n="integer", alpha="number", **SAMPLE)
def test_confounders(e: Engine, kpi_key: str, cause_kpi: str, candidates: list, min_n=6, alpha=0.05, **scope) -> dict:
    return contest.confounders(e.facts, kpi_key, cause_kpi, candidates, min_n, alpha, **_scope(e, scope))


@tool("contest", "Whether a correlation is only a shared trend.", kpi_key="kpi!", cause_kpi="kpi!", grain="grain", time_filter="time", filters="filters", min_n="integer", alpha="number")
def test_spurious_correlation(e: Engine, kpi_key: str, cause_kpi: str, grain="quarter", time_filter=None, filters=None, min_n=6, alpha=0.05) -> dict:
    return contest.spurious(e.facts, kpi_key, cause_kpi, grain, time_filter or "all", filters, min_n, alpha)


@tool("contest", "Rival causes side by side.", kpi_key="kpi!", candidate_causes="kpis!", ordered_by="text", precedence_grain="grain", min_n="integer", alpha="number", include_precedence="flag", include_consistency="flag", **SAMPLE)
def rank_competing_explanations(e: Engine, kpi_key: str, candidate_causes: list, ordered_by="abs_partial_r", precedence_grain="week", min_n=6, alpha=0.05, include_precedence=True, include_consistency=True, **scope) -> dict:
    return contest.competing(e.facts, kpi_key, candidate_causes, ordered_by, precedence_grain, min_n, alpha, include_precedence, include_consistency, **_scope(e, scope))


@tool("contest", "p, q and interval of correlations.", kpi_key="kpi!", cause_kpi="kpi", candidates="kpis", min_n="integer", alpha="number", **SAMPLE)
def test_statistical_significance(e: Engine, kpi_key: str, cause_kpi=None, candidates=None, min_n=6, alpha=0.05, **scope) -> dict:
    return contest.statistical_significance(e.facts, kpi_key, cause_kpi, candidates, min_n, alpha, **_scope(e, scope))


@tool("contest", "Whether there is enough to test on.", kpi_key="kpi!", dimension="dimension", time_filter="time", grain="grain", filters="filters", min_n="integer", alpha="number", power="number")
def check_sample_adequacy(e: Engine, kpi_key: str, dimension=None, time_filter=None, grain="quarter", filters=None, min_n=6, alpha=0.05, power=0.8) -> dict:
    return contest.adequacy(e.facts, kpi_key, dimension, time_filter or "all", grain, filters, min_n, alpha, power)


@tool("contest", "Whether one member makes a correlation.", kpi_key="kpi!", cause_kpi="kpi!", dimension="dimension", min_n="integer", alpha="number", **PAIR)
def test_sensitivity_to_outliers(e: Engine, kpi_key: str, cause_kpi: str, period_a, period_b, dimension=None, filters=None, min_n=6, alpha=0.05) -> dict:
    return contest.outlier_sensitivity(e.facts, kpi_key, cause_kpi, period_a, period_b, dimension, filters, min_n, alpha)


@tool("contest", "The size of an effect with intervals.", kpi_key="kpi!", cause_kpi="kpi!", min_n="integer", alpha="number", **SAMPLE)
def estimate_effect_size(e: Engine, kpi_key: str, cause_kpi: str, min_n=6, alpha=0.05, **scope) -> dict:
    return contest.effect_size(e.facts, kpi_key, cause_kpi, min_n, alpha, **_scope(e, scope))
