"""KPI definitions and the sums that they are computed from."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.errors import InvalidArgument, UnknownKpi
from tallyloom.functions import formula


@dataclass(frozen=True)
class RowFilter:
    """A condition on rows that count for a KPI."""

    column: str
    op: str
    value: object = None

    def predicate(self) -> Column:
        c = F.col(f"`{self.column}`")
        if self.op in ("in", "not_in"):
            inside = c.isin(list(self.value))
            return inside if self.op == "in" else ~inside
        if self.op in ("is_null", "not_null"):
            return c.isNull() if self.op == "is_null" else c.isNotNull()
        tests = {"eq": c == self.value, "ne": c != self.value, "gt": c > self.value, "gte": c >= self.value, "lt": c < self.value, "lte": c <= self.value}
        if self.op not in tests:
            raise InvalidArgument(f"no row filter {self.op!r}")
        return tests[self.op]


@dataclass(frozen=True)
class Kpi:
    """kind is sum, mean or ratio; a ratio is always the sum of its numerator over the sum of its denominator."""

    key: str
    kind: str
    numerator: formula.Node
    denominator: formula.Node | None = None
    scale: float = 1.0
    unit: str = "count"
    higher_is_better: bool = True
    label: str = ""
    description: str = ""
    tags: tuple[str, ...] = ()
    filters: tuple[RowFilter, ...] = ()

    @property
    def additive(self) -> bool:
        return self.kind == "sum"

    def fields(self) -> set[str]:
        own = formula.fields(self.numerator) | (formula.fields(self.denominator) if self.denominator else set())
        return own | {f.column for f in self.filters}

    def tree(self) -> formula.Node:
        return formula.Op("/", self.numerator, self.denominator) if self.denominator else self.numerator

    def sums(self, when: Column | None = None, suffix: str = "") -> list[Column]:
        """The aggregates that the value is finished from: its numerator, and for means and ratios its denominator.

        Row filters and ``when`` stand inside the aggregates, so KPIs of different conditions share one scan.
        """
        tests = [f.predicate() for f in self.filters] + ([when] if when is not None else [])
        test = reduce(lambda a, b: a & b, tests) if tests else None
        only = lambda c: F.when(test, c) if test is not None else c
        top = formula.column(self.numerator)
        out = [F.sum(only(top)).alias(f"{self.key}__n{suffix}")]
        if self.kind == "mean":
            out.append(F.count(only(top)).cast("double").alias(f"{self.key}__d{suffix}"))
        elif self.kind == "ratio":
            out.append(F.sum(only(formula.column(self.denominator))).alias(f"{self.key}__d{suffix}"))
        return out

    def sum_names(self, suffix: str = "") -> list[str]:
        return [f"{self.key}__n{suffix}"] + ([f"{self.key}__d{suffix}"] if self.kind != "sum" else [])

    def finish(self, suffix: str = "") -> Column:
        top = F.col(f"{self.key}__n{suffix}")
        return top if self.kind == "sum" else F.try_divide(top, F.col(f"{self.key}__d{suffix}")) * self.scale


def kpi(key: str, kind: str, top: str, bottom: str | None = None, **more) -> Kpi:
    return Kpi(key, kind, formula.parse(top), formula.parse(bottom) if bottom else None, label=more.pop("label", key.replace("_", " ").capitalize()), **more)


@dataclass
class Catalog:
    """KPIs by key. A formula may name another KPI, which is then put in its place."""

    kpis: dict[str, Kpi] = field(default_factory=dict)

    @classmethod
    def of(cls, kpis: Iterable[Kpi]) -> Catalog:
        return cls({k.key: k for k in kpis})

    def resolve(self, key: str, columns: Iterable[str] = ()) -> Kpi:
        """The KPI with names of other KPIs expanded; a bare column is its own sum."""
        columns = set(columns)
        if key not in self.kpis:
            if key in columns:
                return Kpi(key, "sum", formula.Ref(key), label=key)
            raise UnknownKpi(f"no KPI {key!r}", alternatives=sorted(self.kpis)[:20])

        def lookup(name: str) -> formula.Node | None:
            return self.kpis[name].tree() if name in self.kpis and name not in columns else None

        found = self.kpis[key]
        start = (key,) if key not in columns else ()
        grow = lambda node: formula.expand(node, lookup, start) if node else None
        return replace(found, numerator=grow(found.numerator), denominator=grow(found.denominator))

    def available(self, columns: Iterable[str]) -> list[str]:
        """Keys whose columns are all there."""
        held, out = set(columns), []
        for key in self.kpis:
            if self.resolve(key, held).fields() <= held:
                out.append(key)
        return out
