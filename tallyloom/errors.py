"""Typed errors: a code that callers can branch on, a message, and bounded alternatives."""

from __future__ import annotations

MOST_ALTERNATIVES = 20


class AnalyticsError(Exception):
    code = "tool_error"

    def __init__(self, message: str, **details):
        super().__init__(message)
        self.details = details

    def payload(self) -> dict:
        return {"status": "error", "error": {"code": self.code, "message": str(self), **self.details}}


class UnknownKpi(AnalyticsError):
    code = "unknown_kpi"


class UnknownDimension(AnalyticsError):
    code = "unknown_dimension"


class MalformedFormula(AnalyticsError):
    code = "malformed_formula"


class UnknownMember(AnalyticsError):
    code = "unknown_member"

    def __init__(self, dimension: str, text: str, alternatives: list[str]):
        super().__init__(f"{dimension} has no member {text!r}", dimension=dimension, alternatives=sorted(alternatives)[:MOST_ALTERNATIVES])


class MalformedTimeFilter(AnalyticsError):
    code = "malformed_time_filter"


class EmptyPeriod(AnalyticsError):
    code = "empty_period"

    def __init__(self, label: str, held: list[str]):
        super().__init__(f"no rows in {label}", held=sorted(held)[-MOST_ALTERNATIVES:])


class InvalidArgument(AnalyticsError):
    code = "invalid_argument"
