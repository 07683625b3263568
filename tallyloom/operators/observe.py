"""The overview of one KPI in one period: value, significance, members, drivers, histories and all KPIs beside it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import lru_cache, partial

from pyspark.sql import DataFrame

from tallyloom.errors import EmptyPeriod
from tallyloom.operators import investigate, noise, retrieve
from tallyloom.plans import timefilter as tf
from tallyloom.sources.facts import Facts


def default_kpi(f: Facts) -> str | None:
    """revenue if there is one, else the first additive KPI for which more is better, else the first."""
    keys = f.catalog.available(f.measures)
    good = [k for k in keys if f.kpi(k).additive and f.kpi(k).higher_is_better]
    return "revenue" if "revenue" in keys else good[0] if good else keys[0] if keys else None


class Overview(Mapping[str, DataFrame]):
    """Frames by name, each planned when it is first asked for, so that reading one costs nothing for the others."""

    def __init__(self, frames: dict[str, Callable[[], DataFrame]]) -> None:
        self._frames, self._planned = frames, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._planned:
            self._planned[name] = self._frames[name]()
        return self._planned[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._frames)

    def __len__(self) -> int:
        return len(self._frames)


def latest(f: Facts) -> tf.TimeFilter:
    """The latest quarter that holds rows, from their dates alone."""
    bound = tf.parse({"type": "latest", "grain": "quarter", "n": 1}).bind(f.load(set()))
    if not bound.wanted:
        raise EmptyPeriod("the latest quarter", [])
    return tf.parse(bound.wanted[0])


def observe(f: Facts, kpi_key: str | None = None, period: str | None = None, dimensions: list[str] | None = None) -> Overview:
    """Frames by name. The period is the latest quarter held unless given; it is compared with the one before."""
    key = kpi_key or default_kpi(f)
    dims, keys = list(dimensions or f.dimensions), f.catalog.available(f.measures)
    # values and histories come from the KPI's sums by day, which tell the latest quarter too: the facts are scanned and joined once
    day = lru_cache(maxsize=None)(lambda: f.daily([key]))
    now = lru_cache(maxsize=None)(lambda: tf.parse(period) if period else latest(day()))
    pair = lambda: (now(), tf.previous(now()))
    out: dict[str, Callable[[], DataFrame]] = {
        "value": lambda: noise.compare(day(), key, *pair()), "significance": lambda: noise.significance(day(), [key], now().name, now().kind), "quarters": lambda: retrieve.series(day(), [key], "quarter"),
        "weeks": lambda: retrieve.series(day(), [key], "week", {"type": "latest", "grain": "quarter", "n": 3}), "scoreboard": lambda: investigate.movement(f, keys, *pair()),
    }
    if f.kpi(key).kind != "mean":
        out |= {f"members_{d}": partial(lambda d: investigate.by_member(f, key, d, *pair()), d) for d in dims}
        out |= {"attribution": lambda: investigate.shapley(f, key, *pair(), dims), "drivers": lambda: investigate.rank_drivers(f, key, *pair(), dims), "focus": lambda: investigate.focus(f, key, *pair(), dims)}
    return Overview(out)
