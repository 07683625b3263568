"""What a question names: KPIs, members, periods and a contrast, each with how sure that is."""

from __future__ import annotations

import re

from tallyloom.functions.text import ngrams, normalise
from tallyloom.plans import catalogue
from tallyloom.plans import timefilter as tf
from tallyloom.sources.facts import Facts

#: Words that set two sides against each other, months, and the lead and least score of a KPI that is meant.
CONTRASTS = (" versus ", " vs ", " vs. ", " compared with ", " compared to ", " against ", " than ")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MARGIN, FLOOR = 0.15, 0.5


def periods(text: str) -> list[dict]:
    """The time scopes that a text names, in order: quarters, months, years, ranges of years, and the latest n of a grain."""
    low, found = text.lower(), []
    taken: list[tuple[int, int]] = []

    def add(m: re.Match, spec: dict) -> None:
        if not any(a < m.end() and m.start() < b for a, b in taken):
            taken.append(m.span())
            found.append((m.start(), spec))

    for m in re.finditer(r"\bq([1-4])[ ,-]*(?:of )?(\d{4})\b|\b(\d{4})[ -]*q([1-4])\b", low):
        add(m, {"type": "quarter", "year": int(m[2] or m[3]), "quarter": int(m[1] or m[4])})
    for m in re.finditer(rf"\b({'|'.join(MONTHS)})[ ,]*(\d{{4}})\b", low):
        label = f"{m[2]}-{MONTHS.index(m[1]) + 1:02d}"
        add(m, {"type": "months", "start": label, "end": label})
    for m in re.finditer(r"\b(?:from |between )?(\d{4})(?: to | and | through |-)(\d{4})\b", low):
        if int(m[1]) <= int(m[2]):
            add(m, {"type": "years", "values": list(range(int(m[1]), int(m[2]) + 1))})
    for m in re.finditer(r"\b(?:last|latest|past|recent) (?:(\d{1,3}) )?(year|quarter|month|week|day)s?\b", low):
        add(m, {"type": "latest", "grain": m[2], "n": int(m[1] or 1)})
    for m in re.finditer(r"\b((?:19|20)\d{2})\b", low):
        add(m, {"type": "year", "year": int(m[1])})
    for _, spec in found:
        tf.parse(spec)
    return [spec for _, spec in sorted(found, key=lambda x: x[0])]


def members(f: Facts, text: str) -> list[dict]:
    """Members that a text names, by its longest word runs first; a word is used once. A name of several dimensions is ambiguous.

    The runs are sought in the frame, once for each dimension, so any number of members will do.
    """
    grams, found, used = ngrams(text, 4), [], set()
    known = {d: f.held(d, map(normalise, grams)) for d in f.dimensions}
    for gram in grams:
        if used & set(gram.split()):
            continue
        hits = [(d, own[normalise(gram)]) for d, own in known.items() if normalise(gram) in own]
        if hits:
            used |= set(gram.split())
            found.append({"text": gram, "dimension": hits[0][0], "member": hits[0][1], "ambiguous": [d for d, _ in hits[1:]]})
    return found


def ground(f: Facts, question: str) -> dict:
    """KPIs, members, periods and sides of a question; a KPI is certain if it leads by a margin and scores enough."""
    low = f" {question.lower()} "
    split = next((low.split(c, 1) for c in CONTRASTS if c in low), None)
    matches = catalogue.search(f.catalog, question)
    lead = matches[0]["score"] - (matches[1]["score"] if len(matches) > 1 else 0.0) if matches else 0.0
    return {
        "kpis": matches, "kpi": matches[0]["kpi"] if matches and matches[0]["score"] >= FLOOR and lead >= MARGIN else None,
        "ambiguous": [m["kpi"] for m in matches if matches[0]["score"] - m["score"] < MARGIN] if matches and lead < MARGIN else [],
        "members": members(f, question), "periods": periods(question), "sides": [s.strip() for s in split] if split else [],
    }
