"""What KPIs mean and how they hang together: search by phrase, formula structure, components, relatives."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from tallyloom.functions import formula
from tallyloom.functions.text import contains_phrase, normalise, words
from tallyloom.plans.kpi import Catalog, Kpi

#: How much each kind of match says that a phrase names a KPI, as score and basis.
MATCHES = {"name": (1.0, "exact_name"), "phrase": (0.85, "exact_name"), "tag": (0.8, "semantic_tag"), "field": (0.7, "concept_alias"), "word": (0.55, "exact_name"), "definition": (0.35, "business_definition")}
#: How much each kind of relation weighs, the decay by depth, and the least overlap of fields.
WEIGHTS = {"formula": 1.0, "derivation": 0.9, "shared_source_field": 0.6, "semantic_tag": 0.35}
DECAY, LEAST_OVERLAP = 0.9, 0.34


def search(catalog: Catalog, text: str, limit: int | None = 8, min_score: float = 0.0) -> list[dict]:
    """KPIs that a phrase may mean, by the strongest of their matches: (-score, key)."""
    grams = ["_".join(own) for n in range(4, 0, -1) for k in range(len(words(text)) - n + 1) for own in [words(text)[k : k + n]]]
    found = []
    for key, k in catalog.kpis.items():
        best = None
        for gram in grams:
            phrase = gram.replace("_", " ")
            if gram in (normalise(key), normalise(k.label)):
                how = "name"
            elif len(gram) > 3 and (contains_phrase(k.label, phrase) or contains_phrase(key, phrase)):
                how = "phrase" if "_" in gram else "word"
            elif gram in k.tags:
                how = "tag"
            elif gram in {normalise(f) for f in k.fields()}:
                how = "field"
            elif "_" in gram and len(gram) > 6 and contains_phrase(k.description, phrase):
                how = "definition"
            else:
                continue
            score, basis = MATCHES[how]
            if best is None or score > best["score"]:
                best = {"kpi": key, "label": k.label, "score": score, "basis": basis, "matched": gram}
        if best and best["score"] >= min_score:
            found.append(best)
    return sorted(found, key=lambda m: (-m["score"], m["kpi"]))[:limit]


def definition(k: Kpi) -> dict:
    return {"kpi": k.key, "label": k.label, "description": k.description, "unit": k.unit, "kind": k.kind, "additive": k.additive, "higher_is_better": k.higher_is_better, "fields": sorted(k.fields()), "tags": list(k.tags)}


def structure(catalog: Catalog, key: str, columns: list[str], expand: bool = True, max_depth: int = 4) -> dict:
    """Signed and placed leaves of a KPI's formula; KPIs that it names are listed, and expanded down to ``max_depth``."""
    own = catalog.resolve(key, columns) if expand else catalog.kpis.get(key, catalog.resolve(key, columns))
    named = [{"kpi": t["field"], **t} for t in formula.placed(catalog.kpis[key].tree())] if key in catalog.kpis else []
    return {"kpi": key, "kind": own.kind, "terms": formula.placed(own.tree()), "components": [t for t in named if t["field"] in catalog.kpis and t["field"] not in columns], "expanded": expand}


@dataclass(frozen=True)
class Relation:
    source: str
    target: str
    relation: str
    weight: float
    fields: tuple[str, ...]
    depth: int = 0
    sign: int = 1


def _signed(node: formula.Node) -> frozenset:
    return frozenset((s, repr(t)) for s, t in formula.terms(node))


def components(catalog: Catalog, key: str, columns: list[str]) -> list[Relation]:
    """KPIs that a formula is made of: those it names, at any depth, and those whose terms are one half of it."""
    found: dict[tuple[str, str], Relation] = {}

    def named(current: str, depth: int, path: tuple[str, ...]) -> None:
        if current not in catalog.kpis or current in path or depth > 4:
            return
        for t in formula.placed(catalog.kpis[current].tree()):
            other = t["field"]
            if other in catalog.kpis and other not in columns and other != key:
                slot = (other, t["place"])
                if slot not in found:
                    found[slot] = Relation(other, key, t["place"], round(WEIGHTS["formula"] * DECAY**depth, 3), tuple(sorted(catalog.resolve(other, columns).fields())), depth, t["sign"])
                named(other, depth + 1, (*path, current))

    named(key, 0, ())
    own = catalog.resolve(key, columns)
    for place, half in (("numerator", own.numerator), ("denominator", own.denominator)):
        for other in catalog.kpis:
            rival = catalog.resolve(other, columns)
            if other != key and own.denominator and half and rival.denominator is None and _signed(rival.numerator) == _signed(half):
                found.setdefault((other, place), Relation(other, key, place, WEIGHTS["formula"], tuple(sorted(rival.fields()))))
    return sorted(found.values(), key=lambda r: (r.depth, -r.weight, r.source, r.relation))


def related(catalog: Catalog, key: str, columns: list[str], relations: list[str] | None = None, depth: int = 1) -> list[Relation]:
    """All relatives, best evidence first: components to ``depth``, KPIs that are built from this one, shared fields, shared tags."""
    found: dict[tuple[str, str], Relation] = {}
    queue, seen = [(key, 0)], set()
    while queue:
        current, hop = queue.pop(0)
        if current in seen or current not in catalog.kpis:
            continue
        seen.add(current)
        for r in components(catalog, current, columns):
            if r.source != key:
                found.setdefault((r.source, r.relation), Relation(r.source, key, r.relation, round(r.weight * DECAY**hop, 3), r.fields, r.depth + hop, r.sign))
            if hop + 1 < depth:
                queue.append((r.source, hop + 1))
    made = {s for s, _ in found}
    own = catalog.resolve(key, columns)
    mine, tags = own.fields(), set(own.tags)
    for other in catalog.kpis:
        if other == key or other in made:
            continue
        rival = catalog.resolve(other, columns)
        theirs = rival.fields()
        overlap = len(mine & theirs) / len(mine | theirs) if mine | theirs else 0.0
        if any(r.source == key for r in components(catalog, other, columns)):
            r = Relation(other, key, "derivation", WEIGHTS["derivation"], tuple(sorted(mine & theirs)))
        elif overlap >= LEAST_OVERLAP:
            r = Relation(other, key, "shared_source_field", round(WEIGHTS["shared_source_field"] * overlap, 3), tuple(sorted(mine & theirs)))
        elif tags & set(rival.tags):
            r = Relation(other, key, "semantic_tag", WEIGHTS["semantic_tag"], ())
        else:
            continue
        found.setdefault((other, r.relation), r)
    kept = [r for r in found.values() if relations is None or r.relation in relations]
    return sorted(kept, key=lambda r: (-r.weight, r.depth, r.source, r.relation))


def neighbours(catalog: Catalog, key: str, columns: list[str], depth: int = 1) -> list[str]:
    return list(dict.fromkeys(r.source for r in related(catalog, key, columns, depth=depth)))


def payload(relations: list[Relation]) -> list[dict]:
    return [asdict(r) for r in relations]


def mechanical(catalog: Catalog, key: str, cause: str, columns: list[str]) -> str:
    """Whether two KPIs are tied by formula: one derived from the other, both, sharing inputs, or none of these."""
    down = any(r.source == cause for r in components(catalog, key, columns))
    up = any(r.source == key for r in components(catalog, cause, columns))
    if down and up:
        return "mutual"
    if down:
        return "kpi_derived_from_cause"
    if up:
        return "cause_derived_from_kpi"
    return "shared_inputs" if catalog.resolve(key, columns).fields() & catalog.resolve(cause, columns).fields() else "none"
