"""KPI formulas: parsing, inspection and compilation to columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.errors import MalformedFormula

Node = "Ref | Num | Op"


@dataclass(frozen=True)
class Ref:
    name: str


@dataclass(frozen=True)
class Num:
    value: float


@dataclass(frozen=True)
class Op:
    """A binary operation; a negation is 0 - x."""

    sign: str
    left: Node
    right: Node


_TOKEN = re.compile(r"\s*(?:\{([^{}]+)\}|(\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|([-+*/()]))")
#: How tightly each operator binds.
_BINDING = {"+": 1, "-": 1, "*": 2, "/": 2}


def parse(text: str) -> Node:
    """The tree of an arithmetic expression over ``{field}`` or bare names, numbers, + - * / and brackets."""
    tokens, at = [], 0
    stripped = text.rstrip()
    while at < len(stripped):
        if not (m := _TOKEN.match(stripped, at)):
            raise MalformedFormula(f"{text!r}: nothing can start at {stripped[at : at + 10]!r}")
        field, number, name, sign = m.groups()
        tokens.append(Ref((field or name).strip()) if field or name else Num(float(number)) if number else sign)
        at = m.end()

    def climb(least: int) -> Node:
        left = primary()
        while tokens and isinstance(tokens[0], str) and _BINDING.get(tokens[0], 0) >= least:
            sign = tokens.pop(0)
            left = Op(sign, left, climb(_BINDING[sign] + 1))
        return left

    def primary() -> Node:
        if not tokens:
            raise MalformedFormula(f"{text!r} ends too early")
        token = tokens.pop(0)
        if token == "-":
            return Op("-", Num(0.0), primary())
        if token == "(":
            inner = climb(1)
            if not tokens or tokens.pop(0) != ")":
                raise MalformedFormula(f"{text!r}: a bracket is not closed")
            return inner
        if isinstance(token, str):
            raise MalformedFormula(f"{text!r}: {token!r} is out of place")
        return token

    tree = climb(1)
    if tokens:
        raise MalformedFormula(f"{text!r}: {tokens[0]!r} is left over")
    return tree


def fields(node: Node) -> set[str]:
    return {node.name} if isinstance(node, Ref) else set() if isinstance(node, Num) else fields(node.left) | fields(node.right)


def expand(node: Node, lookup: Callable[[str], Node | None], path: tuple[str, ...] = ()) -> Node:
    """``node`` with each name that ``lookup`` knows replaced by its own tree; a name inside itself is an error."""
    if isinstance(node, Ref):
        if node.name in path:
            raise MalformedFormula(f"{' -> '.join([*path, node.name])} refers to itself")
        inner = lookup(node.name)
        return node if inner is None else expand(inner, lookup, (*path, node.name))
    if isinstance(node, Num):
        return node
    return Op(node.sign, expand(node.left, lookup, path), expand(node.right, lookup, path))


def column(node: Node, of: Mapping[str, Column] | None = None) -> Column:
    """A double column; a missing operand or a division by zero gives null."""
    if isinstance(node, Ref):
        return (of[node.name] if of else F.col(f"`{node.name}`")).cast("double")
    if isinstance(node, Num):
        return F.lit(node.value)
    left, right = column(node.left, of), column(node.right, of)
    return {"+": left + right, "-": left - right, "*": left * right}[node.sign] if node.sign != "/" else F.try_divide(left, right)


def terms(node: Node, sign: int = 1) -> list[tuple[int, Node]]:
    """The signed summands of a tree."""
    if isinstance(node, Op) and node.sign in "+-":
        return [t for t in terms(node.left, sign) + terms(node.right, -sign if node.sign == "-" else sign) if t[1] != Num(0.0)]
    return [(sign, node)]


def placed(node: Node, place: str = "term", sign: int = 1) -> list[dict]:
    """Each leaf with its sign and place: numerator, denominator, factor or term."""
    if isinstance(node, Num):
        return []
    if isinstance(node, Ref):
        return [{"field": node.name, "sign": sign, "place": place}]
    if node.sign == "/":
        return placed(node.left, "numerator", sign) + placed(node.right, "denominator", sign)
    if node.sign == "*":
        inner = place if place in ("numerator", "denominator") else "factor"
        return placed(node.left, inner, sign) + placed(node.right, inner, sign)
    return placed(node.left, place, sign) + placed(node.right, place, -sign if node.sign == "-" else sign)


#: A product's parts: the factors above and below the line, in order.
_Product = tuple[tuple[str, ...], tuple[str, ...]]


def _summands(node: Node) -> dict[_Product, float]:
    """A tree as a sum of products with their coefficients; a sum inside a product stays one factor."""
    if isinstance(node, Num):
        return {((), ()): node.value}
    if isinstance(node, Ref):
        return {(("{" + node.name + "}",), ()): 1.0}
    left, right = _summands(node.left), _summands(node.right)
    if node.sign in "+-":
        out = dict(left)
        for product, k in right.items():
            out[product] = out.get(product, 0.0) + (k if node.sign == "+" else -k)
        return {p: k for p, k in out.items() if k} or {((), ()): 0.0}

    def single(own: dict[_Product, float]) -> tuple[float, _Product]:
        if len(own) == 1:
            (product, k), = own.items()
            return k, product
        return 1.0, ((_written(own),), ())

    (a, (up, below)), (b, (more, under)) = single(left), single(right)
    if node.sign == "*":
        return {(tuple(sorted(up + more)), tuple(sorted(below + under))): a * b}
    # a division by a constant 0 is undefined, whatever stands above
    return {(tuple(sorted(up + under)), tuple(sorted(below + more))): a / b} if b else {(up, (*below, "0")): a}


def _written(own: dict[_Product, float]) -> str:
    part = lambda p, k: f"{k:+.12g}" + "".join(f"*{x}" for x in p[0]) + "".join(f"/{x}" for x in p[1])
    return "(" + " ".join(sorted(part(p, k) for p, k in own.items())) + ")"


def canonical(node: Node) -> str:
    """One text for all ways to write a formula that differ in order, brackets, signs or constants only."""
    return _written(_summands(node))
