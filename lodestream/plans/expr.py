"""Conditions and references: one grammar, evaluated on the driver or compiled to a Column.

    or > and > comparison > not > value

Comparisons don't chain. `not` binds tighter than a comparison. A bare word is
a string; ${a.b.c} is a reference. Numbers compare as floats; other types only
for equality, which is deep. Truth: null, false, 0 and "" are false, all else
true. A reference to something missing is an error, not false.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = re.compile(r"\$\{([^}]*)\}")
TOKEN = re.compile(
    r"""\s*(?:(?P<ref>\$\{[^}]*\})|(?P<str>'[^']*'|"[^"]*")|(?P<num>[+-]?(?:\d[\d.+\-eE]*|\.\d[\d.+\-eE]*))|(?P<op>==|!=|<=|>=|<|>|\(|\))|(?P<word>[A-Za-z_][A-Za-z0-9_.\-]*))"""
)


class ExprError(ValueError):
    """A condition that can't be read or evaluated."""


@dataclass(frozen=True)
class Node:
    kind: str
    value: Any = None
    parts: tuple = ()


def references(value) -> list[str]:
    """Paths of all ${} in strings anywhere in a JSON-like value, in order."""
    if isinstance(value, str):
        return [m.strip() for m in REFERENCE.findall(value)]
    if isinstance(value, dict):
        return [r for v in value.values() for r in references(v)]
    return [r for v in value for r in references(v)] if isinstance(value, list | tuple) else []


def whole(text) -> str | None:
    """The path if the text is exactly one reference."""
    m = REFERENCE.fullmatch(text.strip()) if isinstance(text, str) else None
    return m[1].strip() if m else None


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = TOKEN.match(text, at)
        if not m:
            raise ExprError(f"unexpected {text[at:].strip()[0]!r} in {text!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def parse(text: str) -> Node:
    found, at = tokens(text), 0
    if not found:
        raise ExprError("empty condition")

    def peek(*words):
        return at < len(found) and found[at][1] in words and found[at][0] in ("op", "word")

    def take():
        nonlocal at
        at += 1
        return found[at - 1]

    def either():
        left = both()
        while peek("or"):
            take()
            left = Node("or", None, (left, both()))
        return left

    def both():
        left = compare()
        while peek("and"):
            take()
            left = Node("and", None, (left, compare()))
        return left

    def compare():
        left = negate()
        if peek("==", "!=", "<", "<=", ">", ">="):
            return Node("cmp", take()[1], (left, negate()))
        return left

    def negate():
        if peek("not"):
            take()
            return Node("not", None, (negate(),))
        return value()

    def value():
        if at >= len(found):
            raise ExprError(f"{text!r} ends too early")
        kind, v = take()
        if v == "(" and kind == "op":
            inner = either()
            if not peek(")"):
                raise ExprError(f"a bracket of {text!r} is open")
            take()
            return inner
        if kind == "ref":
            return Node("ref", v[2:-1].strip())
        if kind == "str":
            return Node("lit", v[1:-1])
        if kind == "num":
            try:
                return Node("lit", float(v))
            except ValueError:
                raise ExprError(f"{v!r} is no number") from None
        if kind == "word":
            return Node("lit", {"true": True, "false": False, "null": None}.get(v, v))
        raise ExprError(f"unexpected {v!r} in {text!r}")

    tree = either()
    if at < len(found):
        raise ExprError(f"unexpected {found[at][1]!r} in {text!r}")
    return tree


def truthy(v) -> bool:
    return not (v is None or v is False or v == "" or (isinstance(v, int | float) and v == 0))


def number(v) -> bool:
    return isinstance(v, int | float) and not isinstance(v, bool)


def evaluate(node: Node, lookup) -> Any:
    """lookup(path) gives a value or raises ExprError."""
    if node.kind == "lit":
        return node.value
    if node.kind == "ref":
        return lookup(node.value)
    if node.kind == "not":
        return not truthy(evaluate(node.parts[0], lookup))
    if node.kind in ("or", "and"):
        left = truthy(evaluate(node.parts[0], lookup))
        return left if left == (node.kind == "or") else truthy(evaluate(node.parts[1], lookup))
    a, b = (evaluate(p, lookup) for p in node.parts)
    op = node.value
    if number(a) and number(b):
        a, b = float(a), float(b)
        return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    if op in ("==", "!="):
        same = type(a) is type(b) and a == b
        return same == (op == "==")
    raise ExprError(f"{a!r} and {b!r} have no order")


def holds(text: str, lookup) -> bool:
    return truthy(evaluate(parse(text), lookup))


def from_mapping(values: dict):
    """A lookup over nested dicts."""

    def lookup(path: str):
        v = values
        for k in path.split("."):
            if not isinstance(v, dict) or k not in v:
                raise ExprError(f"nothing at {path!r}")
            v = v[k]
        return v

    return lookup


def truthy_column(c: Column, kind: str) -> Column:
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    if kind == "string":
        return F.coalesce(c != "", F.lit(False))
    if kind in ("double", "float", "int", "bigint", "smallint", "tinyint") or kind.startswith("decimal"):
        return F.coalesce(c != 0, F.lit(False))
    return c.isNotNull()


def to_column(text: str, schema: dict[str, str]) -> Column:
    """The condition over a frame whose columns (path -> Spark type) are the references; missing ones are an error now."""

    def kind_of(v):
        return "boolean" if isinstance(v, bool) else "double" if isinstance(v, float) else "string" if isinstance(v, str) else "void"

    def build(n: Node) -> tuple[Column, str]:
        if n.kind == "lit":
            return F.lit(n.value), kind_of(n.value)
        if n.kind == "ref":
            if n.value not in schema:
                raise ExprError(f"nothing at {n.value!r}")
            return F.col(n.value), schema[n.value]
        if n.kind == "not":
            return ~truthy_column(*build(n.parts[0])), "boolean"
        if n.kind in ("or", "and"):
            a, b = (truthy_column(*build(p)) for p in n.parts)
            return (a | b if n.kind == "or" else a & b), "boolean"
        (a, ka), (b, kb) = (build(p) for p in n.parts)
        text_like = lambda k: k in ("string", "boolean", "void")
        if not text_like(ka) and not text_like(kb):
            a, b = a.cast("double"), b.cast("double")
            c = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[n.value]
            same = F.coalesce(c, F.lit(n.value == "!=") & ~(a.isNull() & b.isNull()))
            return same, "boolean"
        if n.value not in ("==", "!="):
            raise ExprError(f"{ka} and {kb} have no order")
        same = a.eqNullSafe(b) if ka == kb or "void" in (ka, kb) else F.lit(False)
        return (same if n.value == "==" else ~same), "boolean"

    return truthy_column(*build(parse(text)))


def substitute(value, lookup, display=None):
    """References replaced in a JSON-like value: a whole one by its value, one inside text by its display."""
    if isinstance(value, dict):
        return {k: substitute(v, lookup, display) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute(v, lookup, display) for v in value]
    if not isinstance(value, str):
        return value
    path = whole(value)
    if path is not None:
        return lookup(path)
    return REFERENCE.sub(lambda m: (display or show)(lookup(m[1].strip())), value)


def show(v) -> str:
    """Strings as they are, quantities as `value unit`, the rest as JSON."""
    import json

    if isinstance(v, str):
        return v
    if isinstance(v, dict) and set(v) >= {"value", "unit"}:
        return f"{show(v['value'])} {show(v['unit'])}"
    return json.dumps(v, separators=(",", ":"))
