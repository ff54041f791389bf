"""Metadata filters: dictionaries and trees to Column predicates.

Two policies for missing fields are kept: in the record API every operator is false on a missing field, even ``$neq``; in the query language
``!=`` alone is true on one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS: dict[str, Callable[[Column, object], Column]] = {
    "$eq": lambda c, v: c == F.lit(v),
    "$neq": lambda c, v: c != F.lit(v),
    "$gt": lambda c, v: c > F.lit(v),
    "$gte": lambda c, v: c >= F.lit(v),
    "$lt": lambda c, v: c < F.lit(v),
    "$lte": lambda c, v: c <= F.lit(v),
}
SYMBOLS = {"=": "$eq", "!=": "$neq", ">": "$gt", ">=": "$gte", "<": "$lt", "<=": "$lte", "==": "$eq"}


def _comparable(df: DataFrame, name: str, value: object) -> bool:
    """Text compares with text, numbers with numbers, booleans with booleans; anything else is a mismatch, which is false."""
    kind = dict(df.dtypes).get(name, "")
    if isinstance(value, bool):
        return kind == "boolean"
    if isinstance(value, (int, float)):
        return kind.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"))
    if isinstance(value, str):
        return kind in ("string", "timestamp", "date")
    return value is None


def compare(df: DataFrame, name: str, op: str, value: object) -> Column:
    """One record-API comparison; list columns match if any element does."""
    op = SYMBOLS.get(op, op)
    if op not in OPS:
        raise ValueError(f"unknown operator {op}")
    kind = dict(df.dtypes).get(name)
    if kind is None:
        return F.lit(False)
    if kind.startswith("array<"):
        return F.coalesce(F.exists(F.col(name), lambda x: OPS[op](x, value)), F.lit(False))
    if not _comparable(df, name, value):
        return F.lit(False)
    if value is None:
        return F.col(name).isNull() if op == "$eq" else F.col(name).isNotNull() if op == "$neq" else F.lit(False)
    return F.coalesce(OPS[op](F.col(name), value), F.lit(False))


def matches(df: DataFrame, spec: Mapping[str, object]) -> Column:
    """``{"a": 1, "b": {"$gte": 2, "$lt": 5}}``: all must hold."""
    parts = []
    for name, want in spec.items():
        for op, value in want.items() if isinstance(want, Mapping) else [("$eq", want)]:
            parts.append(compare(df, name, op, value))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def parsed(text: str) -> dict:
    """A filter written in JSON; values may be text, numbers or booleans."""
    spec = json.loads(text)
    if not isinstance(spec, dict):
        raise ValueError("a filter is an object")
    for want in spec.values():
        for v in want.values() if isinstance(want, dict) else [want]:
            if not isinstance(v, (str, int, float, bool)):
                raise ValueError(f"unsupported filter value {v!r}")
    return spec


def tree(df: DataFrame, node: Mapping) -> Column:
    """Trees of adapters: ``{"operator": "AND" | "OR" | "NOT", "conditions": [...]}`` over ``{"field", "operator", "value"}`` with ``in`` and ``not in``."""
    op = str(node["operator"])
    if op.upper() in ("AND", "OR", "NOT"):
        parts = [tree(df, x) for x in node["conditions"]]
        if op.upper() == "NOT":
            return ~reduce(lambda a, b: a & b, parts, F.lit(True))
        return reduce((lambda a, b: a & b) if op.upper() == "AND" else (lambda a, b: a | b), parts, F.lit(op.upper() == "AND"))
    name, value = str(node["field"]).removeprefix("meta."), node.get("value")
    if op in ("in", "not in"):
        inside = F.coalesce(F.col(name).isin(*value), F.lit(False)) if name in df.columns else F.lit(False)
        return inside if op == "in" else ~inside
    return compare(df, name, op, value)


def language_compare(name: str, op: str, value: object, df: DataFrame) -> Column:
    """One comparison of the query language: a missing field is different from everything, else unequal to nothing."""
    if name not in df.columns:
        return F.lit(op == "!=")
    c = F.col(f"`{name}`")
    if value is None:
        return c.isNull() if op == "=" else c.isNotNull() if op == "!=" else F.lit(False)
    if not _comparable(df, name, value):
        return c.isNull() if op == "!=" else F.lit(False)
    hit = F.coalesce(OPS[SYMBOLS[op]](c, value), F.lit(False))
    return hit | c.isNull() if op == "!=" else hit
