"""Structured predicates: a JSON object {column: {operator: operand}} becomes one Column; all columns must hold."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_PREDICATES, MAX_VALUES = 32, 4096
_RANGE = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}


class FilterError(ValueError):
    """The filter is not well formed, or an operand does not fit its column."""


def _literal(value, kind: T.DataType) -> Column:
    if isinstance(value, (list, dict)):
        raise FilterError("an operand is a single value")
    numeric = isinstance(kind, T.NumericType)
    if numeric and isinstance(value, str):
        try:
            float(value)
        except ValueError:
            raise FilterError(f"{value!r} is not a number") from None
    if isinstance(kind, T.StringType) and not isinstance(value, str):
        raise FilterError(f"{value!r} is not text")
    return F.lit(value).cast(kind)


def predicate(df: DataFrame, spec: dict | str) -> Column:
    """The Column of a filter over df's columns; unknown columns and operators, and operands that do not fit, are errors."""
    spec = json.loads(spec) if isinstance(spec, str) else spec
    if not isinstance(spec, dict) or not spec:
        raise FilterError("a filter is an object with one column at least")
    if len(spec) > MAX_PREDICATES:
        raise FilterError(f"more than {MAX_PREDICATES} predicates")
    parts = []
    for name, test in spec.items():
        if name not in df.columns:
            raise FilterError(f"no column {name!r}")
        if not isinstance(test, dict) or len(test) != 1:
            raise FilterError("a column has exactly one operator")
        ((op, value),) = test.items()
        parts.append(F.coalesce(_one(F.col(name), df.schema[name].dataType, op, value), F.lit(False)))
    return reduce(Column.__and__, parts)


def equalities(spec: dict, columns: list[str]) -> dict[str, list] | None:
    """{column: values} where a filter asks for values of these columns alone (eq, in, overlap); else None."""
    out: dict[str, list] = {}
    for name, test in spec.items():
        ((op, value),) = test.items()
        if name not in columns or op not in ("eq", "in", "overlap") or op == "eq" and (value is None or isinstance(value, (list, dict))):
            return None
        out[name] = [value] if op == "eq" else list(value)
    return out


def _many(value) -> list:
    if not isinstance(value, list):
        raise FilterError("the operand is a list")
    if len(value) > MAX_VALUES:
        raise FilterError(f"more than {MAX_VALUES} values")
    return value


def _one(c: Column, kind: T.DataType, op: str, value) -> Column:
    array = isinstance(kind, T.ArrayType)
    text = isinstance(kind.elementType if array else kind, T.StringType)
    if op == "eq":
        return c.isNull() if value is None else c == _literal(value, kind)
    if op == "in":
        values = [_literal(v, kind) for v in _many(value) if v is not None]
        return c.isin(*values) if values else F.lit(False)
    if op == "overlap":
        if not array:
            raise FilterError("overlap is for array columns")
        values = [_literal(v, kind.elementType) for v in _many(value)]
        return F.arrays_overlap(c, F.array(*values)) if values else F.lit(False)
    if op in ("ilike", "ilike_any"):
        if not text:
            raise FilterError("ilike is for text")
        patterns = _many(value) if op == "ilike_any" else [value]
        if not all(isinstance(p, str) for p in patterns):
            raise FilterError("a pattern is text")
        one = lambda x: reduce(Column.__or__, [x.ilike(p) for p in patterns], F.lit(False))
        return F.exists(c, one) if array else one(c)
    if op == "range":
        if not isinstance(value, dict) or not value or set(value) - set(_RANGE) or None in value.values():
            raise FilterError("a range has bounds gt, gte, lt or lte")
        return reduce(Column.__and__, [getattr(c, _RANGE[k])(_literal(v, kind)) for k, v in value.items()])
    raise FilterError(f"no operator {op!r}")
