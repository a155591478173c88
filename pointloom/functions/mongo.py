"""JSON predicates with $and, $or, $nor, $not and comparison operators, compiled to one column."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expr import compare

_COMPARE = {"$eq": "==", "$ne": "!=", "$gt": ">", "$gte": ">=", "$lt": "<", "$lte": "<="}


def _operand(df: DataFrame, x) -> Column:
    if isinstance(x, str):
        if x not in df.columns:
            raise ValueError(f"no dimension {x!r}")
        return F.col(f"`{x}`").cast("double")
    return F.lit(float(x))


def _dimension(df: DataFrame, name: str, test) -> Column:
    c = _operand(df, name)
    if not isinstance(test, dict):
        return compare("==", c, _operand(df, test))
    parts = []
    for op, x in test.items():
        if op in _COMPARE:
            parts.append(compare(_COMPARE[op], c, _operand(df, x)))
        elif op in ("$in", "$nin"):
            any_ = reduce(lambda a, b: a | b, (compare("==", c, _operand(df, v)) for v in x), F.lit(False))
            parts.append(any_ if op == "$in" else ~any_)
        elif op == "$not":
            parts.append(~_dimension(df, name, x))
        else:
            raise ValueError(f"unknown operator {op!r}")
    return reduce(lambda a, b: a & b, parts)


def condition(df: DataFrame, expression: str | dict) -> Column:
    tree = json.loads(expression) if isinstance(expression, str) else expression
    parts = []
    for key, x in tree.items():
        if key in ("$and", "$or", "$nor"):
            inner = [condition(df, e) for e in x]
            all_ = reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), inner)
            parts.append(~all_ if key == "$nor" else all_)
        elif key == "$not":
            parts.append(~condition(df, x))
        else:
            parts.append(_dimension(df, key, x))
    return reduce(lambda a, b: a & b, parts, F.lit(True))
