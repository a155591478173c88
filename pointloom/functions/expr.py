"""Arithmetic, comparison and assignment expressions over dimensions, compiled to columns.

All arithmetic is in double. Division by zero gives NaN, comparisons are those
of IEEE (NaN equals nothing), logarithms of what has none give NaN or minus infinity.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import checked, declared_type, standard_name

NAN, LOWEST, HIGHEST = float("nan"), -1.7976931348623157e308, 1.7976931348623157e308


class ExpressionError(ValueError):
    pass


_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|(==|!=|<=|>=|&&|\|\||[-+*/()<>!=]))")


def tokens_of(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at:].strip()[:10]!r} in {text!r}")
        kind = ("number", "name", "sign")[m.lastindex - 1]
        if kind == "sign" and m[3] == "-" and out and out[-1] == ("sign", "-"):
            raise ExpressionError(f"'--' in {text!r}")
        out.append((kind, m[m.lastindex]))
        at = m.end()
    return out


def _log(base: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(x > 0, base(x)).when(x == 0, F.lit(float("-inf"))).otherwise(F.lit(NAN))


MATH: dict[str, Callable[[Column], Column]] = {
    "floor": lambda x: F.when(F.isnan(x), x).otherwise(F.floor(x).cast("double")),
    "ceil": lambda x: F.when(F.isnan(x), x).otherwise(F.ceil(x).cast("double")),
    "round": lambda x: F.round(x, 0), "abs": F.abs, "fabs": F.abs, "sqrt": F.sqrt,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh,
    "log": _log(F.log), "log2": _log(F.log2), "log10": _log(F.log10), "exp": F.exp, "exp2": lambda x: F.pow(F.lit(2.0), x),
}
CONSTANTS = {"nan": NAN, "lowest": LOWEST, "highest": HIGHEST}
TESTS: dict[str, Callable[[Column], Column]] = {"isnan": F.isnan, "ismax": lambda x: x == F.lit(HIGHEST), "ismin": lambda x: x == F.lit(LOWEST)}


@dataclass
class Node:
    """A value (double) or a condition, with its constant where it has one."""

    column: Column
    boolean: bool = False
    constant: float | None = None


def compare(op: str, a: Column, b: Column) -> Column:
    """IEEE comparison of doubles."""
    known = ~F.isnan(a) & ~F.isnan(b)
    if op == "!=":
        return ~known | (a != b)
    return known & {"==": a == b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(NAN))


_LEVELS = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "*": 5, "/": 5}


class Parser:
    """Precedence climbing over the tokens of one expression."""

    def __init__(self, text: str, resolve: Callable[[str], Column]):
        self.text, self.resolve = text, resolve
        self.tokens, self.at = tokens_of(text), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        t = self.peek()
        if value is not None and t[1] != value:
            raise ExpressionError(f"expected {value!r}, found {t[1]!r} in {self.text!r}")
        self.at += 1
        return t

    def whole(self) -> Node:
        node = self.level(1)
        if self.peek()[0] != "end":
            raise ExpressionError(f"unexpected {self.peek()[1]!r} in {self.text!r}")
        return node

    def level(self, least: int) -> Node:
        left = self.unary()
        compared = False
        while (op := self.peek()[1]) in _LEVELS and self.peek()[0] == "sign" and _LEVELS[op] >= least:
            n = _LEVELS[op]
            if n == 3 and compared:
                raise ExpressionError(f"comparisons cannot be chained in {self.text!r}")
            self.take()
            left = self.join(op, left, self.level(n + 1))
            compared = n == 3
        return left

    def join(self, op: str, a: Node, b: Node) -> Node:
        if op in ("&&", "||"):
            if not (a.boolean and b.boolean):
                raise ExpressionError(f"{op} joins conditions only, in {self.text!r}")
            return Node(a.column & b.column if op == "&&" else a.column | b.column, True)
        if a.boolean or b.boolean:
            raise ExpressionError(f"{op} takes values, not conditions, in {self.text!r}")
        if _LEVELS[op] == 3:
            return Node(compare(op, a.column, b.column), True)
        known = a.constant is not None and b.constant is not None
        if op == "/":
            if known and b.constant == 0:
                raise ExpressionError(f"division by a constant zero in {self.text!r}")
            value = a.constant / b.constant if known else None
            return Node(divide(a.column, b.column) if value is None else F.lit(value), constant=value)
        value = {"+": float.__add__, "-": float.__sub__, "*": float.__mul__}[op](a.constant, b.constant) if known else None
        column = {"+": a.column + b.column, "-": a.column - b.column, "*": a.column * b.column}[op]
        return Node(column if value is None else F.lit(value), constant=value)

    def unary(self) -> Node:
        kind, value = self.peek()
        if value == "!" and kind == "sign":
            self.take()
            node = self.unary()
            if not node.boolean:
                raise ExpressionError(f"'!' takes a condition in {self.text!r}")
            return Node(~node.column, True)
        if value == "-" and kind == "sign":
            self.take()
            node = self.unary()
            if node.boolean:
                raise ExpressionError(f"'-' takes a value in {self.text!r}")
            return Node(-node.column, constant=None if node.constant is None else -node.constant)
        if value == "(":
            self.take()
            node = self.level(1)
            self.take(")")
            return node
        if kind == "number":
            self.take()
            return Node(F.lit(float(value)), constant=float(value))
        if kind == "name":
            self.take()
            if self.peek()[1] == "(":
                return self.call(value)
            return Node(self.resolve(value).cast("double"))
        raise ExpressionError(f"unexpected {value or 'end'!r} in {self.text!r}")

    def call(self, name: str) -> Node:
        self.take("(")
        if name in CONSTANTS:
            self.take(")")
            return Node(F.lit(CONSTANTS[name]), constant=CONSTANTS[name] if not math.isnan(CONSTANTS[name]) else None)
        if name not in MATH and name not in TESTS:
            raise ExpressionError(f"unknown function {name!r} in {self.text!r}")
        x = self.level(4)
        self.take(")")
        if x.boolean:
            raise ExpressionError(f"{name} takes a value in {self.text!r}")
        return Node(TESTS[name](x.column), True) if name in TESTS else Node(MATH[name](x.column))


def _resolver(df: DataFrame) -> Callable[[str], Column]:
    names = set(df.columns)

    def resolve(name: str) -> Column:
        own = name if name in names else standard_name(name)
        if own not in names:
            raise ExpressionError(f"no dimension {name!r}")
        return F.col(f"`{own}`")

    return resolve


def value(df: DataFrame, text: str) -> Column:
    node = Parser(text, _resolver(df)).whole()
    if node.boolean:
        raise ExpressionError(f"{text!r} is a condition")
    return node.column


def condition(df: DataFrame, text: str) -> Column:
    node = Parser(text, _resolver(df)).whole()
    if not node.boolean:
        raise ExpressionError(f"{text!r} is a value")
    return node.column


_ASSIGN = re.compile(r"^\s*([A-Za-z_]\w*)\s*=(?!=)\s*(.*?)(?:\s+WHERE\s+(.*))?$", re.IGNORECASE | re.DOTALL)


def assign(df: DataFrame, statement: str, also: Column | None = None) -> DataFrame:
    """Apply ``Dim = value [WHERE condition]``; an unknown dimension is made as a double of 0."""
    m = _ASSIGN.match(statement)
    if not m:
        raise ExpressionError(f"not an assignment: {statement!r}")
    name = m[1] if m[1] in df.columns else standard_name(m[1])
    kind = declared_type(df, name) if name in df.columns else "double"
    new = checked(value(df, m[2]), kind, name)
    old = F.col(f"`{name}`") if name in df.columns else F.lit(0.0)
    where = condition(df, m[3]) if m[3] else None
    if also is not None:
        where = also if where is None else where & also
    return df.withColumn(name, new if where is None else F.when(where, new).otherwise(old))
