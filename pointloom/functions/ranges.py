"""Range lists such as ``Z[0:10),Classification![2:2]``."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGE = re.compile(r"\s*([A-Za-z_]\w*)\s*(!?)\s*([\[(])\s*([-+.\deE]*)\s*:\s*([-+.\deE]*)\s*([\])])\s*")


@dataclass(frozen=True)
class Range:
    dimension: str
    negate: bool
    low: float | None
    high: float | None
    low_closed: bool
    high_closed: bool

    def column(self, of: Column | None = None) -> Column:
        """NaN is inside no range, so a negated range passes it."""
        c = (F.col(f"`{self.dimension}`") if of is None else of).cast("double")
        inside = ~F.isnan(c)
        if self.low is not None:
            inside = inside & (c >= self.low if self.low_closed else c > self.low)
        if self.high is not None:
            inside = inside & (c <= self.high if self.high_closed else c < self.high)
        return ~inside if self.negate else inside


def parse_one(text: str) -> Range:
    m = _RANGE.fullmatch(text)
    if not m:
        raise ValueError(f"not a range: {text!r}")
    low, high = (float(x) if x else None for x in (m[4], m[5]))
    return Range(m[1], bool(m[2]), low, high, m[3] == "[", m[6] == "]")


def parse(text: str | list[str]) -> list[Range]:
    parts = text if isinstance(text, list) else re.split(r",(?=\s*[A-Za-z_])", text)
    return [parse_one(p) for p in parts]


def condition(ranges: str | list) -> Column:
    """Ranges of one dimension are alternatives; different dimensions must all hold."""
    parsed = [r if isinstance(r, Range) else parse_one(r) for r in ranges] if isinstance(ranges, list) else parse(ranges)
    by: dict[str, list[Column]] = {}
    for r in parsed:
        by.setdefault(r.dimension, []).append(r.column())
    return reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, c) for _, c in sorted(by.items())))
