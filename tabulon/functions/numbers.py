"""Readable numbers and lists of page numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled(n: Column, divider: int = 1000, suffix: str = "", places: int = 2, prefixes: str = "KMGTPEZ") -> Column:
    """1234 as 1.23K; below the divider the number itself."""
    out = F.concat(n.cast("string"), F.lit(suffix)) if suffix else n.cast("string")
    for k, letter in enumerate(prefixes, 1):
        out = F.when(F.abs(n) >= float(divider) ** k, F.format_string(f"%.{places}f{letter}{suffix}", n.cast("double") / float(divider) ** k)).otherwise(out)
    return out


def intervals(text: Column, repeat: bool = False, ordered: bool = True) -> Column:
    """'1,3-5' as [1, 3, 4, 5]."""
    parts = F.filter(F.split(F.replace(text, F.lit(" "), F.lit("")), ","), lambda x: x != "")
    ends = lambda x, k: F.get(F.split(x, "-"), F.lit(k)).cast("int")
    out = F.flatten(F.transform(parts, lambda x: F.when(x.contains("-"), F.sequence(ends(x, 0), ends(x, 1))).otherwise(F.array(x.try_cast("int")))))
    out = out if repeat else F.array_distinct(out)
    return F.array_sort(out) if ordered else out


def items(values: Column, *places: int) -> Column:
    """The values at the places (from 0) of an array; null beyond its end."""
    return F.array(*(F.get(values, F.lit(k)) for k in places))
