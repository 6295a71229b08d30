"""Column names: slugs, unique names and headers."""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ALLOWED = frozenset(string.ascii_letters + string.digits + "_")


def slug(text: str, separator: str = "_", allowed: Iterable[str] = ALLOWED) -> str:
    """ASCII, lower case, words joined by ``separator``."""
    text = unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode()
    keep = {*allowed, separator}
    text = "".join(c for c in re.sub(r"(\w\b)", rf"\1{separator}", text) if c in keep).lower()
    return re.sub(re.escape(separator) + "+", separator, text).strip(separator)


def camel_to_snake(text: str) -> str:
    return slug(re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", re.sub(r"(.)([A-Z][a-z]+)", r"\1_\2", text)))


def unique_name(name: str, taken: Iterable[str], pattern: str = "{name}_{index}", start: int = 2, longest: int | None = None) -> str:
    taken, found, k = set(taken), name[:longest], start
    while found in taken:
        found, k = pattern.format(name=name, index=k), k + 1
        if longest and len(found) > longest:
            over = len(found) - longest
            found = pattern.format(name=name[:-over], index=k - 1)
    return found


def header(names: Iterable[str | None], longest: int | None = None, prefix: str = "field_") -> list[str]:
    """Names as unique slugs; an empty one is numbered, one that begins with a
    digit gets the prefix."""
    out: list[str] = []
    for k, name in enumerate(names):
        name = slug(str(name)) if name is not None else ""
        name = name or f"{prefix}{k}"
        name = prefix + name if name[0].isdigit() else name
        out.append(unique_name(name, out, longest=longest))
    return out


def slugged(column: Column, separator: str = "_") -> Column:
    """The slug of text in ASCII; letters with marks need ``slugged_any``."""
    x = F.regexp_replace(column, r"(\w\b)", f"$1{separator}")
    x = F.lower(F.regexp_replace(x, f"[^A-Za-z0-9_{re.escape(separator)}]", ""))
    return F.regexp_replace(F.regexp_replace(x, f"{re.escape(separator)}+", separator), f"^{re.escape(separator)}|{re.escape(separator)}$", "")


def slugged_any(column: Column) -> Column:
    """The slug of any text; marks of letters are dropped by Python."""

    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda x: None if x is None else slug(x))

    return F.pandas_udf(run, "string")(column)


def snaked(column: Column) -> Column:
    return slugged(F.regexp_replace(F.regexp_replace(column, "(.)([A-Z][a-z]+)", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))
