"""Types by elimination: a candidate survives if every value that isn't null
can be parsed.  A few rows refute most candidates; then all values are held
against the first survivor of each column alone, and against the next one only
where it fails, so a value is parsed once or twice rather than by every type."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import DEFAULT, FIELDS, is_null


#: Rows that refute candidates before all rows are read.
FIRST = 1000


def infer(df: DataFrame, candidates: Sequence[str] = DEFAULT, fallback: str = "text", samples: int | None = None, pick: Callable[[list[str]], str] | None = None) -> dict[str, str]:
    """{column: field}: the first candidate that survives, ``fallback`` for a
    column of nulls; columns that aren't text keep their type.  ``pick``
    chooses among the survivors instead."""
    from ..functions.types import field_of

    kinds = dict(df.dtypes)
    df = df if samples is None else df.limit(samples)
    texts = [c for c in df.columns if kinds[c] == "string"]
    left = _survivors(df if pick else df.limit(FIRST), texts, candidates)
    out = {c: field_of(kinds[c]).name for c in df.columns if c not in texts}
    if pick:
        out |= {c: fallback if n is None else pick(n) if n else fallback for c, n in left.items()}
        return {c: out[c] for c in df.columns}
    left = {c: list(candidates) if n is None else n for c, n in left.items()}
    seen: dict[str, bool] = {}
    while open_ := [c for c in texts if c not in out]:
        aggs = []
        for k, c in enumerate(open_):
            x = F.col(f"`{c}`")
            test = left[c][0] if left[c] else "text"
            fits = F.lit(True) if test in ("text", "binary") else F.coalesce(F.bool_and(is_null(x) | FIELDS[test].parse(x).isNotNull()), F.lit(True))
            aggs += [fits.alias(f"fits{k}"), (F.lit(True) if seen.get(c) else F.coalesce(F.bool_or(~is_null(x)), F.lit(False))).alias(f"some{k}")]
        got = df.agg(*aggs).first()
        for k, c in enumerate(open_):
            seen[c] = got[f"some{k}"]
            if not seen[c] or not left[c]:
                out[c] = fallback
            elif got[f"fits{k}"]:
                out[c] = left[c][0]
            else:
                left[c].pop(0)
    return {c: out[c] for c in df.columns}


def _survivors(df: DataFrame, texts: list[str], candidates: Sequence[str]) -> dict[str, list[str] | None]:
    """The candidates that all values of each column fit; None: only nulls."""
    tests = [n for n in candidates if n not in ("text", "binary")]
    # one number a value: bit k says that it fits candidate k, the top bit that
    # it is null; a null fits all.  One AND a column is all that is aggregated.
    top, aggs = len(tests), []
    for c in texts:
        x = F.col(f"`{c}`")
        fits = [F.when(FIELDS[n].parse(x).isNotNull(), 1 << k).otherwise(0) for k, n in enumerate(tests)]
        aggs.append(F.bit_and(F.when(is_null(x), (1 << top + 1) - 1).otherwise(sum(fits[1:], fits[0]) if fits else F.lit(0))).alias(c))
    found = df.agg(*aggs).first() if aggs else []
    masks = dict(zip(texts, found))
    return {c: None if m is None or m >> top else [n for n in candidates if n in ("text", "binary") or m >> tests.index(n) & 1] for c, m in masks.items()}


def typed(df: DataFrame, types: dict[str, str] | None = None, strict: bool = True, **how) -> DataFrame:
    """Text columns parsed as their fields (inferred where not given).  A value
    that doesn't fit raises, or is null where not strict.  The field's name is
    kept in the column's metadata."""
    types = {**infer(df.select(*(f"`{c}`" for c in df.columns if c not in (types or {}))), **how), **(types or {})}
    kinds, cols = dict(df.dtypes), []
    for c in df.columns:
        x, f = F.col(f"`{c}`"), FIELDS[types[c]]
        if kinds[c] == "string" and f.name != "text":
            value = f.parse(x)
            if strict:
                value = F.when(is_null(x) | value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit("Value '"), F.substring(x, 1, 50), F.lit(f"' can't be {f.name}"))).cast(f.spark))
            x = value
        cols.append(x.alias(c, metadata={"field": f.name}))
    return df.select(*cols)


def shown(df: DataFrame) -> DataFrame:
    """Every value as text, by its field."""
    from ..functions.types import field_of

    return df.select(*(FIELDS.get(f.metadata.get("field") or "", field_of(f.dataType.simpleString())).show(F.col(f"`{f.name}`")).alias(f.name) for f in df.schema))
