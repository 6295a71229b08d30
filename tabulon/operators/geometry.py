"""Tables from placed text: objects (page, x0, y0, x1, y1, text) become lines
and columns by grouping the intervals that they cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intersects(a0: Column, a1: Column, b0: Column, b1: Column, slack: float = 0.0) -> Column:
    return (a0 - slack < b1) & (b0 < a1 + slack)


def contains_centre(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    centre = (b0 + b1) / 2
    return (a0 < centre) & (centre < a1)


def contains(a0: Column, a1: Column, b0: Column, b1: Column, slack: float = 0.0) -> Column:
    return (a0 - slack <= b0) & (b1 <= a1 + slack)


def threshold(objects: DataFrame, axis: str, share: float = 0.3) -> float:
    """A share of the mean height, or of the mean width of a character."""
    x = F.col("y1") - F.col("y0") if axis == "y" else (F.col("x1") - F.col("x0")) / F.greatest(F.length("text"), F.lit(1))
    return share * (objects.agg(F.avg(x)).first()[0] or 0.0)


def groups(objects: DataFrame, axis: str, slack: float = 0.0, by: tuple[str, ...] = ("page",)) -> DataFrame:
    """With the number of the group, from 0, of intervals that meet; a new one
    begins where an interval starts at or after the end of all before."""
    lo, hi, name = f"{axis}0", f"{axis}1", f"{axis}_group"
    w = Window.partitionBy(*by).orderBy(lo, hi)
    before = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = objects.withColumn("__new", F.when(before.isNull() | (F.col(lo) >= before + slack), 1).otherwise(0))
    return out.withColumn(name, (F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long")).drop("__new")


def _lines(objects: DataFrame, slack: float = 0.0) -> DataFrame:
    """Objects in lines of the usual width: mode plus or minus the deviation."""
    g = groups(objects, "y", slack)
    width = g.groupBy("page", "y_group").agg((F.max("x1") - F.min("x0")).alias("w"))
    tally = width.groupBy("page", "w").agg(F.count("*").alias("n"), F.min("y_group").alias("f"))
    usual = tally.groupBy("page").agg(F.max_by("w", F.struct("n", -F.col("f"))).alias("mode"))
    usual = usual.join(width.groupBy("page").agg(F.coalesce(F.stddev_samp("w"), F.lit(0.0)).alias("sd")), "page")
    ok = width.join(usual, "page").where(F.abs(F.col("w") - F.col("mode")) <= F.col("sd")).select("page", "y_group")
    return g.join(ok, ["page", "y_group"], "left_semi")


def cells(objects: DataFrame, x_slack: float = 0.0, y_slack: float = 0.0, same_width: bool = False) -> DataFrame:
    """(page, y_group, x_group, text): texts of a cell in order, by lines."""
    o = _lines(objects, y_slack) if same_width else groups(objects, "y", y_slack)
    o = groups(o, "x", x_slack)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))), lambda x: x.text), "\n")
    return o.groupBy("page", "y_group", "x_group").agg(joined.alias("text"))


def by_header(objects: DataFrame) -> DataFrame:
    """Cells by the columns of the first line: an object belongs to the first
    header that it overlaps."""
    g = groups(objects, "y")
    top = g.where("y_group = 0").select("page", F.col("x0").alias("h0"), F.col("x1").alias("h1"))
    top = top.withColumn("x_group", F.row_number().over(Window.partitionBy("page").orderBy("h0")).cast("long") - 1)
    hit = g.join(top, "page").where((F.col("x0") < F.col("h1")) & (F.col("h0") < F.col("x1")))
    keys = ["page", "y_group", "x0", "y0", "x1", "y1", "text"]
    first = hit.groupBy(*keys).agg(F.min("x_group").alias("x_group"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))), lambda x: x.text), "\n")
    return first.groupBy("page", "y_group", "x_group").agg(joined.alias("text"))


def by_boxes(objects: DataFrame, boxes: DataFrame) -> DataFrame:
    """Cells by drawn rectangles: an object belongs to the first box, in order
    of y and x, that holds its centre."""
    b = boxes.distinct().withColumnsRenamed({"x0": "bx0", "y0": "by0", "x1": "bx1", "y1": "by1"})
    hit = objects.join(b, "page").where(contains_centre(F.col("bx0"), F.col("bx1"), F.col("x0"), F.col("x1")) & contains_centre(F.col("by0"), F.col("by1"), F.col("y0"), F.col("y1")))
    keys = ["page", "x0", "y0", "x1", "y1", "text"]
    first = hit.groupBy(*keys).agg(F.min(F.struct("by0", "bx0")).alias("box"))
    w = Window.partitionBy("page")
    first = first.select("*", (F.dense_rank().over(w.orderBy("box.by0")) - 1).cast("long").alias("y_group"), (F.dense_rank().over(w.orderBy("box.bx0")) - 1).cast("long").alias("x_group"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))), lambda x: x.text), "\n")
    return first.groupBy("page", "y_group", "x_group").agg(joined.alias("text"))


ALGORITHMS = {"y-groups": cells, "header-position": by_header, "rects-boundaries": by_boxes}


def between(objects: DataFrame, starts_after: Column | None = None, ends_before: Column | None = None) -> DataFrame:
    """Objects after the first match and before the first match of the end, in
    order of page, y and x.  One order over all pages needs one partition per
    document: add a column ``document`` to process many."""
    by = [c for c in ("document",) if c in objects.columns]
    w = Window.partitionBy(*by or [F.lit(0)]).orderBy("page", "y0", "x0")
    out = objects
    if starts_after is not None:
        seen = F.max(starts_after.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
        out = out.withColumn("__in", seen).where(F.col("__in") == 1).drop("__in")
    if ends_before is not None:
        done = F.max(ends_before.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn("__out", done).where(F.col("__out") == 0).drop("__out")
    return out


def split_lines(objects: DataFrame, share: float = 0.95) -> DataFrame:
    """One object for each line of a text of several."""
    lines = F.split("text", "\n")
    out = objects.withColumn("__n", F.size(lines)).select("*", F.posexplode(lines).alias("__k", "__line"))
    h = (F.col("y1") - F.col("y0")) / F.col("__n")
    return out.withColumns({"text": F.col("__line"), "y1": F.col("y0") + h * F.col("__k") + h * share, "y0": F.col("y0") + h * F.col("__k")}).drop("__n", "__k", "__line")


def page_text(objects: DataFrame) -> DataFrame:
    return objects.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))), lambda x: x.text), "\n").alias("text"))


def nearest(objects: DataFrame, to: DataFrame) -> DataFrame:
    """For each object of ``to`` the other object with the nearest centre on
    its page."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    a = to.select("page", F.col("text").alias("of"), cx.alias("ax"), cy.alias("ay"))
    b = objects.select("page", "text", cx.alias("bx"), cy.alias("by"))
    d = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    pairs = a.join(b, "page").where((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by")))
    return pairs.groupBy("page", "of", "ax", "ay").agg(F.min(F.struct(d.alias("distance"), "text")).alias("x")).select("page", "of", F.col("x.text").alias("text"), F.col("x.distance").alias("distance"))
