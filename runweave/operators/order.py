"""Places of rows in a total order, and joins of points with ranges, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def ranked(rows: DataFrame, order: str, name: str, rows_in_range: int = 4096) -> DataFrame:
    """Adds the place of each row by the BIGINT order, from 0; equal rows get places in any order.

    Rows are counted by ranges of order of equal width; the place is the count of all ranges
    before and the row number within the range. Widths follow the span of order, so a range
    has rows_in_range rows on average; only where order is very uneven do ranges differ.
    """
    edge = rows.agg(F.min(order).alias("a"), F.max(order).alias("b"), F.count("*").alias("n")).first()  # one row
    if not edge.n:
        return rows.withColumn(name, F.lit(0).cast("bigint"))
    width = max(1, -(-(edge.b - edge.a + 1) * rows_in_range // edge.n))
    d = rows.withColumn("_range", F.floor((F.col(order) - edge.a) / width).cast("bigint"))
    counts = d.groupBy("_range").agg(F.count("*").alias("_rows"))
    # a row a range: ranges of ranges keep this sum in many tasks too
    group = F.floor(F.col("_range") / 4096)
    sums = counts.withColumn("_group", group)
    groups = sums.groupBy("_group").agg(F.sum("_rows").alias("_in_group"))
    first = F.coalesce(F.sum("_in_group").over(W.orderBy("_group").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = groups.withColumn("_before_group", first).drop("_in_group")
    within = F.coalesce(F.sum("_rows").over(W.partitionBy("_group").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("_before", within).join(groups, "_group").select("_range", (F.col("_before") + F.col("_before_group")).alias("_before"))
    at = F.row_number().over(W.partitionBy("_range").orderBy(order)) - 1
    return d.withColumn("_at", at).join(sums, "_range").withColumn(name, (F.col("_before") + F.col("_at")).cast("bigint")).drop("_range", "_before", "_at")


def in_ranges(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, buckets: int = 1 << 16) -> DataFrame:
    """points joined with the rows of ranges whose [start, end] holds their BIGINT at: an equi-join on buckets of keys.

    A range that spans up to 64 buckets stands in each of them; a wider one in each bucket of
    a coarser grid, 64 times as wide, and so on. So a range has at most 65 rows and a point
    one for each grid; nothing is compared outside its bucket.
    """
    edge = ranges.agg(F.min(start).alias("a"), F.max(end).alias("b"), F.max(F.col(end) - F.col(start)).alias("w")).first()  # one row
    if edge.a is None:
        return points.join(ranges, F.lit(False))
    width = max(1, -(-(edge.b - edge.a + 1) // buckets))
    grids = [width]
    while grids[-1] * 64 < edge.w:
        grids.append(grids[-1] * 64)
    level = F.lit(0)
    for k, w in enumerate(grids[:-1]):
        level = F.when(F.col(end) - F.col(start) >= w * 64, k + 1).otherwise(level) if k == 0 else F.when(F.col(end) - F.col(start) >= w * 64, F.lit(k + 1)).otherwise(level)
    size = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in grids]), F.col("_grid") + 1)
    place = lambda c, w: F.floor((c - edge.a) / w).cast("bigint")
    r = ranges.where(F.col(start) <= F.col(end)).withColumn("_grid", level.cast("int")).withColumn("_width", size)
    r = r.withColumn("_bucket", F.explode(F.sequence(place(F.col(start), F.col("_width")), place(F.col(end), F.col("_width"))))).drop("_width")
    cells = F.array(*[F.struct(F.lit(k).alias("_grid"), place(F.col(at), w).alias("_bucket")) for k, w in enumerate(grids)])
    p = points.where(F.col(at).between(edge.a, edge.b)).withColumn("_cell", F.explode(cells)).select(*points.columns, "_cell._grid", "_cell._bucket")
    hit: Column = F.col(at).between(F.col(start), F.col(end))
    return p.join(r, ["_grid", "_bucket"]).where(hit).drop("_grid", "_bucket")
