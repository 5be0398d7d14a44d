"""Row numbers in a total order without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import materialise


def number_rows(df: DataFrame, order: list[Column], name: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds name, 1 to n: ranges are sorted apart, and each row adds its place to the sizes of the ranges before its own.

    drop: columns that the order alone needs; sorted rows are written without them.
    """
    ranged = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).drop(*drop).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("__at", 33)
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    placed = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranged.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(name, placed).drop("__at", "__part", "__before")
