"""Running numbers over a whole table without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panolith.session import written


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """`df` with a long column `name` that counts its rows from 0 in the order of the columns.

    The rows are dealt by ranges of the order and written, which fixes who is where; each
    range numbers its own rows, and the sizes of the ranges, one row each, give their starts.
    """
    dealt = written(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    placed = dealt.withColumn("__inside", inside).join(F.broadcast(starts), "__range")
    return placed.withColumn(name, (F.col("__start") + F.col("__inside") - 1).cast("long")).drop("__range", "__inside", "__start")


def quantile(df: DataFrame, value: str, share: float, by: list[str], name: str) -> DataFrame:
    """(by..., name, n): the exact quantile of a column, read between two values, and the number of values; nulls don't count.

    Values fall into 4096 equal parts of their group's range. Counts tell which parts hold the two values
    around the quantile, and only the rows of those are put in order, so no task holds a group.
    """
    parts, keys = 4096, by or ["__all"]
    rows = df.where(F.col(value).isNotNull()).withColumn("__all", F.lit(0)).select(*keys, F.col(value).cast("double").alias("__v"))
    ends = rows.groupBy(*keys).agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.count(F.lit(1)).alias("n"))
    place = F.least(F.floor((F.col("__v") - F.col("__low")) / F.nullif(F.col("__high") - F.col("__low"), F.lit(0.0)) * parts), F.lit(parts - 1))
    dealt = rows.join(ends, keys).withColumn("__part", F.coalesce(place, F.lit(0)))
    counted = dealt.groupBy(*keys, "__part", "n").agg(F.count(F.lit(1)).alias("__m"))
    upto = F.sum("__m").over(Window.partitionBy(*keys).orderBy("__part"))
    at = share * (F.col("n") - 1)
    held = counted.withColumn("__upto", upto).withColumn("__before", F.col("__upto") - F.col("__m")).where((F.col("__before") <= F.ceil(at)) & (F.col("__upto") > F.floor(at)))
    offset = held.groupBy(*keys).agg(F.min("__before").alias("__offset"))
    few = dealt.join(held.select(*keys, "__part"), [*keys, "__part"]).join(offset, keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__v")) - 1 + F.col("__offset")
    few = few.withColumn("__rank", rank).where((F.col("__rank") == F.floor(at)) | (F.col("__rank") == F.ceil(at)))
    low, high = F.min("__v"), F.max("__v")
    return few.groupBy(*keys, "n").agg((low + (high - low) * (F.max(at) - F.floor(F.max(at)))).alias(name)).select(*by, name, "n")
