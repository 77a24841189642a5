"""Pixels of several photos on one canvas, as rows (image_id, x, y, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ownership(depths: DataFrame, at=("x", "y"), image: str = "image_id", depth: str = "depth") -> DataFrame:
    """(x, y, image_id): the photo with the largest depth at each place; ties to the least id.

    Depths of 0 or less own nothing. A grouped maximum, so each task combines before the shuffle.
    """
    owned = depths.where(F.col(depth) > 0)
    return owned.groupBy(*at).agg(F.max_by(F.col(image), F.struct(F.col(depth), -F.col(image))).alias(image))


def pasted(pixels: DataFrame, at=("x", "y"), values=("b", "g", "r")) -> DataFrame:
    """The last photo's pixel at each place."""
    top = pixels.groupBy(*at).agg(F.max_by(F.struct(*values), F.col("image_id")).alias("v"))
    return top.select(*at, *[F.col(f"v.{c}").alias(c) for c in values])


def weighted_mean(pixels: DataFrame, weight: str = "weight", at=("x", "y"), values=("b", "g", "r")) -> DataFrame:
    """Weighted mean of each place; weights under 1e-3 in all count 1e-3."""
    total = F.greatest(F.sum(weight), F.lit(1e-3))
    return pixels.groupBy(*at).agg(*[(F.sum(F.col(c) * F.col(weight)) / total).alias(c) for c in values])


def feathered(pixels: DataFrame, sharpness: float = 0.02, at=("x", "y"), values=("b", "g", "r")) -> DataFrame:
    """Blend by the distance to each photo's edge (column depth), up to 1 / sharpness pixels."""
    w = pixels.withColumn("weight", F.least(F.lit(1.0), F.greatest(F.col("depth") * sharpness, F.lit(0.0))))
    return weighted_mean(w.where("weight > 0"), "weight", at, values)


def masked(pixels: DataFrame, mask: DataFrame, on=("image_id", "x", "y")) -> DataFrame:
    """The pixels that the mask has too."""
    return pixels.join(mask, list(on), "left_semi")


def painted_over(base: DataFrame, top: DataFrame, at=("x", "y")) -> DataFrame:
    """`top` where it has pixels, else `base`."""
    return base.join(top, list(at), "left_anti").unionByName(top)


def bilinear(points: DataFrame, pixels: DataFrame, values=("b", "g", "r")) -> DataFrame:
    """`points` (point_id, image_id, px, py) with values read between the four pixels around.

    An equi-join of each point's four neighbours; places outside the photo read its border.
    """
    size = pixels.groupBy("image_id").agg(F.max("x").alias("__mx"), F.max("y").alias("__my"))
    p = points.join(size, "image_id")
    p = p.withColumns({"__px": F.least(F.greatest("px", F.lit(0.0)), "__mx"), "__py": F.least(F.greatest("py", F.lit(0.0)), "__my")})
    fx, fy = F.col("__px") - F.floor("__px"), F.col("__py") - F.floor("__py")
    corner = lambda i, j, w: F.struct(
        F.least(F.floor("__px") + i, "__mx").cast("int").alias("x"), F.least(F.floor("__py") + j, "__my").cast("int").alias("y"), w.alias("__w")
    )
    corners = F.array(corner(0, 0, (1 - fx) * (1 - fy)), corner(1, 0, fx * (1 - fy)), corner(0, 1, (1 - fx) * fy), corner(1, 1, fx * fy))
    near = p.withColumn("__c", F.explode(corners)).select("point_id", "image_id", "__c.x", "__c.y", "__c.__w").where("__w > 0")
    read = near.join(pixels, ["image_id", "x", "y"])
    return points.join(read.groupBy("point_id").agg(*[F.sum(F.col(c) * F.col("__w")).alias(c) for c in values]), "point_id")


def neighbour_distance(points: DataFrame, by: list[str]) -> DataFrame:
    """Distances between a place's source coordinates and those one column on, where both are there."""
    here, there = points.alias("p"), points.withColumn("gx", F.col("gx") - 1).alias("q")
    both = here.join(there, [*by, "gx", "gy"])
    dx, dy = F.col("q.px") - F.col("p.px"), F.col("q.py") - F.col("p.py")
    return both.select(*by, "gx", "gy", F.sqrt(dx * dx + dy * dy).alias("step"))


def monotone_prefix(samples: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """The samples before the first one that is under an earlier one."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(order)
    df = samples.withColumn("__low", (F.col(value) < F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("int"))
    df = df.withColumn("__seen", F.max("__low").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.where(F.coalesce("__seen", F.lit(0)) == 0).drop("__low", "__seen")


def curve_penalties(samples: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Adds rise (first difference above 0) and bend (second difference) of each curve."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(order)
    before, earlier = F.lag(value).over(w), F.lag(value, 2).over(w)
    return samples.withColumns({"rise": F.greatest(F.col(value) - before, F.lit(0.0)), "bend": F.col(value) - 2 * before + earlier})
