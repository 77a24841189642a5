"""Control points: filters, edits, errors, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panolith.operators.graph import connected_components
from panolith.operators.order import numbered
from panolith.schema import LINE_KINDS, PAIR_KINDS


def pair_points(points: DataFrame) -> DataFrame:
    return points.where(F.col("enabled") & F.col("kind").isin(*PAIR_KINDS))


def line_points(points: DataFrame) -> DataFrame:
    return points.where(F.col("enabled") & F.col("kind").isin(*LINE_KINDS))


def of_pair(points: DataFrame, a: int, b: int) -> DataFrame:
    """The points between images a and b in either direction, with their index."""
    return points.where((F.least("img_a", "img_b") == min(a, b)) & (F.greatest("img_a", "img_b") == max(a, b)))


def distinct_pairs(points: DataFrame) -> DataFrame:
    """(img_a, img_b), smaller first, of enabled points between different images."""
    both = points.where(F.col("enabled") & (F.col("img_a") != F.col("img_b")))
    return both.select(F.least("img_a", "img_b").alias("img_a"), F.greatest("img_a", "img_b").alias("img_b")).distinct()


def add_points(points: DataFrame, new: DataFrame) -> DataFrame:
    """`new` after `points`, with indexes that go on from the largest one."""
    last = points.agg(F.coalesce(F.max("cp_index"), F.lit(-1)).alias("__last"))
    counted = numbered(new.drop("cp_index"), ["img_a", "img_b", "xa", "ya", "xb", "yb"], "__n")
    placed = counted.join(F.broadcast(last)).withColumn("cp_index", F.col("__last") + 1 + F.col("__n")).drop("__n", "__last")
    return points.unionByName(placed, allowMissingColumns=True)


def patch_point(points: DataFrame, index: int, **values) -> DataFrame:
    """The point of an index with new enabled, weight, xa, ya, xb or yb."""
    here = F.col("cp_index") == index
    return points.withColumns({k: F.when(here, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})


def delete_point(points: DataFrame, index: int) -> DataFrame:
    """Without the point of an index; later indexes move up by one."""
    left = points.where(F.col("cp_index") != index)
    return left.withColumn("cp_index", F.col("cp_index") - (F.col("cp_index") > index).cast("long"))


def merge_points(old: DataFrame, found: DataFrame) -> DataFrame:
    """The points of `old` that were not found automatically, then `found`."""
    return add_points(old.where(F.col("kind") != "auto"), found)


def prune(points: DataFrame, threshold: float | None = None, by: list[str] | None = None) -> DataFrame:
    """`points` with those disabled whose error is over the threshold.

    Without one it is 3 times the root mean square of the enabled points' positive errors,
    and at least 3 pixels; `by` takes it per group. Without positive errors nothing changes.
    """
    if threshold is not None:
        limit = points.withColumn("__limit", F.lit(float(threshold)))
    else:
        counted = F.when(F.col("enabled") & (F.col("error") > 0), F.col("error") * F.col("error"))
        rms = points.groupBy(*(by or [])).agg(F.greatest(F.lit(3.0), 3 * F.sqrt(F.avg(counted))).alias("__limit"), F.count(counted).alias("__n"))
        rms = rms.select(*(by or []), F.when(F.col("__n") > 0, F.col("__limit")).alias("__limit"))
        limit = points.join(rms, by) if by else points.join(F.broadcast(rms))
    keep = F.coalesce(F.col("error") <= F.col("__limit"), F.lit(True))
    return limit.withColumn("enabled", F.col("enabled") & keep).drop("__limit")


def residual_class(error: Column) -> Column:
    return F.when(error > 12, "bad").when(error > 5, "mid").otherwise("good")


def rms_class(rms: Column) -> Column:
    return F.when(rms < 5, "good").when(rms < 12, "warn").otherwise("bad")


def accepted_suggestion(score: Column) -> Column:
    return score >= 0.45


def pair_summary(points: DataFrame) -> DataFrame:
    """(img_a, img_b, n, rms, max_error) per unordered pair over enabled points with an error."""
    used = points.where(F.col("enabled") & (F.col("error") > 0))
    return used.groupBy(F.least("img_a", "img_b").alias("img_a"), F.greatest("img_a", "img_b").alias("img_b")).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rms"), F.max("error").alias("max_error")
    )


def by_error(points: DataFrame) -> DataFrame:
    """`points` with `place`, from 0, in the order of their errors, largest first; points without one come last."""
    keyed = points.withColumns({"__less": -F.coalesce("error", F.lit(float("-inf"))), "__index": F.col("cp_index")})
    return numbered(keyed, ["__less", "__index"], "place").drop("__less", "__index")


def by_image(points: DataFrame) -> DataFrame:
    """(image_id, cp_index, x, y, side): both sides of each point, one row each."""
    side = lambda p: F.struct(F.col(f"img_{p}").alias("image_id"), F.col(f"x{p}").alias("x"), F.col(f"y{p}").alias("y"), F.lit(p).alias("side"))
    sides = F.array(side("a"), side("b"))
    return points.select("cp_index", F.explode(sides).alias("s")).select("s.image_id", "cp_index", "s.x", "s.y", "s.side")


def facing(points: DataFrame, a: int) -> DataFrame:
    """Points with the side of image `a` first."""
    turned = F.col("img_a") != a
    swap = {"img_a": "img_b", "img_b": "img_a", "xa": "xb", "ya": "yb", "xb": "xa", "yb": "ya"}
    return points.withColumns({k: F.when(turned, F.col(v)).otherwise(F.col(k)) for k, v in swap.items()})


def groups(images: DataFrame, points: DataFrame) -> DataFrame:
    """(image_id, group_id) of the enabled images; a group is what enabled points connect, its id the least image."""
    active = images.where("enabled").select("image_id")
    used = points.where("enabled").select(F.col("img_a").cast("long").alias("u"), F.col("img_b").cast("long").alias("v"))
    for end in ("u", "v"):
        used = used.join(active.select(F.col("image_id").cast("long").alias(end)), end, "left_semi")
    parts = connected_components(used).withColumnRenamed("node", "image_id")
    return active.select(F.col("image_id").cast("long")).join(parts, "image_id", "left").select("image_id", F.coalesce("component", "image_id").alias("group_id"))


def largest_first(members: DataFrame) -> DataFrame:
    """(group_id, n, place): the groups of `groups` by size, largest first, ties by id."""
    sizes = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).withColumn("__less", -F.col("n"))
    return numbered(sizes, ["__less", "group_id"], "place").drop("__less")


def stats(images: DataFrame, points: DataFrame) -> DataFrame:
    """One row: total, enabled, n_groups, largest, n_orphans (enabled images without a link)."""
    sizes = groups(images, points).groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    shape = sizes.agg(F.count(F.lit(1)).alias("n_groups"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("n_orphans"))
    return points.agg(F.count(F.lit(1)).alias("total"), F.count_if("enabled").alias("enabled")).join(F.broadcast(shape))


def status_line(stats: DataFrame, rms: Column) -> DataFrame:
    """One row: what a viewer says under the picture, from `stats` and the error of the last solve."""
    split = F.when(F.col("n_groups") > 1, F.format_string(", split into %d", "n_groups")).otherwise("")
    alone = F.when(F.col("n_orphans") > 0, F.format_string(", %d unlinked", "n_orphans")).otherwise("")
    return stats.select(F.concat(F.format_string("%d of %d points, RMS %.2f", "enabled", "total", rms), split, alone).alias("line"))
