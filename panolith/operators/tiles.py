"""Tiles of a canvas and the photos that touch them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panolith.operators.order import quantile
from panolith.schema import Layout

TILE, MARGIN = 1536, 192


def tile_grid(spark: SparkSession, layout: Layout, tile: int = TILE) -> DataFrame:
    """(tx, ty, x0, y0, w, h) of the tiles of the drawn part, in pixels from its corner."""
    nx, ny = max(1, ceil(layout.w / tile)), max(1, ceil(layout.h / tile))
    df = spark.range(nx * ny).select((F.col("id") % nx).cast("int").alias("tx"), F.floor(F.col("id") / nx).cast("int").alias("ty"))
    df = df.withColumns({"x0": F.col("tx") * tile, "y0": F.col("ty") * tile})
    return df.withColumns({"w": F.least(F.lit(tile), F.lit(layout.w) - F.col("x0")), "h": F.least(F.lit(tile), F.lit(layout.h) - F.col("y0"))})


def expanded(tiles: DataFrame, layout: Layout, margin: int = MARGIN) -> DataFrame:
    """Adds ex0, ey0, ex1, ey1: the tile with its margin, within the canvas."""
    return tiles.withColumns(
        {
            "ex0": F.greatest(F.col("x0") - margin, F.lit(0)),
            "ey0": F.greatest(F.col("y0") - margin, F.lit(0)),
            "ex1": F.least(F.col("x0") + F.col("w") + margin, F.lit(layout.w)),
            "ey1": F.least(F.col("y0") + F.col("h") + margin, F.lit(layout.h)),
        }
    )


def cell_size(layout: Layout) -> int:
    return min(64, max(8, ceil(max(layout.w, layout.h) / 1500)))


def coverage(spark: SparkSession, layout: Layout, sees: Callable, cell: int | None = None) -> DataFrame:
    """(image_id, cx, cy): cells of the canvas whose middle each photo sees, and their neighbours.

    sees(x, y) gives (image_id, mask) of the photos for arrays of canvas coordinates. Columns of a
    canvas that wraps go on at the other end. Batches of cells are projected as arrays: as
    column expressions the long chain of steps would be copied many times over by the optimizer.
    """
    cell = cell or cell_size(layout)
    nx, ny = ceil(layout.w / cell), ceil(layout.h / cell)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cx, cy = batch["id"].to_numpy() % nx, batch["id"].to_numpy() // nx
            for image, mask in sees(cx * cell + cell / 2 + layout.x0, cy * cell + cell / 2 + layout.y0):
                yield pd.DataFrame({"image_id": image, "cx": cx[mask], "cy": cy[mask]})

    cells = spark.range(nx * ny).mapInPandas(run, "image_id long, cx int, cy int")
    return dilated(cells, nx, ny, layout.hfov >= 358 and layout.w >= layout.full_w)


def dilated(cells: DataFrame, nx: int, ny: int, wraps: bool = False) -> DataFrame:
    """The cells and their eight neighbours within the grid, each once."""
    step = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    near = cells.withColumn("__dx", step).withColumn("__dy", step)
    x = F.col("cx") + F.col("__dx")
    near = near.withColumns({"cx": F.pmod(x, F.lit(nx)) if wraps else x, "cy": F.col("cy") + F.col("__dy")}).drop("__dx", "__dy")
    return near.where((F.col("cx") >= 0) & (F.col("cx") < nx) & (F.col("cy") >= 0) & (F.col("cy") < ny)).distinct()


def tile_images(tiles: DataFrame, covered: DataFrame, cell: int) -> DataFrame:
    """(tx, ty, image_id, bx0, by0, bx1, by1): photos that touch each expanded tile, and where.

    An equi-join on cells rather than a range join: each tile is exploded into its cells. The
    box is that of the covered cells within the tile, in pixels.
    """
    # The last pixel row or column that a half-open box holds is at its end less 1.
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell).cast("int"), F.floor((F.col(b) - 1) / cell).cast("int")))
    of_tile = tiles.where("ex1 > ex0 and ey1 > ey0").withColumn("cx", cells("ex0", "ex1")).withColumn("cy", cells("ey0", "ey1"))
    met = of_tile.join(covered, ["cx", "cy"])
    box = met.groupBy("tx", "ty", "image_id", "ex0", "ey0", "ex1", "ey1").agg(F.min("cx").alias("a"), F.min("cy").alias("b"), F.max("cx").alias("c"), F.max("cy").alias("d"))
    return box.select(
        "tx",
        "ty",
        "image_id",
        F.greatest(F.col("a") * cell, "ex0").alias("bx0"),
        F.greatest(F.col("b") * cell, "ey0").alias("by0"),
        F.least((F.col("c") + 1) * cell, "ex1").alias("bx1"),
        F.least((F.col("d") + 1) * cell, "ey1").alias("by1"),
    )


def overlap(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> tuple[Column, Column, Column, Column, Column]:
    """(x, y, w, h, touches) of the intersection of rectangles (x, y, w, h); sides that only touch don't overlap."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = ([F.col(c) for c in r] for r in (a, b))
    x, y = F.greatest(ax, bx), F.greatest(ay, by)
    w, h = F.least(ax + aw, bx + bw) - x, F.least(ay + ah, by + bh) - y
    return x, y, w, h, (w > 0) & (h > 0)


def overlapping_pairs(rects: DataFrame, cell: int = 256) -> DataFrame:
    """(i, j, x, y, w, h), i < j, of rectangles (image_id, x0, y0, w, h) that overlap.

    Each rectangle is filed under the cells it touches; a pair is reported by the cell that
    holds the corner of its intersection, so once, without a distinct.
    """
    span = lambda a, n: F.sequence(F.floor(F.col(a) / cell).cast("long"), F.floor((F.col(a) + F.col(n) - 1) / cell).cast("long"))
    filed = rects.where("w > 0 and h > 0").withColumn("cx", F.explode(span("x0", "w"))).withColumn("cy", F.explode(span("y0", "h")))
    side = lambda p: filed.select("cx", "cy", *[F.col(c).alias(f"{p}_{c}") for c in ("image_id", "x0", "y0", "w", "h")])
    x, y, w, h, touches = overlap(tuple(f"a_{c}" for c in ("x0", "y0", "w", "h")), tuple(f"b_{c}" for c in ("x0", "y0", "w", "h")))
    met = side("a").join(side("b"), ["cx", "cy"]).where("a_image_id < b_image_id").where(touches)
    met = met.where((F.floor(x / cell) == F.col("cx")) & (F.floor(y / cell) == F.col("cy")))
    return met.select(F.col("a_image_id").alias("i"), F.col("b_image_id").alias("j"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def source_scale(points: DataFrame, by: list[str]) -> DataFrame:
    """(by..., scale): how small a source may be made before it is warped.

    `points` holds px, py at grid places gx, gy. The 2nd percentile of the distances between
    neighbours is the finest footprint; with under 8 distances the scale is 1.
    """
    step = lambda across, along: F.sqrt(
        F.pow(F.col("px") - F.lag("px").over(Window.partitionBy(*by, across).orderBy(along)), F.lit(2.0))
        + F.pow(F.col("py") - F.lag("py").over(Window.partitionBy(*by, across).orderBy(along)), F.lit(2.0))
    )
    steps = points.select(*by, step("gy", "gx").alias("across"), step("gx", "gy").alias("down"))
    steps = steps.select(*by, F.explode(F.array("across", "down")).alias("d")).where("d is not null")
    low = quantile(steps, "d", 0.02, by, "p")
    return low.select(*by, F.when((F.col("n") < 8) | (F.col("p") <= 0), F.lit(1.0)).otherwise(F.least(F.greatest(1.4 / F.col("p"), F.lit(0.02)), F.lit(1.0))).alias("scale"))
