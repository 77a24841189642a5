"""Registered photos and their lenses, poses and corrections."""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panolith.functions.geometry import scaled_fov_hint
from panolith.functions.tags import is_supported
from panolith.operators.order import numbered, quantile


def active_ids(images: DataFrame) -> DataFrame:
    return images.where("enabled").select("image_id").orderBy("image_id")


def active_params(images: DataFrame, params: DataFrame) -> DataFrame:
    return params.join(images.where("enabled"), "image_id", "left_semi")


def sizes(images: DataFrame) -> DataFrame:
    """Sizes of all photos, disabled ones too."""
    return images.select("image_id", "width", "height")


def proxy_scale(images: DataFrame) -> DataFrame:
    return images.select("image_id", (F.col("width") / F.greatest("proxy_width", F.lit(1))).alias("scale"))


def corrections(params: DataFrame, vignetting: DataFrame, photometric: DataFrame, on: bool = True) -> DataFrame:
    """(image_id, a, b, c, exposure, flare): what to undo in each photo; identity if off or unknown."""
    ids = params.select("image_id", "lens_id")
    if not on:
        return ids.select("image_id", *[F.lit(0.0).alias(n) for n in "abc"], F.lit(1.0).alias("exposure"), F.lit(0.0).alias("flare"))
    light = photometric.select("image_id", F.col("photo_exposure").alias("exposure"), F.col("photo_flare").alias("flare"))
    whole = ids.join(vignetting, "lens_id", "left").join(light, "image_id", "left")
    return whole.select(
        "image_id", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in "abc"], F.coalesce("exposure", F.lit(1.0)).alias("exposure"), F.coalesce("flare", F.lit(0.0)).alias("flare")
    )


def lens_users(params: DataFrame) -> DataFrame:
    return params.groupBy("lens_id").agg(F.array_sort(F.collect_list("image_id")).alias("users"))


def lens_order(lenses: DataFrame) -> DataFrame:
    """`lenses` with `place`, from 0, by id."""
    return numbered(lenses, ["lens_id"], "place")


def largest_megabytes(images: DataFrame) -> DataFrame:
    """One row: the size of the largest enabled photo decoded, 100 without any."""
    mb = F.max(F.col("width").cast("double") * F.col("height") * 3 / 1e6)
    return images.where("enabled").agg(F.coalesce(mb, F.lit(100.0)).alias("megabytes"))


def new_paths(paths: DataFrame, images: DataFrame) -> DataFrame:
    """Supported paths not registered yet, each once."""
    return paths.where(is_supported(F.col("path"))).join(images.select("path"), "path", "left_anti").select("path").distinct()


def register(photos: DataFrame, images: DataFrame) -> DataFrame:
    """New rows of `images` from (path, width, height, exif); ids go on from the largest one, by path."""
    hint = scaled_fov_hint()
    fresh = photos.join(images.select("path"), "path", "left_anti").dropDuplicates(["path"])
    last = images.agg(F.coalesce(F.max("image_id"), F.lit(-1)).alias("__last"))
    scale = F.least(F.lit(1.0), 1600 / F.greatest("width", "height"))
    rows = numbered(fresh, ["path"], "__n").join(F.broadcast(last)).withColumns(
        {
            "image_id": (F.col("__last") + 1 + F.col("__n")).cast("int"),
            "proxy_width": F.greatest(F.bround(F.col("width") * scale), F.lit(1)).cast("int"),
            "proxy_height": F.greatest(F.bround(F.col("height") * scale), F.lit(1)).cast("int"),
            "fov_hint": hint["hfov"],
            "fov_source": hint["source"],
            "enabled": F.lit(True),
        }
    )
    return rows.select(*images.columns)


def starting(images: DataFrame, tolerance: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(poses, lenses) that photos start with: straight on, and a flat lens of the hint of its first photo.

    Photos share lenses as `match_lenses` says. Reads what that reads.
    """
    of = match_lenses(images, tolerance)
    neutral = {n: F.lit(0.0) for n in ("yaw", "pitch", "roll")}
    poses = of.withColumns({**neutral, "exposure": F.lit(1.0), "white_balance": F.array(*[F.lit(1.0)] * 3)})
    hints = images.select(F.col("image_id").cast("long").alias("lens_id"), F.col("fov_hint").cast("double").alias("fov"))
    flat = {n: F.lit(0.0) for n in ("a", "b", "c", "cx", "cy", "shear_x", "shear_y")}
    lenses = of.select("lens_id").distinct().join(hints, "lens_id").withColumns({"projection": F.lit("rectilinear"), **flat})
    return poses.select("image_id", "yaw", "pitch", "roll", "lens_id", "exposure", "white_balance"), lenses.select("lens_id", "fov", "projection", *flat)


def remove_image(image_id: int, images: DataFrame, params: DataFrame, photometric: DataFrame, points: DataFrame) -> tuple[DataFrame, ...]:
    """The four relations without one photo, its corrections and its points."""
    other = F.col("image_id") != image_id
    return images.where(other), params.where(other), photometric.where(other), points.where((F.col("img_a") != image_id) & (F.col("img_b") != image_id))


def anchor_after(images: DataFrame, anchor: int | None) -> DataFrame:
    """One row: the anchor if it is still there, else the least id."""
    here = F.max(F.when(F.col("image_id") == F.lit(anchor), F.col("image_id")))
    return images.agg(F.coalesce(here, F.min("image_id")).alias("anchor"))


def patch_image(images: DataFrame, image_id: int, **values) -> DataFrame:
    here = F.col("image_id") == image_id
    return images.withColumns({k: F.when(here, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})


def patch_params(params: DataFrame, image_id: int, **degrees: float) -> DataFrame:
    """New yaw, pitch or roll of a photo, given in degrees."""
    here = F.col("image_id") == image_id
    return params.withColumns({k: F.when(here, F.radians(F.lit(float(v)))).otherwise(F.col(k)) for k, v in degrees.items()})


def patch_lens(lenses: DataFrame, lens_id: int, **values) -> DataFrame:
    """New fov, projection, a, b or c of a lens; None leaves a value."""
    here = F.col("lens_id") == lens_id
    return lenses.withColumns({k: F.when(here, F.coalesce(F.lit(v), F.col(k))).otherwise(F.col(k)) for k, v in values.items()})


def match_lenses(images: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """(image_id, lens_id): photos of one size share a lens with the first photo like them.

    In the order of ids, a photo joins the first lens of its size whose first photo has the
    same lens name and focal length (rounded to 0.1, missing ones alike), or whose angle of
    view is within `tolerance` degrees of the photo's; else it starts a lens. Reads image_id,
    width, height, lens, focal, fov_hint. Sizes are matched independently of each other; a
    lens id is the id of its first photo. Of a size, a task keeps only the lenses met so far.
    """
    key = ["width", "height"]
    schema = "image_id long, lens_id long"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Lenses by mark, and by steps of the angle of view: near ones are in the same step or the next.
        marked: dict[tuple, tuple[int, int]] = {}
        angled: dict[tuple, list[tuple[int, int, float]]] = {}
        n = 0
        for batch in batches:
            out = []
            for i, w, h, name, focal, fov in batch.itertuples(index=False):
                focal = 0.0 if focal is None or focal != focal else float(focal)
                mark = (w, h, None if name is None or name != name else name, round(focal, 1))
                step = None if fov is None or fov != fov or tolerance <= 0 else floor(fov / tolerance)
                alike = [marked[mark]] if mark in marked else []
                if step is not None:
                    alike += [(k, lens) for s in (step - 1, step, step + 1) for k, lens, f in angled.get((w, h, s), ()) if abs(f - fov) < tolerance]
                mine = min(alike)[1] if alike else i
                if not alike:
                    marked[mark] = (n, i)
                    if step is not None:
                        angled.setdefault((w, h, step), []).append((n, i, fov))
                    n += 1
                out.append((i, mine))
            yield pd.DataFrame(out, columns=["image_id", "lens_id"])

    rows = images.select(F.col("image_id").cast("long"), *key, "lens", "focal", "fov_hint")
    n = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *key).sortWithinPartitions(*key, "image_id").mapInPandas(fold, schema)


def refreshed_fov(lenses: DataFrame, params: DataFrame, fixed: DataFrame) -> DataFrame:
    """`lenses` with the median hint of the photos (image_id, fov_hint) that got tags again."""
    hints = quantile(params.join(fixed, "image_id"), "fov_hint", 0.5, ["lens_id"], "__fov").select("lens_id", "__fov")
    return lenses.join(hints, "lens_id", "left").withColumn("fov", F.coalesce("__fov", "fov")).drop("__fov")


def unread(images: DataFrame) -> DataFrame:
    """Photos whose tags have neither a maker nor a focal length."""
    return images.where(F.coalesce(F.col("exif.make"), F.lit("")) == "").where(F.coalesce(F.col("exif.focal_length"), F.lit(0.0)) == 0)


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `table` whose key `new` doesn't have, and all of `new`."""
    return table.join(new.select(key), key, "left_anti").unionByName(new)
