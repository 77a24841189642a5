"""Light and tone as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panolith.functions.geometry import clip, col


def srgb_to_linear(x: Column) -> Column:
    x = clip(x, 0.0, 1.0)
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(x: Column) -> Column:
    x = clip(x, 0.0, 1.0)
    return F.when(x <= 0.0031308, x * 12.92).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)


def falloff(r2: Column, a="a", b="b", c="c") -> Column:
    """Brightness left at a squared radius in half short sides."""
    return 1 + r2 * (col(a) + r2 * (col(b) + r2 * col(c)))


def corner_falloff(a="a", b="b", c="c") -> Column:
    return 1 + col(a) + col(b) + col(c)


def vignetting_active(a="a", b="b", c="c") -> Column:
    return F.abs(col(a)) + F.abs(col(b)) + F.abs(col(c)) > 1e-6


def luminance(blue: Column, green: Column, red: Column) -> Column:
    """Linear light of the weighted mean of gamma-encoded 0-255 channels."""
    return srgb_to_linear((0.0722 * blue + 0.7152 * green + 0.2126 * red) / 255)


def radius2(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Squared distance from the middle, in half short sides."""
    dx, dy, n = x - width / 2, y - height / 2, F.least(width, height) / 2
    return (dx * dx + dy * dy) / (n * n)


def tone(value: Column, exposure: Column, flare: Column, parity: bool = False) -> Column:
    """A 0-255 value with the flare taken off in linear light and the exposure undone, truncated.

    The solver's exposure is what the photo has too much, so it is divided out; parity=True
    multiplies by it.
    """
    light = F.greatest(srgb_to_linear(value / 255) - flare, F.lit(0.0))
    light = light * exposure if parity else light / exposure
    return F.floor(linear_to_srgb(light) * 255 + 1e-9).cast("int")


def tone_table(spark: SparkSession, exposure: float, flare: float = 0.0, parity: bool = False) -> DataFrame:
    """(value, toned): `tone` of all 256 values, small enough to broadcast."""
    return spark.range(256).select(F.col("id").cast("int").alias("value"), tone(F.col("id"), F.lit(exposure), F.lit(flare), parity).alias("toned"))


def devignetted(value: Column, v: Column) -> Column:
    """A 0-255 value with the falloff `v` undone in gamma space, truncated."""
    return F.floor(clip(value * F.pow(1 / F.greatest(v, F.lit(0.08)), F.lit(1 / 2.2)), 0.0, 255.0) + 1e-9).cast("int")


def gained(value: Column, gain: Column, ev: Column | float = 0.0) -> Column:
    """A 0-255 value times gain and 2^ev, clipped and truncated; gains within 1e-3 of 1 leave it."""
    factor = gain * F.pow(F.lit(2.0), col(ev))
    return F.when(F.abs(factor - 1) < 1e-3, value.cast("int")).otherwise(F.floor(clip(value * factor, 0.0, 255.0) + 1e-9).cast("int"))


def softplus_flare(raw: Column) -> Column:
    return F.log1p(F.exp(clip(raw, -30.0, 30.0))) * 0.02


def usable_light(*values: Column) -> Column:
    """Neither near black nor near white."""
    ok = F.lit(True)
    for v in values:
        ok = ok & (v > 0.04) & (v < 0.92)
    return ok
