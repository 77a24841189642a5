"""Brightness statistics of overlaps, and the gains that even them out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panolith.operators.order import quantile

SIGMA_N, SIGMA_G = 5 / 255, 0.12


def overlap_stats(pixels: DataFrame, channels=("b", "g", "r"), at=("x", "y"), least: int = 12) -> DataFrame:
    """(i, j, n, mean_i_*, mean_j_*), i < j: each pair's mean values where both have a pixel.

    An equi-join on places. The sums combine before the shuffle; pairs under `least` places go.
    """
    side = lambda p: pixels.select(*at, F.col("image_id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in channels])
    met = side("i").join(side("j"), list(at)).where("i < j")
    means = [F.avg(f"{p}_{c}").alias(f"mean_{p}_{c}") for p in "ij" for c in channels]
    return met.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), *means).where(F.col("n") >= least)


def normal_entries(stats: DataFrame, channel: str = "b", sigma_n: float = SIGMA_N, sigma_g: float = SIGMA_G) -> DataFrame:
    """(i, j, a, b): entries of the gain equations A g = b, from means in 0-1; b stands on the diagonal."""
    n, mi, mj = F.col("n"), F.col(f"mean_i_{channel}"), F.col(f"mean_j_{channel}")
    sn, sg = sigma_n * sigma_n, sigma_g * sigma_g
    part = lambda i, j, a, b: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), a.alias("a"), b.alias("b"))
    zero = F.lit(0.0)
    parts = F.array(
        part("i", "i", n * (mi * mi / sn + 1 / sg), n / sg),
        part("j", "j", n * (mj * mj / sn + 1 / sg), n / sg),
        part("i", "j", -n * mi * mj / sn, zero),
        part("j", "i", -n * mi * mj / sn, zero),
    )
    return stats.select(F.explode(parts).alias("e")).groupBy("e.i", "e.j").agg(F.sum("e.a").alias("a"), F.sum("e.b").alias("b"))


def solve_gains(stats: DataFrame, image_ids: list[int], channels=("b",), scale: float = 1 / 255) -> dict[int, list[float]]:
    """Gains of each image for each channel: clipped, divided by their median, clipped again.

    The equations have a row per photo and are solved on the driver. A photo without overlap keeps gain 1.
    """
    scaled = stats
    for c in channels:
        for p in "ij":
            scaled = scaled.withColumn(f"mean_{p}_{c}", F.col(f"mean_{p}_{c}") * scale)
    at = {k: n for n, k in enumerate(image_ids)}
    out = np.ones((len(image_ids), len(channels)))
    for k, c in enumerate(channels):
        a, b = np.eye(len(at)) * 1e-9, np.full(len(at), 1e-9)
        for i, j, x, y in normal_entries(scaled, c).collect():
            if i in at and j in at:
                a[at[i], at[j]] += x
                b[at[i]] += y if i == j else 0.0
        out[:, k] = np.clip(np.linalg.solve(a, b), 0.25, 4)
    out = np.clip(out / max(1e-6, float(np.median(out))), 0.25, 4)
    return {i: out[n].tolist() for i, n in at.items()}


def gains_to_ev(gains: DataFrame, columns=("b", "g", "r")) -> DataFrame:
    """`gains` with ev, the base-2 logarithm of the mean gain."""
    mean = sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / len(columns)
    return gains.withColumn("ev", F.log2(F.greatest(mean, F.lit(1e-6))))


def over_median(values: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """`values` with the column divided by its median (1 if that is 0)."""
    middle = quantile(values, column, 0.5, by or [], "__m").drop("n")
    both = values.join(middle, by) if by else values.join(F.broadcast(middle))
    return both.withColumn(column, F.col(column) / F.when(F.col("__m") == 0, 1.0).otherwise(F.col("__m"))).drop("__m")
