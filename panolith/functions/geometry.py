"""Rotations, lens models and panorama projections as column expressions.

World axes are X right, Y down, Z forward; a pixel's centre is at its whole coordinates;
distortion goes from measured to ideal radius. Each function takes and returns a DataFrame and
adds its columns in steps, so that Spark computes shared parts once.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panolith.schema import Layout

#: Largest width and height in degrees that a projection can show, and that a fit picks.
FOV_MAX = {
    "equirect": (360.0, 180.0),
    "cylindrical": (360.0, 170.0),
    "mercator": (360.0, 170.0),
    "rectilinear": (170.0, 170.0),
    "stereographic": (358.0, 358.0),
    "fisheye": (360.0, 360.0),
}
FIT_MAX = FOV_MAX | {
    "cylindrical": (360.0, 150.0),
    "mercator": (360.0, 160.0),
    "rectilinear": (140.0, 140.0),
    "stereographic": (320.0, 320.0),
}
TINY = 1e-12


def col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def with_steps(df: DataFrame, **steps: Column) -> DataFrame:
    for name, value in steps.items():
        df = df.withColumn(name, value)
    return df


def kept(df: DataFrame, ok: Column) -> DataFrame:
    """The rows for which `ok` holds, tested after the steps above and not pushed through them.

    A plain filter would be rewritten in terms of the first columns, with every step copied
    into it as often as it is used; filters aren't pushed through a projection with a
    column that is not deterministic.
    """
    return df.withColumn("__ok", F.when(ok, F.rand(0)).otherwise(F.lit(-1.0))).where("__ok >= 0").drop("__ok")


def rotation(df: DataFrame, yaw="yaw", pitch="pitch", roll="roll", prefix: str = "m") -> DataFrame:
    """Adds m00..m22, the camera-to-world matrix Ry(yaw) Rx(pitch) Rz(roll)."""
    df = df.withColumns(
        {"__cy": F.cos(col(yaw)), "__sy": F.sin(col(yaw)), "__cp": F.cos(col(pitch)), "__sp": F.sin(col(pitch)), "__cr": F.cos(col(roll)), "__sr": F.sin(col(roll))}
    )
    cy, sy, cp, sp, cr, sr = (F.col(f"__{n}") for n in ("cy", "sy", "cp", "sp", "cr", "sr"))
    rows = (
        (cy * cr + sy * sp * sr, sy * sp * cr - cy * sr, sy * cp),
        (cp * sr, cp * cr, -sp),
        (cy * sp * sr - sy * cr, sy * sr + cy * sp * cr, cy * cp),
    )
    named = {f"{prefix}{i}{j}": rows[i][j] for i in range(3) for j in range(3)}
    return df.withColumns(named).drop("__cy", "__sy", "__cp", "__sp", "__cr", "__sr")


def yaw_pitch_roll(df: DataFrame, prefix: str = "m", names=("yaw", "pitch", "roll")) -> DataFrame:
    """The angles of a matrix; straight up or down the roll is 0 and the yaw holds the turn."""
    m = lambda i, j: F.col(f"{prefix}{i}{j}")
    df = df.withColumn("__p", F.asin(clip(-m(1, 2), -1.0, 1.0)))
    locked = F.abs(F.cos("__p")) < 1e-8
    angles = (
        F.when(locked, F.atan2(-m(2, 0), m(0, 0))).otherwise(F.atan2(m(0, 2), m(2, 2))),
        F.col("__p"),
        F.when(locked, F.lit(0.0)).otherwise(F.atan2(m(1, 0), m(1, 1))),
    )
    return df.withColumns(dict(zip(names, angles, strict=True))).drop("__p")


def turned(df: DataFrame, prefix: str = "m", back: bool = False, ray=("rx", "ry", "rz")) -> DataFrame:
    """The ray turned by the matrix, or by its inverse."""
    m = lambda i, j: F.col(f"{prefix}{j}{i}" if back else f"{prefix}{i}{j}")
    x, y, z = (F.col(r) for r in ray)
    return df.withColumns({r: m(i, 0) * x + m(i, 1) * y + m(i, 2) * z for i, r in enumerate(ray)})


def unit(df: DataFrame, ray=("rx", "ry", "rz")) -> DataFrame:
    x, y, z = (F.col(r) for r in ray)
    df = df.withColumn("__n", F.greatest(F.sqrt(x * x + y * y + z * z), F.lit(TINY)))
    return df.withColumns({r: F.col(r) / F.col("__n") for r in ray}).drop("__n")


def focal_px(fov="fov", projection="projection", width="width") -> Column:
    """Focal length in pixels from the horizontal angle of view in degrees."""
    w, kind = col(width), F.col(projection)
    half = F.radians(clip(col(fov), 1e-3, 359.0)) / 2
    return (
        F.when(kind == "rectilinear", w / 2 / F.tan(F.least(half, F.lit(89 * pi / 180))))
        .when(kind == "stereographic", w / 4 / F.tan(half / 2))
        .when(kind == "orthographic", w / 2 / F.sin(F.least(half, F.lit(89.9 * pi / 180))))
        .otherwise(w / 2 / half)
    )


def distortion(r: Column, a="a", b="b", c="c") -> Column:
    """Ideal over measured radius, at a measured radius in half short sides."""
    a, b, c = col(a), col(b), col(c)
    return ((a * r + b) * r + c) * r + (1 - a - b - c)


def _direction(df: DataFrame, x: str, y: str) -> DataFrame:
    """Adds __r, and the unit direction __ux, __uy (0 at the centre)."""
    df = df.withColumn("__r", F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y)))
    far = F.col("__r") > TINY
    return df.withColumns({"__ux": F.when(far, F.col(x) / F.col("__r")).otherwise(0.0), "__uy": F.when(far, F.col(y) / F.col("__r")).otherwise(0.0)})


def pixels_to_rays(df: DataFrame, x="x", y="y", world: bool = True) -> DataFrame:
    """Adds rx, ry, rz, the unit ray of pixel (x, y).

    Reads the lens columns fov, projection, a, b, c, cx, cy, shear_x, shear_y, the size width,
    height, and, for world rays, yaw, pitch, roll.
    """
    df = with_steps(
        df,
        __f=focal_px(),
        __s=F.least("width", "height") / 2,
        __x=col(x) - F.col("width") / 2 + 0.5 - F.col("cx"),
        __y=col(y) - F.col("height") / 2 + 0.5 - F.col("cy"),
    )
    df = df.withColumn("__x", F.col("__x") + F.col("shear_x") * F.col("__y")).withColumn("__y", F.col("__y") + F.col("shear_y") * F.col("__x"))
    df = df.withColumn("__k", F.sqrt(F.col("__x") * F.col("__x") + F.col("__y") * F.col("__y")) / F.col("__s"))
    df = df.withColumn("__k", distortion(F.col("__k")))
    df = df.withColumns({"__x": F.col("__x") * F.col("__k"), "__y": F.col("__y") * F.col("__k")})
    df = _direction(df, "__x", "__y")
    f, r, kind = F.col("__f"), F.col("__r"), F.col("projection")
    df = df.withColumn("__t", F.when(kind == "stereographic", 2 * F.atan2(r, 2 * f)).otherwise(r / f))
    sphere, flat, ortho = kind.isin("fisheye", "stereographic"), kind == "rectilinear", kind == "orthographic"
    s, lon, lat = clip(F.col("__t"), 0.0, 1.0), F.col("__x") / f, F.col("__y") / f

    def ray(round_: Column, plane: Column, parallel: Column, globe: Column) -> Column:
        return F.when(sphere, round_).when(flat, plane).when(ortho, parallel).otherwise(globe)

    ux, uy, t = F.col("__ux"), F.col("__uy"), F.col("__t")
    df = df.withColumns(
        {
            "rx": ray(ux * F.sin(t), F.col("__x"), ux * s, F.cos(lat) * F.sin(lon)),
            "ry": ray(uy * F.sin(t), F.col("__y"), uy * s, F.sin(lat)),
            "rz": ray(F.cos(t), f, F.sqrt(F.greatest(1 - s * s, F.lit(0.0))), F.cos(lat) * F.cos(lon)),
        }
    )
    df = unit(df).drop("__f", "__s", "__x", "__y", "__k", "__r", "__ux", "__uy", "__t")
    if not world:
        return df
    return turned(rotation(df, prefix="__m"), "__m").drop(*[f"__m{i}{j}" for i in range(3) for j in range(3)])


def measured_radius(ideal: Column, steps: int = 24) -> Column:
    """The measured radius of an ideal one, on the part of the curve that rises; by Newton's method."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    d = 1 - a - b - c

    def step(r: Column, _: Column) -> Column:
        value = (((a * r + b) * r + c) * r + d) * r
        slope = ((4 * a * r + 3 * b) * r + 2 * c) * r + d
        return r - (value - ideal) / F.when(F.abs(slope) < 1e-6, F.lit(1e-6)).otherwise(slope)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), ideal, step)


def rays_to_pixels(df: DataFrame, ray=("rx", "ry", "rz"), world: bool = True, matrix: str | None = None) -> DataFrame:
    """Adds px, py and valid, where the lens sees the ray; the inverse of `pixels_to_rays`.

    With `matrix` the pose is read from the nine columns of that prefix, made by `rotation`, so
    that a join with cameras computes it once per camera instead of per ray.
    valid is false behind a flat or parallel lens, and where the distortion curve no longer
    rises or has passed 2.5 half short sides.
    """
    df = df.withColumns(dict(zip(("__vx", "__vy", "__vz"), (F.col(r) for r in ray), strict=True)))
    v = ("__vx", "__vy", "__vz")
    if matrix:
        df = turned(df, matrix, back=True, ray=v)
    elif world:
        df = turned(rotation(df, prefix="__m"), "__m", back=True, ray=v).drop(*[f"__m{i}{j}" for i in range(3) for j in range(3)])
    df = _direction(unit(df, v), "__vx", "__vy").withColumn("__f", focal_px())
    f, r, z, kind = F.col("__f"), F.col("__r"), F.col("__vz"), F.col("projection")
    df = df.withColumn("__t", F.atan2(r, z))
    t = F.col("__t")
    flat, ortho = kind == "rectilinear", kind == "orthographic"
    seen = F.when(flat, z > 1e-6).when(ortho, z > 0).otherwise(F.lit(True))
    safe = F.when(z > 1e-6, z).otherwise(1.0)
    radius = F.when(kind == "fisheye", f * t).when(ortho, f * r).otherwise(2 * f * F.tan(clip(t, 0.0, 179 * pi / 180) / 2))
    df = df.withColumns(
        {
            "valid": seen,
            "__x": F.when(flat, f * F.col("__vx") / safe).when(kind == "equirect", f * F.atan2("__vx", "__vz")).otherwise(F.col("__ux") * radius),
            "__y": F.when(flat, f * F.col("__vy") / safe).when(kind == "equirect", f * F.asin(clip(F.col("__vy"), -1.0, 1.0))).otherwise(F.col("__uy") * radius),
        }
    )
    df = df.withColumn("__i", F.sqrt(F.col("__x") * F.col("__x") + F.col("__y") * F.col("__y")) / (F.least("width", "height") / 2))
    bent = F.abs("a") + F.abs("b") + F.abs("c") > TINY
    df = df.withColumn("__m", F.when(bent, measured_radius(F.col("__i"))).otherwise(F.col("__i")))
    m, a, b, c = F.col("__m"), F.col("a"), F.col("b"), F.col("c")
    rising = ((4 * a * m + 3 * b) * m + 2 * c) * m + (1 - a - b - c) > 0
    df = df.withColumn("__k", F.when(bent & (F.col("__i") > TINY), m / F.col("__i")).otherwise(1.0))
    df = df.withColumns(
        {"valid": F.col("valid") & (~bent | (rising & (m >= 0) & (m <= 2.5))), "__x": F.col("__x") * F.col("__k"), "__y": F.col("__y") * F.col("__k")}
    )
    df = df.withColumn("__y", F.col("__y") - F.col("shear_y") * F.col("__x")).withColumn("__x", F.col("__x") - F.col("shear_x") * F.col("__y"))
    df = df.withColumns({"px": F.col("__x") + F.col("width") / 2 - 0.5 + F.col("cx"), "py": F.col("__y") + F.col("height") / 2 - 0.5 + F.col("cy")})
    return df.drop("__vx", "__vy", "__vz", "__r", "__ux", "__uy", "__f", "__t", "__x", "__y", "__i", "__m", "__k")


def canvas_scale(layout: Layout) -> float:
    """Pixels per radian at the middle of the canvas."""
    from math import tan

    half = min(max(layout.hfov, 1e-3), 360.0) * pi / 360
    if layout.projection == "rectilinear":
        return layout.full_w / 2 / tan(min(half, 89 * pi / 180))
    if layout.projection == "stereographic":
        return layout.full_w / 4 / tan(min(half, 179 * pi / 180) / 2)
    return layout.full_w / 2 / half


def _centred(df: DataFrame, layout: Layout, back: bool, ray) -> DataFrame:
    angles = (layout.center_yaw, layout.center_pitch, layout.center_roll)
    if max(map(abs, angles)) < TINY:
        return df
    df = rotation(df, *map(F.lit, angles), prefix="__c")
    return turned(df, "__c", back=back, ray=ray).drop(*[f"__c{i}{j}" for i in range(3) for j in range(3)])


def canvas_to_rays(df: DataFrame, layout: Layout, x="x", y="y") -> DataFrame:
    """Adds the world ray rx, ry, rz of canvas pixel (x, y), and on_canvas, whether it has one."""
    s, kind = canvas_scale(layout), layout.projection
    df = df.withColumns({"__x": col(x) - layout.full_w / 2 + 0.5, "__y": col(y) - layout.full_h / 2 + 0.5})
    if kind == "rectilinear":
        df = unit(df.withColumns({"rx": F.col("__x"), "ry": F.col("__y"), "rz": F.lit(s), "on_canvas": F.lit(True)}))
    elif kind in ("stereographic", "fisheye"):
        df = _direction(df, "__x", "__y")
        df = df.withColumn("__t", 2 * F.atan2(F.col("__r"), F.lit(2 * s)) if kind == "stereographic" else F.col("__r") / s)
        df = df.withColumns(
            {
                "rx": F.col("__ux") * F.sin("__t"),
                "ry": F.col("__uy") * F.sin("__t"),
                "rz": F.cos("__t"),
                "on_canvas": (F.col("__t") <= pi) if kind == "fisheye" else F.lit(True),
            }
        )
    else:
        v = F.col("__y") / s
        lat = {"equirect": v, "cylindrical": F.atan(v), "mercator": 2 * F.atan(F.exp(v)) - pi / 2}[kind]
        df = with_steps(df, __lon=F.col("__x") / s, __t=lat)
        df = df.withColumn("on_canvas", F.abs("__t") <= pi / 2 + 1e-9).withColumn("__t", clip(F.col("__t"), -pi / 2, pi / 2))
        df = df.withColumns({"rx": F.cos("__t") * F.sin("__lon"), "ry": F.sin("__t"), "rz": F.cos("__t") * F.cos("__lon")})
    df = _centred(df, layout, False, ("rx", "ry", "rz"))
    return df.drop("__x", "__y", "__r", "__ux", "__uy", "__t", "__lon")


def rays_to_canvas(df: DataFrame, layout: Layout, ray=("rx", "ry", "rz")) -> DataFrame:
    """Adds canvas coordinates qx, qy of the world ray; null where the projection can't show it."""
    s, kind = canvas_scale(layout), layout.projection
    v = ("__vx", "__vy", "__vz")
    df = df.withColumns(dict(zip(v, (F.col(r) for r in ray), strict=True)))
    df = unit(_centred(df, layout, True, v), v)
    x, y, z = (F.col(n) for n in v)
    if kind == "rectilinear":
        front = z > 1e-6
        df = df.withColumns({"__qx": F.when(front, s * x / z), "__qy": F.when(front, s * y / z)})
    elif kind in ("stereographic", "fisheye"):
        df = _direction(df, "__vx", "__vy").withColumn("__t", F.atan2(F.col("__r"), z))
        r = 2 * s * F.tan(clip(F.col("__t"), 0.0, 179 * pi / 180) / 2) if kind == "stereographic" else s * F.col("__t")
        df = df.withColumns({"__qx": F.col("__ux") * r, "__qy": F.col("__uy") * r})
    else:
        df = df.withColumn("__t", F.asin(clip(y, -1.0, 1.0)))
        lat = clip(F.col("__t"), -1.5, 1.5)
        v_ = {"equirect": F.col("__t"), "cylindrical": F.tan(lat), "mercator": F.log(F.tan(lat / 2 + pi / 4))}[kind]
        df = df.withColumns({"__qx": F.atan2(x, z) * s, "__qy": v_ * s})
    df = df.withColumns({"qx": F.col("__qx") + (layout.full_w / 2 - 0.5), "qy": F.col("__qy") + (layout.full_h / 2 - 0.5)})
    return df.drop(*v, "__r", "__ux", "__uy", "__t", "__qx", "__qy")


def wrap_angle(x: Column) -> Column:
    """The angle in (-pi, pi]."""
    return F.atan2(F.sin(x), F.cos(x))


def wrap180(x: Column) -> Column:
    """Degrees in [-180, 180)."""
    return F.pmod(x + 180, F.lit(360.0)) - 180


def clamp_fov(projection="projection", hfov="hfov", vfov="vfov") -> tuple[Column, Column]:
    """Both angles of view within 1 degree and the projection's limit."""
    out = []
    for i, name in enumerate((hfov, vfov)):
        most = F.lit((360.0, 180.0)[i])
        for kind, limits in FOV_MAX.items():
            most = F.when(F.col(projection) == kind, F.lit(limits[i])).otherwise(most)
        out.append(F.least(F.greatest(col(name), F.lit(1.0)), most))
    return out[0], out[1]


def degrees_per_pixel(layout: Layout) -> float:
    """How far a pixel in the middle turns the view; flat canvases count at most 70 degrees to a side."""
    from math import degrees, radians, tan

    if layout.projection == "rectilinear":
        return degrees(1 / (layout.full_w / 2 / tan(min(radians(layout.hfov) / 2, radians(70)))))
    return layout.hfov / layout.full_w


def drag(yaw: Column, pitch: Column, dx: Column, dy: Column, degrees_per_px: float) -> tuple[Column, Column]:
    """View angles after the picture has been dragged by (dx, dy) pixels."""
    return wrap180(yaw - dx * degrees_per_px), clip(pitch - dy * degrees_per_px, -90.0, 90.0)


def scaled_fov_hint(width="width", height="height", exif="exif") -> Column:
    """struct<hfov, source, trusted>: the horizontal angle of view that the EXIF tags tell.

    In this order: the 35 mm equivalent, the sensor's resolution tags, a 1.5x crop body, 50 degrees.
    The frame of an upright photo is its short side.
    """
    upright = F.col(height) > F.col(width)
    tag = lambda n: F.col(f"{exif}.{n}")
    angle = lambda frame, f: F.degrees(2 * F.atan(frame / (2 * f)))
    frame = F.when(upright, F.lit(24.0)).otherwise(F.lit(36.0))
    code = F.coalesce(tag("fp_unit"), F.lit(2.0)).cast("int")
    unit_mm = F.when(code == 3, 10.0).when(code == 4, 1.0).when(code == 5, 0.001).otherwise(25.4)
    sensor = F.when((tag("fp_x_res") > 0) & (tag("exif_w") > 0), tag("exif_w") / tag("fp_x_res") * unit_mm)
    turned_ = F.when(upright, sensor * F.least(width, height) / F.greatest(width, height)).otherwise(sensor)
    by_35, by_sensor, by_crop = tag("focal_35") > 1, (tag("focal_length") > 0) & (sensor > 1) & (sensor < 100), tag("focal_length") > 1

    def made(hfov: Column, source: str, trusted: bool) -> Column:
        return F.struct(hfov.alias("hfov"), F.lit(source).alias("source"), F.lit(trusted).alias("trusted"))

    return (
        F.when(by_35, made(angle(frame, tag("focal_35")), "focal_35", True))
        .when(by_sensor, made(angle(turned_, tag("focal_length")), "sensor", True))
        .when(by_crop, made(angle(frame / 1.5, tag("focal_length")), "crop", False))
        .otherwise(made(F.lit(50.0), "default", False))
    )
