"""Photos as DataFrames: files, sizes, EXIF tags and decoded pixels."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf

from panolith.functions.tags import cache_key, is_supported
from panolith.operators.kernels import resized
from panolith.schema import EXIF


def photo_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, modificationTime, length, content) of supported photos in files or folders, one level deep, by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(list(paths))
    return files.where(is_supported(F.col("path"))).orderBy("path")


# Numbers of the tags that are read, and the bytes of each TIFF value type.
TAGS = {
    0x920A: "focal_length", 0xA405: "focal_35", 0x829D: "fnumber", 0x8827: "iso", 0x829A: "exposure_time", 0x010F: "make", 0x0110: "model",
    0xA434: "lens", 0x9003: "datetime", 0x0132: "datetime_file", 0x0112: "orientation", 0xA20E: "fp_x_res", 0xA210: "fp_unit", 0xA002: "exif_w",
    0x0100: "image_w", 0x0101: "image_h",
}
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8}
NUMBERS = ("focal_length", "focal_35", "fnumber", "iso", "exposure_time", "fp_x_res", "fp_unit", "exif_w")
CANON_UUID = bytes.fromhex("85c0b687820f11e08111f4ce462b6a48")


def tiff_tags(data: bytes) -> dict:
    """The known tags of a TIFF block and its EXIF directory; what can't be read is left out."""
    out: dict = {}
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        return out

    def directory(at: int) -> None:
        if not 8 <= at <= len(data) - 2:
            return
        (n,) = struct.unpack_from(order + "H", data, at)
        for i in range(n):
            if at + 14 + 12 * i > len(data):
                return
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            size = TYPE_BYTES.get(kind, 0) * count
            place = at + 10 + 12 * i
            if size > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            if not size or place + size > len(data):
                continue
            if tag == 0x8769:
                directory(struct.unpack_from(order + "I", data, place)[0])
            elif tag in TAGS and TAGS[tag] not in out:
                value = None
                if kind == 2:
                    value = data[place : place + size].split(b"\0")[0].decode("utf-8", "replace").strip() or None
                elif kind in (5, 10):
                    a, b = struct.unpack_from(order + ("II" if kind == 5 else "ii"), data, place)
                    value = a / b if b else None
                elif kind in (1, 3, 4, 6, 8, 9):
                    (value,) = struct.unpack_from(order + {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}[kind], data, place)
                if value is not None:
                    out[TAGS[tag]] = value

    directory(struct.unpack_from(order + "I", data, 4)[0])
    return out


#: Boxes that hold boxes, with the bytes before them.
HOLDERS = {b"moov": 0, b"uuid:" + CANON_UUID.hex().encode(): 16}


def box_index(data: bytes) -> list[tuple[bytes, int, int]]:
    """(path, body start, end) of the ISO media boxes of a file, in its order; a path names the boxes around too.

    A box is as long as its first 32 bits say; 1 stands for 64 bits after the name, and 0 for all
    that is left. A uuid box has its number in its name. A box shorter than its head ends its level.
    """
    found, todo = [], [(b"", 0, len(data))]
    while todo:
        path, at, end = todo.pop()
        if end - at < 8:
            continue
        said, name = struct.unpack_from(">I4s", data, at)
        long = said == 1 and end - at >= 16
        size = struct.unpack_from(">Q", data, at + 8)[0] if long else said or end - at
        body = at + (16 if long else 8)
        if at + size < body:
            continue
        last = min(at + size, end)
        todo.append((path, at + size, end))
        mark = name + b":" + data[body : body + 16].hex().encode() if name == b"uuid" else name
        found.append((path + mark, body, last))
        if mark in HOLDERS:
            todo.append((path + mark + b"/", body + HOLDERS[mark], last))
    return found


class MediaBoxes:
    """Rows of the top-level boxes of a file's bytes."""

    def eval(self, content: bytes):
        for path, body, finish in box_index(bytes(content or b"")):
            if b"/" not in path:
                yield path[:4].decode("latin-1"), body, finish


def media_boxes():
    """The table function of MediaBoxes, to be called on a column or registered."""
    return udtf(MediaBoxes, returnType="kind string, body long, finish long")


def canon_tags(data: bytes) -> dict:
    """Tags of the directories that a CR3 file holds in its maker's box; of a tag that stands twice the first."""
    out: dict = {}
    for path, body, end in box_index(data):
        if path.startswith(b"moov/uuid:") and path.endswith((b"/CMT1", b"/CMT2")):
            out = tiff_tags(data[body:end]) | out
    return out


def jpeg_segments(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(marker, body start, end) of the segments before the picture data."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xDA:
            return
        (size,) = struct.unpack_from(">H", data, at + 2)
        yield marker, at + 4, min(at + 2 + size, len(data))
        at += 2 + size


def photo_tags(data: bytes) -> dict:
    if data[4:8] == b"ftyp":
        return canon_tags(data)
    if data[:2] in (b"II", b"MM"):
        return tiff_tags(data)
    for marker, at, end in jpeg_segments(data):
        if marker == 0xE1 and data[at : at + 6] == b"Exif\0\0":
            return tiff_tags(data[at + 6 : end])
    return {}


def photo_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) from the header alone; sides swapped if the orientation turns the photo."""
    size = None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        size = struct.unpack_from(">II", data, 16)
    elif data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack_from("<ii", data, 18)
        size = (w, abs(h))
    elif data[:2] in (b"II", b"MM"):
        tags = tiff_tags(data)
        size = (tags["image_w"], tags["image_h"]) if "image_w" in tags and "image_h" in tags else None
    for marker, at, end in jpeg_segments(data):
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and end - at >= 5:
            h, w = struct.unpack_from(">HH", data, at + 1)
            size = (w, h)
            break
    if size and int(photo_tags(data).get("orientation", 1)) >= 5:
        size = size[::-1]
    return size


def header_size(content: str) -> Column:
    """struct<width, height> from the header of a column of file contents."""
    return pandas_udf(_sizes, "width int, height int")(content)


def exif_of(content: str) -> Column:
    """The EXIF tags; missing ones null, a missing orientation 1, the file's date for a missing one."""
    return pandas_udf(_tags, EXIF)(content)


def _sizes(content: pd.Series) -> pd.DataFrame:
    made = [photo_size(bytes(c)) if c is not None else None for c in content]
    return pd.DataFrame({"width": pd.array([m[0] if m else None for m in made], dtype="Int32"), "height": pd.array([m[1] if m else None for m in made], dtype="Int32")})


def _tags(content: pd.Series) -> pd.DataFrame:
    rows = []
    for c in content:
        t = photo_tags(bytes(c)) if c is not None else {}
        row = {k: float(t[k]) if k in t else None for k in NUMBERS}
        row |= {k: t.get(k) for k in ("make", "model", "lens")}
        row |= {"datetime": t.get("datetime", t.get("datetime_file")), "orientation": int(t.get("orientation", 1))}
        rows.append(row)
    order = [f.split(":")[0] for f in EXIF[len("struct<") : -1].split(",")]
    return pd.DataFrame(rows, columns=order).astype({k: "float64" for k in NUMBERS})


def registered(files: DataFrame) -> DataFrame:
    """(path, width, height, exif) of photo files, from their headers."""
    size = header_size("content")
    return files.select("path", size.alias("s"), exif_of("content").alias("exif")).select("path", "s.width", "s.height", "exif")


def oriented(img: np.ndarray, orientation: int) -> np.ndarray:
    """The raster as the EXIF orientation (1 to 8) says it should be seen."""
    turns = {1: 0, 2: 0, 3: 2, 4: 2, 5: 3, 6: 3, 7: 1, 8: 1}.get(orientation, 0)
    img = np.rot90(img, turns) if turns else img
    return img[:, ::-1] if orientation in (2, 4, 5, 7) else img


def normalised(img: np.ndarray) -> np.ndarray:
    """Any raster as 8-bit BGR: other depths stretched to 0-255, gray repeated, alpha dropped."""
    if img.dtype != np.uint8:
        low, high = float(img.min()), float(img.max())
        img = ((img.astype(float) - low) / max(high - low, 1e-12) * 255).astype(np.uint8)
    if img.ndim == 2:
        img = img[:, :, None]
    return np.repeat(img, 3, axis=2) if img.shape[2] == 1 else img[:, :, :3]


def decoded(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, width, height, bgr, failed) of PNG, JPEG, TIFF and BMP photos, not yet turned.

    Gray is repeated and alpha dropped. A file that can't be decoded keeps its row, with failed
    true and nulls.
    """
    img = spark.read.format("image").option("dropInvalid", False).load(list(paths)).select("image.*").where(is_supported(F.col("origin")))

    @pandas_udf("binary")
    def bgr(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
        rows = zip(data, height, width, channels, strict=True)
        return pd.Series([normalised(np.frombuffer(d, np.uint8).reshape(h, w, n)).tobytes() if n in (1, 3, 4) else None for d, h, w, n in rows])

    out = img.withColumn("bgr", bgr("data", "height", "width", "nChannels"))
    failed = F.col("bgr").isNull()
    shown = lambda c: F.when(~failed, F.col(c)).alias(c)
    return out.select(F.col("origin").alias("path"), shown("width"), shown("height"), "bgr", failed.alias("failed"))


def proxies(photos: DataFrame, longest: int = 1600) -> DataFrame:
    """`photos` (path, orientation, width, height, bgr) turned and made smaller, never larger.

    Adds proxy_width, proxy_height and proxy, raw BGR bytes. One photo is in memory at a time.
    """
    schema = "path string, width int, height int, proxy_width int, proxy_height int, proxy binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, orientation, w, h, bgr in batch[["path", "orientation", "width", "height", "bgr"]].itertuples(index=False):
                img = oriented(np.frombuffer(bgr, np.uint8).reshape(h, w, 3), int(orientation or 1))
                h, w = img.shape[:2]
                scale = min(1.0, longest / max(w, h))
                pw, ph = max(1, round(w * scale)), max(1, round(h * scale))
                small = np.rint(resized(img, pw, ph)).astype(np.uint8) if scale < 1 else img
                yield pd.DataFrame({"path": [path], "width": [w], "height": [h], "proxy_width": [pw], "proxy_height": [ph], "proxy": [small.tobytes()]})

    return photos.where("bgr IS NOT NULL").select("path", "orientation", "width", "height", "bgr").mapInPandas(run, schema)


def kept_proxies(files: DataFrame, folder: str, longest: int = 1600) -> DataFrame:
    """The proxies of `files` (those of `photo_files`), from a table in `folder` that is added to where one is missing.

    A file's key is its path, length and time of change, so a changed file gets a new proxy.
    """
    spark = files.sparkSession
    keyed = files.select("path", exif_of("content")["orientation"].alias("orientation"), cache_key(F.col("path"), F.col("length"), F.unix_timestamp("modificationTime"), "proxy").alias("key"))
    try:
        known = spark.read.parquet(folder)
    except AnalysisException:  # the first time
        known = None
    missing = keyed if known is None else keyed.join(known.select("key"), "key", "left_anti")
    paths = [r.path for r in missing.select("path").toLocalIterator()]
    if paths:
        read = decoded(spark, *paths).withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))
        made = proxies(read.join(missing, "path"), longest)
        made.join(missing.select("path", "key"), "path").write.mode("append").parquet(folder)
    return spark.read.parquet(folder).join(keyed.select("key"), "key", "left_semi")


def thumbs(photos: DataFrame, longest: int = 360) -> DataFrame:
    """(path, thumb_width, thumb_height, thumb): the proxies of `proxies` made smaller still, raw BGR bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, w, h, bgr in batch.itertuples(index=False):
                scale = min(1.0, longest / max(w, h))
                tw, th = max(1, round(w * scale)), max(1, round(h * scale))
                small = np.rint(resized(np.frombuffer(bgr, np.uint8).reshape(h, w, 3), tw, th)).astype(np.uint8)
                yield pd.DataFrame({"path": [path], "thumb_width": [tw], "thumb_height": [th], "thumb": [small.tobytes()]})

    return photos.select("path", "proxy_width", "proxy_height", "proxy").mapInPandas(run, "path string, thumb_width int, thumb_height int, thumb binary")


def synthetic_scene(seed: int = 1, width: int = 4000, height: int = 2000) -> np.ndarray:
    """An equirectangular test scene: coloured 40-pixel blocks and 3000 discs."""
    rng = np.random.default_rng(seed)
    img = rng.integers(0, 255, (height // 40, width // 40, 3), dtype=np.uint8).repeat(40, axis=0).repeat(40, axis=1)
    for _ in range(3000):
        x, y, r = int(rng.integers(0, width)), int(rng.integers(0, height)), int(rng.integers(4, 30))
        y0, y1, x0, x1 = max(0, y - r), min(height, y + r + 1), max(0, x - r), min(width, x + r + 1)
        yy, xx = np.ogrid[y0:y1, x0:x1]
        img[y0:y1, x0:x1][(yy - y) ** 2 + (xx - x) ** 2 <= r * r] = rng.integers(0, 255, 3)
    return img
