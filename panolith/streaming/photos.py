"""A folder of photos as a stream: tags of new files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panolith.functions.tags import is_supported
from panolith.sources.photos import exif_of, header_size

BINARY = "path string, modificationTime timestamp, length long, content binary"


def photo_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """(path, modificationTime, width, height, exif) of photos that come into the folder, each once."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", files_per_batch).load(folder)
    size = header_size("content")
    known = files.where(is_supported(F.col("path"))).select("path", "modificationTime", size.alias("s"), exif_of("content").alias("exif"))
    return known.select("path", "modificationTime", "s.width", "s.height", "exif")
