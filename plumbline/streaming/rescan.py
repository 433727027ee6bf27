"""Features of image files as they arrive, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.image_bytes import magic_format
from ..operators.audits import ext_format
from ..sources.images import META, _is_image, _meta, _plain

_SOURCE = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """A stream of the byte-level features of new image files below a folder. Like the batch source it skips empty and hidden files."""
    raw = spark.readStream.format("binaryFile").schema(_SOURCE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", most_files).load(folder)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    raw = raw.where(_is_image(F.col("path")))
    raw = raw.select(_plain(F.col("path")).alias("path"), F.col("length").alias("bytes"), ext.alias("ext"), ext_format(ext).alias("ext_format"), magic_format(F.col("content")).alias("magic_format"), F.sha2("content", 256).alias("sha256"), "content")
    return raw.mapInPandas(_meta, META)


def rescan(spark: SparkSession, folder: str, to: str, checkpoint: str) -> int:
    """Processes what arrived since the last call and appends it to a Parquet table, each file once, also across failures. Returns the rows of
    this call."""
    q = arriving(spark, folder).writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(p["numInputRows"] for p in q.recentProgress)
