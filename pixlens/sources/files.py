"""Image bytes of uploads (SRC2): any folder that Spark can read, as (upload_id, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_upload_files(spark: SparkSession, folder: str, uploads: DataFrame, glob: str = "*") -> DataFrame:
    """The bytes of the files under ``folder`` whose name is an upload's original or stored file name.

    A stored file is ``<folder>/.../<last part of the upload's url>``. Spark reads the files in the
    tasks that need them; an upload without file has no row.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
             .select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content"))
    names = uploads.select(F.col("id").alias("upload_id"), F.regexp_extract("url", r"([^/]+)$", 1).alias("name"))
    return names.join(files, "name").select("upload_id", "content")
