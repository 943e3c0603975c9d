"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import zlib

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a session on one machine that names none gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def kept_path(spark: SparkSession, kind: str, source: str) -> str:
    """Where the index of a source is kept between calls."""
    return f"{shared_dir(spark)}/index-{kind}-{zlib.crc32(source.encode()):08x}"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def segment(spark: SparkSession, path: str, names: list[str], schema) -> DataFrame:
    """Rows of the named segment folders below path, with the column seg; of none an empty table."""
    if not names:
        return spark.createDataFrame([], schema).selectExpr("*", "cast(null as string) as seg")
    return spark.read.schema(f"{schema}, seg string").option("basePath", path).parquet(*[f"{path}/seg={n}" for n in names])
