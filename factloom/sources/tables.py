"""Reading, writing, merging and validating the store's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those of equal keys; of several new rows of a key the last by column order wins."""
    others = [c for c in old.columns if c not in keys]
    latest = new.select(*old.columns).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in others]))).where("_n = 1").drop("_n")
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(latest)


def json_lines(rows: DataFrame, kind: str) -> DataFrame:
    """One column `value`: a JSON text for each row, with its kind."""
    return rows.select(F.to_json(F.struct(F.lit(kind).alias("type"), F.struct("*").alias("row"))).alias("value"))


def write_json_lines(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Every table as JSON lines below path, and a manifest of kind, rows and digest."""
    spark = next(iter(tables.values())).sparkSession
    manifest = None
    for kind, rows in tables.items():
        lines = json_lines(rows, kind)
        lines.write.mode("overwrite").text(f"{path}/{kind}")
        written = spark.read.text(f"{path}/{kind}")
        # The order of lines is free: the digest is that of the sum of the lines' hashes.
        one = written.agg(F.lit(kind).alias("kind"), F.count("*").alias("rows"), F.sha2(F.sum(F.xxhash64("value").cast("decimal(38,0)")).cast("string"), 256).alias("digest"))
        manifest = one if manifest is None else manifest.union(one)
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def from_json_lines(lines: DataFrame, schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """The tables of JSON lines by kind, in the given schemas; lines of other kinds are left out."""
    kind = F.get_json_object("value", "$.type")
    return {name: lines.where(kind == name).select(F.from_json("value", T.StructType([T.StructField("row", schema)]))["row"].alias("row")).select("row.*") for name, schema in schemas.items()}


def rejected_lines(lines: DataFrame, kinds: list[str], most: int = 1_000_000) -> DataFrame:
    """(reason, n) of lines that an import refuses: too long, not JSON, or of an unknown kind."""
    kind = F.get_json_object("value", "$.type")
    reason = F.when(F.length("value") > most, "too_long").when(kind.isNull(), "malformed").when(~kind.isin(kinds), "unknown_kind")
    return lines.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def backup(tables: dict[str, DataFrame], path: str) -> None:
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def restore(spark: SparkSession, path: str, schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """The tables of a backup; one whose columns differ from the schema is refused."""
    out = {}
    for name, schema in schemas.items():
        rows = spark.read.parquet(f"{path}/{name}")
        if [(f.name, f.dataType) for f in rows.schema] != [(f.name, f.dataType) for f in schema]:
            raise ValueError(f"{name}: the backup has another schema")
        out[name] = rows
    return out


def manifest(kinds: dict[str, DataFrame]) -> DataFrame:
    """(kind, rows, bytes, digest) of each kind's rows as JSON lines. The digest is the same in whatever order the lines come."""
    out = None
    for kind, rows in kinds.items():
        line = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
        number = F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("long")
        part = rows.agg(F.lit(kind).alias("kind"), F.count("*").alias("rows"), F.sum(F.octet_length(line)).alias("bytes"), F.sum(number.cast("decimal(38,0)")).cast("string").alias("digest"))
        out = part if out is None else out.unionByName(part)
    return out


def complete_lines(lines: DataFrame, file: str, place: str, value: str = "value") -> DataFrame:
    """Lines of JSON without an incomplete last line of a file; a broken line elsewhere is an error when it is read."""
    last = lines.groupBy(file).agg(F.max(place).alias("last_place"))
    broken = F.try_parse_json(value).isNull()
    return lines.join(last, file).where(~((F.col(place) == F.col("last_place")) & broken)).drop("last_place")
