"""Sources and sinks: media scans, city tables, geographic names, manifests, images, vocabularies, exports."""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.operators.places import best_names

CITIES = "id bigint, lat double, lon double, name string, countryCode string, population string"


def scan_media(rows: DataFrame, types: tuple[int, ...] = (0, 1)) -> DataFrame:
    """The catalogue's rows: dateTaken falls back to dateAdded (seconds), null strings are empty."""
    taken = F.when(F.col("dateTakenMs") > 0, F.col("dateTakenMs")).otherwise(F.col("dateAdded") * 1000)
    text = {c: F.coalesce(c, F.lit("")) for c in ("displayName", "bucketName", "relativePath", "mimeType") if c in rows.columns}
    return rows.where(F.col("mediaType").isin(*types)).withColumns({"dateTaken": F.timestamp_millis(taken), **text})


def read_cities(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated city table; rows of fewer than six fields are dropped, a population that is no number counts 0."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 6)
    return rows.select(F.col("f")[0].try_cast("bigint").alias("id"), F.col("f")[3].alias("name"), F.col("f")[4].alias("countryCode"), F.coalesce(F.col("f")[5].try_cast("int"), F.lit(0)).alias("population"), F.col("f")[1].try_cast("double").alias("lat"), F.col("f")[2].try_cast("double").alias("lon")).where("id is not null and lat is not null and lon is not null")


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    """(code, name) of a tab-separated table; of a repeated code the last line counts."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f"), F.monotonically_increasing_id().alias("n")).where(F.size("f") >= 2)
    return rows.groupBy(F.col("f")[0].alias("code")).agg(F.max_by(F.col("f")[1], "n").alias("name"))


def build_cities(cities: DataFrame, names: DataFrame, language: str = "ru") -> DataFrame:
    """Cities with their best name in a language, else their own; coordinates to four places, as text."""
    named = cities.join(best_names(names, language).select(F.col("geonameId").alias("id"), F.col("name").alias("local")), "id", "left")
    return named.select("id", F.format_string("%.4f", "lat").alias("lat"), F.format_string("%.4f", "lon").alias("lon"), F.coalesce("local", "name").alias("name"), "countryCode", "population")


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("sep", "\t").csv(path)


def read_manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(path, group, size, sha256) of a manifest's files: one object that lists them all, or one a line."""
    if lines:
        return spark.read.schema("path string, `group` string, size bigint, sha256 string").json(path)
    schema = "files array<struct<path: string, `group`: string, size: bigint, sha256: string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("files").alias("f")).select("f.*")


def build_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of all files below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def read_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def read_vocabulary(path: str) -> dict[str, int]:
    """token -> id: a JSON map, or a text whose line numbers are the ids."""
    with open(path, encoding="utf-8") as f:
        return json.load(f) if path.endswith(".json") else {line.rstrip("\n"): i for i, line in enumerate(f)}


def read_merges(path: str) -> dict[tuple[str, str], int]:
    """pair -> rank in the order of the file; blank lines and the version line are skipped."""
    with open(path, encoding="utf-8") as f:
        pairs = [tuple(line.split()) for line in f if line.strip() and not line.startswith("#version")]
    return {p: i for i, p in enumerate(pairs) if len(p) == 2}


def floats(content: bytes) -> list[float]:
    """Little-endian float32 bytes as numbers."""
    return np.frombuffer(content, dtype="<f4").tolist()


def to_bytes(vector: list[float]) -> bytes:
    return np.asarray(vector, dtype="<f4").tobytes()


def decode_vectors(rows: DataFrame, column: str) -> DataFrame:
    """A column of float32 bytes as array<float>."""
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<float>")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))

    return rows.withColumn(column, decode(column))


def fingerprint(path: str) -> str:
    """Size and time of a file."""
    s = os.stat(path)
    return f"{s.st_size}-{int(s.st_mtime)}"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def cached(spark: SparkSession, folder: str, parts: list[str], build) -> DataFrame:
    """The table built for these parts, from the folder if it is there whole under their hash; other parts are a miss.

    A table that is there but can't be read is an error, not a miss.
    """
    key = hashlib.sha256("\0".join(parts).encode()).hexdigest()
    path = f"{folder.rstrip('/')}/{key}"
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_manifest(rows: DataFrame, path: str) -> None:
    """rows(path, size, sha256, group) as JSON, one file a line."""
    rows.write.mode("overwrite").json(path)


def export_faces(face: DataFrame, path: str) -> None:
    """Faces as a table, with their vectors as bytes."""
    face.write.mode("overwrite").parquet(path)


def export_all(tables: dict[str, DataFrame], path: str) -> None:
    """Each of faces, rejections, media and persons below a folder: faces as parquet, the rest as tab-separated text."""
    for name, rows in tables.items():
        where = f"{path.rstrip('/')}/{name}"
        export_faces(rows, where) if name == "faces" else write_tsv(rows, where)
