"""The usable vectors of the two kinds of item: media and face."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.operators.cells import usable
from prismlake.tables import latest, table

MEDIA_DIM, FACE_DIM = 96, 128


def media_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec) of all usable current vectors of media_analysis."""
    rows = latest(table(spark, sf_dir, "media_analysis").select("mediaId", "sourceModified", "embedding"), "mediaId", "sourceModified")
    return rows.where(usable(F.col("embedding"), MEDIA_DIM)).select(F.col("mediaId").alias("id"), F.col("embedding").alias("vec"))


def face_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec) of all usable vectors of faces of the current model that aren't artifacts; repeated rows are left in."""
    rows = table(spark, sf_dir, "face").where("embedVersion = 2 and not coalesce(isArtifact, false)").select("id", "embedding")
    rows = rows.where(usable(F.col("embedding"), FACE_DIM) & F.col("id").isNotNull())
    return rows.select("id", F.col("embedding").alias("vec"))
