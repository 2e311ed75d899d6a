"""Work queues by version stamps, for every stage of the indexing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def analysis(media: DataFrame, done: DataFrame, version: int, embedder: bool = True, classifier: bool = True) -> DataFrame:
    """Media that are new, changed, of an older version, or readable without a result that a model could now give."""
    rows = media.join(done.select(F.col("mediaId").alias("id"), "sourceModified", "pipelineVersion", "isUnreadable", F.col("embedding").isNull().alias("noVector"), F.col("sensitiveScore").isNull().alias("noScore"), F.lit(True).alias("known")), "id", "left")
    stale = F.col("known").isNull() | (F.col("pipelineVersion") < version) | (F.col("sourceModified") != F.col("dateModified"))
    lacking = ~F.col("isUnreadable") & ((F.lit(embedder) & F.col("noVector")) | (F.lit(classifier) & F.col("noScore")))
    return rows.where(stale | lacking).select(*media.columns)


def stage(media: DataFrame, done: DataFrame, column: str, version: int, only_images: bool = False) -> DataFrame:
    """Readable, analysed media whose stamp of one stage is behind."""
    rows = media.join(done.where(~F.col("isUnreadable") & (F.col(column) < version)).select(F.col("mediaId").alias("id")), "id", "left_semi")
    return rows.where("mediaType = 0") if only_images else rows


def text_or_codes(media: DataFrame, done: DataFrame, text: int, codes: int) -> DataFrame:
    return media.where("mediaType = 0").join(done.where(~F.col("isUnreadable") & ((F.col("textVersion") < text) | (F.col("codesVersion") < codes))).select(F.col("mediaId").alias("id")), "id", "left_semi")


def reembed(face: DataFrame, version: int) -> DataFrame:
    return face.where(F.col("embedVersion") != version)


def reset(done: DataFrame, column: str, changed: bool) -> DataFrame:
    """All stamps of a stage go back to 0 when its settings change."""
    return done.withColumn(column, F.lit(0)) if changed else done
