"""Current rows of the tables, in Spark and in SQL, and small tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.tables import latest, table

MEDIA_DIM, FACE_DIM = 96, 128

SQL = """
m as (select * exclude (rn) from (select *, row_number() over (partition by id order by dateModified desc) as rn from media) where rn = 1),
a as (select * exclude (rn) from (select *, row_number() over (partition by mediaId order by sourceModified desc) as rn from media_analysis) where rn = 1),
f as (select * exclude (rn) from (select *, row_number() over (partition by id order by mediaId) as rn from face) where rn = 1),
p as (select * exclude (rn) from (select *, row_number() over (partition by id order by position) as rn from person) where rn = 1),
t as (select * exclude (rn) from (select *, row_number() over (partition by mediaId order by lineCount) as rn from media_text) where rn = 1),
tag as (select distinct mediaId, lockedPersonId as personId from f where checked and lockedPersonId is not null),
pm as (select personId, mediaId from f where personId is not null union select personId, mediaId from tag),
sm as (select m.*, a.sensitiveScore from m left join a on a.mediaId = m.id),
visible as (select * from sm where not isHiddenByUser and (sensitiveScore is null or sensitiveScore::double < 0.7::double)),
mv as (select mediaId as id, embedding::double[] as v, sqrt(list_dot_product(embedding::double[], embedding::double[])) as nm from a where embedding is not null and len(embedding) = 96 and list_dot_product(embedding::double[], embedding::double[]) > 1e-24),
fv as (select id, mediaId, personId, lockedPersonId, isArtifact, embedding::double[] as v, sqrt(list_dot_product(embedding::double[], embedding::double[])) as nm from f where embedVersion = 2 and embedding is not null and len(embedding) = 128 and list_dot_product(embedding::double[], embedding::double[]) > 1e-24)
"""


def sql(body: str, more: str = "", recursive: bool = False) -> str:
    return ("with recursive " if recursive else "with ") + SQL + (f", {more}" if more else "") + body


def media(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "media"), "id", "dateModified")


def analysis(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "media_analysis"), "mediaId", "sourceModified")


def face(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "face"), "id")


def person(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "person"), "id")


def texts(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "media_text"), "mediaId")


def tags(spark: SparkSession, d: str) -> DataFrame:
    return face(spark, d).where("checked and lockedPersonId is not null").select("mediaId", F.col("lockedPersonId").alias("personId")).distinct()


def media_vectors(spark: SparkSession, d: str) -> DataFrame:
    from prismlake.operators.cells import usable

    return analysis(spark, d).where(usable(F.col("embedding"), MEDIA_DIM)).select(F.col("mediaId").alias("id"), F.col("embedding").alias("vec"))


def face_vectors(spark: SparkSession, d: str) -> DataFrame:
    from prismlake.operators.cells import usable

    return face(spark, d).where((F.col("embedVersion") == 2) & usable(F.col("embedding"), FACE_DIM)).select("id", "mediaId", "personId", "lockedPersonId", "isArtifact", "embedding")
