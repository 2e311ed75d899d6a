"""Cities of media: nearest by distance and size, counts by city and country."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismlake.functions.geo import finite, flat_km


def city_of(media: DataFrame, city: DataFrame, most_km: float = 30.0) -> DataFrame:
    """(mediaId, cityId): for media(mediaId, latitude, longitude) the city within most_km of least km / (1 + population / 5e6).

    Cities are looked up in the nine one-degree cells around a point, columns read modulo 360; the distance itself is flat
    and doesn't wrap at the date line. Ties go to the smaller id. Coordinates must be finite and in range.
    """
    cell = lambda lat, lon: (F.floor(lat).cast("int"), F.pmod(F.floor(lon), F.lit(360)).cast("int"))
    row, column = cell(F.col("lat"), F.col("lon"))
    around = F.array(*[F.struct((row + i).alias("row"), F.pmod(column + j, F.lit(360)).alias("column")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    cells = city.where(finite(F.col("lat")) & finite(F.col("lon"))).select(F.col("id").alias("cityId"), "lat", "lon", "population", F.explode(around).alias("cell"))
    row, column = cell(F.col("latitude"), F.col("longitude"))
    rows = media.where(finite(F.col("latitude")) & finite(F.col("longitude")) & (F.abs("latitude") <= 90) & (F.abs("longitude") <= 180))
    rows = rows.select("mediaId", "latitude", "longitude", F.struct(row.alias("row"), column.alias("column")).alias("cell"))
    km = flat_km(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon"))
    near = rows.join(cells, "cell").withColumn("km", km).where(F.col("km") <= most_km)
    score = F.col("km") / (1 + F.coalesce("population", F.lit(0)) / 5e6)
    return near.groupBy("mediaId").agg(F.min(F.struct(score.alias("s"), "cityId"))["cityId"].alias("cityId"))


def counts(located: DataFrame, city: DataFrame) -> DataFrame:
    """Cities by falling number of media."""
    return located.groupBy("cityId").agg(F.count("*").alias("items")).join(city.select(F.col("id").alias("cityId"), "name", "countryCode"), "cityId").orderBy(F.desc("items"), "cityId")


def countries(counted: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Countries by falling number of media; one without a name goes by its code."""
    rows = counted.groupBy("countryCode").agg(F.sum("items").alias("items"), F.count("*").alias("cities"))
    if names is not None:
        rows = rows.join(names.select(F.col("code").alias("countryCode"), F.col("name").alias("country")), "countryCode", "left")
        return rows.select("countryCode", F.coalesce("country", "countryCode").alias("country"), "items", "cities").orderBy(F.desc("items"), "countryCode")
    return rows.orderBy(F.desc("items"), "countryCode")


def best_names(names: DataFrame, language: str = "ru") -> DataFrame:
    """(geonameId, name): of names(geonameId, lang, name, preferred, short, colloquial, historic, seq) in a language the best.

    Colloquial and historic ones don't count; preferred ones come first, short ones last, then the order of the file.
    """
    rows = names.where((F.col("lang") == language) & ~F.coalesce("colloquial", F.lit(False)) & ~F.coalesce("historic", F.lit(False)))
    rank = F.when(F.col("preferred"), 0).when(F.col("short"), 2).otherwise(1)
    order = Window.partitionBy("geonameId").orderBy(rank, "seq")
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").select("geonameId", "name")
