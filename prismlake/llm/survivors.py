"""The surviving record of each group of copies, field by field, and a truth model of the values that disagree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.operators.components import components
from prismlake.tables import cut


def groups(pairs: DataFrame) -> DataFrame:
    """(media_id, group_id) of connected pairs(media_a, media_b); group_id is the smallest media id in the group."""
    found = components(pairs.select(F.col("media_a").alias("a"), F.col("media_b").alias("b")))
    return found.select(F.col("node").alias("media_id"), F.col("component").alias("group_id"))


def measured(c: str, low: float, high: float | None):
    """A measurement that counts: measured at all, not null, not NaN, in range."""
    ok = (F.col("qualityVersion") > 0) & F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) >= low)
    return ok & (F.col(c) <= high) if high is not None else ok


def survivors(members: DataFrame, analysis: DataFrame, media: DataFrame) -> DataFrame:
    """(group_id, field, media_id): the member whose sharpness, brightness or dateTaken survives.

    members(media_id, group_id); analysis(mediaId, sharpness, brightness, qualityVersion) and media(id, dateTaken,
    dateModified, size, width, height) hold one row an id. A measurement needs qualityVersion > 0; the highest version
    wins, then most pixels, largest size, smallest id; null sizes count least. dateTaken needs to be from 2000-01-01 on
    and not after dateModified; the earliest wins, then the smallest id. Fields without a usable value give no row, nor
    do members without a row in either table count. A group of any size is reduced by partial aggregation.
    """
    pixels = F.coalesce(F.col("width").cast("long") * F.col("height").cast("long"), F.lit(-1))
    rows = members.join(analysis.select(F.col("mediaId").alias("media_id"), "sharpness", "brightness", "qualityVersion"), "media_id", "left")
    rows = rows.join(media.select(F.col("id").alias("media_id"), "dateTaken", "dateModified", F.coalesce("size", F.lit(-1)).alias("size"), pixels.alias("pixels")), "media_id", "left")
    order = F.struct("qualityVersion", F.coalesce("pixels", F.lit(-1)), F.coalesce("size", F.lit(-1)), (-F.col("media_id")).alias("m"))
    dated = (F.col("dateTaken") >= F.lit("2000-01-01").cast("timestamp_ntz")) & (F.col("dateTaken") <= F.col("dateModified"))
    found = rows.groupBy("group_id").agg(
        (-F.max(F.when(measured("sharpness", 0, None), order))["m"]).alias("sharpness"),
        (-F.max(F.when(measured("brightness", 0, 1), order))["m"]).alias("brightness"),
        F.min(F.when(dated, F.struct("dateTaken", "media_id")))["media_id"].alias("dateTaken"),
    )
    return found.unpivot("group_id", ["sharpness", "brightness", "dateTaken"], "field", "media_id").where("media_id is not null")


#: Prior counts of the truth model: of false values (few are claimed), of true ones, and of truth itself.
PRIOR = {"false": (1.0, 9.0), "true": (5.0, 5.0), "truth": (1.0, 1.0)}


def truths(claims: DataFrame, rounds: int = 8, least: float = 0.5) -> DataFrame:
    """(subject, field, value, belief, kept): which of the claimed values are true, by a latent two-sided model.

    claims(subject, field, value, source). A source that speaks of a subject's field asserts the values it claims and
    denies the others claimed there by anyone. Each source has a sensitivity (share of true values it asserts) and a
    specificity (share of false values it doesn't); both, and each value's belief, are found by expectation-
    maximisation. A field may have several true values: kept marks every one with belief >= least. Values with equal
    votes by the same sources share their belief, so the iteration runs over distinct vote patterns, weighted by how
    many values have them. Rows with a null anywhere are dropped; repeated claims count once; no claims, no rows.
    """
    claims = claims.select("subject", "field", "value", F.col("source").cast("string").alias("source")).dropna().distinct()
    claims = cut(claims, "truth-claims")
    values = claims.select("subject", "field", "value").distinct()
    speak = claims.select("subject", "field", "source").distinct()
    votes = values.join(speak, ["subject", "field"]).join(claims.withColumn("said", F.lit(1)), ["subject", "field", "value", "source"], "left")
    votes = votes.groupBy("subject", "field", "value").agg(F.array_sort(F.collect_set(F.struct("source", F.coalesce("said", F.lit(0)).alias("said")))).alias("pattern"))
    votes = cut(votes, "truth-votes")
    patterns = cut(votes.groupBy("field", "pattern").agg(F.count("*").alias("weight")), "truth-patterns")
    spread = patterns.withColumn("key", F.xxhash64("field", F.to_json("pattern"))).select("key", "field", "weight", F.explode("pattern").alias("v")).select("key", "field", "weight", "v.source", "v.said")
    # At first a value's belief is the share of its speakers that assert it.
    belief = spread.groupBy("key").agg(F.avg("said").alias("belief"))
    for _ in range(rounds):
        seen = spread.join(belief, "key")
        mass = lambda said, true: F.sum(F.when(F.col("said") == said, F.col("weight") * (F.col("belief") if true else 1 - F.col("belief"))).otherwise(0.0))
        source = seen.groupBy("field", "source").agg(
            ((mass(1, True) + PRIOR["true"][0]) / (mass(1, True) + mass(0, True) + sum(PRIOR["true"]))).alias("sensitivity"),
            ((mass(0, False) + PRIOR["false"][1]) / (mass(1, False) + mass(0, False) + sum(PRIOR["false"]))).alias("specificity"),
        )
        odds = F.when(F.col("said") == 1, F.log(F.col("sensitivity") / (1 - F.col("specificity")))).otherwise(F.log((1 - F.col("sensitivity")) / F.col("specificity")))
        prior = PRIOR["truth"][0] / sum(PRIOR["truth"])
        belief = spread.join(F.broadcast(source), ["field", "source"]).groupBy("key").agg((1 / (1 + F.exp(-(F.sum(odds) + F.log(F.lit(prior / (1 - prior))))))).alias("belief"))
        belief = cut(belief, "truth-belief")
    found = votes.withColumn("key", F.xxhash64("field", F.to_json("pattern"))).join(belief, "key")
    return found.select("subject", "field", "value", "belief", (F.col("belief") >= least).alias("kept"))
