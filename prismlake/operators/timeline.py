"""The media timeline: visibility, filters, sections, paging, and clean-up lists."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismlake.conf import CONF
from prismlake.tables import numbered

# What marks a screenshot or screen recording in a name.
MARKERS = ("screenshot", "screen_record", "screenrecord", "screen record", "скриншот")


def scored(media: DataFrame, analysis: DataFrame) -> DataFrame:
    """media with the sensitive score of its analysis; media without one keep a null."""
    return media.join(analysis.select(F.col("mediaId").alias("id"), "sensitiveScore"), "id", "left")


def is_visible(threshold: float, show: bool = False) -> Column:
    """Not above the threshold; an unknown score is visible."""
    return F.lit(True) if show else F.col("sensitiveScore").isNull() | (F.col("sensitiveScore") < threshold)


def is_hidden(threshold: float) -> Column:
    """Hidden by hand or by score; an unknown score isn't."""
    return F.col("isHiddenByUser") | F.coalesce(F.col("sensitiveScore") >= threshold, F.lit(False))


def shown(threshold: float, hide: bool = True) -> Column:
    """Of scored media: neither hidden by hand nor, if sensitive ones are hidden, at the threshold; no score counts 0."""
    kept = ~F.coalesce("isHiddenByUser", F.lit(False))
    return kept & (F.coalesce("sensitiveScore", F.lit(0.0)) < threshold) if hide else kept


def not_hidden(media: DataFrame) -> DataFrame:
    return media.where(~F.coalesce("isHiddenByUser", F.lit(False)))


def favourites(media: DataFrame, analysis: DataFrame) -> DataFrame:
    """Favourites that aren't hidden by hand, whatever their score, newest first."""
    return scored(not_hidden(media).where("isFavorite"), analysis).orderBy(F.col("dateTaken").desc_nulls_last(), F.desc("id"))


def visible(media: DataFrame, analysis: DataFrame, threshold: float = CONF.sensitive_threshold, show: bool = not CONF.hide_sensitive) -> DataFrame:
    """Media that are neither hidden by hand nor, unless shown, sensitive; in no order."""
    return scored(not_hidden(media), analysis).where(is_visible(threshold, show))


def timeline(media: DataFrame, analysis: DataFrame, threshold: float = CONF.sensitive_threshold, show: bool = not CONF.hide_sensitive, bucket: int | None = None) -> DataFrame:
    """Visible media, newest first, then by larger id; nulls of dateTaken last."""
    rows = visible(media, analysis, threshold, show)
    if bucket is not None:
        rows = rows.where(F.col("bucketId") == bucket)
    return rows.orderBy(F.col("dateTaken").desc_nulls_last(), F.desc("id"))


def hidden(media: DataFrame, analysis: DataFrame, threshold: float = CONF.sensitive_threshold) -> DataFrame:
    return scored(media, analysis).where(is_hidden(threshold)).orderBy(F.col("dateTaken").desc_nulls_last(), F.desc("id"))


@dataclass(frozen=True)
class Criteria:
    people: tuple[int, ...] = ()
    cities: tuple[int, ...] = ()
    months: tuple[int, ...] = ()
    since: datetime | None = None
    until: datetime | None = None
    media_type: int | None = None
    favourite: bool = False
    empty: bool = field(init=False, default=False)

    def __post_init__(self):
        object.__setattr__(self, "empty", not (self.people or self.cities or self.months or self.since or self.until or self.media_type is not None or self.favourite))


def select_media(media: DataFrame, criteria: Criteria, person_media: DataFrame | None = None, city_media: DataFrame | None = None) -> DataFrame:
    """Media (as a rule the visible ones) that meet all criteria: every person, any of the cities, any of the months, dates in [since, until)."""
    rows = media
    if criteria.months:
        rows = rows.where(F.month("dateTaken").isin(*criteria.months))
    if criteria.since is not None:
        rows = rows.where(F.col("dateTaken") >= F.lit(criteria.since).cast("timestamp_ntz"))
    if criteria.until is not None:
        rows = rows.where(F.col("dateTaken") < F.lit(criteria.until).cast("timestamp_ntz"))
    if criteria.media_type is not None:
        rows = rows.where(F.col("mediaType") == criteria.media_type)
    if criteria.favourite:
        rows = rows.where("isFavorite")
    for person in criteria.people:
        rows = rows.join(person_media.where(F.col("personId") == person).select(F.col("mediaId").alias("id")), "id", "left_semi")
    if criteria.cities:
        rows = rows.join(city_media.where(F.col("cityId").isin(*criteria.cities)).select(F.col("mediaId").alias("id")), "id", "left_semi")
    return rows


def years(media: DataFrame) -> DataFrame:
    return media.where("dateTaken is not null").select(F.year("dateTaken").alias("year")).distinct().orderBy(F.desc("year"))


def sections(media: DataFrame, columns: int) -> DataFrame:
    """Headers of a grid: a day each, or a month each from five columns on."""
    unit = "month" if columns >= 5 else "day"
    return media.where("dateTaken is not null").groupBy(F.date_trunc(unit, F.col("dateTaken").cast("timestamp")).cast("date").alias("section")).agg(F.count("*").alias("items")).orderBy(F.desc("section"))


def keyset_page(rows: DataFrame, size: int, date: datetime | None = None, last_id: int | None = None) -> DataFrame:
    """The next page in (dateTaken desc, id desc) after a row; the first one without."""
    if date is not None:
        at = F.lit(date).cast("timestamp_ntz")
        rows = rows.where((F.col("dateTaken") < at) | ((F.col("dateTaken") == at) & (F.col("id") < last_id)))
    return rows.where("dateTaken is not null").orderBy(F.desc("dateTaken"), F.desc("id")).limit(size)


def in_order(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ids(id, pos) in the given order; ids without a row drop out."""
    return ids.join(rows, "id").orderBy("pos")


def between_positions(rows: DataFrame, order: list, anchor: int, current: int) -> DataFrame:
    """The inclusive range between two positions (from 0) of an ordering, which should end in a unique column."""
    low, high = sorted((anchor, current))
    return numbered(rows, *order, position="pos").where(F.col("pos").between(low, high))


def every(rows: DataFrame, order: list, most: int) -> DataFrame:
    """Every step-th row of an ordering, the step being the largest that leaves at least `most` of them (or all)."""
    at = numbered(rows, *order, position="pos", total="n")
    return at.where(F.col("pos") % F.greatest(F.lit(1), F.floor(F.col("n") / most)) == 0).drop("pos", "n")


def parted(rows: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass a test, and those that don't; a null test doesn't pass."""
    test = F.coalesce(keep, F.lit(False))
    return rows.where(test), rows.where(~test)


def is_screenshot() -> Column:
    """A marker in the album's or the file's name, in any case."""
    test = F.lit(False)
    for c in ("bucketName", "displayName"):
        for m in MARKERS:
            test = test | F.coalesce(F.lower(c).contains(m), F.lit(False))
    return test


def screenshots(media: DataFrame) -> DataFrame:
    """Screenshots and screen recordings of (as a rule visible) media."""
    return media.where(is_screenshot())


def photos(media: DataFrame) -> DataFrame:
    """Pictures that aren't screenshots."""
    return media.where((F.col("mediaType") == 0) & ~is_screenshot())


def poor(media: DataFrame, analysis: DataFrame, blurred_below: float = CONF.blurred_below, dark_below: float = CONF.dark_below) -> DataFrame:
    """Blurred or dark pictures of (as a rule visible) media, worst first; unmeasured ones, screenshots and videos aren't among them."""
    measured = analysis.where(F.col("sharpness").isNotNull() & ~F.isnan("sharpness") & F.col("brightness").isNotNull() & ~F.isnan("brightness")).select(F.col("mediaId").alias("id"), "sharpness", "brightness")
    rows = photos(media).join(measured, "id")
    return rows.where((F.col("sharpness") < blurred_below) | (F.col("brightness") < dark_below)).orderBy("sharpness", "id")


def large_videos(media: DataFrame, least: int = CONF.large_video_bytes) -> DataFrame:
    return media.where((F.col("mediaType") == 1) & (F.col("size") >= least)).orderBy(F.desc("size"), "id")


def albums(media: DataFrame) -> DataFrame:
    """Albums of media not hidden by hand, newest first: size, greatest path, name and cover of the newest item.

    Ties go to the largest id; scores don't matter. Media without a bucket make one album without a cover.
    """
    rows = not_hidden(media)
    newest = F.struct(F.coalesce("dateTaken", F.lit("0001-01-01").cast("timestamp_ntz")).alias("d"), "id")
    return rows.groupBy("bucketId").agg(F.max_by("bucketName", newest).alias("name"), F.max("relativePath").alias("relativePath"), F.max_by(F.when(F.col("bucketId").isNotNull(), F.col("uri")), newest).alias("cover"), F.count("*").alias("items"), F.max("dateTaken").alias("newest")).orderBy(F.col("newest").desc_nulls_last(), "bucketId")


def smart_albums(album: DataFrame, member: DataFrame, media: DataFrame) -> DataFrame:
    """Albums with the count of members not hidden by hand, and a cover: the medoid if among them, else the first of them.

    An album without any is left out.
    """
    rows = not_hidden(media).select(F.col("id").alias("mediaId"), "uri")
    seen = member.join(rows, "mediaId").join(album.select(F.col("id").alias("albumId"), "name", "coverMediaId", F.col("position").alias("albumPosition")), "albumId")
    first = F.struct((F.col("mediaId") != F.col("coverMediaId")).alias("other"), "position", "mediaId")
    return seen.groupBy("albumId", "name", "albumPosition").agg(F.min_by("uri", first).alias("cover"), F.count("*").alias("items")).orderBy("albumPosition", "albumId")


def smart_album_items(album: int, member: DataFrame, media: DataFrame, analysis: DataFrame, threshold: float = CONF.sensitive_threshold, show: bool = not CONF.hide_sensitive) -> DataFrame:
    """The visible media of a smart album, newest first."""
    rows = member.where(F.col("albumId") == album).select(F.col("mediaId").alias("id")).distinct()
    return timeline(media.join(rows, "id", "left_semi"), analysis, threshold, show)
