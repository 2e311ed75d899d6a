"""Queries over the library: timeline, albums, clean-up lists, statistics, snapshots, work queues, text search."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from prismlake.functions.dates import period
from prismlake.ml import reading
from prismlake.operators import cleanup, places, search, snapshots, timeline
from prismlake.plans.common import MEDIA_DIM, analysis, face, media, media_vectors, person, sql, tags, texts
from prismlake.streaming import pending
from prismlake.tables import latest, table

YEAR = period("year", datetime(2024, 5, 1), year=2019)
JUNE = timeline.Criteria(months=(6, 7, 8), since=datetime(2017, 1, 1), until=datetime(2022, 1, 1), media_type=0)


def top_bucket(spark, d):
    row = media(spark, d).where("bucketId is not null").groupBy("bucketId").count().orderBy(F.desc("count"), "bucketId").first()
    return row["bucketId"] if row else 0


def ranked_favourites(spark, d):
    """A hit list: the 200 largest favourites, whose order the result must keep."""
    top = media(spark, d).where("isFavorite").orderBy(F.desc("size"), "id").select("id", "size").limit(200)
    return top.select("id", F.row_number().over(Window.orderBy(F.desc("size"), "id")).alias("pos"))


def cities(spark, d):
    return latest(table(spark, d, "city"), "id")


def top_cities(spark, d):
    """The two cities with most media."""
    found = places.counts(located(spark, d), cities(spark, d)).limit(2).collect()
    return tuple(r["cityId"] for r in found) or (-1,)


def located(spark, d):
    return places.city_of(analysis(spark, d).select("mediaId", "latitude", "longitude"), cities(spark, d))


def visible(spark, d):
    return timeline.visible(media(spark, d), analysis(spark, d))


def with_hash(spark, d):
    from prismlake.operators.cells import usable

    vec = F.when(usable(F.col("embedding"), MEDIA_DIM), F.col("embedding"))
    rows = analysis(spark, d).where("perceptualHash is not null").select(F.col("mediaId").alias("id"), F.col("perceptualHash").alias("hash"), vec.alias("vec"))
    return rows.join(visible(spark, d).select("id", "width", "height", "mediaType", "durationMs"), "id")


def hybrid(spark, d):
    vectors = media_vectors(spark, d)
    own = vectors.orderBy("id").select("vec").first()
    seen = visible(spark, d)
    allowed = timeline.select_media(seen, JUNE).select("id", "dateTaken")
    return search.hybrid(seen, texts(spark, d), vectors, "the", list(own["vec"]) if own else None, allowed)


def clean_total(spark, d):
    m, a = visible(spark, d), analysis(spark, d)
    return cleanup.total_of([timeline.screenshots(m), timeline.poor(m, a), timeline.large_videos(m)])


def photo_vectors(spark, d):
    return timeline.photos(visible(spark, d)).select("id", "dateTaken").join(media_vectors(spark, d), "id", "left")


def series(spark, d):
    return cleanup.leader_series(photo_vectors(spark, d), MEDIA_DIM, SERIES_MS, 0.2)


def language_lines(spark, d):
    rows = latest(table(spark, d, "text_line"), "id").where("text is not null")
    return rows.select("mediaId", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("c").alias("language"), "text", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


#: Photos of the test tables lie hours apart, so their series need a longer gap (and a lower cosine) than a library's.
SERIES_MS = 6 * 3_600_000


QUERIES = {
    "timeline_visible": lambda s, d: timeline.timeline(media(s, d), analysis(s, d)).select("id", "dateTaken", "sensitiveScore"),
    "bucket_timeline": lambda s, d: timeline.timeline(media(s, d), analysis(s, d), bucket=top_bucket(s, d)).select("id", "bucketId"),
    "favorites_feed": lambda s, d: timeline.favourites(media(s, d), analysis(s, d)).select("id"),
    "hidden_feed": lambda s, d: timeline.hidden(media(s, d), analysis(s, d)).select("id", "isHiddenByUser", "sensitiveScore"),
    "albums_summary": lambda s, d: timeline.albums(media(s, d)),
    "years_desc": lambda s, d: timeline.years(media(s, d)),
    "month_sections": lambda s, d: timeline.sections(media(s, d), 5),
    "day_sections": lambda s, d: timeline.sections(media(s, d), 3),
    "criteria_filter": lambda s, d: timeline.select_media(visible(s, d), JUNE).select("id", "dateTaken"),
    "keyset_page": lambda s, d: timeline.keyset_page(media(s, d), 64, datetime(2018, 1, 1), 0).select("id", "dateTaken"),
    "visible_scores": lambda s, d: timeline.scored(media(s, d), analysis(s, d)).where(timeline.shown(0.3)).select("id"),
    "period_filter": lambda s, d: timeline.select_media(visible(s, d), timeline.Criteria(since=YEAR[0], until=YEAR[1])).select("id"),
    "stride_sample": lambda s, d: timeline.every(media(s, d).select("id"), [F.col("id")], 300),
    "position_range": lambda s, d: timeline.between_positions(timeline.visible(media(s, d), analysis(s, d)).select("id", "dateTaken"), [F.col("dateTaken").desc_nulls_last(), F.desc("id")], 40, 25).select("id", "pos"),
    "city_media": lambda s, d: timeline.select_media(visible(s, d), timeline.Criteria(cities=top_cities(s, d)), city_media=located(s, d)).select("id"),
    "language_score": lambda s, d: reading.best_language(language_lines(s, d)),
    "by_ids_ordered": lambda s, d: timeline.in_order(media(s, d), ranked_favourites(s, d)).select("id", "pos", "uri"),
    "screenshots": lambda s, d: timeline.screenshots(visible(s, d)).select("id", "displayName"),
    "poor_quality": lambda s, d: timeline.poor(visible(s, d), analysis(s, d)).select("id", "sharpness", "brightness"),
    "large_videos": lambda s, d: timeline.large_videos(visible(s, d)).select("id", "size"),
    "cleanup_total": clean_total,
    "rename_plan": lambda s, d: snapshots.move_plan(media(s, d), F.lit("  Sea \t side ")),
    "copies_lsh": lambda s, d: cleanup.copy_links(with_hash(s, d)),
    "copies_groups": lambda s, d: cleanup.copy_groups(with_hash(s, d), media(s, d)),
    "series_gap": lambda s, d: cleanup.gap_series(timeline.photos(visible(s, d)), SERIES_MS).groupBy("run").agg(F.count("*").alias("items"), F.min("dateTaken").alias("first")),
    "series_leader": series,
    "series_best": lambda s, d: cleanup.series_best(series(s, d), media(s, d), analysis(s, d)),
    "sharpness_percentiles": lambda s, d: cleanup.percentiles(analysis(s, d).select(F.col("mediaId").alias("id"), "sharpness"), "sharpness", [1, 5, 50, 95, 99]),
    "sharpness_deciles": lambda s, d: cleanup.deciles(analysis(s, d).where(F.col("brightness").isNotNull() & ~F.isnan("brightness")).select(F.col("mediaId").alias("id"), "sharpness", "brightness"), "sharpness", "brightness").select("decile", "items", F.round("mean", 4).alias("mean")),
    "brightness_bands": lambda s, d: cleanup.histogram(analysis(s, d), "brightness", [0.05, 0.25, 0.5, 0.75, 1.0]),
    "score_auc": lambda s, d: cleanup.auc(timeline.scored(media(s, d), analysis(s, d)).where("sensitiveScore is not null"), "sensitiveScore", "isHiddenByUser").select(F.round("auc", 9).alias("auc")),
    "places_nearest": located,
    "places_count": lambda s, d: places.counts(located(s, d).join(visible(s, d).select(F.col("id").alias("mediaId")), "mediaId", "left_semi"), cities(s, d)),
    "country_rollup": lambda s, d: places.countries(places.counts(located(s, d).join(visible(s, d).select(F.col("id").alias("mediaId")), "mediaId", "left_semi"), cities(s, d))),
    "fts_prefix": lambda s, d: search.full_text(texts(s, d), "the rep", 1 << 30),
    "like_search": lambda s, d: search.like(texts(s, d), "THE G_R").select("mediaId"),
    "hybrid_search": hybrid,
    "parsed_search": lambda s, d: timeline.select_media(visible(s, d), timeline.Criteria(months=tuple(sorted(search.parse("море летом").months)))).select("id"),
    "pending_analysis": lambda s, d: pending.analysis(media(s, d), analysis(s, d), 4).select("id"),
    "pending_quality": lambda s, d: pending.stage(media(s, d), analysis(s, d), "qualityVersion", 3, only_images=True).select("id"),
    "pending_location": lambda s, d: pending.stage(media(s, d), analysis(s, d), "locationVersion", 2).select("id"),
    "pending_faces": lambda s, d: pending.stage(media(s, d), analysis(s, d), "facesVersion", 2, only_images=True).select("id"),
    "pending_text": lambda s, d: pending.text_or_codes(media(s, d), analysis(s, d), 2, 2).select("id"),
    "pending_reembed": lambda s, d: pending.reembed(face(s, d), 2).select("id", "embedVersion"),
    "sync_merge": lambda s, d: snapshots.sync(table(s, d, "media").groupBy("id").agg(F.max("dateModified").alias("dateModified")), media(s, d).where("mediaType = 0"), "id", {"isFavorite": False, "isHiddenByUser": False}),
    "upsert_merge": lambda s, d: snapshots.upsert(analysis(s, d).select("mediaId", "qualityVersion"), media(s, d).where("isFavorite").select(F.col("id").alias("mediaId"), F.lit(9).alias("qualityVersion")), ["mediaId"]),
    "insert_missing": lambda s, d: snapshots.insert_missing(analysis(s, d).select("mediaId", "textVersion"), media(s, d).select(F.col("id").alias("mediaId"), F.lit(0).alias("textVersion")), ["mediaId"]),
    "removed_ids": lambda s, d: snapshots.removed(analysis(s, d).withColumnRenamed("mediaId", "id"), media(s, d), "id"),
    "set_quality": lambda s, d: snapshots.set_where(analysis(s, d).select("mediaId", "sharpness", "qualityVersion"), F.col("sharpness") < 0, sharpness=F.lit(None).cast("float"), qualityVersion=0),
    "cascade_faces": lambda s, d: snapshots.cascade(face(s, d).select("id", "mediaId", "personId"), person(s, d), "personId", set_null=True),
    "move_tags": lambda s, d: snapshots.move_references(tags(s, d), *sorted(r["id"] for r in person(s, d).orderBy("id").limit(2).collect()), column="personId", key=["mediaId", "personId"]),
    "text_stats": lambda s, d: texts(s, d).agg(F.count("*").alias("texts"), F.sum("lineCount").alias("lines")),
}

# Literal values throughout, so that the SQL doesn't follow a mistake of the library's constants.
HASH = """
h as (select a.mediaId as id, a.perceptualHash as hash, mv.v, mv.nm, s.width, s.height, s.mediaType, s.durationMs
  from a join visible s on s.id = a.mediaId left join mv on mv.id = a.mediaId where a.perceptualHash is not null and bit_count(a.perceptualHash) between 5 and 59),
pair as (select x.id as a, y.id as b from h x join h y on x.id < y.id and bit_count(xor(x.hash, y.hash)) <= 3 and x.mediaType = y.mediaType
  where (case when x.width > 0 and x.height > 0 and y.width > 0 and y.height > 0
      then abs(greatest(x.width, x.height)::double / least(x.width, x.height) - greatest(y.width, y.height)::double / least(y.width, y.height)) / (greatest(x.width, x.height)::double / least(x.width, x.height)) <= 0.03 else true end)
    and (x.mediaType <> 1 or coalesce(abs(x.durationMs - y.durationMs) <= 1000, true))
    and (x.v is null or y.v is null or list_dot_product(x.v, y.v) / x.nm / y.nm >= 0.95)),
link as (select a, b from pair union select b, a from pair)
"""
PLACE = """
c as (select distinct id, lat, lon, population, name, countryCode from city),
near as (select a.mediaId, c.id as cityId, sqrt(power((c.lon - a.longitude) * cos(radians((a.latitude + c.lat) / 2)), 2) + power(c.lat - a.latitude, 2)) * 111.2 as km, c.population
  from a join c on abs(floor(a.latitude) - floor(c.lat)) <= 1
    and ((floor(a.longitude) - floor(c.lon))::int % 360 + 360) % 360 in (0, 1, 359)
  where a.latitude is not null and a.longitude is not null and isfinite(a.latitude) and isfinite(a.longitude) and abs(a.latitude) <= 90 and abs(a.longitude) <= 180),
located as (select mediaId, cityId from (select *, row_number() over (partition by mediaId order by km / (1 + coalesce(population, 0) / 5e6::double), cityId) as rn from near where km <= 30) where rn = 1),
counted as (select cityId, count(*) as items, any_value(name) as name, any_value(countryCode) as countryCode from located join c on c.id = cityId where mediaId in (select id from visible) group by cityId)
"""
SHOT = "(" + " or ".join(f"contains(lower(coalesce({c}, '')), '{w}')" for c in ("bucketName", "displayName") for w in ("screenshot", "screen_record", "screenrecord", "screen record", "скриншот")) + ")"
POOR = f"select m.id, m.size, a.sharpness, a.brightness from visible m join a on a.mediaId = m.id where m.mediaType = 0 and not {SHOT} and a.sharpness is not null and not isnan(a.sharpness) and a.brightness is not null and not isnan(a.brightness) and (a.sharpness < 100 or a.brightness::double < 0.05::double)"
LARGE = "select id, size from visible where mediaType = 1 and size >= 104857600"
SUMMER = "month(dateTaken) in (6, 7, 8) and dateTaken >= timestamp '2017-01-01' and dateTaken < timestamp '2022-01-01' and mediaType = 0"
SERIES = f"""
photo as (select id, dateTaken from visible where mediaType = 0 and not {SHOT} and dateTaken is not null),
g as (select id, dateTaken, case when epoch_us(dateTaken) - lag(epoch_us(dateTaken)) over (order by dateTaken, id) > 21600000000 then 1 else 0 end as new from photo),
r as (select *, sum(new) over (order by dateTaken, id rows unbounded preceding) as run from g)
"""
LEADER = SERIES + """,
s as (select row_number() over (order by dateTaken, id) as n, id, epoch_us(dateTaken) as us, v, nm from photo join mv using (id)),
walk(n, leader) as (select 1::bigint, id from s where n = 1 union all
  select s.n, case when s.us - p.us <= 21600000000 and list_dot_product(s.v, p.v) / s.nm / p.nm >= 0.2::double and list_dot_product(s.v, l.v) / s.nm / l.nm >= 0.2::double then walk.leader else s.id end
  from walk join s on s.n = walk.n + 1 join s p on p.n = walk.n join s l on l.id = walk.leader),
series as (select s.id, leader as series from walk join s using (n) where leader in (select leader from walk group by 1 having count(*) > 1))
"""
TOKENS = r"list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9A-Za-z\x{80}-\x{10FFFF}]+'), lambda w: w <> '')"
FTS = f"hit as (select mediaId from (select mediaId, {TOKENS} as w from t) where len(list_filter(w, lambda x: starts_with(x, 'the'))) > 0"
STAGE = "select m.id from m join a on a.mediaId = m.id where not a.isUnreadable and {test}"

ORACLE = {
    "timeline_visible": sql("select id, dateTaken, sensitiveScore from visible"),
    "bucket_timeline": sql("select id, bucketId from visible where bucketId = (select bucketId from m where bucketId is not null group by bucketId order by count(*) desc, bucketId limit 1)"),
    "favorites_feed": sql("select id from m where isFavorite and not isHiddenByUser"),
    "visible_scores": sql("select id from sm where not isHiddenByUser and coalesce(sensitiveScore, 0)::double < 0.3::double"),
    "period_filter": sql("select id from visible where year(dateTaken) = 2019"),
    "stride_sample": sql("select id from (select id, row_number() over (order by id) - 1 as r, count(*) over () as n from m) where r % greatest(1, n // 300) = 0"),
    "position_range": sql("select id, pos from (select id, row_number() over (order by dateTaken desc nulls last, id desc) - 1 as pos from visible) where pos between 25 and 40"),
    "city_media": sql("select id from visible where id in (select mediaId from located where cityId in (select cityId from (select cityId, count(*) as n from located group by 1 order by n desc, 1 limit 2)))", PLACE),
    "language_score": sql("select mediaId, language, score from (select *, row_number() over (partition by mediaId order by score desc, language) as rn from (select mediaId, case id % 3 when 0 then 'a' when 1 then 'b' else 'c' end as language, round(sum(coalesce(confidence, 0)::double * len(text)), 6) as score from (select distinct id, mediaId, text, confidence from text_line) where text is not null group by 1, 2)) where rn = 1"),
    "hidden_feed": sql("select id, isHiddenByUser, sensitiveScore from sm where isHiddenByUser or sensitiveScore::double >= 0.7::double"),
    "albums_summary": sql("select bucketId, max(case when rn = 1 then bucketName end) as name, max(relativePath) as relativePath, max(case when rn = 1 and bucketId is not null then uri end) as cover, count(*) as items, max(dateTaken) as newest from (select *, row_number() over (partition by bucketId order by dateTaken desc nulls last, id desc) as rn from m where not isHiddenByUser) group by bucketId"),
    "years_desc": sql("select distinct year(dateTaken) as year from m where dateTaken is not null"),
    "month_sections": sql("select date_trunc('month', dateTaken)::date as section, count(*) as items from m where dateTaken is not null group by 1"),
    "day_sections": sql("select date_trunc('day', dateTaken)::date as section, count(*) as items from m where dateTaken is not null group by 1"),
    "criteria_filter": sql(f"select id, dateTaken from visible where {SUMMER}"),
    "keyset_page": sql("select id, dateTaken from m where dateTaken < timestamp '2018-01-01' order by dateTaken desc, id desc limit 64"),
    "by_ids_ordered": sql("select id, row_number() over (order by size desc, id) as pos, uri from m where isFavorite order by size desc, id limit 200"),
    "screenshots": sql(f"select id, displayName from visible where {SHOT}"),
    "poor_quality": sql(f"select id, sharpness, brightness from ({POOR})"),
    "large_videos": sql(LARGE),
    "cleanup_total": sql(f"select count(*) as items, coalesce(sum(size), 0) as bytes from (select id, size from visible where {SHOT} union select id, size from ({POOR}) union {LARGE})"),
    "rename_plan": sql("select id, relativePath as oldPath, case when regexp_extract(regexp_replace(relativePath, '/+$', ''), '^(.*/)[^/]*$', 1) = '' then 'Pictures/' else regexp_extract(regexp_replace(relativePath, '/+$', ''), '^(.*/)[^/]*$', 1) end || 'Sea side/' as newPath, lower(regexp_extract(relativePath, '^([^/]*)', 1)) in ('dcim', 'movies', 'pictures') as allowed from m"),
    "copies_lsh": sql("select a as id, count(*) as links from link group by 1", HASH),
    "copies_groups": sql("""select g as "group", count(*) as items, max(case when rn = 1 then id end) as keep, sum(coalesce(size, 0)) - max(case when rn = 1 then coalesce(size, 0) end) as bytes
from (select member.g, m.id, m.size, row_number() over (partition by member.g order by coalesce(isFavorite, false) desc, coalesce(width::bigint * height, 0) desc, coalesce(size, 0) desc, coalesce(epoch_us(dateTaken), 0), m.id) as rn from member join m on m.id = member.id) group by g""",
        HASH + ", reach(a, b) as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a), member as (select a as id, least(a, min(b)) as g from reach group by a)", recursive=True),
    "series_gap": sql("select run, count(*) as items, min(dateTaken) as first from r group by 1", SERIES),
    "series_leader": sql("select id, series from series", LEADER, recursive=True),
    "series_best": sql("select series, count(*) as items, max(case when rn = 1 then id end) as keep from (select x.series, x.id, row_number() over (partition by x.series order by coalesce(m.isFavorite, false) desc, case when a.sharpness is null or isnan(a.sharpness) then 0 else a.sharpness end desc, coalesce(m.width::bigint * m.height, 0) desc, x.id) as rn from series x join m using (id) left join a on a.mediaId = x.id) group by 1", LEADER, recursive=True),
    "sharpness_percentiles": sql("select p, sharpness::double as value from (select sharpness, row_number() over (order by sharpness, mediaId) - 1 as r, count(*) over () as n from a where sharpness is not null and not isnan(sharpness)), (values (1), (5), (50), (95), (99)) q(p) where r = (n - 1) * p // 100"),
    "sharpness_deciles": sql("select d as decile, count(*) as items, round(avg(brightness::double), 4) as mean from (select *, (select max(k) from range(0, 10) q(k) where n * k // 10 <= r) as d from (select brightness, row_number() over (order by sharpness, mediaId) - 1 as r, count(*) over () as n from a where sharpness is not null and not isnan(sharpness) and brightness is not null and not isnan(brightness))) group by d"),
    "brightness_bands": sql("select (brightness::double >= 0.05::double)::int + (brightness >= 0.25)::int + (brightness >= 0.5)::int + (brightness >= 0.75)::int + (brightness >= 1.0)::int as band, count(*) as items from a where brightness is not null and not isnan(brightness) group by 1"),
    "score_auc": sql("select round(sum(pos * (below + neg / 2.0::double)) / sum(pos) / sum(neg), 9) as auc from (select *, coalesce(sum(neg) over (order by s rows between unbounded preceding and 1 preceding), 0)::double as below from (select sensitiveScore as s, sum(isHiddenByUser::int)::double as pos, (count(*) - sum(isHiddenByUser::int))::double as neg from sm where sensitiveScore is not null group by 1))"),
    "places_nearest": sql("select mediaId, cityId from located", PLACE),
    "places_count": sql("select cityId, items, name, countryCode from counted", PLACE),
    "country_rollup": sql("select countryCode, sum(items)::bigint as items, count(*) as cities from counted group by 1", PLACE),
    "fts_prefix": sql("select mediaId from hit", FTS + " and len(list_filter(w, lambda x: starts_with(x, 'rep'))) > 0)"),
    "like_search": sql("select mediaId from t where translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '%the g_r%'"),
    "hybrid_search": sql("select id, score, row_number() over (order by branch, score desc, id) as rank from (select id, 1.0::double as score, 0 as branch from (select mediaId as id from (select mediaId from hit order by mediaId limit 300)) semi join allowed using (id) union all select id, score, 1 from near where id not in (select mediaId from (select mediaId from hit order by mediaId limit 300)))",
        FTS + f"), allowed as (select id from visible where {SUMMER}), q as (select v, nm from mv order by id limit 1), near as (select mv.id, list_dot_product(mv.v, q.v) / mv.nm / q.nm as score from mv semi join allowed using (id), q where list_dot_product(mv.v, q.v) / mv.nm / q.nm >= 0.15 order by score desc, id limit 200)"),
    "parsed_search": sql("select id from visible where month(dateTaken) in (6, 7, 8)"),
    "pending_analysis": sql("select m.id from m left join a on a.mediaId = m.id where a.mediaId is null or a.pipelineVersion < 4 or a.sourceModified <> m.dateModified or (not a.isUnreadable and (a.embedding is null or a.sensitiveScore is null))"),
    "pending_quality": sql(STAGE.format(test="a.qualityVersion < 3 and m.mediaType = 0")),
    "pending_location": sql(STAGE.format(test="a.locationVersion < 2")),
    "pending_faces": sql(STAGE.format(test="a.facesVersion < 2 and m.mediaType = 0")),
    "pending_text": sql(STAGE.format(test="m.mediaType = 0 and (a.textVersion < 2 or a.codesVersion < 2)")),
    "pending_reembed": sql("select id, embedVersion from f where embedVersion <> 2"),
    "sync_merge": sql("select x.id, x.dateModified, coalesce(m.isFavorite, false) as isFavorite, coalesce(m.isHiddenByUser, false) as isHiddenByUser from (select id, max(dateModified) as dateModified from media group by id) x left join m on m.id = x.id and m.mediaType = 0"),
    "upsert_merge": sql("select mediaId, qualityVersion from a where mediaId not in (select id from m where isFavorite) union all select id, 9 from m where isFavorite"),
    "insert_missing": sql("select mediaId, textVersion from a union all select id, 0 from m where id not in (select mediaId from a)"),
    "removed_ids": sql("select id from m where id not in (select mediaId from a)"),
    "set_quality": sql("select mediaId, case when sharpness < 0 then null else sharpness end as sharpness, case when sharpness < 0 then 0 else qualityVersion end as qualityVersion from a"),
    "cascade_faces": sql("select id, mediaId, case when personId in (select id from p) then personId end as personId from f"),
    "move_tags": sql("select distinct mediaId, case when personId = (select min(id) from p) then (select max(id) from (select id from p order by id limit 2)) else personId end as personId from tag"),
    "text_stats": sql("select count(*) as texts, sum(lineCount)::bigint as lines from t"),
}
