"""Queries over people and vectors: persons, faces, similarity, density and linkage clusters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from prismlake.conf import CONF
from prismlake.operators import dbscan as density
from prismlake.operators import linkage, people, pipeline, similarity, timeline
from prismlake.plans.common import FACE_DIM, MEDIA_DIM, analysis, face, face_vectors, media, media_vectors, person, sql, tags
from prismlake.tables import cut, numbered

EPS = 0.14
TOPICS = [(f"topic {i}", [1.0 if j % 5 == i else -0.25 for j in range(MEDIA_DIM)]) for i in range(5)]


def visible(s, d):
    return timeline.visible(media(s, d), analysis(s, d))


def examples(s, d):
    return face_vectors(s, d).where("lockedPersonId is not null and not isArtifact").select("id", F.col("lockedPersonId").alias("personId"), "embedding")


def open_faces(s, d):
    return face_vectors(s, d).where("lockedPersonId is null and not isArtifact").select("id", "embedding")


def two_rejected(s, d):
    """For two faces of three the one or two persons that are most like them are rejected."""
    found = cut(people._means(examples(s, d), open_faces(s, d), FACE_DIM, 3), "two-rejected")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "personId"))
    return found.withColumn("r", rank).where("r <= id % 3").select(F.col("id").alias("faceId"), "personId")


def first_query(s, d):
    row = media_vectors(s, d).orderBy("id").first()
    return (row["id"], [float(x) for x in row["vec"]]) if row else (0, [])


def counted(s, d):
    v = cut(media_vectors(s, d), "vectors")
    return v, v.count()


def first_person(s, d):
    row = face(s, d).where("personId is not null").groupBy("personId").count().orderBy(F.desc("count"), "personId").first()
    return row["personId"] if row else -1


def loose_tags(s, d):
    """Tags set by hand without a face: every confirmed person is also tagged on the next media."""
    return tags(s, d).select((F.col("mediaId") + 1).alias("mediaId"), "personId")


def all_of(s, d):
    """Media with both of two persons that are most often together."""
    pm = cut(people.person_media(face(s, d), tags(s, d)), "all-of")
    a, b = (pm.select(F.col("personId").alias(c), "mediaId") for c in ("a", "b"))
    row = a.join(b, "mediaId").where("a < b").groupBy("a", "b").count().orderBy(F.desc("count"), "a", "b").first()
    two = (row["a"], row["b"]) if row else (-1, -2)
    return timeline.select_media(visible(s, d), timeline.Criteria(people=two), person_media=pm).select("id")


def labels(s, d, points=4):
    v, n = counted(s, d)
    return v, cut(density.density(v, n, MEDIA_DIM, 1 - EPS, points).select("id", "cluster"), "labels")


def refined(s, d):
    v, found = labels(s, d)
    return density.refine(v, found, MEDIA_DIM, EPS, largest=10, share=0.0)


def albums(s, d):
    """Albums of the visible media: clustered, refined where too large, named and ordered."""
    v = cut(media_vectors(s, d).join(visible(s, d).select("id"), "id", "left_semi"), "albums")
    found = density.density(v, v.count(), MEDIA_DIM, 1 - EPS, CONF.album_rebuild_points).select("id", "cluster")
    return density.smart_albums(density.refine(v, found, MEDIA_DIM, EPS, CONF.album_rebuild_points), v, media(s, d), MEDIA_DIM, TOPICS)


def linked(s, d):
    rows = cut(face_vectors(s, d).where("not isArtifact").select("id", F.col("embedding").alias("vec"), "mediaId", F.col("lockedPersonId").alias("anchor")), "linked")
    near = similarity.neighbours(rows.select("id", "vec"), rows.count(), FACE_DIM, CONF.face_neighbours, CONF.face_link)
    pairs = near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    return linkage.link(rows, cut(pairs, "linked"), CONF.face_link, rejections(s, d))


def rejections(s, d):
    """A rejection for each unchecked face that lies on a media with a confirmed face of its person."""
    f = face(s, d)
    sure = f.where("lockedPersonId is not null").select("mediaId", F.col("lockedPersonId").alias("personId"), F.col("id").alias("own"))
    return f.where("lockedPersonId is null").join(sure, ["mediaId", "personId"]).select(F.col("id").alias("faceId"), "personId").distinct()


def rebuilt(s, d):
    boxes = people.visible_faces(face(s, d), media(s, d), analysis(s, d), 2).select("id", *pipeline.BOX)
    known = face_vectors(s, d)
    return pipeline.rebuild(known.join(boxes, "id"), known.where("isArtifact").select("id", "embedding"), FACE_DIM, rejections(s, d))


def weighed(s, d):
    rows = people.visible_faces(face(s, d), media(s, d), analysis(s, d), 2).where("score is not null")
    return numbered(rows.select("id", "lockedPersonId", *pipeline.BOX), *pipeline.by_weight(), position="pos").select("id", "pos")


def overlaps(s, d):
    boxes = face(s, d).select("id", "mediaId", "boxLeft", "boxTop", "boxRight", "boxBottom", "checked")
    return people.best_overlap(boxes.where("not checked"), boxes.where("checked"), 0.3).select("oldId", "newId")


def centres(s, d):
    rows = face_vectors(s, d).where("personId is not null and not isArtifact").select("personId", F.col("embedding").alias("vec"))
    return people.centroids(rows, "personId", FACE_DIM)


def suggested(s, d):
    c = cut(centres(s, d), "centres")
    row = c.orderBy(F.desc("n"), "personId").first()
    return people.suggestions(c, row["personId"] if row else 0, least=0.1).select("personId", F.round("score", 9).alias("score"))


QUERIES = {
    "person_media_counts": lambda s, d: people.person_counts(person(s, d), face(s, d), tags(s, d), media(s, d)),
    "person_media_feed": lambda s, d: people.media_of(first_person(s, d), face(s, d), tags(s, d), media(s, d), analysis(s, d)).select("id", "sensitiveScore"),
    "person_default_name": lambda s, d: people.default_name(people.person_counts(person(s, d), face(s, d), tags(s, d), media(s, d))),
    "visible_faces": lambda s, d: people.visible_faces(face(s, d), media(s, d), analysis(s, d), 2).select("id", "mediaId", "width", "height"),
    "people_on_media": lambda s, d: people.people_on_media(face(s, d), person(s, d)).select("id", "mediaId", "personId", "name"),
    "tags_on_media": lambda s, d: people.tags_on_media(face(s, d), loose_tags(s, d), person(s, d)),
    "person_media_union": lambda s, d: people.person_media(face(s, d), tags(s, d)),
    "people_all_of": all_of,
    "not_in_filter": lambda s, d: person(s, d).join(face(s, d).where("personId is not null and checked").select(F.col("personId").alias("id")), "id", "left_anti").select("id"),
    "exists_filter": lambda s, d: person(s, d).join(face(s, d).where("lockedPersonId is not null").select(F.col("lockedPersonId").alias("id")), "id", "left_semi").select("id"),
    "crowded_media": lambda s, d: people.crowded(face(s, d), 3),
    "faces_on_media": lambda s, d: people.faces_on_media(face(s, d), person(s, d)).select("id", "mediaId", "personId", "name"),
    "collage_groups": lambda s, d: people.collages(face_vectors(s, d), 0.6),
    "box_overlap": overlaps,
    "box_suppress": lambda s, d: people.suppress(face(s, d).where("boxRight > boxLeft and boxBottom > boxTop and score is not null")),
    "knn_assign": lambda s, d: people.assign_by_examples(examples(s, d), open_faces(s, d), FACE_DIM).select("id", "personId"),
    "knn_self_check": lambda s, d: people.self_check(examples(s, d), FACE_DIM),
    "artifact_filter": lambda s, d: people.like_artifacts(face_vectors(s, d).where("isArtifact"), face_vectors(s, d).where("not isArtifact"), FACE_DIM, least=0.15).select("id"),
    "trusted_examples": lambda s, d: linkage.trusted(examples(s, d), FACE_DIM),
    "centroid_by_person": lambda s, d: centres(s, d).select("personId", "n", F.round(F.col("centroid")[0], 6).alias("c1"), F.round(F.col("centroid")[FACE_DIM - 1], 6).alias("c128")),
    "person_suggestions": suggested,
    "topk_cosine": lambda s, d: similarity.topk(media_vectors(s, d), first_query(s, d)[1], 200, 0.15).select("id", F.round("score", 9).alias("score")),
    "topk_filtered": lambda s, d: similarity.topk(media_vectors(s, d), first_query(s, d)[1], 50, -1.0, include=media(s, d).where("isFavorite")).select("id", F.round("score", 9).alias("score")),
    "similar_media": lambda s, d: similarity.visible_after(similarity.similar(media_vectors(s, d), first_query(s, d)[0], 60, 0.3), visible(s, d)).select("id", F.round("score", 9).alias("score")),
    "eps_join": lambda s, d: similarity.links(*counted(s, d), MEDIA_DIM, 1 - EPS),
    "knn_join": lambda s, d: similarity.neighbours(*counted(s, d), MEDIA_DIM, 5, 0.5).select("id", "other", F.round("score", 9).alias("score")),
    "topic_argmax": lambda s, d: similarity.nearest_topic(media_vectors(s, d), TOPICS).select("id", "topic"),
    "dbscan_labels": lambda s, d: labels(s, d)[1],
    "dbscan_refine": refined,
    "smart_albums": albums,
    "linkage_average": linked,
    "people_rebuild": lambda s, d: rebuilt(s, d)[0],
    "people_table": lambda s, d: pipeline.new_persons(cut(rebuilt(s, d)[0], "people-table"), person(s, d)),
    "faces_by_weight": weighed,
    "knn_rejected": lambda s, d: people.assign_by_examples(examples(s, d), open_faces(s, d), FACE_DIM, rejected=two_rejected(s, d)).select("id", "personId"),
}

CENTRES = """
dims as (select personId, i, sum(v[i] / nm) as s from fv, range(1, 129) q(i) where personId is not null and not isArtifact group by 1, 2),
cen as (select personId, list(s / len order by i) as c from dims join (select personId, sqrt(sum(s * s)) as len from dims group by 1) using (personId) group by 1),
own as (select cen.* from cen join (select personId, count(*) as n from fv where personId is not null and not isArtifact group by 1 order by n desc, 1 limit 1) using (personId))
"""
KNN = """
ex as (select id, lockedPersonId as pid, v, nm from fv where lockedPersonId is not null and not isArtifact),
cand as (select id, v, nm from fv where lockedPersonId is null and not isArtifact),
best as (select c.id, ex.pid, list_dot_product(c.v, ex.v) / c.nm / ex.nm as s from {cand} c join ex on ex.id <> c.id),
top3 as (select id, pid, avg(s) as score from (select *, row_number() over (partition by id, pid order by s desc) as rn from best) where rn <= 3 group by id, pid),
ranked as (select *, row_number() over (partition by id order by score desc, pid) as r, lead(score) over (partition by id order by score desc, pid) as second from top3),
won as (select id, pid from ranked where r = 1 and score >= 0.42::double and (second is null or score - second >= 0.05::double))
"""
EDGE = """
pair as (select x.id as a, y.id as b, round(list_dot_product(x.v, y.v) / x.nm / y.nm, 12) as score from mv x join mv y on x.id < y.id where list_dot_product(x.v, y.v) / x.nm / y.nm >= 0.86::double - 1e-11),
edge as (select * from pair where score >= 0.86::double)
"""
DENSE = EDGE + """,
link as (select a, b from edge union all select b, a from edge),
core as (select a as id from link group by a having count(*) + 1 >= 4),
inner_ as (select a, b from link where a in (select id from core) and b in (select id from core)),
reach(a, b) as (select a, b from inner_ union select r.a, l.b from reach r join inner_ l on r.b = l.a),
named as (select id, least(id, coalesce((select min(b) from reach where reach.a = core.id), id)) as cluster from core),
border as (select l.a as id, arg_min(named.cluster, named.id) as cluster from link l join named on named.id = l.b group by l.a)
"""



def dense_sql(tag: str, links: str, points: int) -> str:
    """CTEs of the density clusters of edges(a, b), told by both ends: named<tag> for cores, border<tag> for the rest."""
    return f"""
link{tag} as ({links}),
core{tag} as (select a as id from link{tag} group by a having count(*) + 1 >= {points}),
inner{tag} as (select a, b from link{tag} where a in (select id from core{tag}) and b in (select id from core{tag})),
reach{tag}(a, b) as (select a, b from inner{tag} union select r.a, l.b from reach{tag} r join inner{tag} l on r.b = l.a),
named{tag} as (select id, least(id, coalesce((select min(b) from reach{tag} where reach{tag}.a = core{tag}.id), id)) as cluster from core{tag}),
border{tag} as (select l.a as id, arg_min(named{tag}.cluster, named{tag}.id) as cluster from link{tag} l join named{tag} on named{tag}.id = l.b where l.a not in (select id from core{tag}) group by l.a),
label{tag} as (select mv.id, coalesce(n.cluster, b.cluster, -1) as cluster from mv left join named{tag} n on n.id = mv.id left join border{tag} b on b.id = mv.id)"""


def refined_sql(tag: str, before: str, least: float) -> str:
    """CTEs of one round that clusters the clusters of more than ten rows again: final<tag>(id, cluster)."""
    inside = f"select l.a, l.b from (select a, b, score from edge union all select b, a, score from edge) l join big{tag} x on x.id = l.a join big{tag} y on y.id = l.b and y.cluster = x.cluster where l.score >= {least}::double - 1e-13"
    return f"""
big{tag} as (select * from {before} where cluster in (select cluster from {before} where cluster >= 0 group by 1 having count(*) > 10)),{dense_sql(tag, inside, 4)},
new{tag} as (select b.id, case when max(l.cluster) over (partition by b.cluster) >= 0 then l.cluster else b.cluster end as cluster from big{tag} b join label{tag} l using (id)),
final{tag} as (select p.id, coalesce(n.cluster, p.cluster) as cluster from {before} p left join new{tag} n using (id))"""


BOTH = "select a, b from edge union all select b, a from edge"
ALBUMS = EDGE + ", seen as (select id from visible)," + dense_sql("v", f"select * from ({BOTH}) where a in (select id from seen) and b in (select id from seen)", 6) + """,
mine as (select l.cluster as album, mv.id, mv.v, mv.nm from labelv l join mv using (id) where l.cluster >= 0 and l.id in (select id from seen)),
dims as (select album, i, sum(v[i] / nm) as s from mine, range(1, 97) q(i) group by 1, 2),
cen as (select album, list(s order by i) as c from dims group by 1),
rated as (select m.album, m.id, list_dot_product(m.v, c.c) / m.nm / sqrt(list_dot_product(c.c, c.c)) as score from mine m join cen c using (album)),
topic as (select album, topic, list_dot_product(c, w) / sqrt(list_dot_product(w, w)) / sqrt(list_dot_product(c, c)) as score from cen, (select 'topic ' || i as topic, list_transform(range(0, 96), lambda j: case when j % 5 = i then 1.0::double else -0.25::double end) as w from range(0, 5) q(i))),
titled as (select album, max(case when score >= 0.25::double then topic end) as topic from (select *, row_number() over (partition by album order by score desc, topic desc) as rn from topic) where rn = 1 group by 1),
base as (select r.album, count(*) as items, arg_max(r.id, (round(r.score, 11), -r.id)) as cover, min(m.dateTaken) as first, max(m.dateTaken) as last from rated r left join m using (id) group by 1),
spanned as (select base.*, topic, case when first is null then 'undated' when strftime(first, '%Y-%m') = strftime(last, '%Y-%m') then strftime(first, '%b %Y') when year(first) = year(last) then year(first)::varchar else year(first) || '–' || year(last) end as span from base join titled using (album)),
based as (select *, coalesce(topic, 'Similar photos · ' || span) as base from spanned),
nth as (select *, row_number() over (partition by base order by items desc, album) as nth from based),
mth as (select *, row_number() over (partition by base, span, topic is not null and nth > 1 order by items desc, album) as mth from nth)
"""

ORACLE = {
    "person_media_counts": sql("select p.id, p.name, p.position, count(*) as mediaCount from p join pm on pm.personId = p.id where pm.mediaId in (select id from m where not isHiddenByUser) group by 1, 2, 3"),
    "person_media_feed": sql("select id, sensitiveScore from sm where not isHiddenByUser and id in (select mediaId from pm where personId = (select personId from f where personId is not null group by 1 order by count(*) desc, 1 limit 1))"),
    "person_default_name": sql("select (select name from (select p.id, p.name, count(*) as n from p join pm on pm.personId = p.id where pm.mediaId in (select id from m where not isHiddenByUser) group by 1, 2) where name is not null order by n desc, id limit 1) as name"),
    "visible_faces": sql("select f.id, f.mediaId, v.width, v.height from f join visible v on v.id = f.mediaId where not f.isArtifact and f.embedVersion = 2"),
    "people_on_media": sql("select f.id, f.mediaId, f.personId, p.name from f join p on p.id = f.personId"),
    "tags_on_media": sql("select t.mediaId, t.personId, p.name from (select mediaId + 1 as mediaId, personId from tag) t join p on p.id = t.personId where not exists (select 1 from f join p q on q.id = f.personId where f.mediaId = t.mediaId and f.personId = t.personId)"),
    "person_media_union": sql("select personId, mediaId from pm"),
    "people_all_of": sql("select id from visible where id in (select x.mediaId from pm x join pm y using (mediaId) where (x.personId, y.personId) in (select (x.personId, y.personId) from pm x join pm y using (mediaId) where x.personId < y.personId group by x.personId, y.personId order by count(*) desc, x.personId, y.personId limit 1))"),
    "not_in_filter": sql("select id from p where id not in (select personId from f where personId is not null and checked)"),
    "exists_filter": sql("select id from p where exists (select 1 from f where f.lockedPersonId = p.id)"),
    "crowded_media": sql("select mediaId, count(*) as faces from f where not isArtifact group by 1 having count(*) >= 3"),
    "faces_on_media": sql("select f.id, f.mediaId, f.personId, p.name from f left join p on p.id = f.personId where not f.isArtifact"),
    "collage_groups": sql("select distinct x.mediaId from fv x join fv y on x.mediaId = y.mediaId and x.id < y.id where list_dot_product(x.v, y.v) / x.nm / y.nm >= 0.6::double"),
    "box_overlap": sql("""select oldId, newId from (select *, row_number() over (partition by oldId order by iou desc, newId) as rn from (
select *, case when ao + an - i > 0 then i / (ao + an - i) else 0 end as iou from (select x.id as oldId, y.id as newId,
  greatest(0, least(x.boxRight::double, y.boxRight::double) - greatest(x.boxLeft::double, y.boxLeft::double)) * greatest(0, least(x.boxBottom::double, y.boxBottom::double) - greatest(x.boxTop::double, y.boxTop::double)) as i,
  (x.boxRight::double - x.boxLeft::double) * (x.boxBottom::double - x.boxTop::double) as ao, (y.boxRight::double - y.boxLeft::double) * (y.boxBottom::double - y.boxTop::double) as an
  from f x join f y on x.mediaId = y.mediaId where not x.checked and y.checked)) where iou >= 0.3::double) where rn = 1"""),
    "knn_assign": sql("select id, pid as personId from won", KNN.format(cand="cand")),
    "knn_rejected": sql("select id, pid as personId from won", KNN.format(cand="cand").replace("ranked as (select *,", "two as (select id, pid from (select *, row_number() over (partition by id order by score desc, pid) as rn from top3 where id % 3 > 0) where rn <= id % 3), ranked as (select *,").replace("as second from top3)", "as second from top3 where (id, pid) not in (select (id, pid) from two))")),
    "faces_by_weight": sql("select id, row_number() over (order by locked, weight desc, id) - 1 as pos from (select f.id, f.lockedPersonId is null as locked, sqrt(greatest(0, (f.boxRight - f.boxLeft)::double * case when v.width > 0 then v.width else 1 end * (f.boxBottom - f.boxTop)::double * case when v.height > 0 then v.height else 1 end)) * f.score as weight from f join visible v on v.id = f.mediaId where not f.isArtifact and f.embedVersion = 2 and f.score is not null)"),
    "dbscan_refine": sql("select id, cluster from finalb", EDGE + "," + dense_sql("z", BOTH, 4) + "," + refined_sql("a", "labelz", 0.88) + "," + refined_sql("b", "finala", 0.9), recursive=True),
    "smart_albums": sql("select album, row_number() over (order by items desc, album) as position, items, cover, first, last, case when nth = 1 then base when topic is not null and mth = 1 then base || ' · ' || span else base || ' · ' || nth end as name from mth", ALBUMS, recursive=True),
    "box_suppress": sql("select mediaId, unnest(kept) as id from (select mediaId, kept, row_number() over (partition by mediaId order by n desc) as r from walk) where r = 1", """
b as (select mediaId, id, row_number() over (partition by mediaId order by score desc, id) as n, boxLeft::double as l, boxTop::double as t, boxRight::double as r, boxBottom::double as d from f where boxRight > boxLeft and boxBottom > boxTop and score is not null),
ov as (select x.mediaId, x.n, coalesce(list(y.id) filter (where greatest(0, least(x.r, y.r) - greatest(x.l, y.l)) * greatest(0, least(x.d, y.d) - greatest(x.t, y.t)) > 0.3::double * ((x.r - x.l) * (x.d - x.t) + (y.r - y.l) * (y.d - y.t) - greatest(0, least(x.r, y.r) - greatest(x.l, y.l)) * greatest(0, least(x.d, y.d) - greatest(x.t, y.t)))), []) as over
  from b x left join b y on y.mediaId = x.mediaId and y.n < x.n group by x.mediaId, x.n),
walk(mediaId, n, kept) as (select mediaId, n, [id] from b where n = 1 union all
  select b.mediaId, b.n, case when list_has_any(walk.kept, ov.over) then walk.kept else list_append(walk.kept, b.id) end
  from walk join b on b.mediaId = walk.mediaId and b.n = walk.n + 1 join ov on ov.mediaId = b.mediaId and ov.n = b.n)""", recursive=True),
    "knn_self_check": sql("select case when won.pid is null then 'none' when won.pid = ex.pid then 'right' else 'wrong' end as outcome, count(*) as faces from ex left join won on won.id = ex.id group by 1", KNN.format(cand="ex")),
    "artifact_filter": sql("select id from (select x.id, list_dot_product(x.v, y.v) / x.nm / y.nm as s, row_number() over (partition by x.id order by list_dot_product(x.v, y.v) / x.nm / y.nm desc) as rn from fv x join fv y on y.isArtifact and not x.isArtifact and x.lockedPersonId is null) where rn <= 3 group by id having avg(s) >= 0.15::double"),
    "centroid_by_person": sql("select personId, n, round(max(case when i = 1 then s end) / sqrt(sum(s * s)), 6) as c1, round(max(case when i = 128 then s end) / sqrt(sum(s * s)), 6) as c128 from (select personId, i, sum(v[i] / nm) as s, count(*) as n from fv, range(1, 129) q(i) where personId is not null and not isArtifact group by 1, 2) group by personId, n"),
    "topk_cosine": sql("select mv.id, round(list_dot_product(mv.v, q.v) / mv.nm / q.nm, 9) as score from mv, (select * from mv order by id limit 1) q where list_dot_product(mv.v, q.v) / mv.nm / q.nm >= 0.15::double order by list_dot_product(mv.v, q.v) / mv.nm / q.nm desc, mv.id limit 200"),
    "topk_filtered": sql("select mv.id, round(list_dot_product(mv.v, q.v) / mv.nm / q.nm, 9) as score from mv, (select * from mv order by id limit 1) q where mv.id in (select id from m where isFavorite) order by list_dot_product(mv.v, q.v) / mv.nm / q.nm desc, mv.id limit 50"),
    "similar_media": sql("select id, round(s, 9) as score from (select mv.id, list_dot_product(mv.v, q.v) / mv.nm / q.nm as s from mv, (select * from mv order by id limit 1) q where mv.id <> q.id and list_dot_product(mv.v, q.v) / mv.nm / q.nm >= 0.3::double order by s desc, mv.id limit 60) where id in (select id from visible)"),
    "eps_join": sql("select a as id, least(a, (select min(b) from reach where reach.a = link.a)) as component, count(*) as links from link group by a", EDGE + ", link as (select a, b from edge union all select b, a from edge), reach(a, b) as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a)", recursive=True),
    "knn_join": sql("select id, other, round(score, 9) as score from (select *, row_number() over (partition by id order by score desc, other) as rn from (select x.id, y.id as other, round(list_dot_product(x.v, y.v) / x.nm / y.nm, 12) as score from mv x join mv y on x.id <> y.id) where score >= 0.5::double) where rn <= 5"),
    "person_suggestions": sql("select x.personId, round(list_dot_product(x.c, y.c), 9) as score from cen x, own y where x.personId <> y.personId and list_dot_product(x.c, y.c) >= 0.1::double order by score desc, x.personId limit 3", CENTRES),
    "topic_argmax": sql("select id, topic from (select mv.id, topic, row_number() over (partition by mv.id order by list_dot_product(mv.v, w) / sqrt(list_dot_product(w, w)) desc, topic desc) as rn from mv, (select 'topic ' || i as topic, list_transform(range(0, 96), lambda j: case when j % 5 = i then 1.0::double else -0.25::double end) as w from range(0, 5) q(i))) where rn = 1"),
    "dbscan_labels": sql("select mv.id, coalesce(named.cluster, border.cluster, -1) as cluster from mv left join named on named.id = mv.id left join border on border.id = mv.id", DENSE, recursive=True),
}
