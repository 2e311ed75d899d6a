"""The rebuild of people: artifacts out, faces linked, confirmed and left-over faces attached, covers chosen, identities kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismlake.conf import CONF
from prismlake.functions.vectors import dot, norm
from prismlake.operators import linkage, people, similarity
from prismlake.tables import cut, discard

BOX = ["boxLeft", "boxTop", "boxRight", "boxBottom", "score", "width", "height"]
EDGE = 0.01


def pixel_size() -> Column:
    """The side of a face in pixels of the original; without the media's size, in fractions of the frame."""
    side = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(1)
    area = (F.col("boxRight") - F.col("boxLeft")).cast("double") * side("width") * (F.col("boxBottom") - F.col("boxTop")).cast("double") * side("height")
    return F.sqrt(F.greatest(F.lit(0.0), area))


def touches_edge() -> Column:
    return (F.col("boxLeft") < EDGE) | (F.col("boxTop") < EDGE) | (F.col("boxRight") > 1 - EDGE) | (F.col("boxBottom") > 1 - EDGE)


def by_weight() -> list[Column]:
    """The order in which faces are looked at: confirmed ones first, then large and clear ones, then by id."""
    return [F.col("lockedPersonId").isNull(), F.desc(pixel_size() * F.col("score")), F.col("id")]


def cover(rows: DataFrame, dim: int) -> DataFrame:
    """(cluster, cover): among the more typical half of a cluster's faces the largest and clearest, ties to the smaller id.

    Faces cut by the edge of the frame only count where there are no others. The half is found by ranking positions that
    are summed up from buckets of typicality, so a cluster of any size is spread over many tasks.
    """
    centre = people.centroids(rows.select("cluster", "vec"), "cluster", dim)
    scored = rows.join(centre.drop("n"), "cluster").withColumn("typical", dot(F.col("vec"), F.col("centroid")) / norm(F.col("vec"))).drop("vec", "centroid")
    scored = cut(scored.withColumn("bucket", F.floor((F.col("typical") + 1) * 2048).cast("int")), "cover")
    held = scored.groupBy("cluster", "bucket").agg(F.count("*").alias("h"))
    above = F.coalesce(F.sum("h").over(Window.partitionBy("cluster").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select("cluster", "bucket", above.alias("above"), F.sum("h").over(Window.partitionBy("cluster")).alias("n"))
    inner = F.row_number().over(Window.partitionBy("cluster", "bucket").orderBy(F.desc("typical"), "id"))
    half = scored.join(held, ["cluster", "bucket"]).withColumn("r", F.col("above") + inner).where("r <= n - floor(n / 2)")
    best = F.struct((~touches_edge()).alias("inside"), (pixel_size() * F.col("score")).alias("s"), (-F.col("id")).alias("i"))
    return half.groupBy("cluster").agg((-F.max(best)["i"]).alias("cover"))


def rebuild(face: DataFrame, artifacts: DataFrame, dim: int, rejected: DataFrame | None = None, link_least: float = CONF.face_link, smallest: int = CONF.smallest_person) -> tuple[DataFrame, DataFrame]:
    """People of faces: (position, cluster, faces, personId, cover), one row a person, and (cluster, id), one a face.

    face(id, mediaId, personId, lockedPersonId, embedding, box..., score, width, height): visible faces of one model, no
    artifacts, vectors usable. artifacts(id, embedding): what was marked as no face. rejected(faceId, personId).
    1. Unconfirmed faces like artifacts go. 2. Faces of collages count as of media of their own. 3. The rest is linked over
    nearest neighbours; confirmed faces are anchors, rejections bans. 4. Sets of less than `smallest` faces go unless
    anchored. 5. Unconfirmed faces clearly near the consistent examples of a confirmed person move to it. 6. Faces left over
    join the clearly nearest set among those that hold no face of their media and aren't rejected for them. 7. Sets that
    have become too small go. 8. A person is its anchor, or the previous one that holds enough of it; null is a new one.
    """
    face = cut(face, "people")
    bad = people.like_artifacts(artifacts, face, dim).select("id")
    rows = face.join(bad, "id", "left_anti")
    collage = people.collages(rows).withColumn("collage", F.lit(True))
    rows = rows.join(collage, "mediaId", "left").withColumn("mediaKey", F.when(F.col("collage"), -F.col("id")).otherwise(F.col("mediaId")))
    rows = cut(rows.select("id", F.col("embedding").alias("vec"), F.col("mediaKey").alias("mediaId"), F.col("lockedPersonId").alias("anchor"), "personId", *BOX), "people-rows")
    discard(face)
    no = (rejected if rejected is not None else rows.sparkSession.createDataFrame([], "faceId long, personId long")).select("faceId", "personId").distinct()

    near = similarity.neighbours(rows.select("id", "vec"), rows.count(), dim, CONF.face_neighbours, link_least)
    pairs = cut(near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct(), "people-pairs")
    label = cut(linkage.link(rows.select("id", "vec", "mediaId", "anchor"), pairs, link_least, no), "people-labels")
    kept = _large(rows.join(label, "id"), smallest)
    discard(pairs, label)

    # Confirmed persons draw the faces that clearly are like their consistent examples.
    confirmed = rows.where("anchor is not null").select(F.col("anchor").alias("personId"), "id", F.col("vec").alias("embedding"))
    trusted = confirmed.join(linkage.trusted(confirmed, dim).select("id"), "id", "left_semi")
    drawn = people.assign_by_examples(trusted, rows.where("anchor is null").select("id", F.col("vec").alias("embedding")), dim, rejected=no)
    home = kept.where("anchor is not null").groupBy("anchor").agg(F.min("cluster").alias("target"))
    drawn = cut(drawn.join(home, F.col("personId") == F.col("anchor")).select("id", "target"), "people-drawn")
    label = kept.select("id", "cluster").join(drawn, "id", "full").select("id", F.coalesce("target", "cluster").alias("cluster"))
    first, kept = kept, cut(rows.join(label, "id"), "people-kept")
    left = cut(rows.join(kept.select("id"), "id", "left_anti"), "people-left")
    discard(first, drawn, rows)

    examples = kept.select("id", F.col("cluster").alias("personId"), F.col("vec").alias("embedding"))
    same = left.select("id", "mediaId").join(kept.select("cluster", "mediaId").distinct(), "mediaId").select(F.col("id").alias("faceId"), F.col("cluster").alias("personId"))
    anchors = kept.where("anchor is not null").select("cluster", "anchor").distinct()
    barred = no.join(anchors, no["personId"] == anchors["anchor"]).select("faceId", F.col("cluster").alias("personId"))
    late = people.assign_by_examples(examples, left.select("id", F.col("vec").alias("embedding")), dim, rejected=same.unionByName(barred))
    late = cut(late.select("id", F.col("personId").alias("cluster")), "people-late")  # its tiles are gone before the rest is written
    final = _large(kept.unionByName(left.join(late, "id").select(*kept.columns)), smallest)
    discard(kept, left, late)

    size = cut(final.groupBy("cluster").agg(F.count("*").alias("faces"), F.max("anchor").alias("anchor")), "people-size")
    votes = final.where("personId is not null").groupBy("cluster", "personId").agg(F.count("*").alias("n"))
    heirs = people.inherit(size.select("cluster", F.col("faces").alias("size"), "anchor"), votes)
    found = size.join(heirs, "cluster", "left").join(cover(final, dim), "cluster")
    order = Window.orderBy(F.desc("faces"), "cluster")  # one row a person
    return found.select((F.row_number().over(order) - 1).alias("position"), "cluster", "faces", "personId", "cover"), final.select("cluster", "id")


def _large(rows: DataFrame, smallest: int) -> DataFrame:
    """Rows whose cluster has enough faces or an anchor."""
    kept = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.count("anchor").alias("anchored")).where((F.col("n") >= smallest) | (F.col("anchored") > 0))
    return cut(rows.join(kept.select("cluster"), "cluster", "left_semi"), "people-large")


def new_persons(found: DataFrame, person: DataFrame) -> DataFrame:
    """(id, name, coverFaceId, position, redraw): the persons table after a rebuild.

    Persons keep their name; one that is gone from person(id, name, coverFaceId) comes back without. New ones get ids above
    all others, by position. redraw tells where the cover isn't the one the avatar was made of.
    """
    top = F.broadcast(person.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top")).crossJoin(found.agg(F.coalesce(F.max("personId"), F.lit(0)).alias("_far"))))
    fresh = F.row_number().over(Window.partitionBy(F.col("personId").isNull()).orderBy("position"))  # one row a person
    rows = found.join(top).withColumn("id", F.coalesce("personId", F.greatest("_top", "_far") + fresh))
    old = person.select("id", "name", F.col("coverFaceId").alias("was"))
    return rows.join(old, "id", "left").select("id", "name", F.col("cover").alias("coverFaceId"), "position", F.coalesce(F.col("was") != F.col("cover"), F.lit(True)).alias("redraw"))
