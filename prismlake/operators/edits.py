"""What a user does to people, as new snapshots of the five tables concerned.

Every edit takes a People value and gives another one; nothing is computed before a table of it is used. Ids of faces
and media are literals, as they come from a selection on a screen.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.operators.people import best_overlap
from prismlake.operators.snapshots import insert_missing, move_references, set_where


@dataclass(frozen=True)
class People:
    """person(id, name, ...), face(id, mediaId, personId, lockedPersonId, isArtifact, checked, ...), rejection(faceId, personId),
    dismissal(personA, personB), tag(mediaId, personId)."""

    person: DataFrame
    face: DataFrame
    rejection: DataFrame
    dismissal: DataFrame
    tag: DataFrame


def _name(name: str | None) -> str | None:
    return (name or "").strip() or None


def _owner(person: int):
    return F.lit(person).cast("long")


def _reject(state: People, test, person: int) -> DataFrame:
    """The rejections with one of `person` for each face that passes a test."""
    return insert_missing(state.rejection, state.face.where(test).select(F.col("id").alias("faceId"), _owner(person).alias("personId")), ["faceId", "personId"])


def _of_on(person: int, media: Collection[int]):
    return (F.col("personId") == person) & F.col("mediaId").isin(*media)


def rename(state: People, person: int, name: str | None) -> People:
    """A name confirms a person's faces; a blank one is none and confirms nothing."""
    clean = _name(name)
    named = set_where(state.person, F.col("id") == person, name=F.lit(clean).cast("string"))
    return replace(state, person=named, face=lock(state.face, person) if clean else state.face)


def lock(face: DataFrame, person: int) -> DataFrame:
    return set_where(face, F.col("personId") == person, lockedPersonId=_owner(person))


def unlock(face: DataFrame, person: int | None = None) -> DataFrame:
    """A person's faces, or all of them, are no longer confirmed."""
    test = F.col("lockedPersonId").isNotNull() if person is None else F.col("lockedPersonId") == person
    return set_where(face, test, lockedPersonId=None)


def assign_and_lock(face: DataFrame, test, person: int) -> DataFrame:
    return set_where(face, test, personId=_owner(person), lockedPersonId=_owner(person), isArtifact=F.lit(False))


def merge(state: People, target: int, persons: Collection[int], name: str | None) -> People:
    """Persons become one: faces (the target's own too) are confirmed, rejections and tags move, the others go."""
    sources = [p for p in persons if p != target]
    if not sources:
        return state
    test = F.col("personId").isin(*sources) | F.coalesce(F.col("lockedPersonId").isin(*sources), F.lit(False)) | (F.col("personId") == target)
    rejection, tag = state.rejection, state.tag
    for s in sources:
        rejection = move_references(rejection, s, target, "personId", ["faceId", "personId"])
        tag = move_references(tag, s, target, "personId", ["mediaId", "personId"])
    dismissal = state.dismissal.where(~F.col("personA").isin(*sources) & ~F.col("personB").isin(*sources))
    person = set_where(state.person.where(~F.col("id").isin(*sources)), F.col("id") == target, name=F.lit(_name(name)).cast("string"))
    return People(person, set_where(state.face, test, personId=_owner(target), lockedPersonId=_owner(target)), rejection, dismissal, tag)


def remove(state: People, person: int, media: Collection[int]) -> People:
    """"Not this person" on some media: the faces are rejected and detached, tags go; other faces aren't confirmed."""
    test = _of_on(person, media)
    return replace(
        state,
        rejection=_reject(state, test, person),
        face=set_where(state.face, test, personId=None, lockedPersonId=None),
        tag=state.tag.where(~((F.col("personId") == person) & F.col("mediaId").isin(*media))),
    )


def move(state: People, source: int, media: Collection[int], target: int) -> People:
    """Faces of one person on some media go to another and are confirmed; the first one keeps a rejection; tags move."""
    if source == target:
        return state
    test = _of_on(source, media)
    moved = state.face.where(test).select(F.col("id").alias("faceId"))
    rejection = _reject(state, test, source).join(moved.withColumn("personId", _owner(target)), ["faceId", "personId"], "left_anti")
    tagged = (F.col("personId") == source) & F.col("mediaId").isin(*media)
    tag = insert_missing(state.tag, state.tag.where(tagged).withColumn("personId", _owner(target)), ["mediaId", "personId"]).where(~tagged)
    return replace(state, rejection=rejection, face=assign_and_lock(state.face, test, target), tag=tag)


def assign(state: People, face: int, person: int) -> People:
    """"This is ..." for one face: confirmed, no artifact any more; its previous person keeps a rejection."""
    previous = F.coalesce("lockedPersonId", "personId")
    new = state.face.where((F.col("id") == face) & (previous != person)).select(F.col("id").alias("faceId"), previous.alias("personId"))
    rejection = insert_missing(state.rejection, new, ["faceId", "personId"]).where(~((F.col("faceId") == face) & (F.col("personId") == person)))
    return replace(state, rejection=rejection, face=assign_and_lock(state.face, F.col("id") == face, person))


def not_faces(state: People, person: int, media: Collection[int] | None = None) -> People:
    """A person's faces on some media are artifacts; without media all of them are, and the person goes."""
    if media is not None:
        test = _of_on(person, media)
        return replace(state, face=set_where(state.face, test, isArtifact=F.lit(True), personId=None, lockedPersonId=None))
    test = (F.col("personId") == person) | F.coalesce(F.col("lockedPersonId") == person, F.lit(False))
    state = replace(state, face=set_where(state.face, test, isArtifact=F.lit(True), personId=None, lockedPersonId=None))
    gone = lambda df, *columns: df.where(~F.coalesce(F.array_contains(F.array(*columns), person), F.lit(False)))
    return People(state.person.where(F.col("id") != person), state.face, gone(state.rejection, "personId"), gone(state.dismissal, "personA", "personB"), gone(state.tag, "personId"))


def mark_checked(face: DataFrame, ids: Collection[int]) -> DataFrame:
    return set_where(face, F.col("id").isin(*ids), checked=F.lit(True))


def dismiss(state: People, a: int, b: int) -> People:
    """The pair isn't suggested again; it is kept with the smaller person first."""
    pair = state.dismissal.sparkSession.createDataFrame([(min(a, b), max(a, b))], "personA long, personB long")
    return replace(state, dismissal=insert_missing(state.dismissal, pair, ["personA", "personB"]))


def reset_edits(state: People) -> People:
    """Confirmations, rejections and dismissals go; names stay."""
    return replace(state, face=unlock(state.face), rejection=state.rejection.limit(0), dismissal=state.dismissal.limit(0))


def reset_all(state: People) -> People:
    """People start from nothing: with the persons their tags go too."""
    state = reset_edits(state)
    return replace(state, person=state.person.limit(0), tag=state.tag.limit(0), face=state.face.withColumn("personId", F.lit(None).cast("long")))


def forget(state: People, keep: DataFrame) -> People:
    """Persons outside keep(id) without a tag go; persons that exist by a tag alone stay. Faces of none lose their person."""
    kept = keep.select("id").unionByName(state.tag.select(F.col("personId").alias("id"))).distinct()
    person = state.person.join(kept, "id", "left_semi")
    from prismlake.operators.snapshots import cascade

    return replace(state, person=person, face=cascade(cascade(state.face, person, "personId", set_null=True), person, "lockedPersonId", set_null=True))


def inherit_edits(old: DataFrame, rejection: DataFrame, new: DataFrame, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """New faces of a media with what was known of the old face they overlap most, and the rejections to restore.

    new(id, mediaId, box..., checked, ...) gets personId, lockedPersonId and isArtifact; checked stays or is taken over.
    """
    match = best_overlap(new, old, least).select(F.col("oldId").alias("id"), F.col("newId").alias("was"))
    known = old.select(F.col("id").alias("was"), *[F.col(c).alias(f"_{c}") for c in ("personId", "lockedPersonId", "isArtifact", "checked")])
    rows = new.join(match, "id", "left").join(known, "was", "left")
    took = {c: F.when(F.col("was").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in ("personId", "lockedPersonId", "isArtifact")}
    faces = rows.withColumns({**took, "checked": F.col("checked") | F.coalesce("_checked", F.lit(False))}).select(*new.columns)
    restored = match.join(rejection.select(F.col("faceId").alias("was"), "personId"), "was").select(F.col("id").alias("faceId"), "personId")
    return faces, restored


def save_faces(face: DataFrame, rejection: DataFrame, analysis: DataFrame, media: DataFrame, found: DataFrame, restored: DataFrame, version: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A batch of media(mediaId) searched for faces: the new face, rejection and analysis tables.

    Old faces of the batch go with their rejections, found(id, mediaId, ...) take their place, restored(faceId, personId)
    come back for those, and the media are marked as done.
    """
    kept = face.join(media, "mediaId", "left_anti").select(*face.columns)
    faces = kept.unionByName(found.select(*face.columns))
    alive = faces.select(F.col("id").alias("faceId"))
    rejections = insert_missing(rejection.join(kept.select(F.col("id").alias("faceId")), "faceId", "left_semi"), restored.join(alive, "faceId", "left_semi"), ["faceId", "personId"])
    done = analysis.join(media.distinct().withColumn("_done", F.lit(True)), "mediaId", "left")
    return faces, rejections, set_where(done, F.col("_done"), facesVersion=version).select(*analysis.columns)
