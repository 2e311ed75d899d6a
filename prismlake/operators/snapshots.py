"""Changes of stored tables as new snapshots: upserts, inserts, sync with a source, edits of faces and persons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str], stamp: str | None = None) -> DataFrame:
    """New rows replace old ones of the same key; of several new rows of a key the last written counts.

    stamp: a column of new that tells the order of writing. Without it rows of a key should be equal; if they aren't, the
    greatest by all other columns is kept, so that the result doesn't depend on chance. Null keys never match.
    """
    rest = [c for c in new.columns if c not in key and c != stamp]
    rank = F.struct(*([stamp] if stamp else []), *[F.to_json(F.struct(F.col(c))).alias(c) for c in rest])
    new = new.groupBy(*key).agg(F.max_by(F.struct(*new.columns), rank).alias("_row")).select("_row.*")
    return old.join(new.select(*key), key, "left_anti").unionByName(new.select(*old.columns))


def insert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows are added only where their key isn't there yet."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti").select(*old.columns))


def sync(fresh: DataFrame, stored: DataFrame, key: str, local: dict[str, object]) -> DataFrame:
    """The fresh snapshot with the local columns of rows that were stored before, defaults for new ones; missing ids go."""
    kept = fresh.drop(*local).join(stored.select(key, *local), key, "left")
    return kept.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in local.items()})


def removed(fresh: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return stored.select(key).join(fresh.select(key), key, "left_anti")


def set_where(rows: DataFrame, test: Column, **values) -> DataFrame:
    """An update: columns of the rows that meet a test get new values; a null test leaves them."""
    hit = F.coalesce(test, F.lit(False))
    return rows.withColumns({c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def delete_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


def cascade(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str = "id", set_null: bool = False) -> DataFrame:
    """Children whose parent is gone are dropped, or lose the reference."""
    known = parents.select(F.col(parent_key).alias(child_key)).distinct()
    if not set_null:
        return children.join(known, child_key, "left_semi")
    return children.join(known.withColumn("_known", F.lit(True)), child_key, "left").withColumn(child_key, F.when(F.col("_known"), F.col(child_key))).drop("_known").select(*children.columns)


def merge_persons(face: DataFrame, source: int, target: int) -> DataFrame:
    """All faces of one person move to another; they and its own are locked there."""
    test = (F.col("personId") == source) | F.coalesce(F.col("lockedPersonId") == source, F.lit(False)) | (F.col("personId") == target)
    return set_where(face, test, personId=F.lit(target).cast("long"), lockedPersonId=F.lit(target).cast("long"))


def move_references(rows: DataFrame, source: int, target: int, column: str, key: list[str]) -> DataFrame:
    """References move from one person to another; those that would then repeat an existing row are dropped."""
    moved = rows.withColumn("_moved", F.col(column) == source).withColumn(column, F.when(F.col(column) == source, F.lit(target).cast("long")).otherwise(F.col(column)))
    first = Window.partitionBy(*key).orderBy("_moved")
    return moved.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "_moved")


def lock_named(face: DataFrame, person: int) -> DataFrame:
    """Naming a person confirms its faces."""
    return set_where(face, F.col("personId") == person, lockedPersonId=F.lit(person).cast("long"))


def detach(face: DataFrame, rejection: DataFrame, ids: list[int], person: int) -> tuple[DataFrame, DataFrame]:
    """Faces leave a person and are rejected for it: the new faces and the new rejections(faceId, personId)."""
    hit = F.col("id").isin(ids) & (F.col("personId") == person)
    added = face.where(hit).select(F.col("id").alias("faceId"), F.lit(person).cast("long").alias("personId")).distinct()
    return set_where(face, hit, personId=F.lit(None).cast("long"), lockedPersonId=F.lit(None).cast("long")), insert_missing(rejection, added, ["faceId", "personId"])


def replace_text(texts: DataFrame, new: DataFrame) -> DataFrame:
    """A batch of read texts(mediaId, text, lineCount, textRead): those read replace the stored ones, blank ones delete."""
    read = new.where("textRead")
    return texts.join(read.select("mediaId"), "mediaId", "left_anti").unionByName(read.where("lineCount > 0").select(*texts.columns))


def save_text(stored: dict[str, DataFrame], media: DataFrame, found: dict[str, DataFrame], text_version: int, codes_version: int, read: bool) -> dict[str, DataFrame]:
    """A batch of media(mediaId) read: the new tables `text`, `line`, `code` and `analysis`.

    Codes are always replaced and marked. Text and lines are replaced and marked only if text was read; else they stay.
    """
    media = media.select("mediaId").distinct()
    swap = lambda name: stored[name].join(media, "mediaId", "left_anti").select(*stored[name].columns).unionByName(found[name].select(*stored[name].columns))
    out = {name: swap(name) if read or name == "code" else stored[name] for name in ("text", "line", "code")}
    stamps = {"codesVersion": codes_version} | ({"textVersion": text_version} if read else {})
    marked = stored["analysis"].join(media.withColumn("_done", F.lit(True)), "mediaId", "left")
    return out | {"analysis": set_where(marked, F.col("_done"), **stamps).select(*stored["analysis"].columns)}


def move_plan(media: DataFrame, name: Column) -> DataFrame:
    """(id, oldPath, newPath, allowed) of a rename of albums, each within its root; the moves themselves are someone else's."""
    from prismlake.functions.text import album_name, may_rename, renamed

    clean = album_name(name)
    return media.select("id", F.col("relativePath").alias("oldPath"), renamed(F.col("relativePath"), clean).alias("newPath"), (may_rename(F.col("relativePath")) & clean.isNotNull()).alias("allowed"))


def move_to(media: DataFrame, path: str) -> DataFrame:
    """(id, oldPath, newPath, allowed) of a move of media into one folder, whose root must take files of their type."""
    from prismlake.functions.text import may_move

    return media.select("id", F.col("relativePath").alias("oldPath"), F.lit(path).alias("newPath"), may_move(F.lit(path), F.col("mediaType")).alias("allowed"))
