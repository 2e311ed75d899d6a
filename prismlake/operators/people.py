"""People: counts and media of persons, assignment of faces by their nearest examples, overlaps and suggestions.

Examples and artifacts are compared with faces over a grid of tiles, so that neither side is ever whole in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismlake.conf import CONF
from prismlake.functions.vectors import cosine, dot
from prismlake.operators.cells import matrix, unit
from prismlake.tables import cut, is_small


def person_media(face: DataFrame, tag: DataFrame) -> DataFrame:
    """(personId, mediaId) of faces and of tags set by hand, each once."""
    seen = face.where("personId is not null").select("personId", "mediaId")
    return seen.unionByName(tag.select("personId", "mediaId")).distinct()


def media_of(person: int, face: DataFrame, tag: DataFrame, media: DataFrame, analysis: DataFrame) -> DataFrame:
    """A person's media that aren't hidden by hand, whatever their score, newest first, with their score."""
    from prismlake.operators.timeline import not_hidden, scored

    own = person_media(face, tag).where(F.col("personId") == person).select(F.col("mediaId").alias("id"))
    return scored(not_hidden(media).join(own, "id", "left_semi"), analysis).orderBy(F.col("dateTaken").desc_nulls_last(), F.desc("id"))


def person_counts(person: DataFrame, face: DataFrame, tag: DataFrame, media: DataFrame) -> DataFrame:
    """Persons with at least one media that isn't hidden by hand: named ones first, then by position."""
    from prismlake.operators.timeline import not_hidden

    counts = person_media(face, tag).join(not_hidden(media).select(F.col("id").alias("mediaId")), "mediaId", "left_semi").groupBy("personId").agg(F.count("*").alias("mediaCount"))
    return person.join(counts, person["id"] == counts["personId"]).select("id", "name", "position", "mediaCount").orderBy(F.col("name").isNull(), "position", "id")


def faces_on_media(face: DataFrame, person: DataFrame) -> DataFrame:
    return face.where("not coalesce(isArtifact, false)").select("id", "mediaId", "boxLeft", "personId").join(person.select(F.col("id").alias("personId"), "name"), "personId", "left")


def people_on_media(face: DataFrame, person: DataFrame) -> DataFrame:
    """Faces that belong to a known person, with the name; from left to right where ordered by boxLeft and id."""
    return face.where("personId is not null").select("id", "mediaId", "boxLeft", "personId").join(person.select(F.col("id").alias("personId"), "name"), "personId")


def tags_on_media(face: DataFrame, tag: DataFrame, person: DataFrame) -> DataFrame:
    """(mediaId, personId, name): persons tagged by hand that no face on the media is known as."""
    named = tag.join(person.select(F.col("id").alias("personId"), "name"), "personId")
    return named.join(people_on_media(face, person).select("mediaId", "personId"), ["mediaId", "personId"], "left_anti").select("mediaId", "personId", "name")


def default_name(counted: DataFrame) -> DataFrame:
    """(name): that of the named person with most media among counted(id, name, mediaCount); ties go to the smaller id.

    Null where none is named.
    """
    order = F.struct("mediaCount", -F.col("id"))
    return counted.agg(F.max_by(F.when(F.col("name").isNotNull(), F.col("name")), F.when(F.col("name").isNotNull(), order)).alias("name"))


def visible_faces(face: DataFrame, media: DataFrame, analysis: DataFrame, version: int, threshold: float = CONF.sensitive_threshold, show: bool = not CONF.hide_sensitive) -> DataFrame:
    """Faces of one model, no artifacts, on visible media, with the media's width and height: what people are made of."""
    from prismlake.operators.timeline import visible

    seen = visible(media, analysis, threshold, show).select(F.col("id").alias("mediaId"), "width", "height")
    return face.where((F.col("embedVersion") == version) & ~F.col("isArtifact")).join(seen, "mediaId")


def crowded(face: DataFrame, least: int = 6) -> DataFrame:
    """Media with at least so many faces that aren't artifacts."""
    return face.where("not isArtifact").groupBy("mediaId").agg(F.count("*").alias("faces")).where(F.col("faces") >= least)


def collages(face: DataFrame, least: float = CONF.collage_score) -> DataFrame:
    """Media on which two faces are so alike that they must be the same person; media have few faces."""
    a = face.select("mediaId", F.col("id").alias("a"), F.col("embedding").alias("va"))
    b = face.select("mediaId", F.col("id").alias("b"), F.col("embedding").alias("vb"))
    return a.join(b, "mediaId").where("a < b").where(cosine(F.col("va"), F.col("vb")) >= least).select("mediaId").distinct()


def iou(a: str, b: str):
    w = F.greatest(F.lit(0.0), F.least(f"{a}Right", f"{b}Right").cast("double") - F.greatest(f"{a}Left", f"{b}Left").cast("double"))
    h = F.greatest(F.lit(0.0), F.least(f"{a}Bottom", f"{b}Bottom").cast("double") - F.greatest(f"{a}Top", f"{b}Top").cast("double"))
    area = lambda s: (F.col(f"{s}Right").cast("double") - F.col(f"{s}Left").cast("double")) * (F.col(f"{s}Bottom").cast("double") - F.col(f"{s}Top").cast("double"))
    return F.when(area(a) + area(b) - w * h > 0, w * h / (area(a) + area(b) - w * h)).otherwise(0.0)


def best_overlap(old: DataFrame, new: DataFrame, least: float = 0.5) -> DataFrame:
    """For every old box the new box of the same media that overlaps it most, if enough. Ties go to the smaller id."""
    side = lambda df, s: df.select("mediaId", F.col("id").alias(f"{s}Id"), *[F.col(f"box{c}").alias(f"{s}{c}") for c in ("Left", "Top", "Right", "Bottom")])
    pairs = side(old, "old").join(side(new, "new"), "mediaId").withColumn("iou", iou("old", "new")).where(F.col("iou") >= least)
    rank = Window.partitionBy("oldId").orderBy(F.desc("iou"), "newId")
    return pairs.withColumn("r", F.row_number().over(rank)).where("r = 1").select("oldId", "newId", "iou")


def suppress(boxes: DataFrame, most: float = 0.3) -> DataFrame:
    """Greedy suppression: by falling score, a box is dropped if it overlaps a kept one of its media by more than `most`."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["score", "id"], ascending=[False, True])
        box = df[["boxLeft", "boxTop", "boxRight", "boxBottom"]].to_numpy(dtype=float)
        area, kept = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1]), []
        for i in range(len(box)):
            w = np.maximum(0, np.minimum(box[i, 2], box[kept, 2]) - np.maximum(box[i, 0], box[kept, 0]))
            h = np.maximum(0, np.minimum(box[i, 3], box[kept, 3]) - np.maximum(box[i, 1], box[kept, 1]))
            both = area[i] + area[kept] - w * h
            if not np.any((w * h > most * both) & (both > 0)):
                kept.append(i)
        return df.iloc[kept][["mediaId", "id"]]

    return boxes.select("mediaId", "id", "score", "boxLeft", "boxTop", "boxRight", "boxBottom").groupBy("mediaId").applyInPandas(run, "mediaId long, id long")


#: A person with more examples than this is spread over several tiles.
TILE_ROWS = 8_192
#: So many times these rows a tile has of examples, and of faces: every row is written once for each tile of the other side.
TILE_EXAMPLES, TILE_FACES = 2, 4


def _tiles(rows: DataFrame, key: str, n: int, times: int, held: DataFrame | None = None) -> tuple[DataFrame, int]:
    """rows with the number of their tile by a hash of a key, and how many tiles there are.

    held(key, n): rows of each key; keys of more than TILE_ROWS rows are spread over as many tiles as they need, and
    flagged `wide`.
    """
    tiles = max(1, -(-n // (times * TILE_ROWS)))
    spot = F.pmod(F.xxhash64(key), F.lit(tiles))
    if held is None:
        return rows.withColumns({"_tile": spot.cast("int"), "_wide": F.lit(False)}), tiles
    large = held.where(F.col("n") > TILE_ROWS).select(key, F.ceil(F.col("n") / TILE_ROWS).alias("_parts"))  # at most n / TILE_ROWS rows
    rows = rows.join(F.broadcast(large), key, "left")
    spread = F.pmod(spot + F.pmod(F.xxhash64("id"), F.col("_parts")), F.lit(tiles))
    return rows.withColumns({"_tile": F.coalesce(spread, spot).cast("int"), "_wide": F.col("_parts").isNotNull()}).drop("_parts"), tiles


def _means(examples: DataFrame, faces: DataFrame, dim: int, k: int, rejected: DataFrame | None = None, best: int = 2) -> DataFrame:
    """(id, personId, score): mean of each face's k best cosines to a person's examples, itself left out; the best persons.

    rejected(id, personId): persons that don't count for a face; they are left out before any choice is made. Faces and
    examples are cut into tiles by their numbers, and every pair of tiles is one task of bounded size; that is all pairs,
    as a mean over few cosines this low bounds nothing. A person lies in one tile, which passes on its `best` persons
    only; of one too large for that every tile passes on the k best cosines, which are then merged.
    """
    held = examples.groupBy("personId").agg(F.count("*").alias("n"))
    n_examples, n_faces = examples.count(), faces.count()
    e, e_tiles = _tiles(examples.select("id", "personId", F.col("embedding").alias("vec")), "personId", n_examples, TILE_EXAMPLES, held)
    f, f_tiles = _tiles(faces.select("id", F.col("embedding").alias("vec")), "id", n_faces, TILE_FACES)
    never = F.array().cast("array<bigint>")
    if rejected is not None:
        by = rejected.groupBy("id").agg(F.collect_set("personId").alias("never"))  # what a user rejected for one face
        f = f.join(by, "id", "left").withColumn("never", F.coalesce("never", never))
    else:
        f = f.withColumn("never", never)
    times = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    e = e.select(F.lit(True).alias("isExample"), "id", "personId", "vec", "_wide", never.alias("never"), F.col("_tile").alias("et"), times(f_tiles).alias("ft"))
    f = f.select(F.lit(False).alias("isExample"), "id", F.lit(None).cast("long").alias("personId"), "vec", "_wide", "never", times(e_tiles).alias("et"), F.col("_tile").alias("ft"))

    def run(group: pa.Table) -> pa.Table:
        is_example, ids = group.column("isExample").to_numpy(), group.column("id").to_numpy()
        x = unit(matrix(group.column("vec"), dim))
        at_e, at_f = np.flatnonzero(is_example), np.flatnonzero(~is_example)
        person = group.column("personId").take(pa.array(at_e)).to_numpy()
        order = np.argsort(person, kind="stable")
        at_e, person = at_e[order], person[order]
        wide = group.column("_wide").to_numpy()[at_e]
        names, starts = np.unique(person, return_index=True)
        barred = group.column("never").to_pylist()
        out, parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], []
        for lo in range(0, len(at_f) if len(at_e) else 0, 512):
            own = at_f[lo : lo + 512]
            score = x[own] @ x[at_e].T
            score[ids[own][:, None] == ids[at_e][None, :]] = np.nan
            mean = np.full((len(own), len(names)), np.nan)
            for j, (a, b) in enumerate(zip(starts, [*starts[1:], len(at_e)], strict=True)):
                top = score[:, a:b] if b - a <= k else -np.partition(np.where(np.isnan(score[:, a:b]), np.inf, -score[:, a:b]), k - 1, axis=1)[:, :k]
                top = np.where(np.isinf(top), np.nan, top)
                if wide[a]:
                    parts += [(int(ids[own[i]]), int(names[j]), t[~np.isnan(t)].tolist()) for i, t in enumerate(top) if names[j] not in barred[own[i]]]
                else:
                    known = ~np.isnan(top)
                    with np.errstate(invalid="ignore"):
                        mean[:, j] = np.where(known, top, 0).sum(1) / known.sum(1)
            for i, at in enumerate(own):
                if barred[at]:
                    mean[i, np.isin(names, barred[at])] = np.nan
            keep = ~np.isnan(mean)
            row, column = np.nonzero(keep)
            value = mean[row, column]
            order = np.lexsort((names[column], -value, row))
            row, column, value = row[order], column[order], value[order]
            first = np.flatnonzero(np.r_[True, np.diff(row) != 0]) if len(row) else np.zeros(0, int)
            rank = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
            row, column, value = row[rank < best], column[rank < best], value[rank < best]
            out.append((ids[own[row]], names[column], value))
        i, p, s = (np.concatenate(c) for c in zip(*out, strict=True))
        m = len(i)
        return pa.table({
            "id": np.r_[i, np.array([t[0] for t in parts], np.int64)], "personId": np.r_[p, np.array([t[1] for t in parts], np.int64)],
            "score": pa.array([*s, *[None] * len(parts)], pa.float64()), "top": pa.array([*[None] * m, *[t[2] for t in parts]], pa.list_(pa.float64())),
        })

    grouped = e.unionByName(f)
    spark = grouped.sparkSession
    if e_tiles * f_tiles > int(spark.conf.get("spark.sql.shuffle.partitions")):
        grouped = grouped.repartition(min(200_000, e_tiles * f_tiles), "et", "ft")
    found = grouped.groupBy("et", "ft").applyInArrow(run, "id bigint, personId bigint, score double, top array<double>")
    if is_small(held.where(F.col("n") > TILE_ROWS), 0):
        return found.select("id", "personId", "score")
    found = cut(found, "means")
    merged = found.where("top is not null").groupBy("id", "personId").agg(F.slice(F.sort_array(F.flatten(F.collect_list("top")), False), 1, k).alias("top"))
    merged = merged.where(F.size("top") > 0).select("id", "personId", (F.aggregate("top", F.lit(0.0), lambda s, x: s + x) / F.size("top")).alias("score"))
    return found.where("top is null").select("id", "personId", "score").unionByName(merged)


def assign_by_examples(examples: DataFrame, faces: DataFrame, dim: int, k: int = CONF.knn_neighbours, least: float = CONF.knn_min_score, margin: float = CONF.knn_margin, rejected: DataFrame | None = None) -> DataFrame:
    """(id, personId, score): the person of highest mean cosine to its k nearest examples, if clear enough.

    examples(id, personId, embedding), faces(id, embedding), rejected(faceId, personId). Persons rejected for a face don't
    count at all; the best must reach `least` and lead the second by `margin`. Ties go to the smaller person id.
    """
    no = rejected.select(F.col("faceId").alias("id"), "personId").distinct() if rejected is not None else None
    found = _means(examples, faces, dim, k, no)
    order = Window.partitionBy("id").orderBy(F.desc("score"), "personId")
    found = found.select("*", F.row_number().over(order).alias("r"), F.lead("score").over(order).alias("second")).where("r = 1")
    return found.where((F.col("score") >= least) & (F.col("second").isNull() | (F.col("score") - F.col("second") >= margin))).select("id", "personId", "score")


def self_check(examples: DataFrame, dim: int, checks: DataFrame | None = None, **kw) -> DataFrame:
    """Outcome counts when each example (or each of checks) is assigned by all the others: right, wrong, none."""
    checks = examples if checks is None else checks
    got = assign_by_examples(examples, checks, dim, **kw).select("id", F.col("personId").alias("got"))
    outcome = F.when(F.col("got").isNull(), "none").when(F.col("got") == F.col("personId"), "right").otherwise("wrong")
    return checks.select("id", "personId").join(got, "id", "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("faces"))


def like_artifacts(artifacts: DataFrame, faces: DataFrame, dim: int, k: int = CONF.knn_neighbours, least: float = CONF.artifact_score) -> DataFrame:
    """(id, score) of unlocked faces whose k best cosines to artifacts have a mean of at least `least`."""
    one = artifacts.select("id", F.lit(0).cast("long").alias("personId"), "embedding")
    return _means(one, faces.where("lockedPersonId is null"), dim, k).select("id", "score").where(F.col("score") >= least)


def centroids(vectors: DataFrame, key: str, dim: int) -> DataFrame:
    """(key, n, centroid): unit vector of each group's sum of unit vectors; partial sums first, so groups may be large."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(key).to_numpy(zero_copy_only=False)
            x = unit(matrix(batch.column("vec"), dim))
            order = np.argsort(k, kind="stable")
            starts = np.flatnonzero(np.r_[True, k[order][1:] != k[order][:-1]]) if len(k) else np.zeros(0, int)
            if len(starts):
                yield pa.RecordBatch.from_arrays([pa.array(k[order][starts]), pa.array(np.diff(np.r_[starts, len(k)])), pa.array(list(np.add.reduceat(x[order], starts, axis=0)), pa.list_(pa.float64()))], names=[key, "n", "vec"])

    schema = f"{key} bigint, n bigint, vec array<double>"
    sums = vectors.select(key, "vec").mapInArrow(partial, schema).groupBy(key).applyInArrow(_summing(key, dim), schema)
    length = F.sqrt(dot(F.col("vec"), F.col("vec")))
    return sums.select(key, "n", F.transform("vec", lambda x: F.try_divide(x, length)).alias("centroid"))


def _summing(key: str, dim: int):
    def add(group: pa.Table) -> pa.Table:
        x = group.column("vec").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        return pa.table({key: group.column(key)[:1], "n": pa.array([int(group.column("n").to_numpy().sum())], pa.int64()), "vec": pa.array([x.sum(0)], pa.list_(pa.float64()))})

    return add


def suggestions(centroid: DataFrame, person: int, dismissed: DataFrame | None = None, least: float = CONF.suggestion_score, most: int = 3) -> DataFrame:
    """Persons whose centroid is near a person's own: (personId, score), best first, without those dismissed."""
    own = centroid.where(F.col("personId") == person).select(F.col("centroid").alias("own")).limit(1)
    rows = centroid.where(F.col("personId") != person).join(F.broadcast(own)).select("personId", dot(F.col("centroid"), F.col("own")).alias("score"))
    if dismissed is not None:
        other = dismissed.where((F.col("personA") == person) | (F.col("personB") == person)).select(F.when(F.col("personA") == person, F.col("personB")).otherwise(F.col("personA")).alias("personId"))
        rows = rows.join(other, "personId", "left_anti")
    return rows.where(F.col("score") >= least).orderBy(F.desc("score"), "personId").limit(most)


def inherit(clusters: DataFrame, votes: DataFrame, least: float = CONF.inherit_share) -> DataFrame:
    """(cluster, personId): by falling size each cluster takes the unused person with most of its faces, if it has enough.

    clusters(cluster, size, anchor): an anchor is the cluster's person, and used from the start. votes(cluster, personId,
    n). A person must hold a share of at least `least`; ties go to the smaller cluster and person. As in a marriage of
    ranked wishes, the order of size decides: every round the best remaining wish of each cluster is granted where no
    larger cluster has it too, so nothing is walked one by one and rounds end with the longest chain of refusals.
    """
    open_ = clusters.where("anchor is null").select("cluster", "size")
    taken = clusters.where("anchor is not null").select(F.col("anchor").alias("personId"))
    wish = votes.join(open_, "cluster").where(F.col("n") >= F.col("size") * least).join(taken, "personId", "left_anti").select("cluster", "size", "personId", "n")
    wish = cut(wish, "heirs")
    found = clusters.where("anchor is not null").select("cluster", F.col("anchor").alias("personId"))
    while not wish.isEmpty():
        own = Window.partitionBy("cluster").orderBy(F.desc("n"), "personId")
        rival = Window.partitionBy("personId").orderBy(F.desc("size"), "cluster")
        first = wish.withColumn("r", F.row_number().over(own))
        # A wish is safe if it is the cluster's first and no larger cluster could still want the person.
        safe = first.withColumn("q", F.row_number().over(rival)).where("r = 1 and q = 1").select("cluster", "personId")
        safe = cut(safe, "heirs-safe")
        found = found.unionByName(safe)
        wish = cut(wish.join(safe.select("cluster"), "cluster", "left_anti").join(safe.select("personId"), "personId", "left_anti").select("cluster", "size", "personId", "n"), "heirs")
    return found
