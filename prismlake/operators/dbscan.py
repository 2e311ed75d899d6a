"""Density clusters of vectors or over a similarity graph, and the albums made of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismlake.conf import CONF
from prismlake.functions.dates import span_label
from prismlake.operators.cells import gather, matrix, place, tiled, unit
from prismlake.operators.components import components
from prismlake.operators.similarity import CELL_ROWS, sides, told, whole
from prismlake.tables import cut, discard, is_small

#: Pairs that a tile scores at once.
PAIRS = 4 << 20


def dbscan(ids: DataFrame, edges: DataFrame, min_points: int = CONF.album_min_points) -> DataFrame:
    """(id, cluster): cluster is the smallest core id of the cluster, -1 for noise.

    ids(id), edges(a, b) with each pair once. A core point has min_points neighbours, itself included. Cores that touch
    share a cluster; a border point goes to the cluster of its smallest core neighbour.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    core = both.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") + 1 >= min_points).select(F.col("a").alias("id"))
    if min_points <= 1:
        core = ids.select("id")
    core = cut(core, "dbscan-core")
    inner = edges.join(core.select(F.col("id").alias("a")), "a", "left_semi").join(core.select(F.col("id").alias("b")), "b", "left_semi")
    joined = components(inner).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    core = cut(core.join(joined, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster")), "dbscan-labels")
    border = both.join(core.select(F.col("id").alias("b"), "cluster"), "b").groupBy("a").agg(F.min_by("cluster", "b").alias("near")).select(F.col("a").alias("id"), "near")
    return ids.select("id").join(core, "id", "left").join(border, "id", "left").select("id", F.coalesce("cluster", "near", F.lit(-1)).cast("long").alias("cluster"))


def density(vectors: DataFrame, n: int, dim: int, least: float, min_points: int = CONF.album_min_points, part: str | None = None) -> DataFrame:
    """(id, cluster, links): density clusters of vectors(id, vec) without ever writing their pairs down.

    links: partners of cosine (12 places) >= least; a core has min_points rows around it, itself included. cluster is the
    smallest core id of the cluster, for a border row that of its smallest core neighbour, -1 for noise. part: a column;
    only rows equal in it are partners. Exact: every tile of the vector cells counts its rows' partners, then tells which
    of its cores it connects (a tree, not the pairs), and each other row's smallest core. vectors is read several times and
    must give the same rows in the same order each time, as a table written by cut() does.
    """
    spread = whole(dim)
    pivots = gather(vectors, n, dim, CELL_ROWS, least, spread)
    keep = [part] if part else []
    size = 4 * dim + 48

    def near(group: pa.Table, ask: np.ndarray, at: np.ndarray, x: np.ndarray):
        """Chunks of partners (one of `ask`, one of `at`), pair by pair; the decision is made in double precision."""
        small, ids = x.astype(np.float32), group.column("id").to_numpy()
        label = group.column(part).to_numpy() if part else None
        across, step = np.ascontiguousarray(small[at].T), max(1, min(512, PAIRS // max(1, len(at))))
        for lo in range(0, len(ask) if len(at) else 0, step):
            score = small[ask[lo : lo + step]] @ across
            flat = np.flatnonzero(score >= least - 1e-5)
            a, b = ask[lo + flat // len(at)], at[flat % len(at)]
            keep = ids[a] != ids[b]
            if part:
                keep &= label[a] == label[b]
            unsure = np.flatnonzero(keep & (score.ravel()[flat] < least + 1e-5))
            keep[unsure] = np.round(np.einsum("ij,ij->i", x[a[unsure]], x[b[unsure]]), 12) >= least
            yield a[keep], b[keep]

    def degrees(group: pa.Table) -> pa.Table:
        x, ids = unit(matrix(group.column("vec"), dim)), group.column("id").to_numpy()
        at, ask, _ = sides(group, pivots)
        count, back = np.zeros(len(ids), np.int64), told(group, pivots)
        for a, b in near(group, ask, at, x):
            count += np.bincount(b, minlength=len(ids)) + np.bincount(a, minlength=len(ids)) * back
        return pa.table({**{c: group.column(c) for c in where}, "id": ids, "links": count})

    where = ["cell", "block", "tile"]
    placed = place(vectors, pivots, least, spread, keep)
    there = cut(tiled(placed, pivots, size).applyInArrow(degrees, "cell int, block int, tile int, id bigint, links bigint"), "density-tiles")
    counted = cut(there.groupBy("id").agg(F.sum("links").alias("links")).where("links > 0"), "density-links")
    core = F.col("links") + 1 >= min_points
    # What a row is goes to its tiles beside it, as rows without a vector: vectors are never joined, so not shuffled by id.
    marks = there.select(*where, "id").join(counted.select("id", core.alias("core")), "id", "left")

    def connect(group: pa.Table) -> pa.Table:
        has = pc.is_valid(group.column("vec"))
        known, group = group.filter(pc.invert(has)), group.filter(has)
        by, of = np.argsort(known.column("id").to_numpy()), np.argsort(group.column("id").to_numpy())
        if not np.array_equal(known.column("id").to_numpy()[by], group.column("id").to_numpy()[of]):
            raise RuntimeError("density: vectors must be a stored table, as rows came to other tiles the second time")
        mark = known.column("core").take(pa.array(by))
        touched = np.flatnonzero(pc.is_valid(mark).to_numpy())
        if not len(touched):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "core": pa.array([], pa.bool_())})
        group, is_core = group.take(pa.array(of[touched])), mark.take(pa.array(touched)).to_numpy().astype(bool)
        x, ids = unit(matrix(group.column("vec"), dim)), group.column("id").to_numpy()
        at, ask, _ = sides(group, pivots)
        # Border rows at home may touch cores of another block, or of visitors from afar, only.
        back = told(group, pivots)
        label, least_core = np.arange(len(ids)), np.full(len(ids), np.iinfo(np.int64).max)
        for a, b in near(group, ask, at, x):
            both = is_core[a] & is_core[b]
            _connect(label, a[both], b[both])
            border = is_core[b] & ~is_core[a]
            np.minimum.at(least_core, a[border], ids[b[border]])
            border = is_core[a] & ~is_core[b] & back[a]
            np.minimum.at(least_core, b[border], ids[a[border]])
        root = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(root, label, ids)
        tree = np.flatnonzero(is_core & (ids != root[label]))
        border = np.flatnonzero(least_core < np.iinfo(np.int64).max)
        return pa.table({"a": np.r_[ids[tree], ids[border]], "b": np.r_[root[label[tree]], least_core[border]], "core": np.r_[np.ones(len(tree), bool), np.zeros(len(border), bool)]})

    rows_and_marks = placed.withColumn("core", F.lit(None).cast("boolean")).unionByName(marks, allowMissingColumns=True)
    found = cut(tiled(rows_and_marks, pivots, size).applyInArrow(connect, "a bigint, b bigint, core boolean"), "density-trees")
    discard(there)
    joined = components(found.where("core")).select(F.col("node").alias("id"), "component")
    cores = counted.where(core).join(joined, "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
    if min_points <= 1:
        alone = vectors.select("id").join(counted.select("id"), "id", "left_anti").select("id", F.col("id").alias("cluster"))
        cores = cores.unionByName(alone)
    cores = cut(cores, "density-cores")
    # The smallest core neighbour over all tiles decides.
    border = found.where("not core").groupBy("a").agg(F.min("b").alias("b")).join(cores.select(F.col("id").alias("b"), "cluster"), "b").select(F.col("a").alias("id"), "cluster")
    named = cores.unionByName(border)
    rows = vectors.select("id").join(counted, "id", "left").join(named, "id", "left")
    return rows.select("id", F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def _connect(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives rows a[i] and b[i], and whatever shares a label with them, one label; label[i] is a row, that of itself at a root."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def refine(vectors: DataFrame, labels: DataFrame, dim: int, eps: float, min_points: int = CONF.album_min_points, step: float = 0.02, floor: float = 0.04, rounds: int = 2, largest: int = CONF.refine_largest, share: float = CONF.refine_share) -> DataFrame:
    """(id, cluster): clusters of labels(id, cluster) that are too large are clustered again, inside, with a smaller radius.

    Too large: more than `largest` rows and more than `share` of all. Up to `rounds` times, while the radius keeps to the
    floor. If nothing is found inside, the cluster stays; else rows outside the new ones are noise.
    """
    labels = cut(labels.select("id", "cluster"), "refine")
    limit = max(largest, int(share * labels.count()))
    for _ in range(rounds):
        eps -= step
        if eps < floor - 1e-9:
            break
        big = labels.where("cluster >= 0").groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("cluster")
        members = cut(labels.join(big, "cluster", "left_semi").join(vectors.select("id", "vec"), "id"), "refine")
        n = members.count()
        if not n:
            break
        new = density(members, n, dim, 1 - eps, min_points, "cluster").select("id", F.col("cluster").alias("new")).join(members.select("id", "cluster"), "id")
        found = new.groupBy("cluster").agg(F.max("new").alias("any"))
        new = new.join(found, "cluster").select("id", F.when(F.col("any") >= 0, F.col("new")).otherwise(F.col("cluster")).alias("new"))
        old, labels = labels, cut(labels.join(new, "id", "left").select("id", F.coalesce("new", "cluster").alias("cluster")), "refine")
        discard(old, members)
    return labels


def smart_albums(labels: DataFrame, vectors: DataFrame, media: DataFrame, dim: int, topics: list[tuple[str, list[float]]] | None = None, topic_least: float = CONF.topic_score, least: int = CONF.album_min_rows) -> DataFrame:
    """(album, position, items, cover, first, last, name): one album a cluster, largest first.

    The cover is the member nearest to the centre. The name is the nearest topic if it reaches topic_least; one used
    before gets the span of dates, and if that was used too a number. Without a topic it is a general title with the span,
    numbered from the second on. Fewer than `least` vectors give no albums. Albums are few: they are ordered in one task.
    """
    from prismlake.operators.people import centroids
    from prismlake.operators.similarity import nearest_topic

    labels = labels.where("cluster >= 0")
    if is_small(vectors, least - 1):
        labels = labels.limit(0)
    rows = labels.join(vectors, "id")
    centre = centroids(rows.withColumnRenamed("cluster", "album"), "album", dim)
    from prismlake.functions.vectors import cosine

    scored = rows.join(centre, F.col("cluster") == F.col("album")).select("album", "id", cosine(F.col("vec"), F.col("centroid")).alias("score"))
    dated = scored.join(media.select("id", "dateTaken"), "id", "left")
    album = dated.groupBy("album").agg(F.count("*").alias("items"), F.max_by("id", F.struct("score", -F.col("id"))).alias("cover"), F.min("dateTaken").alias("first"), F.max("dateTaken").alias("last"))
    span = F.coalesce(span_label(F.col("first"), F.col("last")), F.lit("undated"))
    topic_name = F.lit(None).cast("string")
    if topics:
        topic = nearest_topic(centre.select(F.col("album").alias("id"), F.col("centroid").alias("vec")), topics, topic_least).select(F.col("id").alias("album"), "topic")
        album = album.join(topic, "album", "left")
        topic_name = F.col("topic")
    album = album.select("album", "items", "cover", "first", "last", topic_name.alias("topic"), span.alias("span"))
    album = album.withColumn("base", F.coalesce("topic", F.concat_ws(" · ", F.lit("Similar photos"), "span")))
    order = [F.desc("items"), F.col("album")]
    album = album.withColumn("nth", F.row_number().over(Window.partitionBy("base").orderBy(*order)))
    # Among the repeats of a topic the first of each span is told by it.
    repeat = F.col("topic").isNotNull() & (F.col("nth") > 1)
    album = album.withColumn("mth", F.row_number().over(Window.partitionBy("base", "span", repeat).orderBy(*order)))
    name = F.when(F.col("nth") == 1, F.col("base")).when(repeat & (F.col("mth") == 1), F.concat_ws(" · ", "base", "span")).otherwise(F.concat_ws(" · ", "base", F.col("nth").cast("string")))
    return album.select("album", F.row_number().over(Window.orderBy(*order)).alias("position"), "items", "cover", "first", "last", name.alias("name"))


def needs_rebuild(albums: int, pending: int, hours: float, most_pending: int = CONF.rebuild_pending, most_hours: float = CONF.rebuild_hours) -> bool:
    return albums == 0 or pending >= most_pending or (pending > 0 and hours >= most_hours)


def members_ranked(labels: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(album, id, position): members by falling cosine to their centre."""
    from prismlake.functions.vectors import cosine
    from prismlake.operators.people import centroids

    rows = labels.where("cluster >= 0").join(vectors, "id")
    centre = centroids(rows.withColumnRenamed("cluster", "album"), "album", dim)
    scored = rows.join(centre, F.col("cluster") == F.col("album")).select("album", "id", cosine(F.col("vec"), F.col("centroid")).alias("score"))
    return scored.select("album", "id", F.row_number().over(Window.partitionBy("album").orderBy(F.desc("score"), "id")).alias("position"))
