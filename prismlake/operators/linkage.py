"""Average-linkage clusters with anchors and bans: dense for small sets, sparse over a neighbour graph for large ones."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismlake.conf import CONF
from prismlake.functions.vectors import dot
from prismlake.operators.components import components
from prismlake.operators.people import centroids
from prismlake.operators.similarity import neighbours
from prismlake.tables import cut, discard, is_small


#: A connected set of up to so many rows is linked in one task; larger ones by rounds of joins.
TASK_ROWS = 20_000
#: A person with more examples than this is linked over a neighbour graph instead of all pairs.
DENSE_ROWS = 2_048


def average_linkage(x: np.ndarray, least: float, anchor: list[int | None] | None = None, bans: list[tuple[int, int]] = ()) -> np.ndarray:
    """Labels of unit vectors: groups of highest mean cosine merge while it is at least `least`.

    Rows of one anchor start together, different anchors never merge, nor do groups that hold a banned pair. Merges follow
    chains of nearest neighbours, which for mean linkage end in the same groups as always merging the best pair.
    """
    n = len(x)
    anchor = list(anchor or [None] * n)
    start: dict = {}
    group = [start.setdefault(("a", anchor[i]) if anchor[i] is not None else ("i", i), len(start)) for i in range(n)]
    k = len(start)
    onto = np.zeros((k, n))
    onto[group, np.arange(n)] = 1
    size = onto.sum(1)
    mean = onto @ (x @ x.T) @ onto.T / np.outer(size, size)
    named = np.array([key[0] == "a" for key in start], bool)
    mean[named[:, None] & named[None, :]] = -np.inf
    for i, j in bans:
        if group[i] != group[j]:
            mean[group[i], group[j]] = mean[group[j], group[i]] = -np.inf
    np.fill_diagonal(mean, -np.inf)
    label, open_, chain = np.arange(k), np.ones(k, bool), []
    while open_.any():
        if not chain:
            chain = [int(open_.argmax())]
        tip = chain[-1]
        to = int(mean[tip].argmax())
        if mean[tip, to] < least:  # nothing can reach it any more, as means only average out
            open_[tip] = False
            mean[tip] = mean[:, tip] = -np.inf
            chain.pop()
            continue
        if len(chain) > 1 and mean[tip, chain[-2]] >= mean[tip, to]:
            a, b = sorted((tip, chain[-2]))
            chain = chain[:-2]
            both = (size[a] * mean[a] + size[b] * mean[b]) / (size[a] + size[b])
            both[[a, b]] = -np.inf
            mean[a], mean[:, a] = both, both
            mean[b] = mean[:, b] = -np.inf
            size[a] += size[b]
            open_[b] = False
            label[label == b] = a
        else:
            chain.append(to)
    return label[group]


def sparse_linkage(x: np.ndarray, edges: list[tuple[int, int]], least: float, media: list[int] | None = None, anchor: list[int | None] | None = None, rejected: list[set[int]] | None = None, penalty: float = 1.1) -> np.ndarray:
    """As average_linkage, over candidate pairs only: mean cosine from group sums, a heap of candidates, lazily renewed.

    Two faces of one media lower the mean by `penalty` for each pair of theirs, and their groups don't merge while below
    `least`. A row rejected for a person never joins a group anchored to it.
    """
    n = len(x)
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    sums, size = x.astype(np.float64).copy(), np.ones(n)
    held = [{media[i]: 1} if media is not None else {} for i in range(n)]
    owner = list(anchor or [None] * n)
    banned = [set(r) for r in rejected] if rejected else [set() for _ in range(n)]
    near: list[set[int]] = [set() for _ in range(n)]

    def join(a: int, b: int) -> None:
        parent[b] = a
        sums[a] += sums[b]
        size[a] += size[b]
        for m, c in held[b].items():
            held[a][m] = held[a].get(m, 0) + c
        owner[a] = owner[a] if owner[a] is not None else owner[b]
        banned[a] |= banned[b]
        near[a] |= near[b]

    first: dict = {}
    for i, who in enumerate(owner):
        if who is not None:
            if who in first:
                join(find(first[who]), i)
            else:
                first[who] = i

    def score(a: int, b: int) -> float:
        if owner[a] is not None and owner[b] is not None and owner[a] != owner[b]:
            return -np.inf
        if owner[a] in banned[b] - {None} or owner[b] in banned[a] - {None}:
            return -np.inf
        small, large = (held[a], held[b]) if len(held[a]) < len(held[b]) else (held[b], held[a])
        same = sum(c * large.get(m, 0) for m, c in small.items())
        return float(sums[a] @ sums[b] - penalty * same) / (size[a] * size[b])

    heap = []
    for i, j in edges:
        a, b = sorted((find(i), find(j)))
        if a != b and b not in near[a]:
            near[a].add(b)
            near[b].add(a)
            if (s := score(a, b)) >= least:
                heap.append((-s, a, b))
    heapq.heapify(heap)
    while heap:
        s, a, b = heapq.heappop(heap)
        if parent[a] != a or parent[b] != b:
            continue
        now = score(a, b)
        if now < -s - 1e-6:
            if now >= least:
                heapq.heappush(heap, (-now, a, b))
            continue
        join(a, b)
        for c in {find(c) for c in near[a]} - {a}:
            near[c].add(a)
            if (s := score(a, c)) >= least:
                heapq.heappush(heap, (-s, *sorted((a, c))))
        near[a] = {find(c) for c in near[a]} - {a}
    return np.array([find(i) for i in range(n)])


def _rounds(rows: DataFrame, edges: DataFrame, least: float, penalty: float, banned: DataFrame) -> DataFrame:
    """(a, b): merges of groups by rounds, in each of which all pairs merge that prefer each other to anything else.

    rows(id, vec, mediaId, anchor), edges(a, b), banned(id, personId). For mean linkage such merges never spoil a better
    one, so the groups are those of merging the best pair each time. A round is a few joins and aggregations over group
    sums; vectors of a group meet by partial sums only.
    """
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    first = F.coalesce(F.min("id").over(Window.partitionBy("anchor")), F.col("id"))
    rows = rows.withColumn("g", F.when(F.col("anchor").isNotNull(), first).otherwise(F.col("id")))
    rows = cut(rows.select("id", "g", "mediaId", "anchor", F.transform("vec", lambda v: v / norm).alias("vec")), "rounds-rows")
    sums = centroid_sums(rows.select("g", "vec"), "g", rows)
    groups = cut(sums.join(rows.groupBy("g").agg(F.max("anchor").alias("anchor")), "g"), "rounds-groups")
    media = cut(rows.where("mediaId is not null").groupBy("g", "mediaId").agg(F.count("*").alias("c")), "rounds-media")
    never = cut(rows.select("id", "g").join(banned, "id").select("g", "personId").distinct(), "rounds-never")
    of = rows.select("id", "g")
    ends = edges.join(of.select(F.col("id").alias("a"), F.col("g").alias("ga")), "a").join(of.select(F.col("id").alias("b"), F.col("g").alias("gb")), "b")
    near = cut(ends.select(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).where("a <> b").distinct(), "rounds-near")
    done = rows.where("id <> g").select(F.col("id").alias("a"), F.col("g").alias("b"))
    while True:
        side = lambda s: groups.select(F.col("g").alias(s), F.col("vec").alias(f"v{s}"), F.col("size").alias(f"n{s}"), F.col("anchor").alias(f"o{s}"))  # noqa: B023, E731
        pairs = near.join(side("a"), "a").join(side("b"), "b").where("oa is null or ob is null or oa = ob")
        for one, other in (("a", "b"), ("b", "a")):
            bar = never.select(F.col("g").alias(one), F.col("personId").alias(f"o{other}"))
            pairs = pairs.join(bar, [one, f"o{other}"], "left_anti")
        both = near.join(media.select(F.col("g").alias("a"), "mediaId", F.col("c").alias("ca")), "a").join(media.select(F.col("g").alias("b"), "mediaId", F.col("c").alias("cb")), ["b", "mediaId"])
        same = both.groupBy("a", "b").agg(F.sum(F.col("ca") * F.col("cb")).alias("same"))
        dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
        score = (dot - penalty * F.coalesce("same", F.lit(0))) / (F.col("na") * F.col("nb"))
        scored = pairs.join(same, ["a", "b"], "left").select("a", "b", score.alias("score")).where(F.col("score") >= least)
        scored = cut(scored, "rounds-scored")
        wish = scored.select("a", "b", "score").unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
        best = wish.groupBy("a").agg(F.max(F.struct("score", (-F.least("a", "b")).alias("l"), (-F.greatest("a", "b")).alias("h"), "b"))["b"].alias("b"))
        merge = cut(best.alias("x").join(best.alias("y"), (F.col("x.a") == F.col("y.b")) & (F.col("x.b") == F.col("y.a"))).where("x.a > x.b").select("x.a", "x.b"), "rounds-merge")
        if merge.isEmpty():
            return done
        done = done.unionByName(merge)
        into = F.broadcast(merge) if is_small(merge, 100_000) else merge
        moved = lambda df, c: df.join(into.select(F.col("a").alias(c), F.col("b").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")  # noqa: B023, E731
        joined = moved(groups, "g")
        # At most two rows of a group: its own and the one that joins it.
        add = F.when(F.count("*") == 1, F.min_by("vec", "size")).otherwise(F.zip_with(F.min_by("vec", F.struct("size", "vec")), F.max_by("vec", F.struct("size", "vec")), lambda x, y: x + y))
        old = groups, media, never, near, scored
        groups = cut(joined.groupBy("g").agg(add.alias("vec"), F.sum("size").alias("size"), F.max("anchor").alias("anchor")), "rounds-groups")
        media = cut(moved(media, "g").groupBy("g", "mediaId").agg(F.sum("c").alias("c")), "rounds-media")
        never = cut(moved(never, "g").distinct(), "rounds-never")
        near = moved(moved(near, "a"), "b")
        near = cut(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "rounds-near")
        discard(*old)


def centroid_sums(vectors: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """(key, vec, size): sums of vectors(key, vec) by group; each task adds up its own rows first."""
    one = rows.select(F.size("vec").alias("n")).first()
    dim = one["n"] if one else 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                k = batch.column(key).to_numpy()
                x = batch.column("vec").flatten().to_numpy().reshape(-1, dim)
                order = np.argsort(k, kind="stable")
                starts = np.flatnonzero(np.r_[True, k[order][1:] != k[order][:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(k[order][starts]), pa.array(list(np.add.reduceat(x[order], starts, axis=0)), pa.list_(pa.float64())), pa.array(np.diff(np.r_[starts, len(k)]))], names=[key, "vec", "size"])

    def total(group: pa.Table) -> pa.Table:
        x = group.column("vec").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        return pa.table({key: group.column(key)[:1], "vec": pa.array([x.sum(0)], pa.list_(pa.float64())), "size": pa.array([int(group.column("size").to_numpy().sum())], pa.int64())})

    schema = f"{key} bigint, vec array<double>, size bigint"
    return vectors.select(key, "vec").mapInArrow(partial, schema).groupBy(key).applyInArrow(total, schema)


def link(rows: DataFrame, edges: DataFrame, least: float, rejected: DataFrame | None = None, penalty: float = CONF.same_photo_penalty, task_rows: int = TASK_ROWS) -> DataFrame:
    """(id, cluster): sparse average linkage of rows(id, vec, mediaId, anchor), edges(a, b) being candidate pairs.

    rejected(faceId, personId): a row never joins a group anchored to that person. Groups can't cross components of the
    edges and shared anchors. A component of up to task_rows rows is linked by itself in one task; larger ones, of any
    size, by rounds over all of them. cluster is the smallest id.
    """
    banned = (rejected if rejected is not None else rows.sparkSession.createDataFrame([], "faceId long, personId long")).select(F.col("faceId").alias("id"), "personId").distinct()
    anchored = rows.where("anchor is not null")
    star = anchored.join(anchored.groupBy("anchor").agg(F.min("id").alias("b")), "anchor").select(F.col("id").alias("a"), "b")
    joined = cut(components(edges.select("a", "b").unionByName(star)).select(F.col("node").alias("id"), "component"), "link-components")
    large = cut(joined.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > task_rows).select("component"), "link-large")  # at most rows / task_rows
    named = rows.select("id", "vec", "mediaId", "anchor").join(joined, "id").join(banned.groupBy("id").agg(F.collect_set("personId").alias("banned")), "id", "left")
    small = lambda df: df.join(F.broadcast(large), "component", "left_anti")
    # Rows and edges of a component come together in one table: no list of edges is ever one value.
    columns = "component bigint, id bigint, vec array<float>, mediaId bigint, anchor bigint, banned array<bigint>, other bigint"
    nodes = small(named).select("component", "id", F.col("vec").cast("array<float>").alias("vec"), "mediaId", "anchor", "banned", F.lit(None).cast("long").alias("other"))
    inner = small(edges.join(joined.withColumnRenamed("id", "a"), "a")).select("component", F.col("a").alias("id"), *[F.lit(None).cast(t).alias(c) for c, t in (("vec", "array<float>"), ("mediaId", "long"), ("anchor", "long"), ("banned", "array<bigint>"))], F.col("b").alias("other"))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        ends = df[df["vec"].isna()]
        df = df[~df["vec"].isna()].sort_values("id").reset_index(drop=True)
        x = np.stack(df["vec"].to_numpy()).astype(float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        ids = df["id"].to_numpy()
        a, b = np.searchsorted(ids, ends["id"].to_numpy()), np.searchsorted(ids, ends["other"].to_numpy(dtype=np.int64))
        media = [(-1, i) if pd.isna(m) else int(m) for i, m in enumerate(df["mediaId"])]
        anchor = [None if pd.isna(v) else int(v) for v in df["anchor"]]
        label = sparse_linkage(x, list(zip(a.tolist(), b.tolist(), strict=True)), least, media, anchor, [set() if v is None else {int(p) for p in v} for v in df["banned"]], penalty)
        low = df.groupby(label)["id"].min()
        return pd.DataFrame({"id": df["id"], "cluster": low.loc[label].to_numpy()})

    found = nodes.unionByName(inner).groupBy("component").applyInPandas(run, "id long, cluster long")
    alone = rows.select("id").join(joined.select("id"), "id", "left_anti").select("id", F.col("id").alias("cluster"))
    found = found.unionByName(alone)
    if large.isEmpty():
        return found
    wide = named.join(F.broadcast(large), "component", "left_semi")
    ends = edges.join(joined.withColumnRenamed("id", "a"), "a").join(F.broadcast(large), "component", "left_semi").select("a", "b")
    merged = components(_rounds(wide.select("id", "vec", "mediaId", "anchor"), ends, least, penalty, banned)).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    return found.unionByName(wide.select("id").join(merged, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster")))


def consistent_examples(x: np.ndarray, least: float = 0.35, mode: float = 0.45) -> np.ndarray:
    """Which of a person's examples to trust: those of sub-clusters whose centre is near the largest one's; two pass as they are."""
    if len(x) <= 2:
        return np.ones(len(x), bool)
    label = average_linkage(x, least)
    names, counts = np.unique(label, return_counts=True)
    centre = {n: x[label == n].sum(0) for n in names}
    centre = {n: c / (np.linalg.norm(c) or 1) for n, c in centre.items()}
    main = names[np.lexsort((names, -counts))[0]]
    kept = [n for n in names if n == main or centre[n] @ centre[main] >= mode]
    return np.isin(label, kept)


def trusted(examples: DataFrame, dim: int, least: float = CONF.example_link, mode: float = CONF.example_mode_link) -> DataFrame:
    """(personId, id) of examples(personId, id, embedding) that agree with the rest of their person's; ids are unique.

    Persons of up to DENSE_ROWS examples are linked over all pairs in one task, larger ones over their nearest neighbours.
    """
    rows = examples.select("personId", "id", "embedding")
    large = cut(rows.groupBy("personId").agg(F.count("*").alias("n")).where(F.col("n") > DENSE_ROWS).select("personId"), "trusted-large")

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("id")
        x = np.stack(df["embedding"].to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
        return df[consistent_examples(x, least, mode)][["personId", "id"]]

    found = rows.join(F.broadcast(large), "personId", "left_anti").groupBy("personId").applyInPandas(run, "personId long, id long")
    if large.isEmpty():
        return found
    wide = cut(rows.join(F.broadcast(large), "personId", "left_semi").withColumnRenamed("embedding", "vec"), "trusted-wide")
    near = neighbours(wide.select("id", "vec"), wide.count(), dim, CONF.face_neighbours, least)
    of = wide.select("id", "personId")
    edges = near.join(of, "id").join(of.select(F.col("id").alias("other"), F.col("personId").alias("p")), "other").where("personId = p")
    edges = cut(edges.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct(), "trusted-edges")
    label = cut(link(wide.select("id", "vec", F.lit(None).cast("long").alias("mediaId"), F.lit(None).cast("long").alias("anchor")), edges, least).join(wide, "id"), "trusted-labels")
    centre = label.select("cluster", "personId").distinct().join(centroids(label.select("cluster", "vec"), "cluster", dim), "cluster")
    main = centre.groupBy("personId").agg(F.max_by("centroid", F.struct("n", -F.col("cluster"))).alias("main"), F.max_by("cluster", F.struct("n", -F.col("cluster"))).alias("first"))
    kept = centre.join(main, "personId").where((F.col("cluster") == F.col("first")) | (dot(F.col("centroid"), F.col("main")) >= mode)).select("cluster")
    return found.unionByName(label.join(kept, "cluster", "left_semi").select("personId", "id"))
