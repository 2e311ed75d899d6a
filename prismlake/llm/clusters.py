"""Similarity clusters of vectors: mergeable cluster features, agglomerated, then one assignment of every vector.

Every block of a vector cell grows a cluster-feature tree of its own: a feature is a number and a linear sum; a vector
goes down the branches nearest to it and into the leaf there whose mean cosine to it is high enough, or opens a new one;
a branch with too many leaves is split. The trees of a cell's blocks are merged two by two, level by level. Leaves are
then agglomerated by Ward's method, first for some rounds in cells of leaves, each leaf at home alone, so that a cluster's
leaves from many cells become few; what remains meets in every cell that one could share with its like, and what cells
agree on is closed over as connected components. A last pass holds every vector against the clusters' centres. Only
summaries move between the steps; they are as many as there are clusters and stray vectors. Leaves are grown and merged
at half precision; the last pass, which decides, uses the vectors as stored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismlake.operators.cells import Pivots, fit, from_halves, lists, matrix, place, split_repeats, tiled, unit, visit, visits
from prismlake.operators.components import components
from prismlake.tables import cut, discard

CELL_ROWS = 16_384
#: Leaves of a branch at most, and branches a vector goes down.
BRANCH, BEAM = 96, 3
#: Connected leaves up to so many are agglomerated by a matrix of all pairs, more by their near pairs.
DENSE_LEAVES = 1_024
#: Where leaves look for their like: least cosine and spread for those of several vectors, and for single ones.
MEET = ((True, 0.65, 2.0), (False, 0.80, 1.0))
#: Leaves of a cell in which they meet, rounds in which they do so at home alone, and leaves looked at to tell visitors.
MEET_ROWS, ROUNDS, MET_SAMPLE = 4_096, 2, 4_096


class Tree:
    """Cluster features of unit vectors under branches; grown by batches, merged by inserting another tree's leaves."""

    def __init__(self, dim: int, least: float):
        self.least = least
        self.sums, self.count = np.zeros((0, dim), np.float32), np.zeros(0, np.float64)
        self.branch, self.branches = np.zeros(0, np.int64), np.zeros((0, dim), np.float32)

    def nearest(self, x: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The leaf each vector may join, -1 for none."""
        best, to = np.full(len(x), -np.inf, np.float32), np.full(len(x), -1)
        if not len(self.count):
            return to
        mean = self.sums / self.count[:, None].astype(np.float32)
        if len(self.branches) <= BEAM:
            score = x @ mean.T
            to = score.argmax(1)
            best = score[np.arange(len(x)), to]
        else:
            score = x @ (self.branches / np.maximum(np.linalg.norm(self.branches, axis=1, keepdims=True), 1e-12)).T
            near = np.argpartition(-score, BEAM - 1, axis=1)[:, :BEAM]
            row, node = np.repeat(np.arange(len(x)), BEAM), near.ravel()
            order, under = np.argsort(node, kind="stable"), np.argsort(self.branch, kind="stable")
            rows, leaves = np.split(row[order], np.searchsorted(node[order], np.arange(1, len(self.branches)))), np.split(under, np.searchsorted(self.branch[under], np.arange(1, len(self.branches))))
            for r, own in zip(rows, leaves, strict=True):
                if len(r) and len(own):
                    score = x[r] @ mean[own].T
                    at = score.argmax(1)
                    top = score[np.arange(len(r)), at]
                    up = top > best[r]
                    best[r[up]], to[r[up]] = top[up], own[at[up]]
        return np.where(best >= self.least, to, -1)

    def insert(self, x: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The leaf of each of a batch of vectors (or of means, each of `weight` vectors)."""
        leaf = self.nearest(x, weight)
        free = np.flatnonzero(leaf < 0)
        rest = x[free]
        near = rest @ rest.T
        open_, first, new = np.ones(len(free), bool), [], 0
        for i in range(len(free)):
            if not open_[i]:
                continue
            members = open_ & (near[i] >= self.least)
            members[i] = True
            if members.sum() > 1:  # once more, by the mean over the seed's neighbours
                members |= open_ & (near[members].mean(0) >= self.least)
            open_ &= ~members
            leaf[free[members]] = len(self.count) + new
            first.append(free[i])
            new += 1
        if new:
            self.sums, self.count = np.concatenate([self.sums, np.zeros((new, x.shape[1]), np.float32)]), np.concatenate([self.count, np.zeros(new)])
            to = (x[first] @ self.branches.T / np.maximum(np.linalg.norm(self.branches, axis=1), 1e-12)).argmax(1) if len(self.branches) else np.zeros(new, np.int64)
            if not len(self.branches):
                self.branches = np.zeros((1, x.shape[1]), np.float32)
            self.branch = np.concatenate([self.branch, to])
        order = np.argsort(leaf, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(leaf[order]) != 0])
        more = np.add.reduceat(x[order] * weight[order, None].astype(np.float32), starts, axis=0)
        at = leaf[order][starts]
        self.sums[at] += more
        np.add.at(self.branches, self.branch[at], more)
        self.count += np.bincount(leaf, weight, minlength=len(self.count))
        self._split()
        return leaf

    def _split(self) -> None:
        """Branches with too many leaves part in two around their two leaves that are farthest from each other's side."""
        while len(full := np.flatnonzero(np.bincount(self.branch, minlength=len(self.branches)) > BRANCH)):
            for node in full:
                own = np.flatnonzero(self.branch == node)
                mean = unit(self.sums[own], np.float32)
                a = (mean @ mean.sum(0)).argmin()
                b = (mean @ mean[a]).argmin()
                far = mean @ mean[b] > mean @ mean[a]
                for _ in range(2):
                    if far.all() or not far.any():
                        break
                    far = mean @ mean[far].mean(0) > mean @ mean[~far].mean(0)
                if far.all() or not far.any():
                    far = np.arange(len(own)) % 2 == 0
                self.branch[own[far]] = len(self.branches)
                self.branches = np.concatenate([self.branches, self.sums[own[far]].sum(0, keepdims=True)])
                self.branches[node] = self.sums[own[~far]].sum(0)


def leaves(x: np.ndarray, least: float, weight: np.ndarray | None = None, step: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaf of every unit vector of x, and the leaves' counts and linear sums; weight: how many vectors each stands for."""
    weight = np.ones(len(x)) if weight is None else np.asarray(weight, np.float64)
    tree = Tree(x.shape[1], least)
    leaf = [tree.insert(x[lo : lo + step], weight[lo : lo + step]) for lo in range(0, len(x), step)]
    return np.concatenate(leaf) if leaf else np.zeros(0, np.int64), tree.count.astype(np.int64), tree.sums


def ward(count: np.ndarray, sums: np.ndarray, least: float, home: np.ndarray | None = None) -> np.ndarray:
    """Group of each leaf: leaves whose mean cosine is at least `least` merge, mutually nearest by Ward's distance first.

    Mutual nearest neighbours may merge at once without changing the outcome; only leaves that touch others take part.
    home: leaves of which one at least is in each pair that is looked for, all by default.
    """
    group = np.arange(len(count))
    mean = (sums / count[:, None]).astype(np.float32)
    home = np.ones(len(mean), bool) if home is None else home
    at, pairs = np.flatnonzero(home), [np.zeros((0, 2), np.int64)]
    for lo in range(0, len(at), 256):
        row, column = np.divmod(np.flatnonzero(mean[at[lo : lo + 256]] @ mean.T >= least), len(mean))
        row = at[lo + row]
        keep = np.where(home[column], row < column, True)
        pairs.append(np.sort(np.stack([row[keep], column[keep]], 1), axis=1))
    # Leaves that no chain of such pairs connects can't merge, so each connected set is agglomerated by itself.
    root = group.copy()
    ends = np.concatenate(pairs)
    while len(ends):
        low = root.copy()
        np.minimum.at(low, ends[:, 1], low[ends[:, 0]])
        np.minimum.at(low, ends[:, 0], low[ends[:, 1]])
        low = low[low]
        if (low == root).all():
            break
        root = low
    order = np.argsort(root, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(root[order]) != 0]) if len(order) else []
    for live in np.split(order, starts[1:]) if len(order) else []:
        if len(live) > DENSE_LEAVES:
            inside = np.isin(ends[:, 0], live)
            group[live] = live[_sparse(count[live].astype(np.float64), sums[live].astype(np.float64), np.searchsorted(live, ends[inside]), least)]
        elif len(live) > 1:
            for m in _agglomerate(count[live].astype(np.float64), sums[live].astype(np.float64), least):
                group[live[m]] = live[min(m)]
    return group


def _agglomerate(weight: np.ndarray, sums: np.ndarray, least: float) -> list[list[int]]:
    cross = sums @ sums.T
    members = [[i] for i in range(len(weight))]
    if (cross >= least * np.outer(weight, weight)).all():
        return [list(range(len(weight)))]  # any order of merging ends here
    while len(weight) > 1:
        mean = cross / np.outer(weight, weight)
        self_ = np.diag(mean)
        distance = np.outer(weight, weight) / np.add.outer(weight, weight) * (self_[:, None] + self_[None, :] - 2 * mean)
        distance[(mean < least) | np.eye(len(weight), dtype=bool)] = np.inf
        to = distance.argmin(1)
        ok = np.isfinite(distance[np.arange(len(to)), to])
        pair = [(i, to[i]) for i in range(len(to)) if ok[i] and i < to[i] and to[to[i]] == i]
        if not pair:
            i = int(np.argmin(np.where(ok, distance[np.arange(len(to)), to], np.inf)))
            if not ok[i]:
                break
            pair = [(i, to[i])]
        into = np.arange(len(weight))
        for a, b in pair:
            into[max(a, b)] = min(a, b)
            members[min(a, b)] += members[max(a, b)]
        kept = np.flatnonzero(into == np.arange(len(weight)))
        position = np.full(len(weight), -1)
        position[kept] = np.arange(len(kept))
        onto = np.zeros((len(kept), len(weight)))
        onto[position[into], np.arange(len(weight))] = 1
        cross, weight = onto @ cross @ onto.T, onto @ weight
        members = [members[i] for i in kept]
    return members

def _sparse(weight: np.ndarray, sums: np.ndarray, pairs: np.ndarray, least: float) -> np.ndarray:
    """Group of each leaf (the position of its first), merging along given pairs only: memory follows their number."""
    group = np.arange(len(weight))
    weight, sums = weight.copy(), sums.copy()
    pairs = np.unique(np.sort(pairs, axis=1), axis=0)
    while len(pairs):
        a, b = pairs.T
        cross = np.concatenate([np.einsum("ij,ij->i", sums[a[i : i + 65536]], sums[b[i : i + 65536]]) for i in range(0, len(a), 65536)])
        own = np.einsum("ij,ij->i", sums, sums) / weight**2
        mean = cross / (weight[a] * weight[b])
        distance = weight[a] * weight[b] / (weight[a] + weight[b]) * (own[a] + own[b] - 2 * mean)
        ok = mean >= least
        if not ok.any():
            break
        one, other, d = np.r_[a[ok], b[ok]], np.r_[b[ok], a[ok]], np.r_[distance[ok], distance[ok]]
        order = np.lexsort((np.maximum(one, other), np.minimum(one, other), d, one))
        first = order[np.flatnonzero(np.r_[True, np.diff(one[order]) != 0])]
        choice = np.full(len(weight), -1)
        choice[one[first]] = other[first]
        held = np.flatnonzero(choice >= 0)
        merge = held[(choice[choice[held]] == held) & (held < choice[held])]
        to = np.arange(len(weight))
        to[choice[merge]] = merge
        sums[merge] += sums[choice[merge]]
        weight[merge] += weight[choice[merge]]
        group = to[group]
        pairs = np.sort(to[pairs], axis=1)
        pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
    return group


def clusters(vectors: DataFrame, n: int, dim: int, least: float = 0.57, smallest: int = 5) -> DataFrame:
    """(cluster_id, member_id, score): sets of at least `smallest` vectors, each with a mean cosine >= least to the others.

    vectors(id, vec): usable vectors; repeated rows of an id are equal and count once, null ids don't; n: their number. score is that mean; a vector goes to the cluster of
    highest mean and to none where that is below least; cluster_id is the smallest member id. Equal vectors count singly; of a
    vector that very many ids have, one stands for all with their number until the end.
    No vectors, or no such set, give no rows. Further columns are ignored.
    """
    rows, rest = split_repeats(vectors.select("id", "vec").where("id is not null"), n, 1)
    pivots = fit(rows, n, dim, CELL_ROWS, MEET[0][1], MEET[0][2])
    placed = place(rows, pivots, least, 0, keep=["weight"], half=True)

    def grow(group: pa.Table) -> pa.Table:
        group = group.take(pa.array(np.unique(group.column("id").to_numpy(), return_index=True)[1]))
        x = unit(from_halves(group.column("vec"), dim), np.float32)
        leaf, count, sums = leaves(x, least, group.column("weight").to_numpy())
        key = (group.column("cell")[0].as_py() << 44) | (group.column("block")[0].as_py() << 20)
        return _leaf_rows(group, key | leaf, np.unique(leaf, return_index=True)[1], count, sums)

    columns = "cell int, block int, id bigint, leaf bigint, count bigint, vec array<float>"
    grown = cut(tiled(placed, pivots, 2 * dim + 40).applyInArrow(grow, columns), "clusters-leaves")
    summaries = grown.where("count > 0").select("cell", "block", "leaf", "count", "vec")
    moved, levels = [], []
    level, width = 0, int(pivots.blocks.max())

    def merge(group: pa.Table) -> pa.Table:
        """The trees of two neighbouring blocks as one: the leaves of both are inserted into a new tree."""
        count, key = group.column("count").to_numpy(), group.column("leaf").to_numpy()
        x = matrix(group.column("vec"), dim)
        own, total, sums = leaves(unit(x, np.float32), least, count)
        first = np.unique(own, return_index=True)[1]
        return pa.table({"cell": group.column("cell"), "block": group.column("block"), "leaf": key, "into": key[first][own], "count": np.where(np.isin(np.arange(len(own)), first), total[own], 0), "vec": lists(sums[own])})

    while width > 1:
        pairs = summaries.withColumn("block", F.shiftright("block", 1))
        merged = cut(pairs.groupBy("cell", "block").applyInArrow(merge, "cell int, block int, leaf bigint, `into` bigint, count bigint, vec array<float>"), f"clusters-level-{level}")
        levels.append(merged)
        moved.append(merged.where("leaf <> into").select(F.col("leaf").alias("a"), F.col("into").alias("b")))
        summaries = merged.where("count > 0").select("cell", "block", "leaf", "count", "vec")
        level, width = level + 1, -(-width // 2)

    def features(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, count = group.column("id").to_numpy(), group.column("count").to_numpy()
        return key, count, from_halves(group.column("vec"), dim) * (group.column("length").to_numpy() * count)[:, None].astype(np.float32)

    def gather(group: pa.Table) -> pa.Table:
        """The leaves of a cell agglomerated; the first of each group carries their sum, others a count of 0."""
        key, count, sums = features(group)
        into = ward(count, sums, least)
        first, at = np.unique(into, return_inverse=True)
        total, summed = np.bincount(at, count), np.zeros((len(first), dim), np.float32)
        np.add.at(summed, at, sums)
        held, length = np.zeros(len(key), np.int64), np.zeros(len(key))
        held[first], length[first] = total, np.sqrt(np.einsum("ij,ij->i", summed, summed, dtype=np.float64)) / total
        return pa.table({"id": key, "into": key[into], "count": held, "length": length, "vec": _some_lists(held > 0, summed)})

    def meet(group: pa.Table) -> pa.Table:
        key, count, sums = features(group)
        into = ward(count, sums, least, group.column("home").to_numpy())
        away = np.flatnonzero(into != np.arange(len(into)))
        return pa.table({"a": key[away], "b": key[into[away]]})

    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))) / F.col("count")
    sized = summaries.select(F.col("leaf").alias("id"), "count", "vec", length.alias("length"))
    keep, row = ["count", "length"], 2 * dim + 60
    few, left = sized, sized.count()
    # A cluster has leaves in many cells; where they are at home together they become one before any looks further.
    for nth in range(ROUNDS):
        if left <= MEET_ROWS:
            break
        cells = fit(few, left, dim, MEET_ROWS)
        gathered = cut(tiled(place(few, cells, least, 0, keep, half=True), cells, row).applyInArrow(gather, "id bigint, `into` bigint, count bigint, length double, vec array<float>"), f"clusters-round-{nth}")
        levels.append(gathered)
        moved.append(gathered.where("id <> into").select(F.col("id").alias("a"), F.col("into").alias("b")))
        few = gathered.where("count > 0").select("id", "count", "vec", "length")
        left = few.count()
    # Leaves of several vectors look far for their like; single vectors, mostly strays, are found by those or by the last pass.
    cells = fit(few, left, dim, MEET_ROWS)
    kinds = [(few.where("count > 1" if several else "count = 1"), near, spread) for several, near, spread in MEET]
    cells = Pivots(cells.centre, cells.gap, cells.held, sum(_met(leaves_, cells, near, spread) for leaves_, near, spread in kinds))
    many, single = (place(leaves_, cells, near, spread, keep, half=True) for leaves_, near, spread in kinds)
    links = tiled(many.unionByName(single), cells, row).applyInArrow(meet, "a bigint, b bigint")
    for more in moved:
        links = links.unionByName(more)
    joined = cut(components(links).select(F.col("node").alias("leaf"), F.col("component").alias("cluster")), "clusters-joined")
    named = cut(grown.select("cell", "block", "id", "leaf").join(joined, "leaf", "left").select("cell", "block", "id", F.coalesce("cluster", "leaf").alias("cluster")), "clusters-named")

    # A cluster's leaves are added up part by part, so that one of any number of leaves falls to several tasks first.
    def add(group: pa.Table) -> pa.Table:
        return pa.table({"cluster": group.column("cluster")[:1], "part": group.column("part")[:1], "count": pa.array([int(group.column("count").to_numpy().sum())]), "vec": lists(matrix(group.column("vec"), dim).sum(0, dtype=np.float64)[None, :])})

    totals = sized.withColumnRenamed("id", "leaf").join(joined, "leaf", "left").select(F.coalesce("cluster", "leaf").alias("cluster"), F.col("cluster").isNotNull().alias("several"), F.pmod(F.xxhash64("leaf"), F.lit(256)).cast("int").alias("part"), "count", "vec")
    sums = totals.where("several").groupBy("cluster", "part").applyInArrow(add, "cluster bigint, part int, count bigint, vec array<float>")
    sums = sums.withColumn("part", F.lit(0)).groupBy("cluster", "part").applyInArrow(add, "cluster bigint, part int, count bigint, vec array<float>")
    centres = sums.select(F.col("cluster").alias("id"), "count", "vec").unionByName(totals.where("not several and count >= 2").select(F.col("cluster").alias("id"), "count", "vec"))
    centres = cut(centres, "clusters-centres")
    discard(grown, joined, *levels)

    def assign(group: pa.Table) -> pa.Table:
        what, key, count = (group.column(c).to_numpy() for c in ("what", "id", "count"))
        vec = group.column("vec")
        at_c, at_v, at_m = (np.flatnonzero(what == w) for w in (0, 1, 2))
        at_v = at_v[np.unique(key[at_v], return_index=True)[1]]
        if not len(at_c) or not len(at_v):
            return pa.table({"cluster": pa.array([], pa.int64()), "member_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        order = at_c[np.unique(key[at_c], return_index=True)[1]]
        centre, size, name = matrix(vec.take(pa.array(order)), dim).astype(np.float64), count[order].astype(np.float64), key[order]
        ids = key[at_v]
        x = matrix(vec.take(pa.array(at_v)), dim)
        by = np.argsort(key[at_m], kind="stable")
        own = count[at_m][by][np.minimum(np.searchsorted(key[at_m][by], ids), max(len(by) - 1, 0))] if len(by) else np.full(len(ids), -1)
        position = np.minimum(np.searchsorted(name, own), len(name) - 1)
        inside = name[position] == own
        best, score = np.zeros(len(ids), np.int64), np.full(len(ids), -1.0)
        mean = np.ascontiguousarray((centre / size[:, None]).T, np.float32)
        for lo in range(0, len(ids), 512):
            part = unit(x[lo : lo + 512])
            # In single precision for those that may reach `least`; without a vector's own part its mean is lower still.
            row, column = np.divmod(np.flatnonzero(part.astype(np.float32) @ mean >= least - 1e-4), len(name))
            sums = np.concatenate([np.einsum("ij,ij->i", part[row[i : i + 65536]], centre[column[i : i + 65536]]) for i in range(0, len(row), 65536)] or [np.zeros(0)])
            own_too = inside[lo + row] & (column == position[lo + row])
            exact = np.where(own_too, (sums - 1) / np.maximum(size[column] - 1, 1), sums / size[column])
            order = np.lexsort((column, -exact, row))
            order = order[np.flatnonzero(np.r_[True, np.diff(row[order]) != 0])] if len(order) else order
            best[lo + row[order]], score[lo + row[order]] = column[order], exact[order]
        ok = score >= least
        return pa.table({"cluster": name[best[ok]], "member_id": ids[ok], "score": score[ok]})

    sides = place(rows, pivots, least, 0).select("cell", "block", F.lit(1).alias("what"), "id", F.lit(0).cast("long").alias("count"), "vec")
    sides = sides.unionByName(named.select("cell", "block", F.lit(2).alias("what"), "id", F.col("cluster").alias("count"), F.lit(None).cast("array<float>").alias("vec")))
    # A member of mean cosine 0.57 has a cosine of about 0.65 to the centre of a usual cluster; besides, a centre is held
    # against every block in which a vector of its cluster lies.
    here = named.select("cell", "block", F.col("cluster").alias("id")).distinct().join(centres, "id").select("cell", "block", "id", "count", "vec")
    near = visit(centres, pivots, *MEET[0][1:], keep=["count"]).select("cell", "block", "id", "count", "vec").unionByName(here)
    sides = sides.unionByName(near.select("cell", "block", F.lit(0).alias("what"), "id", "count", "vec"))
    if len(pivots.centre) > 2:
        sides = sides.repartition(3 * int(pivots.blocks.sum()), "cell", "block")
    found = sides.groupBy("cell", "block").applyInArrow(assign, "cluster bigint, member_id bigint, score double")
    if rest is not None:
        found = cut(found, "clusters-first")
        # Equal vectors are in one cluster, with one score.
        reps = F.broadcast(rest.select(F.col("rep").alias("member_id")).distinct())
        same = rest.join(F.broadcast(found.join(reps, "member_id", "left_semi").withColumnRenamed("member_id", "rep")), "rep")
        found = found.unionByName(same.select("cluster", F.col("id").alias("member_id"), "score"))
    found = cut(found, "clusters-found")
    heads = found.groupBy("cluster").agg(F.min("member_id").alias("cluster_id"), F.count("*").alias("size")).where(F.col("size") >= smallest)
    return found.join(heads, "cluster").select("cluster_id", "member_id", "score")


def _leaf_rows(group: pa.Table, key: np.ndarray, first: np.ndarray, count: np.ndarray, sums: np.ndarray) -> pa.Table:
    """The rows of a group with their leaf; the first row of each leaf also carries its feature, others a count of 0."""
    at = np.full(len(key), -1)
    at[first] = np.arange(len(first))
    has = at >= 0
    return pa.table({"cell": group.column("cell"), "block": group.column("block"), "id": group.column("id"), "leaf": pa.array(key), "count": pa.array(np.where(has, count[np.maximum(at, 0)], 0)), "vec": _some_lists(has, sums[at[has]])})


def _some_lists(has: np.ndarray, x: np.ndarray) -> pa.Array:
    """Lists of the rows of x, in order, where `has` is true; elsewhere null."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(has, x.shape[1], 0))].astype(np.int32)), pa.array(x.ravel()), mask=pa.array(~has))


def _met(rows: DataFrame, pivots: Pivots, least: float, spread: float) -> np.ndarray:
    """By cell, how many of rows(id, vec) are to be expected as visitors, from those of MET_SAMPLE rows of smallest hash."""
    n = rows.count()
    part = min(1.0, MET_SAMPLE / max(n, 1))
    sample = rows if part == 1.0 else rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(np.ceil(part * (1 << 20))))
    found = sample.select("vec").toArrow()
    if not found.num_rows:
        return np.zeros(len(pivots.centre))
    home, _, cell = visits(unit(matrix(found.column(0), pivots.dim), np.float32), pivots, least, spread)
    count = np.bincount(cell, minlength=len(pivots.centre)) - np.bincount(home, minlength=len(pivots.centre))
    return count * (n / found.num_rows)


def describe(members: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster_id, size, typical): each cluster's size and its members of highest score, ties to the smaller id."""
    # The window keeps `typical` rows of a cluster in each task before anything is shuffled.
    rank = Window.partitionBy("cluster_id").orderBy(F.desc("score"), "member_id")
    top = members.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= typical)
    top = top.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "member_id"))), lambda t: t["member_id"]).alias("typical"))
    return members.groupBy("cluster_id").agg(F.count("*").alias("size")).join(top, "cluster_id").select("cluster_id", "size", "typical")
