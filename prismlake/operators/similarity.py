"""Vector search: top-k of a query, similarity joins, topics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismlake.conf import CONF
from prismlake.functions.vectors import cosine, literal
from prismlake.operators.cells import Pivots, fit, gather, matrix, place, tiled, unit

CELL_ROWS = 4_096


def _best(vectors: DataFrame, query: list[float], k: int, least: float) -> DataFrame:
    """The k of highest cosine to a query, least at least: every batch is scored at once, every task passes on k rows."""
    q = np.asarray(query, np.float64)
    q = q / max(np.linalg.norm(q), 1e-300)
    dim = len(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("vec"), dim).astype(np.float64)
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            with np.errstate(divide="ignore", invalid="ignore"):
                score = x @ q / norm
            ok = score >= least
            ids, scores = np.r_[ids, batch.column("id").to_numpy()[ok]], np.r_[scores, score[ok]]
            if len(ids) > 4 * k + 4096:
                keep = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[keep], scores[keep]
        keep = np.lexsort((ids, -scores))[:k]
        yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(scores[keep])], names=["id", "score"])

    rows = vectors.where((F.size("vec") == dim) & F.col("id").isNotNull()).select(F.col("id").cast("long"), F.col("vec").cast("array<float>"))
    return rows.mapInArrow(run, "id bigint, score double").orderBy(F.desc("score"), "id").limit(k)


def topk(vectors: DataFrame, query: list[float], k: int, least: float = -1.0, include: DataFrame | None = None, exclude: list[int] | None = None) -> DataFrame:
    """(id, score): the k vectors of highest cosine to the query, at least `least`; ties go to the smaller id.

    vectors(id, vec); only those as long as the query count, and zero vectors don't; an empty query finds nothing.
    include(id) restricts the scan before scoring, exclude leaves ids out. Each task keeps k rows.
    """
    rows = vectors if query else vectors.limit(0)
    if include is not None:
        rows = rows.join(include.select("id"), "id", "left_semi")
    if exclude:
        rows = rows.where(~F.col("id").isin(exclude))
    return _best(rows, query or [1.0], k, least)


def vector_of(vectors: DataFrame, item: int) -> list[float] | None:
    """An item's vector; None if it has none. The only row that is read is pushed down to the scan."""
    row = vectors.where(F.col("id") == item).select("vec").first()
    return [float(x) for x in row["vec"]] if row and row["vec"] is not None else None


def similar(vectors: DataFrame, item: int, k: int = CONF.similar_limit, least: float = CONF.similar_min_score) -> DataFrame:
    """The k vectors most like an item's own, without it; nothing if the item has none."""
    own = vector_of(vectors, item)
    return topk(vectors, own or [], k, least, exclude=[item])


def visible_after(hits: DataFrame, visible: DataFrame) -> DataFrame:
    """Hits that are visible. The limit comes first, so fewer than k may remain."""
    return hits.join(visible.select("id"), "id", "left_semi")


def whole(dim: int) -> float:
    """The spread at which no partner can be missed: its other part may lie wholly in the direction of the next cell; 1 % for rounding."""
    return 1.01 * float(np.sqrt(dim))


def sides(group: pa.Table, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, bool]:
    """Positions of the home rows of a tile and of the rows to hold against them, and whether these include the home rows."""
    home = group.column("home").to_numpy()
    own = pivots.kind(group) == "own"
    return np.flatnonzero(home), np.arange(len(home)) if own else np.flatnonzero(~home), own


def told(group: pa.Table, pivots: Pivots) -> np.ndarray:
    """Which rows of a tile of Groups are held against its home rows here alone, so that both sides must be told."""
    return np.ones(group.num_rows, bool) if pivots.kind(group) == "inner" else group.column("back").to_numpy()


def pairs_within(vectors: DataFrame, n: int, dim: int, least: float, spread: float | None = None) -> DataFrame:
    """(a, b, score), a < b: pairs of vectors(id, vec) with cosine (12 places) >= least; vectors usable, one row an id.

    Exact: a vector visits every cell in which a partner can be, whatever its direction. With a `spread` it visits only
    those where one could be with so many standard deviations of slack. least must be above 0. The result is as large as
    the number of pairs; see links() and dbscan.density() for what needs none of them written down.
    """
    exact = spread is None
    spread = whole(dim) if exact else spread
    pivots = fit(vectors, n, dim, CELL_ROWS, least, spread)

    def run(group: pa.Table) -> pa.Table:
        x, ids = unit(matrix(group.column("vec"), dim)), group.column("id").to_numpy()
        home = group.column("home").to_numpy()
        at, ask, own = sides(group, pivots)
        outer = pivots.kind(group) == "outer"
        small = x.astype(np.float32)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for lo in range(0, len(ask), 512):
            row, column = np.nonzero(small[ask[lo : lo + 512]] @ small[at].T >= least - 1e-5)
            a, b = ask[lo + row], at[column]
            keep = np.where(home[a], ids[a] < ids[b], True)
            if exact and (own or outer):  # both ends visit each other: the pair is told where the smaller is at home
                keep &= home[a] | (ids[b] < ids[a])
            a, b = a[keep], b[keep]
            score = np.round(np.einsum("ij,ij->i", x[a], x[b]), 12)
            ok = score >= least
            found.append((np.minimum(ids[a], ids[b])[ok], np.maximum(ids[a], ids[b])[ok], score[ok]))
        a, b, s = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"a": a, "b": b, "score": s})

    found = tiled(place(vectors, pivots, least, spread), pivots, 4 * dim + 32).applyInArrow(run, "a bigint, b bigint, score double")
    return found if exact else found.dropDuplicates(["a", "b"])


def links(vectors: DataFrame, n: int, dim: int, least: float) -> DataFrame:
    """(id, component, links): vectors(id, vec) with a partner of cosine >= least, their number of partners and connected set.

    Exact, and no pair is ever written down: tiles count their rows' partners and pass on a tree of what they connect.
    """
    from prismlake.operators.dbscan import density

    found = density(vectors, n, dim, least, 1)
    return found.where("links > 0").select("id", F.col("cluster").alias("component"), "links")


def neighbours(vectors: DataFrame, n: int, dim: int, k: int, least: float, spread: float = 2.0, seed: int = 41) -> DataFrame:
    """(id, other, score): up to k nearest others with cosine >= least, by random projection to 64 dimensions and exact re-rank.

    The projection finds 2k candidates in each tile, down to 0.12 below the threshold. Vectors of up to 256 dimensions
    aren't projected, as they are compared as fast without.
    """
    pivots = gather(vectors, n, dim, CELL_ROWS, least, spread)
    signs = np.where(np.random.default_rng(seed).random((dim, 64)) < 0.5, -1.0, 1.0).astype(np.float32) / 8.0

    def run(group: pa.Table) -> pa.Table:
        x, ids = unit(matrix(group.column("vec"), dim)), group.column("id").to_numpy()
        at, ask, own = sides(group, pivots)
        low = x.astype(np.float32) @ signs if dim > 256 else x.astype(np.float32)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

        def look(ask: np.ndarray, at: np.ndarray) -> None:
            for lo in range(0, len(ask) if len(at) else 0, 512):
                own = ask[lo : lo + 512]
                score = low[own] @ low[at].T
                hit = score >= least - (0.12 if dim > 256 else 1e-5)
                row, column = np.divmod(np.flatnonzero(hit), len(at))
                held = np.bincount(row, minlength=len(own))
                many = np.flatnonzero(held > 2 * k + 1)  # only rows with more candidates than that are sorted out
                if len(many):
                    few = held[row] <= 2 * k + 1
                    rest = score[many]
                    rest[ids[own[many]][:, None] == ids[at][None, :]] = -9
                    best = np.argpartition(-rest, 2 * k - 1, axis=1)[:, : 2 * k]
                    row, column = np.r_[row[few], np.repeat(many, 2 * k)], np.r_[column[few], best.ravel()]
                keep = ids[own[row]] != ids[at[column]]
                a, b = own[row[keep]], at[column[keep]]
                exact = np.round(np.einsum("ij,ij->i", x[a], x[b]), 12)
                order = np.lexsort((ids[b], -exact, a))
                order = order[exact[order] >= least]
                a, b, exact = a[order], b[order], exact[order]
                first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
                ok = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)])) < k
                found.append((ids[a][ok], ids[b][ok], exact[ok]))

        look(ask, at)
        back = told(group, pivots)
        if back.any():  # two blocks of one cell look at each other, and a cell's rows at visitors from afar
            look(at, ask[back[ask]])
        a, b, s = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"id": a, "other": b, "score": s})

    found = tiled(place(vectors, pivots, least, spread), pivots, 4 * dim + 32).applyInArrow(run, "id bigint, other bigint, score double")
    rank = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    return found.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k).drop("r")


def nearest_topic(vectors: DataFrame, topics: list[tuple[str, list[float]]], least: float = -1.0) -> DataFrame:
    """(id, topic, score): the topic of highest cosine, if it reaches `least`; topics are a short list of literals."""
    scored = F.array(*[F.struct(cosine(F.col("vec"), literal(v)).alias("score"), F.lit(name).alias("topic")) for name, v in topics])
    rows = vectors.select("id", F.array_max(scored).alias("best"))
    return rows.select("id", F.when(F.col("best.score") >= least, F.col("best.topic")).alias("topic"), F.col("best.score").alias("score"))
