"""Most similar vectors for every vector: inverted lists scanned with adaptive dimensions.

Vectors are grouped into cells (see cells.py); a tile's home rows are its list, home rows and visitors are its queries.
In a list, rotated vectors are compared in column blocks: after a block, the squared distance so far, scaled to all
dimensions, is held against the largest distance that still matters to the query, with the slack that a random rotation
allows (a hypothesis test); the candidates that fail are abandoned. What matters is the threshold or, where the query has
as many neighbours already, its k-th best so far. Survivors get exact cosines in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.operators.cells import fit, matrix, place, split_repeats, tiled, unit
from prismlake.tables import cut

#: Rows of a list: sending a vector to one more list costs about as much as comparing it with so many.
LIST_ROWS = 16_384
#: Slack of the test in standard deviations, columns of a block, queries scanned together.
SLACK, COLUMNS, QUERIES = 2.1, 32, 256


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(3).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def scan(q: np.ndarray, data: np.ndarray, least: float | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, cosine) in single precision of the pairs of unit vectors q x data with cosine >= least, nearly all.

    least: one for all queries, or one for each.
    """
    dim = q.shape[1]
    least = np.broadcast_to(np.asarray(least, np.float32), len(q))
    far = 2 - 2 * least
    done = min(COLUMNS, dim)
    rest_q, rest_d = np.einsum("ij,ij->i", q[:, :done], q[:, :done]), np.einsum("ij,ij->i", data[:, :done], data[:, :done])
    bound = lambda d: d / dim * (1 + SLACK / np.sqrt(d)) ** 2 * far if d < dim else far + 1e-5
    # |a-b|^2 <= bound over the first columns, as a bound on a dot product that has -|b|^2/2 in one more column.
    dots = np.c_[q[:, :done], np.ones(len(q), np.float32)] @ np.c_[data[:, :done], -rest_d / 2].T
    hit = np.flatnonzero(dots >= ((rest_q - bound(done).astype(np.float32)) / 2)[:, None])
    if len(hit) * 8 > dots.size:
        dots += (rest_d / 2)[None, :]
        dots += q[:, done:] @ data[:, done:].T
        row, column = np.divmod(np.flatnonzero(dots >= least[:, None] - 1e-5), len(data))
        return row, column, dots[row, column]
    row, column = np.divmod(hit, len(data))
    distance = rest_q[row] - 2 * dots[row, column]
    while done < dim and len(row):
        upto = min(dim, done + COLUMNS)
        step = np.concatenate([np.square(q[row[i : i + 65536], done:upto] - data[column[i : i + 65536], done:upto]).sum(1) for i in range(0, len(row), 65536)])
        distance, done = distance + step, upto
        alive = distance <= bound(done)[row]
        row, column, distance = row[alive], column[alive], distance[alive]
    return row, column, 1 - distance / 2


def strongest(key: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of those within 1e-5 of their key's k-th best score."""
    order = np.lexsort((-score, key))
    starts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(order) else np.zeros(0, int)
    length = np.diff(np.r_[starts, len(order)])
    last = score[order[starts + np.minimum(length, k) - 1]] if len(order) else np.zeros(0)
    return order[score[order] >= np.repeat(last, length) - 1e-5]


def best(key: np.ndarray, cosine: np.ndarray, item: np.ndarray, k: int) -> np.ndarray:
    """Positions of each key's k best by cosine, then smaller item."""
    order = np.lexsort((item, -cosine, key))
    starts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < k]


def cosines(a: np.ndarray, b: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    return np.round(np.concatenate([np.einsum("ij,ij->i", a[row[i : i + 32768]], b[column[i : i + 32768]]) for i in range(0, len(row), 32768)] or [np.zeros(0)]), 12)


def kth(q: np.ndarray, data: np.ndarray, least: float, k: int) -> np.ndarray:
    """For each query a cosine that its k-th best among the data reaches: that among a part of them, or the threshold.

    With it whole lists are abandoned early that a fixed threshold would have scanned to the end.
    """
    some = data[: max(4 * k, len(data) // 16)]
    if len(some) <= k:
        return np.full(len(q), least, np.float32)
    score = q @ some.T
    return np.maximum(least, np.partition(score, len(some) - k, axis=1)[:, len(some) - k] - 1e-4).astype(np.float32)


def search_cell(ids: np.ndarray, x: np.ndarray, home: np.ndarray, k: int, least: float, turn: np.ndarray, own_too: bool = True, back_too: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, neighbour, cosine): the k best partners within the tile's list, for its rows (own_too) and its visitors.

    What visitors find holds both ways. With back_too the list's rows are queries of the visitors' list too, so that
    these bounds, which are each side's own, lose neither side's.
    """
    exact = unit(x)
    turned = exact.astype(np.float32) @ turn
    at, guests = np.flatnonzero(home), np.flatnonzero(~home)
    if not len(at):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    at = at[np.argsort(ids[at], kind="stable")]
    # Equal vectors are searched once; the k + 1 smallest ids of each stand for the rest.
    _, first, copy_of = np.unique(np.ascontiguousarray(x[at]).view(np.dtype((np.void, x.shape[1] * 4))).ravel(), return_index=True, return_inverse=True)
    copy_of = copy_of.ravel()
    by = np.argsort(copy_of, kind="stable")
    start = np.searchsorted(copy_of[by], np.arange(len(first) + 1))
    one = at[first]
    found = []

    def expand(row: np.ndarray, column: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        times = np.minimum(start[column + 1] - start[column], k + 1)
        again = np.repeat(np.arange(len(row)), times)
        nth = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
        return row[again], ids[at[by[start[column[again]] + nth]]], cosine[again]

    for lo in range(0, len(one) if own_too else 0, QUERIES):
        own = one[lo : lo + QUERIES]
        # A query is in its own list, hence k + 1.
        row, column, score = scan(turned[own], turned[one], kth(turned[own], turned[one], least, k + 1))
        keep = strongest(row, score, k + 1)
        row, column = row[keep], column[keep]
        cosine = cosines(exact, exact, own[row], one[column])
        row, item, cosine = expand(row, column, cosine)
        keep = best(row, cosine, item, k + 1)
        row, item, cosine = row[keep] + lo, item[keep], cosine[keep]
        times = start[row + 1] - start[row]
        again = np.repeat(np.arange(len(row)), times)
        nth = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
        found.append((ids[at[by[start[row[again]] + nth]]], item[again], cosine[again]))
    few = np.diff(start) <= k
    for lo in range(0, len(guests), QUERIES):
        own = guests[lo : lo + QUERIES]
        row, column, score = scan(turned[own], turned[one], least if back_too else kth(turned[own], turned[one], least, k))
        keep = strongest(row, score, k)
        r, item, cosine = expand(row[keep], column[keep], cosines(exact, exact, own[row[keep]], one[column[keep]]))
        found.append((ids[own[r]], item, cosine))
        back = np.flatnonzero(few[column])
        keep = back[strongest(column[back], score[back], k)]
        cosine = cosines(exact, exact, own[row[keep]], one[column[keep]])
        times = start[column[keep] + 1] - start[column[keep]]
        again = np.repeat(np.arange(len(keep)), times)
        nth = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
        found.append((ids[at[by[start[column[keep][again]] + nth]]], ids[own[row[keep][again]]], cosine[again]))
    item, other, cosine = (np.concatenate(c) for c in zip(*found, strict=True))
    keep = np.flatnonzero((item != other) & (cosine >= least))
    keep = keep[best(item[keep], cosine[keep], other[keep], k)]
    return item[keep], other[keep], cosine[keep]


def nearest(vectors: DataFrame, n: int, dim: int, k: int, least: float, spread: float = 0.9) -> DataFrame:
    """(item_id, neighbour_id, cosine): for every vector its k most similar others with cosine (12 places) >= least.

    vectors(id, vec): usable vectors; repeated rows of an id are equal and count once, null ids don't; n: their number.
    Ties go to the smaller id; equal vectors are each other's neighbours at cosine 1. Of a vector that very many rows have the k + 1
    smallest ids are searched, and the others take over what the smallest found. No vectors, or one, give no rows.
    Approximate: a pair is missed if neither vector's visits reach the other's home, or if the scan abandons it; measured
    recall is in the README. Other columns are ignored.
    """
    rows, rest = split_repeats(vectors.select("id", "vec").where("id is not null"), n, k + 1)
    pivots = fit(rows, n, dim, LIST_ROWS, least, spread)
    turn = rotation(dim)

    def run(group: pa.Table) -> pa.Table:
        kind = pivots.kind(group)
        group = group.take(pa.array(np.unique(group.column("id").to_numpy(), return_index=True)[1]))
        x = matrix(group.column("vec"), dim)
        item, other, cosine = search_cell(group.column("id").to_numpy(), x, group.column("home").to_numpy(), k, least, turn, kind == "own", True)
        return pa.table({"item_id": item, "neighbour_id": other, "cosine": cosine})

    found = tiled(place(rows, pivots, least, spread), pivots, 4 * dim + 32).applyInArrow(run, "item_id bigint, neighbour_id bigint, cosine double")
    if rest is not None:
        # Everyone else with the vector sees what its smallest id sees, and that one.
        found = cut(found, "nearest")
        seen = found.select(F.col("item_id").alias("rep"), "neighbour_id", "cosine").unionByName(rest.select("rep", F.col("rep").alias("neighbour_id"), F.lit(1.0).alias("cosine")).distinct())
        found = found.unionByName(rest.join(F.broadcast(seen.join(rest.select("rep").distinct(), "rep", "left_semi")), "rep").select(F.col("id").alias("item_id"), "neighbour_id", "cosine").where("item_id <> neighbour_id"))
    top = found.groupBy("item_id").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("cosine")).alias("c"), "neighbour_id"))), 1, k).alias("top"))
    return top.select("item_id", F.explode("top").alias("t")).select("item_id", F.col("t.neighbour_id").alias("neighbour_id"), (-F.col("t.c")).alias("cosine"))
