"""Self-join of 64-bit codes within a Hamming budget, by a binary trie.

Node pairs of the trie are traversed together from the root; each pair carries the bits by which its two prefixes
differ and is dropped when they exceed the budget. To spread the work, the codes' bits are cut into ``budget + exact``
bands: two codes within the budget agree on at least ``exact`` of them, so they meet below one of the subtries that
fix ``exact`` bands. A pair is reported only below the first such subtrie, hence once, and none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Node pairs with at most so many code pairs below them are compared code by code.
LEAF_PAIRS = 64
#: Code pairs compared, or node pairs expanded, in one step.
STEP = 1 << 20
#: Codes that a task should get.
TASK_CODES = 1 << 20


def bands(budget: int, exact: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each band."""
    n = budget + exact
    cuts = [round(64 * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _pairs(alo, ahi, blo, bhi, same):
    """Index pairs below node pairs; below a node paired with itself, each unordered pair once."""
    na, nb = ahi - alo, bhi - blo
    total = na * nb
    which = np.repeat(np.arange(len(total)), total)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(total) - total, total)
    i, j = alo[which] + nth // nb[which], blo[which] + nth % nb[which]
    keep = ~same[which] | (i < j)
    return i[keep], j[keep]


def self_join(code: np.ndarray, roots: list[tuple[int, int]] | np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j within the budget, of codes (uint64) that are sorted within each of the ranges in roots."""
    roots = np.asarray(roots, dtype=np.int64).reshape(-1, 2)
    zeros: dict[int, np.ndarray] = {}

    def upto(depth: int) -> np.ndarray:
        if depth not in zeros:
            zeros[depth] = np.r_[0, np.cumsum((code >> np.uint64(63 - depth)) & np.uint64(1) == 0)]
        return zeros[depth]

    stack = [(0, roots[:, 0], roots[:, 1], roots[:, 0], roots[:, 1], np.zeros(len(roots), np.int64))]
    while stack:
        depth, alo, ahi, blo, bhi, acc = stack.pop()
        if len(alo) > STEP // 8:
            half = len(alo) // 2
            stack += [(depth, *(v[:half] for v in (alo, ahi, blo, bhi, acc))), (depth, *(v[half:] for v in (alo, ahi, blo, bhi, acc)))]
            continue
        leaf = ((ahi - alo) * (bhi - blo) <= LEAF_PAIRS) | (depth == 64)
        if leaf.any():
            a, b, c, d = alo[leaf], ahi[leaf], blo[leaf], bhi[leaf]
            ends = np.cumsum((b - a) * (d - c))
            at = 0
            while at < len(a):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, side="right")))
                i, j = _pairs(a[at:to], b[at:to], c[at:to], d[at:to], a[at:to] == c[at:to])
                near = np.bitwise_count(code[i] ^ code[j]) <= budget
                if near.any():
                    yield i[near], j[near]
                at = to
        alo, ahi, blo, bhi, acc = (v[~leaf] for v in (alo, ahi, blo, bhi, acc))
        if not len(alo):
            continue
        z = upto(depth)
        amid, bmid = alo + z[ahi] - z[alo], blo + z[bhi] - z[blo]
        twins = alo == blo
        parts = [(alo, amid, blo, bmid, acc), (amid, ahi, bmid, bhi, acc), (alo, amid, bmid, bhi, acc + 1)]
        parts.append(tuple(v[~twins] for v in (amid, ahi, blo, bmid, acc + 1)))
        alo, ahi, blo, bhi, acc = (np.concatenate(v) for v in zip(*parts, strict=True))
        alive = (ahi > alo) & (bhi > blo) & (acc <= budget) & ~((alo == blo) & (ahi - alo == 1))
        stack.append((depth + 1, *(v[alive] for v in (alo, ahi, blo, bhi, acc))))


def near_codes(codes: DataFrame, budget: int, n: int, tasks: int | None = None) -> DataFrame:
    """(code_a, code_b, bits) with code_a < code_b of the distinct, non-null codes(code) that differ in at most budget bits.

    n: number of codes, from which the number of bands to fix is chosen, so that a subtrie keeps to some hundred codes, and
    the number of tasks unless it is given.
    An empty table gives an empty result; other columns are ignored.
    """
    exact = 1
    while exact < 4 and n / 2 ** (64 * exact / (budget + exact)) > 1024:
        exact += 1
    parts = bands(budget, exact)
    chosen = list(combinations(range(len(parts)), exact))
    keys = []
    for c, picked in enumerate(chosen):
        key = F.lit(0).cast("long")
        for b in picked:
            low, width = parts[b]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("code", low).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(F.struct(F.lit(c).alias("c"), key.alias("key")))
    mask = np.array([((1 << w) - 1) << low for low, w in parts], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        c, key, code = (np.concatenate([b.column(k).to_numpy() for b in rows]) for k in ("c", "key", "code"))
        code = code.view(np.uint64)
        order = np.lexsort((code, key, c))
        c, key, code = c[order], key[order], code[order]
        edge = np.flatnonzero(np.r_[True, (np.diff(c) != 0) | (np.diff(key) != 0), True])
        roots = np.stack([edge[:-1], edge[1:]], 1)
        for i, j in self_join(code, roots[roots[:, 1] - roots[:, 0] > 1], budget):
            differs = code[i] ^ code[j]
            # The first `exact` bands on which the pair agrees must be those of this subtrie.
            agree = np.stack([(differs & m) == 0 for m in mask], 1)
            first = agree & (np.cumsum(agree, 1) <= exact)
            mine = np.zeros((len(chosen), len(parts)), bool)
            for at, picked in enumerate(chosen):
                mine[at, list(picked)] = True
            keep = (first == mine[c[i]]).all(1)
            a, b = code[i[keep]].view(np.int64), code[j[keep]].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.bitwise_count(differs[keep]).astype(np.int32))], names=["code_a", "code_b", "bits"])

    rows = codes.select("code").select("code", F.explode(F.array(*keys)).alias("k")).select("code", F.col("k.c").alias("c"), F.col("k.key").alias("key"))
    # A task holds its subtries' codes in memory, so there are more tasks where there are more codes.
    tasks = tasks or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * len(chosen) // TASK_CODES))
    return rows.repartition(min(200_000, tasks), "c", "key").mapInArrow(run, "code_a bigint, code_b bigint, bits int")
