"""Connected components of a graph given as edges, by alternating large-star and small-star contractions.

Each round halves the depth of the trees that hang below a component's smallest node, so the number of rounds is
logarithmic; a node of any degree is handled by aggregation and join, never by collecting its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.tables import cut, discard


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one batch: the same connections as a star for each local component."""
    for batch in batches:
        root: dict[int, int] = {}

        def find(x: int, root: dict[int, int] = root) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up] if up in root else up
                x = root[x]
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        stars = [(x, find(x)) for x in list(root)]
        stars = [(x, r) for x, r in stars if x != r]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in stars], pa.int64()), pa.array([r for _, r in stars], pa.int64())], names=["a", "b"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reached.

    Edges with a null end are dropped, loops add nothing, and repeated or reversed edges count once. Nodes that occur
    only in loops are left out; an empty table gives an empty result. Further columns are ignored.
    Raises an error if the labels haven't settled after max_rounds.
    """
    ends = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    # Directed from the larger node to the smaller.
    now = cut(ends.mapInArrow(_contract, "a bigint, b bigint").distinct(), "components")
    before = _state(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        old, now = now, cut(small.where("a <> b").distinct(), "components")
        discard(old)
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
