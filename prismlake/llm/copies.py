"""Near-duplicate media, from perceptual hashes and vectors that may be missing on either side.

Hashes with enough detail go through the binary trie join over all distinct values; its pairs are exact. The rows of a
value shared by very many are compared in tiles of bounded size with those of every near value, which is exact too. Rows
that have no such hash (missing, or hardly any bits) are looked up by vector: they visit the vector cells in which a
partner could live, and are compared there with every row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismlake.llm.trie import near_codes
from prismlake.operators.cells import fit, matrix, place, split_repeats, tiled, unit, usable
from prismlake.operators.components import components
from prismlake.tables import cut

#: A hash of more usable rows than this (or than 1/4096 of all) is compared in tiles of about TILE_ROWS rows a side.
HOT = 256
TILE_ROWS = 2_048
CELL_ROWS = 2_048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _by_vector(rows: DataFrame, n: int, dim: int, bits: int, with_hash: float, without_hash: float, spread: float) -> DataFrame:
    """Pairs of which one side is flagged `asks`; rows(id, vec, hash, asks)."""
    least = min(with_hash, without_hash)
    pivots = fit(rows, n, dim, CELL_ROWS, least, spread)

    def run(group: pa.Table) -> pa.Table:
        x, ids = unit(matrix(group.column("vec"), dim)), group.column("id").to_numpy()
        hashed = group.column("hash").combine_chunks()
        known, code = hashed.is_valid().to_numpy(zero_copy_only=False), hashed.fill_null(0).to_numpy().view(np.uint64)
        asks, home = (group.column(c).to_numpy() for c in ("asks", "home"))
        small, kind = x.astype(np.float32), pivots.kind(group)
        found = []

        def look(askers: np.ndarray, at: np.ndarray) -> None:
            for lo in range(0, len(askers) if len(at) else 0, 512):
                own = askers[lo : lo + 512]
                row, column = np.nonzero(small[own] @ small[at].T >= least - 1e-5)
                a, b = own[row], at[column]
                cosine = np.einsum("ij,ij->i", x[a], x[b])
                both = known[a] & known[b]
                keep = (ids[a] != ids[b]) & np.where(both, (cosine >= with_hash) & (np.bitwise_count(code[a] ^ code[b]) <= bits), cosine >= without_hash)
                found.append(np.stack([np.minimum(ids[a], ids[b])[keep], np.maximum(ids[a], ids[b])[keep]], 1))

        look(np.flatnonzero(asks if kind == "own" else asks & ~home), np.flatnonzero(home))
        if kind == "inner":  # two blocks of one cell: those of the first ask the second too
            look(np.flatnonzero(asks & home), np.flatnonzero(~home))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.table({"media_a": pairs[:, 0], "media_b": pairs[:, 1]})

    cells = place(rows, pivots, least, spread, keep=["hash", "asks"], visitors="asks")
    return tiled(cells, pivots, 4 * dim + 48).applyInArrow(run, "media_a bigint, media_b bigint").distinct()


def _by_tiles(near: DataFrame, rows: DataFrame, dim: int, least: float) -> DataFrame:
    """Pairs with cosine >= least of rows(id, vec, hash) whose hashes are paired in near(code_a, good_a, code_b, good_b)."""
    parts = lambda good: F.ceil(F.col(good) / TILE_ROWS).cast("int")
    part_of = lambda n: F.pmod(F.xxhash64("id"), n)
    tile = ["code_a", "code_b", "part_a", "part_b"]
    tiles = near.select("code_a", "code_b", parts("good_a").alias("n_a"), parts("good_b").alias("n_b"))
    tiles = tiles.withColumn("part_a", F.explode(F.sequence(F.lit(0), F.col("n_a") - 1))).withColumn("part_b", F.explode(F.sequence(F.lit(0), F.col("n_b") - 1)))
    tiles = tiles.where("code_a <> code_b or part_a <= part_b")

    def side(s: str) -> DataFrame:
        own = tiles if s == "a" else tiles.where("code_a <> code_b or part_a <> part_b")
        known = near.select(F.col(f"code_{s}").alias("hash"), parts(f"good_{s}").alias("n")).distinct()
        placed = rows.join(known, "hash").select(F.col("hash").alias(f"code_{s}"), part_of(F.col("n")).cast("int").alias(f"part_{s}"), "id", "vec")
        return own.join(placed, [f"code_{s}", f"part_{s}"]).select(*tile, F.lit(s == "a").alias("first"), "id", "vec")

    def run(group: pa.Table) -> pa.Table:
        x, ids, first = unit(matrix(group.column("vec"), dim)), group.column("id").to_numpy(), group.column("first").to_numpy()
        small, left, right = x.astype(np.float32), np.flatnonzero(first), np.flatnonzero(~first)
        same = group.column("code_a")[0] == group.column("code_b")[0] and group.column("part_a")[0] == group.column("part_b")[0]
        right = left if same else right
        found = [np.zeros((0, 2), np.int64)]
        for lo in range(0, len(left), 512):
            row, column = np.nonzero(small[left[lo : lo + 512]] @ small[right].T >= least - 1e-5)
            a, b = left[lo + row], right[column]
            keep = (ids[a] < ids[b]) | (not same)
            a, b = a[keep], b[keep]
            a, b = (side[np.einsum("ij,ij->i", x[a], x[b]) >= least] for side in (a, b))
            found.append(np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])], 1))
        pairs = np.concatenate(found)
        return pa.table({"media_a": pairs[:, 0], "media_b": pairs[:, 1]})

    return side("a").unionByName(side("b")).groupBy(*tile).applyInArrow(run, "media_a bigint, media_b bigint")


def copies(rows: DataFrame, dim: int, bits: int = 6, with_hash: float = 0.95, without_hash: float = 0.98, hash_only_bits: int = 3, detail: tuple[int, int] = (5, 59), spread: float = 3.0) -> DataFrame:
    """(media_a, media_b), media_a < media_b, of rows(id, hash, vec) that are copies of each other.

    With both hashes and both usable vectors: hashes differ in at most `bits` and cosine >= with_hash. With both vectors
    and a hash missing: cosine >= without_hash. With a vector unusable (null, other length, null or NaN inside, norm not
    above 1e-12): both hashes with a number of set bits in `detail` and at most hash_only_bits different. A row with
    neither takes part in no pair, nor does a null id. One row an id; equal rows under several ids are copies like any others. Empty tables
    give an empty result; further columns are ignored.
    """
    rows = cut(rows.where("id is not null").select("id", "hash", F.when(usable(F.col("vec"), dim), F.col("vec")).alias("vec")), "copies")
    ones = F.bit_count("hash")
    detailed = F.coalesce(ones.between(*detail), F.lit(False))
    narrow = rows.select("id", "hash", F.col("vec").isNotNull().alias("good"))
    n, n_good = narrow.agg(F.count("*"), F.count(F.when(F.col("good"), 1))).first()
    if not n:
        return rows.select(F.col("id").alias("media_a"), F.col("id").alias("media_b")).limit(0)

    codes = narrow.where(detailed).groupBy(F.col("hash").alias("code")).agg(F.count(F.when(F.col("good"), 1)).alias("n_good"), F.count(F.when(~F.col("good"), 1)).alias("n_bad"))
    codes = cut(codes, "copies-codes")
    hot_from = max(HOT, n // 4096)
    near = near_codes(codes, bits, codes.count())
    side = lambda s: codes.select(F.col("code").alias(f"code_{s}"), F.col("n_good").alias(f"good_{s}"), F.col("n_bad").alias(f"bad_{s}"))
    same = codes.where("n_good + n_bad > 1").select(F.col("code").alias("code_a"), F.col("code").alias("code_b"), F.lit(0).alias("bits"))
    near = cut(near.unionByName(same).join(side("a"), "code_a").join(side("b"), "code_b"), "copies-near")

    # Rows of a code that very many have are cut into parts, and its pairs into pairs of parts: no key of a join is large.
    part_of = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    large = cut(codes.where(F.col("n_good") + F.col("n_bad") > TILE_ROWS).select(F.col("code").alias("hash"), F.ceil((F.col("n_good") + F.col("n_bad")) / TILE_ROWS).alias("parts")), "copies-large")
    ids = narrow.where(detailed).join(large, "hash", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    left, right = (ids.select(F.col("hash").alias(f"code_{s}"), part_of(F.col("parts")).alias(f"part_{s}"), F.col("id").alias(f"id_{s}"), F.col("good").alias(f"g_{s}")) for s in "ab")

    def met(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
        for s in "ab":
            parts = F.ceil((F.col(f"good_{s}") + F.col(f"bad_{s}")) / TILE_ROWS).cast("int")
            pairs = pairs.withColumn(f"part_{s}", F.explode(F.sequence(F.lit(0), parts - 1)))
        pairs = pairs.select("code_a", "part_a", "code_b", "part_b")
        return pairs.join(left, ["code_a", "part_a"]).join(right, ["code_b", "part_b"]).where(once)

    once = (F.col("code_a") != F.col("code_b")) | (F.col("id_a") < F.col("id_b"))
    ordered = lambda df: df.select(F.least("id_a", "id_b").alias("media_a"), F.greatest("id_a", "id_b").alias("media_b"))

    # A vector is missing: the hashes alone decide.
    blind = near.where(F.col("bits") <= hash_only_bits)
    bad_first = met(blind.where("bad_a > 0"), left.where("not g_a"), right)
    bad_next = met(blind.where("bad_b > 0 and good_a > 0"), left.where("g_a"), right.where("not g_b"))
    blind = ordered(bad_first).unionByName(ordered(bad_next))

    # Both are there: the trie's pairs are candidates, the vectors decide.
    both = near.where((F.col("good_a") > 0) & (F.col("good_b") > 0))
    crowded = both.where((F.col("good_a") > hot_from) | (F.col("good_b") > hot_from))
    both = both.where((F.col("good_a") <= hot_from) & (F.col("good_b") <= hot_from))
    both = ordered(met(both, left.where("g_a"), right.where("g_b")))
    vec = rows.where("vec is not null")
    both = both.join(vec.select(F.col("id").alias("media_a"), F.col("vec").alias("va")), "media_a").join(vec.select(F.col("id").alias("media_b"), F.col("vec").alias("vb")), "media_b")
    both = both.where(dot(F.col("va"), F.col("vb")) / F.sqrt(dot(F.col("va"), F.col("va"))) / F.sqrt(dot(F.col("vb"), F.col("vb"))) >= with_hash).select("media_a", "media_b")

    if not crowded.isEmpty():
        both = both.unionByName(_by_tiles(crowded, vec.where(detailed), dim, with_hash))
    asking = vec.select("id", "vec", "hash", (~detailed).alias("asks"))
    return both.unionByName(blind).unionByName(_by_vector(asking, n_good, dim, bits, with_hash, without_hash, spread))


def copy_groups(rows: DataFrame, dim: int, detail: tuple[int, int] = (5, 59)) -> DataFrame:
    """(media_id, group_id, links): every row of rows(id, hash, vec) that has a copy, its group, and how many copies it has.

    Groups are the connected components of copies(), group_id is the smallest id. Of rows equal in hash and vector that are
    very many, one stands for all: its pairs count for each, and no pair among them is written.
    """
    rows = rows.select("id", "hash", F.when(usable(F.col("vec"), dim), F.col("vec")).alias("vec"))
    # Without a usable vector and a detailed hash a row is no copy of anything.
    rows = cut(rows.where("id is not null").where(F.col("vec").isNotNull() | F.coalesce(F.bit_count("hash").between(*detail), F.lit(False))), "copy-groups")
    stay, rest = split_repeats(rows, rows.count(), 1, ("hash", "vec"))
    pairs = cut(copies(stay, dim, detail=detail), "copy-pairs")
    both = pairs.unionByName(pairs.select(F.col("media_b").alias("media_a"), F.col("media_a").alias("media_b")))
    if rest is None:
        links = both.groupBy(F.col("media_a").alias("media_id")).agg(F.count("*").alias("links"))
    else:
        heavy = F.broadcast(stay.where("weight > 1").select(F.col("id").alias("media_b"), F.col("weight")))  # at most 100,000
        far = both.join(heavy, "media_b", "left").groupBy(F.col("media_a").alias("media_id")).agg(F.sum(F.coalesce("weight", F.lit(1))).alias("far"))
        own = stay.where("weight > 1").select(F.col("id").alias("media_id"), (F.col("weight") - 1).alias("own"))
        links = far.join(own, "media_id", "full").select("media_id", (F.coalesce("far", F.lit(0)) + F.coalesce("own", F.lit(0))).alias("links"))
    found = components(pairs.select(F.col("media_a").alias("a"), F.col("media_b").alias("b"))).select(F.col("node").alias("media_id"), F.col("component").alias("group_id"))
    found = links.join(found, "media_id", "left").select("media_id", F.coalesce("group_id", "media_id").alias("group_id"), "links")
    if rest is None:
        return found
    found = cut(found, "copy-groups-found")
    reps = F.broadcast(rest.select(F.col("rep").alias("media_id")).distinct())
    same = F.broadcast(found.join(reps, "media_id", "left_semi").withColumnRenamed("media_id", "rep"))
    return found.unionByName(rest.join(same, "rep").select(F.col("id").alias("media_id"), "group_id", "links"))
