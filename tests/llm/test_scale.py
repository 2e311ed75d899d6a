"""Operators for training data with hot values and forced into many cells, tiles and levels."""

import numpy as np
import pytest

pytest.importorskip("prismlake.llm")
from prismlake.llm import clusters as clusters_module  # noqa: E402
from prismlake.llm import neighbours as neighbours_module  # noqa: E402
from prismlake.llm.clusters import Tree, clusters, describe, leaves, ward  # noqa: E402
from prismlake.llm.copies import copies, copy_groups  # noqa: E402
from prismlake.llm.neighbours import kth, nearest, scan  # noqa: E402
from prismlake.operators import cells  # noqa: E402
from prismlake.operators.components import components  # noqa: E402

from .test_llm import VEC, copies_by_hand, neighbours_by_hand, planted  # noqa: E402


def frame(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(c) for c in v]) for i, v in enumerate(x)], VEC)


def test_nearest_with_vectors_that_very_many_have(spark, monkeypatch):
    monkeypatch.setattr(cells, "REPEATS", 10)
    x = planted(np.random.default_rng(1), 6, 12, 16, 0.4).astype(np.float32)
    x = np.concatenate([np.repeat(x[:1], 30, 0), x, np.repeat(x[20:21], 25, 0), 2 * x[20:21]])
    order = np.random.default_rng(2).permutation(len(x))
    df = spark.createDataFrame([(int(i), x[i].tolist()) for i in order] + [(3, x[3].tolist())] * 20, VEC)
    want = neighbours_by_hand(np.arange(len(x)), x, 5, 0.8)
    df = df.union(spark.createDataFrame([(None, x[0].tolist())] * 3, VEC)).selectExpr("*", "1 as home", "'x' as weight", "2 as _h")
    got = {(r["item_id"], r["neighbour_id"]) for r in nearest(df, len(x), 16, 5, 0.8).collect()}
    assert got == {(a, b) for a, b, *_ in want}


def test_nearest_in_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK_ROWS", 25)
    monkeypatch.setattr(neighbours_module, "LIST_ROWS", 80)
    x = planted(np.random.default_rng(3), 5, 60, 24, 0.8).astype(np.float32)
    want = {(a, b) for a, b, *_ in neighbours_by_hand(np.arange(len(x)), x, 5, 0.6)}
    got = {(r["item_id"], r["neighbour_id"]) for r in nearest(frame(spark, x), len(x), 24, 5, 0.6, spread=2.0).collect()}
    assert len(want & got) >= 0.99 * len(want)


def test_the_kth_best_bounds_a_scan():
    rng = np.random.default_rng(4)
    q, data = (v / np.linalg.norm(v, axis=1)[:, None] for v in (rng.standard_normal((20, 32)).astype(np.float32), rng.standard_normal((400, 32)).astype(np.float32)))
    bound = kth(q, data, -0.5, 4)
    truth = np.sort(q @ data.T, axis=1)[:, ::-1]
    assert (bound <= truth[:, 3] + 1e-6).all() and (bound > -0.5).all() and (kth(q, data[:3], 0.1, 4) == np.float32(0.1)).all()
    row, column, score = scan(q, data, bound)
    assert all(score[row == i].max() == pytest.approx(truth[i, 0], abs=1e-5) for i in range(20))


def partition(rows):
    found = {}
    for r in rows:
        found.setdefault(r["cluster_id"], set()).add(r["member_id"])
    return {frozenset(m) for m in found.values()}


def test_clusters_over_blocks_levels_and_repeats(spark, monkeypatch):
    x = planted(np.random.default_rng(5), 8, 25, 48, 0.5).astype(np.float32)
    x = np.concatenate([x, np.repeat(x[3:4], 40, 0), np.repeat(x[60:61], 30, 0)])
    df = frame(spark, x).union(spark.createDataFrame([(None, x[0].tolist())], VEC)).selectExpr("*", "1 as cell", "2 as count", "3 as cluster")
    plain = clusters(df, len(x), 48).cache()
    want = partition(plain.collect())
    assert len(want) == 8 and sum(map(len, want)) == len(x)
    monkeypatch.setattr(cells, "REPEATS", 10)
    again = {(r["cluster_id"], r["member_id"]): r["score"] for r in clusters(df, len(x), 48).collect()}
    assert again == pytest.approx({(r["cluster_id"], r["member_id"]): r["score"] for r in plain.collect()}, abs=1e-3)
    monkeypatch.setattr(cells, "BLOCK_ROWS", 20)
    monkeypatch.setattr(clusters_module, "CELL_ROWS", 70)
    monkeypatch.setattr(clusters_module, "DENSE_LEAVES", 4)
    assert partition(clusters(df, len(x), 48).collect()) == want
    top = {r["cluster_id"]: (r["size"], r["typical"]) for r in describe(plain).collect()}
    assert {c: n for c, (n, _) in top.items()} == {min(m): len(m) for m in want}
    for c, (_, typical) in top.items():
        rows = sorted((-r["score"], r["member_id"]) for r in plain.where(f"cluster_id = {c}").collect())
        assert typical == [m for _, m in rows[:3]]


def test_trees_split_weigh_and_merge(monkeypatch):
    monkeypatch.setattr(clusters_module, "BRANCH", 8)
    x = planted(np.random.default_rng(6), 60, 6, 32, 0.3)
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    leaf, count, sums = leaves(x, 0.6, step=64)
    assert count.sum() == len(x) and np.allclose(sums.sum(0), x.sum(0), atol=1e-3)
    assert all(len(set(leaf[i : i + 6])) <= 2 for i in range(0, 360, 6))
    tree = Tree(32, 0.6)
    tree.insert(x, np.ones(len(x)))
    assert len(tree.branches) > 4 and np.bincount(tree.branch).max() <= 8 and np.allclose(tree.branches.sum(0), x.sum(0), atol=1e-3)
    _, heavy, _ = leaves(x[:1], 0.6, np.array([7]))
    assert heavy.tolist() == [7]
    dense = ward(count, sums, 0.6)
    monkeypatch.setattr(clusters_module, "DENSE_LEAVES", 0)
    assert len(set(ward(count, sums, 0.6))) == len(set(dense))


def test_groups_of_copies_with_rows_that_very_many_equal(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = planted(rng, 10, 4, 8, 0.1).tolist()
    rows = [(i, int(rng.integers(1 << 40, 1 << 60)) if i % 3 else None, v) for i, v in enumerate(x)]
    rows += [(100 + i, 0x0F0F0F0F0F0F, x[0]) for i in range(40)] + [(200 + i, 0x0F0F0F0F0F0E, None) for i in range(30)] + [(300 + i, 1, None) for i in range(30)] + [(400 + i, None, x[5]) for i in range(30)]
    df = spark.createDataFrame([*rows, (None, 0x0F0F0F0F0F0F, x[0])], "id bigint, hash bigint, vec array<float>").selectExpr("*", "1 as parts", "2 as media_a")
    pairs = copies_by_hand(rows)
    links = {}
    for a, b in pairs:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
    group = {r["node"]: r["component"] for r in components(spark.createDataFrame(list(pairs), "a long, b long")).collect()}
    want = {(i, group[i], n) for i, n in links.items()}
    assert {tuple(r) for r in copy_groups(df, 8).collect()} == want
    monkeypatch.setattr(cells, "REPEATS", 10)
    assert {tuple(r) for r in copy_groups(df, 8).collect()} == want
    assert copy_groups(df.limit(0), 8).count() == 0
    assert {tuple(r) for r in copies(df, 8).collect()} == pairs


def test_few_leaves_look_far_however_many_cells(spark, monkeypatch):
    rng = np.random.default_rng(17)
    centre = rng.standard_normal((300, 48))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    x = np.repeat(centre, 8, axis=0) + rng.standard_normal((2400, 48)) * 0.08
    df = spark.createDataFrame([(int(i), [float(f) for f in v]) for i, v in enumerate(x)], "id long, vec array<float>")
    monkeypatch.setattr(clusters_module, "CELL_ROWS", 100)
    monkeypatch.setattr(clusters_module, "MEET_ROWS", 100, raising=False)
    seen, place = [], clusters_module.place

    def counted(vectors, pivots, least, spread, *more, **named):
        found = place(vectors, pivots, least, spread, *more, **named)
        if spread == clusters_module.MEET[0][2]:
            seen.append((vectors.count(), found.count()))
        return found

    monkeypatch.setattr(clusters_module, "place", counted)
    found = {}
    for r in clusters(df, len(x), 48).collect():
        found.setdefault(r["cluster_id"], set()).add(r["member_id"])
    assert sorted(map(sorted, found.values())) == [list(range(8 * i, 8 * i + 8)) for i in range(300)]
    (leaves_, placed), = seen
    assert leaves_ <= 1.3 * 300 and placed <= 4 * 300  # a theme's leaves from all cells are one before they look further


def test_ward_looks_for_pairs_of_home_leaves():
    rng = np.random.default_rng(18)
    x = np.repeat(rng.standard_normal((3, 32)), 4, axis=0) + rng.standard_normal((12, 32)) * 0.05
    x = cells.unit(x, np.float32)
    home = np.arange(12) >= 4
    group = ward(np.ones(12, np.int64), x, 0.57, home)
    assert list(group) == [0, 1, 2, 3, *[4] * 4, *[8] * 4]
    assert list(ward(np.ones(12, np.int64), x, 0.57)) == [0] * 4 + [4] * 4 + [8] * 4
