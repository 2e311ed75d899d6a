"""Operators forced into many cells, tiles and rounds give what they give in one."""

import os
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.operators import cells, dbscan, linkage, people, pipeline, similarity

from .test_vectors import faces, frame, partition, seeded


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(cells, "BLOCK_ROWS", 12)
    monkeypatch.setattr(similarity, "CELL_ROWS", 40)
    monkeypatch.setattr(dbscan, "CELL_ROWS", 40)
    monkeypatch.setattr(people, "TILE_ROWS", 7)


def unit(x):
    x = x.astype(np.float32).astype(float)
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_tiles_are_bounded_and_every_pair_meets_once(spark, small):
    x = seeded(np.random.default_rng(5), 6, 40, 16, 0.9)
    df = frame(spark, x)
    pivots = cells.fit(df, len(x), 16, 40, 0.6, similarity.whole(16))
    assert len(pivots.centre) > 3 and pivots.blocks.max() > 2 and pivots.chunks.max() > 2
    placed = cells.place(df, pivots, 0.6, similarity.whole(16))
    assert placed.groupBy("cell", "block", "tile").count().agg(F.max("count")).first()[0] < 90
    c = np.round(unit(x) @ unit(x).T, 12)
    want = {(i, j) for i, j in np.argwhere(np.triu(c >= 0.6, 1)).tolist()}
    got = [(r["a"], r["b"]) for r in similarity.pairs_within(df, len(x), 16, 0.6).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    degree = {i: int(n) for i, n in enumerate((c >= 0.6).sum(1) - 1) if n}
    assert {r["id"]: r["links"] for r in similarity.links(df, len(x), 16, 0.6).collect()} == degree
    near = {}
    for r in similarity.neighbours(df, len(x), 16, 3, 0.6, spread=similarity.whole(16)).collect():
        near.setdefault(r["id"], set()).add(r["other"])
    c[np.arange(len(x)), np.arange(len(x))] = -1
    assert near == {i: {int(j) for j in np.lexsort((np.arange(len(x)), -c[i]))[:3] if c[i, j] >= 0.6} for i in range(len(x)) if (c[i] >= 0.6).any()}


@pytest.mark.parametrize("points", [1, 4, 7])
def test_density_over_tiles_equals_the_graph(spark, small, points):
    x = seeded(np.random.default_rng(6), 5, 30, 16, 1.1)
    df = frame(spark, x)
    edges = similarity.pairs_within(df, len(x), 16, 0.75)
    want = {r["id"]: r["cluster"] for r in dbscan.dbscan(df, edges, points).collect()}
    assert {r["id"]: r["cluster"] for r in dbscan.density(df, len(x), 16, 0.75, points).collect()} == want
    if points > 1:
        assert -1 in want.values()
    half = df.withColumn("side", F.col("id") % 2)
    inner = edges.where("a % 2 = b % 2")
    want = {r["id"]: r["cluster"] for r in dbscan.dbscan(df, inner, points).collect()}
    assert {r["id"]: r["cluster"] for r in dbscan.density(half, len(x), 16, 0.75, points, "side").collect()} == want


def test_projected_neighbours_of_long_vectors(spark):
    x = seeded(np.random.default_rng(7), 8, 12, 512, 0.5)
    c = unit(x) @ unit(x).T - 2 * np.eye(len(x))
    got = [(r["id"], r["other"]) for r in similarity.neighbours(frame(spark, x), len(x), 512, 5, 0.3).collect()]
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-c[i])[:5]}
    assert len(want & set(got)) >= 0.9 * len(want) and len(got) == len(set(got))


def test_means_over_tiles_and_wide_persons(spark, small):
    rng = np.random.default_rng(8)
    x = unit(seeded(rng, 4, 15, 8, 1.0))
    person = [1] * 20 + [2] * 3 + [3] * 12 + [4] * 5  # 1 and 3 are wider than a tile
    ex = faces(spark, [(i, p, x[i]) for i, p in enumerate(person)])
    ask = faces(spark, [(100 + i, None, x[40 + i]) for i in range(20)] + [(3, None, x[3])]).drop("personId")
    bars = [(100, 1), (100, 3), (101, 2), (3, 1)]
    got = {(r["id"], r["personId"]): r["score"] for r in people._means(ex, ask, 8, 3, spark.createDataFrame(bars, "id long, personId long"), best=9).collect()}
    want = {}
    for i, v in [(100 + i, x[40 + i]) for i in range(20)] + [(3, x[3])]:
        for p in (1, 2, 3, 4):
            own = [float(x[j] @ v) for j in range(40) if person[j] == p and j != i]
            if (i, p) not in bars:
                want[i, p] = np.mean(sorted(own)[::-1][:3])
    assert got == pytest.approx(want, abs=1e-6)


def test_repeats_stand_for_the_rest(spark, monkeypatch):
    monkeypatch.setattr(cells, "REPEATS", 10)
    rows = [(i, [1.0, 2.0]) for i in range(30)] + [(100 + i, [float(i), 1.0]) for i in range(5)] + [(7, [1.0, 2.0])] * 40
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    stay, rest = cells.split_repeats(df, len(rows), 3)
    kept = {r["id"]: r["weight"] for r in stay.collect()}
    assert kept == {0: 28, 1: 1, 2: 1, **{100 + i: 1 for i in range(5)}}
    assert {r["id"]: r["rep"] for r in rest.collect()} == {i: 0 for i in range(3, 30)}
    stay, rest = cells.split_repeats(df.where("id > 40"), 5, 3)
    assert rest is None and {r["weight"] for r in stay.collect()} == {1}


def test_linkage_by_rounds_equals_linkage_in_one_task(spark):
    x = unit(seeded(np.random.default_rng(9), 5, 10, 16, 0.8))
    rows = spark.createDataFrame([(i, [float(c) for c in v], i if i % 7 else 500, {3: 77, 33: 77, 12: 88}.get(i)) for i, v in enumerate(x)], "id long, vec array<float>, mediaId long, anchor long")
    no = spark.createDataFrame([(13, 88), (14, 88)], "faceId long, personId long")
    near = similarity.neighbours(rows.select("id", "vec"), len(x), 16, 49, -0.9 + 1.0).selectExpr("least(id, other) a", "greatest(id, other) b").distinct()
    for least in (0.4, 0.6):
        one = {r["id"]: r["cluster"] for r in linkage.link(rows, near, least, no).collect()}
        many = {r["id"]: r["cluster"] for r in linkage.link(rows, near, least, no, task_rows=3).collect()}
        assert one == many and len(one) == 50 and one[3] == one[33] and one[12] not in (one[13], one[14], one[3])
        assert 3 < len(set(one.values())) < 40


def test_consistent_examples_of_a_large_person(spark, monkeypatch):
    x = seeded(np.random.default_rng(10), 3, 14, 16, 0.5)
    ex = faces(spark, [(i, 1 if i < 24 else 2, v) for i, v in enumerate(x)])
    want = {(r["personId"], r["id"]) for r in linkage.trusted(ex, 16).collect()}
    monkeypatch.setattr(linkage, "DENSE_ROWS", 20)
    assert {(r["personId"], r["id"]) for r in linkage.trusted(ex, 16).collect()} == want and 0 < len(want) < 42


def test_identities_go_by_size(spark):
    c = spark.createDataFrame([(1, 10, None), (2, 10, None), (3, 4, None), (4, 9, 50), (5, 5, None)], "cluster long, size long, anchor long")
    v = spark.createDataFrame([(1, 60, 5), (1, 61, 4), (2, 60, 6), (2, 62, 4), (3, 62, 2), (5, 50, 5), (4, 60, 9)], "cluster long, personId long, n long")
    assert {r["cluster"]: r["personId"] for r in people.inherit(c, v).collect()} == {4: 50, 1: 60, 2: 62}
    assert people.inherit(c.limit(0), v).count() == 0


def test_rebuild_of_planted_people(spark):
    rng = np.random.default_rng(11)
    centre = unit(rng.standard_normal((5, 32)))
    rows, vec = [], {}

    def add(i, c, media, person=None, locked=None, box=(0.2, 0.2, 0.4, 0.4), score=0.9, size=(1000, 1000), noise=0.05):
        vec[i] = unit((c + noise * rng.standard_normal(32))[None])[0]
        rows.append((i, media, person, locked, [float(v) for v in vec[i]], *box, score, *size))

    for i in range(6):
        add(i, centre[0], i, person=900, box=(0.2, 0.2, 0.3 + 0.02 * i, 0.4))
    add(10, centre[1], 20, locked=901, person=901)
    add(11, centre[1], 21)
    add(12, centre[1], 22)  # rejected for 901
    add(13, centre[2], 23)  # alone
    for i in range(20, 23):
        add(i, centre[3], 0 if i == 20 else i, person=902)
    add(23, 0.75 * centre[3] + 0.66 * centre[0], 0)  # its first choice holds a face of its media
    add(30, centre[4], 50)  # like an artifact
    box = "boxLeft double, boxTop double, boxRight double, boxBottom double, score double, width int, height int"
    face = spark.createDataFrame(rows, f"id long, mediaId long, personId long, lockedPersonId long, embedding array<float>, {box}")
    art = spark.createDataFrame([(99, [float(v) for v in centre[4]])], "id long, embedding array<float>")
    no = spark.createDataFrame([(12, 901)], "faceId long, personId long")
    found, members = pipeline.rebuild(face, art, 32, no, link_least=0.7)
    by = {}
    for r in members.collect():
        by.setdefault(r["cluster"], set()).add(r["id"])
    assert by[0] == {0, 1, 2, 3, 4, 5} and by[10] == {10, 11} and by[20] >= {20, 21, 22} and 12 not in set().union(*by.values()) and 13 not in set().union(*by.values()) and 30 not in set().union(*by.values())
    people_ = {r["cluster"]: r for r in found.collect()}
    assert {c: r["personId"] for c, r in people_.items()} == {0: 900, 10: 901, 20: 902} and [people_[c]["position"] for c in (0, 20, 10)] == [0, 1, 2]
    old = spark.createDataFrame([(900, "A", people_[0]["cover"]), (902, "C", 1)], "id long, name string, coverFaceId long")
    table = {r["id"]: (r["name"], r["redraw"]) for r in pipeline.new_persons(found, old).collect()}
    assert table == {900: ("A", False), 901: (None, True), 902: ("C", True)}


def test_cover_is_large_and_inside(spark):
    rows = [(1, 1, [1.0, 0.0], 0.0, 0.2, 0.5, 0.9, 0.9, 10, 10), (1, 2, [1.0, 0.01], 0.2, 0.2, 0.3, 0.3, 0.9, 100, 100), (1, 3, [1.0, 0.02], 0.2, 0.2, 0.3, 0.3, 0.9, 0, None), (1, 4, [0.0, 1.0], 0.2, 0.2, 0.9, 0.9, 0.9, 100, 100)]
    df = spark.createDataFrame(rows, "cluster long, id long, vec array<float>, boxLeft double, boxTop double, boxRight double, boxBottom double, score double, width int, height int")
    assert [tuple(r) for r in pipeline.cover(df, 2).collect()] == [(1, 2)]
    assert [tuple(r) for r in pipeline.cover(df.where("id = 1"), 2).collect()] == [(1, 1)]


def test_dense_chains_equal_naive_with_bans():
    x = seeded(np.random.default_rng(12), 4, 9, 8, 0.9)
    got = linkage.average_linkage(x, 0.3, bans=[(0, 1), (2, 30)])
    assert all(got[a] != got[b] for a, b in ((0, 1), (2, 30))) and len(partition(got)) > 3


def places_and_strays(n, dim, seed):
    """Many small places far from each other, and a fifth of strays, some of them near the edge of a place."""
    rng = np.random.default_rng(seed)
    centre = np.linalg.qr(rng.normal(size=(dim, dim)))[0][:24]
    x = centre[rng.integers(0, 24, n)] + rng.normal(size=(n, dim)) * 0.5 / np.sqrt(dim)
    x[: n // 10] = rng.normal(size=(n // 10, dim))
    x[n // 10 : n // 5] = centre[rng.integers(0, 24, n // 5 - n // 10)] + rng.normal(size=(n // 5 - n // 10, dim)) * 1.2 / np.sqrt(dim)
    return rng.permutation(x)


def test_links_and_clusters_place_few_rows(spark, small):
    """Every place but the strays' neighbours is met where it is, and strays are told to both sides."""
    x, dim = places_and_strays(900, 32, 3), 32
    df = frame(spark, x)
    pivots = cells.gather(df, len(x), dim, 40, 0.7, similarity.whole(dim))
    _, _, _, back = pivots.visiting(unit(x).astype(np.float32), 0.7, similarity.whole(dim))
    assert pivots.far > 10 and 0 < pivots.held[-1] < 300 and back.any()
    assert pivots.held.sum() + pivots.met.sum() < 2 * len(x)
    c = np.round(unit(x) @ unit(x).T, 12) - 2 * np.eye(len(x))
    assert {r["id"]: r["links"] for r in similarity.links(df, len(x), dim, 0.7).collect()} == {i: int(d) for i, d in enumerate((c >= 0.7).sum(1)) if d}
    edges = frame_of_pairs(spark, np.argwhere(np.triu(c >= 0.7)))
    for points in (4, 12):
        want = {r["id"]: r["cluster"] for r in dbscan.dbscan(df, edges, points).collect()}
        assert {r["id"]: r["cluster"] for r in dbscan.density(df, len(x), dim, 0.7, points).collect()} == want


def test_density_never_joins_its_vectors(spark, small, monkeypatch):
    """A join would shuffle all vectors by id, beside the shuffle of their tiles."""
    plans, write = {}, dbscan.cut
    monkeypatch.setattr(dbscan, "cut", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and write(df, name))
    x = seeded(np.random.default_rng(6), 5, 30, 16, 1.1)
    got = dbscan.density(frame(spark, x), len(x), 16, 0.75, 4)
    depth, under = lambda line: len(line) - len(line.lstrip(" :+-")), []
    lines = plans["density-trees"].split("\n")
    for i, line in enumerate(lines):
        if line.lstrip(" :+-").startswith("Join"):
            under += [x for x in lines[i + 1 : next((j for j in range(i + 1, len(lines)) if depth(lines[j]) <= depth(line)), len(lines))]]
    assert under and not any("vec#" in x for x in under)
    assert got.count() == len(x)


def test_refinement_leaves_one_table(spark, small, monkeypatch):
    """Members' vectors and earlier labels are removed after each round."""
    kept, write = {}, dbscan.cut
    monkeypatch.setattr(dbscan, "cut", lambda df, name: kept.setdefault((found := write(df, name))._cut_path, (name, found))[1])
    x = seeded(np.random.default_rng(6), 5, 30, 16, 1.1)
    df = frame(spark, x)
    labels = dbscan.density(df, len(x), 16, 0.6, 4).select("id", "cluster")
    assert dbscan.refine(df, labels, 16, 0.4, 4, step=0.15, floor=0.0, rounds=2, largest=5, share=0.0).count() == len(x)
    assert sum(os.path.exists(path) for path, (name, _) in kept.items() if name == "refine") == 1
    assert not any(os.path.exists(path) for path, (name, _) in kept.items() if name == "density-tiles")


def test_visits_hold_few_vectors_of_pivots_at_once():
    """Rows near very many pivots: the pivots' vectors aren't all gathered beside each other."""
    x = unit(np.random.default_rng(2).normal(size=(2500, 96)) + 0.5).astype(np.float32)
    k = 2000
    pivots = cells.Groups(x[:k], np.zeros((0, 0), np.float32), np.ones(k + 1), np.ones(k + 1), np.arange(k), 0.6)
    tracemalloc.start()
    home, row, _, _ = pivots.visiting(x[k:], 0.5, similarity.whole(96))
    assert tracemalloc.get_traced_memory()[1] < 200 << 20 and len(row) > 100_000
    tracemalloc.stop()


def test_rebuilt_people_keep_one_table_of_vectors(spark, monkeypatch):
    kept, write = {}, pipeline.cut
    monkeypatch.setattr(pipeline, "cut", lambda df, name: kept.setdefault((found := write(df, name))._cut_path, found))
    rng = np.random.default_rng(3)
    x = np.repeat(np.linalg.qr(rng.normal(size=(16, 16)))[0][:3], 6, axis=0) + rng.normal(size=(18, 16)) * 0.02
    rows = [(i, i, None, 7 if i < 2 else None, x[i].tolist(), 0.2, 0.2, 0.4, 0.4, 0.9, 100, 100) for i in range(18)]
    face = spark.createDataFrame(rows, "id long, mediaId long, personId long, lockedPersonId long, embedding array<float>, boxLeft double, boxTop double, boxRight double, boxBottom double, score double, width int, height int")
    found, members = pipeline.rebuild(face, face.where("id < 0").select("id", "embedding"), 16)
    there = [df for path, df in kept.items() if os.path.exists(path) and {"vec", "embedding"} & set(df.columns)]
    assert len(there) == 1 and len(kept) > 6
    assert sorted(r["faces"] for r in found.collect()) == [6, 6, 6] and members.count() == 18


def frame_of_pairs(spark, pairs):
    return spark.createDataFrame([tuple(map(int, p)) for p in pairs], "a long, b long")


def test_neighbours_of_places_and_strays(spark, small):
    x, dim = places_and_strays(900, 32, 4), 32
    c = np.round(unit(x) @ unit(x).T, 12) - 2 * np.eye(len(x))
    got = {(r["id"], r["other"]) for r in similarity.neighbours(frame(spark, x), len(x), dim, 5, 0.6, spread=similarity.whole(dim)).collect()}
    assert got == {(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), -c[i]))[:5] if c[i, j] >= 0.6}


def test_rejections_of_a_plan_pass_on_two_persons_a_face(spark, tmp_path, monkeypatch):
    """knn_rejected needs the two best persons of a face: no more of them are written down."""
    from prismlake.plans import faces as plan

    rng, asked = np.random.default_rng(8), []
    means = people._means
    monkeypatch.setattr(people, "_means", lambda *a, **kw: asked.append(means(*a, **kw)) or asked[-1])
    x = rng.normal(size=(90, 128)).astype(np.float32)
    rows = [(i, i, 2, i % 6 if i < 60 else None, False, x[i].tolist()) for i in range(90)]
    spark.createDataFrame(rows, "id long, mediaId long, embedVersion int, lockedPersonId long, isArtifact boolean, embedding array<float>").withColumn("personId", F.col("lockedPersonId")).write.parquet(f"{tmp_path}/face.parquet")
    got = plan.two_rejected(spark, str(tmp_path)).groupBy("faceId").count().collect()
    assert {r["faceId"]: r["count"] for r in got} == {i: i % 3 for i in range(60, 90) if i % 3}
    assert asked[0].count() == 60


def test_gather_finds_places_by_a_share_of_many_rows(spark, monkeypatch):
    from prismlake.operators import cells

    rng = np.random.default_rng(23)
    x = np.repeat(rng.standard_normal((100, 32)), 20, axis=0) + rng.standard_normal((2000, 32)) * 0.2
    df = spark.createDataFrame([(i, [float(f) for f in v]) for i, v in enumerate(x)], "id long, vec array<float>")
    for name, value in (("GROUP_SAMPLE", 100), ("GROUP_ONE_OF", 3), ("GROUP_MOST", 1000)):
        monkeypatch.setattr(cells, name, value, raising=False)
    groups = cells.gather(df, len(x), 32, 500, 0.86, 1.01 * np.sqrt(32))
    assert groups.held[groups.far] < 0.5 * len(x)  # of a twentieth no place would be found
