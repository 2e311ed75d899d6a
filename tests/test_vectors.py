import numpy as np
import pytest

from prismlake.ml import image_ops, protocol, tokenizers
from prismlake.operators import dbscan, linkage, people, similarity


def circle(*degrees):
    a = np.radians(degrees)
    return np.stack([np.cos(a), np.sin(a)], 1)


def frame(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vec array<float>")


def run_dbscan(spark, x, eps, min_points):
    v = frame(spark, x)
    e = similarity.pairs_within(v, len(x), x.shape[1], 1 - eps).cache()
    found = dbscan.dbscan(v, e, min_points)
    got = {r["id"]: r["cluster"] for r in found.collect()}
    assert got == {r["id"]: r["cluster"] for r in dbscan.density(v, len(x), x.shape[1], 1 - eps, min_points).collect()}
    return v, e, found, got


def test_density_clusters_on_the_circle(spark):
    *_, got = run_dbscan(spark, circle(0, 1, 2, 3, 4, 90, 91, 92, 93, 94, 200), 0.01, 4)
    assert [got[i] for i in range(11)] == [0] * 5 + [5] * 5 + [-1]
    *_, got = run_dbscan(spark, circle(*range(0, 40, 2)), 0.0025, 3)
    assert set(got.values()) == {0}


def test_refinement_splits_and_keeps(spark):
    v, e, found, got = run_dbscan(spark, circle(0, 1, 2, 3, 7, 8, 9, 10), 0.06, 3)
    assert set(got.values()) == {0}
    fine = dbscan.refine(v, found, 2, 0.06, 3, step=0.0295, floor=0.0, rounds=2, largest=5, share=0.0)
    assert {r["cluster"] for r in fine.collect()} == {0, 4}


def naive(x, least):
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        best = max(((np.mean(x[a] @ x[b].T), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j), key=lambda t: t[0])
        if best[0] < least:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


def partition(label):
    return {frozenset(np.flatnonzero(label == v).tolist()) for v in set(label.tolist())}


def seeded(rng, groups, each, dim, spread=0.3):
    c = np.repeat(rng.standard_normal((groups, dim)), each, axis=0)
    x = c + rng.uniform(-spread, spread, c.shape)
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8])
def test_dense_linkage_equals_naive(least):
    x = seeded(np.random.default_rng(1), 5, 8, 8)
    assert partition(linkage.average_linkage(x, least)) == naive(x, least)


@pytest.mark.parametrize("least", [0.5, 0.7, 0.85])
def test_sparse_linkage_equals_dense(least):
    x = seeded(np.random.default_rng(2), 6, 12, 16)
    every = [(i, j) for i in range(len(x)) for j in range(i + 1, len(x))]
    assert partition(linkage.sparse_linkage(x, every, least)) == partition(linkage.average_linkage(x, least))


def test_linkage_constraints():
    x = circle(0, 90, 180)
    label = linkage.average_linkage(x, 0.9, anchor=[1, 1, None])
    assert label[0] == label[1] != label[2]
    x = circle(0, 1, 2, 3)
    assert linkage.average_linkage(x, 0.9, bans=[(0, 3)])[0] != linkage.average_linkage(x, 0.9, bans=[(0, 3)])[3]
    label = linkage.average_linkage(x, 0.9, anchor=[1, None, None, 2])
    assert label[0] != label[3]
    pair, every = seeded(np.random.default_rng(3), 1, 2, 8, 0.01), [(0, 1)]
    assert len(set(linkage.sparse_linkage(pair, every, 0.9, media=[5, 5]))) == 2 and len(set(linkage.sparse_linkage(pair, every, 0.9, media=[5, 6]))) == 1
    assert len(set(linkage.sparse_linkage(pair, every, 0.9, anchor=[7, None], rejected=[set(), {7}]))) == 2


def test_linkage_on_spark(spark):
    x = seeded(np.random.default_rng(4), 4, 10, 16)
    rows = spark.createDataFrame([(i, [float(c) for c in v], i, 77 if i in (0, 39) else None) for i, v in enumerate(x)], "id long, vec array<float>, mediaId long, anchor long")
    near = similarity.neighbours(rows.select("id", "vec"), len(x), 16, 8, 0.6).selectExpr("least(id, other) a", "greatest(id, other) b").distinct()
    got = {r["id"]: r["cluster"] for r in linkage.link(rows, near, 0.7).collect()}
    assert len(got) == 40 and got[0] == got[39] and len(set(got.values())) in (3, 4, 5)


def faces(spark, rows):
    return spark.createDataFrame([(i, p, [float(c) for c in v]) for i, p, v in rows], "id long, personId long, embedding array<float>")


def test_assignment_by_examples(spark):
    ex = faces(spark, [(i, 1, circle(a)[0]) for i, a in enumerate([0, 2, 90, 92])] + [(10 + i, 2, circle(a)[0]) for i, a in enumerate([180, 182])])
    ask = faces(spark, [(100, None, circle(91)[0]), (101, None, circle(136)[0]), (102, None, circle(181)[0])])
    got = {r["id"]: r["personId"] for r in people.assign_by_examples(ex, ask.drop("personId"), 2, k=2).collect()}
    assert got == {100: 1, 102: 2}
    no = spark.createDataFrame([(102, 2)], "faceId long, personId long")
    assert {r["id"]: r["personId"] for r in people.assign_by_examples(ex, ask.drop("personId"), 2, k=2, rejected=no).collect()} == {100: 1}
    # With the two nearest persons rejected the third still counts, however persons are spread.
    three = ex.unionByName(faces(spark, [(20, 3, circle(170)[0]), (21, 3, circle(172)[0])]))
    both = spark.createDataFrame([(102, 2), (102, 3), (100, 3)], "faceId long, personId long")
    assert {r["id"]: r["personId"] for r in people.assign_by_examples(three, ask.drop("personId"), 2, k=2, least=-1.0, margin=0.0, rejected=both).collect()}[102] == 1
    assert {r["outcome"]: r["faces"] for r in people.self_check(ex, 2, k=1).collect()} == {"right": 6}
    assert people.assign_by_examples(ex.limit(0), ask.drop("personId"), 2).count() == 0


def test_consistent_examples_drop_a_foreign_mode():
    x = np.concatenate([circle(0, 2, 4, 6, 8), circle(150, 152)])
    assert linkage.consistent_examples(x).tolist() == [True] * 5 + [False] * 2
    assert linkage.consistent_examples(circle(0, 170)).all()


def test_centroids_overlap_and_identity(spark):
    df = spark.createDataFrame([(1, [3.0, 0.0]), (1, [0.0, 5.0]), (2, [0.0, 2.0])], "personId long, vec array<float>")
    got = {r["personId"]: (r["n"], r["centroid"]) for r in people.centroids(df, "personId", 2).collect()}
    assert got[1][0] == 2 and got[1][1] == pytest.approx([0.5**0.5] * 2)
    box = "id long, mediaId long, boxLeft float, boxTop float, boxRight float, boxBottom float, score float"
    a = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 1.0, 0.9), (2, 1, 0.0, 0.0, 1.0, 0.9, 0.8), (3, 1, 0.9, 0.9, 1.0, 1.0, 0.7)], box)
    assert {r["id"] for r in people.suppress(a).collect()} == {1, 3}
    assert [(r["oldId"], r["newId"]) for r in people.best_overlap(a.where("id = 2"), a.where("id <> 2")).collect()] == [(2, 1)]


def test_search(spark):
    v = frame(spark, circle(0, 10, 20, 180)).union(spark.createDataFrame([(9, [1.0])], "id long, vec array<float>"))
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(similarity.topk(v, [1.0, 0.0], 2)) == [0, 1] and ids(similarity.topk(v, [1.0, 0.0], 9, 0.9, exclude=[0])) == [1, 2]
    assert ids(similarity.topk(v, [], 3)) == [] and ids(similarity.similar(v, 0, 5, 0.95)) == [1] and ids(similarity.similar(v, 77)) == []
    got = {r["id"]: r["topic"] for r in similarity.nearest_topic(v.where("id < 9"), [("east", [1.0, 0.0]), ("west", [-1.0, 0.0])], 0.5).collect()}
    assert got == {0: "east", 1: "east", 2: "east", 3: "west"}


def test_pairs_over_several_cells(spark, monkeypatch):
    monkeypatch.setattr(similarity, "CELL_ROWS", 40)
    x = seeded(np.random.default_rng(5), 12, 20, 16, 0.6)
    got = {(r["a"], r["b"]) for r in similarity.pairs_within(frame(spark, x), len(x), 16, 0.85).collect()}
    x32 = x.astype(np.float32).astype(float)
    x32 /= np.linalg.norm(x32, axis=1)[:, None]
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if round(float(x32[i] @ x32[j]), 12) >= 0.85}
    assert len(want - got) <= 0.01 * len(want) and not got - want


def grey(a):
    a = a.astype(np.int64)
    return ((255 << 24) | (a << 16) | (a << 8) | a).ravel()


def blur(a, k=3):
    p = np.pad(a.astype(float), k // 2, mode="edge")
    return np.mean([p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(k) for j in range(k)], axis=0).astype(int)


def test_image_measures(spark):
    y, x = np.mgrid[:96, :128]
    board = ((x // 8 + y // 8) % 2) * 255
    sharp, soft = image_ops.quality(grey(board), 128, 96)[0], image_ops.quality(grey(blur(blur(board))), 128, 96)[0]
    half = board.copy()
    half[:, 64:] = 128
    assert soft < sharp / 5 and image_ops.quality(grey(half), 128, 96)[0] > 0.5 * sharp
    assert image_ops.quality(grey(np.full((10, 10), 51)), 10, 10) == (0.0, pytest.approx(0.2)) and image_ops.quality(grey(np.full((2, 2), 51)), 2, 2)[0] == 0
    ramp = np.tile(np.arange(90, 0, -10), (8, 1))
    assert image_ops.difference_hash(grey(ramp), 9, 8) == -1 and image_ops.difference_hash(grey(ramp[:, ::-1]), 9, 8) == 0
    df = spark.createDataFrame([(1, grey(ramp).tolist(), 9, 8), (2, None, 9, 8), (3, [1], 5, 5)], "id long, argb array<bigint>, width int, height int")
    assert {r["id"]: r["hash"] for r in image_ops.measure(df).collect()} == {1: -1, 2: None, 3: None}


def test_geometry():
    src = np.array([[38.2946, 51.6963], [73.5318, 51.5014], [56.0252, 71.7366], [41.5493, 92.3655], [70.7299, 92.2041]])
    assert image_ops.similarity_transform(src, src) == pytest.approx([1, 0, 0, 0], abs=1e-9)
    turned = src @ np.array([[0.5, 0.1], [-0.1, 0.5]]) + [3, -4]
    assert image_ops.similarity_transform(src, turned) == pytest.approx([0.5, 0.1, 3, -4])
    tiles = image_ops.tiles(2560, 1707, 3)
    seen = np.zeros((1707, 2560), bool)
    for a, b, c, d in tiles:
        seen[b:d, a:c] = True
    assert len(tiles) == 9 and seen.all() and image_ops.tiles(100, 80, 3) == []
    assert any(a <= 950 and c >= 1050 and b <= 950 and d >= 1050 for a, b, c, d in image_ops.tiles(2000, 2000, 2))
    p = np.zeros((40, 60))
    p[10:20, 5:30] = 0.9
    p[30:31, 50:52] = 0.9
    assert len(image_ops.text_boxes(p)) == 1
    scores = np.eye(4)[[0, 1, 1, 0, 1, 2, 2, 3]]
    assert image_ops.ctc(scores, "abc") == ("aabc", 1.0)


def test_tokenizers():
    vocabulary = {"<|startoftext|>": 1, "<|endoftext|>": 2, "c": 3, "a": 4, "t</w>": 5, "ca": 6, "cat</w>": 7}
    t = tokenizers.PairTokenizer(vocabulary, {("c", "a"): 0, ("ca", "t</w>"): 1}, 6)
    assert t.encode("  CAT ") == ([1, 7, 2, 2, 2, 2], [1, 1, 1, 0, 0, 0])
    p = tokenizers.PieceTokenizer({"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3, "кот": 4, "##ик": 5, "на": 6, ",": 7, "!": 8}, 6)
    assert p.encode("котик, на")[0] == [2, 4, 5, 7, 6, 3] and 1 in p.encode("пёс!")[0]


def test_encoders(spark):
    df = spark.createDataFrame([(1, "red car"), (2, "car red"), (3, None)], "id long, text string")
    got = {r["id"]: r["vec"] for r in protocol.embed(df, "text", protocol.HashEncoder(8)).collect()}
    assert got[1] == pytest.approx(got[2]) and got[3] is None
    assert protocol.cascade(np.array([0.0, 0.5]), lambda at: np.full(len(at), 0.9)).tolist() == [0.0, 0.9]
    assert protocol.routes("hello", True, True) == "english" and protocol.routes("море", True, True) == "multilingual" and protocol.routes("море", True, False) == "english"


def test_pairs_within_misses_none_across_cells(spark, monkeypatch):
    monkeypatch.setattr(similarity, "CELL_ROWS", 50)
    turn = np.linspace(0, 2 * np.pi, 400, endpoint=False)
    x = np.zeros((400, 96), np.float32)  # on a circle a partner lies in the very direction of the next cell
    x[:, 0], x[:, 1] = np.cos(turn), np.sin(turn)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = {(int(a), int(b)) for a, b in np.argwhere(np.triu(np.round(u @ u.T, 12) >= 0.86, 1))}
    assert {(r["a"], r["b"]) for r in similarity.pairs_within(df, 400, 96, 0.86).collect()} == want
