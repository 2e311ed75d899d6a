import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake import perf
from prismlake.functions import vectors
from prismlake.ml import faces
from prismlake.sources import files, images
from prismlake.streaming import incremental


def tiff(orientation, lat=None):
    """An EXIF block with an orientation and, if given, a location in the south and west."""
    gps = b""
    n = 1 + (lat is not None)
    head = b"II*\x00" + struct.pack("<I", 8) + struct.pack("<H", n) + struct.pack("<HHIHH", 0x112, 3, 1, orientation, 0)
    if lat is not None:
        at = 8 + 2 + 12 * n + 4
        head += struct.pack("<HHII", 0x8825, 4, 1, at)
        data = at + 2 + 12 * 4 + 4
        third = lambda v: struct.pack("<6I", int(v), 1, 30, 1, 0, 1)
        gps = struct.pack("<H", 4) + struct.pack("<HHI4s", 1, 2, 2, b"S\0\0\0") + struct.pack("<HHII", 2, 5, 3, data) + struct.pack("<HHI4s", 3, 2, 2, b"W\0\0\0") + struct.pack("<HHII", 4, 5, 3, data + 24) + struct.pack("<I", 0) + third(lat) + third(lat + 1)
    return b"Exif\x00\x00" + head + struct.pack("<I", 0) + gps


def test_pictures_round_trip_and_bad_ones_are_none():
    px = np.random.default_rng(0).integers(0, 256, (13, 17, 3))
    assert (images.decode(images.encode(px)) == px).all()
    assert (images.decode(b"P6 17 13 255\n" + px.astype(np.uint8).tobytes()) == px).all()
    assert (images.decode(b"P5\n# x\n17 13\n255\n" + px[..., 0].astype(np.uint8).tobytes()) == px[..., :1]).all()
    rows = b"".join(r[:, ::-1].astype(np.uint8).tobytes() + b"\0" for r in px[::-1])
    assert (images.decode(b"BM" + bytes(8) + struct.pack("<I", 54) + struct.pack("<IiiHHI", 40, 17, 13, 1, 24, 0) + bytes(20) + rows) == px).all()
    assert images.decode(b"\x89PNG\r\n\x1a\nxx") is None and images.decode(b"") is None and images.decode(None) is None
    assert images.decode(images.encode(px), 8).shape == (6, 8, 3) and images.argb(px).dtype == np.int32


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
def test_filters_of_png(kind):
    import zlib

    px = np.random.default_rng(kind).integers(0, 256, (5, 6, 3))
    lines = []
    for y in range(5):
        line = [kind]
        for x in range(18):
            at = px[y].ravel()
            a, b, c = int(at[x - 3]) if x > 2 else 0, int(px[y - 1].ravel()[x]) if y else 0, int(px[y - 1].ravel()[x - 3]) if y and x > 2 else 0
            p = a + b - c
            paeth = a if abs(p - a) <= min(abs(p - b), abs(p - c)) else b if abs(p - b) <= abs(p - c) else c
            line.append((int(at[x]) - {1: a, 2: b, 3: (a + b) // 2, 4: paeth}[kind]) % 256)
        lines.append(bytes(line))
    plain = images.encode(px)
    start = plain.index(b"IDAT") - 4
    body = zlib.compress(b"".join(lines))
    made = plain[:start] + struct.pack(">I", len(body)) + b"IDAT" + body + bytes(4) + plain[plain.index(b"IEND") - 4 :]
    assert (images.decode(made) == px).all()


def test_exif():
    assert images.exif(b"\xff\xd8" + tiff(6))["rotation"] == 90 and images.exif(tiff(1)) == {"rotation": 0} and images.exif(b"nothing") == {}
    got = images.exif(tiff(3, 55))
    assert got["rotation"] == 180 and got["latitude"] == pytest.approx(-55.5) and got["longitude"] == pytest.approx(-56.5)
    assert images.exif(tiff(3, 55)[:30]) in ({}, {"rotation": 180})


@pytest.mark.parametrize("turn, orientation", [(0, 1), (90, 6), (180, 3), (270, 8)])
def test_parts_of_turned_pictures(turn, orientation):
    shown = np.zeros((80, 120, 3), int)
    shown[20:40, 60:80] = 200  # what the viewer sees
    content = images.encode(np.rot90(shown, turn // 90)) + tiff(orientation)
    box = (60 / 120, 20 / 80, 80 / 120, 40 / 80)
    crop = images.face_crop(content, box, side=5)
    assert (crop.left, crop.top, crop.width, crop.height) == (48, 8, 120, 80) and crop.scale == pytest.approx(0.25)
    assert crop.px.shape[:2] == (11, 11) and crop.px[5, 5, 0] == 200 and crop.px[0, 0, 0] == 0
    assert (crop.x(60 / 120), crop.y(20 / 80)) == pytest.approx((3.0, 3.0))
    small = images.decode(images.avatar(content, box, side=10))
    assert small.shape == (10, 10, 3) and small[5, 5, 0] == 200 and images.avatar(b"x", box) is None
    whole = images.decode(images.avatar(content, box))
    assert whole.shape == (30, 30, 3) and whole[:, :, 0].sum() == 200 * 400


def test_picture_tables(spark):
    px = np.full((4, 6, 3), 9)
    df = spark.createDataFrame([(1, images.encode(px) + tiff(6, 10)), (2, b"broken"), (3, None)], "id long, content binary")
    got = {r["id"]: (r["width"], r["height"], r["argb"] and len(r["argb"])) for r in images.pixels(df).collect()}
    assert got == {1: (4, 6, 24), 2: (None, None, None), 3: (None, None, None)}
    box = df.select("*", *[F.lit(v).alias(c) for c, v in (("boxLeft", 0.0), ("boxTop", 0.0), ("boxRight", 1.0), ("boxBottom", 1.0))])
    assert {r["id"]: r["avatar"] is not None for r in images.avatars(box).collect()} == {1: True, 2: False, 3: False}
    assert {r["id"]: r["latitude"] for r in images.locations(df).collect()} == {1: -10.5, 2: None, 3: None}
    assert images.video_frame("/nowhere.mp4") is None


def test_faces_by_parts_and_verification(spark):
    asked = []

    def detect(px):
        asked.append(px.shape[:2])
        n = 7 if px.shape[:2] == (100, 100) else 1
        return [((10.0 * i, 0.0, 10.0 * i + 8, 8.0), 0.9 - i / 100) for i in range(n)] + [((0.0, 50.0, 1.0, 51.0), 0.99)]

    found = faces.search(np.zeros((100, 100, 3)), detect, lambda: np.zeros((1600, 1600, 3)))
    assert len(asked) == 1 + 4 + 9 and 7 <= len(found) <= 20 and all(0 <= v <= 1 for b, _ in found for v in b)
    assert len(faces.search(np.zeros((50, 50, 3)), detect)) == 2
    assert faces.around((10, 10, 20, 30), 100, 100) == (0, 4, 32, 36) and faces.iou((0, 0, 1, 1), (2, 2, 3, 3)) == 0
    prompts = [(True, np.array([1.0, 0.0])), (False, np.array([0.0, 1.0]))]
    assert faces.probability(np.array([[1.0, 0.0], [0.0, 1.0], [0.7, 0.7]]), prompts) == pytest.approx([1, 0, 0.5])
    rows = [(1, 0.5, False, False, None, [1.0, 0.0]), (2, 0.5, False, False, None, [0.0, 1.0]), (3, 0.5, False, False, 7, [0.0, 1.0]), (4, 0.9, False, False, None, [0.0, 1.0]), (5, 0.5, False, False, None, None), (6, 0.1, True, False, None, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, score double, checked boolean, isArtifact boolean, lockedPersonId long, vec array<double>")
    keep, drop = faces.verify(df, prompts)
    assert {r["id"] for r in keep.collect()} == {1, 5} and {r["id"] for r in drop.collect()} == {2}
    topics = faces.topic_vectors([("A", "cat"), ("B", "dog")], ["{}", "a {}"], lambda t: np.array([3.0, 4.0]) if "cat" in t else None, lambda t: None)
    assert topics == [("A", pytest.approx([0.6, 0.8]))]
    one = spark.createDataFrame([([0.0, 0.0], 0.0)], "v array<double>, x double")
    assert one.select(vectors.share_of(F.col("v"), [1]), vectors.sigmoid(F.col("x"))).first()[:] == (0.5, 0.5)


def test_manifest_and_exports(spark, tmp_path):
    rows = spark.createDataFrame([("a", "g", 3, "x")], "path string, `group` string, size long, sha256 string")
    files.write_manifest(rows, f"{tmp_path}/m")
    assert files.read_manifest(spark, f"{tmp_path}/m", lines=True).collect() == rows.collect()
    files.export_all({"faces": rows, "persons": rows}, f"{tmp_path}/x")
    assert spark.read.parquet(f"{tmp_path}/x/faces").count() == 1 and spark.read.csv(f"{tmp_path}/x/persons", sep="\t").count() == 1
    built = []
    make = lambda: built.append(1) or rows
    for parts in (["a"], ["a"], ["b"]):
        files.cached(spark, f"{tmp_path}/c", parts, make)
    assert len(built) == 2


def test_store_rewrites_only_what_is_touched(spark, tmp_path):
    store = incremental.Store(spark, f"{tmp_path}/s", ["id"], "id long, v string", parts=8)
    assert store.read().count() == 0
    new = lambda rows: spark.createDataFrame(rows, "id long, v string")
    store.upsert(new([(i, "a") for i in range(50)]), batch=0)
    before = store._last()[1]["parts"]
    store.upsert(new([(3, "b"), (99, "c")]), batch=1)
    after = store._last()[1]["parts"]
    assert 1 <= sum(before.get(p) != after[p] for p in after) <= 2
    store.upsert(new([(3, "again")]), batch=1)
    got = {r["id"]: r["v"] for r in store.read().collect()}
    assert len(got) == 51 and got[3] == "b" and got[99] == "c"
    for i in range(4):
        store.upsert(new([(3, f"{i}")]), batch=2 + i)
    assert len(store.folder.numbered("commit-")) <= 3
    store.replace(new([(1, "z")]))
    assert [tuple(r) for r in store.read().collect()] == [(1, "z")]


def test_cursor_cache_and_times(spark, tmp_path):
    rows = spark.createDataFrame([(i,) for i in range(5)], "id long")
    cursor = incremental.Cursor(spark, f"{tmp_path}/k", "crowd")
    ids = lambda: [r["id"] for r in incremental.Cursor(spark, f"{tmp_path}/k", "crowd").rest(rows, 2).collect()]
    assert ids() == [0, 1, 2, 3, 4]
    cursor.advance(2)
    assert ids() == [3, 4]
    cursor.finish(2)
    assert ids() == [] and cursor.rest(rows, 3).count() == 5
    built = []
    cache = incremental.Cached(lambda df: built.append(1) or df.selectExpr("sum(id) s"))
    assert cache.get(rows).first()["s"] == cache.get(rows.orderBy(F.desc("id"))).first()["s"] == 10 and len(built) == 1
    assert cache.get(rows.withColumn("id", F.col("id") + 1)).first()["s"] == 15 and len(built) == 2
    stats = perf.Stats()
    for v in (3.0, 1.0, 2.0):
        stats.add("x", v)
    with stats.measure("y"):
        pass
    assert stats.summary()["x"] == {"count": 3, "total": 6.0, "mean": 2.0, "max": 3.0, "median": 2.0, "p90": 2.0} and stats.summary()["y"]["count"] == 1
