import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.functions import text
from prismlake.functions.vectors import cosine, normalise, softmax
from prismlake.operators import cleanup, places, search, snapshots, timeline
from prismlake.operators.components import components
from prismlake.sources import files
from prismlake.streaming import incremental, pending

PEOPLE = {1: "Маша", 2: "Иван Петров", 3: "Мария"}
PLACES = [("Москва", {1}), ("Санкт-Петербург", {2}), ("Турция", {3, 4}), ("Сочи", {5})]


def test_parser():
    q = search.parse("с Машей на море", PEOPLE)
    assert q.people == (1,) and q.text == "на море"
    q = search.parse("Маша с Иваном летом 2023 и 2021", PEOPLE, this_year=2026)
    assert q.people == (1, 2) and q.year == 2023 and q.months == {6, 7, 8} and q.text == ""
    assert search.parse("машина", PEOPLE).people == ()
    assert search.parse("Маша в мае", PEOPLE, ignored={"маша"}).text == "Маша"
    assert search.parse("1985 год", this_year=2026).year is None and search.parse("2028", this_year=2026).year is None
    assert search.parse("в Турции", places=PLACES).cities == {3, 4} and search.parse("в Сочи", places=PLACES).text == ""
    assert search.parse("") == search.Query("")


def test_full_text_folds_ascii_only(spark):
    df = spark.createDataFrame([(1, "Hello don't WIFI"), (2, "Пароль wifi_net"), (3, None), (4, "naïve")], "mediaId long, text string")
    hits = lambda q: {r[0] for r in search.full_text(df, q).collect()}
    assert hits("wif hel") == {1} and hits("WIFI") == {1, 2} and hits("пар") == set() and hits("Пар") == {2}
    assert hits("don't") == set() and hits("a") == set() and hits("") == set() and hits("nai") == set() and hits("naï") == {4}


def test_fusion(spark):
    exact = spark.createDataFrame([(5,), (3,), (3,)], "id long")
    near = spark.createDataFrame([(3, 0.9), (7, 0.5), (8, 0.7)], "id long, score double")
    order = lambda df: [r["id"] for r in df.orderBy("rank").collect()]
    assert order(search.fuse(exact, near)) == [3, 5, 8, 7] and order(search.fuse(exact, None)) == [3, 5]
    assert order(search.fuse(exact, near, spark.createDataFrame([(5,), (7,)], "id long"))) == [5, 7]


def test_visibility_of_unknown_scores(spark):
    media = spark.sql("select * from values (1L, cast('2020-01-01' as timestamp_ntz), false, false, 1L, 'a', 'u1', 'p'), (2L, cast('2020-01-02' as timestamp_ntz), false, true, 1L, 'b', 'u2', 'o'), (3L, null, true, false, 1L, null, 'u3', null), (4L, cast('2020-01-02' as timestamp_ntz), false, false, null, null, 'u4', null) as m(id, dateTaken, isHiddenByUser, isFavorite, bucketId, bucketName, uri, relativePath)")
    analysis = spark.createDataFrame([(1, 0.9), (2, None)], "mediaId long, sensitiveScore float")
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(timeline.timeline(media, analysis)) == [4, 2] and ids(timeline.timeline(media, analysis, show=True)) == [4, 2, 1]
    assert ids(timeline.hidden(media, analysis)) == [1, 3] and ids(timeline.favourites(media, analysis)) == [2]
    # A sensitive favourite is still a favourite; its album and its person count it too.
    assert ids(timeline.favourites(media.withColumn("isFavorite", F.lit(True)), analysis)) == [4, 2, 1]
    album = timeline.albums(media).collect()
    assert [(r["bucketId"], r["name"], r["items"], r["cover"], r["relativePath"]) for r in album] == [(None, None, 1, None, None), (1, "b", 2, "u2", "p")]
    assert ids(timeline.scored(media, analysis).where(timeline.shown(0.7)).orderBy("id")) == [2, 4] and ids(timeline.scored(media, analysis).where(timeline.shown(0.0)).orderBy("id")) == []
    some, rest = timeline.parted(media, F.col("bucketId") == 1)
    assert ids(some.orderBy("id")) == [1, 2, 3] and ids(rest) == [4]
    page = timeline.keyset_page(media, 1)
    assert ids(page) == [4] and ids(timeline.keyset_page(media, 5, datetime(2020, 1, 2), 4)) == [2, 1]
    assert [r["pos"] for r in timeline.between_positions(media, [F.col("id")], 2, 1).collect()] == [1, 2]


def test_smart_album_cover_falls_back(spark):
    media = spark.sql("select id, uri from values (1L, 'a'), (2L, 'b'), (3L, 'c') as m(id, uri)").withColumn("isHiddenByUser", F.col("id") == 1)
    album = spark.createDataFrame([(10, "x", 1, 0), (11, "y", 3, 1), (12, "z", 1, 2)], "id long, name string, coverMediaId long, position int")
    member = spark.createDataFrame([(10, 1, 0), (10, 2, 1), (11, 2, 0), (11, 3, 1), (12, 1, 0)], "albumId long, mediaId long, position int")
    assert [(r["albumId"], r["cover"], r["items"]) for r in timeline.smart_albums(album, member, media).collect()] == [(10, "b", 1), (11, "c", 2)]
    items = timeline.smart_album_items(11, member, media.withColumn("dateTaken", F.lit(None).cast("timestamp")), spark.createDataFrame([(3, 0.9)], "mediaId long, sensitiveScore float"))
    assert [r["id"] for r in items.collect()] == [2]


def test_paths(spark):
    df = spark.createDataFrame([("DCIM/Camera/", 0), ("Movies/A/B/", 1), ("Movies/A/", 0), ("sync/", 1), ("DCIM/", 0)], "path string, kind int")
    got = df.select(text.renamed(F.col("path"), F.lit("Море")).alias("p"), text.may_move(F.col("path"), F.col("kind")).alias("ok")).collect()
    assert [tuple(r) for r in got] == [("DCIM/Море/", True), ("Movies/A/Море/", True), ("Movies/Море/", False), ("Pictures/Море/", False), ("Pictures/Море/", True)]
    names = spark.createDataFrame([("  a \t b ",), ("",), ("a/b",), ("..",), ("...",), ("x" * 101,), (None,)], "n string")
    assert [r[0] for r in names.select(text.album_name(F.col("n"))).collect()] == ["a b", None, None, None, "...", None, None]
    plan = {tuple(r) for r in snapshots.move_plan(df.select(F.col("path").alias("relativePath"), F.col("kind").alias("mediaType"), F.lit(1).alias("id")), F.lit(" Море ")).collect()}
    assert (1, "Movies/A/", "Movies/Море/", True) in plan and (1, "sync/", "Pictures/Море/", False) in plan
    assert {r["allowed"] for r in snapshots.move_to(df.select(F.col("path").alias("relativePath"), F.col("kind").alias("mediaType"), F.lit(1).alias("id")), "Movies/B/").collect()} == {True, False}
    where = spark.createDataFrame([("+55.7522+037.6156/",), ("+00.0000+000.0000/",), ("+95+010/",), ("x",), (None,)], "t string")
    assert [r[0] and tuple(r[0]) for r in where.select(text.iso6709(F.col("t"))).collect()] == [(55.7522, 37.6156), None, None, None, None]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0, 3.0]), ([0.0, 0.0], [0.0, 0.0, 0.0])], "v array<float>, s array<double>")
    got = df.select(normalise(F.col("v")), softmax(F.col("s")), cosine(F.col("v"), F.col("v"))).collect()
    assert got[0][0] == pytest.approx([0.6, 0.8]) and got[1][0] == [0, 0] and sum(got[0][1]) == pytest.approx(1) and got[0][2] == pytest.approx(1) and got[1][2] is None
    assert files.floats(files.to_bytes([1.5, -2.0])) == [1.5, -2.0]


def test_components(spark):
    rng = np.random.default_rng(0)
    chain = [(i, i + 1) for i in range(200)]
    rng.shuffle(chain)
    star = [(1000, 1000 + i) for i in range(1, 300)]
    edges = [(int(a), int(b)) for a, b in chain] + star + star[:5] + [(5000, 5000), (None, 3), (7000, 6999)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame([(*e, "x") for e in edges], "a long, b long, node string")).collect()}
    assert found == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1300)}, 6999: 6999, 7000: 6999}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_copies_and_groups(spark):
    h = 0x0F0F_1234_5678_9ABC
    rows = [(1, h, None, 10, 10), (2, h ^ 7, [1.0, 0.0], 20, 20), (3, h ^ 8, [1.0, 0.1], 20, 20), (4, h ^ 15, [0.0, 1.0], 20, 20), (5, h, None, 10, 30), (6, 1, None, 1, 1), (7, 1, None, 1, 1), (8, h, None, None, None)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "id long, hash long, vec array<float>, width int, height int, mediaType int, durationMs long")
    assert {tuple(r) for r in cleanup.copy_pairs(cleanup.copy_classes(df)).collect()} == {(1, 2), (1, 3), (1, 8), (2, 8), (3, 8), (5, 8)}
    media = spark.sql("select id, false as isFavorite, 10L * id as size, 1 as width, 1 as height, cast('2020-01-01' as timestamp_ntz) as dateTaken from range(1, 9)")
    assert [tuple(r) for r in cleanup.copy_groups(df.where("id < 4"), media).collect()] == [(1, 3, 3, 30)]
    # Equal rows are one class but all of them count; a rotated copy has the same shape; nulls equal nulls.
    more = df.unionByName(df.where("id = 3").withColumn("id", F.lit(13).cast("long"))).unionByName(df.where("id = 3").withColumns({"id": F.lit(14).cast("long"), "width": F.lit(30), "height": F.lit(20)}))
    wide = df.where("id = 3").withColumns({"id": F.lit(15).cast("long"), "width": F.lit(20), "height": F.lit(30)})
    links = {r["id"]: r["links"] for r in cleanup.copy_links(more.unionByName(wide).where("id not in (1, 5, 8)")).collect()}
    assert links == {3: 1, 13: 1, 14: 1, 15: 1}
    assert cleanup.copy_links(df.limit(0)).count() == 0


def test_near_hashes_are_exact_at_any_number_of_bands(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 60)
    code = sorted({int(b) ^ sum(1 << int(i) for i in rng.choice(62, rng.integers(0, 5), replace=False)) for b in base for _ in range(4)})
    want = {(a, b) for i, a in enumerate(code) for b in code[i + 1 :] if bin(a ^ b).count("1") <= 3}
    for n in (1, 1 << 30, 1 << 45):
        got = [tuple(r) for r in cleanup.near_hashes(spark.createDataFrame([(c,) for c in code], "hash long"), 3, n).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_series(spark):
    base = datetime(2020, 1, 1, 23, 59, 0)
    at = [0, 30, 60, 300, 330, 86400]
    v = [[1.0, 0.0], [1.0, 0.01], [0.0, 1.0], [1.0, 0.0], [1.0, 0.0], [1.0, 0.0]]
    rows = [(i, 1, datetime.fromtimestamp(base.timestamp() + s), x) for i, (s, x) in enumerate(zip(at, v, strict=True))] + [(50, 1, base, None), (51, None, base, [1.0, 0.0]), (52, 1, None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, bucketId long, dateTaken timestamp_ntz, vec array<float>")
    runs = {r["id"]: r["run"] for r in cleanup.gap_series(df).collect()}
    # All media are one sequence, whatever their bucket; rows without a date are no part of it.
    assert {i: runs[i] for i in range(6)} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 2} and runs[51] == 0 and 52 not in runs
    # One without a vector is passed over entirely, and so doesn't bridge a gap; one like the last but not the first leaves.
    assert {tuple(r) for r in cleanup.leader_series(df.where("id <> 51"), 2).collect()} == {(0, 0), (1, 0), (3, 3), (4, 3)}
    turn = [(i, base, [float(np.cos(i / 4)), float(np.sin(i / 4))]) for i in range(7)]
    drift = {r["id"]: r["series"] for r in cleanup.leader_series(spark.createDataFrame(turn, "id long, dateTaken timestamp_ntz, vec array<float>"), 2, least=0.8).collect()}
    assert drift == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}
    assert cleanup.leader_series(df.limit(0), 2).count() == 0


def test_statistics(spark):
    rng = np.random.default_rng(1)
    v, o, p = rng.random(97).round(1), rng.random(97), rng.random(97) < 0.4
    df = spark.createDataFrame([(i, float(a), float(b), bool(c)) for i, (a, b, c) in enumerate(zip(v, o, p, strict=True))] + [(900, None, 1.0, True), (901, float("nan"), 1.0, True)], "id long, v double, o double, p boolean")
    assert {r["p"]: r["value"] for r in cleanup.percentiles(df, "v", [1, 50, 99]).collect()} == {q: sorted(v)[96 * q // 100] for q in (1, 50, 99)}
    got = {r["decile"]: r["items"] for r in cleanup.deciles(df, "v", "o").collect()}
    assert got == {d: 97 * (d + 1) // 10 - 97 * d // 10 for d in range(10)}
    want = np.mean([(a > b) + (a == b) / 2 for a in v[p] for b in v[~p]])
    assert cleanup.auc(df, "v", "p").first()["auc"] == pytest.approx(want)
    assert cleanup.auc(df.limit(0), "v", "p").first()["auc"] is None
    assert sum(r["items"] for r in cleanup.histogram(df, "v", [0.3, 0.6]).collect()) == 97


def test_places(spark):
    city = spark.createDataFrame([(1, "A", "XX", 0, 10.0, 10.0), (2, "B", "XX", 50_000_000, 10.0, 10.2), (3, "C", "YY", None, 60.0, 179.9)], "id long, name string, countryCode string, population int, lat double, lon double")
    media = spark.createDataFrame([(1, 10.0, 10.05), (2, 40.0, 0.0), (3, None, 1.0), (4, 60.0, 179.8), (5, float("nan"), 0.0)], "mediaId long, latitude double, longitude double")
    found = places.city_of(media, city)
    assert {tuple(r) for r in found.collect()} == {(1, 2), (4, 3)}
    assert [(r["countryCode"], r["items"]) for r in places.countries(places.counts(found, city)).collect()] == [("XX", 1), ("YY", 1)]


def test_snapshots(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "id long, v string")
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(snapshots.upsert(old, new, ["id"])) == {(1, "a"), (2, "c"), (3, "d")}
    assert rows(snapshots.insert_missing(old, new, ["id"])) == {(1, "a"), (2, "b"), (3, "d")}
    assert rows(snapshots.sync(new.select("id").distinct(), old.withColumn("f", F.lit(True)).select("id", "f"), "id", {"f": False})) == {(2, True), (3, False)}
    assert rows(snapshots.set_where(old, F.col("v") == "a", v="z")) == {(1, "z"), (2, "b")}
    assert rows(snapshots.cascade(old.withColumnRenamed("id", "pid").withColumn("id", F.lit(1)), new, "pid", set_null=True).select("pid", "v")) == {(None, "a"), (2, "b")}
    face = spark.createDataFrame([(1, 10, None), (2, 20, 20), (3, None, None)], "id long, personId long, lockedPersonId long")
    assert rows(snapshots.merge_persons(face, 10, 20)) == {(1, 20, 20), (2, 20, 20), (3, None, None)}
    stamped = spark.createDataFrame([(2, "z", 1), (2, "y", 5), (2, "x", 3)], "id long, v string, at long")
    assert rows(snapshots.upsert(old.withColumn("at", F.lit(0).cast("long")), stamped, ["id"], "at")) == {(1, "a", 0), (2, "y", 5)}
    left, rejected = snapshots.detach(face, spark.createDataFrame([], "faceId long, personId long"), [2, 3], 20)
    assert rows(left) == {(1, 10, None), (2, None, None), (3, None, None)} and rows(rejected) == {(2, 20)}


def test_queues(spark):
    media = spark.sql("select id, 0 as mediaType, cast('2020-01-01' as timestamp_ntz) as dateModified from range(1, 6)")
    done = spark.sql("select id as mediaId, cast(if(id = 2, '2019-01-01', '2020-01-01') as timestamp_ntz) as sourceModified, if(id = 3, 1, 2) as pipelineVersion, id = 5 as isUnreadable, if(id >= 4, null, array(1f)) as embedding, 0.5f as sensitiveScore, 1 as qualityVersion from range(2, 6)")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(pending.analysis(media, done, 2)) == [1, 2, 3, 4] and ids(pending.analysis(media, done, 2, embedder=False)) == [1, 2, 3]
    assert ids(pending.stage(media, done, "qualityVersion", 2)) == [2, 3, 4]


def test_incremental_index(spark, tmp_path):
    source, store = str(tmp_path / "in"), incremental.Store(spark, str(tmp_path / "store"), ["id"], "id long, n int")
    analyse = lambda df: df.groupBy("id").agg(F.max("n").cast("int").alias("n"))
    for part in ([(1, 1), (2, 1)], [(2, 5), (3, 1)]):
        spark.createDataFrame(part, "id long, n int").write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long, n int").parquet(source)
        incremental.index(stream, store, analyse, str(tmp_path / "check")).awaitTermination()
    assert {tuple(r) for r in store.read().collect()} == {(1, 1), (2, 5), (3, 1)}


def test_bursts_by_event_time(spark, tmp_path):
    spark.sql("select 1L as bucketId, cast('2020-01-01 00:00:00' as timestamp_ntz) + make_interval(0,0,0,0,0,0,s) as dateTaken from values (0), (30), (300), (3000) as t(s)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("bucketId long, dateTaken timestamp_ntz").parquet(str(tmp_path / "in"))
    q = incremental.bursts(stream).writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted(r["items"] for r in spark.table("bursts").collect())[-1] == 2


def test_sources(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("1\t10.5\t20.5\tA\tXX\t100\n2\t1\t2\tB\tYY\tmany\nshort\tline\n")
    (tmp_path / "n.tsv").write_text("XX\told\nXX\tnew\nYY\n")
    assert {tuple(r) for r in files.read_cities(spark, str(tmp_path / "c.tsv")).select("id", "population").collect()} == {(1, 100), (2, 0)}
    assert {tuple(r) for r in files.read_countries(spark, str(tmp_path / "n.tsv")).collect()} == {("XX", "new")}
    (tmp_path / "m.json").write_text(json.dumps({"files": [{"path": "a", "group": "g", "size": 3, "sha256": "x"}]}))
    assert files.read_manifest(spark, str(tmp_path / "m.json")).first()["size"] == 3
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin" / "f").write_bytes(b"abc")
    assert files.build_manifest(spark, str(tmp_path / "bin")).first()["sha256"].startswith("ba7816bf")
    (tmp_path / "merges.txt").write_text("#version: 1\n\na b\nc d\n")
    assert files.read_merges(str(tmp_path / "merges.txt")) == {("a", "b"): 0, ("c", "d"): 1}
    names = spark.createDataFrame([(1, "ru", "Б", False, True, False, False, 0), (1, "ru", "А", False, False, False, False, 1), (1, "ru", "В", True, False, True, False, 2)], "geonameId long, lang string, name string, preferred boolean, short boolean, colloquial boolean, historic boolean, seq int")
    built = files.build_cities(files.read_cities(spark, str(tmp_path / "c.tsv")), names)
    assert {tuple(r) for r in built.select("id", "lat", "name").collect()} == {(1, "10.5000", "А"), (2, "1.0000", "B")}


def test_components_that_do_not_settle_are_an_error(spark):
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long").repartition(8), max_rounds=1).count()
