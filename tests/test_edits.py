from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from prismlake.functions import dates
from prismlake.ml import reading
from prismlake.operators import edits, people, snapshots, timeline


@pytest.fixture
def state(spark):
    face = [(1, 100, 10, 10, False, True), (2, 100, 20, None, False, False), (3, 101, 20, 20, False, False), (4, 102, 30, None, False, False), (5, 103, None, None, True, False), (6, 104, 20, None, False, False)]
    return edits.People(
        spark.createDataFrame([(10, "Ann"), (20, None), (30, "Cy")], "id long, name string"),
        spark.createDataFrame(face, "id long, mediaId long, personId long, lockedPersonId long, isArtifact boolean, checked boolean"),
        spark.createDataFrame([(4, 10), (4, 20), (1, 20)], "faceId long, personId long"),
        spark.createDataFrame([(10, 30)], "personA long, personB long"),
        spark.createDataFrame([(100, 20), (101, 10), (105, 20)], "mediaId long, personId long"),
    )


def rows(df, *columns):
    return {tuple(r) for r in (df.select(*columns) if columns else df).collect()}


def owners(state):
    return {r["id"]: (r["personId"], r["lockedPersonId"]) for r in state.face.collect()}


def test_a_name_confirms(state):
    named = edits.rename(state, 20, " Bob ")
    assert rows(named.person) == {(10, "Ann"), (20, "Bob"), (30, "Cy")} and owners(named) == owners(state) | {2: (20, 20), 6: (20, 20)}
    assert owners(edits.rename(state, 20, "  ")) == owners(state) and rows(edits.rename(state, 10, " ").person) == {(10, None), (20, None), (30, "Cy")}
    assert owners(replace(state, face=edits.unlock(state.face, 20)))[3] == (20, None) and all(o[1] is None for o in owners(replace(state, face=edits.unlock(state.face))).values())


def test_merge_locks_and_moves_what_does_not_repeat(state):
    one = edits.merge(state, 10, [10, 20], "Ann B")
    assert rows(one.person) == {(10, "Ann B"), (30, "Cy")} and owners(one) == {1: (10, 10), 2: (10, 10), 3: (10, 10), 4: (30, None), 5: (None, None), 6: (10, 10)}
    assert rows(one.rejection) == {(4, 10), (1, 10)} and rows(one.tag, "mediaId", "personId") == {(100, 10), (101, 10), (105, 10)} and rows(one.dismissal) == {(10, 30)}
    assert edits.merge(state, 10, [10], "x") is state


def test_faces_leave_and_move(state):
    out = edits.remove(state, 20, [100, 101])
    assert owners(out) == owners(state) | {2: (None, None), 3: (None, None)} and rows(out.rejection) == {(4, 10), (4, 20), (1, 20), (2, 20), (3, 20)} and rows(out.tag) == {(101, 10), (105, 20)}
    moved = edits.move(replace(state, rejection=state.rejection.union(state.face.where("id = 2").selectExpr("id", "30L"))), 20, [100, 105], 30)
    assert owners(moved) == owners(state) | {2: (30, 30)} and rows(moved.rejection) == {(4, 10), (4, 20), (1, 20), (2, 20)}
    assert rows(moved.tag, "mediaId", "personId") == {(100, 30), (105, 30), (101, 10)}
    given = edits.assign(state, 4, 10)
    assert owners(given)[4] == (10, 10) and rows(given.rejection) == {(4, 20), (4, 30), (1, 20)}
    assert owners(edits.assign(state, 5, 10))[5] == (10, 10) and not edits.assign(state, 5, 10).face.where("id = 5 and isArtifact").count()


def test_artifacts_dismissals_and_resets(state):
    bad = edits.not_faces(state, 20)
    assert {r["id"] for r in bad.face.where("isArtifact").collect()} == {2, 3, 5, 6} and rows(bad.person, "id") == {(10,), (30,)} and rows(bad.rejection) == {(4, 10)} and rows(bad.tag) == {(101, 10)}
    assert {r["id"] for r in edits.not_faces(state, 20, [104]).face.where("isArtifact").collect()} == {5, 6}
    assert rows(edits.dismiss(state, 20, 10).dismissal) == {(10, 30), (10, 20)} and rows(edits.dismiss(state, 30, 10).dismissal) == {(10, 30)}
    plain = edits.reset_edits(state)
    assert plain.rejection.count() == plain.dismissal.count() == 0 and plain.person.count() == 3 and all(o[1] is None for o in owners(plain).values())
    assert edits.reset_all(state).person.count() == 0 and {o for o in owners(edits.reset_all(state)).values()} == {(None, None)}
    kept = edits.forget(state, state.person.where("id = 30").select("id"))
    assert rows(kept.person, "id") == {(10,), (20,), (30,)} and rows(edits.forget(replace(state, tag=state.tag.limit(0)), state.person.where("id = 30").select("id")).person, "id") == {(30,)}
    assert edits.mark_checked(state.face, [2, 3]).where("checked").count() == 3


def test_a_batch_of_faces_keeps_what_was_known(spark):
    box = "boxLeft double, boxTop double, boxRight double, boxBottom double"
    old = spark.createDataFrame([(1, 7, 0.0, 0.0, 0.4, 0.4, 10, 10, False, True), (2, 7, 0.5, 0.5, 0.9, 0.9, None, None, True, False), (3, 8, 0.0, 0.0, 1.0, 1.0, 20, None, False, False)], f"id long, mediaId long, {box}, personId long, lockedPersonId long, isArtifact boolean, checked boolean")
    new = spark.createDataFrame([(11, 7, 0.0, 0.0, 0.4, 0.38, None, None, False, False), (12, 7, 0.5, 0.5, 0.9, 0.88, None, None, False, False), (13, 7, 0.9, 0.0, 1.0, 0.1, None, None, False, True)], old.schema)
    rejection = spark.createDataFrame([(1, 30), (2, 10), (3, 10)], "faceId long, personId long")
    faces, restored = edits.inherit_edits(old, rejection, new)
    assert rows(faces, "id", "personId", "lockedPersonId", "isArtifact", "checked") == {(11, 10, 10, False, True), (12, None, None, True, False), (13, None, None, False, True)} and rows(restored) == {(11, 30), (12, 10)}
    analysis = spark.createDataFrame([(7, 0), (8, 0)], "mediaId long, facesVersion int")
    f, r, a = edits.save_faces(old, rejection, analysis, spark.createDataFrame([(7,)], "mediaId long"), faces, restored, 3)
    assert rows(f, "id") == {(3,), (11,), (12,), (13,)} and rows(r) == {(3, 10), (11, 30), (12, 10)} and rows(a) == {(7, 3), (8, 0)}


def test_a_batch_of_texts(spark):
    stored = {"text": spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "mediaId long, text string, lineCount int"), "line": spark.createDataFrame([(10, 1, "a")], "id long, mediaId long, text string"), "code": spark.createDataFrame([(1, "x"), (2, "y")], "mediaId long, value string"), "analysis": spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "mediaId long, textVersion int, codesVersion int")}
    found = {"text": stored["text"].where("mediaId = 2").withColumn("mediaId", F.lit(1).cast("long")), "line": stored["line"].limit(0), "code": stored["code"].limit(0)}
    media = spark.createDataFrame([(1,)], "mediaId long")
    new = snapshots.save_text(stored, media, found, 5, 6, True)
    assert rows(new["text"]) == {(1, "b", 1), (2, "b", 1)} and new["line"].count() == 0 and rows(new["code"]) == {(2, "y")} and rows(new["analysis"]) == {(1, 5, 6), (2, 1, 1)}
    only = snapshots.save_text(stored, media, found, 5, 6, False)
    assert rows(only["text"]) == rows(stored["text"]) and rows(only["code"]) == {(2, "y")} and rows(only["analysis"]) == {(1, 1, 6), (2, 1, 1)}


def test_periods():
    now = datetime(2024, 12, 9, 5)
    assert dates.period("this month", now) == (datetime(2024, 12, 1), datetime(2025, 1, 1)) and dates.period("this year", now) == (datetime(2024, 1, 1), datetime(2025, 1, 1))
    assert dates.period("year", now, year=2020)[1] == datetime(2021, 1, 1) and dates.period("range", now, since=now) == (now, None)
    with pytest.raises(ValueError):
        dates.period("year", now)


def test_default_name_and_every(spark):
    counted = spark.createDataFrame([(1, None, 9), (2, "B", 5), (3, "C", 5), (4, "D", 1)], "id long, name string, mediaCount long")
    assert people.default_name(counted).first()["name"] == "B" and people.default_name(counted.where("id = 1")).first()["name"] is None
    assert sorted(r["id"] for r in timeline.every(counted, [F.col("id")], 2).collect()) == [1, 3] and timeline.every(counted, [F.col("id")], 9).count() == 4


def test_reading_probes_and_retries():
    boxes = [(0, 0, 9, 9), (0, 0, 8, 8), (0, 0, 7, 7), (0, 0, 1, 1), (1, 1, 2, 2)]
    asked = []

    def recognise(some, lang):
        asked.append((lang, len(some)))
        sure = {"en": {0: 0.9, 1: 0.9, 2: 0.9, 3: 0.3, 4: 0.5}, "ru": {0: 0.2, 1: 0.2, 2: 0.2, 3: 0.45, 4: 0.55}}[lang]
        return [reading.Line(b, f"{lang} text", sure[boxes.index(b)]) for b in some]

    got = {x.box: x.text[:2] for x in reading.read(boxes, ["ru", "en"], recognise)}
    # The mean is below what counts as sure, so both weak lines are read again; only one gains enough.
    assert got == {boxes[0]: "en", boxes[1]: "en", boxes[2]: "en", boxes[3]: "ru", boxes[4]: "en"} and asked == [("ru", 3), ("en", 3), ("en", 2), ("ru", 2)]
    assert reading.read(boxes, [], recognise) == [] and len(reading.read(boxes, ["en"], recognise)) == 5
    assert [x.confidence for x in reading.kept([reading.Line(boxes[0], "ab", 0.5), reading.Line(boxes[0], "a", 0.9), reading.Line(boxes[0], "abc", 0.4)])] == [0.5]


def test_joined_lines(spark):
    lines = spark.createDataFrame([(1, 5, "b", 0.2, 0.1), (2, 5, "a", 0.1, 0.5), (3, 5, "c", 0.2, 0.2), (4, 6, None, 0.0, 0.0)], "id long, mediaId long, text string, boxTop double, boxLeft double")
    assert [tuple(r) for r in reading.joined(lines).collect()] == [(5, "a\nb\nc", 3)]
