"""Copies and series among media, what a clean-up would free, and statistics of measurements."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismlake.conf import CONF
from prismlake.functions.vectors import cosine
from prismlake.operators.cells import matrix, usable
from prismlake.operators.components import components
from prismlake.tables import cut, numbered

#: What decides whether two media are copies; rows equal in all of it form a class.
COMPARED = ["hash", "vec", "width", "height", "mediaType", "durationMs"]


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def same_shape(a: str, b: str, most: float = 0.03, most_ms: int = 1000) -> Column:
    """Ratios of the long to the short side within `most` of a's, so a rotated copy matches; unknown sizes match too.

    Both must be of one type, and videos need nearly equal durations.
    """
    known = (F.col(f"{a}.width") > 0) & (F.col(f"{a}.height") > 0) & (F.col(f"{b}.width") > 0) & (F.col(f"{b}.height") > 0)
    ratio = lambda s: F.greatest(f"{s}.width", f"{s}.height") / F.least(f"{s}.width", f"{s}.height")
    shape = F.when(known, F.abs(ratio(a) - ratio(b)) / ratio(a) <= most).otherwise(True)
    timing = (F.col(f"{a}.mediaType") != 1) | (F.abs(F.col(f"{a}.durationMs") - F.col(f"{b}.durationMs")) <= most_ms)
    return (F.col(f"{a}.mediaType") == F.col(f"{b}.mediaType")) & F.coalesce(shape, F.lit(True)) & F.coalesce(timing, F.lit(True))


def near_hashes(codes: DataFrame, most_bits: int, n: int) -> DataFrame:
    """(ha, hb), ha < hb: the distinct hashes of codes(hash) that differ in at most most_bits bits; exact.

    The 64 bits are cut into most_bits + fixed bands; two hashes within the budget agree on at least `fixed` of them and
    meet in the buckets of those. n, the number of hashes, decides how many bands are fixed, so that a bucket of random
    hashes keeps to about a hundred. A pair is reported by the first bucket it shares only.
    """
    fixed = 1
    while fixed < 4 and n / 2 ** (64 * fixed / (most_bits + fixed)) > 128:
        fixed += 1
    edges = [round(64 * i / (most_bits + fixed)) for i in range(most_bits + fixed + 1)]
    band = lambda h, i: F.shiftrightunsigned(h, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))
    chosen = list(combinations(range(most_bits + fixed), fixed))
    keys = F.array(*[F.struct(F.lit(c).alias("c"), F.array(*[band("hash", i) for i in picked]).alias("key")) for c, picked in enumerate(chosen)])
    rows = codes.select("hash", F.explode(keys).alias("bucket"))
    pairs = rows.select(F.col("hash").alias("ha"), "bucket").join(rows.select(F.col("hash").alias("hb"), "bucket"), "bucket").where((F.col("ha") < F.col("hb")) & (hamming(F.col("ha"), F.col("hb")) <= most_bits))
    agree = [(band("ha", i) == band("hb", i)) for i in range(most_bits + fixed)]
    first = F.coalesce(*[F.when(F.array_min(F.array(*[agree[i] for i in picked])), F.lit(c)) for c, picked in enumerate(chosen)])
    return pairs.where(F.col("bucket.c") == first).select("ha", "hb")


def copy_classes(rows: DataFrame, bits: tuple[int, int] = CONF.copy_bit_range) -> DataFrame:
    """(rep, members, hash, vec, width, height, mediaType, durationMs): rows(id, ...) with enough detail, equal ones once.

    rep is the smallest id of a class. Equal rows are copies of each other, so a class of any size is one row from here on.
    """
    return rows.where(F.bit_count("hash").between(*bits)).groupBy(*COMPARED).agg(F.min("id").alias("rep"), F.count("*").alias("members"))


def copy_pairs(classes: DataFrame, most_bits: int = CONF.copy_max_bits, least: float = CONF.copy_min_cosine) -> DataFrame:
    """(a, b), a < b: pairs of classes (their representatives) that are copies; classes as by copy_classes.

    Hashes differ in at most most_bits bits, shapes are nearly the same, cosine >= least unless a vector is missing (null)
    or of another length.
    """
    rows = cut(classes.withColumn("id", F.col("rep")).select("id", *COMPARED), "copies")
    codes = cut(rows.groupBy("hash").agg(F.count("*").alias("n")), "copies-codes")
    near = near_hashes(codes, most_bits, codes.count())
    near = near.unionByName(codes.where("n > 1").select(F.col("hash").alias("ha"), F.col("hash").alias("hb")))
    a, b = (rows.select(F.col("hash").alias(f"h{s}"), F.struct("id", *[c for c in COMPARED if c != "hash"]).alias(s)) for s in "ab")
    pairs = near.join(a, "ha").join(b, "hb").where("ha <> hb or a.id < b.id")
    low_first = F.when(F.col("a.id") < F.col("b.id"), F.struct(F.col("a"), F.col("b"))).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = pairs.select(low_first.alias("p")).select("p.a", "p.b").where(same_shape("a", "b"))
    like = F.col("a.vec").isNull() | F.col("b.vec").isNull() | (F.size("a.vec") != F.size("b.vec")) | (cosine(F.col("a.vec"), F.col("b.vec")) >= least)
    return pairs.where(like).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def copy_links(rows: DataFrame) -> DataFrame:
    """(id, links): every row that has a copy, with the number of its copies among rows(id, ...).

    Copies of a row are the others of its class and all members of the classes paired with it.
    """
    classes = cut(copy_classes(rows), "copies-classes")
    pairs = cut(copy_pairs(classes), "copies-pairs")
    size = classes.select("rep", "members")
    both = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    far = both.join(size.select(F.col("rep").alias("other"), "members"), "other").groupBy("rep").agg(F.sum("members").alias("far"))
    links = classes.join(far, "rep", "left").select("rep", *COMPARED, (F.col("members") - 1 + F.coalesce("far", F.lit(0))).alias("links")).where("links > 0")
    return _members(rows, links).select("id", "links")


def _members(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The ids of rows with the further columns of their class; classes are salted, so that a large one is spread."""
    salt = F.pmod(F.xxhash64("id"), F.lit(16)).cast("int")
    rows = rows.select("id", salt.alias("_salt"), *COMPARED).alias("r")
    held = classes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15)))).alias("k")
    same = F.col("r._salt") == F.col("k._salt")
    for c in COMPARED:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}"))
    return rows.join(held, same).select("r.id", *[f"k.{c}" for c in classes.columns if c not in COMPARED])


def copy_groups(rows: DataFrame, media: DataFrame) -> DataFrame:
    """(group, items, keep, bytes): groups of copies among rows(id, hash, ...), most bytes to gain first.

    Kept is the favourite, then the one with most pixels, the largest, the earliest, the smallest id.
    """
    classes = cut(copy_classes(rows), "copies-classes")
    joined = components(copy_pairs(classes)).select(F.col("node").alias("rep"), "component")
    named = classes.join(joined, "rep", "left").withColumn("group", F.coalesce("component", "rep")).where("members > 1 or component is not null")
    members = _members(rows, named).select("id", "group")
    pixels = F.coalesce(F.col("width").cast("long") * F.col("height").cast("long"), F.lit(0))
    rows = members.join(media, "id")
    best = F.struct(F.coalesce("isFavorite", F.lit(False)).alias("f"), pixels.alias("p"), F.coalesce("size", F.lit(0)).alias("s"), (-F.coalesce(F.unix_micros(F.col("dateTaken").cast("timestamp")), F.lit(0))).alias("d"), (-F.col("id")).alias("i"))
    found = rows.groupBy("group").agg(F.count("*").alias("items"), (-F.max(best)["i"]).alias("keep"), F.sum("size").alias("total"), F.max_by(F.coalesce("size", F.lit(0)), best).alias("kept"))
    return found.where("items > 1").select("group", "items", "keep", (F.col("total") - F.col("kept")).alias("bytes")).orderBy(F.desc("bytes"), "group")


def runs(rows: DataFrame, breaks: Column | None = None, gap_ms: int = CONF.series_gap_ms) -> DataFrame:
    """rows(id, dateTaken, ...) with `run`, counted from 0 along (dateTaken, id): a new one after each gap above gap_ms.

    breaks: a further reason to start a new run; in it `before` stands for a struct of the row before. Rows without a
    date are left out. Rows are numbered by range partitions, which split at any id, so no day or second is too full.
    """
    at = numbered(rows.where("dateTaken is not null"), "dateTaken", "id", position="_pos")
    names = [c for c in at.columns if c != "_pos"]
    own = F.struct(*names)
    # The row before comes by a join on the position; parts of the order are then summed up part by part.
    before = at.select((F.col("_pos") + 1).alias("_pos"), own.alias("before"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    new = us("dateTaken") - us("before.dateTaken") > gap_ms * 1000
    new = F.coalesce(new | breaks if breaks is not None else new, F.lit(False)).cast("int")
    flagged = cut(at.join(before, "_pos", "left").select(*names, "_pos", new.alias("_new")).withColumn("_part", F.floor(F.col("_pos") / 65_536)), "runs")
    sums = flagged.groupBy("_part").agg(F.sum("_new").alias("_held"))
    offset = sums.select("_part", F.coalesce(F.sum("_held").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    run = F.sum("_new").over(Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0))
    return flagged.withColumn("run", run).join(F.broadcast(offset), "_part").select(*names, (F.col("_offset") + F.col("run")).alias("run"))


def gap_series(rows: DataFrame, gap_ms: int = CONF.series_gap_ms) -> DataFrame:
    """(id, dateTaken, run): all rows in one order of time, cut where more than gap_ms lie between two; run counts from 0."""
    return runs(rows.select("id", "dateTaken"), None, gap_ms)


def leader_series(rows: DataFrame, dim: int, gap_ms: int = CONF.series_gap_ms, least: float = CONF.series_min_cosine) -> DataFrame:
    """(id, series): bursts among rows(id, dateTaken, vec), series being the first one's id.

    A row joins if it follows within gap_ms and is like both the one before and the first; else it starts a new series.
    Rows without a usable vector or without a date are passed over entirely; series of one are dropped. Gaps and unlike
    neighbours cut the work first; a run that remains is walked in order, row by row, and never held as a whole.
    """
    rows = rows.where(usable(F.col("vec"), dim)).select("id", "dateTaken", "vec")
    unlike = ~(cosine(F.col("vec"), F.col("before.vec")) >= least)
    at = cut(runs(rows, unlike, gap_ms), "series")
    several = at.groupBy("run").agg(F.count("*").alias("n")).where("n > 1").select("run")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, first, leader = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, run_of = batch.column("id").to_numpy(), batch.column("run").to_numpy()
            x = matrix(batch.column("vec"), dim).astype(np.float64)
            x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            series = np.empty(len(ids), np.int64)
            for i in range(len(ids)):
                if run_of[i] != run or not x[i] @ leader >= least:
                    run, first, leader = run_of[i], ids[i], x[i].copy()
                series[i] = first
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(series)], names=["id", "series"])

    walked = at.join(several, "run", "left_semi").repartition("run").sortWithinPartitions("run", "dateTaken", "id").select("id", "run", "vec").mapInArrow(walk, "id bigint, series bigint")
    walked = cut(walked, "series-walked")
    return walked.join(walked.groupBy("series").agg(F.count("*").alias("n")).where("n > 1").select("series"), "series", "left_semi").select("id", "series")


def series_best(series: DataFrame, media: DataFrame, analysis: DataFrame) -> DataFrame:
    """(series, items, keep): the favourite, then the sharpest (none counts 0), most pixels, smallest id."""
    pixels = F.coalesce(F.col("width").cast("long") * F.col("height").cast("long"), F.lit(0))
    sharp = F.when(F.col("sharpness").isNotNull() & ~F.isnan("sharpness"), F.col("sharpness")).otherwise(F.lit(0.0))
    rows = series.join(media.select("id", "isFavorite", pixels.alias("pixels")), "id").join(analysis.select(F.col("mediaId").alias("id"), "sharpness"), "id", "left")
    best = F.struct(F.coalesce("isFavorite", F.lit(False)).alias("f"), sharp.alias("s"), "pixels", (-F.col("id")).alias("i"))
    return rows.groupBy("series").agg(F.count("*").alias("items"), (-F.max(best)["i"]).alias("keep"))


def total_of(parts: list[DataFrame]) -> DataFrame:
    """(items, bytes) of media(id, size) in any of the lists, each counted once."""
    rows = parts[0].select("id", "size")
    for p in parts[1:]:
        rows = rows.unionByName(p.select("id", "size"))
    return rows.dropDuplicates(["id"]).agg(F.count("*").alias("items"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def _ranked(rows: DataFrame, value: str) -> DataFrame:
    """rows with a value, their position (from 0) in the order of value and id, and their number."""
    return numbered(rows.where(F.col(value).isNotNull() & ~F.isnan(value)), F.col(value), F.col("id"), total="n")


def percentiles(rows: DataFrame, value: str, which: list[int]) -> DataFrame:
    """(p, value): the value at index (n - 1) * p / 100, rounded down, of rows(id, value) in order."""
    rows = _ranked(rows.select("id", F.col(value).cast("double").alias("v")), "v")
    asked = F.explode(F.array(*[F.lit(p) for p in which]))
    return rows.select("v", "rank", "n", asked.alias("p")).where(F.col("rank") == F.floor((F.col("n") - 1) * F.col("p") / 100)).select("p", F.col("v").alias("value"))


def deciles(rows: DataFrame, by: str, other: str) -> DataFrame:
    """(decile, items, mean): mean of `other` over the tenths of rows in the order of `by`; bounds at n * d / 10."""
    rows = _ranked(rows.select("id", F.col(by).cast("double").alias("v"), F.col(other).cast("double").alias("o")), "v")
    d = F.floor((F.col("rank") * 10 + 9) / F.col("n")).cast("int")
    d = F.when(F.floor(F.col("n") * d / 10) > F.col("rank"), d - 1).otherwise(d)
    return rows.select(F.least(d, F.lit(9)).alias("decile"), "o").groupBy("decile").agg(F.count("*").alias("items"), F.avg("o").alias("mean"))


def histogram(rows: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """(band, items): band i holds values from bounds[i-1] up to below bounds[i]; one pass, no shuffle of rows."""
    band = F.lit(0)
    for b in bounds:
        band = band + (F.col(value) >= b).cast("int")
    return rows.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(band.alias("band")).agg(F.count("*").alias("items"))


def auc(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """(auc): area under the curve by the rank sum of rows(id, score, positive); ties in score count half.

    Null and NaN scores are left out; without a positive or without a negative row it is null.
    """
    ranked = _ranked(rows.select("id", F.col(score).cast("double").alias("s"), F.col(positive).cast("long").alias("p")), "s")
    by = ranked.groupBy("s").agg(F.sum("p").alias("pos"), (F.min("rank") + (F.count("*") - 1) / 2 + 1).alias("middle"), F.count("*").alias("all"))
    total = by.agg(F.sum(F.col("pos") * F.col("middle")).alias("r"), F.sum("pos").cast("double").alias("p"), F.sum(F.col("all") - F.col("pos")).cast("double").alias("n"))
    return total.select(F.when((F.col("p") > 0) & (F.col("n") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("n"))).alias("auc"))
