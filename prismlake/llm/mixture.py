"""Mixing sources to target shares of all tokens, by capped water-filling and seeded repetition."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismlake.tables import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how the tokenizer of that vocabulary parts a text before it merges bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A source's documents fall into so many buckets by hash, and those of the bucket on the edge into so many again.
BUCKETS = 1_024

_encoders: dict[str, object] = {}


def _encoder(name: str, ranks: bytes, pattern: str):
    if name not in _encoders:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _encoders[name] = tiktoken.Encoding("mixture", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encoders[name]


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """documents(doc_id, source, text) with the number of tokens instead of the text; null texts have none.

    vocabulary: a file of byte pairs and ranks on the driver, a few MB; pattern: how its tokenizer parts a text.
    """
    with open(vocabulary, "rb") as f:
        ranks = documents.sparkSession.sparkContext.broadcast((vocabulary, f.read(), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(*ranks.value).encode_ordinary
        for batch in batches:
            tokens = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(tokens, pa.int64())], names=["doc_id", "source", "tokens"])

    return documents.select("doc_id", "source", "text").mapInArrow(run, "doc_id bigint, source string, tokens bigint")


def plan(counts: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(source, share, max_repeat, available, planned) for every source of targets(source, weight, max_repeat).

    counts(source, tokens). total: tokens to mix; if none, all that the sources hold once. Sources of null name or without
    a positive weight, and repeats below 1, plan nothing; a source named more than once counts by its first row by weight.
    Water-filling: a source whose weight asks for more than its repeats give is clamped there, and its excess is shared by
    the others in proportion to weight, until none goes over. Sources are clamped in the order of what they can give for
    their weight, so sums along that order tell where the clamping ends. One row a source; the total is reached unless
    all are clamped.
    """
    first = Window.partitionBy("source").orderBy(F.desc("weight"), "max_repeat")
    rows = targets.where("source is not null").select("source", F.coalesce(F.greatest(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("weight"), F.greatest(F.coalesce(F.col("max_repeat").cast("int"), F.lit(0)), F.lit(0)).alias("max_repeat"))
    rows = rows.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    have = counts.groupBy("source").agg(F.sum("tokens").alias("available"))
    rows = rows.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)).cast("long"))
    rows = cut(rows.withColumn("most", (F.col("available") * F.col("max_repeat")).cast("double")), "mix-sources")
    whole = Window.partitionBy()
    wanted = F.sum(F.col("available").cast("double")).over(whole) if total is None else F.lit(float(total))
    rows = rows.select("*", (F.col("weight") / F.coalesce(F.when(F.sum("weight").over(whole) > 0, F.sum("weight").over(whole)), F.lit(1.0))).alias("share"), wanted.alias("total"))
    live = rows.where("weight > 0 and most > 0").withColumn("gives", F.col("most") / F.col("weight"))
    order = Window.orderBy("gives", "source")  # one row a source
    before, after = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    live = live.select("source", "gives", ((F.col("total") - before) / after).alias("level"), F.row_number().over(order).alias("nth"))
    free = F.min(F.when(F.col("gives") > F.col("level"), F.struct("nth", "level"))).over(Window.partitionBy())
    live = live.select("source", free["level"].alias("level"), free["nth"].alias("edge"), "nth")
    amount = F.when(F.col("nth").isNull(), F.lit(0.0)).when(F.col("edge").isNull() | (F.col("nth") < F.col("edge")), F.col("most")).otherwise(F.greatest(F.lit(0.0), F.col("weight") * F.col("level")))
    return rows.join(live, "source", "left").select("source", "share", "max_repeat", "available", amount.alias("planned"))


def mix(counts: DataFrame, planned: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, source, tokens, repeats): every document as often as its source's plan asks, at least once.

    A source is used wholly as many times as fit; for the rest its documents are taken in a seeded random order while
    they fit. The order is cut by hash into buckets: whole buckets go by their sums, only the one on the edge is cut again,
    and only the edge of that is ordered row by row: a millionth of a source. doc_id must be unique; documents without
    tokens go with the whole repeats.
    """
    wanted = planned.where("available > 0 and planned > 0").select("source", (F.floor(F.col("planned") / F.col("available"))).cast("int").alias("times"), (F.col("planned") % F.col("available")).alias("room"))
    rows = counts.select("doc_id", "source", "tokens").join(wanted, "source").withColumn("at", F.xxhash64(F.lit(seed), "doc_id"))
    done = []
    for shift in (0, 10):
        rows = rows.withColumn("bucket", F.pmod(F.shiftright("at", shift), F.lit(BUCKETS)))
        sums = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("held"))
        before = F.sum("held").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        sums = sums.select("source", "bucket", "held", F.coalesce(before, F.lit(0)).alias("before"))
        rows = rows.join(sums, ["source", "bucket"]).withColumn("room", F.col("room") - F.col("before"))
        edge = (F.col("room") > 0) & (F.col("room") < F.col("held"))
        done.append(rows.where(~edge).select("doc_id", "source", "tokens", (F.col("times") + (F.col("room") >= F.col("held")).cast("int")).alias("repeats")))
        rows = rows.where(edge).select("doc_id", "source", "tokens", "times", "room", "at")
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("at", "doc_id"))
    done.append(rows.select("doc_id", "source", "tokens", (F.col("times") + (upto - F.col("tokens") / 2 <= F.col("room")).cast("int")).alias("repeats")))
    return done[0].unionByName(done[1]).unionByName(done[2]).where("repeats > 0")


def shares(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """Target and actual share of each source, and how often its documents are used."""
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used"), F.count("*").alias("documents"), F.max("repeats").alias("most"))
    rows = planned.join(used, "source", "left").na.fill(0, ["used", "documents", "most"])
    return rows.select("source", "share", "max_repeat", "available", "documents", "used", "most", (F.col("used") / F.sum("used").over(Window.partitionBy())).alias("actual"))
