"""Incremental indexing as a stream: each micro-batch is analysed and upserted into a stored table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.operators.snapshots import upsert


class Folder:
    """Small files in a folder that all executors share, replaced as a whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def read(self, name: str) -> dict | None:
        where = self.hadoop.Path(f"{self.path}/{name}")
        if not self.fs.exists(where):
            return None
        stream = self.fs.open(where)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, name: str, value: dict) -> None:
        """A new file first, then a rename over the old one, so a lost writer leaves the old or the new state."""
        fresh = self.hadoop.Path(f"{self.path}/.{name}-{uuid.uuid4().hex}")
        out = self.fs.create(fresh, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        where = self.hadoop.Path(f"{self.path}/{name}")
        if self.fs.exists(where):
            self.fs.delete(where, False)
        self.fs.rename(fresh, where)

    def remove(self, name: str) -> None:
        self.fs.delete(self.hadoop.Path(f"{self.path}/{name}"), True)

    def numbered(self, prefix: str) -> list[int]:
        folder = self.hadoop.Path(self.path)
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())


class Store:
    """A table in parts by a hash of its key. An upsert rewrites only the parts its rows fall into.

    A commit file names the folder of every part; the highest complete one counts, so a lost writer harms nothing. Folders
    no longer named by the last two commits are removed. A batch that was committed is not applied again.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: str, parts: int = 64):
        self.spark, self.path, self.key, self.schema, self.parts = spark, path.rstrip("/"), key, schema, parts
        self.folder = Folder(spark, path)

    def _last(self) -> tuple[int, dict]:
        for n in reversed(self.folder.numbered("commit-")):
            found = self.folder.read(f"commit-{n}")
            if found is not None:
                return n, found
        return -1, {"parts": {}, "batch": -1}

    def _read(self, where: dict[str, str]) -> DataFrame:
        if not where:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{folder}/_part={part}" for part, folder in where.items()])

    def read(self) -> DataFrame:
        return self._read(self._last()[1]["parts"])

    def _commit(self, rows: DataFrame, kept: dict[str, str], touched: list[int], batch: int) -> None:
        name = f"data-{uuid.uuid4().hex}"
        rows.withColumn("_part", self._part()).write.partitionBy("_part").parquet(f"{self.path}/{name}")
        held = {str(r["_part"]) for r in self.spark.read.parquet(f"{self.path}/{name}").select("_part").distinct().collect()} if touched else set()
        n, last = self._last()
        self.folder.write(f"commit-{n + 1}", {"parts": {p: f for p, f in kept.items() if int(p) not in touched} | {p: name for p in held}, "batch": batch})
        for old in self.folder.numbered("commit-"):
            if old < n:
                gone = self.folder.read(f"commit-{old}")
                used = set(last["parts"].values()) | set(self._last()[1]["parts"].values())
                for folder in set(gone["parts"].values()) - used:
                    self.folder.remove(folder)
                self.folder.remove(f"commit-{old}")

    def _part(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("int")

    def replace(self, rows: DataFrame) -> None:
        self._commit(rows, {}, list(range(self.parts)), -1)

    def upsert(self, rows: DataFrame, stamp: str | None = None, batch: int = -1) -> None:
        last = self._last()[1]
        if 0 <= batch <= last["batch"]:
            return
        touched = [r["p"] for r in rows.select(self._part().alias("p")).distinct().collect()]  # at most `parts` numbers
        if touched:
            old = self._read({p: f for p, f in last["parts"].items() if int(p) in touched})
            self._commit(upsert(old, rows, self.key, stamp), last["parts"], touched, max(batch, last["batch"]))


class Cursor:
    """A position that outlives the process: which ids of a pass are done, and for which version it was completed."""

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.folder, self.name = Folder(spark, path), f"cursor-{name}"

    def _state(self) -> dict:
        return self.folder.read(self.name) or {"after": None, "done": 0}

    def rest(self, rows: DataFrame, version: int, key: str = "id") -> DataFrame:
        """Rows of this pass that are still to do, in the order of their key; none if it was completed for the version."""
        state = self._state()
        if state["done"] >= version:
            return rows.limit(0)
        rows = rows if state["after"] is None else rows.where(F.col(key) > state["after"])
        return rows.orderBy(key)

    def advance(self, after: int) -> None:
        self.folder.write(self.name, self._state() | {"after": after})

    def finish(self, version: int) -> None:
        self.folder.write(self.name, {"after": None, "done": version})


class Cached:
    """A derived table that is built again when the fingerprint of what it comes from changes.

    The fingerprint covers number and content (a sum of row hashes), so edits in place are noticed too.
    """

    def __init__(self, build: Callable[[DataFrame], DataFrame]):
        self.build, self.state, self.table = build, None, None

    def get(self, source: DataFrame) -> DataFrame:
        state = tuple(source.agg(F.count("*"), F.sum(F.xxhash64(*source.columns).cast("decimal(38,0)"))).first())
        if state != self.state:
            if self.table is not None:
                self.table.unpersist()
            self.state, self.table = state, self.build(source).persist()
        return self.table


def index(stream: DataFrame, store: Store, analyse: Callable[[DataFrame], DataFrame], checkpoint: str, available_now: bool = True):
    """Start the query that analyses each micro-batch of a stream and upserts the result; a repeated batch changes nothing."""

    def one(batch: DataFrame, number: int) -> None:
        store.upsert(analyse(batch), batch=number)

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def bursts(stream: DataFrame, gap: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Extension: runs of media(bucketId, dateTaken) of an album without a longer gap, by event time, late rows dropped."""
    rows = stream.withColumn("at", F.col("dateTaken").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.session_window("at", gap).alias("w"), "bucketId").agg(F.count("*").alias("items")).select("bucketId", F.col("w.start").alias("first"), F.col("w.end").alias("past"), "items")
