"""Test passages in a corpus: a broadcast hash set of the test items' word windows, scanned over every document.

A window is told by two independent 64-bit hashes: the first, of its words' hashes, finds it in a sorted array; the second,
of its text, verifies the hit. Up to BROADCAST_WINDOWS windows are broadcast with their items. More are broadcast as one bitmap of fixed size,
which lets only promising windows of the corpus through to an exact join; nothing depends on the number of items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.tables import cut

WINDOW = 12
#: Windows (of 20 bytes each) that are broadcast with their items; bits of the map that stands for more (64 MB).
BROADCAST_WINDOWS, MAP_BITS = 4_000_000, 1 << 29
SEGMENT = 1 << 20
#: Words whose hashes a worker remembers.
REMEMBERED = 1 << 20

# A word is a maximal run of letters and digits; a hyphen at a line end belongs to the break and goes with it.
BREAK = re.compile(r"[-‐][ \t]*\r?\n[ \t]*")
WORD = re.compile(r"[^\W_]+(?:[-‐][ \t]*\r?\n[ \t]*[^\W_]+)*")


def words(text: str) -> list[str]:
    """The words of a text, lower-cased after they are told apart."""
    return [plain(w) for w in WORD.findall(text)]


def plain(word: str) -> str:
    return (BREAK.sub("", word) if "\n" in word else word).lower()


class Hashes(dict):
    """Hash of a word as it is written, broken or not, in upper or lower case; forgets everything when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(plain(word).encode("utf-8", "surrogatepass"))
        return found


_hash = Hashes()


def windows(found: list[str], size: int) -> np.ndarray:
    """A hash of every window of `size` words, by their hashes and order."""
    n = len(found) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(_hash.__getitem__, found), np.uint64, len(found))
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + own[j : j + n]
    return h ^ (h >> np.uint64(31))


def proof(found: list[str], at: np.ndarray, size: int) -> np.ndarray:
    """A second hash, of the very text of the windows at some places."""
    return np.array([xxhash.xxh3_64_intdigest("\0".join(map(plain, found[i : i + size])).encode("utf-8", "surrogatepass"), 1) for i in at.tolist()], dtype=np.uint64)


class Windows:
    """The test items' windows: sorted first hashes, second hashes, and the number of the item that holds each."""

    def __init__(self, items: list[tuple[int, str]], size: int = WINDOW):
        parts = []
        for n, (_, text) in enumerate(items):
            own = WORD.findall(text)
            hashes = windows(own, size)
            parts.append((hashes, proof(own, np.arange(len(hashes)), size), n))
        first = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
        second = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint64)
        item = np.concatenate([np.full(len(p[0]), p[2], np.int32) for p in parts]) if parts else np.zeros(0, np.int32)
        order = np.lexsort((item, second, first))
        self.size, self.ids = size, np.array([i for i, _ in items], np.int64)
        self.first, self.second, self.item = first[order], second[order], item[order]

    def hits(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(position, item) of every window of a document that a test item holds; found: its words as written."""
        first = windows(found, self.size)
        if not len(first) or not len(self.first):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low = np.searchsorted(self.first, first)
        at = np.flatnonzero(self.first[np.minimum(low, len(self.first) - 1)] == first)
        if not len(at):
            return at, at
        second = proof(found, at, self.size)
        times = np.searchsorted(self.first, first[at], side="right") - low[at]
        again = np.repeat(at, times)
        entry = low[again] + np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
        right = self.second[entry] == np.repeat(second, times)
        return again[right], self.item[entry[right]].astype(np.int64)


def stretches(places: list[tuple[int, int]], at: np.ndarray, item: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(item, first character, character after the last) of each maximal stretch; places: where the words are."""
    if not len(at):
        return []
    order = np.lexsort((at, item))
    at, item = at[order], item[order]
    new = np.flatnonzero(np.r_[True, (np.diff(item) != 0) | (np.diff(at) > size)])
    last = np.r_[new[1:], len(at)] - 1
    return [(int(item[a]), places[at[a]][0], places[at[b] + size - 1][1]) for a, b in zip(new, last, strict=True)]


def spans(text: str, windows_: Windows) -> list[tuple[int, int, int]]:
    """(item id, first character, character after the last) of each maximal stretch of a text that an item holds."""
    matches = list(WORD.finditer(text))
    at, item = windows_.hits([m.group() for m in matches])
    return sorted((int(windows_.ids[n]), a, b) for n, a, b in stretches([m.span() for m in matches], at, item, windows_.size))


def without(text: str, places: list[tuple[int, int]]) -> str:
    """The text without some stretches, which may overlap."""
    keep, at = [], 0
    for a, b in sorted(places):
        keep.append(text[at : max(at, a)])
        at = max(at, b)
    return "".join([*keep, text[at:]])


def _items(items: DataFrame) -> DataFrame:
    return items.where("text is not null and item_id is not null").select(F.col("item_id").cast("long"), "text").distinct()


def _few(items: DataFrame, size: int) -> Windows | None:
    """The items' windows if they are few enough to broadcast; a text has at most half as many words as characters."""
    n, chars = items.limit(BROADCAST_WINDOWS + 1).agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    if n > BROADCAST_WINDOWS or chars > 2 * BROADCAST_WINDOWS:
        return None
    return Windows([tuple(r) for r in items.orderBy("item_id", "text").collect()], size)


def _joined(documents: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """(doc_id, item_id, at): windows of documents that an item holds, for any number of items.

    The items' hashes set bits of a map of fixed size, made by segments; windows of the corpus whose bit is set go to an
    equi-join on both hashes, and no others.
    """

    def cut_up(batches: Iterator[pa.RecordBatch], bits: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = WORD.findall(text)
                first = windows(found, size)
                at = np.arange(len(first))
                if bits is not None:
                    slot = first % np.uint64(MAP_BITS)
                    at = np.flatnonzero(bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), key, np.int64)), pa.array(at.astype(np.int64)), pa.array(first[at].view(np.int64)), pa.array(proof(found, at, size).view(np.int64))], names=["id", "at", "h", "g"])

    schema = "id bigint, at bigint, h bigint, g bigint"
    known = cut(items.select("item_id", "text").mapInArrow(cut_up, schema).select(F.col("id").alias("item_id"), "h", "g").distinct(), "leak-windows")

    def segment(group: pa.Table) -> pa.Table:
        bits = np.zeros(SEGMENT, np.uint8)
        bits[group.column("slot").to_numpy() % SEGMENT] = 1
        return pa.table({"part": group.column("part")[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    # Python's remainder of the unsigned hash, from the signed one.
    slot = known.select(F.col("h").bitwiseAND(F.lit(MAP_BITS - 1)).alias("slot")).distinct().withColumn("part", F.floor(F.col("slot") / SEGMENT))
    parts = slot.groupBy("part").applyInArrow(segment, "part bigint, bits binary").toArrow()  # MAP_BITS / 8 bytes at most
    bits = np.zeros(MAP_BITS // 8, np.uint8)
    for part, own in zip(parts.column(0).to_pylist(), parts.column(1).to_pylist(), strict=True):
        bits[part * SEGMENT // 8 : (part + 1) * SEGMENT // 8] = np.frombuffer(own, np.uint8)
    shared = documents.sparkSession.sparkContext.broadcast(bits)
    found = documents.select("doc_id", "text").mapInArrow(lambda batches: cut_up(batches, shared.value), schema)
    return found.join(known, ["h", "g"]).select(F.col("id").alias("doc_id"), "item_id", "at")


def leaks(documents: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, item_id): documents that hold at least `size` consecutive words of an item.

    documents(doc_id, text), items(item_id, text). Null texts and texts of fewer words match nothing; repeated rows give
    one pair; further columns are ignored. Texts are read whole.
    """
    items = _items(items)
    documents = documents.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    few = _few(items, size)
    if few is None:
        return _joined(documents, items, size).select("doc_id", "item_id").distinct()
    shared = documents.sparkSession.sparkContext.broadcast(few)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            docs, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                item = np.unique(known.hits(WORD.findall(text))[1])
                if len(item):
                    docs.append(np.full(len(item), doc, np.int64))
                    found.append(known.ids[item])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs)), pa.array(np.concatenate(found))], names=["doc_id", "item_id"])

    return documents.mapInArrow(scan, "doc_id bigint, item_id bigint").distinct()


def clean(documents: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, first, past, kept): each leaked stretch by code points, and the document without all of them.

    Only documents with a leak are listed; doc_id must be unique. For any number of items, as leaks().
    """
    items = _items(items)
    documents = documents.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id bigint, item_id bigint, first bigint, past bigint, kept string"
    few = _few(items, size)

    def rows_of(doc: int, text: str, found: list[tuple[int, int, int]]) -> list[tuple]:
        rest = without(text, [(a, b) for _, a, b in found]) if found else ""
        return [(doc, *s, rest) for s in found]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(),) * 4 + (pa.string(),)
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "item_id", "first", "past", "kept"])

    if few is None:
        hits = _joined(documents, items, size).groupBy("doc_id").agg(F.collect_set(F.struct("item_id", "at")).alias("hits"))  # of one document

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for doc, text, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "hits")), strict=True):
                    at, item = (np.array([h[k] for h in own], np.int64) for k in ("at", "item_id"))
                    rows += rows_of(doc, text, sorted(stretches([m.span() for m in WORD.finditer(text)], at, item, size)))
                yield batch_of(rows)

        return documents.join(hits, "doc_id").mapInArrow(place, schema)
    shared = documents.sparkSession.sparkContext.broadcast(few)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += rows_of(doc, text, spans(text, shared.value))
            yield batch_of(rows)

    return documents.mapInArrow(scan, schema)
