"""Languages of short texts and of the passages in them.

A sparse multinomial logistic regression over TF-IDF character n-grams, trained by follow-the-regularised-leader with
elastic net on a bounded sample of labelled lines (document frequencies are those of all lines), whose labels may be
wrong: after a first round, lines whose label the model doesn't share are set aside, right or wrong, and it is trained
again. Confidences are calibrated by a temperature, fitted together with the share of wrong labels on all held-out
lines. Passages of one language are found as the best path through a line's words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANGUAGES = ("de", "en", "es", "fr", "it", "ja", "nl", "pl", "pt", "ru", "tr", "uk", "zh")
# Three-letter codes of these languages.
THREE = {"deu": "de", "ger": "de", "eng": "en", "spa": "es", "fra": "fr", "fre": "fr", "ita": "it", "jpn": "ja", "nld": "nl", "dut": "nl", "pol": "pl", "por": "pt", "rus": "ru", "tur": "tr", "ukr": "uk", "zho": "zh", "chi": "zh"}

#: Labelled lines the model is fitted on, at most about so many (those of smallest hash of their text's id).
TRAIN_LINES = 12_000
BUCKETS = 1 << 16
GRAMS = (1, 2, 3, 4)
#: Words a worker remembers the evidence of.
REMEMBERED = 1 << 16
#: Cost of changing the language within a line, in nats.
SWITCH = 6.0

PIECE = re.compile(r"\S+")
RUN = re.compile(r"[぀-ヿ㐀-鿿ｦ-ﾟ々、。]+|[^\W\d_]+(?:['’\-][^\W\d_]+)*")
CJK = re.compile(r"[぀-ヿ㐀-鿿ｦ-ﾟ]")


def known(lang: str) -> Column:
    """A declared language in any notation as two letters; null where it is none of LANGUAGES but unusable."""
    code = F.regexp_extract(F.lower(F.trim(lang)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    three = F.create_map(*[F.lit(x) for pair in THREE.items() for x in pair])
    code = F.coalesce(three[code], code)
    return F.when(code.isin(*LANGUAGES), code)


@lru_cache(1 << 16)
def grams(word: str) -> np.ndarray:
    """Hashed n-grams of a word with its ends marked; a run of a script without blanks has no ends."""
    word = word.lower()
    text = word if CJK.match(word) else f"␂{word}␃"
    text = text.encode("utf-32-le")
    n = len(text) // 4
    found = [zlib.crc32(text[4 * i : 4 * (i + k)]) for k in GRAMS for i in range(n - k + 1)]
    return np.array(found, dtype=np.int64) & (BUCKETS - 1)


def units(text: str) -> list[tuple[int, int]]:
    """Places of the words of a text, and of the runs of letters of a script without blanks."""
    out = []
    for piece in PIECE.finditer(text):
        part = piece.group()
        if any(c.isdigit() for c in part) and not CJK.search(part) and sum(c.isalpha() for c in part) < 3 + 2 * sum(c.isdigit() for c in part):
            continue
        out += [(piece.start() + m.start(), piece.start() + m.end()) for m in RUN.finditer(part)]
    return out


@dataclass
class Model:
    weight: np.ndarray  # BUCKETS x languages, idf included
    bias: np.ndarray
    temperature: float = 1.0
    names: tuple[str, ...] = LANGUAGES
    idf: np.ndarray = field(default=None, repr=False)
    #: Share of wrong labels, and the calibration error of the confidences, as found on held-out lines.
    noise: float = 0.0
    error: float = 0.0
    known: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def word(self, w: str) -> tuple[np.ndarray, np.ndarray]:
        """A word's evidence for each language, and its say in nats as if it were a text by itself; remembered."""
        found = self.known.get(w)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            evidence = self.weight[grams(w)].sum(0, dtype=np.float64)
            local = evidence / self.norm([w]) / self.temperature
            local = local - local.max()
            local -= np.log(np.exp(local).sum())
            local *= min(1.0 + 0.5 * len(w) if CJK.match(w) else 0.25 + 0.15 * len(w), 4.0)
            found = self.known[w] = (evidence, local)
        return found

    def norm(self, found: list[str]) -> float:
        key, count = np.unique(np.concatenate([grams(w) for w in found]), return_counts=True)
        return float(np.sqrt(np.sum((count * self.idf[key]) ** 2))) or 1.0

    def classify(self, found: list[str], evidence: np.ndarray) -> tuple[str, float]:
        z = (evidence.sum(0) / self.norm(found) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        return self.names[int(p.argmax())], float(p.max())


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = [grams(text[a:b]) for a, b in units(text)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0)
    key, count = np.unique(np.concatenate(found), return_counts=True)
    value = count * idf[key]
    return key, value / (np.linalg.norm(value) or 1.0)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, rounds: int = 3, alpha: float = 0.8, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a multinomial logistic regression with elastic net, by follow-the-regularised-leader."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(key: np.ndarray) -> np.ndarray:
        zz = z[key]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[key])) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            key, value = np.append(rows[i][0], BUCKETS), np.append(rows[i][1], 0.1)
            w = weights(key)
            score = value @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = np.outer(value, p)
            z[key] += g - (np.sqrt(n[key] + g * g) - np.sqrt(n[key])) / alpha * w
            n[key] += g * g
    all_ = weights(np.arange(BUCKETS + 1))
    return all_[:-1], all_[-1] * 0.1


def occurrences(texts: Iterable[str | None]) -> tuple[np.ndarray, int]:
    """In how many of some texts each hashed n-gram occurs, and how many texts there are; null counts as none."""
    seen, n = np.zeros(BUCKETS, np.int64), 0
    for t in texts:
        if t is None:
            continue
        n += 1
        found = [grams(t[a:b]) for a, b in units(t)]
        if found:
            seen[np.unique(np.concatenate(found))] += 1
    return seen, n


def frequencies(lines: DataFrame) -> tuple[np.ndarray, int]:
    """The same over all rows of lines(text): each task adds up its own counters, which then meet by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            more, rows = occurrences(batch.column("text").to_pylist())
            seen, n = seen + more, n + rows
        key = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, key], pa.int32()), pa.array(np.r_[n, seen[key]], pa.int64())], names=["bucket", "n"])

    found = lines.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    key, count = found.column("bucket").to_numpy(), found.column("n").to_numpy()
    seen = np.zeros(BUCKETS, np.int64)
    seen[key[key >= 0]] = count[key >= 0]
    return seen, int(count[key < 0].sum())


def fit(texts: list[str], labels: list[str], seen: tuple[np.ndarray, int] | None = None) -> Model:
    """A model from texts and labels; seen: frequencies() of the corpus, else those of the texts."""
    seen, n = seen or occurrences(texts)
    idf = np.log((1 + n) / (1 + seen)) + 1
    rows = [features(t, idf) for t in texts]
    keep = [i for i, r in enumerate(rows) if len(r[0])]
    rows, y = [rows[i] for i in keep], np.array([LANGUAGES.index(labels[i]) for i in keep], dtype=int)
    if not rows:
        return Model(np.zeros((BUCKETS, len(LANGUAGES)), np.float32), np.zeros(len(LANGUAGES)), 1.0, idf=idf)

    def scores(w: np.ndarray, b: np.ndarray, which: np.ndarray) -> np.ndarray:
        return np.stack([rows[i][1] @ w[rows[i][0]] + b for i in which]) if len(which) else np.zeros((0, len(LANGUAGES)))

    order = np.random.default_rng(1).permutation(len(rows))
    held, used = order[: len(order) // 8], order[len(order) // 8 :]
    held = held if len(held) else used
    w, b = ftrl([rows[i] for i in used], y[used], len(LANGUAGES), rounds=2)
    used = used[scores(w, b, used).argmax(1) == y[used]]
    w, b = ftrl([rows[i] for i in used], y[used], len(LANGUAGES))
    temperature, noise, error = calibrate(scores(w, b, held), y[held])
    return Model((w * idf[:, None]).astype(np.float32), b, temperature, idf=idf, noise=noise, error=error)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def calibrate(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float, float]:
    """(temperature, share of wrong labels, calibration error) of scores whose labels are partly wrong.

    A label is taken to be the true language or, with the share of wrong ones, any by how common it is; both numbers are
    those of highest likelihood. The error is the mean gap, over tenths of confidence, between how often the label agrees
    with the model and how often it should by its confidence and the share of wrong labels.
    """
    if not len(labels):
        return 1.0, 0.0, 0.0
    common = np.bincount(labels, minlength=scores.shape[1]) / len(labels)
    best = (-np.inf, 1.0, 0.0)
    for t in np.geomspace(0.05, 5, 40):
        own = softmax(scores / t)[np.arange(len(labels)), labels]
        for noise in np.linspace(0, 0.6, 61):
            fit_ = float(np.log((1 - noise) * own + noise * common[labels] + 1e-12).sum())
            if fit_ > best[0]:
                best = (fit_, float(t), float(noise))
    _, t, noise = best
    p = softmax(scores / t)
    top = p.argmax(1)
    due, agrees = (1 - noise) * p.max(1) + noise * common[top], top == labels
    tenth = np.minimum((p.max(1) * 10).astype(int), 9)
    error = sum(abs(due[tenth == k].sum() - agrees[tenth == k].sum()) for k in range(10)) / len(labels)
    return t, noise, float(error)


def train(lines: DataFrame, most: int = TRAIN_LINES) -> Model:
    """A model from lines(id, text, label): label one of LANGUAGES, partly wrong, or null.

    Weights are fitted on about `most` labelled lines at most; n-grams are weighed by their frequencies in all lines.
    """
    seen = frequencies(lines)
    lines = lines.where("label is not null")
    n = lines.count()
    part = min(1.0, most / max(n, 1))
    sample = lines if part == 1.0 else lines.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(part * (1 << 20)))
    rows = sample.where("text is not null and label is not null").select("id", "text", "label").orderBy("id").collect()
    return fit([r["text"] for r in rows], [r["label"] for r in rows], seen)


def cut_up(text: str, model: Model, switch: float = SWITCH) -> list[tuple[int, int, str, float]]:
    """(first, past, language, confidence) of each passage of running text.

    A passage has at least two words, or four letters of a script without blanks; numbers, codes and signs make none.
    """
    at = units(text)
    found = [text[a:b] for a, b in at]
    if not running(found):
        return []
    say = [model.word(w) for w in found]
    evidence, local = np.array([x[0] for x in say]), np.array([x[1] for x in say])
    whole = local.sum(0)
    if local.max(1).sum() - switch <= whole.max():  # no path that changes the language can be better
        path = [int(whole.argmax())] * len(found)
    else:
        path = _path(local, switch)
    edges = [i for i in range(len(path)) if i == 0 or path[i] != path[i - 1]] + [len(path)]
    parts = [(a, b) for a, b in zip(edges, edges[1:], strict=False)]
    parts = [(a, b) for a, b in parts if running(found[a:b])] or [(0, len(found))]
    out = []
    for a, b in parts:
        lang, p = model.classify(found[a:b], evidence[a:b])
        if out and out[-1][2] == lang:
            a = out.pop()[4]
            lang, p = model.classify(found[a:b], evidence[a:b])
        out.append((at[a][0], at[b - 1][1], lang, p, a))
    return [x[:4] for x in out]


def _path(local: np.ndarray, switch: float) -> list[int]:
    """The language of each word on the path of most evidence, less the cost of every change."""
    cost, back = local[0].copy(), []
    for row in local[1:]:
        best = int(cost.argmax())
        stay = cost >= cost[best] - switch
        back.append(np.where(stay, np.arange(len(cost)), best))
        cost = np.where(stay, cost, cost[best] - switch) + row
    path = [int(cost.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


def running(found: list[str]) -> bool:
    solid = sum(len(w) for w in found if CJK.match(w))
    return solid >= 4 or sum(len(w) >= 2 for w in found if not CJK.match(w)) >= 2


def passages(lines: DataFrame, model: Model) -> DataFrame:
    """lines(id, mediaId, text, label) with a row for each passage: first, past (code points), lang, confidence.

    A line without running text, empty or null gives one row with nulls there. Texts of any length are read whole; equal
    rows give equal results. The model is broadcast; its size is fixed by BUCKETS.
    """
    shared = lines.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found, seen = [], [], {}
            for i, text in enumerate(batch.column("text").to_pylist()):
                if text not in seen:
                    seen[text] = (cut_up(text, shared.value) if text else []) or [(None, None, None, None)]
                row += [i] * len(seen[text])
                found += seen[text]
            take = pa.array(row, pa.int64())
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("id", "mediaId", "label")), *(pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds))], names=["id", "mediaId", "label", "first", "past", "lang", "confidence"])

    return lines.select("id", "mediaId", "label", "text").mapInArrow(run, "id bigint, mediaId bigint, label string, first bigint, past bigint, lang string, confidence double")


def documents(found: DataFrame) -> DataFrame:
    """(media_id, lang, confidence, share): the language of most letters of each media; ties go to the first by name."""
    size = F.col("past") - F.col("first")
    by = found.where("lang is not null and media_id is not null").groupBy("media_id", "lang").agg(F.sum(size).alias("size"), (F.sum(size * F.col("confidence")) / F.sum(size)).alias("confidence"))
    rank = Window.partitionBy("media_id").orderBy(F.desc("size"), "lang")
    by = by.select("*", F.row_number().over(rank).alias("rank"), (F.col("size") / F.sum("size").over(Window.partitionBy("media_id"))).alias("share"))
    return by.where("rank = 1").select("media_id", "lang", F.round("confidence", 6).alias("confidence"), F.round("share", 6).alias("share"))
