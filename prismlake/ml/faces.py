"""Rules around any face detector and any pair of encoders: search by parts, verification, prompts of topics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.ml.image_ops import tiles, to_frame

# What counts as a face, as a crowd, and as verified; scale of an encoder's logits.
LEAST_FRACTION, CROWD, DENSE_SIDE, MOST_FACES, OVERLAP = 0.02, 6, 1600, 60, 0.3
VERIFY_BELOW, LEAST_PROBABILITY, LOGIT_SCALE, VERIFY_MARGIN = 0.8, 0.5, 100.0, 1.6

Found = tuple[tuple[float, float, float, float], float]


def iou(a: tuple[float, ...], b: tuple[float, ...]) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def merged(found: list[Found], most: float = OVERLAP) -> list[Found]:
    """By falling score, those that overlap none kept before by more than `most`; equal scores in the order given."""
    kept: list[Found] = []
    for box, score in sorted(found, key=lambda f: -f[1]):
        if all(iou(box, k[0]) <= most for k in kept):
            kept.append((box, score))
    return kept


def search(image: np.ndarray, detect: Callable[[np.ndarray], list[Found]], large: Callable[[], np.ndarray | None] | None = None, crowd: int = CROWD) -> list[Found]:
    """Faces of a picture as fractions of it, best first, at most MOST_FACES.

    detect gives boxes in pixels of what it gets. Faces below LEAST_FRACTION of the long side don't count. Where the whole
    holds a crowd, the picture (a larger one, if there is) is searched by 2 x 2 parts, and by 3 x 3 if it is large enough.
    """

    def of(px: np.ndarray, grid: int) -> list[Found]:
        h, w = px.shape[:2]
        out = []
        for tile in tiles(w, h, grid):
            for box, score in detect(px[tile[1] : tile[3], tile[0] : tile[2]]):
                if max(box[2] - box[0], box[3] - box[1]) >= max(w, h) * LEAST_FRACTION:
                    out.append((to_frame(box, tile, w, h), score))
        return out

    found = merged(of(image, 1))
    if len(found) >= crowd:
        big = large() if large else image
        if big is not None:
            more = of(big, 2) + (of(big, 3) if max(big.shape[:2]) >= DENSE_SIDE else [])
            found = merged(found + more)
    return found[:MOST_FACES]


def around(box: tuple[float, float, float, float], width: int, height: int, margin: float = VERIFY_MARGIN) -> tuple[int, int, int, int]:
    """The square (left, top, right, bottom) around a box in pixels that an encoder should see, within the frame."""
    side = max(box[2] - box[0], box[3] - box[1]) * margin
    left, top = (min(max(round((box[i] + box[i + 2]) / 2 - side / 2), 0), size - 1) for i, size in ((0, width), (1, height)))
    return left, top, left + min(max(round(side), 1), width - left), top + min(max(round(side), 1), height - top)


def probability(vectors: np.ndarray, prompts: list[tuple[bool, np.ndarray]]) -> np.ndarray:
    """How likely each picture is what the positive prompts say: their share of the softmax over all prompts."""
    z = LOGIT_SCALE * vectors @ np.stack([p for _, p in prompts]).T
    e = np.exp(z - z.max(1, keepdims=True))
    return e[:, [i for i, (yes, _) in enumerate(prompts) if yes]].sum(1) / e.sum(1)


def verify(faces: DataFrame, prompts: list[tuple[bool, np.ndarray]]) -> tuple[DataFrame, DataFrame]:
    """Ids of faces to keep as checked, and of those to drop, among faces(id, score, checked, isArtifact, lockedPersonId, vec).

    Asked are uncertain faces that nobody has confirmed or checked; vec is the encoder's vector of the face's surroundings.
    A face without one is kept, as without prompts all are.
    """
    asked = faces.where((F.col("score") < VERIFY_BELOW) & ~F.col("checked") & ~F.col("isArtifact") & F.col("lockedPersonId").isNull())

    def run(batches):
        for batch in batches:
            vec = batch.column("vec").to_pylist()
            has = np.array([v is not None for v in vec], bool)
            p = np.ones(len(vec))
            if has.any() and prompts:
                p[has] = probability(np.array([v for v in vec if v is not None], float), prompts)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(p)], names=["id", "p"])

    rated = asked.select("id", "vec").mapInArrow(run, "id bigint, p double")
    return rated.where(F.col("p") >= LEAST_PROBABILITY).select("id"), rated.where(F.col("p") < LEAST_PROBABILITY).select("id")


def topic_vectors(topics: list[tuple[str, str]], templates: list[str], english: Callable[[str], np.ndarray | None], other: Callable[[str], np.ndarray | None]) -> list[tuple[str, list[float]]]:
    """(title, vector) of topics(title, prompt): the normalised mean over the templates ({} stands for the prompt).

    Where the English encoder gives nothing the title goes to the other one; a topic without any vector is left out.
    """
    out = []
    for title, prompt in topics:
        found = [v for t in templates if (v := english(t.replace("{}", prompt))) is not None]
        v = np.sum(np.asarray(found, float), axis=0) if found else other(title)
        if v is not None:
            v = np.asarray(v, float)
            out.append((title, (v / max(np.linalg.norm(v), 1e-12) if found else v).tolist()))
    return out
