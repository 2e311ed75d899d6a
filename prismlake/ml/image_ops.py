"""Image measurements in numpy, and their use over tables of pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WEIGHTS = np.array([299, 587, 114])


def channels(argb: np.ndarray, width: int, height: int) -> np.ndarray:
    p = np.asarray(argb, dtype=np.int64).reshape(height, width)
    return np.stack([(p >> 16) & 255, (p >> 8) & 255, p & 255], axis=-1)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    h, w = image.shape[:2]
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    image = image.reshape(h, w, -1).astype(float)
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    return top * (1 - fy) + (image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx) * fy


def difference_hash(argb: np.ndarray, width: int, height: int) -> int:
    """64 bits, row by row of 9 x 8 pixels: whether a pixel is brighter than its right neighbour; as a signed integer."""
    luma = np.floor(np.rint(resize(channels(argb, width, height), 9, 8)) @ WEIGHTS / 1000)
    bits = (luma[:, :-1] > luma[:, 1:]).ravel()
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def quality(argb: np.ndarray, width: int, height: int, grid: int = 4) -> tuple[float, float]:
    """(sharpness, brightness): largest variance of the Laplacian over grid x grid parts, mean luma of 0 to 1."""
    luma = channels(argb, width, height) @ WEIGHTS / 1000
    bright = float(luma.mean() / 255)
    if width < 3 or height < 3:
        return 0.0, bright
    lap = 4 * luma[1:-1, 1:-1] - luma[1:-1, :-2] - luma[1:-1, 2:] - luma[:-2, 1:-1] - luma[2:, 1:-1]
    part = (np.arange(1, height - 1) * grid // height)[:, None] * grid + (np.arange(1, width - 1) * grid // width)[None, :]
    n, s, q = (np.bincount(part.ravel(), w, grid * grid) for w in (None, lap.ravel(), (lap**2).ravel()))
    held = n > 0
    return float(np.max(q[held] / n[held] - (s[held] / n[held]) ** 2)), bright


def tensor(argb: np.ndarray, width: int, height: int, side: int, mean: list[float], std: list[float]) -> np.ndarray:
    """Shorter side scaled to `side`, centre cut out, normalised: channels first."""
    scale = side / min(width, height)
    w, h = max(side, round(width * scale)), max(side, round(height * scale))
    image = resize(channels(argb, width, height), w, h)
    image = image[(h - side) // 2 :, (w - side) // 2 :][:side, :side] / 255
    return ((image - np.array(mean)) / np.array(std)).transpose(2, 0, 1).astype(np.float32)


def letterbox(argb: np.ndarray, width: int, height: int, side: int) -> tuple[np.ndarray, float]:
    """Blue-green-red, fitted into a square from the top left, and the scale."""
    scale = side / max(width, height)
    w, h = max(1, round(width * scale)), max(1, round(height * scale))
    out = np.zeros((side, side, 3), np.float32)
    out[:h, :w] = resize(channels(argb, width, height), w, h)[:, :, ::-1]
    return out.transpose(2, 0, 1), scale


def tiles(width: int, height: int, grid: int, overlap: float = 0.15, least: int = 64) -> list[tuple[int, int, int, int]]:
    """(left, top, right, bottom) of grid x grid overlapping parts; the last ones reach the edge, small ones are left out."""
    if grid <= 1:
        return [(0, 0, width, height)]

    def cuts(size: int) -> list[tuple[int, int]]:
        step = size // grid
        more = int(step * overlap)
        return [(max(0, i * step - more), size if i == grid - 1 else min(size, (i + 1) * step + more)) for i in range(grid)]

    boxes = [(a, c, b, d) for c, d in cuts(height) for a, b in cuts(width)]
    return [t for t in boxes if t[2] - t[0] >= least and t[3] - t[1] >= least]


def similarity_transform(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """(a, b, tx, ty) of the least-squares map x' = a x - b y + tx, y' = b x + a y + ty between points."""
    s, t = np.asarray(source, float).reshape(-1, 2), np.asarray(target, float).reshape(-1, 2)
    ms, mt = s.mean(0), t.mean(0)
    zs, zt = (s - ms) @ np.array([1, 1j]), (t - mt) @ np.array([1, 1j])
    ratio = (zt * np.conj(zs)).sum() / (np.abs(zs) ** 2).sum()
    shift = mt @ np.array([1, 1j]) - ratio * (ms @ np.array([1, 1j]))
    return np.array([ratio.real, ratio.imag, shift.real, shift.imag])


def to_frame(box: tuple[float, float, float, float], tile: tuple[int, int, int, int], width: int, height: int) -> tuple[float, ...]:
    """A box in pixels of a tile as fractions of the frame, clipped to it."""
    l, t, r, b = box[0] + tile[0], box[1] + tile[1], box[2] + tile[0], box[3] + tile[1]
    return tuple(float(min(1.0, max(0.0, v))) for v in (l / width, t / height, r / width, b / height))


def text_boxes(probability: np.ndarray, threshold: float = 0.3, mean_least: float = 0.6, side_least: int = 3, grow: float = 1.6) -> list[tuple[int, int, int, int]]:
    """(left, top, right, bottom) of text on a probability map: runs above the threshold joined where they overlap in
    neighbouring rows, kept if bright and large enough, grown by an amount that follows their area and outline."""
    h, w = probability.shape
    on = np.pad(probability > threshold, ((0, 0), (1, 1)))
    edge = np.diff(on.astype(np.int8), axis=1)
    runs = [list(zip(np.flatnonzero(e == 1), np.flatnonzero(e == -1), strict=True)) for e in edge]
    parent: list[int] = []
    where: list[tuple[int, int, int]] = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[int] = []
    for y, row in enumerate(runs):
        now = []
        for a, b in row:
            i = len(parent)
            parent.append(i)
            where.append((y, int(a), int(b)))
            now.append(i)
            for j in above:
                if where[j][1] < b and a < where[j][2]:
                    parent[find(j)] = find(i)
        above = now
    groups: dict[int, list[tuple[int, int, int]]] = {}
    for i, run in enumerate(where):
        groups.setdefault(find(i), []).append(run)
    out = []
    for g in groups.values():
        top, bottom = min(r[0] for r in g), max(r[0] for r in g) + 1
        left, right = min(r[1] for r in g), max(r[2] for r in g)
        if min(right - left, bottom - top) < side_least:
            continue
        if np.mean(np.concatenate([probability[y, a:b] for y, a, b in g])) < mean_least:
            continue
        bw, bh = right - left, bottom - top
        pad = bw * bh * grow / (2 * (bw + bh))
        out.append((int(max(0, left - pad)), int(max(0, top - pad)), int(min(w, right + pad)), int(min(h, bottom + pad))))
    return sorted(out, key=lambda b: (b[1], b[0]))


def ctc(scores: np.ndarray, alphabet: str) -> tuple[str, float]:
    """(text, confidence): repeats collapsed, blanks (class 0) dropped; confidence is the mean of the kept maxima."""
    best, value = scores.argmax(1), scores.max(1)
    keep = (best != 0) & np.r_[True, best[1:] != best[:-1]]
    return "".join(alphabet[i - 1] for i in best[keep]), float(value[keep].mean()) if keep.any() else 0.0


def measure(images: DataFrame) -> DataFrame:
    """images(id, argb array<int>, width, height) as (id, hash, sharpness, brightness); unusable pixels give nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for argb, w, h in zip(batch.column("argb"), batch.column("width").to_pylist(), batch.column("height").to_pylist(), strict=True):
                px = argb.values.to_numpy(zero_copy_only=False) if argb.is_valid else None
                if px is None or not w or not h or len(px) != w * h:
                    rows.append((None, None, None))
                else:
                    rows.append((difference_hash(px, w, h), *quality(px, w, h)))
            kinds = (pa.int64(), pa.float32(), pa.float32())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["id", "hash", "sharpness", "brightness"])

    return images.select("id", "argb", "width", "height").mapInArrow(run, "id bigint, hash bigint, sharpness float, brightness float")
