"""Pictures: decoding, their EXIF, parts around faces, avatars. PNG, BMP and PNM by themselves, other kinds where Pillow is there."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from prismlake.ml.image_ops import resize

try:
    from PIL import Image
except ImportError:  # without it JPEG and others can't be read
    Image = None

# Sides of a face, an avatar and a thumbnail in pixels, the margins around a face for each.
FACE_SIDE, FACE_MARGIN = 160, 0.6
AVATAR_SIDE, AVATAR_MARGIN = 256, 1.5
THUMBNAIL_SIDE, THUMBNAIL_MARGIN = 128, 1.4


def _png(content: bytes) -> np.ndarray:
    at, data, palette, alpha = 8, b"", None, b""
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
        at += size + 12
    if depth != 8 or interlaced:
        raise ValueError("only 8 bits a sample, not interlaced")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * n)
    rows = np.zeros((height + 1, width * n), np.int64)
    for y in range(height):
        kind, line, up = raw[y, 0], raw[y, 1:].astype(np.int64), rows[y]
        if kind == 0:
            rows[y + 1] = line
        elif kind == 2:
            rows[y + 1] = (line + up) & 255
        elif kind == 1:
            rows[y + 1] = (np.cumsum(line.reshape(width, n), axis=0) & 255).ravel()
        else:
            out = rows[y + 1]
            for x in range(width * n):
                a, b, c = (out[x - n] if x >= n else 0), up[x], (up[x - n] if x >= n else 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                out[x] = (line[x] + guess) & 255
    px = rows[1:].reshape(height, width, n)
    if color == 3:
        return palette[px[..., 0]].astype(np.int64)
    return np.repeat(px[..., :1], 3, axis=2) if color in (0, 4) else px[..., :3]


def _bmp(content: bytes) -> np.ndarray:
    start, = struct.unpack("<I", content[10:14])
    width, height, _, depth, packed = struct.unpack("<iiHHI", content[18:34])
    if depth not in (24, 32) or packed not in (0, 3):
        raise ValueError("only plain 24 or 32 bits a pixel")
    stride = (width * depth // 8 + 3) // 4 * 4
    rows = np.frombuffer(content, np.uint8, abs(height) * stride, start).reshape(abs(height), stride)[:, : width * depth // 8].reshape(abs(height), width, depth // 8)
    return (rows[::-1] if height > 0 else rows)[..., 2::-1].astype(np.int64)


def _pnm(content: bytes) -> np.ndarray:
    fields, at = [], 0
    while len(fields) < 4:
        end = at
        while content[end : end + 1] not in (b" ", b"\n", b"\t", b"\r"):
            end += 1
        if content[at : at + 1] == b"#":
            end = content.index(b"\n", at)
        elif end > at:
            fields.append(content[at:end])
        at = end + 1
    width, height = int(fields[1]), int(fields[2])
    n = 3 if fields[0] == b"P6" else 1
    return np.repeat(np.frombuffer(content, np.uint8, width * height * n, at).reshape(height, width, n), 3 // n, axis=2).astype(np.int64)


def decode(content: bytes | None, long_side: int | None = None) -> np.ndarray | None:
    """Red, green and blue of a picture (height x width x 3), its long side scaled down to long_side; None if unreadable."""
    try:
        if content[:8] == b"\x89PNG\r\n\x1a\n":
            px = _png(content)
        elif content[:2] == b"BM":
            px = _bmp(content)
        elif content[:2] in (b"P5", b"P6"):
            px = _pnm(content)
        elif Image is not None:
            px = np.asarray(Image.open(io.BytesIO(content)).convert("RGB")).astype(np.int64)
        else:
            return None
    except Exception:  # noqa: BLE001 - a broken file is an unreadable one
        return None
    h, w = px.shape[:2]
    if long_side and max(h, w) > long_side:
        scale = long_side / max(h, w)
        px = np.rint(resize(px, max(1, round(w * scale)), max(1, round(h * scale)))).astype(np.int64)
    return px


def encode(px: np.ndarray) -> bytes:
    """Pixels as a PNG."""
    h, w = px.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), px.astype(np.uint8).reshape(h, -1)], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def argb(px: np.ndarray) -> np.ndarray:
    """Pixels as signed 32-bit numbers, opaque."""
    p = px.astype(np.int64).reshape(-1, 3)
    return ((255 << 24) | (p[:, 0] << 16) | (p[:, 1] << 8) | p[:, 2]).astype(np.uint32).view(np.int32)


def exif(content: bytes) -> dict[str, float]:
    """What a JPEG, PNG or TIFF block tells: rotation (degrees clockwise), latitude, longitude; what it doesn't is left out.

    Locations out of range or at 0, 0 count as none.
    """
    at = content.find(b"Exif\x00\x00")
    if at >= 0:
        t = content[at + 6 :]
    elif (at := content.find(b"eXIf")) >= 0:
        t = content[at + 4 :]
    else:
        t = content
    if t[:4] not in (b"II*\x00", b"MM\x00*"):
        return {}
    e = "<" if t[:2] == b"II" else ">"
    size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}

    def directory(start: int) -> dict[int, list]:
        found = {}
        n, = struct.unpack_from(e + "H", t, start)
        for k in range(n):
            tag, kind, count = struct.unpack_from(e + "HHI", t, start + 2 + 12 * k)
            where = start + 10 + 12 * k
            if size.get(kind, 1) * count > 4:
                where, = struct.unpack_from(e + "I", t, where)
            if kind == 2:
                found[tag] = [t[where : where + count].rstrip(b"\0").decode("latin-1")]
            elif kind in (3, 4):
                found[tag] = list(struct.unpack_from(f"{e}{count}{'H' if kind == 3 else 'I'}", t, where))
            elif kind == 5:
                v = struct.unpack_from(f"{e}{2 * count}I", t, where)
                found[tag] = [a / b if b else 0.0 for a, b in zip(v[::2], v[1::2], strict=True)]
        return found

    try:
        main = directory(struct.unpack_from(e + "I", t, 4)[0])
        out = {"rotation": {3: 180, 6: 90, 8: 270}.get(main.get(0x112, [1])[0], 0)}
        if 0x8825 in main:
            gps = directory(main[0x8825][0])
            if all(k in gps for k in (1, 2, 3, 4)):
                degrees = lambda v: v[0] + v[1] / 60 + v[2] / 3600
                lat, lon = degrees(gps[2]) * (-1 if gps[1][0] == "S" else 1), degrees(gps[4]) * (-1 if gps[3][0] == "W" else 1)
                if abs(lat) <= 90 and abs(lon) <= 180 and not (abs(lat) < 1e-6 and abs(lon) < 1e-6):
                    out |= {"latitude": lat, "longitude": lon}
        return out
    except (struct.error, IndexError):
        return {}


def upright(px: np.ndarray, rotation: int) -> np.ndarray:
    """Pixels turned clockwise."""
    return np.rot90(px, -rotation // 90)


@dataclass(frozen=True)
class Crop:
    """A part of a picture, and where it was: its corner and scale in pixels of the upright original."""

    px: np.ndarray
    left: int
    top: int
    scale: float
    width: int
    height: int

    def x(self, fraction: float) -> float:
        return (fraction * self.width - self.left) * self.scale

    def y(self, fraction: float) -> float:
        return (fraction * self.height - self.top) * self.scale


def to_source(box: tuple[int, int, int, int], rotation: int, width: int, height: int) -> tuple[int, int, int, int]:
    """A box (left, top, right, bottom) of the upright picture of width x height in the file's own pixels."""
    left, top, right, bottom = box
    turned = {90: (top, width - right, bottom, width - left), 180: (width - right, height - bottom, width - left, height - top), 270: (height - bottom, left, height - top, right)}
    return turned.get(rotation, box)


def face_crop(content: bytes, box: tuple[float, float, float, float], side: int = FACE_SIDE, margin: float = FACE_MARGIN) -> Crop | None:
    """The part around a face, whose box is in fractions of the upright picture.

    It is sampled down by the largest power of two that leaves the face at least `side` pixels wide. None if unreadable.
    """
    px = decode(content)
    if px is None:
        return None
    rotation = int(exif(content).get("rotation", 0))
    h, w = px.shape[:2] if rotation in (0, 180) else px.shape[1::-1]
    left, top, right, bottom = box[0] * w, box[1] * h, box[2] * w, box[3] * h
    more = max(right - left, bottom - top) * margin
    part = (round(max(0.0, left - more)), round(max(0.0, top - more)), round(min(float(w), right + more)), round(min(float(h), bottom + more)))
    a, b, c, d = to_source(part, rotation, w, h)
    if c <= a or d <= b:
        return None
    step = 1
    while (right - left) / (step * 2) >= side:
        step *= 2
    cut = upright(px[b:d:step, a:c:step], rotation)
    return Crop(cut, part[0], part[1], cut.shape[1] / (part[2] - part[0]), w, h)


def avatar(content: bytes, box: tuple[float, float, float, float], side: int = AVATAR_SIDE, margin: float = AVATAR_MARGIN) -> bytes | None:
    """A square around a face as a PNG of at most `side` pixels, never enlarged; clipped by the frame. None if unreadable."""
    px = decode(content)
    if px is None:
        return None
    px = upright(px, int(exif(content).get("rotation", 0)))
    h, w = px.shape[:2]
    reach = max((box[2] - box[0]) * w, (box[3] - box[1]) * h) * margin
    if not reach > 0:
        return None
    cx, cy = (box[0] + box[2]) / 2 * w, (box[1] + box[3]) / 2 * h
    a, b, c, d = (round(v) for v in (max(0.0, cx - reach / 2), max(0.0, cy - reach / 2), min(float(w), cx + reach / 2), min(float(h), cy + reach / 2)))
    cut = px[b:d, a:c] if c > a and d > b else px
    scale = min(1.0, side / max(reach, 1e-9), side / max(cut.shape[:2]))
    size = max(1, round(cut.shape[1] * scale)), max(1, round(cut.shape[0] * scale))
    return encode(np.rint(resize(cut, *size)) if scale < 1 else cut)


def pixels(images: DataFrame, long_side: int | None = None) -> DataFrame:
    """images(id, content) as (id, argb, width, height), upright; unreadable ones give nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):  # one picture a batch
                px = decode(content, long_side) if content else None
                if px is not None:
                    px = upright(px, int(exif(content).get("rotation", 0)))
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([None if px is None else argb(px)], pa.list_(pa.int32())), pa.array([None if px is None else px.shape[1]], pa.int32()), pa.array([None if px is None else px.shape[0]], pa.int32())], names=["id", "argb", "width", "height"])

    return images.select("id", "content").mapInArrow(run, "id bigint, argb array<int>, width int, height int")


def avatars(faces: DataFrame, side: int = AVATAR_SIDE, margin: float = AVATAR_MARGIN) -> DataFrame:
    """faces(id, content, boxLeft, boxTop, boxRight, boxBottom) as (id, avatar): PNG bytes, null if unreadable."""
    names = ["boxLeft", "boxTop", "boxRight", "boxBottom"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
            made = [avatar(content, box, side, margin) if content and None not in box else None for content, box in zip(batch.column("content").to_pylist(), boxes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.binary())], names=["id", "avatar"])

    return faces.select("id", "content", *names).mapInArrow(run, "id bigint, avatar binary")


def locations(images: DataFrame) -> DataFrame:
    """images(id, content) as (id, latitude, longitude) of their EXIF; null where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [exif(c) if c else {} for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f.get(k) for f in found], pa.float64()) for k in ("latitude", "longitude"))], names=["id", "latitude", "longitude"])

    return images.select("id", "content").mapInArrow(run, "id bigint, latitude double, longitude double")


def video_frame(path: str, long_side: int | None = None) -> np.ndarray | None:
    """The first frame of a video, where a codec library (PyAV) is there; else None, as for an unreadable file."""
    try:
        import av

        with av.open(path) as video:
            px = next(video.decode(video=0)).to_ndarray(format="rgb24").astype(np.int64)
    except Exception:  # noqa: BLE001
        return None
    return decode(encode(px), long_side)
