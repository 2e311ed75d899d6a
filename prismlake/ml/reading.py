"""Which language a picture's text is in, and reading its weak lines again: the rules around any line recogniser."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Lines probed, weak and sure confidences, lines read again, the gain that replaces a line, what is kept.
PROBES, WEAK, SURE, RETRIES, GAIN = 3, 0.6, 0.85, 12, 0.1
MOST_LINES, LEAST_CONFIDENCE, LEAST_LENGTH = 120, 0.5, 2

Box = tuple[float, float, float, float]


@dataclass(frozen=True)
class Line:
    box: Box
    text: str
    confidence: float


def score(lines: list[Line]) -> float:
    """Confidences weighed by the length of what was read."""
    return sum(line.confidence * len(line.text) for line in lines)


def read(boxes: list[Box], languages: list[str], recognise: Callable[[list[Box], str], list[Line]]) -> list[Line]:
    """The lines of a picture, read in the language that suits its largest boxes best.

    If the result isn't sure on the whole, its weak lines are read in the other languages too, and the best of those
    replaces a line where it is clearly surer. Ties go to the language named first.
    """
    if not languages:
        return []
    if len(languages) == 1:
        return recognise(boxes, languages[0])
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    probe = sorted(boxes, key=area, reverse=True)[:PROBES]
    probes = {lang: recognise(probe, lang) for lang in languages}
    best = max(languages, key=lambda lang: score(probes[lang]))
    rest = [b for b in boxes if b not in probe]
    lines = probes[best] + (recognise(rest, best) if rest else [])
    weak = [line.box for line in lines if line.confidence < WEAK][:RETRIES]
    if not weak or np.mean([line.confidence for line in lines]) >= SURE:
        return lines
    again: dict[Box, Line] = {}
    for lang in languages:
        for line in recognise(weak, lang) if lang != best else ():
            again[line.box] = max(again.get(line.box, line), line, key=lambda x: x.confidence)
    return [again[x.box] if x.box in again and again[x.box].confidence > x.confidence + GAIN else x for x in lines]


def kept(lines: list[Line]) -> list[Line]:
    """Lines worth storing: sure enough, of two characters at least, no more than a picture's share."""
    return [x for x in lines if x.confidence >= LEAST_CONFIDENCE and len(x.text) >= LEAST_LENGTH][:MOST_LINES]


def best_language(lines: DataFrame) -> DataFrame:
    """(mediaId, language, score): per media the language of largest weighed confidence among lines(mediaId, language, text, confidence).

    Ties go to the first by name; null texts and confidences count 0.
    """
    weighed = F.coalesce(F.col("confidence").cast("double") * F.length("text"), F.lit(0.0))
    by = lines.groupBy("mediaId", "language").agg(F.round(F.sum(weighed), 6).alias("score"))
    rank = Window.partitionBy("mediaId").orderBy(F.desc("score"), "language")
    return by.withColumn("r", F.row_number().over(rank)).where("r = 1").select("mediaId", "language", "score")


def joined(lines: DataFrame) -> DataFrame:
    """(mediaId, text, lineCount) of lines(id, mediaId, text, boxTop, boxLeft), from top to bottom, then from the left."""
    order = F.array_sort(F.collect_list(F.struct("boxTop", "boxLeft", "id", "text")))
    rows = lines.where("text is not null").groupBy("mediaId").agg(order.alias("parts"))
    return rows.select("mediaId", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"), F.size("parts").alias("lineCount"))
