"""Searching media: natural-language queries, full text, and their fusion with vector hits."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismlake.conf import CONF
from prismlake.functions.text import matches_all, query_terms

# Months and seasons in all their forms, with the numbers of their months (from 1).
MONTHS = {
    "январь января январе january jan": (1,),
    "февраль февраля феврале february feb": (2,),
    "март марта марте march": (3,),
    "апрель апреля апреле april": (4,),
    "май мая мае may": (5,),
    "июнь июня июне june": (6,),
    "июль июля июле july": (7,),
    "август августа августе august": (8,),
    "сентябрь сентября сентябре september": (9,),
    "октябрь октября октябре october": (10,),
    "ноябрь ноября ноябре november": (11,),
    "декабрь декабря декабре december": (12,),
    "зима зимой зимы зиму winter": (1, 2, 12),
    "весна весной весны весну spring": (3, 4, 5),
    "лето летом лета summer": (6, 7, 8),
    "осень осенью осени autumn fall": (9, 10, 11),
}
# Case endings of names, the final vowels they replace, prepositions, forms of a year.
ENDINGS = ("", "а", "я", "у", "ю", "е", "и", "ы", "ой", "ей", "ом", "ем", "ём", "ою", "ею")
VOWELS = "аяоеёиыуюэй"
PREPOSITIONS = ("с", "со", "в", "во", "у", "и", "на", "из", "with", "in", "and", "at")
YEAR = re.compile(r"((?:19|20)\d\d)(?:г\.?|года|году|-?м|-?го)?", re.IGNORECASE)

MONTH_OF = {form: months for forms, months in MONTHS.items() for form in forms.split()}


@dataclass(frozen=True)
class Query:
    text: str
    people: tuple[int, ...] = ()
    year: int | None = None
    months: frozenset[int] = frozenset()
    cities: frozenset[int] = frozenset()
    words: tuple[tuple[str, str], ...] = field(default=())


def forms(name: str) -> set[str]:
    """The words of a name (of three letters at least) in all cases: as they are, and their stems with every ending."""
    out = set()
    for word in re.split(r"[ -]", name.lower()):
        if len(word) >= 3:
            stem = word[:-1] if word[-1] in VOWELS else word
            out |= {word} | ({stem + e for e in ENDINGS} if len(stem) >= 2 else set())
    return out


def vocabulary(people: dict[int, str], places: list[tuple[str, set[int]]]) -> dict[str, tuple[str, object]]:
    """form -> (kind, value) of all that a query may name; of a form with several meanings the first kind, then name, counts."""
    table: dict[str, tuple[str, object]] = {form: ("months", months) for form, months in MONTH_OF.items()}
    for kind, named in (("person", people.items()), ("place", [(frozenset(ids), name) for name, ids in places])):
        for value, name in named:
            for form in forms(name):
                if len(form) >= 3:
                    table.setdefault(form, (kind, value))
    return table


def parse(query: str, people: dict[int, str] | None = None, places: list[tuple[str, set[int]]] | None = None, ignored: frozenset[str] | set[str] = frozenset(), this_year: int | None = None) -> Query:
    """Years, months, people and places out of a query; the rest stays text.

    A word is a year (1990 to next year), months, a person or a place, in this order. Ignored words stay text, and a
    preposition right before a recognised word goes with it. Of several years the first counts.
    """
    now = this_year or date.today().year
    table = vocabulary(people or {}, places or [])
    words = query.split()
    bare = [w.strip(",.!?;:") for w in words]
    year = [int(m[1]) if (m := YEAR.fullmatch(w)) and 1990 <= int(m[1]) <= now + 1 else None for w in bare]
    seen = [None if w.lower() in ignored else ("year", y) if y else table.get(w.lower()) for w, y in zip(bare, year, strict=True)]
    ahead = [*seen[1:], None][: len(seen)]
    text = " ".join(w for w, own, then in zip(words, seen, ahead, strict=True) if own is None and not (then and w.lower() in PREPOSITIONS))
    of = lambda kind: [s[1] for s in seen if s and s[0] == kind]
    return Query(text, tuple(dict.fromkeys(of("person"))), next(iter(of("year")), None), frozenset(m for ms in of("months") for m in ms), frozenset(c for cs in of("place") for c in cs), tuple((w, s[0]) for w, s in zip(words, seen, strict=True) if s))


def full_text(texts: DataFrame, query: str, most: int = CONF.text_limit) -> DataFrame:
    """(mediaId) of texts(mediaId, text) in which every term starts some token; unranked, the smallest ids up to `most`."""
    return texts.where(matches_all(F.col("text"), query_terms(query))).select("mediaId").orderBy("mediaId").limit(most)


def like(texts: DataFrame, needle: str, column: str = "text") -> DataFrame:
    """Rows that hold a needle, upper and lower case of ASCII letters alike; % and _ stay wild."""
    from prismlake.functions.text import LOWER, UPPER, fold

    return texts.where(fold(F.col(column)).like("%" + needle.translate(str.maketrans(UPPER, LOWER)) + "%"))


def fuse(exact: DataFrame, semantic: DataFrame | None, allowed: DataFrame | None = None) -> DataFrame:
    """(id, score, rank): text hits first with score 1, then vector hits that aren't among them, both among allowed(id).

    exact(id), semantic(id, score); without an encoder semantic is None and only exact hits count.
    """
    exact = exact.select("id").distinct()
    if allowed is not None:
        exact = exact.join(allowed.select("id"), "id", "left_semi")
    rows = exact.select("id", F.lit(1.0).alias("score"), F.lit(0).alias("branch"))
    if semantic is not None:
        rest = semantic.join(exact, "id", "left_anti")
        if allowed is not None:
            rest = rest.join(allowed.select("id"), "id", "left_semi")
        rows = rows.unionByName(rest.select("id", F.col("score").cast("double"), F.lit(1).alias("branch")))
    # At most as many rows as the two limits allow.
    return rows.select("id", "score", F.row_number().over(Window.orderBy("branch", F.desc("score"), "id")).alias("rank"))


def hybrid(visible: DataFrame, texts: DataFrame, vectors: DataFrame, query: str, vector: list[float] | None, filtered: DataFrame | None, k: int = CONF.semantic_limit, least: float = CONF.semantic_min_score, most_text: int = CONF.text_limit) -> DataFrame:
    """(id, score, rank) for a text and filters that may both be missing; only visible(id, ...) media are shown.

    No text and no filter find nothing; filters alone give their media, newest first, with score 0 and no rank. Both
    limits apply before the filter of what is visible, so fewer hits may remain.
    """
    from prismlake.operators.similarity import topk

    if not query.strip():
        rows = filtered if filtered is not None else visible.limit(0)
        return rows.orderBy(F.col("dateTaken").desc_nulls_last(), F.desc("id")).select("id", F.lit(0.0).alias("score"), F.lit(None).cast("int").alias("rank"))
    shown = visible.select("id")
    exact = full_text(texts, query, most_text).select(F.col("mediaId").alias("id")).join(shown, "id", "left_semi")
    near = topk(vectors, vector, k, least, include=filtered).join(shown, "id", "left_semi") if vector is not None else None
    return fuse(exact, near, filtered)
