"""Text rules: full-text tokens, album names and paths, ISO 6709 locations."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Characters that file systems of the FAT family forbid; root folders that may hold media of each type.
FORBIDDEN = r'[\\/:*?"<>|\x00-\x1f]'
ROOTS = {0: ("dcim", "pictures"), 1: ("dcim", "movies", "pictures")}


def fold(text: Column) -> Column:
    """Lower case of ASCII letters alone, as the index of the store folds."""
    return F.translate(text, UPPER, LOWER)


def tokens(text: Column) -> Column:
    return F.filter(F.split(fold(text), r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"), lambda t: t != "")


def query_terms(query: str) -> list[str]:
    """Prefixes to look for: words without signs, of at least two letters or digits."""
    cleaned = ("".join(c for c in w if c.isalnum()) for w in query.split())
    return [w.translate(str.maketrans(UPPER, LOWER)) for w in cleaned if len(w) >= 2]


def matches_all(text: Column, terms: list[str]) -> Column:
    """Every term starts some token; no terms match nothing."""
    if not terms:
        return F.lit(False)
    words = tokens(text)
    starts = lambda term: F.exists(words, lambda w: w.startswith(term))
    found = [starts(t) for t in terms]
    return F.coalesce(F.array_min(F.array(*found)), F.lit(False))


def album_name(name: Column) -> Column:
    """Blanks squeezed and trimmed; null where empty, over 100 characters, one or two dots or with forbidden signs."""
    clean = F.trim(F.regexp_replace(name, r"\s+", " "))
    bad = (F.length(clean) == 0) | (F.length(clean) > 100) | clean.rlike(FORBIDDEN) | clean.isin(".", "..")
    return F.when(~bad, clean)


def root_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"^([^/]*)", 1))


def parent_of(path: Column) -> Column:
    """The folder above, with its closing slash; empty at the top."""
    return F.regexp_extract(F.regexp_replace(path, r"/+$", ""), r"^(.*/)[^/]*$", 1)


def renamed(path: Column, name: Column) -> Column:
    """The path with its last folder called name; at the top it goes below Pictures."""
    parent = parent_of(path)
    return F.concat(F.when(parent == "", F.lit("Pictures/")).otherwise(parent), name, F.lit("/"))


def may_rename(path: Column) -> Column:
    """Whether the root can hold an album's files of any type."""
    return root_of(path).isin(*ROOTS[1])


def may_move(path: Column, media_type: Column) -> Column:
    """Whether the root can hold a file of this type."""
    test = F.lit(False)
    for kind, roots in ROOTS.items():
        test = test | ((media_type == kind) & root_of(path).isin(*roots))
    return test


def iso6709(text: Column) -> Column:
    """(latitude, longitude) of e.g. +55.7522+037.6156/; null where malformed, out of range or at 0, 0."""
    lat, lon = (F.regexp_extract(text, r"^([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)", i).try_cast("double") for i in (1, 2))
    ok = (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((F.abs(lat) < 1e-6) & (F.abs(lon) < 1e-6))
    return F.when(ok, F.struct(lat.alias("latitude"), lon.alias("longitude")))


def is_latin(text: str) -> bool:
    return all(ord(c) < 0x250 for c in text if c.isalpha())


def is_url(text: Column) -> Column:
    return F.lower(text).rlike(r"^https?://")


def normalise_name(name: str) -> str:
    return re.sub(r"\s+", " ", name).strip()
