"""Vector cells: pivots fitted on a bounded sample, and the assignment of every vector to the cells it has to meet.

A vector's *home* is the pivot of highest cosine. It also visits another cell if a partner of cosine ``least`` could
well live there: seen from a vector x, such a partner is ``least * x`` plus a random direction of norm
``sqrt(1 - least^2)``, so it changes sides between two pivots only if x's own lead for its home is within ``spread``
standard deviations of what that direction contributes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismlake.tables import cut

#: Vectors the pivots are fitted on: about so many, or so many a cell (those of smallest hash of their id).
SAMPLE_ROWS, SAMPLE_PER_CELL = 16_384, 16
#: Beyond this many cells they hold more rows each, in more tiles: the work grows, the size of a task doesn't.
MAX_CELLS = 8_192
#: A cell expected to hold more rows than this, or to be visited by more, is compared tile by tile.
BLOCK_ROWS = 32_768
#: Bytes of placed vectors that a task should get.
TASK_BYTES = 4 << 20
#: A vector that more rows than this (and than 1/100,000 of all) have is compared once; see split_repeats.
REPEATS = 1_024
#: Groups: sampled vectors, the cosine that makes a sampled vector part of a dense place, and its least members.
GROUP_SAMPLE, PLACE_LEAST, PLACE_ROWS = 32_768, 0.55, 4
#: Of many vectors one of so many is sampled, up to so many in all: places of fewer rows are found, fewer rows are far from all.
GROUP_ONE_OF, GROUP_MOST = 12, 65_536
#: Pairs of pivots whose vectors are held beside each other.
PAIRS = 1 << 15


@dataclass(frozen=True)
class Pivots:
    centre: np.ndarray
    gap: np.ndarray
    #: By cell: rows to expect of its own, and visitors.
    held: np.ndarray
    met: np.ndarray

    @cached_property
    def blocks(self) -> np.ndarray:
        """In how many blocks a cell's own rows are."""
        return np.maximum(1, np.ceil(self.held / BLOCK_ROWS)).astype(np.int64)

    @cached_property
    def chunks(self) -> np.ndarray:
        """In how many chunks a cell's visitors are."""
        return np.maximum(1, np.ceil(self.met / BLOCK_ROWS)).astype(np.int64)

    @property
    def rows(self) -> int:
        """Rows to expect after placing."""
        return int(self.held @ (self.blocks + self.chunks - 1) + self.met @ self.blocks)

    def share(self, part: float) -> Pivots:
        """The same cells for a part of the rows, by which there are fewer tiles."""
        return Pivots(self.centre, self.gap, self.held * part, self.met * part)

    @property
    def dim(self) -> int:
        return self.centre.shape[1]

    @property
    def tiles(self) -> int:
        return int((self.blocks * (self.blocks + 1) // 2 + self.blocks * (self.chunks - 1)).sum())

    def kind(self, group: pa.Table) -> str:
        """What a group of placed rows is: `own` (a block with the first visitors), `inner` (two blocks), `outer` (a block and later visitors)."""
        cell, block, tile = (group.column(c)[0].as_py() for c in ("cell", "block", "tile"))
        return "own" if tile == block else "inner" if tile < self.blocks[cell] else "outer"


@dataclass(frozen=True)
class Groups(Pivots):
    """Cells of whole dense places, several to a cell, and a last cell for the rows that are far from every place.

    Rows near a place visit the other places where a partner could be; far rows visit places too, but no row visits the
    far cell: a pair of a near and a far row meets once, where the near row is at home, and is told to both (``back``).
    ``of``: the cell of each pivot; ``near``: the cosine to its pivot that a row at home in a place has at least.
    """

    of: np.ndarray
    near: float

    @property
    def far(self) -> int:
        return len(self.held) - 1

    def visiting(self, x: np.ndarray, least: float, spread: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Home of every unit vector of x, and (row, cell, back) of its visits to other cells.

        With whole(dim) as spread nothing can be missed: a partner y at home with pivot p is nearer to p than to x's own
        pivot h, so x's distance to the plane between them, (xh - xp) / |h - p|, is at most the sine of their angle; and
        from yp >= near and xp follows the most that xy can be. A smaller spread lets only so many standard deviations
        of the directions' other parts count (twice as many for the second).
        """
        m = len(x)
        if not len(self.centre):
            return np.full(m, self.far), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        score = x @ self.centre.T
        best = score.argmax(1)
        top = score[np.arange(m), best]
        home = np.where(top >= self.near, self.of[best], self.far)
        other = np.sqrt(1 - least**2)
        lead = min(1.01 * other, spread * other / least / np.sqrt(self.dim))
        may = score >= least_seen(self.near, least, min(1.0, 2 * spread / np.sqrt(self.dim))) - 1e-4
        row, pivot = np.nonzero(may)
        # By parts: with the vectors of all these pivots beside each other a driver's or worker's memory would not do.
        of = [np.einsum("ij,ij->i", self.centre[best[row[lo : lo + PAIRS]]], self.centre[pivot[lo : lo + PAIRS]]) for lo in range(0, len(row), PAIRS)]
        gap = np.sqrt(np.maximum(0, 2 - 2 * np.concatenate([np.zeros(0, np.float32), *of])))
        reached = top[row] - score[row, pivot] <= lead * gap + 1e-4
        both = np.unique(row[reached] * np.int64(len(self.held)) + self.of[pivot[reached]])
        row, cell = both // len(self.held), both % len(self.held)
        out = cell != home[row]
        row, cell = row[out], cell[out]
        return home, row, cell, home[row] == self.far


def least_seen(near: float, least: float, part: float) -> float:
    """The least cosine a of x to a pivot at which a y of cosine c >= near to it can have a c + part sqrt(1 - a^2) sqrt(1 - c^2) >= least."""
    a, c = np.linspace(-1, 1, 2001)[:, None], np.linspace(near, 1, 201)[None, :]
    can = (a * c + part * np.sqrt(1 - a**2) * np.sqrt(np.maximum(0, 1 - c**2)) >= least - 1e-3).any(1)
    return float(a[can.argmax(), 0]) - 1e-3 if can.any() else 2.0


def gather(vectors: DataFrame, n: int, dim: int, cell_rows: int, least: float, spread: float) -> Groups:
    """Groups for vectors(id, vec), n rows, all usable: about cell_rows rows a cell; least and spread as for place().

    Dense places are found on a bounded sample: a vector and what is near it, by turns. How near a row must be to be at
    home in one is chosen so that the fewest rows are placed.
    """
    part = min(1.0, max(GROUP_SAMPLE, min(GROUP_MOST, n // GROUP_ONE_OF)) / max(n, 1))
    sample = vectors if part == 1.0 else vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(np.ceil(part * (1 << 20))))
    found = sample.select("vec").toArrow()
    x = unit(matrix(found.column(0), dim), np.float32) if found.num_rows else np.zeros((0, dim), np.float32)
    x = x[np.random.default_rng(7).permutation(len(x))]
    scale, centre = n / max(len(x), 1), _places(x)
    some = x[:4096]
    score = some @ centre.T if len(centre) else np.zeros((len(some), 0), np.float32)
    best = score.max(1, initial=-1.0)
    tried = []
    for near in np.arange(0.6, 0.96, 0.02) if len(centre) and len(some) else []:
        far = best < near
        blocks = max(1, np.ceil(n * far.mean() / BLOCK_ROWS))
        seen = (score >= least_seen(near, least, min(1.0, 2 * spread / np.sqrt(dim)))).sum(1)
        tried.append((far.mean() * blocks + seen.mean(), near))
    near = float(min(tried)[1]) if tried else 1.0
    if not tried:
        return Groups(centre[:0], np.zeros((0, 0), np.float32), np.array([float(n)]), np.zeros(1), np.zeros(0, np.int64), near)
    at, most = _nearest(x, centre)
    own = np.bincount(at[most >= near], minlength=len(centre)) * scale
    order = np.argsort(_together(centre), kind="stable")
    cell = np.zeros(len(centre), np.int64)
    cell[order] = (np.cumsum(own[order]) - own[order]) // cell_rows
    cell = np.unique(cell, return_inverse=True)[1]
    k = int(cell.max()) + 1
    bare = Groups(centre, np.zeros((0, 0), np.float32), np.zeros(k + 1), np.zeros(k + 1), cell, near)
    held, met = np.zeros(k + 1), np.zeros(k + 1)
    for lo in range(0, len(x), 512):
        home, _, seen, _ = bare.visiting(x[lo : lo + 512], least, spread)
        held += np.bincount(home, minlength=k + 1)
        met += np.bincount(seen, minlength=k + 1)
    return Groups(centre, bare.gap, held * scale, met * scale, cell, near)


def _places(x: np.ndarray) -> np.ndarray:
    """Centres of the dense places of unit vectors x."""
    left, found = x, []
    skip = 0
    while skip < len(left):
        near = left @ left[skip] >= PLACE_LEAST
        near[skip] = True
        if near.sum() >= PLACE_ROWS:
            found.append(left[near].sum(0))
            skip -= int(near[:skip].sum())
            left = left[~near]
        else:
            skip += 1
    centre = np.array(found, np.float32).reshape(-1, x.shape[1])
    for _ in range(2 if len(centre) else 0):
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
        home, most = _nearest(x, centre)
        inside = most >= PLACE_LEAST
        sums = np.zeros_like(centre)
        np.add.at(sums, home[inside], x[inside])
        centre = np.where(np.abs(sums).sum(1, keepdims=True) > 0, sums, centre)
    return centre / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)


def _nearest(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pivot of highest cosine to each row of x, and that cosine; a part of x at a time."""
    at, most = np.zeros(len(x), np.int64), np.zeros(len(x), np.float32)
    for lo in range(0, len(x), 2048):
        score = x[lo : lo + 2048] @ centre.T
        at[lo : lo + 2048], most[lo : lo + 2048] = score.argmax(1), score.max(1)
    return at, most


def _together(centre: np.ndarray) -> np.ndarray:
    """A number for each centre, equal for those that are near each other, by turns."""
    label, close = np.full(len(centre), -1), centre @ centre.T >= 0.4
    for i in range(len(centre)):
        if label[i] < 0:
            label[close[i] & (label < 0)] = i
            label[i] = i
    return label


def usable(vec: Column, dim: int) -> Column:
    """Not null, of length dim, without null or NaN, norm above 1e-12."""
    square = F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.coalesce((F.size(vec) == dim) & (square > 1e-24) & (square < float("inf")), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column as rows of float32; lists must have length dim."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


def lists(x: np.ndarray) -> pa.Array:
    """The reverse of matrix."""
    n, dim = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32)), pa.array(np.ascontiguousarray(x, dtype=np.float32).ravel()))


def halves(x: np.ndarray) -> pa.Array:
    """Rows as half-precision bytes: enough to group vectors by, at half the size in a shuffle."""
    n, dim = x.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * 2 * dim, 2 * dim, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(x, dtype=np.float16))])


def from_halves(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The reverse of halves, as float32."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float16).reshape(-1, dim).astype(np.float32)


def unit(x: np.ndarray, kind: type = np.float64) -> np.ndarray:
    x = x.astype(kind)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))[:, None].astype(kind)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        home = np.concatenate([(x[i : i + 4096] @ centre.T).argmax(1) for i in range(0, len(x), 4096)])
        order = np.argsort(home, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(home[order]) > 0])
        sums = np.add.reduceat(x[order], starts, axis=0)
        present = home[order][starts]
        centre[present] = sums
        missing = np.setdiff1d(np.arange(k), present)
        centre[missing] = x[rng.choice(len(x), len(missing))]
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    return centre


def fit(vectors: DataFrame, n: int, dim: int, cell_rows: int, least: float = 1.0, spread: float = 0.0) -> Pivots:
    """Pivots for vectors(id, vec), n rows, all usable: one for about cell_rows rows; least and spread as for place().

    Equal vectors count once in the fit, so that one that many rows have doesn't draw pivots to itself.
    """
    wanted = int(min(MAX_CELLS, max(1, n // cell_rows)))
    part = min(1.0, max(SAMPLE_ROWS, SAMPLE_PER_CELL * wanted) / max(n, 1))
    sample = vectors if part == 1.0 else vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(np.ceil(part * (1 << 20))))
    found = sample.select("vec").toArrow()
    x = unit(matrix(found.column(0), dim), np.float32) if found.num_rows else np.zeros((0, dim), np.float32)
    once = x[np.unique(mixed(x), return_index=True)[1]] if len(x) else x
    k = int(min(wanted, max(1, len(once) // 8)))
    centre = spherical_kmeans(once, k) if len(x) else np.eye(1, dim, dtype=np.float32)
    centre = centre.astype(np.float32)
    gap = np.sqrt(np.maximum(0, 2 - 2 * (centre @ centre.T))).astype(np.float32)
    scale = n / max(len(x), 1)
    held, met = np.zeros(k), np.zeros(k)
    for lo in range(0, len(x), 4096):
        home, _, cell = visits(x[lo : lo + 4096], Pivots(centre, gap, held, held), least, spread)
        held += np.bincount(home, minlength=k)
        met += np.bincount(cell, minlength=k)
    return Pivots(centre, gap, held * scale, (met - held) * scale)


def visits(x: np.ndarray, pivots: Pivots, least: float, spread: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home of every unit vector of x, and (row, cell) of its visits, home included."""
    score = x @ pivots.centre.T
    home = score.argmax(1)
    lead = spread * np.sqrt(1 - least**2) / least / np.sqrt(pivots.dim)
    row, cell = np.nonzero(score >= score[np.arange(len(x)), home][:, None] - np.float32(lead) * pivots.gap[home])
    return home, row, cell


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of each row's bytes: equal vectors have equal hashes."""
    bits = np.ascontiguousarray(x).view(np.uint32).astype(np.uint64)
    odd = np.random.default_rng(11).integers(1, 1 << 62, x.shape[1], dtype=np.uint64) | np.uint64(1)
    h = (bits * odd).sum(1, dtype=np.uint64)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)


def place(vectors: DataFrame, pivots: Pivots, least: float, spread: float, keep: list[str] | None = None, visitors: str | None = None, half: bool = False) -> DataFrame:
    """vectors(id, vec, ...) as rows (cell, block, tile, home, id, vec, *keep): each vector at home and in the cells it visits.

    Groups of (cell, block, tile) have a bounded size: a cell's own rows are cut into blocks, its visitors into chunks.
    Group (b, b) holds block b as home rows and the first chunk of visitors; group (b, c) with another block c > b holds
    c's rows as visitors of b; further groups hold b and a later chunk of visitors. So every row meets every home row of
    the cells it visits once. visitors: boolean column; rows where it is false only go home. spread 0 sends every vector
    to its own block alone. With Groups a column back tells which visitors are met nowhere else. half: vec as unit vectors of half precision, see halves().
    """
    keep = keep or []
    types = dict(vectors.dtypes)
    schema = "cell int, block int, tile int, home boolean, id bigint, vec " + ("binary" if half else "array<float>") + ", back boolean" * isinstance(pivots, Groups) + "".join(f", {c} {types[c]}" for c in keep)

    def spans(row: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row so many times, and which time it is."""
        again = np.repeat(np.arange(len(row)), times)
        return again, np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = matrix(batch.column("vec").slice(lo, 4096), pivots.dim)
                score_of = unit(part, np.float32)
                hashed = mixed(part)
                back = None
                if isinstance(pivots, Groups):
                    home, row, cell, back = pivots.visiting(score_of, least, spread)
                elif spread:
                    home, row, cell = visits(score_of, pivots, least, spread)
                else:
                    home = (score_of @ pivots.centre.T).argmax(1)
                    row, cell = np.arange(0), np.arange(0)
                if visitors:
                    may = batch.column(visitors).slice(lo, 4096).to_numpy(zero_copy_only=False).astype(bool)[row]
                    row, cell = row[may], cell[may]
                out = cell != home[row]
                row, cell = row[out], cell[out]
                every, count = np.arange(len(part)), pivots.blocks[home]
                own = (hashed % count.astype(np.uint64)).astype(np.int64)
                found = [(every, home, own, own, True)]
                if spread:
                    again, nth = spans(every, count - 1)  # the other blocks of the cell
                    other = nth + (nth >= own[again])
                    low = np.minimum(other, own[again])
                    for is_home in (True, False):
                        side = (own[again] == low) == is_home
                        found += [(again[side], home[again[side]], low[side], np.maximum(other, own[again])[side], is_home)]
                    again, nth = spans(every, pivots.chunks[home] - 1)
                    found += [(again, home[again], own[again], count[again] + nth, True)]
                    again, nth = spans(row, pivots.blocks[cell])
                    chunk = ((hashed[row] >> np.uint64(7)) % pivots.chunks[cell].astype(np.uint64)).astype(np.int64)[again]
                    found += [(row[again], cell[again], nth, np.where(chunk == 0, nth, pivots.blocks[cell[again]] + chunk - 1), False)]
                r, c, b, t = (np.concatenate([f[i] for f in found]) for i in range(4))
                at_home = np.concatenate([np.full(len(f[0]), f[4]) for f in found])
                told = [] if back is None else [np.concatenate([np.zeros(len(r) - len(again), bool), back[again]])]  # visits come last
                for i in range(0, len(r), 8192):
                    s = slice(i, i + 8192)
                    take = pa.array(lo + r[s])
                    yield pa.RecordBatch.from_arrays([*(pa.array(v[s].astype(np.int32)) for v in (c, b, t)), pa.array(at_home[s]), batch.column("id").take(take), halves(score_of[r[s]]) if half else lists(part[r[s]]), *(pa.array(b[s]) for b in told), *(batch.column(k).take(take) for k in keep)], names=["cell", "block", "tile", "home", "id", "vec", *["back"] * len(told), *keep])

    return vectors.select("id", "vec", *dict.fromkeys([*keep, *([visitors] if visitors else [])])).mapInArrow(run, schema)


def visit(vectors: DataFrame, pivots: Pivots, least: float, spread: float, keep: list[str] | None = None) -> DataFrame:
    """vectors(id, vec, ...) as rows (cell, block, id, vec, *keep): one for every block of every cell visited, home included."""
    keep = keep or []
    types = dict(vectors.dtypes)
    schema = "cell int, block int, id bigint, vec array<float>" + "".join(f", {c} {types[c]}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = matrix(batch.column("vec").slice(lo, 2048), pivots.dim)
                _, row, cell = visits(unit(part, np.float32), pivots, least, spread)
                times = pivots.blocks[cell]
                again = np.repeat(np.arange(len(row)), times)
                block = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
                row, cell = row[again], cell[again]
                for i in range(0, len(row), 8192):
                    s = slice(i, i + 8192)
                    take = pa.array(lo + row[s])
                    yield pa.RecordBatch.from_arrays([pa.array(cell[s].astype(np.int32)), pa.array(block[s].astype(np.int32)), batch.column("id").take(take), lists(part[row[s]]), *(batch.column(k).take(take) for k in keep)], names=["cell", "block", "id", "vec", *keep])

    return vectors.select("id", "vec", *keep).mapInArrow(run, schema)


def tiled(placed: DataFrame, pivots: Pivots, row_bytes: int):
    """Placed rows grouped by tile, in about three times as many tasks as tiles, so that few share one; in fewer if tiles are small."""
    if pivots.tiles > 2:
        least = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        placed = placed.repartition(int(min(200_000, 3 * pivots.tiles, max(least, np.ceil(pivots.rows * row_bytes / TASK_BYTES)))), "cell", "block", "tile")
    return placed.groupBy("cell", "block", "tile")


def split_repeats(vectors: DataFrame, n: int, kept: int, on: tuple[str, ...] = ("vec",)) -> tuple[DataFrame, DataFrame | None]:
    """Rows that stand for all, and the rest: of a vector that very many ids of vectors(id, vec) have, the smallest ids stay.

    on: the columns in which rows must be equal, if others than the vector.

    The first table is vectors with a column weight: 1, or on the smallest id of such a vector the number of its ids less
    the other `kept` - 1 that stay. The second is (id, rep), rep being that smallest id; None if no vector repeats so often.
    Only numbers by hash (of 128 bits) are shuffled to find them; there are at most 100,000 such vectors, so what stays of
    them is broadcast. Repeated rows of an id count once among them.
    """
    often = max(REPEATS, n // 100_000, kept)
    once = cut(vectors.groupBy(F.xxhash64(*on).alias("_h")).agg(F.count("*").alias("c")).where(F.col("c") > often).select("_h"), "repeats")
    if once.isEmpty():
        return vectors.withColumn("weight", F.lit(1).cast("long")), None
    key = ["_h", "_g"]
    hashed = vectors.withColumns({"_h": F.xxhash64(*on), "_g": F.xxhash64(F.lit(7), *on)})
    hot = hashed.join(F.broadcast(once), "_h", "left_semi").groupBy(*key).agg(F.count("*").alias("c")).where(F.col("c") > often)
    hot = cut(hot.select(*key), "repeats-both")
    few = hashed.join(F.broadcast(hot), key, "left_anti").drop(*key).withColumn("weight", F.lit(1).cast("long"))
    many = hashed.join(F.broadcast(hot), key)
    ids = many.select(*key, "id").distinct()
    first = ids.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("id"))).where(F.col("_r") <= kept)
    first = cut(first.join(ids.groupBy(*key).agg(F.count("*").alias("_n")), key), "repeats-first")
    weight = F.when(F.col("_r") == 1, F.greatest(F.lit(1), F.col("_n") - (kept - 1))).otherwise(1).cast("long")
    stay = many.join(F.broadcast(first.select("id", weight.alias("weight"))), "id").dropDuplicates(["id"])
    rest = ids.join(F.broadcast(first.where("_r = 1").select(*key, F.col("id").alias("rep"))), key).join(F.broadcast(first.select("id")), "id", "left_anti")
    return few.unionByName(stay.select(*few.columns)), cut(rest.select("id", "rep"), "repeats-rest")
