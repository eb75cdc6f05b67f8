"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors u, v with cosine >= c have squared distance at most D = 2 - 2c. After a rotation the
dimensions are cut into blocks; the squared block distances sum to the whole one, so in some
block the pair keeps within the block's proportional budget, D times the block's share of the
dimensions. Every block is range-joined under its budget: rows go to the grid cell of the block's
leading coordinates (cells a budget's radius wide) and visit the neighbouring cells that their ball
reaches; the pairs of a cell that keep the budget in the whole block are candidates, and the union
of candidates is verified on the whole vectors in double precision. A pair counts in the first block
whose budget it keeps, in one cell, so no pair needs to be shuffled to be counted once.

The rotation is that of the principal axes of a sample of at most SAMPLE distinct vectors, dealt over
the blocks in turn, so every block leads with axes along which the vectors lie far apart. Any rotation
gives the same links; the sample decides the work only. So does the number of grid coordinates, which
is that of the least cost for the number of vectors, measured on the sample: more vectors make finer grids.

Equal vectors are one class with a multiplicity. A cell's rows are dealt to chunk pairs of bounded
size, so a cell that holds a third of all rows is many tasks; tasks return link counts and a
spanning forest, never pairs. No cell or partner is capped.

Defined cases: null, empty and zero vectors and those with null or non-finite components link with
nothing and are kept; vectors of different lengths never link; a vec_id names one vector, and rows
that repeat it count as copies; null vec_ids are left out; an empty table gives an empty table; very
large and very small components are scaled by powers of two, so products neither overflow nor vanish.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .graph import components
from .grouping import map_groups
from .runtime import Scratch, cut_table

COSINE, BLOCK, LEAST_GRID, MOST_GRID = 0.95, 16, 2, 4
#: Vectors that the rotation and the grid are fitted to, at most.
SAMPLE = 2000
#: Seconds of a row placed in a cell and of a pair compared, about; they weigh the grids against each other.
PLACE_COST, PAIR_COST = 1e-5, 3e-9
CHUNK = 20_000
SLACK = 1e-7


@lru_cache(maxsize=8)
def random_rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(12345).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def fitted_rotation(sample: np.ndarray, width: int) -> np.ndarray:
    """Principal axes of unit vectors, the widest first, dealt over the blocks in turn."""
    dims = sample.shape[1]
    _, axes = np.linalg.eigh(np.cov(sample, rowvar=False).reshape(dims, dims))
    ranks = np.empty(dims, np.int64)
    blocks = blocks_of(dims, width)
    slots = sorted((place, b if place % 2 == 0 else -b, lo + place) for b, (lo, hi) in enumerate(blocks) for place in range(hi - lo))
    ranks[[slot for *_, slot in slots]] = np.arange(dims)
    return axes[:, ::-1][:, ranks]


def plan(sample: dict[int, np.ndarray], n: int, cosine: float, width: int, grid: int | None, chunk: int = CHUNK) -> dict[int, tuple[np.ndarray, int]]:
    """Rotation and grid coordinates of each length of vectors that the sample holds; n is the number of all vectors."""
    out, whole = {}, sum(map(len, sample.values()))
    for dims, rows in sample.items():
        rows = unit(rows)
        turn = fitted_rotation(rows, width) if len(rows) >= 2 * dims else random_rotation(dims)
        share, turned, costs = n * len(rows) / whole, rows @ turn, []
        most = min(MOST_GRID, width, dims)
        for g in range(min(LEAST_GRID, most), most + 1):
            placed = pairs = 0
            for b, (lo, hi) in enumerate(blocks_of(dims, width)):
                got = list(cells(turned, [(lo, hi)], (2 - 2 * cosine) * (hi - lo) / dims, g, dims_of_blocks=hi - lo))
                number, home = np.concatenate([x[2] for x in got]), np.concatenate([x[3] for x in got])
                _, at = np.unique(number, return_inverse=True)
                own, other = np.bincount(at, home), np.bincount(at, ~home)
                # rows of a cell go to every chunk pair of it
                size = (own + other) * (share / len(rows))
                placed += float((size * np.ceil(size / chunk)).sum())
                pairs += float((own * (own - 1) / 2 + own * other).sum())
            costs.append((PLACE_COST * placed + PAIR_COST * pairs * (share / len(rows)) ** 2, g))
        out[dims] = (turn, grid or min(costs)[1])
    return out


def blocks_of(dims: int, width: int = BLOCK) -> list[tuple[int, int]]:
    n = max(1, dims // width)
    edges = [dims * i // n for i in range(n + 1)]
    return list(zip(edges[:-1], edges[1:]))


def unpack(packed: pa.Array, dims: int) -> np.ndarray:
    """Rows of doubles from vectors packed as floats or doubles."""
    data, offsets = B.flat(packed)
    single = np.diff(offsets) == 4 * dims
    out = np.empty((len(single), dims))
    for narrow, kind in ((True, np.float32), (False, np.float64)):
        rows = np.flatnonzero(single == narrow)
        if len(rows) == len(single):
            return data.view(kind).reshape(-1, dims).astype(np.float64)
        if len(rows):
            out[rows] = np.frombuffer(b"".join(data[offsets[r] : offsets[r + 1]].tobytes() for r in rows), kind).reshape(-1, dims)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def cells(turned: np.ndarray, blocks: list[tuple[int, int]], room: float, grid: int, dims_of_blocks: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, rows, cell numbers, whether at home): each row's own cell and the later cells that its ball reaches."""
    dims = dims_of_blocks or turned.shape[1]
    for b, (lo, hi) in enumerate(blocks):
        budget = room * (hi - lo) / dims + SLACK
        radius, g = budget**0.5, min(grid, hi - lo)
        at = turned[:, lo : lo + g] / radius
        home = np.floor(at).astype(np.int64)
        within = at - home
        for shift in np.ndindex(*(3,) * g):
            step = np.array(shift) - 1
            # of two neighbouring cells the rows of one visit the other: the one whose first step is up
            first = step[np.flatnonzero(step)[:1]]
            if len(first) and first[0] < 0:
                continue
            gap = np.where(step > 0, 1 - within, np.where(step < 0, within, 0.0))
            rows = np.flatnonzero((gap * gap).sum(axis=1) <= 1 + SLACK)
            cell = home[rows] + step
            number = np.zeros(len(rows), np.int64)
            for d in range(g):
                number = (number << 15) + (cell[:, d] + (1 << 14))
            yield b, rows, number, np.full(len(rows), not len(first))


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest components near one; exact but for what would vanish beside these."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, of scaled rows."""
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def join_cell(group: pa.Table, cosine: float, width: int, turns: dict[int, tuple[np.ndarray, int]]) -> pa.RecordBatch | None:
    """Link counts and a spanning forest of one chunk pair of a cell: rows (vec, links, root)."""
    ids = group.column("vec").to_numpy()
    home = group.column("home").to_numpy()
    part = group.column("part").to_numpy()
    i, j, b = (group.column(c)[0].as_py() for c in ("i", "j", "block"))
    left, right = np.flatnonzero((part == i) & home), np.flatnonzero(part == j)
    # a row at home meets all rows of the other part, once
    sides = [(left, right)] if i == j else [(left, right), (np.flatnonzero((part == j) & home), np.flatnonzero((part == i) & ~home))]
    if not home.any() or len(ids) < 2:
        return None
    weight = group.column("copies").to_numpy()
    raw = scaled(unpack(group.column("vector").combine_chunks(), group.column("dims")[0].as_py()))
    turn, grid = turns_of(turns, raw.shape[1])
    turned = unit(raw) @ turn
    blocks, room = blocks_of(raw.shape[1], width), 2 - 2 * cosine
    budgets = [room * (hi - lo) / raw.shape[1] + SLACK for lo, hi in blocks]
    lo, hi = blocks[b]
    coarse = turned[:, lo:hi].astype(np.float32)
    half, one = -(coarse * coarse).sum(axis=1, keepdims=True) / 2, np.ones((len(ids), 1), np.float32)
    # products of these are minus half the squared distances, in single precision; the budget gets room for
    # its rounding here and is held in double precision below
    rows_of, columns_of = np.hstack((coarse, half, one)), np.hstack((coarse, one, half)).T
    least = np.float32(-(budgets[b] + 1e-5) / 2)
    counts = np.zeros(len(ids), np.int64)
    root = np.arange(len(ids))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    # both sides in the order of one more coordinate, so that a slab meets only what is in its reach
    along, reach = turned[:, min(lo + grid, hi - 1)], budgets[b] ** 0.5 + 1e-6

    def slabs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for own, others in sides:
            own, others = own[np.argsort(along[own], kind="stable")], others[np.argsort(along[others], kind="stable")]
            for s in range(0, len(own), 500):
                slab = own[s : s + 500]
                first, last = np.searchsorted(along[others], (along[slab[0]] - reach, along[slab[-1]] + reach))
                if last > first:
                    yield slab, others[first:last]

    for own, others in slabs():
        hits = np.flatnonzero(rows_of[own] @ columns_of[:, others] >= least)
        x, y = own[hits // len(others)], others[hits % len(others)]
        keep = (x < y) | (~home[y] & (ids[x] != ids[y])) if i == j else ids[x] != ids[y]
        x, y = x[keep], y[keep]
        for t in range(0, len(x), 200_000):
            p, q = x[t : t + 200_000], y[t : t + 200_000]
            inside = []
            for c in range(b + 1):
                d = turned[p, blocks[c][0] : blocks[c][1]] - turned[q, blocks[c][0] : blocks[c][1]]
                inside.append((d * d).sum(axis=1) <= budgets[c])
            first = inside[b] & ~np.logical_or.reduce([np.zeros(len(p), bool), *inside[:b]])
            p, q = p[first], q[first]
            link = exact_cosine(raw[p], raw[q]) >= cosine
            p, q = p[link], q[link]
            np.add.at(counts, p, weight[q])
            np.add.at(counts, q, weight[p])
            for u, v in zip(p.tolist(), q.tolist()):
                u, v = top(u), top(v)
                if u != v:
                    root[max(u, v)] = min(u, v)
    linked = np.flatnonzero(counts)
    if not len(linked):
        return None
    roots = np.array([ids[top(x)] for x in linked.tolist()])
    return pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(counts[linked]), pa.array(roots)], ["vec", "links", "root"])


def turns_of(turns: dict[int, tuple[np.ndarray, int]], dims: int) -> tuple[np.ndarray, int]:
    """Rotation and grid of a length; one that the sample does not hold is rare."""
    return turns.get(dims) or (random_rotation(dims), 1)


def links(vectors: DataFrame, scratch: Scratch, cosine: float = COSINE, width: int = BLOCK, grid: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(vec, links, root) partial link counts and forest edges of vectors (vec, copies, vector as doubles, dims), a table."""
    spark = vectors.sparkSession
    sample: dict[int, list] = {}
    for r in vectors.orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).select("vector", "dims").collect():
        sample.setdefault(r["dims"], []).append(bytes(r["vector"]))
    held = {d: unpack(pa.array(rows, pa.binary()), d) for d, rows in sample.items()}
    turns = spark.sparkContext.broadcast(plan(held, vectors.count(), cosine, width, grid, chunk))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for size in np.unique(dims):
                own = batch.filter(pa.array(dims == size))
                turn, g = turns_of(turns.value, int(size))
                turned = unit(unpack(own.column("vector"), int(size))) @ turn
                for b, rows, cell, home in cells(turned, blocks_of(int(size), width), 2 - 2 * cosine, g):
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([own.column("vec").take(pa.array(rows)), pa.array(np.full(n, int(size), np.int64)), pa.array(np.full(n, b, np.int64)), pa.array(cell), pa.array(home)], ["vec", "dims", "block", "cell", "home"])

    at = scratch.table(vectors.mapInArrow(place, "vec long, dims long, block long, cell long, home boolean"))
    spread = ["dims", "block", "cell"]
    full = at.groupBy(*spread).agg(F.ceil(F.count("*") / chunk).cast("long").alias("parts"), F.max("home").alias("any"), F.count("*").alias("n")).where("any and n > 1").drop("any", "n")
    rows = at.join(full, spread).withColumn("part", F.pmod(F.xxhash64("vec"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.select("vec", *spread, "home", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    rows = rows.join(vectors.drop("dims"), "vec").select("vec", *spread, "home", "part", "i", "j", "copies", "vector")
    return scratch.table(map_groups(rows, [*spread, "i", "j"], lambda group: join_cell(group, cosine, width, turns.value), "vec long, links long, root long"))


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes, of floats where these hold them exactly."""
    for batch in batches:
        lists = batch.column("v")
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(lists.offsets.to_numpy())
        ends = np.cumsum(sizes)
        with np.errstate(over="ignore"):
            single = bool((flat.astype(np.float32) == flat).all())
        flat = flat.astype(np.float32) if single else flat
        packed = [flat[e - s : e].tobytes() for s, e in zip(sizes, ends)]
        yield pa.RecordBatch.from_arrays([batch.column("vec"), batch.column("copies"), pa.array(packed, pa.binary()), pa.array(sizes.astype(np.int64))], ["vec", "copies", "vector", "dims"])


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, width: int = BLOCK, grid: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row."""
    rows = embeddings.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.size("v") > 0
    sound = sound & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(sound, F.transform("v", lambda x: x + 0.0)))
    with Scratch(embeddings.sparkSession, "subspace") as scratch:
        classes = scratch.table(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("vec"), F.count("*").alias("copies")))
        vectors = scratch.table(classes.mapInArrow(pack, "vec long, copies long, vector binary, dims long"))
        found = links(vectors, scratch, cosine, width, grid, chunk)
        label = components(found.select(F.col("vec").alias("a"), F.col("root").alias("b")), scratch)
        counts = found.groupBy("vec").agg(F.sum("links").alias("links"))
        classes = classes.join(counts, "vec", "left").join(label.withColumnRenamed("node", "vec"), "vec", "left")
        classes = classes.select("v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "vec").alias("component"))
        out = rows.join(classes, "v", "left")
        component = F.coalesce("component", "vec_id")
        return cut_table(out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept")), "links")
