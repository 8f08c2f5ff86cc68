"""Embedding near-duplicates: an exact metric range join by cosine.

Vectors become points on the unit sphere, where the angle is a metric. A bounded sample of pivots partitions them:
every vector lives in the cell of its nearest pivot. It may have partners in another cell, by the triangle inequality,
only if its angle to that pivot is at most the cell's radius plus the range, and at most its angle to its own pivot plus
twice the range.

Cells are laid out in blocks of bounded bytes: large cells are cut, neighbouring small ones share a block. A *tile* is a
pair of blocks and a task's piece of work: a vector goes to the tiles of its own block with each block that holds a cell
where it may have partners, and every pair of vectors meets in one tile only. Vectors travel packed, as many in a row as
one batch has for a tile. A vector is copied once a block, so blocks are large and cells, which only save products, small.

Inside a tile the cells are compared under the same conditions, and only where angles to the pivot differ by the range at
most. Products are first bounded from above: of rotated vectors, the product of the leading components plus the product of
the lengths of the rest is never less than the cosine (Cauchy and Schwarz), in single precision with its largest error
allowed for. Pairs that pass are computed in double precision, one by one, or by whole products where many pass. A tile
returns link counts and a spanning forest of its links, never the pairs.

Equal vectors are one node from the start and count with their number, so a vector that a third of all rows share
costs as much as any other. They are known by a 64-bit hash; that two different vectors of a billion share one has a
chance of about 3 in 100.

The sample only steers where work is done: any sample gives the same exact result. In data without structure the range
reaches into most cells, and the join nears the comparison of all pairs, the price of exactness there.

Defined results: a vector that is null, empty, zero or holds null or non-finite components links with nothing, is its
own component and is kept; vectors of different lengths don't link; a row without an id links with nothing, has no
component and is kept; rows that share an id are separate vectors of one component; an empty table gives an empty
result; extra input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargoscope.llm.common import cut
from cargoscope.llm.components import components

THRESHOLD = 0.9
#: Vectors drawn per length to choose pivots from, vectors per cell aimed at, least and most cells of a length.
PIVOT_SAMPLE = 2048
CELL_ROWS = 8192
LEAST_CELLS = 4
MOST_CELLS = 256
#: Most vectors and most bytes (as doubles) of a block; a length is cut in up to LEAST_BLOCKS of SMALL_BLOCK_ROWS at least.
BLOCK_ROWS = 32768
BLOCK_BYTES = 16 * 1024 * 1024
SMALL_BLOCK_ROWS = 2048
LEAST_BLOCKS = 12
#: Rows and columns of a tile whose products are held at once, and rows dealt to tiles at once.
STRIP_ROWS = 512
STRIP_COLUMNS = 1024
DEAL_ROWS = 4096
#: Bytes of packed vectors that are handed on at once, and that a task deals where every vector goes to every block.
PACKED_BYTES = 8 * 1024 * 1024
DEALT_BYTES = 64 * 1024 * 1024
#: Most partitions of the dealing and of the tiles.
MOST_TASKS = 20_000
#: Longest vectors that are rotated; of longer ones the components are taken as they come.
MOST_ROTATED = 512
#: Products of two components that one pair costs which passes the bound, and the share of pairs from which on a strip
#: is computed as a whole.
PASS_COST = 50_000
DENSE = 1 / 32
#: Links held before they are cut to a forest.
HELD_LINKS = 1 << 20
#: Most lengths that get pivots of their own; vectors of rarer lengths share one cell per length.
MOST_LENGTHS = 16

#: Covers the rounding of angles; it only adds work.
SLACK = 1e-6

_EDGE_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])
_PACKED = "tile long, dim long, block long, rep binary, weight binary, cell binary, vector binary"


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    m = flat.astype(np.float64).reshape(-1, dim)
    with np.errstate(over="ignore"):
        m = m / np.abs(m).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def choose_pivots(unit: np.ndarray, k: int) -> np.ndarray:
    """Farthest-first traversal: pivots spread over the sample, so dense groups get cells of their own."""
    chosen = [0]
    near = unit @ unit[0]
    while len(chosen) < min(k, len(unit)):
        nxt = int(np.argmin(near))
        chosen.append(nxt)
        near = np.maximum(near, unit @ unit[nxt])
    return unit[chosen]


def in_chain(pivots: np.ndarray) -> np.ndarray:
    """The pivots in an order in which each is followed by the nearest of those left, so that neighbours share blocks."""
    order, left = [0], np.ones(len(pivots), bool)
    left[0] = False
    while left.any():
        order.append(int(np.argmax(np.where(left, pivots @ pivots[order[-1]], -np.inf))))
        left[order[-1]] = False
    return pivots[order]


def shortening(unit: np.ndarray, threshold: float) -> tuple[np.ndarray | None, int]:
    """A rotation to the sample's principal components (None: none) and how many of them the bound takes: those by which
    the sample's pairs cost least, all of them if no fewer do."""
    dim = unit.shape[1]
    rotation = np.linalg.eigh(unit.T @ unit)[1][:, ::-1] if 1 < dim <= MOST_ROTATED else None
    turned = unit if rotation is None else unit @ rotation
    widths = sorted({max(1, dim * i // 16) for i in range(1, 17)})
    cost = {}
    for width in widths:
        x = shortened(turned, None, width)
        cost[width] = x.shape[1] + PASS_COST * (np.count_nonzero(x @ x.T >= threshold) - len(x)) / max(1, len(x) * (len(x) - 1))
    return rotation, min(widths, key=lambda w: (cost[w], w))


def shortened(unit: np.ndarray, rotation: np.ndarray | None, width: int) -> np.ndarray:
    """The leading ``width`` components after the rotation and the length of the rest."""
    turned = unit if rotation is None else unit @ rotation
    if width >= unit.shape[1]:
        return turned.astype(np.float32)
    rest = turned[:, width:]
    return np.concatenate([turned[:, :width], np.sqrt((rest * rest).sum(1, keepdims=True))], axis=1).astype(np.float32)


def _raw_by_length(batch: pa.RecordBatch):
    """Index and vectors of each length in a batch whose column 1 holds the vectors."""
    column = batch.column(1)
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.values)[column.offsets[0].as_py() : column.offsets[-1].as_py()] if len(column) else np.array([])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.array([], int)
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield int(dim), at, flat[(starts[at][:, None] + np.arange(dim)).ravel()].reshape(-1, int(dim))


def _by_length(batch: pa.RecordBatch):
    for dim, at, raw in _raw_by_length(batch):
        yield dim, at, _unit(raw, dim)


def _home(pivots):
    """mapInArrow: (rep, vector) -> rep, dim, home cell and the angle to its pivot."""

    def run(batches):
        for batch in batches:
            for dim, at, unit in _by_length(batch):
                if dim in pivots.value:
                    angles = _angles(unit, pivots.value[dim])
                    cell, angle = angles.argmin(1), angles.min(1)
                else:
                    cell, angle = np.zeros(len(at), int), np.zeros(len(at))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), dim)), pa.array(cell.astype(np.int64)), pa.array(angle)], names=["rep", "dim", "cell", "angle"])

    return run


def _spread(pivots, radii, reach: float):
    """(rep, vector) batches -> one row per vector, by its place in the batch, and cell that the vector must meet."""

    def run(batches):
        for batch in batches:
            for dim, at, unit in _by_length(batch):
                if dim in pivots.value:
                    angles = _angles(unit, pivots.value[dim])
                    own = angles.argmin(1)
                    radius = np.array([radii.get((dim, c), -np.inf) for c in range(angles.shape[1])])
                    member = _may_meet(angles, radius[None, :], angles.min(1)[:, None], reach)
                    member[np.arange(len(at)), own] = True
                    row, cell = np.nonzero(member)
                    home = own[row] == cell
                else:
                    row, cell, home = np.arange(len(at)), np.zeros(len(at), int), np.ones(len(at), bool)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[row])), pa.array(at[row]), pa.array(np.full(len(row), dim)), pa.array(cell.astype(np.int64)), pa.array(home)], names=["rep", "at", "dim", "cell", "home"])

    return run


def _may_meet(angle, radius, own, reach: float):
    """Whether a vector at ``angle`` to a cell's pivot and ``own`` to its own may have partners in the cell."""
    return (angle <= radius + reach + SLACK) & (angle <= own + 2 * reach + SLACK)


def lay_out(sizes: dict[tuple[int, int], int]) -> tuple[dict[tuple[int, int], tuple[int, int]], int, int]:
    """Vectors per (length, cell) -> first block and number of blocks of each, the number of all blocks and of tiles."""
    places, total, tiles = {}, 0, 0
    for dim in sorted({d for d, _ in sizes}):
        cells = [(c, n) for (d, c), n in sorted(sizes.items()) if d == dim]
        most = min(BLOCK_ROWS, max(1, BLOCK_BYTES // (8 * dim)), max(SMALL_BLOCK_ROWS, -(-sum(n for _, n in cells) // LEAST_BLOCKS)))
        start, filled = total, most
        for cell, n in cells:
            if filled + n > most:
                places[dim, cell], filled = (total, max(1, -(-n // most))), n
                total += places[dim, cell][1]
            else:
                places[dim, cell], filled = (total - 1, 1), filled + n
        tiles += (total - start) * (total - start + 1) // 2
    return places, total, tiles


def _deal(pivots, radii, reach: float, places, total: int):
    """mapInArrow: (rep, vector, weight) -> packed vectors of one block for one tile; see the module's text."""

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, DEAL_ROWS):
                part = batch.slice(begin, DEAL_ROWS)
                reps, weights = np.asarray(part.column(0)), np.asarray(part.column(2))
                for (dim, at, raw), met in zip(_raw_by_length(part), _spread(pivots, radii, reach)([part]), strict=True):
                    row, cell, home = (np.asarray(met.column(n)) for n in ("at", "cell", "home"))
                    cells = np.unique(cell)
                    first, blocks = np.array([places[dim, int(c)] for c in cells], np.int64)[np.searchsorted(cells, cell)].T
                    own, lives = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                    own[row[home]] = first[home] + (reps[row[home]].view(np.uint64) % blocks[home].astype(np.uint64)).astype(np.int64)
                    lives[row[home]] = cell[home]
                    # Each block that holds one of the vector's cells, once.
                    nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    row, block = np.divmod(np.unique(np.repeat(row, blocks) * total + np.repeat(first, blocks) + nth), total)
                    mine = own[row]
                    tile = np.minimum(mine, block) * total + np.maximum(mine, block)
                    order = np.lexsort((mine, tile))
                    row, mine, tile = row[order], mine[order], tile[order]
                    cuts = np.flatnonzero((np.diff(tile) != 0) | (np.diff(mine) != 0)) + 1
                    made, size = [], 0
                    for s, e in zip([0, *cuts], [*cuts, len(row)], strict=True):
                        r = row[s:e]
                        made.append((tile[s], dim, mine[s], reps[r].tobytes(), weights[r].tobytes(), lives[r].tobytes(), raw[np.searchsorted(at, r)].tobytes()))
                        size += len(made[-1][-1])
                        if size >= PACKED_BYTES or e == len(row):
                            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*made), [pa.int64()] * 3 + [pa.binary()] * 4, strict=True)], names=[f.split()[0] for f in _PACKED.split(", ")])
                            made, size = [], 0

    return run


def linked(x: np.ndarray, y: np.ndarray, raw_x: np.ndarray, raw_y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each pair's cosine reaches the threshold; pairs at the edge are computed one by one from the raw
    vectors, so that the result doesn't hang on how a block product is rounded. Products are held a strip at a time."""
    out = np.empty((len(x), len(y)), bool)
    for at in range(0, len(x), STRIP_ROWS):
        cos = x[at : at + STRIP_ROWS] @ y.T
        link = np.greater_equal(cos, threshold - 1e-12, out=out[at : at + STRIP_ROWS])
        rows, cols = np.nonzero(link)
        edge = cos[rows, cols] < threshold + 1e-12
        for i, j in zip(rows[edge], cols[edge], strict=True):
            link[i, j] = _reaches(raw_x[at + i], raw_y[j], threshold)
    return out


def _reaches(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    a, b = x.astype(np.float64), y.astype(np.float64)
    return float(a @ b) / (float(np.sqrt(a @ a)) * float(np.sqrt(b @ b))) >= threshold


def forest(link: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(node, smallest node reachable) pairs that connect what the link matrix connects; at most one per node."""
    rows, cols = link.any(1), link.any(0)
    link, left, right = link[rows][:, cols], left[rows], right[cols]
    lx, ly = left.copy(), right.copy()
    far = np.iinfo(np.int64).max
    while len(lx):
        nx = np.minimum(lx, np.where(link, ly[None, :], far).min(1))
        ny = np.minimum(ly, np.where(link, nx[:, None], far).min(0))
        if (nx == lx).all() and (ny == ly).all():
            break
        lx, ly = nx, ny
    pairs = np.concatenate([np.stack([left, lx], 1), np.stack([right, ly], 1)])
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (a, b) as a forest: each node but the smallest of its component, and that smallest one."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[x], root[y]
        apart = x != y
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (further := root[root]).tobytes() != root.tobytes():
            root = further
    low = root != np.arange(len(nodes))
    return nodes[low], nodes[root[low]]


def _places(passes: np.ndarray, size: int) -> np.ndarray:
    """The places of the few that are true of the first ``size``, looked for by eights."""
    eights = passes[: -(-size // 8) * 8].reshape(-1, 8)
    eights.ravel()[size:] = False
    some = np.flatnonzero(eights.view(np.uint64))
    row, column = np.nonzero(eights[some])
    return some[row] * 8 + column


class _Side:
    """The vectors of a tile that live in one of its blocks; ``links`` counts their partners."""

    def __init__(self, chunks: list[tuple], dim: int, dtype, pivots: np.ndarray | None, shape: tuple) -> None:
        self.rep, self.weight, self.cell = (np.concatenate([np.frombuffer(c[i], np.int64) for c in chunks]) for i in range(3))
        self.raw = np.concatenate([np.frombuffer(c[3], dtype) for c in chunks]).reshape(-1, dim)
        self.unit = _unit(self.raw, dim)
        self.short = shortened(self.unit, *shape)
        self.own = np.zeros(len(self.rep)) if pivots is None else np.arccos(np.clip(np.einsum("ij,ij->i", self.unit, pivots[self.cell]), -1.0, 1.0))
        self.links = np.zeros(len(self.rep), np.int64)


class _Tile:
    """Finds the links between two sides, or inside one."""

    def __init__(self, x: _Side, y: _Side, threshold: float) -> None:
        self.x, self.y, self.threshold = x, y, threshold
        # Products of unit vectors in single precision: each component and each sum is off by 2**-24 of it at most.
        self.low = np.float32(threshold - (x.short.shape[1] + 8) * 2.0**-23)
        self.ends: tuple[list, list] = [], []
        self.held = 0
        # Held for all strips: pages that are new to the process cost more than the products.
        self.bounds, self.passes = np.empty(STRIP_ROWS * STRIP_COLUMNS, np.float32), np.empty(STRIP_ROWS * STRIP_COLUMNS, bool)

    def compare(self, pivots: np.ndarray | None, radius: Callable[[int], float], reach: float) -> None:
        x, y = self.x, self.y
        for cell in np.unique(y.cell):
            ys = np.flatnonzero(y.cell == cell)
            ys = ys[np.argsort(y.own[ys], kind="stable")]
            if x is y:
                self.strips(ys, y.own[ys], ys, reach, upper=True)
                xs = np.flatnonzero(x.cell < cell)
            else:
                xs = np.arange(len(x.rep))
            if pivots is None:
                angle = np.zeros(len(xs))
            else:
                angle = _angles(x.unit[xs], pivots[[cell]])[:, 0]
                near = (x.cell[xs] == cell) | _may_meet(angle, radius(int(cell)), x.own[xs], reach)
                xs, angle = xs[near], angle[near]
            order = np.argsort(angle, kind="stable")
            self.strips(xs[order], angle[order], ys, reach)

    def strips(self, xs: np.ndarray, angle: np.ndarray, ys: np.ndarray, reach: float, upper: bool = False) -> None:
        """Vectors ``xs``, ordered by their ``angle`` to a pivot, with ``ys``, ordered by theirs; ``upper``: with later ones."""
        left, right, own = self.x.short[xs], self.y.short[ys], self.y.own[ys]
        for s in range(0, len(xs), STRIP_ROWS):
            e = min(len(xs), s + STRIP_ROWS)
            begin, end = np.searchsorted(own, [angle[s] - reach - SLACK, angle[e - 1] + reach + SLACK])
            for t in range(max(begin, s) if upper else begin, end, STRIP_COLUMNS):
                u = min(end, t + STRIP_COLUMNS)
                size = (e - s) * (u - t)
                bounds = np.matmul(left[s:e], right[t:u].T, out=self.bounds[:size].reshape(e - s, u - t))
                np.greater_equal(bounds, self.low, out=self.passes[:size].reshape(e - s, u - t))
                passed = _places(self.passes, size)
                if len(passed) > DENSE * size:
                    self.whole(xs[s:e], ys[t:u], t - s if upper else None)
                elif len(passed):
                    row, column = np.divmod(passed, u - t)
                    if upper:
                        later = t + column > s + row
                        row, column = row[later], column[later]
                    self.some(xs[s:e][row], ys[t:u][column])

    def some(self, i: np.ndarray, j: np.ndarray) -> None:
        x, y = self.x, self.y
        for at in range(0, len(i), STRIP_ROWS * 16):
            a, b = i[at : at + STRIP_ROWS * 16], j[at : at + STRIP_ROWS * 16]
            cos = np.einsum("ij,ij->i", x.unit[a], y.unit[b])
            link = cos >= self.threshold - 1e-12
            for k in np.flatnonzero(link & (cos < self.threshold + 1e-12)):
                link[k] = _reaches(x.raw[a[k]], y.raw[b[k]], self.threshold)
            a, b = a[link], b[link]
            np.add.at(x.links, a, y.weight[b])
            np.add.at(y.links, b, x.weight[a])
            self.hold(x.rep[a], y.rep[b])

    def whole(self, i: np.ndarray, j: np.ndarray, ahead: int | None) -> None:
        x, y = self.x, self.y
        link = linked(x.unit[i], y.unit[j], x.raw[i], y.raw[j], self.threshold)
        if ahead is not None:
            link &= np.arange(len(j))[None, :] + ahead > np.arange(len(i))[:, None]
        as_numbers = link.astype(np.float64)  # whole numbers far below 2**53
        x.links[i] += (as_numbers @ y.weight[j].astype(np.float64)).astype(np.int64)
        y.links[j] += (x.weight[i].astype(np.float64) @ as_numbers).astype(np.int64)
        self.hold(*forest(link, x.rep[i], y.rep[j]).T)

    def hold(self, a: np.ndarray, b: np.ndarray) -> None:
        for ends, more in zip(self.ends, (a, b), strict=True):
            ends.append(more)
        self.held += len(a)
        if self.held > HELD_LINKS:
            a, b = self.forest()
            self.ends, self.held = ([a], [b]), len(a) // 2

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate([*ends, np.array([], np.int64)]) for ends in self.ends)
        return spanning(a, b)

    def found(self) -> pa.RecordBatch:
        """Link counts (b is -1) and the forest of the links (links is 0)."""
        a, b = self.forest()
        parts = [(side.rep[side.links > 0], side.links[side.links > 0]) for side in ([self.x] if self.x is self.y else [self.x, self.y])]
        counted = sum(len(rep) for rep, _ in parts)
        columns = [np.concatenate([*[rep for rep, _ in parts], a]), np.concatenate([np.full(counted, -1), b]), np.concatenate([*[n for _, n in parts], np.zeros(len(a), np.int64)])]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], schema=_EDGE_SCHEMA)


def _join(pivots, shapes, radii, reach: float, threshold: float, dtype, total: int):
    """mapInArrow over packed vectors, ordered by tile: link counts per vector (b is -1) and forest edges (links is 0)."""

    def joined(dim: int, sides: dict[int, list[tuple]], twin: bool):
        if twin or len(sides) == 2:
            own = pivots.value.get(dim)
            made = [_Side(chunks, dim, dtype, own, shapes.value.get(dim, (None, dim))) for chunks in sides.values()]
            tile = _Tile(made[0], made[-1], threshold)
            tile.compare(own, lambda cell: radii.get((dim, cell), -np.inf), reach)
            yield tile.found()

    def run(batches):
        last, sides = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                tile, dim, block, *chunk = (c[i].as_py() for c in batch.columns)
                if last and tile != last[0]:
                    yield from joined(last[1], sides, last[2])
                    sides = {}
                # A tile of one block gets all of the block's vectors, another one those that may have partners.
                last = (tile, dim, tile // total == tile % total)
                sides.setdefault(block, []).append(tuple(chunk))
        if last:
            yield from joined(last[1], sides, last[2])

    return run


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``embeddings`` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    spark = embeddings.sparkSession
    kind = "array<float>" if "float" in embeddings.schema["embedding"].dataType.simpleString() else "array<double>"
    rows = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), embeddings["embedding"].cast(kind).alias("vector"))
    big = F.lit(float("inf"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & fine, F.lit(False)))
    # Node numbers: the smallest id may stand for several vectors when ids repeat, so a hash of the vector is the node.
    node = F.xxhash64(F.size("vector"), F.to_json(F.struct("vector")))
    rows = cut(rows.withColumn("rep", F.when(F.col("fine"), node)))
    nodes = rows.where("fine").groupBy("rep").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"), F.any_value("vector").alias("vector"))
    nodes = cut(nodes)

    counts = nodes.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(MOST_LENGTHS).collect()
    pivots, shapes = {}, {}
    for dim, n in counts:
        k = min(MOST_CELLS, max(LEAST_CELLS, n // CELL_ROWS))
        sample = nodes.where(F.size("vector") == dim).orderBy(F.xxhash64("rep", F.lit(1))).limit(PIVOT_SAMPLE).select("vector").collect()
        unit = _unit(np.array([r["vector"] for r in sample], np.float64).ravel(), dim)
        pivots[dim], shapes[dim] = in_chain(choose_pivots(unit, k)), shortening(unit, threshold)
    shared = spark.sparkContext.broadcast(pivots)  # at most MOST_LENGTHS * MOST_CELLS vectors
    shapes = spark.sparkContext.broadcast(shapes)  # at most MOST_LENGTHS matrices of MOST_ROTATED rows

    reach = float(np.arccos(min(1.0, max(-1.0, threshold))))
    homes = nodes.select("rep", "vector").mapInArrow(_home(shared), "rep long, dim long, cell long, angle double")
    # At most MOST_CELLS rows for each of MOST_LENGTHS lengths and one for each other length; N lengths take N * N / 2 numbers.
    cells = homes.groupBy("dim", "cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()
    radii = {(r["dim"], r["cell"]): r["radius"] for r in cells if r["dim"] in pivots}
    places, total, tiles = lay_out({(r["dim"], r["cell"]): r["n"] for r in cells})
    dealt = sum(r["n"] * r["dim"] for r in cells) * 8 * total
    hands = min(MOST_TASKS, -(-dealt // DEALT_BYTES), -(-sum(r["n"] for r in cells) // DEAL_ROWS))
    packed = nodes.select("rep", "vector", "weight").repartition(max(1, hands), "rep").mapInArrow(_deal(shared, radii, reach, places, total), _PACKED)
    # By number: a tile's work grows faster than its bytes, by which partitions would be put together.
    by_tile = packed.repartition(min(MOST_TASKS, max(1, 2 * tiles)), "tile").sortWithinPartitions("tile")
    found = cut(by_tile.mapInArrow(_join(shared, shapes, radii, reach, threshold, np.float32 if kind == "array<float>" else np.float64, total), "a long, b long, links long"))

    links = found.where("links > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("others"))
    first = nodes.select("rep", "first", "weight")
    edges = found.where("links = 0").select("a", "b").distinct()
    ends = edges.join(first.select(F.col("rep").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("rep").alias("b"), F.col("first").alias("y")), "b")
    labels = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    known = first.join(links, "rep", "left").join(labels.withColumnRenamed("node", "first"), "first", "left")
    known = known.select("rep", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "first").alias("c"))
    out = rows.drop("vector").join(known, "rep", "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
