"""Ground splits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudstrata.functions.joins import join_hot
from cloudstrata.operators.parameters import MOST_NODES
from cloudstrata.operators.profile import AXES, finite
from cloudstrata.session import cut

#: Nodes of a tile along an axis, and steps that tiles take between two exchanges of their edges.
TILE, STEPS = 512, 20


def ground_by_cell(points: DataFrame, cell: float | tuple[float, float], tolerance: float, by: list[str] | None = None) -> DataFrame:
    """Adds cx, cy, floor and ground: z at most a tolerance above the least z of the point's cell.

    The least z of cells is aggregated before the shuffle and joined back, so one
    full cell doesn't gather its points in a task.
    """
    by = by or []
    cx, cy = cell if isinstance(cell, tuple) else (cell, cell)
    celled = points.withColumns({"cx": F.floor(F.col("x") / F.lit(float(cx))), "cy": F.floor(F.col("y") / F.lit(float(cy)))})
    low = celled.groupBy(*by, "cx", "cy").agg(F.min("z").alias("floor"))
    return celled.join(low, [*by, "cx", "cy"]).withColumn("ground", F.col("z") - F.col("floor") <= F.lit(float(tolerance)))


def ground_summary(split: DataFrame, by: list[str]) -> DataFrame:
    """Cells, points, ground and other points, and the share of ground."""
    g = F.col("ground")
    return split.groupBy(*by).agg(F.countDistinct("cx", "cy").alias("cells"), F.count("*").alias("points"), F.count_if(g).alias("ground_points"), F.count_if(~g).alias("other_points")).withColumn("ground_fraction", F.col("ground_points") / F.col("points"))


def partition_counts(split: DataFrame, by: list[str]) -> DataFrame:
    """Points by core or context and ground or not."""
    g, c = F.col("ground"), F.col("core")
    return split.groupBy(*by).agg(*[F.count_if(a & b).alias(n) for n, a, b in (("core_ground", c, g), ("core_other", c, ~g), ("context_ground", ~c, g), ("context_other", ~c, ~g))])


#: How far above the cloud the cloth begins; the greatest move of a cloth at rest; how near the ground a node beside it is put on it.
ABOVE, AT_REST, BESIDE = 0.05, 0.005, 0.3


def _fall(height: np.ndarray, before: np.ndarray, movable: np.ndarray, floor: np.ndarray, rigidness: int, time_step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One step of a cloth: it falls, neighbours pull one another, and what has reached the ground stays. A node's next height depends on nodes at most 2 * rigidness away along each axis."""
    step = np.where(movable, (height - before) * 0.99 - 0.2 * time_step * time_step, 0)
    before, height = height, height + step
    for _ in range(rigidness):
        for axis in (0, 1):
            for start in (0, 1):  # pairs of neighbours that share no node
                a = [slice(None)] * 2
                b = [slice(None)] * 2
                n = height.shape[axis]
                a[axis], b[axis] = slice(start, n - 1, 2), slice(start + 1, n, 2)
                d = (height[tuple(b)] - height[tuple(a)]) / 2
                ma, mb = movable[tuple(a)], movable[tuple(b)]
                height[tuple(a)] += np.where(ma & mb, d, np.where(ma, 2 * d, 0)) * 0.5
                height[tuple(b)] -= np.where(ma & mb, d, np.where(mb, 2 * d, 0)) * 0.5
    hit = movable & (height <= floor)
    height[hit] = floor[hit]
    return height, before, movable & ~hit


def _settle(height: np.ndarray, movable: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes beside the ground that nearly reach it are put on it."""
    padded = np.pad(~movable, 1)
    beside = padded[2:, 1:-1] | padded[:-2, 1:-1] | padded[1:-1, 2:] | padded[1:-1, :-2]
    close = movable & beside & (height - floor < BESIDE)
    return np.where(close, floor, height), movable & ~close


def _filled(floor: np.ndarray) -> np.ndarray:
    """Nodes without points beside others take the height of the highest neighbour."""
    padded = np.pad(floor, 1, constant_values=-np.inf)
    near = np.max([padded[1 + dx : 1 + dx + floor.shape[0], 1 + dy : 1 + dy + floor.shape[1]] for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))], 0)
    return np.where(np.isfinite(floor), floor, near)


def cloth_mask(xyz: np.ndarray, resolution: float, threshold: float, rigidness: int, iterations: int, smooth: bool, time_step: float = 0.65) -> np.ndarray:
    """Cloth simulation filter (Zhang et al. 2016): a cloth falls on the cloud turned upside down; points near it are ground."""
    low = xyz.min(0)
    nx, ny = (np.floor((xyz.max(0)[:2] - low[:2]) / resolution).astype(int) + 6).tolist()
    if nx * ny > MOST_NODES:
        raise ValueError(f"the cloth would have {nx * ny} nodes, more than {MOST_NODES}")
    upside = -xyz[:, 2]
    gx, gy = (np.rint((xyz[:, k] - low[k]) / resolution).astype(int) + 2 for k in (0, 1))
    floor = np.full((nx, ny), -np.inf)
    np.maximum.at(floor, (gx, gy), upside)
    while not np.isfinite(floor).all():
        floor = _filled(floor)
    height = np.full((nx, ny), upside.max() + ABOVE)
    before, movable = height.copy(), np.ones((nx, ny), bool)
    for _ in range(iterations):
        height, before, movable = _fall(height, before, movable, floor, rigidness, time_step)
        if np.abs(height - before).max() < AT_REST:
            break
    if smooth:
        for _ in range(2):
            height, movable = _settle(height, movable, floor)
    return np.abs(height[gx, gy] - upside) < threshold


def ground_by_cloth(points: DataFrame, by: list[str], resolution: float = 1.0, threshold: float = 0.8, rigidness: int = 3, iterations: int = 500, smooth: bool = True, time_step: float = 0.65) -> DataFrame:
    """Adds ground by a cloth over each group. The cloth is global, so a group is one task's work: groups are regions of bounded size, as region() makes them."""
    columns = points.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id")
        return pdf.assign(ground=cloth_mask(pdf[[*AXES]].to_numpy(float), resolution, threshold, rigidness, iterations, smooth, time_step))

    kinds = dict(points.dtypes)
    return points.groupBy(*by).applyInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "ground boolean"]))


def ground_by_cloth_regions(points: DataFrame, by: list[str], span: float = 512.0, padding: float = 32.0, **cloth) -> DataFrame:
    """Adds ground to every point: squares of a fixed grid, each with padding around, are regions of a cloth each, and a point takes its own square's label."""
    squares = {}
    for a in ("x", "y"):
        first, last = (F.floor((F.col(a) + d) / F.lit(span)) for d in (-padding, padding))
        squares[a] = F.sequence(first, last)
    out = points.withColumn("__sx", F.explode(squares["x"])).withColumn("__sy", F.explode(squares["y"]))
    out = ground_by_cloth(out, [*by, "__sx", "__sy"], **cloth)
    own = (F.col("__sx") == F.floor(F.col("x") / F.lit(span))) & (F.col("__sy") == F.floor(F.col("y") / F.lit(span)))
    return out.filter(own).drop("__sx", "__sy")


def ground_by_cloth_tiles(
    points: DataFrame, by: list[str], resolution: float = 1.0, threshold: float = 0.8, rigidness: int = 3, iterations: int = 500, smooth: bool = True, time_step: float = 0.65, tile: int = TILE, steps: int = STEPS
) -> DataFrame:
    """Adds ground by one cloth over each group, however large: the same labels as cloth_mask gives for the whole group.

    Points are reduced to the nodes of the cloth's grid before the shuffle, so many points of a
    place take no room. The grid is dealt into tiles; in a round each tile takes `steps` steps in a window with
    the edges of its eight neighbours, so wide that nothing from beyond reaches the tile meanwhile, and
    keeps its own part, which is exact. Rounds go on until no node of any tile moves, and the last one is cut off
    at the step where the whole cloth rests. Nodes without points are filled, and the cloth is settled, in the same way.
    Points whose coordinates aren't finite aren't ground.
    """
    halo = 2 * rigidness * steps
    if halo > tile or tile % 2:
        raise ValueError("a tile has to be even, and as wide as 2 * rigidness * steps at least")
    kinds = dict(points.dtypes)
    whole = finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z"))
    sound = points.filter(whole)
    low = sound.groupBy(*by).agg(*[f(a).alias(f"__{n}{a}") for a in "xy" for n, f in (("lo", F.min), ("hi", F.max))], (F.max(-F.col("z")) + ABOVE).alias("__top"))
    size = [(F.floor((F.col(f"__hi{a}") - F.col(f"__lo{a}")) / resolution) + 6).cast("int").alias(f"__n{a}") for a in "xy"]
    extent = cut(low.select(*by, "__lox", "__loy", *size, "__top"), "cloth-extent")
    at = [(F.rint((F.col(a) - F.col(f"__lo{a}")) / resolution) + 2).cast("int").alias(f"__g{a}") for a in "xy"]
    placed_points = cut(sound.join(extent, by).select(*points.columns, *at), "cloth-points")
    nodes = placed_points.groupBy(*by, "__gx", "__gy").agg(F.max(-F.col("z")).alias("__floor"))
    tiles = [F.explode(F.sequence(F.lit(0), ((F.col(f"__n{a}") - 1) / tile).cast("int"))).alias(f"__t{a}") for a in "xy"]
    grid = extent.select("*", tiles[0]).select("*", tiles[1])
    inner = [F.floor(F.col(f"__g{a}") / tile).cast("int").alias(f"__t{a}") for a in "xy"]
    of_tile = nodes.select(*by, *inner, F.struct("__gx", "__gy", "__floor").alias("__node")).groupBy(*by, "__tx", "__ty").agg(F.collect_list("__node").alias("__nodes"))  # a tile's nodes
    group = ", ".join(f"`{b}` {kinds[b]}" for b in by)
    schema = f"{group}, __tx int, __ty int, __nx int, __ny int, __open long, __moves array<double>, __floor binary, __height binary, __before binary, __movable binary"
    state = cut(grid.join(of_tile, [*by, "__tx", "__ty"], "left").select(*by, "__tx", "__ty", "__nx", "__ny", "__top", "__nodes").mapInArrow(_laid(len(by), tile), schema), "cloth")
    run = lambda work, now: cut(now.mapInArrow(_edges(len(by), tile, halo), f"{group}, __tx int, __ty int, __dx int, __dy int, {schema.split(', ', len(by) + 2)[-1]}").groupBy(*by, "__tx", "__ty").applyInArrow(_round(len(by), tile, halo, work), schema), "cloth")

    def fill(floor, height, before, movable):
        for _ in range(halo):
            floor = _filled(floor)
        return floor, height, before, movable, []

    while state.agg(F.sum("__open")).first()[0]:
        state = run(fill, state)

    def fall(n: int) -> Callable:
        def work(floor, height, before, movable):
            states = []
            for _ in range(n):
                height, before, movable = _fall(height, before, movable, floor, rigidness, time_step)
                states.append(np.abs(height - before))
            return floor, height, before, movable, states

        return work

    done = 0
    while done < iterations and not state.isEmpty():
        n = min(steps, iterations - done)
        new = run(fall(n), state)
        moves = list(new.agg(*[F.max(F.col("__moves")[k]).alias(f"m{k}") for k in range(n)]).first())
        rests = next((k for k, m in enumerate(moves) if m < AT_REST), None)
        if rests is not None:
            state = new if rests + 1 == n else run(fall(rests + 1), state)
            break
        state, done = new, done + n
    if smooth and not state.isEmpty():

        def settle(floor, height, before, movable):
            for _ in range(2):
                height, movable = _settle(height, movable, floor)
            return floor, height, before, movable, []

        state = run(settle, state)
    heights = cut(state.mapInArrow(_heights(len(by), tile), f"{group}, __gx int, __gy int, __height double"), "cloth-heights")
    labelled = join_hot(placed_points, heights, [*by, "__gx", "__gy"])
    labelled = labelled.select(*points.columns, (F.abs(F.col("__height") + F.col("z")) < threshold).alias("ground"))
    return labelled.unionByName(points.filter(~whole).withColumn("ground", F.lit(False)))


def _grids(batch: pa.RecordBatch, row: int, tile: int, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """floor, height, before and movable of a tile's row, whose columns begin at `at`."""
    cell = lambda k, kind: np.frombuffer(batch.column(at + k)[row].as_py(), kind)
    nx, ny = (min(tile, batch.column(at - 4 + k)[row].as_py() - tile * batch.column(at - 6 + k)[row].as_py()) for k in range(2))
    return tuple(cell(k, kind).reshape(nx, ny) for k, kind in enumerate((np.float64, np.float64, np.float64, bool)))


def _row(head: list[pa.Array], open_nodes: int, moves: list[float], grids: tuple, names: list[str]) -> pa.RecordBatch:
    cells = [pa.array([g.tobytes()], pa.binary()) for g in grids]
    return pa.RecordBatch.from_arrays([*head, pa.array([open_nodes], pa.int64()), pa.array([moves], pa.list_(pa.float64())), *cells], names=names)


def _names(by: int, batch) -> list[str]:
    return [*batch.schema.names[:by], "__tx", "__ty", "__nx", "__ny", "__open", "__moves", "__floor", "__height", "__before", "__movable"]


def _laid(by: int, tile: int):
    """Tiles with their nodes' floors, and the cloth above all of them."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                tx, ty, nx, ny, top = (row.column(by + j)[0].as_py() for j in range(5))
                shape = (min(tile, nx - tile * tx), min(tile, ny - tile * ty))
                floor = np.full(shape, -np.inf)
                nodes = row.column(by + 5).flatten()
                if len(nodes):
                    gx, gy, z = (nodes.field(j).to_numpy(zero_copy_only=False) for j in range(3))
                    floor[gx - tile * tx, gy - tile * ty] = z
                height = np.full(shape, top)
                yield _row(row.columns[: by + 4], int((~np.isfinite(floor)).sum()), [], (floor, height, height, np.ones(shape, bool)), _names(by, batch))

    return run


def _edges(by: int, tile: int, halo: int):
    """Each tile for itself, and the parts of it that its neighbours need; dx and dy: where it lies from the one it is for."""

    def run(batches):
        for batch in batches:
            names = [*batch.schema.names[: by + 2], "__dx", "__dy", *batch.schema.names[by + 2 :]]
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                tx, ty, nx, ny = (row.column(by + j)[0].as_py() for j in range(4))
                grids = _grids(row, 0, tile, by + 6)
                for dx in (-1, 0, 1):
                    for dy in (-1, 0, 1):
                        ux, uy = tx - dx, ty - dy
                        if not (0 <= ux <= (nx - 1) // tile and 0 <= uy <= (ny - 1) // tile):
                            continue
                        part = tuple({-1: slice(max(0, n - halo), n), 0: slice(0, n), 1: slice(0, min(halo, n))}[d] for d, n in zip((dx, dy), grids[0].shape, strict=True))
                        cells = [pa.array([np.ascontiguousarray(g[part]).tobytes()], pa.binary()) for g in grids]
                        own = lambda v: pa.array([v], pa.int32())
                        yield pa.RecordBatch.from_arrays([*row.columns[:by], own(ux), own(uy), own(dx), own(dy), *row.columns[by + 2 : by + 6], *cells], names=names)

    return run


def _round(by: int, tile: int, halo: int, work: Callable):
    """A tile's window from its own grid and its neighbours' edges, worked on, and the tile's part of it."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        tx, ty = table.column(by)[0].as_py(), table.column(by + 1)[0].as_py()
        nx, ny = table.column(by + 4)[0].as_py(), table.column(by + 5)[0].as_py()
        total, start, shape, own = [], [], [], []
        for t, n in ((tx, nx), (ty, ny)):
            begin, end = tile * t, min(n, tile * (t + 1))
            start.append(max(0, begin - halo))
            shape.append(min(n, end + halo) - start[-1])
            own.append(slice(begin - start[-1], end - start[-1]))
            total.append((begin, end))
        window = [np.empty(shape, kind) for kind in (np.float64, np.float64, np.float64, bool)]
        for r in range(table.num_rows):
            place = []
            for axis, n in ((0, nx), (1, ny)):
                d = table.column(by + 2 + axis)[r].as_py()
                begin, end = total[axis]
                low, high = {-1: (max(begin - halo, max(0, begin - tile)), begin), 0: (begin, end), 1: (end, min(n, end + halo))}[d]
                place.append(slice(low - start[axis], high - start[axis]))
            size = tuple(s.stop - s.start for s in place)
            for k, kind in enumerate((np.float64, np.float64, np.float64, bool)):
                window[k][tuple(place)] = np.frombuffer(table.column(by + 8 + k)[r].as_py(), kind).reshape(size)
        *grids, moves = work(*window)
        part = tuple(own)
        kept = tuple(np.ascontiguousarray(g[part]) for g in grids)
        head = [table.column(k).slice(0, 1).combine_chunks() for k in (*range(by + 2), by + 4, by + 5)]
        out = _row([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in head], int((~np.isfinite(kept[0])).sum()), [float(m[part].max()) for m in moves], kept, _names(by, table))
        return pa.Table.from_batches([out])

    return run


def _heights(by: int, tile: int):
    """The nodes of tiles with their heights."""

    def run(batches):
        for batch in batches:
            names = [*batch.schema.names[:by], "__gx", "__gy", "__height"]
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                height = _grids(row, 0, tile, by + 6)[1]
                gx, gy = (g.ravel() + tile * row.column(by + j)[0].as_py() for j, g in enumerate(np.indices(height.shape)))
                group = [row.column(j).take(pa.array(np.zeros(height.size, np.int64))) for j in range(by)]
                yield pa.RecordBatch.from_arrays([*group, pa.array(gx, pa.int32()), pa.array(gy, pa.int32()), pa.array(height.ravel())], names=names)

    return run
