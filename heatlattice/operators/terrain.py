"""Elevation grids, route profiles and what they cost."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heatlattice.functions import physics as p
from heatlattice.functions.params import GROUND, Ground
from heatlattice.operators.graph import BLOCK, KEY, blocks_of_two, both_ways, canonical, forest_of, spanning_tree, spanning_tree_of_points, spread_groups, spread_networks
from heatlattice.storage import stored

SPACING = 25.0


#: Cells of a tile's side, and bytes of tiles that may be broadcast.
TILE, BROADCAST_BYTES = 32, 16_000_000


def tiled(dem: DataFrame, nx: int, ny: int) -> DataFrame:
    """ti, tj, zs: the grid (i, j, z; a row a cell) in square tiles, row by row, with the first cells of the next ones."""
    near = lambda c: F.expr(f"if({c} % {TILE} = 0 and {c} > 0, array({c} div {TILE}, {c} div {TILE} - 1), array({c} div {TILE}))")
    cells = dem.select(F.explode(near("i")).alias("ti"), "i", "j", "z").select("ti", F.explode(near("j")).alias("tj"), "i", "j", "z")
    rows = cells.groupBy(F.col("ti").cast("int").alias("ti"), F.col("tj").cast("int").alias("tj")).agg(F.array_sort(F.collect_list(F.struct("i", "j", "z"))).alias("zs"))
    return rows.select("ti", "tj", "zs.z").withColumnRenamed("z", "zs")


def sampled(points: DataFrame, dem: DataFrame, x0: float, y0: float, step: float, nx: int, ny: int) -> DataFrame:
    """points (x, y, ...) with bilinear z from dem (i, j, z), a whole grid of at least two by two cells; points outside take the border.

    A point meets the tile that holds its four corners, and reads them from the array. The size of the grid says how many
    bytes of tiles there are: up to BROADCAST_BYTES they go to the points, beyond that points are shuffled by tile.
    """
    place = lambda c, at, n: F.least(F.greatest((F.col(c) - at) / step, F.lit(0.0)), F.lit(n - 1.0001))
    rest = points.columns
    own = points.withColumn("fi", place("x", x0, nx)).withColumn("fj", place("y", y0, ny))
    own = own.withColumns({"i0": F.floor("fi").cast("int"), "j0": F.floor("fj").cast("int")})
    own = own.withColumns({"ti": F.expr(f"cast(i0 div {TILE} as int)"), "tj": F.expr(f"cast(j0 div {TILE} as int)"), "tx": F.col("fi") - F.col("i0"), "ty": F.col("fj") - F.col("j0")})
    tiles = tiled(dem, nx, ny)
    joined = own.join(F.broadcast(tiles) if small((x0, y0, step, nx, ny)) else tiles, ["ti", "tj"])
    wide = f"(least((tj + 1) * {TILE}, {ny - 1}) - tj * {TILE} + 1)"
    corner = lambda di, dj: f"zs[(i0 + {di} - ti * {TILE}) * {wide} + j0 + {dj} - tj * {TILE}]"
    z = f"{corner(0, 0)} * (1 - tx) * (1 - ty) + {corner(1, 0)} * tx * (1 - ty) + {corner(0, 1)} * (1 - tx) * ty + {corner(1, 1)} * tx * ty"
    return joined.select(*rest, F.expr(z).alias("z"))


def profile(routes: DataFrame, spacing: float = SPACING) -> DataFrame:
    """network_id, u, v, k, length, chainage, x, y of equally spaced points on straight routes (ux, uy) to (vx, vy)."""
    out = routes.withColumn("length", F.sqrt(F.pow(F.col("vx") - F.col("ux"), 2) + F.pow(F.col("vy") - F.col("uy"), 2)))
    out = out.withColumn("n", F.greatest(F.lit(2), F.ceil(F.col("length") / spacing).cast("int") + 1))
    out = out.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("t", F.col("k") / (F.col("n") - 1))
    return out.select(KEY, "u", "v", "k", "length", (F.col("t") * F.col("length")).alias("chainage"), *((F.col(f"u{c}") + F.col("t") * (F.col(f"v{c}") - F.col(f"u{c}"))).alias(c) for c in "xy"))


def metrics(samples: DataFrame, grounds: dict[str, Ground] | None = None, scales: dict[int, float] | None = None) -> DataFrame:
    """l2d, l3d, w, dz, climb, max_slope, mean_slope, feasible, z_low, z_high of every route from its samples with z.

    ``grounds`` names further weights, of other slope factors; like w they are infinite where a route is infeasible.
    ``scales`` gives each route a row for each number, with its heights scaled by the factor (about 0; ``scale`` is the number).
    Samples of a route are gathered as one sorted array (its length bounds it), so that no window is needed.
    """
    at = F.array_sort(F.collect_list(F.struct("k", "chainage", "z"))).alias("s")
    routes = samples.groupBy(KEY, "u", "v").agg(at, F.min("z").alias("z_low"), F.max("z").alias("z_high"))
    more = []
    if scales:
        factors = F.array(*(F.struct(F.lit(i).alias("scale"), F.lit(f).alias("f")) for i, f in scales.items()))
        routes = routes.withColumn("x", F.explode(factors)).select(KEY, "u", "v", "s", "z_low", "z_high", "x.*")
        routes = routes.withColumn("s", F.expr("transform(s, p -> named_struct('k', p.k, 'chainage', p.chainage, 'z', p.z * f))"))
        routes, more = routes.withColumns({"z_low": F.col("z_low") * F.col("f"), "z_high": F.col("z_high") * F.col("f")}), ["scale"]
    steps = "transform(sequence(1, size(s) - 1), i -> named_struct('h', s[i].chainage - s[i - 1].chainage, 'v', s[i].z - s[i - 1].z))"
    graded = f"transform({steps}, x -> named_struct('l', sqrt(x.h * x.h + x.v * x.v), 'g', if(x.h > 0, abs(x.v) / x.h, 0e0), 'v', x.v))"
    total = lambda body: F.expr(f"aggregate(g, 0e0, (a, x) -> a + {body})")
    out = routes.withColumn("g", F.expr(graded))
    out = out.select(
        KEY, "u", "v", *more, "z_low", "z_high",
        F.expr("s[size(s) - 1].chainage").alias("l2d"),
        total("x.l").alias("l3d"),
        total(f"x.l * {p.slope_factor('x.g')}").alias("weight"),
        *(total(f"x.l * {p.slope_factor('x.g', g)}").alias(c) for c, g in (grounds or {}).items()),
        F.expr("s[size(s) - 1].z - s[0].z").alias("dz"),
        total("greatest(x.v, 0e0)").alias("climb"),
        F.expr("aggregate(g, 0e0, (a, x) -> greatest(a, x.g))").alias("max_slope"),
        total("x.g * x.l").alias("slope_sum"),
    )
    out = out.withColumn("mean_slope", F.col("slope_sum") / F.greatest("l3d", F.lit(1e-9))).withColumn("feasible", F.col("max_slope") <= GROUND.steepest)
    finite = lambda c: F.when(F.col("feasible"), F.col(c)).otherwise(F.lit(float("inf")))
    return out.withColumns({"w": finite("weight")} | {c: finite(c) for c in grounds or {}}).drop("slope_sum", "weight")


def all_routes(nodes: DataFrame, dem: DataFrame, grid: tuple[float, float, float, int, int], spacing: float = SPACING, grounds: dict[str, Ground] | None = None, scales: dict[int, float] | None = None) -> DataFrame:
    """metrics() of the straight route between every two nodes of a network.

    Tiles of up to BROADCAST_BYTES go to the blocks of pairs that lie on them, where routes are sampled: neither pairs nor samples
    are shuffled. Samples of larger grids are shuffled by tile.
    """
    if not small(grid):
        return sampled_routes(nodes, dem, grid, spacing, grounds, scales)
    return by_blocks(nodes, dem, grid, spacing, grounds, scales, lambda routes: routes)


def sampled_routes(nodes: DataFrame, dem: DataFrame, grid: tuple[float, float, float, int, int], spacing: float, grounds: dict[str, Ground] | None, scales: dict[int, float] | None) -> DataFrame:
    """all_routes() with a row for every sample."""
    a, b = ends(nodes)
    return metrics(sampled(profile(a.join(b, KEY).filter("u < v"), spacing), dem, *grid), grounds, scales)


def by_blocks(nodes: DataFrame, dem: DataFrame, grid: tuple[float, float, float, int, int], spacing: float, grounds: dict[str, Ground] | None, scales: dict[int, float] | None, kept: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Those rows of all_routes() that are kept of every two blocks of nodes."""
    nx, ny = grid[3:]
    block = max(1, int(BLOCK / len(scales or [1]) ** 0.5))
    points = stored(blocks_of_two(nodes, block))
    tiles = tiles_under(points, dem, grid)
    names = [*(grounds or {})]

    def run(points: pd.DataFrame, tiles: pd.DataFrame) -> pd.DataFrame:
        a, b = points[points.side == 0], points[points.side == 1]
        if points.i.iloc[0] == points.j.iloc[0]:
            p, q = np.triu_indices(len(a), 1)
            a = b = a.sort_values("node")
        else:
            p, q = (c.ravel() for c in np.indices((len(a), len(b))))
        node, x, y = (np.stack([a[c].to_numpy()[p], b[c].to_numpy()[q]]) for c in ("node", "x", "y"))
        turned = node[0] > node[1]
        for c in (node, x, y):
            c[:, turned] = c[::-1, turned]
        apart = node[0] < node[1]
        out = measured(node[:, apart], x[:, apart], y[:, apart], heights(tiles, nx, ny), grid, spacing, grounds or {}, scales)
        out.insert(0, KEY, points[KEY].iloc[0])
        return kept(out)

    kind = dict(nodes.dtypes)[KEY]
    scale = "scale int, " if scales else ""
    shape = f"{KEY} {kind}, u long, v long, {scale}z_low double, z_high double, l2d double, l3d double, {''.join(f'{c} double, ' for c in names)}dz double, climb double, max_slope double, mean_slope double, feasible boolean, w double"
    return spread_groups(points).groupBy(KEY, "i", "j").cogroup(spread_groups(tiles).groupBy(KEY, "i", "j")).applyInPandas(run, shape)


def tiles_under(points: DataFrame, dem: DataFrame, grid: tuple[float, float, float, int, int]) -> DataFrame:
    """The tiles under the points (x, y) of every two blocks i, j of a network."""
    x0, y0, step, nx, ny = grid
    tile = lambda c, at, n: F.expr(f"cast(floor(least(greatest(({c} - {at!r}D) / {step!r}D, 0D), {n - 1.0001!r}D)) / {TILE} as int)")
    box = points.select(KEY, "i", "j", tile("x", x0, nx).alias("ti"), tile("y", y0, ny).alias("tj")).groupBy(KEY, "i", "j")
    box = box.agg(F.min("ti").alias("t0"), F.max("ti").alias("t1"), F.min("tj").alias("s0"), F.max("tj").alias("s1"))
    wanted = box.select(KEY, "i", "j", F.explode(F.expr("sequence(t0, t1)")).alias("ti"), "s0", "s1").select(KEY, "i", "j", "ti", F.explode(F.expr("sequence(s0, s1)")).alias("tj"))
    return wanted.join(tiled(dem, nx, ny), ["ti", "tj"]).select(KEY, "i", "j", "ti", "tj", "zs").toDF(KEY, "i", "j", "ti", "tj", "zs")


def heights(tiles: pd.DataFrame, nx: int, ny: int) -> tuple[int, int, np.ndarray]:
    """First cells and heights of the part of a grid that lies under tiles (ti, tj, zs)."""
    i0, j0 = int(tiles.ti.min()) * TILE, int(tiles.tj.min()) * TILE
    z = np.full((min(int(tiles.ti.max() + 1) * TILE, nx - 1) - i0 + 1, min(int(tiles.tj.max() + 1) * TILE, ny - 1) - j0 + 1), np.nan)
    for ti, tj, zs in zip(tiles.ti, tiles.tj, tiles.zs, strict=True):
        wide = min((tj + 1) * TILE, ny - 1) - tj * TILE + 1
        part = np.asarray(zs, dtype=float).reshape(-1, wide)
        z[ti * TILE - i0 :, tj * TILE - j0 :][: len(part), :wide] = part
    return i0, j0, z


#: Samples that are worked on at a time.
SAMPLES = 1 << 19


def measured(node: np.ndarray, x: np.ndarray, y: np.ndarray, dem: tuple[int, int, np.ndarray], grid: tuple[float, float, float, int, int], spacing: float, grounds: dict[str, Ground], scales: dict[int, float] | None) -> pd.DataFrame:
    """metrics() of routes given by their two ends (node, x and y have two rows), in the same steps."""
    x0, y0, step, nx, ny = grid
    i0, j0, height = dem
    dx, dy = x[1] - x[0], y[1] - y[0]
    length = np.sqrt(dx * dx + dy * dy)
    counts = np.fmax(np.ceil(length / spacing) + 1, 2).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    parts, at = [], 0
    while at < len(order):
        rows = order[at : at + max(1, SAMPLES // int(counts[order[at]]))]
        at += len(rows)
        n, far = counts[rows], length[rows]
        chain, zs = [], []
        for k in range(int(n[0])):
            on = int(np.searchsorted(-n, -k))  # routes of more than k samples come first
            r = rows[:on]
            t = k / (n[:on] - 1)
            fi = np.fmin(np.fmax((x[0][r] + t * dx[r] - x0) / step, 0.0), nx - 1.0001)
            fj = np.fmin(np.fmax((y[0][r] + t * dy[r] - y0) / step, 0.0), ny - 1.0001)
            ci, cj = np.floor(fi), np.floor(fj)
            tx, ty, ci, cj = fi - ci, fj - cj, ci.astype(np.int64) - i0, cj.astype(np.int64) - j0
            zs.append(height[ci, cj] * (1 - tx) * (1 - ty) + height[ci + 1, cj] * tx * (1 - ty) + height[ci, cj + 1] * (1 - tx) * ty + height[ci + 1, cj + 1] * tx * ty)
            chain.append(t * far[:on])
        for scale, factor in (scales or {None: None}).items():
            parts.append(_summed(node[:, rows], chain, zs if factor is None else [z * factor for z in zs], zs, factor, grounds, scale))
    return pd.concat(parts, ignore_index=True) if parts else _summed(node, [length] * 2, [length] * 2, [length] * 2, None, grounds, 0 if scales else None)


def _summed(node: np.ndarray, chain: list[np.ndarray], zs: list[np.ndarray], plain: list[np.ndarray], factor: float | None, grounds: dict[str, Ground], scale: int | None) -> pd.DataFrame:
    """metrics() of routes whose samples are lists by their number; a route that has ended is not in the later ones."""
    zero = lambda: np.zeros(node.shape[1])
    low, high, last, top = plain[0].copy(), plain[0].copy(), zs[0].copy(), chain[0].copy()
    l3d, climb, steepest, slopes = zero(), zero(), zero(), zero()
    weights = {c: zero() for c in ("w", *grounds)}
    for k in range(1, len(zs)):
        on = len(zs[k])
        h, dv = chain[k] - chain[k - 1][:on], zs[k] - zs[k - 1][:on]
        l = np.sqrt(h * h + dv * dv)
        with np.errstate(divide="ignore", invalid="ignore"):
            g = np.where(h > 0, np.abs(dv) / h, 0.0)
        l3d[:on] += l
        for c, of in weights.items():
            ground = grounds.get(c, GROUND)
            of[:on] += l * ((1 + ground.a1 * np.abs(g) + ground.a2 * g * g) * np.where(np.abs(g) > ground.rock_slope, ground.rock_factor, 1.0))
        climb[:on] += np.fmax(dv, 0.0)
        steepest[:on] = np.fmax(steepest[:on], g)
        slopes[:on] += g * l
        low[:on], high[:on] = np.fmin(low[:on], plain[k]), np.fmax(high[:on], plain[k])
        last[:on], top[:on] = zs[k], chain[k]
    feasible = steepest <= GROUND.steepest
    finite = lambda of: np.where(feasible, of, np.inf)
    f = 1.0 if factor is None else factor
    out = {"u": node[0], "v": node[1]} | ({} if scale is None else {"scale": scale}) | {"z_low": low * f, "z_high": high * f, "l2d": top, "l3d": l3d}
    out |= {c: finite(weights[c]) for c in grounds}
    return pd.DataFrame(out | {"dz": last - zs[0], "climb": climb, "max_slope": steepest, "mean_slope": slopes / np.fmax(l3d, 1e-9), "feasible": feasible, "w": finite(weights["w"])})


def trees(nodes: DataFrame, dem: DataFrame, grid: tuple[float, float, float, int, int], spacing: float = SPACING, grounds: dict[str, Ground] | None = None, scales: dict[int, float] | None = None, seed: DataFrame | None = None) -> DataFrame:
    """network_id, variant, u, v, w of the spanning trees of all routes by their weight, without keeping the routes.

    There is a tree for each of ``grounds`` (variant is its place) or ``scales`` (its number), else variant is 0. Of every two
    blocks only the routes of their own trees go on: any other closes a cycle of smaller ones. A network's key is a long.

    No route weighs less than its straight line where slopes only add to it. So a pair is sampled only if its line is no longer than the
    heaviest edge between its ends in a tree whose weights are known: ``seed`` (u, v), by default the spanning tree by distance.
    """
    weights = [*(grounds or {"w": GROUND})]
    lists = F.array(*(F.struct(F.lit(i).alias("variant"), F.col(c).alias("w")) for i, c in enumerate(weights)))
    by_variant = lambda ways: ways.select(KEY, F.col("scale").alias("variant"), "u", "v", "w") if scales else ways.select(KEY, "u", "v", F.explode(lists).alias("e")).select(KEY, "e.variant", "u", "v", "e.w")
    if small(grid):
        seed = spanning_tree_of_points(nodes) if seed is None else seed
        known = by_variant(routes_of(seed, nodes, dem, grid, spacing, grounds, scales)).groupBy(KEY, "u", "v").agg(F.max("w").alias("w"))
        adds = all(g.a1 >= 0 and g.a2 >= 0 and g.rock_factor >= 1 for g in (grounds or {"w": GROUND}).values())
        found = lightest(nodes, known if adds else known.withColumn("w", F.lit(float("inf"))), dem, grid, spacing, grounds, scales)
    else:
        found = by_variant(stored(sampled_routes(nodes, dem, grid, spacing, grounds, scales)))
    both = 1 + max(scales or [len(weights) - 1])
    tree = spanning_tree(found.select((F.col(KEY) * both + F.col("variant")).alias(KEY), "u", "v", "w"))
    return tree.select(F.floor(F.col(KEY) / both).cast("long").alias(KEY), F.pmod(F.col(KEY), F.lit(both)).cast("int").alias("variant"), "u", "v", "w")


#: Nodes of a block whose pairs are looked through for routes that may be in a tree, and routes that are sampled at a time.
TREE_BLOCK, TREE_ROUTES = 2048, 1 << 17


def merged(nodes: pd.DataFrame, edges: pd.DataFrame, block: int) -> pd.DataFrame:
    """node, x, y of a network with own (block), gap, before, after and tops, in the order in which its tree (u, v, w) grows together.

    Parts join by the next lightest edge, one behind the other, and gap is its weight. So the heaviest edge of the tree between two nodes is the
    greatest gap from one to the other. before and after are the greatest gaps from the block's first node and to the next block; tops has the greatest of each block.
    """
    names = np.unique(nodes.node.to_numpy())
    order = np.argsort(edges.w.to_numpy(), kind="stable")
    a, b, w = np.searchsorted(names, edges.u.to_numpy())[order], np.searchsorted(names, edges.v.to_numpy())[order], edges.w.to_numpy(dtype=float)[order]
    part, last, behind, gap = list(range(len(names))), list(range(len(names))), [-1] * len(names), np.full(len(names), np.inf)

    def first(at: int) -> int:
        while part[at] != at:
            part[at] = at = part[part[at]]
        return at

    for one, other, weight in zip(a.tolist(), b.tolist(), w.tolist(), strict=True):
        one, other = first(one), first(other)
        if one != other:
            gap[last[one]], behind[last[one]], last[one], part[other] = weight, other, last[other], one
    rank, row = [], np.zeros(len(names), dtype=int)
    for head in range(len(names)):
        at = head if part[head] == head else -1
        while at >= 0:
            rank.append(at)
            at = behind[at]
    rank = np.array(rank, dtype=int)
    row[rank], gap = np.arange(len(rank)), gap[rank]
    starts = range(0, len(rank), block)
    before = np.concatenate([np.maximum.accumulate(np.append(0.0, gap[k : k + block][:-1])) for k in starts])
    after = np.concatenate([np.maximum.accumulate(gap[k : k + block][::-1])[::-1] for k in starts])
    at = row[np.searchsorted(names, nodes.node.to_numpy())]
    out = nodes[[KEY, "node", "x", "y"]].assign(at=at, own=at // block, gap=gap[at], before=before[at], after=after[at])
    return out.assign(tops=[after[starts]] * len(out))


def lightest(nodes: DataFrame, known: DataFrame, dem: DataFrame, grid: tuple[float, float, float, int, int], spacing: float, grounds: dict[str, Ground] | None, scales: dict[int, float] | None) -> DataFrame:
    """network_id, variant, u, v, w of routes that hold the spanning trees of all; known: a tree's edges (u, v) with their greatest weight w."""
    nx, ny = grid[3:]
    block, most, kind = TREE_BLOCK, TREE_ROUTES // len(scales or [1]), dict(nodes.dtypes)[KEY]
    rows = spread_networks(nodes.filter("node is not null").select(KEY, "node", "x", "y")).groupBy(KEY).cogroup(spread_networks(known).groupBy(KEY))
    rows = stored(rows.applyInPandas(lambda p, e: merged(p, e, block) if len(p) else pd.DataFrame(columns=[KEY, "node", "x", "y", "at", "own", "gap", "before", "after", "tops"]), f"{KEY} {kind}, node long, x double, y double, at int, own int, gap double, before double, after double, tops array<double>"))
    met = rows.withColumn("other", F.explode(F.expr("sequence(0, size(tops) - 1)"))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    reach = F.when(F.col("own") == F.col("other"), F.col("gap")).when(F.col("own") < F.col("other"), F.col("after")).otherwise(F.col("before"))
    between = F.when(F.col("j") > F.col("i") + 1, F.expr("array_max(slice(tops, i + 2, j - i - 1))")).otherwise(0.0)
    points = met.select(KEY, "i", "j", "node", "x", "y", "at", (F.col("own") > F.col("other")).cast("int").alias("side"), F.greatest(reach, between).alias("reach"))
    weights = [*(grounds or {"w": GROUND})]

    def run(points: pd.DataFrame, tiles: pd.DataFrame) -> pd.DataFrame:
        one, far = points.i.iloc[0] == points.j.iloc[0], heights(tiles, nx, ny)
        a, b = ((rows.node.to_numpy(), rows.x.to_numpy(), rows.y.to_numpy(), rows.reach.to_numpy()) for rows in (points[points.side == 0].sort_values("at"), points[points.side == (0 if one else 1)].sort_values("at")))
        held, pairs, waiting = [], [], 0

        def sampled_pairs() -> None:
            p, q = (np.concatenate(c) for c in zip(*pairs, strict=True))
            node, x, y = (np.stack([a[c][p], b[c][q]]) for c in range(3))
            turned = node[0] > node[1]
            for c in (node, x, y):
                c[:, turned] = c[::-1, turned]
            apart = node[0] < node[1]
            ways = measured(node[:, apart], x[:, apart], y[:, apart], far, grid, spacing, grounds or {}, scales)
            held.append(pd.concat([pd.DataFrame({"variant": ways.scale if scales else i, "u": ways.u, "v": ways.v, "w": ways[c]}) for i, c in enumerate(weights)]))
            held[:] = [forest_of(pd.concat(held, ignore_index=True), ["variant"])]
            pairs.clear()

        for p in range(len(a[0]) - 1 if one else len(a[0])):
            past = p + 1 if one else 0
            dx, dy = b[1][past:] - a[1][p], b[2][past:] - a[2][p]
            heaviest = np.maximum.accumulate(a[3][p:-1]) if one else np.maximum(b[3], a[3][p])
            q = past + np.flatnonzero(~(np.sqrt(dx * dx + dy * dy) > heaviest * (1 + 1e-9)))
            pairs.append((np.full(len(q), p), q))
            waiting += len(q)
            if waiting > most:
                sampled_pairs()
                waiting = 0
        if waiting:
            sampled_pairs()
        out = pd.concat(held, ignore_index=True) if held else pd.DataFrame({"variant": [], "u": [], "v": [], "w": []})
        out.insert(0, KEY, points[KEY].iloc[0])
        return out

    points = stored(points)
    tiles = tiles_under(points, dem, grid)
    return spread_groups(points).groupBy(KEY, "i", "j").cogroup(spread_groups(tiles).groupBy(KEY, "i", "j")).applyInPandas(run, f"{KEY} {kind}, variant int, u long, v long, w double")


def nearest_routes(nodes: DataFrame, dem: DataFrame, grid: tuple[float, float, float, int, int], k: int, spacing: float = SPACING) -> DataFrame:
    """all_routes() of each node with its k nearest by weight, then node, each once; infeasible routes are left out."""

    def kept(routes: pd.DataFrame) -> pd.DataFrame:
        ways = routes[np.isfinite(routes.w)].reset_index(drop=True)
        at = pd.DataFrame({"a": pd.concat([ways.u, ways.v]), "b": pd.concat([ways.v, ways.u]), "w": pd.concat([ways.w, ways.w])})
        near = at.sort_values(["a", "w", "b"], kind="stable").groupby("a").head(k)
        return ways.loc[np.unique(near.index)]

    found = stored(by_blocks(nodes, dem, grid, spacing, None, None, kept) if small(grid) else sampled_routes(nodes, dem, grid, spacing, None, None).filter("w < double('infinity')"))
    rank = F.row_number().over(Window.partitionBy(KEY, "a").orderBy("w", "b"))
    near = both_ways(found.select(KEY, "u", "v", "w")).withColumn("rank", rank).filter(F.col("rank") <= k)
    return found.join(near.select(KEY, F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), [KEY, "u", "v"], "left_semi")


def small(grid: tuple[float, float, float, int, int]) -> bool:
    """Whether the tiles of a grid of nx by ny cells may be sent to what lies on them."""
    nx, ny = grid[3:]
    return 8 * (nx + nx // TILE + 1) * (ny + ny // TILE + 1) <= BROADCAST_BYTES


def routes_of(edges: DataFrame, nodes: DataFrame, dem: DataFrame, grid: tuple[float, float, float, int, int], spacing: float = SPACING, grounds: dict[str, Ground] | None = None, scales: dict[int, float] | None = None) -> DataFrame:
    """metrics() of the straight routes of edges (network_id, u, v), named u < v."""
    a, b = ends(nodes)
    rows = canonical(edges).select(KEY, "u", "v").distinct().join(a, [KEY, "u"]).join(b, [KEY, "v"])
    return metrics(sampled(profile(rows, spacing), dem, *grid), grounds, scales)


def ends(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    a, b = (nodes.select(KEY, F.col("node").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y")) for c in "uv")
    return a, b


def relief(elevations: DataFrame) -> DataFrame:
    """z_min, z_max, relief_m and population deviation by network."""
    low, high = F.min("z"), F.max("z")
    return elevations.groupBy(KEY).agg(low.alias("z_min"), high.alias("z_max"), (high - low).alias("relief_m"), F.stddev_pop("z").alias("z_std"))


def scaled(dem: DataFrame, factors: list[float]) -> DataFrame:
    """The grid with its relief scaled about its mean, for each factor."""
    mean = dem.agg(F.avg(F.when(~F.isnan("z"), F.col("z"))).alias("mean"))
    rows = dem.join(F.broadcast(mean)).withColumn("factor", F.explode(F.array(*map(F.lit, factors))))
    return rows.select("factor", "i", "j", (F.col("mean") + F.col("factor") * (F.col("z") - F.col("mean"))).alias("z"))


def hillshade(dem: DataFrame, step: float, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """i, j, shade: central differences inside, one-sided at the edges, by joins with the neighbours' rows."""
    def slope(along: str, across: str) -> DataFrame:
        high = dem.select((F.col(along) - 1).alias(along), across, F.col("z").alias("high"))
        low = dem.select((F.col(along) + 1).alias(along), across, F.col("z").alias("low"))
        both = dem.join(high, [along, across], "left").join(low, [along, across], "left")
        n = F.col("high").isNotNull().cast("int") + F.col("low").isNotNull().cast("int")
        return both.select("i", "j", F.when(n > 0, (F.coalesce("high", "z") - F.coalesce("low", "z")) / (n * step)).otherwise(0.0).alias(f"d{along}"))

    az, alt = math.radians(450.0 - azimuth), math.radians(altitude)
    both = slope("i", "j").join(slope("j", "i"), ["i", "j"])
    tilt = F.sqrt(F.col("di") * F.col("di") + F.col("dj") * F.col("dj"))
    shade = math.sin(alt) * F.cos(F.atan(tilt)) + math.cos(alt) * F.sin(F.atan(tilt)) * F.cos(az - F.atan2(-F.col("di"), F.col("dj")))
    return both.select("i", "j", F.least(F.greatest(shade, F.lit(0.0)), F.lit(1.0)).alias("shade"))
