"""Flow, pipe design, annual cost, seasons and failures of networks, all keyed by network_id."""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatlattice.functions import physics as p
from heatlattice.functions.params import CATALOGUE, ECONOMICS, FAILURES, R_MAX, ROUGHNESS, STEAM, U_MAX, WATER, Economics, Water
from heatlattice.operators import graph
from heatlattice.operators.graph import KEY
from heatlattice.storage import stored

# --- flow


def tree_flow(tree: DataFrame, above: DataFrame, demand: DataFrame, consumers_only: bool = False) -> DataFrame:
    """network_id, u (parent), v, flow: what passes each tree edge is the demand below it. demand: network_id, node, demand_kw."""
    wanted = demand.filter("node <> 0") if consumers_only else demand
    below = above.join(wanted, [KEY, "node"]).groupBy(KEY, F.col("ancestor").alias("node")).agg(F.sum("demand_kw").alias("below"))
    return tree.filter("parent >= 0").join(below, [KEY, "node"], "left").select(KEY, F.col("parent").alias("u"), F.col("node").alias("v"), F.abs(F.coalesce("below", F.lit(0.0))).alias("flow"))


def routed_flow(edges: DataFrame, demand: DataFrame, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """keys, u < v, flow: each demand along its cheapest path, the optimum of the uncapacitated single-source flow.

    ``infeasible`` marks scenarios in which a positive demand is not reached; edges without flow have no row, so without
    any positive demand, or any edge, there are none.
    """
    best = graph.stored(graph.shortest(edges, keys))
    keys = list(keys)
    scenarios = edges.select(*keys).distinct()
    wanted = scenarios.join(demand.filter("node <> 0 and demand_kw > 0"), KEY)
    lost = wanted.join(best.select(*keys, "node"), [*keys, "node"], "left_anti").select(*keys).distinct().withColumn("infeasible", F.lit(True))
    # the paths are a tree: walk all demands up it, one hop a round
    at = graph.stored(wanted.join(best.select(*keys, "node"), [*keys, "node"], "left_semi").select(*keys, "node", "demand_kw"))
    total = None
    while not at.isEmpty():
        step = at.join(best.select(*keys, "node", "parent"), [*keys, "node"]).filter("parent >= 0")
        moved = step.select(*keys, F.least("node", "parent").alias("u"), F.greatest("node", "parent").alias("v"), F.col("demand_kw").alias("flow"))
        total = moved if total is None else total.unionByName(moved)
        at = graph.stored(step.groupBy(*keys, F.col("parent").alias("node")).agg(F.sum("demand_kw").alias("demand_kw")))
    if total is None:  # no positive demand that can be reached
        total = edges.limit(0).select(*keys, "u", "v", F.lit(0.0).alias("flow"))
    flows = total.groupBy(*keys, "u", "v").agg(F.sum("flow").alias("flow"))
    return flows.join(lost, keys, "left").withColumn("infeasible", F.coalesce("infeasible", F.lit(False)))


def design_flow(edges: DataFrame, demand: DataFrame) -> DataFrame:
    """network_id, u, v, flow: each edge's greatest flow over all single failures that leave every load connected.

    A failure off the tree of cheapest paths moves nothing. One on it cuts off the subtree of its lower node, the
    scenario's name here, and only that is routed again: from the edges that lead into it, over the edges inside it. What
    enters at a node outside goes on along the tree, and what the subtree drew before is taken off its old way. So there
    are as many rows as nodes times their depth, and the edges among them, and no scenario holds the whole network.

    Edges that are given twice fail together, with the shorter length. A network with a positive demand that is never reached has no flow.
    """
    edges = graph.stored(graph.canonical(edges).filter("u <> v").groupBy(KEY, "u", "v").agg(F.min("length").alias("length")))
    best = graph.stored(graph.shortest(edges))
    wanted = demand.filter("node <> 0 and demand_kw > 0").groupBy(KEY, "node").agg(F.sum("demand_kw").alias("demand_kw"))
    lost = wanted.join(best.select(KEY, "node"), [KEY, "node"], "left_anti").select(KEY).distinct()
    best = graph.stored(best.join(lost, KEY, "left_anti"))
    total = lambda tree, keys: graph.climbed(tree, keys, tree.select(*keys, "node").join(wanted, [KEY, "node"], "left").select(*keys, "node", F.coalesce("demand_kw", F.lit(0.0)).alias("flow")), {"flow": F.sum})
    base = graph.stored(total(best, [KEY]).filter("node <> 0"))

    keys = [KEY, "cut"]
    above = graph.stored(graph.ancestors(best).select(KEY, "node", "ancestor"))
    inside = graph.stored(above.filter("ancestor <> 0").select(KEY, F.col("ancestor").alias("cut"), "node"))
    # edges with an end in the subtree: b is in it, a may be; the failed one is left out
    arcs = graph.arcs_of(edges, [KEY]).join(inside.withColumnRenamed("node", "b"), [KEY, "b"])
    parent = best.select(KEY, F.col("node").alias("cut"), F.col("parent").alias("above_cut"))
    arcs = arcs.join(parent, keys).filter("not (b = cut and a = above_cut)")
    own = inside.select(*keys, F.col("node").alias("a"), F.lit(True).alias("own"))
    arcs = graph.stored(arcs.join(own, [*keys, "a"], "left").select(*keys, "a", "b", "length", F.col("own").isNotNull().alias("own")))
    outside = best.select(KEY, F.col("node").alias("a"), "cost", "hops")
    offers = arcs.filter("not own").join(outside, [KEY, "a"]).select(*keys, F.col("b").alias("node"), F.struct((F.col("cost") + F.col("length")).alias("cost"), (F.col("hops") + 1).alias("hops"), F.col("a").alias("parent")).alias("s"))
    starts = graph.stored(offers.groupBy(*keys, "node").agg(F.min("s").alias("s")))
    again = graph.stored(graph.relaxed(starts, arcs.filter("own").drop("own"), keys))
    unmet = inside.join(wanted, [KEY, "node"], "left_semi").join(again, [*keys, "node"], "left_anti").select(*keys).distinct()
    again = graph.stored(again.join(unmet, keys, "left_anti"))

    own = inside.withColumn("own", F.lit(True)).withColumnRenamed("node", "parent")
    routed = again.join(own, [*keys, "parent"], "left").select(*keys, "node", F.when(F.col("own"), F.col("parent")).otherwise(-1).alias("parent"), F.col("parent").alias("next"), F.col("own").isNull().alias("enters"))
    routed = graph.stored(routed)
    within = graph.stored(total(routed, keys).join(routed.select(*keys, "node", "next", "enters"), [*keys, "node"]))
    moved = within.select(KEY, F.least("node", "next").alias("u"), F.greatest("node", "next").alias("v"), "flow")
    # along the tree outside: what enters goes up, what was drawn before is taken off
    up = above.filter("ancestor <> 0").select(KEY, F.col("node").alias("next"), F.col("ancestor").alias("node"))
    more = within.filter("enters").select(*keys, "next", "flow").join(up, [KEY, "next"]).select(*keys, "node", "flow")
    scenarios = within.select(*keys).distinct()
    less = scenarios.join(base.withColumnRenamed("node", "cut"), [KEY, "cut"]).join(up.withColumnRenamed("next", "cut"), [KEY, "cut"]).select(*keys, "node", (-F.col("flow")).alias("flow"))
    changed = more.unionByName(less).groupBy(*keys, "node").agg(F.sum("flow").alias("change"))
    changed = changed.join(base, [KEY, "node"]).select(KEY, "node", (F.col("flow") + F.col("change")).alias("flow"))
    on_tree = base.unionByName(changed).groupBy(KEY, "node").agg(F.max("flow").alias("flow")).join(best.select(KEY, "node", "parent"), [KEY, "node"])
    every = moved.unionByName(on_tree.select(KEY, F.least("node", "parent").alias("u"), F.greatest("node", "parent").alias("v"), "flow"))
    most = every.groupBy(KEY, "u", "v").agg(F.max("flow").alias("flow"))
    return edges.select(KEY, "u", "v").join(most, [KEY, "u", "v"], "left").fillna(0.0, ["flow"])


def design_flow_alone(edges: DataFrame, demand: DataFrame, most: int = graph.MOST_POINTS) -> DataFrame:
    """design_flow() with networks of up to ``most`` edges in one task each, by the same steps; larger ones by rounds.

    Only an edge of the tree that some edge off it bridges is routed again: the rest of its scenarios reach nothing.
    """
    kind = dict(edges.dtypes)[KEY]
    edges = graph.stored(graph.canonical(edges).filter("u <> v").groupBy(KEY, "u", "v").agg(F.min("length").alias("length")))
    sized = edges.join(edges.groupBy(KEY).agg(F.count("*").alias("edges")), KEY)
    rows = sized.filter(F.col("edges") <= most).drop("edges")
    small = graph.spread_networks(rows).groupBy(KEY).cogroup(graph.spread_networks(demand.select(KEY, "node", "demand_kw")).groupBy(KEY)).applyInPandas(_design_flow, f"{KEY} {kind}, u long, v long, flow double")
    large = sized.filter(F.col("edges") > most).drop("edges")
    return small if large.isEmpty() else small.unionByName(design_flow(large, demand.join(large.select(KEY).distinct(), KEY, "left_semi")))


def _cheapest(starts: list[tuple[float, int, int, int]], near: dict[int, list[tuple[int, float]]], inside: Callable[[int], bool]) -> dict[int, tuple[float, int, int]]:
    """node: (cost, hops, parent) of the cheapest ways on from starts (cost, hops, parent, node) over nodes that are inside, nearest first."""
    best, heap = {}, list(starts)
    heapq.heapify(heap)
    while heap:
        cost, hops, parent, node = heapq.heappop(heap)
        if node not in best:
            best[node] = cost, hops, parent
            for other, length in near[node]:
                if other not in best and inside(other):
                    heapq.heappush(heap, (cost + length, hops + 1, node, other))
    return best


def _design_flow(edges: pd.DataFrame, demand: pd.DataFrame) -> pd.DataFrame:
    """design_flow() of one network."""
    near: dict[int, list[tuple[int, float]]] = {}
    for u, v, length in zip(edges["u"].tolist(), edges["v"].tolist(), edges["length"].tolist(), strict=True):
        near.setdefault(u, []).append((v, length))
        near.setdefault(v, []).append((u, length))
    wanted = demand[(demand.node != 0) & (demand.demand_kw > 0)].groupby("node").demand_kw.sum().to_dict()
    best = _cheapest([(0.0, 0, -1, 0)], near, lambda node: True) if 0 in near else {}
    if any(node not in best for node in wanted):
        best = {}
    most: dict[tuple[int, int], float] = {}

    def carry(a: int, b: int, flow: float) -> None:
        pair = (min(a, b), max(a, b))
        most[pair] = max(most.get(pair, 0.0), flow)

    # a node comes after its parent; those of a subtree lie next to each other, first to last
    below: dict[int, list[int]] = {node: [] for node in best}
    for node, (_, _, parent) in best.items():
        if parent >= 0:
            below[parent].append(node)
    order, stack = [], [0] if best else []
    while stack:
        order.append(node := stack.pop())
        stack += below[node]
    first = {node: i for i, node in enumerate(order)}
    last, base = dict(first), {node: wanted.get(node, 0.0) for node in order}
    for node in reversed(order[1:]):
        parent = best[node][2]
        base[parent] += base[node]
        last[parent] = max(last[parent], last[node])
    for node in order[1:]:
        carry(node, best[node][2], base[node])
    off = [(u, v, length) for u in best for v, length in near[u] if best[u][2] != v and best[v][2] != u]
    entering: dict[int, list[tuple[int, int, float]]] = {}
    for a, b, length in off:
        node = b
        while node and not first[node] <= first[a] <= last[node]:
            entering.setdefault(node, []).append((a, b, length))
            node = best[node][2]
    for cut, arcs in entering.items():
        inside = lambda node, low=first[cut], high=last[cut]: low <= first[node] <= high
        again = _cheapest([(best[a][0] + length, best[a][1] + 1, a, b) for a, b, length in arcs], near, inside)
        if any(node in wanted and node not in again for node in order[first[cut] : last[cut] + 1]):
            continue
        flow, change = {node: wanted.get(node, 0.0) for node in again}, {}
        for node, (_, _, parent) in reversed(again.items()):
            carry(node, parent, flow[node])
            if inside(parent):
                flow[parent] += flow[node]
                continue
            while parent:
                change[parent] = change.get(parent, 0.0) + flow[node]
                parent = best[parent][2]
        node = cut
        while node:
            change[node] = change.get(node, 0.0) - base[cut]
            node = best[node][2]
        for node, more in change.items():
            carry(node, best[node][2], base[node] + more)
    return edges[[KEY, "u", "v"]].assign(flow=[most.get(pair, 0.0) for pair in zip(edges["u"].tolist(), edges["v"].tolist(), strict=True)])


# --- pipes


def _friction(re: float, d: float) -> float:
    if re < 2300:
        return 64 / re
    x = -2 * math.log10(ROUGHNESS / d / 3.7 + 5.74 / re**0.9)
    for _ in range(40):
        x = -2 * math.log10(ROUGHNESS / d / 3.7 + 2.51 * x / re)
    return 1 / (x * x)


@functools.cache
def capacities(u_max: float = U_MAX, r_max: float = R_MAX, water: Water = WATER) -> list[tuple[int, float]]:
    """dn and the greatest mass flow it carries within both limits; both grow with the flow, so bisection finds it."""
    out = []
    for dn, d, _, _ in CATALOGUE:
        low, high = 1e-9, u_max * water.rho * math.pi * d * d / 4
        fine = lambda m, d=d: _friction(4 * m / (math.pi * d * water.mu), d) / d * water.rho * (4 * m / (water.rho * math.pi * d * d)) ** 2 / 2 <= r_max
        if not fine(high):
            for _ in range(100):
                mid = (low + high) / 2
                low, high = (mid, high) if fine(mid) else (low, mid)
            high = low
        out.append((dn, high))
    return out


def pipe(mass_flow: Column, water: Water = WATER) -> Column:
    """struct(dn, d_in, d_steel, d_casing) of the smallest fitting pipe, the largest if none fits; a CASE of 22 limits."""
    sizes = {dn: F.struct(F.lit(dn).alias("dn"), *(F.lit(x).alias(c) for c, x in zip(("d_in", "d_steel", "d_casing"), dims, strict=True))) for dn, *dims in CATALOGUE}
    limits = capacities(water=water)
    out = F.when(mass_flow <= limits[0][1], sizes[limits[0][0]])
    for dn, most in limits[1:-1]:
        out = out.when(mass_flow <= most, sizes[dn])
    return F.when(mass_flow.isNotNull(), out.otherwise(sizes[CATALOGUE[-1][0]]))


def designed(edges: DataFrame, flow: str = "flow", water: Water = WATER) -> DataFrame:
    """edges (l2d, l3d, w, flow in kW) with mdot, dn, d_in, d_steel, d_casing, u_mps, dp, q_per_m, lw.

    An infeasible route (w null or infinite) is priced at ten times its length.
    """
    out = edges.withColumn("mdot", p.column(p.mass_flow(flow, water))).withColumn("pipe", pipe(F.col("mdot"), water))
    out = out.select(*edges.columns, "mdot", "pipe.*")
    finite = F.col("w").isNotNull() & (F.col("w") < F.lit(math.inf))
    return out.withColumns(
        {
            "u_mps": F.when((F.col("mdot") > 0) & (F.col("l3d") > 0), p.column(p.velocity("mdot", "d_in", water))).otherwise(0.0),
            "dp": p.column(p.pressure_drop("mdot", "d_in", "l3d", water=water)),
            "q_per_m": p.column(p.loss_buried("d_steel", "d_casing", p.n(water.supply_C), p.n(water.return_C))),
            "lw": F.when(finite, F.col("w")).otherwise(F.col("l3d") * 10),
        }
    )


def worst_path(design: DataFrame, above: DataFrame, demand: DataFrame, keys: tuple[str, ...] = (KEY,), dp: str = "dp") -> DataFrame:
    """keys and worst: the greatest sum of pressure drops from the hub to a consumer. design: keys, v (lower node), dp."""
    consumers = demand.filter("node <> 0 and demand_kw > 0").select(KEY, "node")
    path = above.join(consumers, [KEY, "node"], "left_semi").select(KEY, "node", F.col("ancestor").alias("v"))
    sums = path.join(design.select(*keys, "v", F.col(dp).alias("dp_")), [KEY, "v"]).groupBy(*keys, "node").agg(F.sum("dp_").alias("path"))
    return sums.groupBy(*keys).agg(F.max("path").alias("worst"))


def _up(tree: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row of the parent of each node of a rooted tree (node, parent, depth), and the rows of each depth under the root."""
    name = tree["node"].to_numpy()
    order = np.argsort(name)
    up = order[np.minimum(np.searchsorted(name[order], tree["parent"].to_numpy()), len(name) - 1)]
    depth = tree["depth"].to_numpy()
    rows = np.argsort(depth, kind="stable")
    return up, np.split(rows, np.searchsorted(depth[rows], np.arange(1, depth.max() + 1)))[1:]


def one_task(tree: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The rooted trees of up to ``most`` nodes, and the others."""
    sized = tree.join(tree.groupBy(KEY).agg(F.count("*").alias("nodes")), KEY)
    return sized.filter(F.col("nodes") <= most).drop("nodes"), sized.filter(F.col("nodes") > most).drop("nodes")


def tree_flow_alone(tree: DataFrame, demand: DataFrame, most: int = graph.MOST_EDGES) -> DataFrame:
    """tree_flow() of rooted() trees without a row for each node and all above it: trees of up to ``most`` nodes in one task each."""

    def run(tree: pd.DataFrame, demand: pd.DataFrame) -> pd.DataFrame:
        if tree.empty:
            return pd.DataFrame(columns=[KEY, "u", "v", "flow"])
        below = tree["node"].map(demand.groupby("node")["demand_kw"].sum()).fillna(0.0).to_numpy(dtype=float, copy=True)
        up, levels = _up(tree)
        for rows in reversed(levels):
            np.add.at(below, up[rows], below[rows])
        return pd.DataFrame({KEY: tree[KEY], "u": tree["parent"], "v": tree["node"], "flow": np.abs(below)})[tree["parent"] >= 0]

    small, large = one_task(tree, most)
    flows = graph.spread_networks(small).groupBy(KEY).cogroup(graph.spread_networks(demand.select(KEY, "node", "demand_kw")).groupBy(KEY)).applyInPandas(run, f"{KEY} {dict(tree.dtypes)[KEY]}, u long, v long, flow double")
    return flows if large.isEmpty() else flows.unionByName(tree_flow(large, graph.ancestors(large), demand))


def worst_path_alone(design: DataFrame, tree: DataFrame, demand: DataFrame, most: int = graph.MOST_EDGES) -> DataFrame:
    """worst_path() of rooted() trees likewise."""
    consumers = demand.filter("node <> 0 and demand_kw > 0").select(KEY, "node").distinct().withColumn("wanted", F.lit(True))
    drops = design.groupBy(KEY, F.col("v").alias("node")).agg(F.sum("dp").alias("dp"))
    small, large = one_task(tree, most)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        drop, wanted = pdf["dp"].to_numpy(dtype=float, copy=True), pdf["wanted"].to_numpy(dtype=bool)
        up, levels = _up(pdf)
        for rows in levels:
            drop[rows] += drop[up[rows]]
        return pd.DataFrame({KEY: [pdf[KEY].iloc[0]] if wanted.any() else [], "worst": [drop[wanted].max()] if wanted.any() else []})

    rows = small.select(KEY, "node", "parent", "depth").join(drops, [KEY, "node"], "left").join(consumers, [KEY, "node"], "left").fillna(0.0, ["dp"]).fillna(False, ["wanted"])
    worst = graph.spread_networks(rows).groupBy(KEY).applyInPandas(run, f"{KEY} {dict(tree.dtypes)[KEY]}, worst double")
    return worst if large.isEmpty() else worst.unionByName(worst_path(design, graph.ancestors(large), demand))


def annual_cost(design: DataFrame, above: DataFrame, demand: DataFrame, relief: DataFrame, e: Economics = ECONOMICS, water: Water = WATER) -> DataFrame:
    """A row a network: capital, pumping, heat loss, zones, total, specific cost and what they come from.

    relief: network_id, relief_m (greatest less least elevation along all routes).
    """
    return annual_cost_of(design, worst_path(design, above, demand), demand, relief, e, water)


def annual_cost_of(design: DataFrame, worst: DataFrame, demand: DataFrame, relief: DataFrame, e: Economics = ECONOMICS, water: Water = WATER) -> DataFrame:
    """annual_cost() with worst_path() at hand."""
    crf = p.n(p.capital_recovery(e.rate, e.years))
    sums = design.groupBy(KEY).agg(
        F.sum((e.C1 + e.C2 * F.col("d_casing")) * F.col("lw")).alias("trench"),
        F.sum(F.col("q_per_m") * F.col("l3d")).alias("loss_w"),
        *(F.sum(c).alias(f"length_{c}") for c in ("l2d", "l3d", "lw")),
    )
    loads = demand.filter("demand_kw > 0").groupBy(KEY).agg(F.sum("demand_kw").alias("load_kw"))
    out = sums.join(loads, KEY).join(worst, KEY, "left").join(relief, KEY, "left").fillna(0.0, ["worst", "relief_m"])
    out = out.withColumn("pump_dp", p.column(p.closed_loop("worst", "worst"))).withColumn("n_zones", p.column(p.zones("relief_m", p.n(e.pressure_class), water)))
    out = out.withColumns(
        {
            "capital": F.expr(f"trench * {crf}"),
            "pumping": F.expr(f"{p.pump_power(p.mass_flow('load_kw', water), 'pump_dp', e.eta, water)} / 1000e0 * {p.n(e.pump_hours * e.power_price)}"),
            "heat_loss_mwh": F.expr("loss_w / 1e6 * 8760e0"),
            "zones": F.expr(f"(n_zones - 1) * {p.n(e.station)} * {crf}"),
            "delivered_mwh": F.expr(f"load_kw * {p.n(e.full_load_hours)} / 1000e0"),
        }
    ).withColumn("heat_loss", F.col("heat_loss_mwh") * 1000 * e.heat_price)
    out = out.withColumn("total", F.expr("capital + pumping + heat_loss + zones"))
    return out.withColumn("specific", F.expr("total / greatest(delivered_mwh, 1e-9)"))


def steam_cost(edges: DataFrame, mode: str | None = None) -> DataFrame:
    """pipe, pressure, heat, total and length of each network by the published steam model.

    edges: network_id, u (parent), v, length, flow (kg/s). The parent branch comes by a join on its lower node.
    """
    own = edges.withColumn("d_in", p.column(p.steam_inner("flow"))).withColumn("d_out", p.column(p.steam_outer("d_in")))
    own = own.withColumn("area", F.expr("pi() * d_in * d_in / 4e0"))
    above = own.select(KEY, F.col("v").alias("u"), F.col("area").alias("parent_area"))
    own = own.join(above, [KEY, "u"], "left")
    price = p.steam_price("d_out", p.steam_weight("d_in"))
    head = f"((CASE WHEN d_in > 0 THEN {p.n(STEAM.sigma)} * length / d_in ELSE 0e0 END) + {p.area_loss('area', 'parent_area')} + {p.n(STEAM.zeta_elbow / STEAM.elbow_spacing)} * length) * {p.n(STEAM.u**2 / 2)}"
    own = own.withColumns(
        {
            "pipe": F.expr(f"{p.n(p.CRF_STEAM)} * {price} * length"),
            "pressure": F.expr(f"{p.n(STEAM.power_price * STEAM.hours / STEAM.eta / 1000)} * flow * {head}"),
            "heat": F.expr(f"{p.n(STEAM.steam_price * STEAM.hours * 3600 / STEAM.latent)} * {p.steam_loss('d_out', mode)} * length"),
        }
    )
    out = own.groupBy(KEY).agg(*(F.sum(c).alias(c) for c in ("pipe", "pressure", "heat", "length")))
    return out.withColumn("total", F.expr("pipe + pressure + heat"))


def published_units(cost: DataFrame) -> DataFrame:
    """steam_cost() in the units of the published table: length_1e4_m, and pipe, pressure, heat and total in 1e7."""
    money = [(F.col(c) / 1e7).alias(f"{c}_1e7") for c in ("pipe", "pressure", "heat", "total")]
    return cost.select(KEY, (F.col("length") / 1e4).alias("length_1e4_m"), *money)


# --- seasons


def load_bins(spark, least: float = 0.10, hours: int = 8760, bins: int = 40, full_load: float = ECONOMICS.full_load_hours) -> DataFrame:
    """load (middle of the bin) and hours of each of ``bins`` equal bins of the load-duration curve, the last closed."""
    m0 = full_load / 8760
    q = f"(1e0 - {p.n(1 - least)} * pow((id + 0.5e0) / {p.n(hours)}, {p.n((m0 - least) / (1 - m0))}))"
    return binned(spark.range(hours).select(F.expr(q).alias("q")), bins)


def binned(curve: DataFrame, bins: int = 40) -> DataFrame:
    """bin, load (its middle) and hours of ``bins`` equal bins from the least load to the full one (1); curve: q, a row an hour.

    Null loads are left out; where all loads are full there is one bin, the first; bins without hours have no row.
    """
    curve = curve.filter("q is not null")
    low = curve.agg(F.min("q").alias("low"))
    span = F.when(F.col("low") < 1, (1 - F.col("low")) / bins).otherwise(1.0)
    placed = curve.join(F.broadcast(low)).withColumn("bin", F.least(F.floor((F.col("q") - F.col("low")) / span), F.lit(bins - 1)).cast("int"))
    return placed.groupBy("bin").agg(F.count("*").alias("hours"), F.first("low").alias("low")).select("bin", (F.col("low") + (F.col("bin") + 0.5) * (1 - F.col("low")) / bins).alias("load"), "hours")


def seasonal_cost(design: DataFrame, above: DataFrame, demand: DataFrame, bins: DataFrame, least: float = 0.10, coolest: float = 80.0, e: Economics = ECONOMICS) -> DataFrame:
    """pump_kwh, loss_kwh, pumping and heat_loss of a year of load bins with weather-compensated supply."""
    span = WATER.supply_C - coolest
    warm = bins.withColumn("supply_c", coolest + span * (F.col("load") - least) / (1 - least))
    warm = F.broadcast(warm.withColumn("scale", F.col("load") * (WATER.supply_C - WATER.return_C) / (F.col("supply_c") - WATER.return_C)))  # 40 rows
    rows = design.select(KEY, "v", "mdot", "d_in", "d_steel", "d_casing", "l3d").join(warm)
    rows = rows.withColumn("m", F.col("mdot") * F.col("scale")).withColumn("dp", p.column(p.pressure_drop("m", "d_in", "l3d")))
    loss = rows.withColumn("kwh", F.expr(f"{p.loss_buried('d_steel', 'd_casing', 'supply_c')} * l3d * hours / 1000e0")).groupBy(KEY).agg(F.sum("kwh").alias("loss_kwh"))
    worst = worst_path(rows, above, demand, (KEY, "bin"))
    loads = demand.filter("demand_kw > 0").groupBy(KEY).agg(F.sum("demand_kw").alias("load_kw"))
    pump = worst.join(loads, KEY).join(warm, "bin").withColumn("m", F.expr(f"{p.mass_flow('load_kw')} * scale"))
    pump = pump.groupBy(KEY).agg(F.sum(F.expr(f"{p.pump_power('m', '2e0 * worst', e.eta)} * hours / 1000e0")).alias("pump_kwh"))
    return pump.join(loss, KEY).withColumn("pumping", F.col("pump_kwh") * e.power_price).withColumn("heat_loss", F.col("loss_kwh") * e.heat_price)


# --- failures


def stranded(edges: DataFrame, demand: DataFrame) -> DataFrame:
    """network_id, u, v, stranded_kw: the positive demand that each edge's loss cuts off, on any graph.

    Every edge off a breadth-first tree has a number, and a tree edge that of all edges that close a cycle over it, by
    exclusive or: 64 random bits, so 0 means that there is none, and that the edge is a bridge. Its loss strands what is
    below it. Demand that the root never reaches is stranded by every loss. Edges given twice fail together; loops are no edges.
    """
    edges = graph.stored(graph.canonical(edges).select(KEY, "u", "v").filter("u <> v").distinct())
    tree = graph.stored(graph.rooted(edges))
    wanted = demand.filter("demand_kw > 0 and node <> 0").groupBy(KEY, "node").agg(F.sum("demand_kw").alias("demand_kw"))
    own = tree.filter("parent >= 0").select(KEY, F.least("node", "parent").alias("u"), F.greatest("node", "parent").alias("v"), F.col("node").alias("lower"))
    rest = edges.join(own, [KEY, "u", "v"], "left_anti").withColumn("mark", F.xxhash64(KEY, "u", "v"))
    marks = rest.select(KEY, F.explode(F.array("u", "v")).alias("node"), "mark").groupBy(KEY, "node").agg(F.bit_xor("mark").alias("mark"))
    values = tree.select(KEY, "node").join(wanted, [KEY, "node"], "left").join(marks, [KEY, "node"], "left")
    values = values.select(KEY, "node", F.coalesce("demand_kw", F.lit(0.0)).alias("below"), F.coalesce("mark", F.lit(0)).cast("long").alias("mark"))
    below = graph.climbed(tree, [KEY], values, {"below": F.sum, "mark": F.bit_xor})
    bridges = own.join(below.filter("mark = 0").select(KEY, F.col("node").alias("lower"), "below"), [KEY, "lower"]).select(KEY, "u", "v", "below")
    never = wanted.join(tree.select(KEY, "node"), [KEY, "node"], "left_anti").groupBy(KEY).agg(F.sum("demand_kw").alias("never"))
    out = edges.join(bridges, [KEY, "u", "v"], "left").join(never, KEY, "left")
    return out.select(KEY, "u", "v", (F.coalesce("below", F.lit(0.0)) + F.coalesce("never", F.lit(0.0))).alias("stranded_kw"))


def reliability(design: DataFrame, lost: DataFrame, demand: DataFrame, oxygen: str = "2e-5") -> DataFrame:
    """A row a network: unserved energy, worst failure, share served after it, bridges. design: u, v, l3d, dn, u_mps, d_in."""
    rate = p.failure_rate("l3d", "dn", "u_mps", "d_in", oxygen)
    rows = graph.canonical(design).join(lost, [KEY, "u", "v"]).withColumn("rate", F.expr(rate))
    rows = rows.withColumn("eud", F.expr(f"rate * {p.n(FAILURES.repair_h)} * stranded_kw / 1000e0"))
    loads = demand.filter("demand_kw > 0").groupBy(KEY).agg(F.sum("demand_kw").alias("load_kw"))
    worst = F.max(F.struct("stranded_kw", (-F.col("u")).alias("u"), (-F.col("v")).alias("v"))).alias("w")
    out = rows.groupBy(KEY).agg(F.sum("eud").alias("eud_mwh"), F.sum("rate").alias("rate"), F.count(F.when(F.col("stranded_kw") > 1e-9, 1)).alias("bridges"), worst)
    out = out.join(loads, KEY)
    return out.select(KEY, "eud_mwh", "rate", "bridges", (F.col("bridges") == 0).alias("bridge_free"), F.col("w.stranded_kw").alias("worst_kw"), (-F.col("w.u")).alias("worst_u"), (-F.col("w.v")).alias("worst_v"), (1 - F.col("w.stranded_kw") / F.greatest("load_kw", F.lit(1e-9))).alias("n1_served"))


# --- coverage of edges by candidate chords


def covers(above: DataFrame, candidates: DataFrame, weight: DataFrame) -> DataFrame:
    """network_id, u, v, edge, weight: the bridges (edge, weight) that each candidate's cycle covers."""
    return graph.path_edges(above, candidates.select(KEY, "u", "v")).join(weight.select(KEY, "edge", "weight"), [KEY, "edge"])


def best_sets(cover: DataFrame, cost: DataFrame) -> DataFrame:
    """Coverage and cost of every candidate and of every two of a network: k, u1, v1, u2, v2, covered, cost.

    Two candidates cover the sum of each less what both cover; only what they share is joined edge by edge.
    """
    one = cost.join(cover.groupBy(KEY, "u", "v").agg(F.sum("weight").alias("covered")), [KEY, "u", "v"], "left").fillna(0.0, ["covered"])
    name = lambda i: [F.col("u").alias(f"u{i}"), F.col("v").alias(f"v{i}")]
    a, b = (cover.select(KEY, *name(i), "edge", "weight") for i in (1, 2))
    shared = a.join(b.drop("weight"), [KEY, "edge"]).filter("u1 < u2 or (u1 = u2 and v1 < v2)").groupBy(KEY, "u1", "v1", "u2", "v2").agg(F.sum("weight").alias("shared"))
    x, y = (one.select(KEY, *name(i), F.col("covered").alias(f"c{i}"), F.col("cost").alias(f"cost{i}")) for i in (1, 2))
    two = x.join(y, KEY).filter("u1 < u2 or (u1 = u2 and v1 < v2)").join(shared, [KEY, "u1", "v1", "u2", "v2"], "left")
    two = two.select(KEY, F.lit(2).alias("k"), "u1", "v1", "u2", "v2", (F.col("c1") + F.col("c2") - F.coalesce("shared", F.lit(0.0))).alias("covered"), (F.col("cost1") + F.col("cost2")).alias("cost"))
    none = F.lit(None).cast("long")
    return one.select(KEY, F.lit(1).alias("k"), *name(1), none.alias("u2"), none.alias("v2"), "covered", "cost").unionByName(two)


def best_triples(cover: DataFrame, cost: DataFrame, least: DataFrame) -> DataFrame:
    """network_id, covered, cost, u1, v1 to u3, v3: the set of up to three candidates that covers most of each network.

    least: network_id, covered that some set of three reaches (a greedy one). Candidates are put in the order of what each
    covers alone, so a pair, and a third behind it, can only be of use if what they cover together and alone reaches
    that: all else is dropped before it is made. Of what is left the covered edges are counted out. Ties go to the
    cheaper set, then to the lesser names. Sets of fewer have nulls. Candidates that cover nothing are in no set; a
    network without others has no row.
    """
    alone = cover.groupBy(KEY, "u", "v").agg(F.sum("weight").alias("alone")).filter("alone > 0").join(cost, [KEY, "u", "v"])
    place = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("alone"), "cost", "u", "v"))
    one = stored(alone.withColumn("i", place).join(least.select(KEY, F.col("covered").alias("least")), KEY))
    edges = stored(cover.join(one.select(KEY, "u", "v", "i"), [KEY, "u", "v"]).select(KEY, "i", "edge", "weight"))
    slack = F.col("least") * (1 - 1e-9)
    x, y, z = (one.select(KEY, F.col("i").alias(f"i{n}"), F.col("alone").alias(f"alone{n}"), F.col("cost").alias(f"cost{n}"), *(["least"] if n == 1 else [])) for n in (1, 2, 3))
    pairs = x.join(y, KEY).filter("i1 < i2").filter(F.col("alone1") + 2 * F.col("alone2") >= slack)
    ex, ey = (edges.select(KEY, F.col("i").alias(f"i{n}"), "edge", F.col("weight").alias(f"w{n}")) for n in (1, 2))
    shared = pairs.select(KEY, "i1", "i2").join(ex, [KEY, "i1"]).join(ey, [KEY, "i2", "edge"]).groupBy(KEY, "i1", "i2").agg(F.sum("w1").alias("shared"))
    pairs = pairs.join(shared, [KEY, "i1", "i2"], "left").withColumn("two", F.col("alone1") + F.col("alone2") - F.coalesce("shared", F.lit(0.0)))
    pairs = stored(pairs.select(KEY, "i1", "i2", "two", "alone2", (F.col("cost1") + F.col("cost2")).alias("cost"), "least"))
    triples = pairs.filter(F.col("two") + F.col("alone2") >= slack).join(z, KEY).filter("i2 < i3").filter(F.col("two") + F.col("alone3") >= slack)
    triples = stored(triples.select(KEY, "i1", "i2", "i3", (F.col("cost") + F.col("cost3")).alias("cost")))
    named = triples.select(KEY, "i1", "i2", "i3", "cost", F.explode(F.array("i1", "i2", "i3")).alias("i")).join(edges, [KEY, "i"])
    counted = named.groupBy(KEY, "i1", "i2", "i3", "cost", "edge").agg(F.first("weight").alias("weight")).groupBy(KEY, "i1", "i2", "i3", "cost").agg(F.sum("weight").alias("covered"))
    none = F.lit(None).cast("int")
    sets = counted.unionByName(pairs.select(KEY, "i1", "i2", none.alias("i3"), "cost", F.col("two").alias("covered"))).unionByName(one.select(KEY, F.col("i").alias("i1"), none.alias("i2"), none.alias("i3"), "cost", F.col("alone").alias("covered")))
    names = one.select(KEY, "i", F.struct("u", "v").alias("name"))
    for n in (1, 2, 3):
        sets = sets.join(names.select(KEY, F.col("i").alias(f"i{n}"), F.col("name").alias(f"n{n}")), [KEY, f"i{n}"], "left")
    sets = sets.select(KEY, F.round("covered", 9).alias("covered"), F.round("cost", 9).alias("cost"), F.array_sort(F.array_compact(F.array("n1", "n2", "n3"))).alias("set"))
    best = sets.groupBy(KEY).agg(F.min(F.struct((-F.col("covered")).alias("a"), "cost", "set")).alias("b"))
    return best.select(KEY, (-F.col("b.a")).alias("covered"), "b.cost", *(F.get("b.set", F.lit(n))[c].alias(f"{c}{n + 1}") for n in range(3) for c in "uv"))


def frontier(sets: DataFrame, bins: int = 4000) -> DataFrame:
    """The running best coverage along equal cost bins, where it grows."""
    top = sets.groupBy(KEY).agg(F.max("cost").alias("most"))
    binned = sets.join(top, KEY).withColumn("bin", F.least(F.floor(F.col("cost") / F.col("most") * bins), F.lit(bins - 1)).cast("int"))
    best = binned.groupBy(KEY, "bin").agg(F.max("covered").alias("covered"))
    before = F.max("covered").over(Window.partitionBy(KEY).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    return best.withColumn("before", before).filter("before is null or covered > before").drop("before")
