"""Operators whose work is linear, against plain versions that look at every pair or every scenario."""

import heapq
import itertools
import math
import random
from collections import defaultdict

import pandas as pd
import pytest

from heatlattice.operators import designs, graph, netsci, network, search


def plain_nearest(points, k, metric="euclidean"):
    """Distinct pairs u < v of each node with its k nearest, (network, u, v, w)."""
    out = set()
    for net, a, ax, ay in points:
        near = []
        for other, b, bx, by in points:
            if other == net and b != a and None not in (ax, ay, bx, by):
                dx, dy = ax - bx, ay - by
                near.append((math.sqrt(dx * dx + dy * dy) if metric == "euclidean" else abs(dx) + abs(dy), b))
        out |= {(net, min(a, b), max(a, b), round(w, 9)) for w, b in sorted(near)[:k]}
    return sorted(out)


def points():
    rng = random.Random(2)
    out = [(1, i, rng.random() * 100, rng.random() * 100) for i in range(90)]
    out += [(1, 100 + i, 50 + rng.random() / 1e4, 50 + rng.random() / 1e4) for i in range(60)]  # a dense spot
    out += [(1, 200 + i, 7.5, 7.5) for i in range(40)]  # one place
    out += [(2, i, float(i % 9), float(i // 9)) for i in range(81)]  # ties
    out += [(3, i, 5.0, 5.0) for i in range(30)] + [(4, 7, 1.0, 1.0), (4, 8, None, 1.0)] + [(5, i, float(i), 0.0) for i in range(4)]
    return out


@pytest.mark.parametrize("metric", ["euclidean", "rectilinear"])
@pytest.mark.parametrize("most", [4096, 3])
def test_nearest_of_points(spark, monkeypatch, most, metric):
    monkeypatch.setattr(graph, "MOST_POINTS", most)
    nodes = spark.createDataFrame(points(), "network_id long, node long, x double, y double")
    found = [(r.network_id, r.u, r.v, round(r.w, 9)) for r in graph.nearest_of_points(nodes, 5, metric).collect()]
    assert sorted(found) == plain_nearest(points(), 5, metric)
    assert graph.nearest_of_points(nodes.limit(0)).collect() == []


def networks():
    """Edges (network, u, v, length) and demands (network, node, kW): trees with chords, a long path, a cut-off part."""
    rng = random.Random(5)
    edges, demand = [], []
    for net in range(6):
        n = rng.randint(2, 14)
        edges += [(net, rng.randrange(i), i, float(rng.randint(1, 9))) for i in range(1, n)]
        for _ in range(rng.randint(0, n)):
            edges.append((net, *rng.choices(range(n), k=2), float(rng.randint(1, 9))))
        demand += [(net, i, float(rng.randint(0, 5))) for i in range(n)]
    edges += [(7, 0, 1, 1.0), (7, 1, 2, 1.0), (7, 5, 6, 1.0), (8, 0, 1, 2.0), (8, 1, 0, 1.0), (8, 1, 1, 1.0)]
    demand += [(7, 2, 3.0), (7, 6, 4.0), (8, 1, 2.0), (8, 1, 3.0), (8, 0, 9.0)]
    return edges, demand


def routed(edges, gone=None):
    """Cost, hops and parent of every node by its cheapest way; ties to fewer hops, then the least parent."""
    near = defaultdict(dict)
    for u, v, w in edges:
        if u != v and (min(u, v), max(u, v)) != gone:
            near[u][v] = near[v][u] = min(w, near[u].get(v, math.inf))
    best, heap = {}, [(0.0, 0, -1, 0)]
    while heap:
        cost, hops, parent, node = heapq.heappop(heap)
        if node not in best:
            best[node] = (cost, hops, parent)
            for other, w in near[node].items():
                heapq.heappush(heap, (cost + w, hops + 1, node, other))
    return best


def of(net, rows):
    return [r[1:] for r in rows if r[0] == net]


def test_stranded_and_design_flow(spark):
    edges, demand = networks()
    stranded, flows = [], []
    for net in sorted({e[0] for e in edges}):
        own, kw = of(net, edges), defaultdict(float)
        for node, d in of(net, demand):
            kw[node] += d if node and d > 0 else 0
        names = sorted({(min(u, v), max(u, v)) for u, v, _ in own if u != v})
        most = dict.fromkeys(names, 0.0)
        for gone in [None, *names]:
            best = routed(own, gone)
            lost = sum(d for node, d in kw.items() if node not in best)
            if gone:
                stranded.append((net, *gone, lost))
            flow = defaultdict(float)
            for node, d in kw.items():
                while not lost and node:
                    up = best[node][2]
                    flow[min(node, up), max(node, up)] += d
                    node = up
            for name, f in flow.items():
                most[name] = max(most[name], f)
        flows += [(net, *name, f) for name, f in most.items()]
    tables = spark.createDataFrame(edges, "network_id long, u long, v long, length double"), spark.createDataFrame(demand, "network_id long, node long, demand_kw double")
    assert sorted(map(tuple, network.stranded(*tables).collect())) == sorted(stranded)
    assert sorted(map(tuple, network.design_flow(*tables).collect())) == sorted(flows)
    assert network.stranded(tables[0].limit(0), tables[1]).collect() == [] and network.design_flow(tables[0].limit(0), tables[1]).collect() == []


def test_a_network_of_2000_edges(spark):
    """A ladder of rings: every ring edge has a way round it, every spur is a bridge."""
    edges = [(1, 0, 10_000, 1.0)]
    for ring in range(400):
        a = 10_000 + 5 * ring
        edges += [(1, a, a + 1, 1.0), (1, a + 1, a + 2, 1.0), (1, a, a + 3, 2.0), (1, a + 3, a + 2, 2.0)]
        if ring % 8 == 7 or ring == 399:
            edges.append((1, a + 2, a + 4, 1.0))
        else:
            edges.append((1, 10_000, a + 5, 1.0))
    demand = [(1, v, 1.0) for _, _, v, _ in edges if v % 5 == 4]
    tables = spark.createDataFrame(edges, "network_id long, u long, v long, length double"), spark.createDataFrame(demand, "network_id long, node long, demand_kw double")
    found = {(r.u, r.v): r.stranded_kw for r in network.stranded(*tables).collect()}
    assert len(found) == len({(min(u, v), max(u, v)) for _, u, v, _ in edges}) > 1900
    own = of(1, edges)
    for gone in [*random.Random(1).sample(sorted(found), 40), (0, 10_000)]:
        best = routed(own, gone)
        assert found[gone] == sum(d for node, d in of(1, demand) if node not in best)


def test_structure_without_pairs(spark):
    rng = random.Random(8)
    edges, nodes, expected = [], [], {}
    for net in range(5):
        n = rng.choice([2, 5, 9, 17])
        own = [(0 if net == 4 else rng.randrange(i), i, rng.randint(1, 9) / 4) for i in range(1, n)]
        edges += [(net, v, u, x) if rng.random() < 0.5 else (net, u, v, x) for u, v, x in own]
        load = [float(rng.randint(0, 4)) for _ in range(n)]
        load[-1] = 1.0
        nodes += [(net, i, d) for i, d in enumerate(load)]
        metres = [[math.inf] * n for _ in range(n)]
        hops = [[math.inf] * n for _ in range(n)]
        for i in range(n):
            metres[i][i] = hops[i][i] = 0
        for u, v, x in own:
            metres[u][v] = metres[v][u] = x
            hops[u][v] = hops[v][u] = 1
        for table in (metres, hops):
            for k in range(n):
                for i in range(n):
                    for j in range(n):
                        table[i][j] = min(table[i][j], table[i][k] + table[k][j])
        total, kw = sum(map(sum, metres)), sum(load[1:])
        expected[net] = (max(map(max, hops)), max(map(max, metres)), total / n**2, total / (n * (n - 1)), sum(metres[0]) / (n - 1), max(metres[0]), sum(a * b for a, b in zip(metres[0], load, strict=True)) / kw, sum(a * b for a, b in zip(hops[0], load, strict=True)) / kw)
    out = netsci.structure(spark.createDataFrame(nodes, "network_id long, node long, demand_kw double"), spark.createDataFrame(edges, "network_id long, u long, v long, euclidean double"), length="euclidean")
    columns = ["diameter_hops", "diameter_m", "mean_path_m", "mean_path_excl_self", "mean_plant_dist_m", "max_plant_dist_m", "demand_weighted_dist_m", "demand_weighted_hops"]
    assert {r.network_id: tuple(r[c] for c in columns) for r in out.collect()} == {net: pytest.approx(v) for net, v in expected.items()}


def test_sums_up_and_down_a_long_path(spark):
    n = 40
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(n)], "network_id long, u long, v long")
    tree = graph.stored(graph.rooted(edges))
    assert sorted((r.node, r.parent, r.depth) for r in tree.collect()) == [(i, i - 1, i) for i in range(n + 1)]
    values = spark.createDataFrame([(1, i, float(i)) for i in range(0, n + 1, 2)], "network_id long, node long, x double")
    from pyspark.sql import functions as F

    assert {r.node: r.x for r in graph.climbed(tree, ["network_id"], values, {"x": F.sum}).collect()} == {i: float(sum(range(i + i % 2, n + 1, 2))) for i in range(n + 1)}
    far = graph.from_root(tree, ["network_id"], spark.createDataFrame([(1, i, 0.5) for i in range(1, n + 1)], "network_id long, node long, length double"))
    assert {r.node: r.far for r in far.collect()} == {i: i / 2 for i in range(n + 1)}


def test_best_triples_of_all(spark):
    """Against every set of up to three, with chords that cover nothing, ties, and networks of one and two chords."""
    from heatlattice.operators import network, search

    rng = random.Random(6)
    cover, cost = [], []
    for net in range(8):
        weight = {e: float(rng.randint(0, 6)) for e in range(10)}
        for c in range([1, 2, 3, 5, 9, 9, 9, 12][net]):
            cost.append((net, c, c + 100, float(rng.randint(1, 9))))
            cover += [(net, c, c + 100, e, weight[e]) for e in rng.sample(range(10), rng.randint(0, 4))]
    expected = {}
    for net in range(8):
        sets = {(u, v): {e: w for n, a, b, e, w in cover if (n, a, b) == (net, u, v)} for n, u, v, _ in cost if n == net}
        price = {(u, v): c for n, u, v, c in cost if n == net}
        useful = sorted(s for s in sets if sum(sets[s].values()) > 0)
        every = [(-sum({e: w for s in chosen for e, w in sets[s].items()}.values()), sum(price[s] for s in chosen), chosen) for k in (1, 2, 3) for chosen in itertools.combinations(useful, k)]
        if every:
            covered, c, chosen = min(every)
            expected[net] = (-covered, c, *(x for s in chosen for x in s), *([None] * (6 - 2 * len(chosen))))
    tables = spark.createDataFrame(cover, "network_id long, u long, v long, edge long, weight double"), spark.createDataFrame(cost, "network_id long, u long, v long, cost double")
    greedy = search.greedy_cover(*tables, 3, "gain").groupBy("network_id").agg({"gain": "sum"}).toDF("network_id", "covered")
    assert {r[0]: tuple(r[1:]) for r in network.best_triples(*tables, greedy).collect()} == expected


def test_trees_are_priced_without_rows_of_ancestors(spark, monkeypatch):
    up = [-1, 0, 0, 1, 1, 3, 5]
    trees = spark.createDataFrame([(1, p, n) for n, p in enumerate(up) if n] + [(2, 0, 1)], "network_id long, u long, v long")
    demand = spark.createDataFrame([(1, n, 10.0 * n) for n in range(7)] + [(2, 1, 0.0)], "network_id long, node long, demand_kw double")
    tree = graph.stored(graph.rooted(trees))
    design = tree.filter("parent >= 0").selectExpr("network_id", "node AS v", "1e0 + node % 3 AS dp")
    above = graph.stored(graph.ancestors(tree))
    rows = lambda df: sorted(map(tuple, df.collect()))
    flows, worst = rows(network.tree_flow(tree, above, demand)), rows(network.worst_path(design, above, demand))
    for most in (graph.MOST_EDGES, 3):
        assert rows(network.tree_flow_alone(tree, demand, most)) == flows
        assert rows(network.worst_path_alone(design, tree, demand, most)) == worst
    routes = trees.selectExpr("network_id", "u", "v", "1e2 AS l2d", "1e2 AS l3d", "1e2 AS w", "0e0 AS z_low", "1e0 AS z_high")
    monkeypatch.setattr(graph, "ancestors", None)
    assert designs.assessed(trees, routes, demand)[0].count() == 1


def test_swaps_are_priced_as_whole_trees(monkeypatch):
    draw = random.Random(3)
    at = [(draw.uniform(0, 3000), draw.uniform(0, 3000)) for _ in range(14)]
    rows = [(i, j, math.dist(at[i], at[j]) * draw.uniform(1, 1.6), math.dist(at[i], at[j]), z := draw.uniform(0, 300), z + 9) for i, j in itertools.combinations(range(14), 2)]
    tree = search.Tree(pd.DataFrame(rows, columns=["u", "v", "w", "l3d", "z_low", "z_high"]), {i: 100.0 + i % 7 * 50 for i in range(1, 14) if i % 5})
    state = search.Swaps(tree, {(min(range(j), key=lambda i: math.dist(at[i], at[j])), j) for j in range(1, 14)})
    whole, swaps = tree.cost, 0
    for new in [k for k in tree.at if k not in state.edges]:
        if new in state.edges:
            continue
        assert state.now() == pytest.approx(whole(state.edges), rel=1e-12)
        costs = sorted((whole(state.edges - {out} | {new}), out) for out in tree.above(state.edges, new[0]) ^ tree.above(state.edges, new[1]))
        monkeypatch.setattr(search.Tree, "cost", None)  # no whole tree is priced for a swap
        cost, out, count = state.best(*new)
        monkeypatch.undo()
        assert count == len(costs)
        if costs[0][0] < state.now() - 1e-6:
            assert cost == pytest.approx(costs[0][0], rel=1e-12) and out == costs[0][1]
            state.swap(out, new)
            swaps += 1
        else:
            assert cost > state.now() - 1e-5
    assert swaps > 2
