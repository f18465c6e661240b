"""Invariants and small known answers of the operators that have no SQL."""

import itertools
import json
import math
import random

import numpy as np
import pytest

from heatlattice.functions.params import PUBLISHED
from heatlattice.operators import centrality, graph, netsci, network, search, steiner, terrain
from heatlattice.sources import geojson


def edges_of(spark, rows, columns="network_id long, u long, v long, w double"):
    return spark.createDataFrame(rows, columns)


def points(seed=1, n=24, networks=2):
    rng = random.Random(seed)
    return [(k, i, rng.uniform(0, 100), rng.uniform(0, 100)) for k in range(networks) for i in range(n)]


NODES = "network_id long, node long, x double, y double"


def kruskal(rows):
    root, out = {}, set()

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for w, u, v in sorted((w, min(u, v), max(u, v)) for u, v, w in rows):
        if find(u) != find(v):
            root[find(u)] = find(v)
            out.add((u, v))
    return out


def test_spanning_trees_with_ties_and_forests(spark):
    rng = random.Random(2)
    rows = [(k, u, v, float(rng.randint(1, 4))) for k in range(3) for u, v in itertools.combinations(range(12), 2) if rng.random() < 0.3] + [(9, 1, 2, math.inf), (9, 5, 6, 1.0)]
    out = graph.spanning_tree(edges_of(spark, rows)).collect()
    for k in {r[0] for r in rows}:
        assert {(r.u, r.v) for r in out if r.network_id == k} == kruskal([r[1:] for r in rows if r[0] == k])
    pts = spark.createDataFrame([(0, i, float(i % 5), float(i // 5)) for i in range(25)] + [(1, 0, 1.0, 1.0)], NODES)
    one = {tuple(r) for r in graph.spanning_tree_of_points(pts).collect()}
    two = {tuple(r) for r in graph.spanning_tree(graph.pairs(pts)).collect()}
    assert one == two and len(one) == 24
    assert graph.spanning_tree(edges_of(spark, [])).collect() == []


def test_flows_failures_and_percolation_agree(spark):
    rng = random.Random(3)
    tree = [(0, rng.randrange(i), i, 1.0) for i in range(1, 20)]
    demand = spark.createDataFrame([(0, i, float(i % 4) * 10) for i in range(20)], "network_id long, node long, demand_kw double")
    edges = edges_of(spark, tree)
    up = graph.stored(graph.rooted(edges))
    above = graph.ancestors(up)
    flow = {(r.u, r.v): r.flow for r in network.tree_flow(up, above, demand).collect()}
    lost = {(r.u, r.v): r.stranded_kw for r in network.stranded(edges, demand).collect()}
    assert {(min(k), max(k)): f for k, f in flow.items()} == lost
    routed = {(r.u, r.v): r.flow for r in network.routed_flow(edges.withColumnRenamed("w", "length"), demand).collect()}
    assert all(routed.get((min(k), max(k)), 0.0) == f for k, f in flow.items())
    total = sum(float(i % 4) * 10 for i in range(1, 20))
    assert sum(f for (u, _), f in flow.items() if u == 0) == total
    served = netsci.percolation(above, up, demand, netsci.random_orders(up.filter("parent >= 0").select("network_id", graph.F.col("node").alias("edge")), 5)).orderBy("k").collect()
    assert served[0].served == 1.0 and len(served) == 19 and all(a.served >= b.served - 1e-12 for a, b in itertools.pairwise(served))


def test_looped_networks_have_no_bridges(spark):
    ring = [(0, i, (i + 1) % 6, 1.0) for i in range(6)]
    demand = spark.createDataFrame([(0, i, 5.0) for i in range(6)], "network_id long, node long, demand_kw double")
    edges = edges_of(spark, ring)
    assert {r.stranded_kw for r in network.stranded(edges, demand).collect()} == {0.0}
    flows = {(r.u, r.v): r.flow for r in network.design_flow(edges.withColumnRenamed("w", "length"), demand).collect()}
    assert flows[0, 1] == flows[0, 5] == 25.0  # each side can carry all
    c = centrality.connectivity(edges.withColumnRenamed("w", "length")).first()
    assert (c.edge_connectivity, c.node_connectivity, c.bridges, c.cycle_rank, c.two_edge_connected) == (2, 2, 0, 1, True)
    known = centrality.centralities(edges.withColumnRenamed("w", "length")).collect()
    assert len({round(r.betweenness, 9) for r in known}) == 1 and sum(r.pagerank for r in known) == pytest.approx(1)
    lam = netsci.spectrum(edges.withColumnRenamed("w", "conductance")).first().lambda2
    assert lam == pytest.approx(2 - 2 * math.cos(2 * math.pi / 6))


def test_pipe_capacities_are_the_catalogue_rule(spark):
    limits = [m for _, m in network.capacities()]
    assert limits == sorted(limits) and len(limits) == 22
    rows = spark.createDataFrame([(0.0,), (-1.0,), (None,), (1e9,), (limits[3],), (limits[3] * 1.0001,)], "m double")
    got = [r.dn for r in rows.select(network.pipe(graph.F.col("m")).dn.alias("dn")).collect()]
    assert got == [20, 20, None, 1000, 40, 50]


def test_covers_greedy_exact_and_augmentation(spark):
    rng = random.Random(4)
    cover = spark.createDataFrame([(0, c, c + 100, e, float(e)) for c in range(8) for e in rng.sample(range(1, 13), 4)], "network_id long, u long, v long, edge long, weight double")
    cost = spark.createDataFrame([(0, c, c + 100, 1.0 + c) for c in range(8)], "network_id long, u long, v long, cost double")
    sets = {}
    for r in cover.collect():
        sets.setdefault(r.u, set()).add(r.edge)
    for k in (1, 2, 3):
        best = max(sum(set().union(*(sets[c] for c in pick))) for pick in itertools.combinations(sets, k))
        assert search.exact_cover(cover, cost, k).first().covered == best
        gains = search.greedy_cover(cover, cost, k, "gain").collect()
        assert (1 - 1 / math.e) * best <= sum(r.gain for r in gains) <= best
    assert search.exact_cover(cover, cost, 3, budget=3.0).first().cost <= 3.0


def test_steiner_points_shorten_trees(spark):
    square = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (1, 0), (0, 1), (1, 1)])], NODES)
    r = steiner.steiner_trees(square).first()
    assert r.mst == pytest.approx(3) and 1 + math.sqrt(3) - 1e-6 <= r.length <= 3
    assert steiner.steiner_trees(square, "rectilinear").first().length == pytest.approx(3)
    more = steiner.steiner_trees(spark.createDataFrame(points(n=10), NODES)).collect()
    assert all(m.length <= m.mst + 1e-9 and m.gain_pct >= 0 for m in more)
    tri = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0, 0.5, math.sqrt(3) / 2)], "ax double, ay double, bx double, by double, cx double, cy double").selectExpr(f"{steiner.fermat()} p").first().p
    assert (tri.x, tri.y) == (pytest.approx(0.5, abs=1e-6), pytest.approx(math.sqrt(3) / 6, abs=1e-6))


def test_edge_swaps_never_cost_more(spark):
    nodes = spark.createDataFrame(points(n=9), NODES)
    dem = spark.createDataFrame([(i, j, 100.0 + 5 * math.sin(i) + j) for i in range(5) for j in range(5)], "i int, j int, z double")
    routes = graph.stored(terrain.all_routes(nodes, dem, (0.0, 0.0, 25.0, 5, 5), 10.0))
    assert routes.count() == 2 * 36
    demand = nodes.selectExpr("network_id", "node", "cast(node * 100 as double) as demand_kw")
    for r in search.swapped(routes, graph.star(nodes), demand, knn=4, sweeps=3).collect():
        assert r.after <= r.before and r.tried >= r.swaps > 0


def test_numpy_cost_equals_the_columns(spark):
    nodes = spark.createDataFrame(points(n=9, networks=1), NODES)
    dem = spark.createDataFrame([(i, j, 100.0 + i + j) for i in range(5) for j in range(5)], "i int, j int, z double")
    routes = graph.stored(terrain.all_routes(nodes, dem, (0.0, 0.0, 25.0, 5, 5), 10.0))
    demand = nodes.selectExpr("network_id", "node", "cast(node * 100 as double) as demand_kw")
    star = graph.star(nodes).join(routes, ["network_id", "u", "v"])
    up = graph.stored(graph.rooted(star))
    above = graph.ancestors(up)
    design = network.designed(star.join(network.tree_flow(up, above, demand), ["network_id", "u", "v"]))
    relief = star.groupBy("network_id").agg((graph.F.max("z_high") - graph.F.min("z_low")).alias("relief_m"))
    total = network.annual_cost(design, above, demand, relief).first().total
    own = search.Tree(routes.toPandas(), {r.node: r.demand_kw for r in demand.collect()})
    assert own.cost({(0, i) for i in range(1, 9)}) == pytest.approx(total, rel=1e-9)


def test_calibration_reaches_its_targets(spark):
    targets = {k: PUBLISHED[f"{k}_1e7"]["MST"] * 1e7 for k in ("pipe", "pressure", "heat")}
    fit = search.fitted_layout(spark, 36500.0, 11900.0, (20, 22), 20).first()
    out = search.calibrated(fit.users, fit.seed, fit.scale, targets)
    assert all(out[k] == pytest.approx(v, rel=1e-6) for k, v in targets.items())


def test_null_models_are_stable(spark):
    a, b = (sorted(map(tuple, centrality.null_models(spark, 12, 15, 20).repartition(n).collect())) for n in (1, 5))
    assert a == b and all(2 <= r[2] <= 11 for r in a)


def test_communities_of_two_cliques(spark):
    rows = [(0, u, v, 1.0) for block in (range(4), range(4, 8)) for u, v in itertools.combinations(block, 2)] + [(0, 0, 4, 1.0)]
    out = centrality.communities(edges_of(spark, rows, "network_id long, u long, v long, length double")).collect()
    assert len({r.community for r in out}) == 2 and len({r.community for r in out if r.node < 4}) == 1
    assert out[0].modularity == pytest.approx(2 * (12 / 26 - 0.25) , abs=1e-9)


def test_zones_split_steep_networks(spark):
    nodes = spark.createDataFrame([(0, i, 40.0 * i) for i in range(8)], "network_id long, node long, z double")
    edges = edges_of(spark, [(0, i, i + 1, 1.0) for i in range(7)], "network_id long, u long, v long, conductance double")
    label = {r.node: r.zone for r in netsci.zones(nodes, edges).collect()}
    spans = [[i for i in label if label[i] == z] for z in set(label.values())]
    assert len(spans) == 2 and all(40 * (max(s) - min(s)) <= 150.9 for s in spans)


def test_zones_are_cut_until_each_holds(spark):
    nodes = spark.createDataFrame([(0, i, 100.0 * i) for i in range(32)], "network_id long, node long, z double")
    edges = edges_of(spark, [(0, i, i + 1, 1.0) for i in range(31)], "network_id long, u long, v long, conductance double")
    labels = netsci.zones(nodes, edges)
    assert netsci.zone_counts(labels, edges).first()[1:] == (16, 15)  # no two neighbours but one are within 150.9 m
    assert netsci.zone_counts(netsci.zones(nodes, edges, 8), edges).first()[1:] == (8, 7)


def test_geojson_round_trip(spark, tmp_path):
    def feature(ident, cells, homes):
        return {"type": "Feature", "geometry": None, "properties": {"ID": ident, "GEN": "town", "LAN": "XX", "area": 1.5, "DH_demand": 10.0, "DH_supplied_households": homes, "DH_cells": cells}}

    for i, cells in enumerate(("[[1, 2], [3, 4]]", [[5, 6]], None, "broken")):
        (tmp_path / f"heatgrids_{i}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature(f"d{i}", cells, None if i else 7)]}))
    rows = geojson.districts(spark, f"{tmp_path}/heatgrids_*.geojson")
    got = {r.ident: r for r in geojson.by_ident(rows.unionByName(rows.withColumns({"file": geojson.F.lit(""), "households": geojson.F.lit(99)}))).collect()}
    assert len(got) == 4 and got["d0"].households == 7 and got["d1"].households == 0
    assert [(c.x, c.y) for c in got["d0"].cells] == [(1.0, 2.0), (3.0, 4.0)] and got["d1"].cells[0].x == 5.0 and got["d2"].cells is None
    assert geojson.cells(rows).count() == 3
    geojson.write_results(rows.select("ident"), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 4
    assert geojson.grid(spark, (0.0, 1000.0), (0.0, 500.0)).count() == 21 * 16


def test_clusters_become_nodes(spark):
    from heatlattice.operators import nodes as nd

    rng = np.random.default_rng(0)
    cells = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 1, (60, 2)) + np.repeat([[0, 0], [50, 0], [0, 50]], 20, axis=0))], "network_id long, cell_id long, x double, y double")
    out = nd.assembled(nd.substations(nd.clustered(cells, 3), 900.0), nd.hub(cells)).orderBy("node").collect()
    assert [r.n_cells for r in out] == [0.0, 20.0, 20.0, 20.0] and out[0].demand_kw == pytest.approx(-450.0) and out[1].demand_kw == pytest.approx(150.0)
