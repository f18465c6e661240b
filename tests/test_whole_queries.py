"""Queries without SQL do the whole job of their operators."""

import math

from pyspark.sql import functions as F

from heatlattice.operators import centrality, graph, netsci, network, search
from heatlattice.plans import queries, studies

NODES = "network_id long, node long, x double, y double"


def test_steiner_points_go_in_until_none_helps(spark, monkeypatch):
    at = [(0.0, 0.0), (1.0, 0.0), (0.5, math.sqrt(3) / 2)]
    rows = [(1, 3 * t + i, x + 10.0 * t, y) for t in range(5) for i, (x, y) in enumerate(at)]
    monkeypatch.setattr(queries, "frame", lambda *_: spark.createDataFrame(rows, NODES))
    assert queries.steiner_trees(spark, "").first().n_points == 5


def test_edge_swaps_has_the_operators_limits(spark, monkeypatch):
    sites = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1.0, 0.0)], NODES)
    monkeypatch.setattr(studies, "routed", lambda *_: (sites, None))
    monkeypatch.setattr(studies.search, "swapped", lambda routes, trees, demand, knn=8, sweeps=30: (knn, sweeps))
    assert studies.edge_swaps(spark, "") == (8, 30)


def test_null_models_have_each_networks_size(spark, monkeypatch):
    edges = [(1, 0, i) for i in range(1, 4)] + [(2, i, i + 1) for i in range(79)] + [(3, 0, 1)]
    nodes = [(k, i) for k, n in ((1, 4), (2, 80), (3, 2)) for i in range(n)]
    e, nd = spark.createDataFrame(edges, "network_id long, u long, v long"), spark.createDataFrame(nodes, "network_id long, node long")
    monkeypatch.setattr(studies, "frame", lambda spark, sf_dir, text: nd if text == studies.fx.TREE_NODES else e)
    out = {r.network_id: r for r in studies.null_models(spark, "").collect()}
    # a node's degree in a random tree of n nodes has variance (n - 2)(1 - 1 / n) / n; within a tree, n - 1 of n of it is left
    for k, n in ((1, 4), (2, 80), (3, 2)):
        assert abs(out[k].tree_var - (n - 2) * (n - 1) / n**2) < 0.08, k
    trials = centrality.null_models_of(netsci.degrees(nd, e))
    assert sorted(map(tuple, trials.collect())) == sorted(map(tuple, centrality.null_models_of(netsci.degrees(nd.repartition(3), e)).collect()))
    assert trials.count() == 600


def test_route_metrics_against_brute_force(spark, monkeypatch):
    sites = [(k, i, 2000.0 + 90 * i + 7 * k, 1500.0 + 40 * i * (i % 3) - 11 * k) for k in (1, 2) for i in range(5)]
    nx, ny = queries.NX, queries.NY
    dem = [(i, j, 100 + 40 * math.sin(i / 5) + 25 * math.cos(j / 4) + (i * 7 + j * 3) % 11) for i in range(nx) for j in range(ny)]
    z = {(i, j): h for i, j, h in dem}
    monkeypatch.setattr(queries, "frame", lambda *_: spark.createDataFrame(sites, NODES))
    monkeypatch.setattr(queries, "grid", lambda *_: spark.createDataFrame(dem, "i int, j int, z double"))

    def height(x, y):
        a, b = ((v - at) / queries.STEP for v, at in ((x, queries.X0), (y, queries.Y0)))
        i, j = int(a), int(b)
        a, b = a - i, b - j
        return z[i, j] * (1 - a) * (1 - b) + z[i + 1, j] * a * (1 - b) + z[i, j + 1] * (1 - a) * b + z[i + 1, j + 1] * a * b

    want = {}
    for k, u, ux, uy in sites:
        for other, v, vx, vy in sites:
            if k == other and u < v:
                flat = math.hypot(vx - ux, vy - uy)
                n = max(2, math.ceil(flat / 25) + 1)
                hs = [height(ux + t / (n - 1) * (vx - ux), uy + t / (n - 1) * (vy - uy)) for t in range(n)]
                rises = [b - a for a, b in zip(hs, hs[1:], strict=False)]
                want[k, u, v] = flat, sum(math.hypot(flat / (n - 1), r) for r in rises), sum(max(r, 0) for r in rises)
    got = {(r.network_id, r.u, r.v): (r.l2d, r.l3d, r.climb) for r in queries.route_metrics(spark, "").collect()}
    assert set(got) == set(want) and all(abs(a - b) < 1e-4 for key in want for a, b in zip(got[key], want[key], strict=True))


def test_published_comparison_gives_the_known_errors(spark):
    out = {(r.metric, r.topology): r.error_pct for r in studies.published_comparison(spark, "").collect()}
    # known results: the star's column is held out of the calibration
    known = {"length_1e4_m": 0.0, "pipe_1e7": 28.4565, "pressure_1e7": 112.9636, "heat_1e7": -34.5558, "total_1e7": 7.5419}
    assert all(abs(out[m, "Star"] - x) < 1e-3 for m, x in known.items())
    assert all(abs(out[m, "MST"] - x) < 1e-3 for m, x in (known | {"length_1e4_m": 0.003646, "pipe_1e7": 0, "pressure_1e7": 0, "heat_1e7": 0, "total_1e7": -0.137618}).items())


def test_topologies_side_by_side(spark, monkeypatch):
    sites = [(k, i, 2000.0 + 90 * i * (1 + i % 2) + 7 * k, 1500.0 + 40 * i * (i % 3) - 11 * k) for k in (1, 2) for i in range(7)]
    dem = spark.createDataFrame([(i, j, 100 + 40 * math.sin(i / 5) + 25 * math.cos(j / 4)) for i in range(queries.NX) for j in range(queries.NY)], "i int, j int, z double")
    monkeypatch.setattr(studies, "frame", lambda *_: spark.createDataFrame(sites, NODES))
    monkeypatch.setattr(studies, "grid", lambda *_: dem)
    out = {(r.network_id, r.topology): r for r in studies.topology_study(spark, "").collect()}
    assert set(out) == {(k, t) for k in (1, 2) for t in studies.TOPOLOGIES}
    for k in (1, 2):
        one = {t: out[k, t] for t in studies.TOPOLOGIES}
        assert all(abs(r.total - r.capital - r.pumping - r.heat_loss - r.zones) < 1e-6 * r.total and r.delivered_mwh == one["star"].delivered_mwh for r in one.values())
        assert one["star"].length_l2d > one["mst_map"].length_l2d >= one["steiner"].length_l2d - 1e-6
        assert one["mst_terrain"].length_lw <= one["mst_map"].length_lw + 1e-6 and one["star"].max_hops == 1
        assert sorted(r.place for r in one.values()) == [1, 2, 3, 4, 5]
    sweep = studies.slope_sweep(spark, "").collect()
    assert len(sweep) == 10 and all(abs(r.saving_pct - r.d_capital_pct - r.d_pumping_pct - r.d_heat_loss_pct - r.d_zones_pct) < 1e-5 for r in sweep)


def test_large_point_sets_make_no_pairs(spark, monkeypatch):
    import random

    random.seed(3)
    rows = [(k, i, float(random.randint(0, 30)), float(random.randint(0, 30))) for k, n in ((1, 90), (2, 12)) for i in range(n)]  # with ties
    nodes = spark.createDataFrame(rows, NODES)
    whole = sorted(map(tuple, graph.spanning_tree_of_points(nodes).collect()))
    monkeypatch.setattr(graph, "MOST_POINTS", 16)
    monkeypatch.setattr(graph, "pairs", None)
    assert sorted(map(tuple, graph.spanning_tree_of_points(nodes).collect())) == whole


def test_networks_without_demand_edges_or_connection(spark):
    edges = spark.createDataFrame([(1, 0, 1, 5.0), (1, 2, 3, 1.0)], "network_id long, u long, v long, length double")
    demand = spark.createDataFrame([(1, 1, 0.0)], "network_id long, node long, demand_kw double")
    for e in (edges, edges.limit(0)):
        out = network.routed_flow(e, demand)
        assert out.columns == ["network_id", "u", "v", "flow", "infeasible"] and out.collect() == []
    none = search.augmented(*(spark.createDataFrame([], x) for x in ("network_id long, edge long, eud double, stranded_kw double", "network_id long, u long, v long, edge long", "network_id long, u long, v long, lw double")), 2)
    assert none.columns == ["network_id", "u", "v", "cost", "eud_after", "worst_after", "step"] and none.collect() == []
    c = centrality.connectivity(edges).first()
    assert (c.edge_connectivity, c.bridges, c.bridge_fraction, c.cycle_rank, c.two_edge_connected) == (0, 0, 0.0, 0, False)


def test_augmented_with_a_price_of_ones_own(spark):
    """Step by step by hand: what a chord saves by what it costs, which falls with the load that is left to back up."""
    bridges = [(k, e, 10.0 * e + k, 100.0 * (e % 4 + 1)) for k in (1, 2) for e in range(1, 8)]
    chords = [(k, u, u + 1, 5.0 + u * u) for k in (1, 2) for u in range(5)] + [(1, 8, 9, None), (2, 8, 9, -1.0)]
    above = [(k, u, v, e) for k, u, v, _ in chords for e in range(1, 8) if (e * (u + 2) + k) % 3 == 0]
    frames = [spark.createDataFrame(rows, s) for rows, s in ((bridges, "network_id long, edge long, eud double, stranded_kw double"), (above, "network_id long, u long, v long, edge long"), (chords, "network_id long, u long, v long, metres double"))]
    got = search.augmented(*frames, 3, F.col("metres") * 2 + F.col("backup") / 10).collect()
    want = set()
    for k in (1, 2):
        left = {e: (eud, kw) for net, e, eud, kw in bridges if net == k}
        for step in (1, 2, 3):
            backup = max((kw for _, kw in left.values()), default=0.0)
            saved = []
            for net, u, v, metres in chords:
                cuts = {e for n, a, b, e in above if (n, a, b) == (k, u, v)} & left.keys()
                if net == k and cuts and metres is not None and metres * 2 + backup / 10 > 0:
                    cost = metres * 2 + backup / 10
                    saved.append((-sum(left[e][0] for e in cuts) / cost, u, v, cost, cuts))
            if saved:
                _, u, v, cost, cuts = min(saved, key=lambda s: s[:3])
                left = {e: x for e, x in left.items() if e not in cuts}
                want.add((k, step, u, v, round(cost, 9), round(sum(x for x, _ in left.values()), 9), max((x for _, x in left.values()), default=0.0)))
    assert {(r.network_id, r.step, r.u, r.v, round(r.cost, 9), round(r.eud_after, 9), r.worst_after) for r in got} == want and len(got) == len(want) > 2
