"""Pairs, trees and routes by blocks of nodes, against plain versions."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from heatlattice.operators import graph, steiner, terrain
from heatlattice.plans import queries

NODES = "network_id long, node long, x double, y double"


def points():
    rng = random.Random(4)
    out = [(1, 3 * i, rng.random() * 400, rng.random() * 300) for i in range(40)]
    out += [(2, i, float(i % 4) * 50, float(i // 4) * 50) for i in range(12)]  # ties
    return out + [(3, 5, 1.0, 1.0), (4, 0, 2.0, 2.0), (4, 9, 2.0, 2.0)]


@pytest.fixture
def nodes(spark):
    return spark.createDataFrame(points(), NODES)


@pytest.mark.parametrize("block", [512, 5])
def test_distances(nodes, monkeypatch, block):
    monkeypatch.setattr(graph, "BLOCK", block)
    monkeypatch.setattr(graph.dealt, "__defaults__", (block,))
    got = sorted(tuple(r) for r in graph.distances(nodes, {"w": "euclidean", "l1": "rectilinear"}).collect())
    want = [(n, u, v, math.sqrt((a - c) * (a - c) + (b - d) * (b - d)), abs(a - c) + abs(b - d)) for n, u, a, b in points() for m, v, c, d in points() if n == m and u < v]
    assert got == sorted(want)


def test_no_task_makes_most_pairs_of_a_network(spark):
    one = spark.range(3000).selectExpr("id div 3000 AS network_id", "id AS node", "rand(1) AS x", "rand(2) AS y")
    for made in (graph.pairs(one), steiner.hanan(one)):
        sizes = [n for n in made.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()]
        assert max(sizes) < sum(sizes) / 2


def test_thinning_keeps_the_tree(spark, nodes, monkeypatch):
    monkeypatch.setattr(graph, "HELD_EDGES", 7)
    want = sorted(map(tuple, graph.boruvka(graph.pairs(nodes)).collect()))
    kept = graph.thinned(graph.pairs(nodes).coalesce(2))
    assert kept.count() <= 2 * 54
    for most in (1 << 21, 3):  # in one task, and by rounds
        monkeypatch.setattr(graph, "MOST_EDGES", most)
        assert sorted(map(tuple, graph.spanning_tree(graph.pairs(nodes)).collect())) == want


def land(spark):
    return spark.createDataFrame([(i, j, (i * 7 + j * 13) % 29 + i / 8) for i in range(41) for j in range(31)], "i int, j int, z double"), (0.0, 0.0, 25.0, 41, 31)


def near(got, want):
    assert len(got) == len(want) and list(got.columns) == list(want.columns)
    for c in got.columns:
        assert got[c].tolist() == pytest.approx(want[c].tolist(), rel=1e-12, abs=1e-12), c


@pytest.mark.parametrize("extra", [{}, {"grounds": {"w_0": terrain.Ground(a1=0.0)}}, {"scales": {0: 0.0, 3: 2.5}}])
def test_routes_of_blocks_equal_sampled_ones(spark, nodes, monkeypatch, extra):
    monkeypatch.setattr(terrain, "BLOCK", 5)
    dem, grid = land(spark)
    columns = ["network_id", "u", "v", *(["scale"] if "scales" in extra else [])]
    table = lambda df: df.toPandas().sort_values(columns, ignore_index=True)
    made = terrain.all_routes(nodes, dem, grid, 10.0, **extra)
    want = terrain.sampled_routes(nodes, dem, grid, 10.0, extra.get("grounds"), extra.get("scales"))
    near(table(made), table(want)[made.columns])
    # no row for each sample
    assert "chainage" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_trees_and_nearest_routes(spark, nodes, monkeypatch):
    monkeypatch.setattr(terrain, "BLOCK", 5)
    dem, grid = land(spark)
    rows = lambda df: sorted(map(tuple, df.select("network_id", "u", "v").collect()))
    routes = graph.stored(terrain.sampled_routes(nodes, dem, grid, 10.0, None, None))
    steep = {"w_0": terrain.Ground(a1=0.0, a2=0.0), "w_1": terrain.Ground(a1=9.0)}
    sloped = graph.stored(terrain.sampled_routes(nodes, dem, grid, 10.0, steep, None))
    scaled = graph.stored(terrain.sampled_routes(nodes, dem, grid, 10.0, None, {2: 0.5, 4: 1.5}))
    for most in (1 << 24, 0):  # by blocks, and by samples
        monkeypatch.setattr(terrain, "BROADCAST_BYTES", most)
        assert rows(terrain.trees(nodes, dem, grid, 10.0)) == rows(graph.boruvka(routes))
        made = terrain.trees(nodes, dem, grid, 10.0, grounds=steep)
        for i, c in enumerate(steep):
            assert rows(made.filter(f"variant = {i}")) == rows(graph.boruvka(sloped.select("network_id", "u", "v", sloped[c].alias("w"))))
        made = terrain.trees(nodes, dem, grid, 10.0, scales={2: 0.5, 4: 1.5})
        for i in (2, 4):
            assert rows(made.filter(f"variant = {i}")) == rows(graph.boruvka(scaled.filter(f"scale = {i}")))
        finite = routes.filter("w < double('infinity')").toPandas()
        both = pd.concat([finite, finite.rename(columns={"u": "v", "v": "u"})]).sort_values(["network_id", "u", "w", "v"]).groupby(["network_id", "u"]).head(3)
        want = {(n, min(u, v), max(u, v)) for n, u, v in zip(both.network_id, both.u, both.v, strict=True)}
        assert rows(terrain.nearest_routes(nodes, dem, grid, 3, 10.0)) == sorted(want)


@pytest.mark.parametrize("extra", [{}, {"scales": {0: 0.0, 3: 2.5}}])
def test_trees_sample_no_block_of_all_pairs(spark, nodes, monkeypatch, extra):
    dem, grid = land(spark)
    routes = terrain.sampled_routes(nodes, dem, grid, 10.0, None, extra.get("scales"))
    routes = graph.stored(routes.select("network_id", "scale" if extra else terrain.F.lit(0).alias("scale"), "u", "v", "w"))
    monkeypatch.setattr(terrain, "by_blocks", None)
    monkeypatch.setattr(terrain, "TREE_BLOCK", 5, raising=False)
    monkeypatch.setattr(terrain, "TREE_ROUTES", 9, raising=False)
    made = terrain.trees(nodes, dem, grid, 10.0, **extra).collect()
    for i in extra.get("scales", {0: 1.0}):
        want = graph.boruvka(routes.filter(f"scale = {i}").drop("scale")).select("network_id", "u", "v").collect()
        assert sorted(r[:1] + r[2:4] for r in map(tuple, made) if r[1] == i) == sorted(map(tuple, want))


def test_rooting_in_a_task_equals_rounds(spark):
    rng = random.Random(6)
    rows = [(n, *rng.choices(range(12), k=2)) for n in range(5) for _ in range(4 * n)] + [(7, 1, 2), (8, 0, 0), (9, 0, 3), (9, 3, 0), (9, 5, 6)]
    edges = spark.createDataFrame(rows, "network_id long, u long, v long")
    made = sorted(map(tuple, graph.rooted(edges).collect()))
    assert made == sorted(map(tuple, graph.rooted_by_rounds(edges).collect())) and (9, 3, 0, 1) in made


def test_a_long_path_is_rooted_in_few_jobs(spark):
    path = spark.range(300).selectExpr("1L AS network_id", "id AS u", "id + 1 AS v")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("rooting"))
    spark.sparkContext.setJobGroup("rooting", "rooting")
    assert max(r.depth for r in graph.rooted(path).collect()) == 300 and 0 < jobs() < 20
    spark.sparkContext.setJobGroup("rest", "rest")


def test_medians(spark):
    rng = np.random.default_rng(1)
    rows = [(n, float(w)) for n, size in ((1, 1), (2, 2), (3, 301), (4, 400)) for w in np.round(rng.random(size) * 50 + 1e-3, 1 + n % 2)]
    got = {r.network_id: r.median for r in queries.medians(spark.createDataFrame(rows, "network_id long, w double")).collect()}
    assert got == pytest.approx({n: float(np.median([w for m, w in rows if m == n])) for n in (1, 2, 3, 4)})


def test_connectivity_against_removals(spark):
    import itertools
    import time

    from heatlattice.operators import centrality

    def joined(nodes, edges):
        reach = {next(iter(nodes))} if nodes else set()
        while more := {b for u, v in edges for a, b in ((u, v), (v, u)) if a in reach and b in nodes} - reach:
            reach |= more
        return len(reach) == len(nodes)

    rng, nets = random.Random(8), {}
    for n in range(40):
        size = rng.randint(2, 7)
        every = list(itertools.combinations(range(size), 2))
        nets[n] = rng.sample(every, rng.randint(1, len(every)))
    rows = [(n, u, v, 1.0) for n, es in nets.items() for u, v in es]
    got = {r.network_id: r for r in centrality.connectivity(spark.createDataFrame(rows, "network_id long, u long, v long, length double")).collect()}
    for n, es in nets.items():
        nodes = {x for e in es for x in e}
        edge = next(k for k in range(len(es) + 1) if any(not joined(nodes, set(es) - set(c)) for c in itertools.combinations(es, k)))
        node = next((k for k in range(len(nodes) - 1) if any(not joined(nodes - set(c), es) for c in itertools.combinations(nodes, k))), len(nodes) - 1)
        bridges = sum(not joined(nodes, set(es) - {e}) for e in es) if edge else 0
        assert (got[n].edge_connectivity, got[n].node_connectivity, got[n].bridges) == (edge, node, bridges)
    tree = spark.range(1, 6001).selectExpr("1L AS network_id", "id div 3 AS u", "id AS v", "1D AS length")
    start = time.time()
    r = centrality.connectivity(tree).first()
    assert (r.edge_connectivity, r.node_connectivity, r.bridges) == (1, 1, 6000) and time.time() - start < 30


def test_fiedler_vectors_of_large_networks(monkeypatch):
    from heatlattice.operators import netsci

    rng = random.Random(9)
    for chords in (0, 1, 6):
        rows = [(rng.randrange(max(0, i - 9), i), i, 1 / (1 + rng.random() * 9)) for i in range(1, 120)]
        rows += [(*rng.sample(range(120), 2), 0.3 + rng.random()) for _ in range(chords)]
        rows += rows[:2]  # parallel
        pdf = pd.DataFrame(rows, columns=["u", "v", "conductance"])
        names, lap = netsci._laplacian(pdf)
        values, vectors = np.linalg.eigh(lap)
        monkeypatch.setattr(netsci, "MOST_DENSE", 10)
        found, second, f = netsci._fiedler(pdf)
        assert found.tolist() == names.tolist() and second == pytest.approx(values[1], rel=1e-9)
        assert abs(f @ vectors[:, 1]) == pytest.approx(1, abs=1e-9)
    two = pd.DataFrame([(10 * k + i, 10 * k + i + 1, 1.0) for k in (0, 5) for i in range(9)], columns=["u", "v", "conductance"])
    _, second, f = netsci._fiedler(two)
    assert second == 0 and len(set(np.sign(f[:10]))) == 1 and (np.sign(f[:10]) == -np.sign(f[10:])).all()


def test_zones_of_a_large_network_end(spark):
    from heatlattice.operators import netsci

    n = 6000  # all eigenvalues of it take minutes
    edges = spark.range(1, n + 1).selectExpr("1L AS network_id", "id div 7 AS u", "id AS v", "1D + id % 5 AS conductance")
    r = netsci.spectrum(edges).agg({"lambda2": "max", "fiedler": "sum"}).first()
    assert r["max(lambda2)"] > 0 and abs(r["sum(fiedler)"]) < 1e-6


def test_steiner_trees_of_a_task_equal_those_of_rounds(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(n, i, rng.random() * 100, rng.random() * 100) for n, size in ((1, 9), (2, 6), (3, 1), (4, 2)) for i in range(size)]
    nodes = spark.createDataFrame(rows, NODES)
    jobs = []
    for work in (steiner.TASK_WORK, -1):
        monkeypatch.setattr(steiner, "TASK_WORK", work)
        monkeypatch.setattr(steiner, "TIES", 50)
        spark.sparkContext.setJobGroup(f"work {work}", "steiner")
        jobs.append((sorted(map(tuple, steiner.designs(nodes).collect())), len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"work {work}"))))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert jobs[0][0] == jobs[1][0] and jobs[0][1] < jobs[1][1]


def test_swaps_of_networks_run_apart(spark):
    from heatlattice.operators import search

    pairs = spark.createDataFrame([(n, 0, 1, 5.0, 5.0, 0.0, 1.0) for n in range(8)], "network_id long, u long, v long, w double, l3d double, z_low double, z_high double")
    demand = spark.createDataFrame([(n, 1, 50.0) for n in range(8)], "network_id long, node long, demand_kw double")
    made = search.swapped(pairs, pairs.select("network_id", "u", "v"), demand)
    sizes = made.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 8 and sum(n > 0 for n in sizes) >= 4


def test_tree_edges_without_a_row_for_each_pair(spark, nodes, monkeypatch):
    from heatlattice.plans import queries

    monkeypatch.setattr(queries, "frame", lambda *_: nodes)
    monkeypatch.setattr(graph, "distances", None)
    got = {tuple(r) for r in queries.mst_edges(spark, "").select("network_id", "u", "v").collect()}
    for n in {p[0] for p in points()}:
        at = {node: (x, y) for m, node, x, y in points() if m == n}
        part, want = {k: k for k in at}, set()
        for _, u, v in sorted((math.sqrt((at[u][0] - at[v][0]) ** 2 + (at[u][1] - at[v][1]) ** 2), u, v) for u in at for v in at if u < v):
            if part[u] != part[v]:
                want.add((n, u, v))
                part = {k: part[u] if c == part[v] else c for k, c in part.items()}
        assert {e for e in got if e[0] == n} == want
