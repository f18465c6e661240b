"""Chords of all pairs and flows after failures, without a row an edge or a round a hop."""

import random

from pyspark.sql import functions as F

from heatlattice.operators import graph, network, search

PAIRS = "network_id long, u long, v long, lw double"


def trees(seed: int, sizes: dict[int, int]) -> list[tuple[int, int, int]]:
    rng = random.Random(seed)
    return [(k, i, rng.randrange(max(0, i - 6), i)) for k, n in sizes.items() for i in range(1, n)]


def test_chords_of_all_pairs_are_those_picked_edge_by_edge(spark):
    rng, rows = random.Random(3), trees(5, {1: 30, 2: 12, 3: 2})
    tree = spark.createDataFrame([*((k, i, up, 0) for k, i, up in rows), *((k, 0, -1, 0) for k in (1, 2, 3))], "network_id long, node long, parent long, depth int")
    bridges = spark.createDataFrame([(k, i, up, rng.uniform(0.1, 2), rng.uniform(5, 900)) for k, i, up in rows], "network_id long, edge long, parent long, eud double, stranded_kw double")
    edges = {(k, min(a, b), max(a, b)) for k, a, b in rows}
    # node 40 is not reached by the hub
    chords = [(k, u, v, rng.uniform(50, 500)) for k, n in ((1, [*range(30), 40]), (2, range(12)), (3, range(2))) for u in n for v in n if u < v and (k, u, v) not in edges]
    chords = spark.createDataFrame(chords, PAIRS)
    cover = graph.path_edges(graph.ancestors(tree), chords.select("network_id", "u", "v"))
    want = {(r.network_id, r.step): r for r in search.augmented(bridges.drop("parent"), cover, chords, 3).collect()}
    for block in (4, 512):
        made = search.augmented_pairs(bridges, chords, 3, block)
        assert "cover" not in made.columns
        got = {(r.network_id, r.step): r for r in made.collect()}
        assert set(got) == set(want) and {k for k, _ in got} == {1, 2}
        for at, r in want.items():
            assert (got[at].u, got[at].v) == (r.u, r.v)
            assert all(abs(got[at][c] - r[c]) < 1e-9 for c in ("cost", "eud_after", "worst_after"))
    assert search.augmented_pairs(bridges, chords.limit(0), 3).collect() == []


def test_design_flows_of_one_task_are_those_of_the_rounds(spark):
    rng, rows = random.Random(7), trees(9, {1: 25, 2: 40, 3: 3, 4: 6})
    rows += [(k, rng.randrange(n), rng.randrange(n)) for k, n in ((1, 25), (2, 40)) for _ in range(12)] + [(3, 8, 9), (3, 1, 1)]
    edges = spark.createDataFrame([(*r, float(rng.randrange(1, 9))) for r in rows], "network_id long, u long, v long, length double")
    demand = [(k, i, rng.choice([-5.0, 0.0, 10.0, 35.5])) for k, n in ((1, 25), (2, 40), (3, 3)) for i in range(n)] + [(4, 5, 7.0), (4, 77, 1.0)]
    demand = spark.createDataFrame(demand, "network_id long, node long, demand_kw double")
    flows = lambda df: {(r.network_id, r.u, r.v): round(r.flow, 9) for r in df.collect()}
    want = flows(network.design_flow(edges, demand))
    assert flows(network.design_flow_alone(edges, demand)) == want and any(want.values()) and {k for k, *_ in want} == {1, 2, 3, 4}
    assert flows(network.design_flow_alone(edges, demand, 30)) == want
    tree = graph.rooted(edges)
    ways = lambda df: sorted(map(tuple, df.select("network_id", "node", "ancestor", F.col("hops").cast("int")).collect()))
    assert ways(graph.ancestors_alone(tree)) == ways(graph.ancestors_alone(tree, 20)) == ways(graph.ancestors(tree))
