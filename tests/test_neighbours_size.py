"""Neighbours by cells: candidates are no rows, and nothing that grows is broadcast."""

import random

import numpy as np
import pandas as pd

from heatlattice.operators import graph, netsci

NODES = "network_id long, node long, x double, y double"


def cloud(n: int) -> list[tuple[int, int, float, float]]:
    rng = random.Random(2)
    dense = [(1, i, rng.gauss(0, 1) * 10.0 ** (i % 4), rng.gauss(0, 1)) for i in range(n)]
    return dense + [(1, n + i, 5.0, 5.0) for i in range(15)] + [(2, i, float(i % 9), float(i // 9)) for i in range(n)]


def test_cells_find_what_a_search_of_all_finds(spark, monkeypatch):
    rows = cloud(300)
    near = {(k, a, b) for k, a, b, _ in graph.neighbours(spark.createDataFrame(rows, NODES), 4).collect()}
    monkeypatch.setattr(graph, "MOST_POINTS", 10)
    made = graph.neighbours(spark.createDataFrame(rows, NODES), 4)
    assert {(r.network_id, r.a, r.b) for r in made.collect()} == near and len(near) == 4 * len(rows)


def test_a_place_keeps_its_nearest_nodes_where_it_asks():
    asked = pd.DataFrame({"network_id": 1, "place": [7, 9], "ax": [0.0, 2.0], "ay": 0.0, "side": 4.0})
    index = pd.DataFrame({"x": [2.0, 0.0, 1.0], "y": 0.0, "nodes": [np.array([9]), np.array([7, 8]), np.array([3])]})
    out = graph._nearest(asked, index, 3, "euclidean")
    assert [list(v) for v in out.v] == [[7, 8, 3], [9, 3, 7]] and [list(w) for w in out.w] == [[0, 0, 1], [0, 1, 2]]


def test_tables_that_grow_are_not_sent_to_the_driver(spark):
    nodes = graph.stored(spark.createDataFrame(cloud(100), NODES))
    edges = graph.stored(graph.nearest_of_points(nodes, 4))
    for made in (netsci.triangles(nodes, edges), netsci.assortativity(nodes, edges), netsci.degrees(nodes, edges)):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
