"""Centralities and communities of networks with thousands of hanging nodes, against plain definitions on small ones."""

import random
import time
from collections import deque

import numpy as np
import pytest

from heatlattice.operators import centrality

EDGES = "network_id long, u long, v long, length double"


def by_definition(edges: list[tuple[int, int, float]]) -> dict[int, tuple[float, float]]:
    """betweenness and closeness of each node; lengths are whole, so paths are counted exactly."""
    near: dict[int, dict[int, float]] = {}
    for u, v, length in edges:
        near.setdefault(u, {})[v] = length
        near.setdefault(v, {})[u] = length
    names, dist, ways = sorted(near), {}, {}
    for s in names:
        d, queue = {s: 0.0}, deque([s])
        while queue:
            u = queue.popleft()
            for v, length in near[u].items():
                if v != u and d[u] + length < d.get(v, np.inf):
                    d[v] = d[u] + length
                    queue.append(v)
        n = {s: 1}
        for v in sorted(d, key=d.get)[1:]:
            n[v] = sum(n[u] for u, length in near[v].items() if u != v and d[u] + length == d[v])
        dist[s], ways[s] = d, n
    out, count = {}, len(names)
    for x in names:
        through = sum(ways[s][x] * ways[x][t] / ways[s][t] for s in names for t in dist[s] if x in dist[s] and x not in (s, t) and s != t and dist[s][x] + dist[x][t] == dist[s][t])
        total, reach = sum(dist[x].values()), len(dist[x]) - 1
        out[x] = through / ((count - 1) * (count - 2)), reach / total * reach / (count - 1) if total else 0.0
    return out


@pytest.mark.parametrize("seed", range(6))
def test_folded_trees_keep_betweenness_and_closeness(spark, seed):
    rng, n = random.Random(seed), 24
    edges = [(i, rng.randrange(i), float(rng.randrange(1, 4))) for i in range(1, n) if seed % 3 or i != 9]
    edges += [(*rng.sample(range(n), 2), float(rng.randrange(1, 4))) for _ in range((0, 3, 9)[seed % 3])] + [(40, 41, 2.0)]
    edges = list({(min(u, v), max(u, v)): (u, v, length) for u, v, length in edges}.values())
    got = centrality.centralities(spark.createDataFrame([(1, *e) for e in edges], EDGES)).collect()
    want = by_definition(edges)
    assert sorted(r.node for r in got) == sorted(want)
    for r in got:
        assert abs(r.betweenness - want[r.node][0]) < 1e-9 and abs(r.closeness - want[r.node][1]) < 1e-9


def hung(n: int, key: int) -> list[tuple[int, int, int, float]]:
    """Six nodes, each joined with each, and n that hang on them."""
    return [(key, u, v, 3.0 + u) for u in range(6) for v in range(u + 1, 6)] + [(key, i % 5 + 1, 100 + i, 1.0 + i % 97) for i in range(n)]


def test_lanczos_and_sparse_ranks_are_those_of_the_whole_matrix(spark, monkeypatch):
    rng = random.Random(1)
    edges = [e[1:3] for e in hung(60, 1)] + [(100 + a, 100 + b) for a, b in (rng.sample(range(60), 2) for _ in range(40))]
    n = 166
    a = np.zeros((n, n))
    for u, v in edges:
        a[u, v] = a[v, u] = 1
    kept = np.flatnonzero(a.sum(1))
    a = a[np.ix_(kept, kept)]
    monkeypatch.setattr(centrality, "MOST_DENSE", 10)
    u, v = np.nonzero(a)
    lead = centrality._leading(u, v, len(kept))
    assert np.abs(np.abs(np.linalg.eigh(a)[1][:, -1]) - np.abs(lead)).max() < 1e-9
    rows = centrality.centralities(spark.createDataFrame([(1, *e, 1.0) for e in edges], EDGES)).orderBy("node").collect()
    rank = np.full(len(kept), 1 / len(kept))
    for _ in range(200):
        rank = 0.15 / len(kept) + 0.85 * (a / a.sum(1, keepdims=True)).T @ rank
    assert [r.node for r in rows] == kept.tolist() and np.abs(rank - [r.pagerank for r in rows]).max() < 1e-12


def test_centralities_of_a_large_network_end(spark):
    began = time.monotonic()
    rows = centrality.centralities(spark.createDataFrame(hung(6000, 1), EDGES)).toPandas()
    assert len(rows) == 6006 and abs(rows.pagerank.sum() - 1) < 1e-9 and time.monotonic() - began < 60


def merged_by_definition(edges: list[tuple[int, int]]) -> dict[int, int]:
    """Every pair of communities compared at every step."""
    names = sorted({x for e in edges for x in e})
    m, label = len(edges), {x: x for x in names}
    degree = {x: sum(x in e for e in edges) for x in names}
    while True:
        between: dict[tuple[int, int], int] = {}
        for u, v in edges:
            a, b = sorted((label[u], label[v]))
            if a != b:
                between[a, b] = between.get((a, b), 0) + 1
        share = {c: sum(degree[x] for x in names if label[x] == c) for c in set(label.values())}
        # gains in whole numbers, so equal ones are equal
        gain, a, b = max(((2 * m * w - share[a] * share[b], -a, -b) for (a, b), w in between.items()), default=(0, 0, 0))
        if gain <= 0:
            return label
        label = {x: -a if c == -b else c for x, c in label.items()}


def test_communities_are_those_of_every_pair_compared(spark):
    rng, rows, want = random.Random(4), [], {}
    for key in range(40):
        n = rng.randrange(4, 26)
        m = 2 ** rng.randrange(3, 6)  # shares are sums of halves of it, so doubles are exact
        pairs = [(u, v) for u in range(n) for v in range(u + 1, n)]
        edges = rng.sample(pairs, min(m, 2 ** (len(pairs).bit_length() - 1)))
        rows += [(key, *e, 1.0) for e in edges]
        want |= {(key, x): c for x, c in merged_by_definition(edges).items()}
    assert {(r.network_id, r.node): r.community for r in centrality.communities(spark.createDataFrame(rows, EDGES)).collect()} == want


def test_communities_of_a_large_network_end(spark):
    began = time.monotonic()
    rows = centrality.communities(spark.createDataFrame(hung(20000, 1), EDGES)).toPandas()
    assert len(rows) == 20006 and rows.community.nunique() == 5 and time.monotonic() - began < 60
