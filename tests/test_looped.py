"""Networks with loops against all simple paths of small graphs."""

import random
from collections import defaultdict
from fractions import Fraction

import pytest

from heatlattice.operators import looped

# network 1: loops and hanging trees; 2: a loop far from the root, on a way; 3: a tree; 4: ties; 5: two parts; 6: a node
EDGES = {
    1: [(0, 1, 3), (1, 2, 4), (2, 0, 5), (2, 3, 7), (3, 4, 2), (4, 5, 2), (5, 3, 9), (4, 6, 1), (6, 7, 8), (0, 8, 6), (8, 9, 1), (8, 10, 20)],
    2: [(0, 1, 2), (1, 2, 2), (1, 6, 30), (2, 3, 5), (3, 4, 5), (4, 2, 5), (6, 7, 1), (0, 8, 4)],
    3: [(0, 1, 2), (1, 2, 3), (1, 3, 9), (0, 4, 1)],
    4: [(0, 1, 1), (1, 2, 1), (0, 3, 1), (3, 2, 1), (2, 4, 1), (4, 5, 1), (2, 6, 1), (6, 5, 1), (5, 7, 2), (1, 0, 4), (2, 2, 1), (3, 4, None)],
    5: [(0, 1, 2), (1, 2, 2), (2, 0, 3), (7, 8, 5)],
}
NODES = {k: {v for u, w, _ in e for v in (u, w)} for k, e in EDGES.items()} | {6: {0}}
DEMAND = {(k, v): float(10 * (v % 4) - 5 * (v == 7)) for k in NODES for v in NODES[k]}


def random_case(seed):
    """Connected, or not, with short whole lengths, so that there are ties."""
    rng = random.Random(seed)
    n = rng.randint(2, 11)
    edges = [(rng.randrange(v), v, rng.randint(1, 3)) for v in range(1, n) if rng.random() < 0.95]
    edges += [(u, v, rng.randint(1, 4)) for u, v in (rng.sample(range(n), 2) for _ in range(rng.randint(0, 4)))]
    return set(range(n)), edges


for i in range(20, 32):
    NODES[i], EDGES[i] = random_case(i)
    DEMAND |= {(i, v): float(v % 3) for v in NODES[i]}


def plain(k):
    """Everything from all simple paths of the part that 0 reaches."""
    every, best = {(min(u, v), max(u, v)) for u, v, _ in EDGES.get(k, []) if u != v}, {}
    for u, v, w in EDGES.get(k, []):
        if u != v and w:
            best[min(u, v), max(u, v)] = min(w, best.get((min(u, v), max(u, v)), w))
    near = defaultdict(dict)
    for (u, v), w in best.items():
        near[u][v] = near[v][u] = w
    part, todo = {0}, [0]
    while todo:
        for b in near[todo.pop()]:
            if b not in part:
                part.add(b)
                todo.append(b)
    paths = defaultdict(list)

    def on(path, cost):
        paths[path[0], path[-1]].append((cost, path))
        for b, w in near[path[-1]].items():
            if b not in path:
                on([*path, b], cost + w)

    for s in part:
        on([s], 0)
    n, by_node, by_edge = len(NODES[k]), dict.fromkeys(NODES[k], Fraction(0)), {e: Fraction(0) for e in best if e[0] in part}
    metres = {p: min(c for c, _ in found) for p, found in paths.items()}
    hops = {p: min(len(w) - 1 for _, w in found) for p, found in paths.items()}
    for (s, t), found in paths.items():
        if s < t:
            short = [w for c, w in found if c == metres[s, t]]
            for w in short:
                for v in w[1:-1]:
                    by_node[v] += Fraction(1, len(short))
                for a, b in zip(w, w[1:], strict=False):
                    by_edge[min(a, b), max(a, b)] += Fraction(1, len(short))
    by_node = {v: float(p * 2 / ((n - 1) * (n - 2))) if n > 2 else 0.0 for v, p in by_node.items()}
    by_edge = {e: float(p * 2 / (n * (n - 1))) for e, p in by_edge.items()}
    deg = [sum(v in e for e in every) for v in sorted(NODES[k])]
    out = {
        "mean_degree": sum(deg) / n, "max_degree": max(deg), "hub_node": sorted(NODES[k])[deg.index(max(deg))], "n_leaves": deg.count(1), "n_junctions": sum(d >= 3 for d in deg),
        "leaf_fraction": deg.count(1) / n, "connected": len(part) == n, "n_independent_cycles": len(by_edge) - len(part) + 1, "max_betweenness": max(by_node.values()),
        "mean_betweenness": sum(by_node.values()) / n, "max_edge_betweenness": max(by_edge.values(), default=0.0),
        **dict.fromkeys(("diameter_hops", "diameter_m", "mean_path_m", "mean_path_excl_self", "mean_plant_dist_m", "max_plant_dist_m", "demand_weighted_dist_m")),
    }
    if len(part) > 1:
        far = {v: metres[0, v] for v in part if v}
        load = {v: max(DEMAND[k, v], 0.0) for v in far}
        total = sum(load.values())
        out |= {"diameter_hops": max(hops.values()), "diameter_m": max(metres.values()), "mean_path_m": sum(metres.values()) / len(metres), "mean_path_excl_self": sum(metres.values()) / (len(metres) - len(part))}
        out |= {"mean_plant_dist_m": sum(far.values()) / len(far), "max_plant_dist_m": max(far.values()), "demand_weighted_dist_m": sum(far[v] * load[v] for v in far) / total if total else None}
    return out, by_node, by_edge


@pytest.fixture(scope="module")
def tables(spark):
    edges = [(k, u, v, None if w is None else float(w)) for k, e in EDGES.items() for u, v, w in e] + [(1, None, 3, 1.0)]
    nodes = [(k, v, DEMAND[k, v]) for k in NODES for v in NODES[k]]
    return spark.createDataFrame(nodes, "network_id long, node long, demand_kw double"), spark.createDataFrame(edges, "network_id long, u long, v long, length double")


def test_structure_of_looped_networks(tables):
    rows = {r.network_id: r.asDict() for r in looped.structure(*tables).collect()}
    assert rows.keys() == NODES.keys()
    for k, row in rows.items():
        want = plain(k)[0]
        assert row.keys() == {"network_id", *want}
        for c, v in want.items():
            assert row[c] == (v if v is None or isinstance(v, (bool, int)) else pytest.approx(v, abs=1e-12)), (k, c)


def test_betweenness(tables):
    by_node, by_edge = looped.betweenness(*tables)
    nodes = {(r.network_id, r.node): r.betweenness for r in by_node.collect()}
    edges = {(r.network_id, r.u, r.v): r.betweenness for r in by_edge.collect()}
    assert nodes == pytest.approx({(k, v): x for k in NODES for v, x in plain(k)[1].items()}, abs=1e-12)
    assert edges == pytest.approx({(k, *e): x for k in NODES for e, x in plain(k)[2].items()}, abs=1e-12)


def test_hanging_trees_add_no_pairs(spark):
    """A triangle with a long way and 300 leaves at it: nine pairs."""
    rows = [(1, 0, 1), (1, 1, 2), (1, 2, 0)] + [(1, i, i + 1) for i in range(2, 40)] + [(1, 1, 100 + i) for i in range(300)]
    net = looped.folded(spark.createDataFrame([(*r, 1.0) for r in rows], "network_id long, u long, v long, length double"))
    assert looped.distances(net.core).count() == 9
    assert {r.node: r.c for r in net.below.filter("node < 3").collect()} == {0: 1, 1: 301, 2: 39}


def test_no_networks(spark):
    nodes, edges = (spark.createDataFrame([], s) for s in ("network_id long, node long, demand_kw double", "network_id long, u long, v long, length double"))
    assert looped.structure(nodes, edges).isEmpty() and all(t.isEmpty() for t in looped.betweenness(nodes, edges))
