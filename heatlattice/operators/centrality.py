"""Centralities, connectivity, communities and null models of networks of design size, one network a task.

These are the measures whose steps depend on each other within a network; networks are the parallel axis.
"""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatlattice.operators.graph import KEY, spread_networks
from heatlattice.operators.netsci import MOST_DENSE


def _adjacency(pdf: pd.DataFrame) -> tuple[list[int], dict[int, dict[int, float]]]:
    near: dict[int, dict[int, float]] = {}
    for u, v, length in zip(pdf.u, pdf.v, pdf.length, strict=True):
        near.setdefault(u, {})[v] = length
        near.setdefault(v, {})[u] = length
    return sorted(near), near


def _dependencies(source: int, near: dict[int, dict[int, float]], weight: dict[int, int]) -> tuple[dict[int, float], dict[int, float]]:
    """Distances from a source, and the weight of targets that each node lies before on cheapest paths to them."""
    cost, paths, before, order = {source: 0.0}, {source: 1.0}, {source: []}, []
    heap, done = [(0.0, source)], set()
    while heap:
        d, node = heapq.heappop(heap)
        if node in done:
            continue
        done.add(node)
        order.append(node)
        for other, length in near[node].items():
            far = d + length
            if other not in cost or far < cost[other] - 1e-12:
                cost[other], paths[other], before[other] = far, paths[node], [node]
                heapq.heappush(heap, (far, other))
            elif other not in done and abs(far - cost[other]) <= 1e-12:
                paths[other] += paths[node]
                before[other].append(node)
    share = dict.fromkeys(order, 0.0)
    for node in reversed(order):
        for up in before[node]:
            share[up] += paths[up] / paths[node] * (weight[node] + share[node])
    return cost, share


def _passed(names: list[int], near: dict[int, dict[int, float]]) -> tuple[dict[int, float], dict[int, float], dict[int, int]]:
    """Of each node: ordered pairs whose cheapest paths pass it between their ends, its distances in all, and the nodes of its part.

    Trees that hang on loops are taken away end by end, and a node that is left stands for all that hung on it: only the
    nodes of loops, and of ways between them, have paths searched from them. A part without loops comes down to one node.
    """
    rest = {u: {v for v in near[u] if v != u} for u in names}
    below, far, alone, up, hung = dict.fromkeys(names, 1), dict.fromkeys(names, 0.0), dict.fromkeys(names, 0), {}, [u for u in names if len(rest[u]) == 1]
    for u in hung:  # grows
        if rest[u]:
            (top,) = rest[u]
            up[u] = top
            below[top] += below[u]
            far[top] += far[u] + below[u] * near[u][top]
            alone[top] += below[u] * below[u]
            rest[top].discard(u)
            if len(rest[top]) == 1:
                hung.append(top)
    core = {u: {v: near[u][v] for v in near[u] if v not in up and v != u} for u in names if u not in up}
    through, total, size = dict.fromkeys(names, 0.0), {}, {}
    for s in core:
        cost, share = _dependencies(s, core, below)
        for node, x in share.items():
            through[node] += below[s] * x if node != s else 0.0
        size[s] = sum(below[t] for t in cost)
        total[s] = sum(below[t] * d + far[t] for t, d in cost.items())
    for u in reversed([u for u in hung if u in up]):
        size[u] = size[up[u]]
        total[u] = total[up[u]] + near[u][up[u]] * (size[u] - 2 * below[u])
    for u in names:
        own = below[u] - 1
        through[u] += 2 * own * (size[u] - below[u]) + own * own - alone[u]
    return through, total, size


def _leading(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Vector of the greatest eigenvalue of the matrix that has 1 at (u, v): of up to MOST_DENSE nodes from all, beyond that by Lanczos' steps."""
    if n <= MOST_DENSE:
        a = np.zeros((n, n))
        a[u, v] = 1
        return np.linalg.eigh(a)[1][:, -1]
    lead = np.ones(n)
    for _ in range(RESTARTS):
        basis, main, side = [lead / np.linalg.norm(lead)], [], []
        for _ in range(STEPS):
            r = np.bincount(u, basis[-1][v], n)
            main.append(float(basis[-1] @ r))
            every = np.array(basis)
            for _ in range(2):
                r -= every.T @ (every @ r)
            side.append(float(np.linalg.norm(r)))
            values, vectors = np.linalg.eigh(np.diag(main) + np.diag(side[:-1], 1) + np.diag(side[:-1], -1))
            if settled := side[-1] * abs(vectors[-1, -1]) <= 1e-14 * values[-1]:
                break
            basis.append(r / side[-1])
        lead = np.array(basis[: len(main)]).T @ vectors[:, -1]
        if settled:
            break
    return lead / np.linalg.norm(lead)


#: Lanczos' steps before they start again from the best vector, and how often they do.
STEPS, RESTARTS = 60, 100


def centralities(edges: DataFrame) -> DataFrame:
    """network_id, node, degree, betweenness, closeness, eigenvector, pagerank of (u, v, length).

    Hanging trees cost no search; what loops consist of costs one a node. The rest goes by edges.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, near = _adjacency(pdf)
        n = len(names)
        through, total, size = _passed(names, near)
        close = [(size[x] - 1) / total[x] * (size[x] - 1) / (n - 1) if total[x] > 0 and n > 1 else 0.0 for x in names]
        scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
        at = {name: i for i, name in enumerate(names)}
        u = np.repeat(np.arange(n), [len(near[x]) for x in names])
        v = np.array([at[y] for x in names for y in near[x]])
        degree = np.bincount(u, minlength=n)
        lead = _leading(u, v, n)
        lead = lead * (np.sign(lead.sum()) or 1)
        rank = np.full(n, 1 / n)
        for _ in range(200):
            rank = 0.15 / n + 0.85 * np.bincount(v, (rank / degree)[u], n)
        return pd.DataFrame({KEY: pdf[KEY].iloc[0], "node": names, "degree": degree, "betweenness": [through[x] * scale for x in names], "closeness": close, "eigenvector": lead, "pagerank": rank})

    return spread_networks(edges).groupBy(KEY).applyInPandas(run, f"{KEY} {dict(edges.dtypes)[KEY]}, node long, degree int, betweenness double, closeness double, eigenvector double, pagerank double")


def _max_flow(caps: dict[int, dict[int, int]], source: int, sink: int, most: int) -> int:
    flow = 0
    caps = {u: dict(vs) for u, vs in caps.items()}
    while flow < most:
        before, queue = {source: source}, deque([source])
        while queue and sink not in before:
            u = queue.popleft()
            for v, c in caps[u].items():
                if c > 0 and v not in before:
                    before[v] = u
                    queue.append(v)
        if sink not in before:
            break
        v = sink
        while v != source:
            u = before[v]
            caps[u][v] -= 1
            caps[v][u] = caps[v].get(u, 0) + 1
            v = u
        flow += 1
    return flow


def _edge_flows(names: list[int], near: dict[int, dict[int, float]], least: int) -> int:
    arcs = {u: dict.fromkeys(vs, 1) for u, vs in near.items()}
    return min((_max_flow(arcs, names[0], t, least) for t in names[1:]), default=0)


def _node_flows(names: list[int], near: dict[int, dict[int, float]], least: int) -> int:
    split: dict = {}
    for u in names:
        split.setdefault((u, 0), {})[u, 1] = 1
        for v in near[u]:
            split.setdefault((u, 1), {})[v, 0] = len(names)
            split.setdefault((v, 0), {})
    first = min(names, key=lambda u: len(near[u]))
    far = [(first, t) for t in names if t != first and t not in near[first]]
    far += [(a, b) for a in near[first] for b in near[first] if a < b and b not in near[a]]
    return min([least, *(_max_flow(split, (s, 1), (t, 0), least) for s, t in far)])


def _cuts(names: list[int], near: dict[int, dict[int, float]]) -> tuple[int, bool]:
    """How many edges of the part of the first node are bridges, and whether a node of it cuts it, by one depth-first search."""
    place, low, bridges, cut, first = {names[0]: 0}, {names[0]: 0}, 0, False, 0
    stack = [(names[0], None, iter(near[names[0]]))]
    while stack:
        node, up, rest = stack[-1]
        other = next(rest, None)
        if other is None:
            stack.pop()
            if up is not None:
                low[up] = min(low[up], low[node])
                bridges += low[node] > place[up]
                if up == names[0]:
                    first += 1
                else:
                    cut |= low[node] >= place[up]
        elif other not in place:
            place[other] = low[other] = len(place)
            stack.append((other, node, iter(near[other])))
        elif other != up:
            low[node] = min(low[node], place[other])
    return bridges, cut or first > 1


def connectivity(edges: DataFrame) -> DataFrame:
    """network_id, edge and node connectivity, bridges, bridge_fraction, cycle_rank, two_edge_connected.

    A network that is not connected has connectivity 0 and counts no bridges; its cycle rank is that of all its parts.
    One search finds bridges and cutting nodes; flows between pairs are needed only of networks that have none.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, near = _adjacency(pdf)
        n, m = len(names), sum(map(len, near.values())) // 2
        least = min(len(x) for x in near.values())
        parts, left = 0, set(names)
        while left:
            parts += 1
            reach = [left.pop()]
            for u in reach:
                reach += [v for v in near[u] if v in left]
                left -= set(near[u])
        edge = node = bridges = 0
        if parts == 1 and n > 1:
            bridges, cut = _cuts(names, near)
            edge = 1 if bridges else _edge_flows(names, near, least)
            node = 1 if cut or least == 1 else _node_flows(names, near, least)
        return pd.DataFrame({KEY: [pdf[KEY].iloc[0]], "edge_connectivity": [edge], "node_connectivity": [node], "bridges": [bridges], "bridge_fraction": [bridges / m], "cycle_rank": [m - n + parts], "two_edge_connected": [edge >= 2]})

    return edges.groupBy(KEY).applyInPandas(run, f"{KEY} {dict(edges.dtypes)[KEY]}, edge_connectivity int, node_connectivity int, bridges int, bridge_fraction double, cycle_rank int, two_edge_connected boolean")


class _Merging:
    """Communities under merging. A pair of neighbours is kept by the one that had more neighbours when they first met.

    It keeps its neighbours by what a merge with them depends on, their share and the pair's edges, the least name first: however many
    hang on it, it compares a few kinds. What a merge changes are the kinds of the one that is left with the few that keep it.
    """

    def __init__(self, names: list[int], near: dict[int, dict[int, float]]):
        self.m = sum(map(len, near.values())) / 2
        self.name = {u: u for u in names}
        self.share = {u: len(near[u]) / (2 * self.m) for u in names}
        self.between = {u: {v: 1 / (2 * self.m) for v in near[u] if v != u} for u in names}
        self.keepers: dict[int, set[int]] = {u: set() for u in names}
        self.kinds: dict[int, dict[tuple[float, float], list[tuple[int, int]]]] = {u: {} for u in names}
        self.round, self.heap = dict.fromkeys(names, 0), []
        for u in names:
            for v in self.between[u]:
                if u < v:
                    self.meet(u, v)
        for u in names:
            self.compare(u)

    def meet(self, u: int, v: int) -> None:
        a, b = (u, v) if len(self.between[u]) >= len(self.between[v]) else (v, u)
        self.keepers[b].add(a)
        self.keep(a, b)

    def keep(self, a: int, b: int) -> None:
        heapq.heappush(self.kinds[a].setdefault((self.between[a][b], self.share[b]), []), (self.name[b], b))

    def compare(self, a: int) -> None:
        """The best merge of a with one that it keeps; of equal ones that of the least names."""
        self.round[a] += 1
        best, kinds = None, self.kinds[a]
        for kind in list(kinds):
            w, share = kind
            rows = kinds[kind]
            while rows:
                name, b = rows[0]
                if self.between[a].get(b) == w and a in self.keepers[b] and self.share[b] == share and self.name[b] == name:
                    break
                heapq.heappop(rows)
            if not rows:
                del kinds[kind]
                continue
            offer = (-2 * (w - self.share[a] * share), min(self.name[a], name), max(self.name[a], name), a, b)
            best = offer if best is None or offer < best else best
        if best:
            heapq.heappush(self.heap, (*best, self.round[a]))

    def merge(self, a: int, b: int) -> None:
        if len(self.between[a]) < len(self.between[b]):
            a, b = b, a
        self.name[a] = min(self.name[a], self.name[b])
        self.share[a] += self.share[b]
        changed = {a}
        changed |= self.keepers[b] - {a}
        self.keepers[a].discard(b)
        self.keepers[b], self.kinds[b] = set(), {}
        self.round[b] += 1
        for v, w in self.between.pop(b).items():
            del self.between[v][b]
            self.keepers[v].discard(b)
            if v == a:
                continue
            known = v in self.between[a]
            self.between[a][v] = self.between[v][a] = self.between[a].get(v, 0) + w
            if not known:
                self.meet(a, v)
            elif a in self.keepers[v]:
                self.keep(a, v)
        for v in self.keepers[a]:
            self.keep(v, a)
        for v in changed | self.keepers[a]:
            self.compare(v)


def _merged(names: list[int], near: dict[int, dict[int, float]]) -> tuple[dict[int, int], dict[int, float]]:
    """The community of each node, named by its least one, and the share of each."""
    now, into = _Merging(names, near), {}
    while now.heap:
        loss, first, second, a, b, step = heapq.heappop(now.heap)
        if a not in now.between or step != now.round[a]:
            continue
        if -loss <= 1e-15:
            break
        into[second] = first
        now.merge(a, b)
    label = {}
    for u in names:  # a community's name is less than those of what went into it
        label[u] = label[into[u]] if u in into else u
    return label, {now.name[a]: now.share[a] for a in now.between}


def communities(edges: DataFrame) -> DataFrame:
    """network_id, node, community, modularity: merging, while it helps, the two communities that raise modularity most."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, near = _adjacency(pdf)
        m = sum(map(len, near.values())) / 2
        label, share = _merged(names, near)
        inside = {c: 0.0 for c in sorted(share)}
        for u in names:
            for v in near[u]:
                if label[u] == label[v]:
                    inside[label[u]] += 1 / (2 * m)
        q = sum(inside[c] - share[c] ** 2 for c in inside)
        return pd.DataFrame({KEY: pdf[KEY].iloc[0], "node": names, "community": [label[u] for u in names], "modularity": q})

    return spread_networks(edges).groupBy(KEY).applyInPandas(run, f"{KEY} {dict(edges.dtypes)[KEY]}, node long, community long, modularity double")


def _trial(rng: np.random.Generator, n: int, m: int) -> tuple[int, int, float]:
    """er_max, tree_max, tree_var of a random graph of n nodes and m edges and of a random labelled tree."""
    picks = rng.choice(n * (n - 1) // 2, m, replace=False)
    first = (np.floor((2 * n - 1 - np.sqrt((2 * n - 1) ** 2 - 8.0 * picks)) / 2)).astype(int)
    second = picks - first * (2 * n - first - 1) // 2 + first + 1
    er = np.bincount(np.concatenate([first, second]), minlength=n)
    tree = min(1, n - 1) + np.bincount(rng.integers(0, n, max(0, n - 2)), minlength=n)
    return int(er.max()), int(tree.max()), float(tree.var())


def null_models(spark: SparkSession, n: int, m: int, trials: int = 200, seed: int = 0) -> DataFrame:
    """trial, er_max, tree_max, tree_var: degrees of a random graph of n nodes and m edges, and of a random labelled tree.

    Each trial has a generator of its own, so trials run anywhere and come out the same. A labelled tree's degrees are
    one more than how often each node stands in its Pruefer sequence.
    """

    def run(batches):
        for pdf in batches:
            rows = [(trial, *_trial(np.random.default_rng([seed, trial]), n, m)) for trial in pdf.trial]
            yield pd.DataFrame(rows, columns=["trial", "er_max", "tree_max", "tree_var"])

    return spark.range(trials).withColumnRenamed("id", "trial").mapInPandas(run, "trial long, er_max int, tree_max int, tree_var double")


def null_models_of(degrees: DataFrame, trials: int = 200, seed: int = 0) -> DataFrame:
    """null_models() of each network's own numbers of nodes and edges, with its network_id. degrees: network_id, node, degree."""

    def run(batches):
        for pdf in batches:
            rows = [(key, trial, *_trial(np.random.default_rng([seed, own, trial]), n, min(m, n * (n - 1) // 2))) for key, own, n, m, trial in pdf.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=[KEY, "trial", "er_max", "tree_max", "tree_var"])

    sizes = degrees.groupBy(KEY).agg(F.count("*").alias("n"), F.expr("sum(degree) div 2").alias("m"))
    each = sizes.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    each = each.select(KEY, F.xxhash64(KEY).bitwiseAND(F.lit((1 << 63) - 1)).alias("own"), "n", "m", "trial")
    return each.mapInPandas(run, f"{KEY} {dict(degrees.dtypes)[KEY]}, trial long, er_max int, tree_max int, tree_var double")


def degree_ratio(degrees: DataFrame, trials: DataFrame) -> DataFrame:
    """Observed degree variance of each network against that of its random trees. degrees: network_id, node, degree."""
    means = trials.groupBy(KEY).agg(*(F.avg(c).alias(c) for c in ("er_max", "tree_max", "tree_var")))
    seen = degrees.groupBy(KEY).agg(F.max("degree").alias("max_degree"), F.var_pop("degree").alias("var_degree"))
    return seen.join(means, KEY).withColumn("ratio", F.when(F.col("tree_var") > 0, F.col("var_degree") / F.col("tree_var")))
