"""Distances and betweenness of networks with loops. Trees that hang on the loops are folded first, so that only pairs of
nodes on loops, or between them, become rows."""

from __future__ import annotations

import functools
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatlattice.operators import netsci
from heatlattice.operators.graph import KEY, MOST_PARTS, arcs_of, canonical, climbed, from_root, relaxed, rooted, shortest
from heatlattice.storage import stored

PAIR = [KEY, "source"]


class Folded(NamedTuple):
    """A network as its core (what loops, and ways between loops, consist of) and the trees that hang on it.

    edges and core: network_id, u, v, length. hung: network_id, node, parent, -1 at nodes of the core. lengths: of the edge
    to the parent. at: hops and metres from the core. below: c nodes in a node's part of its tree, itself included, and
    the hops and metres of the furthest. reached: r nodes in all. Stored tables, but for lengths and reached.
    """

    edges: DataFrame
    core: DataFrame
    hung: DataFrame
    lengths: DataFrame
    at: DataFrame
    below: DataFrame
    reached: DataFrame


def folded(edges: DataFrame, root: int = 0, length: str = "length") -> Folded:
    """The part of each network that the root reaches. Parallel edges count as their shortest; loops, and edges without an
    end or a length above 0, as none.

    Of a breadth-first tree, an edge is of the core if ends of edges off the tree lie below it and elsewhere. If all
    lie below, the way from the root hangs on the core and is turned round; without edges off the tree the core is the root.
    """
    edges = canonical(edges.select(KEY, "u", "v", F.col(length).alias("length"))).filter("u < v and length > 0").groupBy(KEY, "u", "v").agg(F.min("length").alias("length"))
    edges = stored(edges)
    tree = stored(rooted(edges, root))
    edges = stored(edges.join(tree.select(KEY, F.col("node").alias("u")), [KEY, "u"], "left_semi"))
    own = tree.filter("parent >= 0").select(KEY, F.least("node", "parent").alias("u"), F.greatest("node", "parent").alias("v"), "node", "parent")
    off = stored(edges.join(own, [KEY, "u", "v"], "left_anti"))
    ends = off.select(KEY, F.explode(F.array("u", "v")).alias("node")).groupBy(KEY, "node").agg(F.count("*").alias("ends"))
    below = climbed(tree, [KEY], tree.select(KEY, "node").join(ends, [KEY, "node"], "left").fillna(0, ["ends"]), {"ends": F.sum})
    whole = below.filter(F.col("node") == root).select(KEY, F.col("ends").alias("whole"))
    own = stored(own.join(below, [KEY, "node"]).join(whole, KEY))
    core = stored(off.select(KEY, "u", "v", "length").unionByName(edges.join(own.filter("ends > 0 and ends < whole"), [KEY, "u", "v"], "left_semi").select(KEY, "u", "v", "length")))
    bare = whole.filter("whole = 0").select(KEY, F.lit(root).cast("long").alias("node"))
    top = core.select(KEY, F.explode(F.array("u", "v")).alias("node")).distinct().unionByName(bare).withColumn("parent", F.lit(-1).cast("long"))
    down = own.filter("ends = 0").select(KEY, "node", "parent")
    turned = own.filter("ends > 0 and ends = whole").select(KEY, F.col("parent").alias("node"), F.col("node").alias("parent"))
    hung = stored(top.unionByName(down).unionByName(turned))
    lengths = hung.filter("parent >= 0").select(KEY, "node", F.least("node", "parent").alias("u"), F.greatest("node", "parent").alias("v")).join(edges, [KEY, "u", "v"]).select(KEY, "node", "length")
    far = lambda of, name: from_root(hung, [KEY], of).withColumnRenamed("far", name)
    at = stored(hung.join(far(lengths.withColumn("length", F.lit(1.0)), "hops"), [KEY, "node"]).join(far(lengths, "metres"), [KEY, "node"]).withColumn("hops", F.col("hops").cast("long")))
    each = at.select(KEY, "node", F.lit(1).cast("long").alias("c"), "hops", "metres")
    below = stored(climbed(hung, [KEY], each, {"c": F.sum, "hops": F.max, "metres": F.max}))
    return Folded(edges, core, hung, lengths, at, below, hung.groupBy(KEY).agg(F.count("*").alias("r")))


def distances(core: DataFrame) -> DataFrame:
    """network_id, source, node, cost: between all pairs of the nodes of edges (network_id, u, v, length), and 0 to itself.

    All sources of all networks take part in a round of relaxation; a row goes on only where it was bettered.
    """
    arcs = stored(arcs_of(core, [KEY]))
    start = arcs.select(KEY, F.col("a").alias("source")).distinct()
    start = start.select(KEY, "source", F.col("source").alias("node"), F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.lit(-1).cast("long").alias("parent")).alias("s"))
    return relaxed(stored(start), arcs, PAIR, [KEY]).select(*PAIR, "node", "cost")


def carried(start: DataFrame, steps: DataFrame, left: str, to: str) -> DataFrame:
    """network_id, source, node, total: what all ways over steps bring to a node from start (amount), its own included.

    A round takes every amount one step on, so ways of unequal numbers of steps need no order of the nodes.
    """
    front = stored(start.select(*PAIR, "node", "amount"))
    parts = [front]
    while not front.isEmpty():
        front = stored(front.withColumnRenamed("node", left).join(steps, [*PAIR, left]).groupBy(*PAIR, F.col(to).alias("node")).agg(F.sum("amount").alias("amount")))
        parts.append(front)
        if len(parts) > MOST_PARTS:
            parts = [stored(_added(parts).withColumnRenamed("total", "amount"))]
    return _added(parts)


def _added(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts).groupBy(*PAIR, "node").agg(F.sum("amount").alias("total"))


def passing(net: Folded, dist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of nodes whose shortest ways pass each node (network_id, node, pairs) between its ends, and each edge
    (network_id, u, v, pairs); of several shortest ways each has an equal share. dist: distances() of the core.

    Nodes of the core stand for all that hangs on them. An edge of a hanging tree parts what is below from the rest.
    Ways are equal if their lengths are equal as doubles, summed from the source on.
    """
    dist = stored(dist)
    a, b = (dist.withColumnsRenamed({"node": c, "cost": f"cost_{c}"}) for c in "ab")
    steps = stored(a.join(arcs_of(net.core, [KEY]), [KEY, "a"]).join(b, [*PAIR, "b"]).filter("cost_a + length = cost_b").select(*PAIR, "a", "b"))
    ways = stored(carried(dist.filter("node = source").withColumn("amount", F.lit(1.0)), steps, "a", "b").withColumnRenamed("total", "ways"))
    heavy = net.below.select(KEY, "node", "c")
    # of all targets, their weight by the ways to them
    onward = stored(carried(ways.join(heavy, [KEY, "node"]).withColumn("amount", F.col("c") / F.col("ways")), steps, "b", "a").withColumnRenamed("total", "onward"))
    from_source = heavy.select(KEY, F.col("node").alias("source"), F.col("c").alias("sent"))
    over = steps.join(ways.withColumnRenamed("node", "a"), [*PAIR, "a"]).join(onward.withColumnRenamed("node", "b"), [*PAIR, "b"]).join(from_source, PAIR)
    over = over.groupBy(KEY, F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg((F.sum(F.col("sent") * F.col("ways") * F.col("onward")) / 2).alias("over"))
    parted = net.hung.filter("parent >= 0").join(heavy, [KEY, "node"]).join(net.reached, KEY)
    parted = parted.select(KEY, F.least("node", "parent").alias("u"), F.greatest("node", "parent").alias("v"), (F.col("c") * (F.col("r") - F.col("c"))).cast("double").alias("pairs"))
    on_edges = parted.unionByName(net.core.join(over, [KEY, "u", "v"], "left").select(KEY, "u", "v", F.coalesce("over", F.lit(0.0)).alias("pairs")))
    through = ways.filter("node <> source").join(onward, [*PAIR, "node"]).join(heavy, [KEY, "node"]).join(from_source, PAIR)
    through = through.groupBy(KEY, "node").agg((F.sum(F.col("sent") * (F.col("ways") * F.col("onward") - F.col("c"))) / 2).alias("through"))
    branches = net.hung.filter("parent >= 0").join(heavy, [KEY, "node"]).groupBy(KEY, F.col("parent").alias("node")).agg(F.sum(F.col("c") * F.col("c")).alias("alone"))
    nodes = heavy.join(net.reached, KEY).join(branches, [KEY, "node"], "left").join(through, [KEY, "node"], "left")
    within = ((F.col("c") - 1) * (F.col("c") - 1) - F.coalesce("alone", F.lit(0))) / 2
    on_nodes = nodes.select(KEY, "node", ((F.col("c") - 1) * (F.col("r") - F.col("c")) + within + F.coalesce("through", F.lit(0.0))).alias("pairs"))
    return on_nodes, on_edges


def all_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """network_id, node, demand_kw: one row a node, with its rows' positive demands, and those that only edges name."""
    named = edges.select(KEY, F.explode(F.array("u", "v")).alias("node"), F.lit(0.0).alias("demand_kw"))
    rows = nodes.select(KEY, "node", F.greatest("demand_kw", F.lit(0.0)).alias("demand_kw")).unionByName(named)
    return rows.filter("node is not null").groupBy(KEY, "node").agg(F.sum("demand_kw").alias("demand_kw"))


def betweenness(nodes: DataFrame, edges: DataFrame, root: int = 0, length: str = "length") -> tuple[DataFrame, DataFrame]:
    """Betweenness by shortest length, of nodes (network_id, node, betweenness) and edges (network_id, u, v, betweenness),
    as a share of all pairs that the node is no end of, or of all pairs. Nodes that the root does not reach have 0, their
    edges no row; networks of under three nodes have 0 for nodes."""
    every = stored(all_nodes(nodes, edges))
    net = folded(edges, root, length)
    on_nodes, on_edges = passing(net, distances(net.core))
    n = every.groupBy(KEY).agg(F.count("*").alias("n"))
    others = F.when(F.col("n") > 2, 2 / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(0.0)
    by_node = every.select(KEY, "node").join(on_nodes, [KEY, "node"], "left").join(n, KEY).select(KEY, "node", (F.coalesce("pairs", F.lit(0.0)) * others).alias("betweenness"))
    return by_node, on_edges.join(n, KEY).select(KEY, "u", "v", (2 * F.col("pairs") / (F.col("n") * (F.col("n") - 1))).alias("betweenness"))


def structure(nodes: DataFrame, edges: DataFrame, root: int = 0, length: str = "length") -> DataFrame:
    """netsci.structure() of any network, with its betweenness. nodes: node, demand_kw; edges: u, v and ``length``.

    Degrees are of all nodes and distinct edges. Distances, cycles and betweenness are of the part that the root
    reaches; ``connected`` says whether that is all. A network whose root has no edge has nulls for distances.
    """
    every = stored(all_nodes(nodes, edges))
    whole = canonical(edges.select(KEY, "u", "v")).filter("u < v").distinct()
    deg = netsci.degree_summary(every, whole)
    net = folded(edges, root, length)
    dist = stored(distances(net.core))
    hops = distances(net.core.withColumn("length", F.lit(1.0)))
    end = lambda c: net.below.select(KEY, F.col("node").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("c", "hops", "metres")))
    ends = lambda d: d.filter("node <> source").join(end("source"), PAIR).join(end("node"), [KEY, "node"])
    far = ends(dist).groupBy(KEY).agg(F.sum(F.col("c_source") * F.col("c_node") * F.col("cost")).alias("core_ways"), F.max(F.col("metres_source") + F.col("cost") + F.col("metres_node")).alias("core_metres"))
    steps = ends(hops).groupBy(KEY).agg(F.max(F.col("hops_source") + F.col("cost") + F.col("hops_node")).cast("long").alias("core_hops"))
    hung = net.below.join(net.lengths, [KEY, "node"]).join(net.reached, KEY).groupBy(KEY).agg(F.sum(2.0 * F.col("c") * (F.col("r") - F.col("c")) * F.col("length")).alias("hung_ways"))
    m = net.edges.groupBy(KEY).agg(F.count("*").alias("m"))
    met = net.reached.join(m, KEY, "left").join(far, KEY, "left").join(steps, KEY, "left").join(hung, KEY, "left").join(netsci.turns(net.hung, net.at, net.below), KEY, "left")
    ways, pairs = F.coalesce("core_ways", F.lit(0.0)) + F.coalesce("hung_ways", F.lit(0.0)), F.col("r") * F.col("r")
    met = met.select(
        KEY, "r", F.greatest("core_hops", "diameter_hops").alias("diameter_hops"), F.greatest("core_metres", "diameter_m").alias("diameter_m"),
        (ways / pairs).alias("mean_path_m"), (ways / F.when(F.col("r") > 1, pairs - F.col("r"))).alias("mean_path_excl_self"), (F.col("m") - F.col("r") + 1).alias("n_independent_cycles"),
    )
    plant = shortest(net.edges, root=root).filter(F.col("node") != root).join(every, [KEY, "node"])
    plant = plant.groupBy(KEY).agg(F.avg("cost").alias("mean_plant_dist_m"), F.max("cost").alias("max_plant_dist_m"), (F.sum(F.col("cost") * F.col("demand_kw")) / F.when(F.sum("demand_kw") > 0, F.sum("demand_kw"))).alias("demand_weighted_dist_m"))
    on_nodes, on_edges = passing(net, dist)
    nodes_met = on_nodes.groupBy(KEY).agg(F.max("pairs").alias("most"), F.sum("pairs").alias("all_pairs"))
    edges_met = on_edges.groupBy(KEY).agg(F.max("pairs").alias("most_edge"))
    n = F.col("n")
    share = lambda c, by: F.coalesce(2 * F.col(c) / F.when(by > 0, by), F.lit(0.0))
    out = deg.join(met, KEY, "left").join(plant, KEY, "left").join(nodes_met, KEY, "left").join(edges_met, KEY, "left")
    out = out.withColumns({
        "leaf_fraction": F.col("n_leaves") / n, "connected": F.coalesce(F.col("r") == n, n == 1), "n_independent_cycles": F.coalesce("n_independent_cycles", F.lit(0)),
        "max_betweenness": share("most", (n - 1) * (n - 2)), "mean_betweenness": share("all_pairs", (n - 1) * (n - 2)) / n, "max_edge_betweenness": share("most_edge", n * (n - 1)),
    })
    return out.drop("n", "r", "most", "all_pairs", "most_edge")
