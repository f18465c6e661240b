"""Graphs as edge tables keyed by network_id: candidate pairs, trees, paths, reachability. One plan does all networks.

Node ids are longs, 0 is the hub. Edges are undirected rows (network_id, u, v, ...). Loops over rounds end when a round
finds nothing new; each round's table is written to the shared folder, so nothing grows and lost executors cost a round.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatlattice.storage import stored

KEY = "network_id"


def distance(metric: str = "euclidean") -> Column:
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    return F.sqrt(dx * dx + dy * dy) if metric == "euclidean" else F.abs(dx) + F.abs(dy)


#: Nodes of a block. Every two blocks of a network are a group of pairs, so that a large network is many groups.
BLOCK = 512


def dealt(rows: DataFrame, column: str, block: int = BLOCK) -> DataFrame:
    """rows with the number of blocks of their network, and their own by the hash of a column; nulls are left out."""
    sizes = rows.groupBy(KEY).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    return rows.filter(F.col(column).isNotNull()).join(sizes, KEY).withColumn("own", F.pmod(F.xxhash64(column), F.col("blocks")).cast("int"))


def spread_groups(rows: DataFrame) -> DataFrame:
    """rows by network and two blocks i, j over several tasks a core: few rows that make many are not drawn together."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, KEY, "i", "j")


def spread_networks(rows: DataFrame) -> DataFrame:
    """rows by network over several tasks a core, for work of a network that is long for its few rows: these would be drawn together."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, KEY)


def blocks_of_two(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """nodes (network_id, node, x, y) under every two blocks i <= j with their own; side is 0 in block i and 1 in block j."""
    met = dealt(nodes.select(KEY, "node", "x", "y"), "node", block).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return met.select(KEY, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "x", "y", (F.col("own") > F.col("other")).cast("int").alias("side"))


def distances(nodes: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """network_id, u < v of every pair of nodes (network_id, node, x, y), and its distance in each metric, by column.

    Pairs meet by blocks: rows shuffled are nodes times blocks, and no network is one task's work.
    """
    own = dealt(nodes.select(KEY, "node", "x", "y"), "node")
    a = own.select(KEY, F.col("own").alias("i"), F.explode(F.expr("sequence(own, blocks - 1)")).alias("j"), F.col("node").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = own.select(KEY, F.explode(F.expr("sequence(0, own)")).alias("i"), F.col("own").alias("j"), F.col("node").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    met = spread_groups(a).join(spread_groups(b).hint("shuffle_hash"), [KEY, "i", "j"]).filter("i < j or a < b")
    return met.select(KEY, F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), *(distance(m).alias(c) for c, m in metrics.items()))


def pairs(nodes: DataFrame, metric: str = "euclidean") -> DataFrame:
    """network_id, u < v and w of every pair of nodes (network_id, node, x, y): the complete graph of each network."""
    return distances(nodes, {"w": metric})


def star(nodes: DataFrame) -> DataFrame:
    return nodes.filter("node <> 0").select(KEY, F.lit(0).cast("long").alias("u"), F.col("node").alias("v"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge in both directions (a, b), other columns as they are."""
    rest = [c for c in edges.columns if c not in (KEY, "u", "v")]
    one = edges.select(KEY, F.col("u").alias("a"), F.col("v").alias("b"), *rest)
    return one.unionByName(edges.select(KEY, F.col("v").alias("a"), F.col("u").alias("b"), *rest))


#: Cells of an index are halved so often from the whole of a network.
LEVELS = 16

#: As many halvings of cells are undone for a group of places that look for neighbours together.
HOME = 2


def nearest_of_points(nodes: DataFrame, k: int = 8, metric: str = "euclidean") -> DataFrame:
    """Distinct pairs u < v, with w, of each point with its neighbours()."""
    return neighbours(nodes, k, metric).select(KEY, F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "w").distinct()


def neighbours(nodes: DataFrame, k: int = 8, metric: str = "euclidean") -> DataFrame:
    """network_id, a, b, w: the k nearest b, by w, then node, of each point a (network_id, node, x, y); no other pair is made.

    Networks of up to MOST_POINTS points are searched in one task each, some rows of distances at a time. Larger ones are
    searched by cells. Every place starts at the finest cells of which its own holds more than k places, and looks at
    these and the eight around, with all that share its home of 4 x 4 cells. If its kth neighbour is nearer than a cell's side, no other place can be nearer; else the
    cells double. Points at one place are one, with the k + 1 least nodes, so a place that holds a third of all is no
    more than others. Rows shuffled are points times LEVELS, and places for each home that they lie in or beside; no candidate is a row. Nothing that grows is sent to the driver.

    A node without coordinates has no neighbours; one given twice has the least of its places.
    """
    points = nodes.filter("x is not null and y is not null").groupBy(KEY, "node").agg(F.min(F.struct("x", "y")).alias("at")).select(KEY, "node", "at.x", "at.y")
    points = stored(points)
    sized = points.join(points.groupBy(KEY).agg(F.count("*").alias("points")), KEY)
    schema = f"{KEY} {dict(nodes.dtypes)[KEY]}, a long, b long, w double"

    def searched(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        x, y, name = (pdf[c].to_numpy() for c in ("x", "y", "node"))
        found, near = [], min(k, len(pdf) - 1)
        for first in range(0, len(pdf), 256) if near else ():
            own = np.arange(first, min(first + 256, len(pdf)))
            dx, dy = x[own, None] - x, y[own, None] - y
            w = np.sqrt(dx * dx + dy * dy) if metric == "euclidean" else np.abs(dx) + np.abs(dy)
            w[np.arange(len(own)), own] = np.inf
            row, to = np.nonzero(w <= np.partition(w, near - 1, axis=1)[:, near - 1 : near])
            order = np.lexsort((to, w[row, to], row))
            row, to = row[order], to[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, to = row[place < near], to[place < near]
            found.append((own[row], to, w[row, to]))
        a, b, w = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, dtype=int),) * 3
        out = pd.DataFrame({"a": name[a], "b": name[b], "w": w.astype(float)})
        out.insert(0, KEY, pdf[KEY].iloc[0])
        return out

    small = spread_networks(sized.filter(F.col("points") <= MOST_POINTS).drop("points")).groupBy(KEY).applyInPandas(searched, schema)
    large = sized.filter(F.col("points") > MOST_POINTS).drop("points")
    return small if large.isEmpty() else small.unionByName(nearest_by_cells(large, k, metric))


def _nearest(asked: pd.DataFrame, index: pd.DataFrame, k: int, metric: str) -> pd.DataFrame:
    """Of each place asked (place, ax, ay) the k nearest nodes of an index (x, y, nodes) by w, then node, some rows of distances at a time."""
    if asked.empty:
        return pd.DataFrame({c: [] for c in (KEY, "place", "side", "w", "v")})
    size = index["nodes"].map(len).to_numpy()
    v = np.concatenate(index["nodes"].to_list())
    order = np.argsort(v, kind="stable")
    v, x, y = v[order], np.repeat(index["x"].to_numpy(), size)[order], np.repeat(index["y"].to_numpy(), size)[order]
    ax, ay, near, ws, vs = asked["ax"].to_numpy(), asked["ay"].to_numpy(), min(k, len(v)), [], []
    rows = max(1, HELD_EDGES // len(v))
    for first in range(0, len(asked), rows):
        dx, dy = ax[first : first + rows, None] - x, ay[first : first + rows, None] - y
        w = np.sqrt(dx * dx + dy * dy) if metric == "euclidean" else np.abs(dx) + np.abs(dy)
        row, to = np.nonzero(w <= np.partition(w, near - 1, axis=1)[:, near - 1 : near])
        order = np.lexsort((to, w[row, to], row))
        row, to = row[order], to[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < near
        row, to = row[kept], to[kept]
        ws += list(w[row, to].reshape(-1, near))
        vs += list(v[to].reshape(-1, near))
    return asked[[KEY, "place", "side"]].assign(w=ws, v=vs)


def nearest_by_cells(points: DataFrame, k: int, metric: str) -> DataFrame:
    """neighbours() by a cell index; every network has its own cells."""
    order = Window.partitionBy(KEY, "x", "y").orderBy("node")
    least = points.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= k + 1)
    places = least.groupBy(KEY, "x", "y").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    box = points.groupBy(KEY).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("side"))
    fine = lambda c: F.least(F.floor((F.col(c) - F.col(f"{c}0")) / F.when(F.col("side") > 0, F.col("side")).otherwise(1.0) * (1 << LEVELS)), F.lit((1 << LEVELS) - 1)).cast("int")
    places = stored(places.join(box, KEY).select(KEY, F.col("nodes")[0].alias("place"), "x", "y", "nodes", "side", fine("x").alias("i"), fine("y").alias("j")))
    # the finest cells that hold more than k places
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))
    at = [F.expr(f"shiftright({c}, level)").alias(c) for c in "ij"]
    cells = places.groupBy(KEY, "i", "j").agg(F.count("*").alias("n")).withColumn("level", levels).select(KEY, "level", *at, "n")
    filled = cells.groupBy(KEY, "level", "i", "j").agg(F.sum("n").alias("n")).filter(F.col("n") > k)
    own = places.select(KEY, "place", "i", "j").withColumn("level", levels).select(KEY, "place", "level", *at)
    starts = own.join(filled.hint("merge"), [KEY, "level", "i", "j"]).groupBy(KEY, "place").agg(F.min("level").alias("level"))
    active = stored(places.join(starts.hint("merge"), [KEY, "place"], "left").withColumn("level", F.coalesce("level", F.lit(LEVELS))))
    lists = None
    first = active.agg(F.min("level")).first()[0]
    for level in range(first, LEVELS + 1):
        now = active.filter(F.col("level") == level)
        asked = now.select(KEY, *(F.shiftright(c, level + HOME).alias(c) for c in "ij"), "place", F.col("x").alias("ax"), F.col("y").alias("ay"), "side")
        homes = F.expr(f"array_distinct(flatten(transform(sequence(-1, 1), a -> transform(sequence(-1, 1), b -> struct(shiftright(shiftright(i, {level}) + a, {HOME}) AS i, shiftright(shiftright(j, {level}) + b, {HOME}) AS j)))))")
        index = places.select(KEY, F.explode(homes).alias("h"), "x", "y", "nodes").select(KEY, "h.i", "h.j", "x", "y", "nodes")
        index = index.join(asked.select(KEY, "i", "j").distinct().hint("merge"), [KEY, "i", "j"], "left_semi")
        top = spread_groups(asked).groupBy(KEY, "i", "j").cogroup(spread_groups(index).groupBy(KEY, "i", "j")).applyInPandas(lambda a, b: _nearest(a, b, k + 1, metric), f"{KEY} {dict(points.dtypes)[KEY]}, place long, side double, w array<double>, v array<long>")
        top = stored(top.select(KEY, "place", "side", F.arrays_zip("w", "v").alias("near")))
        reach = F.col("side") * ((1 - 1e-9) * 2.0 ** (level - LEVELS))  # no other place is nearer than a cell's side
        settled = (F.size("near") > k) & (F.col("near")[k]["w"] < reach) if level < LEVELS else F.lit(True)
        done = top.filter(settled).select(KEY, "place", "near")
        lists = done if lists is None else lists.unionByName(done)
        if level < LEVELS:
            open_ = top.filter(~settled).select(KEY, "place")
            rest = active.filter(F.col("level") > level).unionByName(now.join(open_.hint("merge"), [KEY, "place"], "left_semi").withColumn("level", F.lit(level + 1)))
            active = stored(rest)
            if active.isEmpty():
                break
    named = points.join(places.select(KEY, "x", "y", "place").hint("merge"), [KEY, "x", "y"]).select(KEY, "node", "place").join(lists.hint("merge"), [KEY, "place"])
    near = named.select(KEY, F.col("node").alias("a"), F.explode(F.slice(F.filter("near", lambda e: e["v"] != F.col("node")), 1, k)).alias("e"))
    return near.select(KEY, "a", F.col("e.v").alias("b"), "e.w")


def canonical(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"u": F.least("u", "v"), "v": F.greatest("u", "v")})


def outside(weighted: DataFrame, tree: DataFrame) -> DataFrame:
    """Pairs of finite weight that are no tree edges, whatever way round."""
    return canonical(weighted.filter("w < double('infinity')")).join(canonical(tree).select(KEY, "u", "v"), [KEY, "u", "v"], "left_anti")


def compared(one: DataFrame, other: DataFrame) -> DataFrame:
    """same, only_one, only_other and swaps of two edge sets, by network."""
    a = canonical(one).select(KEY, "u", "v").distinct().withColumn("a", F.lit(1))
    b = canonical(other).select(KEY, "u", "v").distinct().withColumn("b", F.lit(1))
    both = a.join(b, [KEY, "u", "v"], "full")
    n = both.groupBy(KEY).agg(F.count(F.when(F.col("b").isNull(), 1)).alias("only_one"), F.count(F.when(F.col("a").isNull(), 1)).alias("only_other"))
    return n.withColumn("same", (F.col("only_one") + F.col("only_other")) == 0).withColumn("swaps", F.floor((F.col("only_one") + F.col("only_other")) / 2))


def forest(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rows of the minimum spanning forest of edges u, v (numbered ends) in the total order (w, u, v), by Boruvka's rounds."""
    order = np.lexsort((v, u, w))
    a, b, kept = u[order], v[order], []
    part = np.arange(int(max(a.max(initial=-1), b.max(initial=-1))) + 1)
    while True:
        ca, cb = part[a], part[b]
        open_ = ca != cb
        a, b, ca, cb, order = a[open_], b[open_], ca[open_], cb[open_], order[open_]
        if not len(a):
            return np.sort(np.concatenate(kept)) if kept else np.zeros(0, dtype=int)
        first, rank = np.full(len(part), len(a)), np.arange(len(a))
        np.minimum.at(first, ca, rank)
        np.minimum.at(first, cb, rank)
        heads = np.flatnonzero(first < len(a))
        pick = first[heads]
        kept.append(order[np.unique(pick)])
        # picks point along a forest whose only cycles are two parts that picked the same edge
        up = np.arange(len(part))
        up[heads] = ca[pick] + cb[pick] - heads
        both = heads[(up[up[heads]] == heads) & (heads < up[heads])]
        up[both] = both
        while (up[up] != up).any():
            up = up[up]
        part = up[part]


def forest_of(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Rows of the spanning forests of all networks (keys) in pdf (keys, u, v, w, ...)."""
    if pdf.empty:
        return pdf
    ends = pd.concat([pdf["u"], pdf["v"]], ignore_index=True)
    names, at = np.unique(ends.to_numpy(), return_inverse=True)  # sorted, so numbers compare as nodes do
    network = pdf.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
    code = pd.factorize(np.concatenate([network, network]) * len(names) + at, sort=True)[0]
    return pdf.iloc[forest(code[: len(pdf)], code[len(pdf) :], pdf["w"].to_numpy(dtype=float))]


#: Edges that a task holds before it keeps their forest only, and that one task joins to a network's tree.
HELD_EDGES, MOST_EDGES = 1 << 19, 1 << 21


def thinned(edges: DataFrame) -> DataFrame:
    """The edges of (network_id, u, v, w) without those that close a cycle of smaller ones among the edges of their partition.

    No such edge is in a minimum spanning forest of all. A task holds the nodes it meets and some edges more, whatever it reads.
    """

    def run(batches):
        held, rows, most = [], 0, HELD_EDGES
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows > most:
                held = [forest_of(pd.concat(held, ignore_index=True), [KEY])]
                rows = len(held[0])
                most = max(HELD_EDGES, 2 * rows)
        if held:
            yield forest_of(pd.concat(held, ignore_index=True), [KEY])

    return edges.mapInPandas(run, edges.schema)


def spanning_tree(weighted: DataFrame) -> DataFrame:
    """Minimum spanning forest of (network_id, u, v, w) in the total order (w, u, v).

    Edges are thinned where they lie. What is left of a network goes to one task if that is up to MOST_EDGES, which leaves
    the tree; beyond that Boruvka's rounds go over the edge table.
    """
    edges = stored(thinned(canonical(weighted).filter("u <> v").select(KEY, "u", "v", "w")))
    sized = edges.join(stored(edges.groupBy(KEY).agg(F.count("*").alias("edges"))), KEY)
    small = sized.filter(F.col("edges") <= MOST_EDGES).drop("edges").groupBy(KEY).applyInPandas(lambda pdf: forest_of(pdf, [KEY]), edges.schema)
    large = sized.filter(F.col("edges") > MOST_EDGES).drop("edges")
    return small if large.isEmpty() else small.unionByName(boruvka(large))


def boruvka(weighted: DataFrame) -> DataFrame:
    """spanning_tree() by rounds over the edge table.

    Every round each component picks its least outgoing edge; the picks join components, whose least node names them.
    """
    edges = stored(canonical(weighted).filter("u <> v").groupBy(KEY, "u", "v").agg(F.min("w").alias("w")))
    part = both_ways(edges.drop("w")).select(KEY, F.col("a").alias("node")).distinct().withColumn("c", F.col("node"))
    part, tree = stored(part), None
    while True:
        cu, cv = part.select(KEY, F.col("node").alias("u"), F.col("c").alias("cu")), part.select(KEY, F.col("node").alias("v"), F.col("c").alias("cv"))
        edges = stored(edges.select(KEY, "u", "v", "w").join(cu, [KEY, "u"]).join(cv, [KEY, "v"]).filter("cu <> cv"))
        if edges.isEmpty():
            break
        order = F.struct("w", "u", "v")
        ends = edges.select(KEY, F.col("cu").alias("c"), F.col("cv").alias("other"), order.alias("e")).unionByName(edges.select(KEY, F.col("cv").alias("c"), F.col("cu").alias("other"), order.alias("e")))
        picks = stored(ends.groupBy(KEY, "c").agg(F.min(F.struct("e", "other")).alias("p")).select(KEY, "c", F.col("p.other").alias("to"), "p.e.u", "p.e.v", "p.e.w"))
        found = picks.select(KEY, "u", "v", "w").distinct()
        tree = found if tree is None else tree.unionByName(found)
        # picks point along a forest whose only cycles are two components that picked the same edge
        back = picks.select(KEY, F.col("c").alias("to"), F.col("to").alias("back"))
        up = picks.join(back, [KEY, "to"], "left").select(KEY, "c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to"))
        up = stored(up)
        while True:  # pointer jumping
            on = up.select(KEY, F.col("c").alias("to"), F.col("to").alias("next"))
            nxt = stored(up.join(on, [KEY, "to"]).select(KEY, "c", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
            up = nxt.drop("moved")
            if nxt.filter("moved").isEmpty():
                break
        part = stored(part.join(up, [KEY, "c"], "left").select(KEY, "node", F.coalesce("to", "c").alias("c")))
    return (tree if tree is not None else edges.select(KEY, "u", "v", "w")).select(KEY, "u", "v", "w")


MOST_POINTS = 4096


def spanning_tree_of_points(nodes: DataFrame, metric: str = "euclidean") -> DataFrame:
    """The same of the complete graph on points (network_id, node, x, y), without making its edges.

    Networks of up to MOST_POINTS points take Prim's rounds in one task each, in O(points) memory. The points of larger
    ones are dealt to blocks, and every two blocks have their own tree made so, all in parallel: an edge that is not in
    the tree of the two blocks of its ends closes a cycle of smaller edges, so it is not in the whole tree either. That
    leaves points x blocks edges for Boruvka's rounds.
    """
    sized = nodes.join(nodes.groupBy(KEY).agg(F.count("*").alias("points")), KEY)
    types = dict(nodes.dtypes)
    schema = f"{KEY} {types[KEY]}, u long, v long, w double"

    def prim(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        name, size = pdf["node"].to_numpy(), len(pdf)
        # what is not in the tree yet comes first: coordinates, place in name, least distance to the tree and to which point of it
        x, y, own = pdf["x"].to_numpy(copy=True), pdf["y"].to_numpy(copy=True), np.arange(size)
        far, near = np.full(size, np.inf), np.zeros(size, dtype=int)
        out, now, edge = [], 0, lambda i: (min(own[i], near[i]), max(own[i], near[i]))
        for left in range(size - 1, 0, -1):
            at, px, py = own[now], x[now], y[now]
            for column in (x, y, own, far, near):
                column[now] = column[left]
            dx, dy = x[:left] - px, y[:left] - py
            w = np.sqrt(dx * dx + dy * dy) if metric == "euclidean" else np.abs(dx) + np.abs(dy)
            old = far[:left]
            same = w == old
            better = w < old
            if same.any():
                a, b = np.minimum(own[:left], at), np.maximum(own[:left], at)
                c, d = np.minimum(own[:left], near[:left]), np.maximum(own[:left], near[:left])
                better |= same & ((a < c) | ((a == c) & (b < d)))
            np.copyto(old, w, where=better)
            np.copyto(near[:left], at, where=better)
            now = int(old.argmin())
            if np.count_nonzero(tied := old == old[now]) > 1:
                now = min(np.flatnonzero(tied), key=edge)
            out.append((*edge(now), old[now]))
        made = pd.DataFrame({"u": name[[e[0] for e in out]], "v": name[[e[1] for e in out]], "w": [e[2] for e in out]}) if out else pd.DataFrame({"u": [], "v": [], "w": []})
        made.insert(0, KEY, pdf[KEY].iloc[0])
        return made

    small = sized.filter(F.col("points") <= MOST_POINTS).drop("points").select(KEY, "node", "x", "y").groupBy(KEY).applyInPandas(prim, schema)
    large = sized.filter(F.col("points") > MOST_POINTS)
    if large.isEmpty():
        return small
    blocks = F.ceil(F.col("points") / (MOST_POINTS // 2)).cast("int")
    own = large.select(KEY, "node", "x", "y", blocks.alias("blocks")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = own.withColumn("other", F.explode(F.expr("filter(sequence(0, blocks - 1), b -> b <> own)")))
    met = met.select(KEY, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "x", "y")
    of_two = met.groupBy(KEY, "i", "j").applyInPandas(lambda pdf: prim(pdf.drop(columns=["i", "j"])), schema)
    return small.unionByName(spanning_tree(of_two.distinct()))


#: Parts of a result that are kept apart before they are stored as one.
MOST_PARTS = 16


def rooted(edges: DataFrame, root: int = 0) -> DataFrame:
    """network_id, node, parent (-1 at the root), depth: breadth-first from the root; the least parent on ties.

    Networks of up to MOST_EDGES edges are searched in one task each, larger ones by rounds over the edge table.
    Nodes that the root does not reach have no row; a network without the root has none. Repeated edges and loops change nothing.
    """
    kind = dict(edges.dtypes)[KEY]

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(pdf[["u", "v"]].to_numpy().ravel(), return_inverse=True)
        at = at.reshape(-1, 2)
        a, b = np.concatenate([at[:, 0], at[:, 1]]), np.concatenate([at[:, 1], at[:, 0]])
        order = np.argsort(a, kind="stable")
        b, first = b[order], np.searchsorted(a[order], np.arange(len(names) + 1))
        parent, depth = np.full(len(names), len(names)), np.full(len(names), -1)
        front = np.flatnonzero(names == root)
        depth[front], step = 0, 0
        while len(front):
            step += 1
            size = first[front + 1] - first[front]
            arc = np.repeat(first[front] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            to, by = b[arc], np.repeat(front, size)
            new = depth[to] < 0
            np.minimum.at(parent, to[new], by[new])
            front = np.unique(to[new])
            depth[front] = step
        there = np.flatnonzero(depth >= 0)
        up = np.append(names, -1)[np.where(depth[there] > 0, parent[there], len(names))]
        out = pd.DataFrame({"node": names[there], "parent": up, "depth": depth[there]})
        out.insert(0, KEY, pdf[KEY].iloc[0])
        return out

    rows = stored(edges.select(KEY, "u", "v").filter("u is not null and v is not null"))
    sized = rows.join(stored(rows.groupBy(KEY).agg(F.count("*").alias("edges"))), KEY)
    small = sized.filter(F.col("edges") <= MOST_EDGES).drop("edges").groupBy(KEY).applyInPandas(search, f"{KEY} {kind}, node long, parent long, depth int")
    large = sized.filter(F.col("edges") > MOST_EDGES).drop("edges")
    return small if large.isEmpty() else small.unionByName(rooted_by_rounds(large, root))


def rooted_by_rounds(edges: DataFrame, root: int = 0) -> DataFrame:
    """rooted() by a frontier of all networks.

    What a frontier meets is one hop nearer, as near, or new, so it is compared with the last two frontiers only.
    """
    arcs = stored(both_ways(edges.select(KEY, "u", "v")))
    front = stored(arcs.filter(F.col("a") == root).select(KEY, F.col("a").alias("node")).distinct().withColumn("parent", F.lit(-1).cast("long")).withColumn("depth", F.lit(0)))
    parts, last, depth = [front], front.limit(0), 0
    while True:
        depth += 1
        new = front.select(KEY, F.col("node").alias("a")).join(arcs, [KEY, "a"]).groupBy(KEY, F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        near = front.select(KEY, "node").unionByName(last.select(KEY, "node"))
        last, front = front, stored(new.join(near, [KEY, "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return functools.reduce(DataFrame.unionByName, parts)
        parts.append(front)
        if len(parts) > MOST_PARTS:
            parts = [stored(functools.reduce(DataFrame.unionByName, parts))]


def climbed(tree: DataFrame, keys: list[str], values: DataFrame, sums: dict[str, Callable[[str], Column]]) -> DataFrame:
    """keys, node and each of ``sums`` over the node and all below it. tree: keys, node, parent (none at -1); values: keys, node, and the columns.

    A node's total over those fewer than 2^i hops below and its 2^i-th ancestor are known; added to that ancestor's
    total they double the reach. So there are log(depth) rounds of as many rows as nodes. Nodes without values have nulls,
    as have totals of nothing.
    """
    now = stored(tree.select(*keys, "node").join(values, [*keys, "node"], "left"))
    jump = stored(tree.filter("parent >= 0").select(*keys, "node", F.col("parent").alias("to")))
    while not jump.isEmpty():
        sent = jump.join(now, [*keys, "node"]).select(*keys, F.col("to").alias("node"), *sums)
        now = stored(now.unionByName(sent).groupBy(*keys, "node").agg(*(f(c).alias(c) for c, f in sums.items())))
        on = jump.select(*keys, F.col("node").alias("to"), F.col("to").alias("next"))
        jump = stored(jump.join(on, [*keys, "to"]).select(*keys, "node", F.col("next").alias("to")))
    return now


def from_root(tree: DataFrame, keys: list[str], lengths: DataFrame) -> DataFrame:
    """keys, node and far: the length of the way up to the root. lengths: keys, node, length of the edge above it (null: 0).

    Pointer doubling: each way is joined with that of the node where it ends.
    """
    way = tree.join(lengths, [*keys, "node"], "left").select(*keys, "node", F.col("parent").alias("to"), F.when(F.col("parent") >= 0, F.coalesce("length", F.lit(0.0))).otherwise(0.0).alias("far"))
    way = stored(way)
    while not way.filter("to >= 0").isEmpty():
        on = way.select(*keys, F.col("node").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"))
        way = stored(way.join(on, [*keys, "to"], "left").select(*keys, "node", F.coalesce("next", F.lit(-1)).alias("to"), (F.col("far") + F.coalesce("more", F.lit(0.0))).alias("far")))
    return way.select(*keys, "node", "far")


def ancestors_alone(tree: DataFrame, most: int = MOST_POINTS) -> DataFrame:
    """ancestors() of rooted() trees, those of up to ``most`` nodes in one task each."""

    def climb(pdf: pd.DataFrame) -> pd.DataFrame:
        name, parts = pdf["node"].to_numpy(), []
        order = np.argsort(name)
        to = np.searchsorted(name[order], pdf["parent"].to_numpy())
        up = np.where(pdf["parent"].to_numpy() >= 0, order[np.minimum(to, len(name) - 1)], -1)
        own = at = np.arange(len(name))
        while len(at):
            parts.append((name[own], name[at], np.full(len(at), len(parts))))
            own, at = own[up[at] >= 0], up[at][up[at] >= 0]
        node, ancestor, hops = (np.concatenate(c) for c in zip(*parts, strict=True))
        return pd.DataFrame({KEY: pdf[KEY].iloc[0], "node": node, "ancestor": ancestor, "hops": hops})

    sized = tree.join(tree.groupBy(KEY).agg(F.count("*").alias("nodes")), KEY)
    small = spread_networks(sized.filter(F.col("nodes") <= most).drop("nodes")).groupBy(KEY).applyInPandas(climb, f"{KEY} {dict(tree.dtypes)[KEY]}, node long, ancestor long, hops int")
    large = sized.filter(F.col("nodes") > most).drop("nodes")
    return small if large.isEmpty() else small.unionByName(ancestors(large))


def ancestors(tree: DataFrame) -> DataFrame:
    """network_id, node, ancestor, hops of every node with itself (0) and all above it; doubling, so log(depth) rounds."""
    up = tree.select(KEY, "node", "ancestor", "hops") if "ancestor" in tree.columns else tree.select(KEY, "node", F.col("node").alias("ancestor"), F.lit(0).alias("hops"))
    jump, step = stored(tree.filter("parent >= 0").select(KEY, "node", F.col("parent").alias("to"))), 1
    up = stored(up)
    while not jump.isEmpty():
        higher = jump.join(up.withColumnRenamed("node", "to"), [KEY, "to"]).select(KEY, "node", "ancestor", (F.col("hops") + step).alias("hops"))
        up = stored(up.unionByName(higher))
        on = jump.select(KEY, F.col("node").alias("to"), F.col("to").alias("next"))
        jump, step = stored(jump.join(on, [KEY, "to"]).select(KEY, "node", F.col("next").alias("to"))), step * 2
    return up


def path_edges(above: DataFrame, ends: DataFrame) -> DataFrame:
    """Of each pair (network_id, u, v): the tree edges on the path between, named by their lower node (edge)."""
    a = ends.join(above.filter("hops >= 0").select(KEY, F.col("node").alias("u"), F.col("ancestor").alias("edge")), [KEY, "u"]).select(KEY, "u", "v", "edge")
    b = ends.join(above.select(KEY, F.col("node").alias("v"), F.col("ancestor").alias("edge")), [KEY, "v"]).select(KEY, "u", "v", "edge")
    return a.unionByName(b).groupBy(KEY, "u", "v", "edge").count().filter("count = 1").drop("count")


def shortest(edges: DataFrame, keys: tuple[str, ...] = (KEY,), root: int = 0) -> DataFrame:
    """keys, node, cost, hops, parent: cheapest paths from the root over (keys, u, v, length), by rounds of relaxation.

    Ties go to fewer hops, then the least parent. Unreached nodes have no row.
    """
    keys = list(keys)
    arcs = stored(arcs_of(edges, keys))
    best = arcs.filter(F.col("a") == root).select(*keys, F.col("a").alias("node")).distinct()
    best = stored(best.select(*keys, "node", F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.lit(-1).cast("long").alias("parent")).alias("s")))
    return relaxed(best, arcs, keys)


def arcs_of(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b, length of every edge both ways."""
    one = edges.select(*keys, F.col("u").alias("a"), F.col("v").alias("b"), "length")
    return one.unionByName(edges.select(*keys, F.col("v").alias("a"), F.col("u").alias("b"), "length"))


def relaxed(best: DataFrame, arcs: DataFrame, keys: list[str], shared: list[str] | None = None) -> DataFrame:
    """keys, node, cost, hops, parent of the cheapest ways on from stored starts (keys, node, s: cost, hops, parent) over arcs.

    ``shared``: the keys that arcs have, if they are the same for all values of the others.
    """
    front = best
    while not front.isEmpty():
        step = front.select(*keys, F.col("node").alias("a"), "s").join(arcs, [*(shared or keys), "a"])
        offer = step.select(*keys, F.col("b").alias("node"), F.struct((F.col("s.cost") + F.col("length")).alias("cost"), (F.col("s.hops") + 1).alias("hops"), F.col("a").alias("parent")).alias("s"))
        offer = offer.groupBy(*keys, "node").agg(F.min("s").alias("s"))
        front = offer.join(best.withColumnRenamed("s", "old"), [*keys, "node"], "left").filter("old is null or s < old").select(*keys, "node", "s")
        front = stored(front)
        best = stored(best.join(front.select(*keys, "node"), [*keys, "node"], "left_anti").unionByName(front))
    return best.select(*keys, "node", "s.cost", "s.hops", "s.parent")
