"""Queries for searches, centralities and null models; most have no SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatlattice.functions import physics as p
from heatlattice.functions.params import ECONOMICS, FAILURES, GROUND, PUBLISHED, Ground
from heatlattice.operators import centrality, designs, graph, netsci, network, regression, search, terrain
from heatlattice.plans import fixtures as fx
from heatlattice.plans.fixtures import duck_text, frame
from heatlattice.plans.queries import ABOVE, COST_COLUMNS, COVER, FLOW, SITES, K, cost_sql, cover_of, design_of, design_sql, grid, mst_sql, picked_sql, route_sql, supply, tree_relief
from heatlattice.plans.registry import query, rounded


def greedy_sql(score: str, steps: int = 3) -> str:
    """Step by step: the best candidate of what is left, and what it leaves."""
    ctes, left = [], "cv"
    for i in range(1, steps + 1):
        ctes += [
            f"g{i} AS (SELECT l.network_id, l.u, l.v, sum(weight) AS gain, max(cd.l3d) AS cost FROM {left} l JOIN cd ON cd.network_id = l.network_id AND cd.u = l.u AND cd.v = l.v GROUP BY 1, 2, 3)",
            f"t{i} AS (SELECT *, {i} AS step FROM g{i} WHERE gain > 0 AND cost > 0 QUALIFY row_number() OVER (PARTITION BY network_id ORDER BY {score} DESC, cost, u, v) = 1)",
            f"l{i} AS (SELECT * FROM {left} l WHERE NOT EXISTS (SELECT 1 FROM t{i} t JOIN cv c ON c.network_id = t.network_id AND c.u = t.u AND c.v = t.v WHERE c.network_id = l.network_id AND c.edge = l.edge))",
        ]
        left = f"l{i}"
    every = " UNION ALL ".join(f"SELECT network_id, step, u, v, gain, cost FROM t{i}" for i in range(1, steps + 1))
    return duck_text(f"WITH RECURSIVE {ABOVE}, {FLOW}, {COVER}, {', '.join(ctes)} {every}")


@query(greedy_sql("gain / cost"))
def cover_greedy_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.greedy_cover(*cover_of(spark, sf_dir), 3)


@query(greedy_sql("gain"))
def cover_greedy_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.greedy_cover(*cover_of(spark, sf_dir), 3, "gain")


@query(duck_text(f"WITH RECURSIVE {ABOVE}, {FLOW}, {COVER} SELECT network_id, max(covered) AS covered FROM sc GROUP BY 1"))
def cover_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch and bound for two picks, held against all pairs."""
    return search.exact_cover(*cover_of(spark, sf_dir), 2).select(K, "covered")


_TRIPLES = """cm AS (SELECT c.* FROM cd c WHERE EXISTS (SELECT 1 FROM cv WHERE cv.network_id = c.network_id AND cv.u = c.u AND cv.v = c.v AND cv.weight > 0)),
  s3 AS (SELECT network_id, l3d AS cost, [(u, v)] AS set FROM cm UNION ALL SELECT a.network_id, a.l3d + b.l3d, [(a.u, a.v), (b.u, b.v)] FROM cm a JOIN cm b ON a.network_id = b.network_id AND (a.u, a.v) < (b.u, b.v)
    UNION ALL SELECT a.network_id, a.l3d + b.l3d + c.l3d, [(a.u, a.v), (b.u, b.v), (c.u, c.v)] FROM cm a JOIN cm b ON a.network_id = b.network_id AND (a.u, a.v) < (b.u, b.v) JOIN cm c ON c.network_id = a.network_id AND (b.u, b.v) < (c.u, c.v)),
  t3 AS (SELECT s3.*, (SELECT sum(weight) FROM (SELECT DISTINCT edge, weight FROM cv WHERE cv.network_id = s3.network_id AND list_contains(s3.set, (cv.u, cv.v)))) AS covered FROM s3),
  b3 AS (SELECT * FROM t3 QUALIFY row_number() OVER (PARTITION BY network_id ORDER BY covered DESC, cost, set) = 1)"""


@query(duck_text(f"WITH RECURSIVE {ABOVE}, {FLOW}, {COVER}, {_TRIPLES} SELECT network_id, covered, cost, " + ", ".join(f"coalesce(set[{n}][{i + 1}], -1)::BIGINT AS {c}{n}" for n in (1, 2, 3) for i, c in enumerate("uv")) + " FROM b3"))
def cover_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best set of up to three chords, of all."""
    cover, cost = (graph.stored(x) for x in cover_of(spark, sf_dir))
    greedy = search.greedy_cover(cover, cost, 3, "gain").groupBy(K).agg(F.sum("gain").alias("covered"))
    return network.best_triples(cover, cost, greedy).fillna(-1)


def augmentation_sql(steps: int = 3) -> str:
    """Step by step: the best chord for its money, sized for the worst of the bridges that are left, and what it leaves."""
    ctes, left = [f"b0 AS (SELECT network_id, v AS edge, flow AS stranded_kw, {p.failure_rate('l3d', 'dn', 'u_mps', 'd_in')} * {p.n(FAILURES.repair_h)} * flow / 1000e0 AS eud FROM pk)"], "b0"
    for i in range(1, steps + 1):
        ctes += [
            f"w{i} AS (SELECT *, {p.mass_flow('greatest(backup, 1e0)')} AS mdot FROM (SELECT network_id, max(stranded_kw) AS backup FROM {left} GROUP BY 1))",
            f"p{i} AS (SELECT * FROM {picked_sql(f'w{i}')})",
            f"g{i} AS (SELECT pe.network_id, pe.u, pe.v, sum(eud) AS gain, max(({p.n(ECONOMICS.C1)} + {p.n(ECONOMICS.C2)} * d_casing) * l3d * {p.n(p.CRF)}) AS cost FROM pe JOIN {left} USING (network_id, edge) JOIN cd ON cd.network_id = pe.network_id AND cd.u = pe.u AND cd.v = pe.v JOIN p{i} ON p{i}.network_id = pe.network_id GROUP BY 1, 2, 3)",
            f"t{i} AS (SELECT * FROM g{i} WHERE cost > 0 QUALIFY row_number() OVER (PARTITION BY network_id ORDER BY gain / cost DESC, u, v) = 1)",
            f"b{i} AS (SELECT * FROM {left} l WHERE NOT EXISTS (SELECT 1 FROM t{i} t JOIN pe ON pe.network_id = t.network_id AND pe.u = t.u AND pe.v = t.v WHERE pe.network_id = l.network_id AND pe.edge = l.edge))",
        ]
        left = f"b{i}"
    of = lambda i, f: f"coalesce((SELECT {f} FROM b{i} WHERE b{i}.network_id = t{i}.network_id), 0e0)"
    every = " UNION ALL ".join(f"SELECT network_id, {i} AS step, u, v, round(cost, 4) AS cost, round({of(i, 'sum(eud)')}, 6) AS eud_after, {of(i, 'max(stranded_kw)')} AS worst_after FROM t{i}" for i in range(1, steps + 1))
    return duck_text(f"WITH RECURSIVE {ABOVE}, {design_sql()}, {COVER}, {', '.join(ctes)} {every}")


@query(augmentation_sql())
def augmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    design, demand, tree, above = design_of(spark, sf_dir)
    rate = p.failure_rate("l3d", "dn", "u_mps", "d_in")
    bridges = design.select(K, F.col("v").alias("edge"), F.col("flow").alias("stranded_kw"), F.expr(f"{rate} * {p.n(FAILURES.repair_h)} * flow / 1000e0").alias("eud"))
    chords = frame(spark, sf_dir, fx.CHORDS).withColumn("lw", F.col("l3d"))
    return rounded(search.augmented(bridges, graph.path_edges(above, chords.select(K, "u", "v")), chords, 3), cost=4, eud_after=6)


def hubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sites of each network, node ids from 0, which is the hub."""
    sites = frame(spark, sf_dir, SITES)
    place = F.row_number().over(graph.Window.partitionBy(K).orderBy("node")) - 1
    return graph.stored(sites.withColumn("node", place.cast("long")))


def routed(spark: SparkSession, sf_dir: str, k: int) -> tuple[DataFrame, DataFrame]:
    """hubbed(), and the terrain routes of their map's spanning tree and of each site with its k nearest by weight."""
    sites, dem = hubbed(spark, sf_dir), grid(spark, sf_dir)
    near = graph.stored(terrain.nearest_routes(sites, dem, fx.GRID, k))
    own = terrain.routes_of(graph.spanning_tree_of_points(sites), sites, dem, fx.GRID)
    return sites, near.unionByName(own.join(near.select(K, "u", "v"), [K, "u", "v"], "left_anti"))


def spanned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[tuple[str, DataFrame]], DataFrame]:
    """hubbed(), their star and spanning trees by distance and terrain weight, and the routes of the edges of these alone."""
    sites, dem = hubbed(spark, sf_dir), grid(spark, sf_dir)
    plain = graph.stored(graph.spanning_tree_of_points(sites))
    trees = [("star", graph.star(sites)), ("mst_map", plain), ("mst_terrain", graph.stored(terrain.trees(sites, dem, fx.GRID, seed=plain)))]
    edges = functools.reduce(DataFrame.unionByName, [t.select(K, "u", "v") for _, t in trees])
    return sites, trees, graph.stored(terrain.routes_of(edges, sites, dem, fx.GRID))


@query()
def edge_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local search from the map's spanning tree, priced over terrain."""
    sites, routes = routed(spark, sf_dir, search.NEAREST)
    return search.swapped(routes, graph.spanning_tree_of_points(sites), loads(sites))


HUBBED = f"SELECT network_id, row_number() OVER (PARTITION BY network_id ORDER BY node) - 1 AS node, x, y FROM ({SITES}) sites"
MAP_SQL = mst_sql("SELECT a.network_id, a.node AS u, b.node AS v, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS w FROM sites a JOIN sites b ON a.network_id = b.network_id AND a.node < b.node")
TERRAIN_SQL = mst_sql("SELECT network_id, u, v, CASE WHEN feasible THEN wt ELSE 'infinity'::DOUBLE END AS w FROM routes")


@query(duck_text(f"""WITH RECURSIVE {route_sql(HUBBED)}, sites AS ({HUBBED}), m AS (SELECT network_id, u, v FROM ({MAP_SQL}) x), t AS (SELECT network_id, u, v FROM ({TERRAIN_SQL}) y),
  j AS (SELECT coalesce(m.network_id, t.network_id) AS network_id, m.u AS mu, t.u AS tu FROM m FULL JOIN t ON m.network_id = t.network_id AND m.u = t.u AND m.v = t.v)
  SELECT network_id, count(*) FILTER (tu IS NULL) AS only_one, count(*) FILTER (mu IS NULL) AS only_other, bool_and(mu IS NOT NULL AND tu IS NOT NULL) AS same, (count(*) FILTER (tu IS NULL OR mu IS NULL)) // 2 AS swaps FROM j GROUP BY 1"""))
def terrain_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spanning trees by distance and by terrain cost, and how they differ."""
    sites = hubbed(spark, sf_dir)
    plain = graph.stored(graph.spanning_tree_of_points(sites))
    return graph.compared(plain, terrain.trees(sites, grid(spark, sf_dir), fx.GRID, seed=plain))


# These three read no table, so they are no registered queries.


def layout_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fitted_layout(spark, PUBLISHED["length_1e4_m"]["Star"] * 1e4, PUBLISHED["length_1e4_m"]["MST"] * 1e4)


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = layout_fit(spark, sf_dir).first()  # one row
    out = search.calibrated(best.users, best.seed, best.scale, {k: PUBLISHED[f"{k}_1e7"]["MST"] * 1e7 for k in ("pipe", "pressure", "heat")})
    return spark.createDataFrame([tuple(map(float, out.values()))], ", ".join(f"{k} double" for k in out))


@query()
def centralities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centrality.centralities(frame(spark, sf_dir, fx.LOOPED))


@query()
def connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centrality.connectivity(frame(spark, sf_dir, fx.LOOPED))


@query()
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centrality.communities(frame(spark, sf_dir, fx.LOOPED))


@query()
def null_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    deg = netsci.degrees(frame(spark, sf_dir, fx.TREE_NODES), frame(spark, sf_dir, fx.TREE_EDGES))
    return centrality.degree_ratio(deg, centrality.null_models_of(deg))


def published_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published figures against the calibrated model."""
    best = layout_fit(spark, sf_dir).first()  # one row
    rows = search.compared_with(PUBLISHED, best.users, best.seed, best.scale)
    return spark.createDataFrame(rows, "metric string, topology string, published double, ours double, error_pct double")


# --- topologies side by side

#: The loads of all sites but the hub.
LOAD = "CASE WHEN node > 0 THEN 100e0 + node % 7 * 50e0 ELSE 0e0 END"
TOPOLOGIES = ["star", "mst_map", "mst_terrain", "steiner", "steiner_rectilinear"]


def loads(sites: DataFrame) -> DataFrame:
    return sites.select(K, "node", F.expr(LOAD).alias("demand_kw"))


def trees_sql(variants: list[str]) -> str:
    """CTEs e and nd of several trees of the sites' networks, network_id * 100 + number, rooted; ``variants`` select u, v."""
    undirected = " UNION ALL ".join(f"SELECT network_id * 100 + {i} AS network_id, u, v FROM ({t}) t{i}" for i, t in enumerate(variants))
    return f"""sites AS ({HUBBED}), ve AS ({undirected}), vb AS (SELECT network_id, u AS a, v AS b FROM ve UNION ALL SELECT network_id, v, u FROM ve),
  rt AS (SELECT DISTINCT network_id, 0::BIGINT AS node, -1::BIGINT AS parent FROM ve UNION ALL SELECT rt.network_id, vb.b, rt.node FROM rt JOIN vb ON vb.network_id = rt.network_id AND vb.a = rt.node AND vb.b <> rt.parent),
  nd AS (SELECT rt.network_id, rt.node, {LOAD.replace('node', 'rt.node')} AS demand_kw, 0e0 AS z FROM rt)"""


EDGES_ROUTED = """e AS (SELECT rt.network_id, rt.parent AS u, rt.node AS v, r.l2d, r.l3d, CASE WHEN r.feasible THEN r.wt END AS w, r.z_low, r.z_high FROM rt JOIN routes r ON r.network_id = rt.network_id // 100 AND r.u = least(rt.parent, rt.node) AND r.v = greatest(rt.parent, rt.node) WHERE rt.parent >= 0),
  up AS (SELECT network_id, node, node AS ancestor, 0 AS hops FROM nd UNION ALL SELECT up.network_id, up.node, e.u, up.hops + 1 FROM up JOIN e ON e.network_id = up.network_id AND e.v = up.ancestor)"""
ROUTE_RELIEF = "SELECT network_id, max(z_high) - min(z_low) AS relief_m FROM e GROUP BY 1"
STAR_SQL = "SELECT network_id, 0::BIGINT AS u, node AS v FROM sites WHERE node > 0"
SPANNING_SQL = f"{trees_sql([STAR_SQL, MAP_SQL, TERRAIN_SQL])}, {EDGES_ROUTED}, {cost_sql(ROUTE_RELIEF)}"
_COSTS = ", ".join(f"round({'total / greatest(delivered_mwh, 1e-9)' if c == 'specific' else c}, {n}) AS {c}" for c, n in COST_COLUMNS.items())


@query(duck_text(f"WITH RECURSIVE {route_sql(HUBBED)}, {SPANNING_SQL} SELECT network_id // 100 AS network_id, ['star', 'mst_map', 'mst_terrain'][network_id % 100 + 1] AS topology, n_zones, round(relief_m, 5) AS relief_m, {_COSTS} FROM cost"))
def topology_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Star, map tree and terrain tree of every network, priced in one plan over their routes."""
    sites, trees, routes = spanned(spark, sf_dir)
    cost, _ = side_by_side(trees, routes, loads(sites))
    return rounded(cost.select(K, "topology", "n_zones", "relief_m", *COST_COLUMNS), relief_m=5, **COST_COLUMNS)


def side_by_side(trees: list[tuple[str, DataFrame]], routes: DataFrame, demand: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cost and reliability of several trees of each network, by topology; routes and demand are those of the networks."""
    union = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    edges = union([designs.keyed(t.select(K, "u", "v"), i) for i, (_, t) in enumerate(trees)])
    both = [graph.stored(union([designs.keyed(x, i) for i in range(len(trees))])) for x in (routes.select(K, "u", "v", "l2d", "l3d", "w", "z_low", "z_high"), demand)]
    names = [name for name, _ in trees]
    cost, lost = designs.assessed(edges, *both)
    return designs.named(cost, names), designs.named(lost, names)


@query()
def topology_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five topologies with cost, reliability and structure; Steiner points have routes of their own."""
    sites, trees, _ = spanned(spark, sf_dir)
    demand, dem = loads(sites), grid(spark, sf_dir)
    parts = [(designs.keyed(sites.select(K, "node", "x", "y"), i), designs.keyed(t.select(K, "u", "v"), i), designs.keyed(demand, i)) for i, (_, t) in enumerate(trees)]
    for i, metric in ((3, "euclidean"), (4, "rectilinear")):
        parts.append(tuple(designs.keyed(x, i) for x in designs.with_points(sites, demand, metric)))
    nodes, edges, wanted = (graph.stored(functools.reduce(DataFrame.unionByName, x)) for x in zip(*parts, strict=True))
    own = graph.stored(terrain.routes_of(edges, nodes, dem, fx.GRID))
    cost, lost = designs.assessed(edges, own, wanted)
    shape = netsci.structure(wanted, graph.canonical(edges).join(own.select(K, "u", "v", "l3d"), [K, "u", "v"]))
    out = designs.named(cost.join(lost.drop("rate"), K).join(shape, K), TOPOLOGIES)
    return out.withColumn("place", F.row_number().over(graph.Window.partitionBy(K).orderBy("specific", "topology")))


_SAVING = ", ".join(f"round(CASE WHEN abs(a.{c} - b.{c}) < 1e-9 * a.total THEN 0e0 ELSE 100e0 * (a.{c} - b.{c}) / a.total END, 6) AS {n}" for c, n in (("total", "saving_pct"), ("capital", "d_capital_pct"), ("pumping", "d_pumping_pct"), ("heat_loss", "d_heat_loss_pct"), ("zones", "d_zones_pct")))


@query(duck_text(f"WITH RECURSIVE {route_sql(HUBBED)}, {SPANNING_SQL} SELECT a.network_id // 100 AS network_id, {_SAVING} FROM cost a JOIN cost b ON a.network_id + 1 = b.network_id AND a.network_id % 100 = 1"))
def terrain_saving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What planning over terrain saves against planning on the map, and by which part of the cost."""
    sites, trees, routes = spanned(spark, sf_dir)
    cost, _ = side_by_side(trees[1:], routes, loads(sites))
    out = designs.saving(cost, "mst_map", "mst_terrain")
    return rounded(out, **{c: 6 for c in out.columns[1:]})


#: Strengths of the slope factor, and the weights of routes by them.
STRENGTHS = [0.0, 0.5, 1.0, 1.5, 2.0]
GROUNDS = {f"w_{i}": Ground(a1=GROUND.a1 * f, a2=GROUND.a2 * f) for i, f in enumerate(STRENGTHS)}
_SLOPED = [mst_sql(f"SELECT network_id, u, v, CASE WHEN feasible THEN {c} ELSE 'infinity'::DOUBLE END AS w FROM routes") for c in GROUNDS]
_WEIGHT = "CASE rt.network_id % 100 // 2 " + " ".join(f"WHEN {i} THEN r.{c}" for i, c in enumerate(GROUNDS)) + " END"


@query(
    duck_text(
        f"WITH RECURSIVE {route_sql(HUBBED, GROUNDS)}, {trees_sql([x for t in _SLOPED for x in (MAP_SQL, t)])}, {EDGES_ROUTED.replace('THEN r.wt END', f'THEN {_WEIGHT} END')}, {cost_sql(ROUTE_RELIEF)}, "
        f"df AS (SELECT network_id - network_id % 2 AS network_id, count(*) // 2 AS n_diff FROM (SELECT network_id - network_id % 2 AS network_id, least(u, v) AS u, greatest(u, v) AS v FROM ve GROUP BY ALL HAVING count(*) = 1) GROUP BY 1) "
        f"SELECT a.network_id // 100 AS network_id, {STRENGTHS}[a.network_id % 100 // 2 + 1]::DOUBLE AS strength, coalesce(n_diff, 0)::BIGINT AS n_diff, {_SAVING} FROM cost a JOIN cost b ON a.network_id + 1 = b.network_id AND a.network_id % 2 = 0 LEFT JOIN df ON df.network_id = a.network_id"
    )
)
def slope_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The saving of terrain trees as the slope factor grows from none to twice its strength; trees are built anew for each."""
    sites = hubbed(spark, sf_dir)
    dem = grid(spark, sf_dir)
    plain = graph.stored(graph.spanning_tree_of_points(sites))
    union = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    made = graph.stored(terrain.trees(sites, dem, fx.GRID, grounds=GROUNDS, seed=plain))
    routes = graph.stored(terrain.routes_of(plain.select(K, "u", "v").unionByName(made.select(K, "u", "v")), sites, dem, fx.GRID, grounds=GROUNDS))
    weighed = [routes.select(K, "u", "v", "l2d", "l3d", F.col(c).alias("w"), "z_low", "z_high") for c in GROUNDS]
    every = graph.stored(union([designs.keyed(r, 2 * i + 1) for i, r in enumerate(weighed)]))
    sloped = graph.stored(made.select((F.col(K) * designs.VARIANTS + 2 * F.col("variant") + 1).alias(K), "u", "v"))
    flat = union([designs.keyed(plain.select(K, "u", "v"), 2 * i) for i in range(len(STRENGTHS))])
    twin = lambda df, by: df.withColumn(K, F.col(K) + by)
    demand = union([designs.keyed(loads(sites), i) for i in range(2 * len(STRENGTHS))])
    cost, _ = designs.assessed(flat.unionByName(sloped), every.unionByName(twin(every, -1)), graph.stored(demand))
    by = cost.withColumn("topology", F.when(F.col(K) % 2 == 0, "map").otherwise("terrain")).withColumn(K, F.col(K) - F.col(K) % 2)
    out = designs.saving(by, "map", "terrain").join(graph.compared(flat, twin(sloped, -1)).select(K, F.col("swaps").alias("n_diff")), K)
    strength = F.element_at(F.array(*map(F.lit, STRENGTHS)), (F.col(K) % designs.VARIANTS / 2 + 1).cast("int"))
    out = out.withColumn("strength", strength).withColumn(K, F.floor(F.col(K) / designs.VARIANTS))
    return rounded(out, **{c: 6 for c in out.columns if c.endswith("_pct")})


# --- robustness: sizes and draws of nodes, relief

SIZES, DRAWS = [8, 16, 24], 4


def drawn(sizes: list[int], draws: int) -> str:
    """A network of each size and draw: the sites with the least digests, node ids from 0; its key is network_id * 100 + 10 * size + draw."""
    return f"""SELECT network_id * 100 + 10 * size + draw AS network_id, place - 1 AS node, x, y FROM (
  SELECT network_id, size, n, draw, x, y, row_number() OVER (PARTITION BY network_id, size, draw ORDER BY md5(concat(CAST(draw AS VARCHAR(9)), ':', CAST(node AS VARCHAR(20)))), node) AS place
  FROM ({SITES}) sites CROSS JOIN (VALUES {', '.join(f'(CAST({i} AS BIGINT), {n})' for i, n in enumerate(sizes))}) sizes(size, n) CROSS JOIN (VALUES {', '.join(f'(CAST({i} AS BIGINT))' for i in range(draws))}) draws(draw)) drawn WHERE place <= n"""


DRAWN = drawn(SIZES, DRAWS)
#: Savings have 6 decimals; the 1e-9 sends the ties of their means the same way in both engines.
_MEANS = "round(avg(saving_pct) + 1e-9, 5) AS mean_pct, min(saving_pct) AS min_pct, max(saving_pct) AS max_pct, round(median(saving_pct) + 1e-9, 5) AS median_pct"


def means(rows: DataFrame, *by: str) -> DataFrame:
    middle = lambda f, name: F.round(f("saving_pct") + 1e-9, 5).alias(name)
    return rows.groupBy(*by).agg(middle(F.avg, "mean_pct"), F.min("saving_pct").alias("min_pct"), F.max("saving_pct").alias("max_pct"), middle(F.median, "median_pct"))


@query(
    duck_text(
        f"WITH RECURSIVE {route_sql(DRAWN)}, {SPANNING_SQL.replace(HUBBED, DRAWN)}, sv AS (SELECT a.network_id // 100 AS id, {_SAVING} FROM cost a JOIN cost b ON a.network_id + 1 = b.network_id AND a.network_id % 100 = 1) "
        f"SELECT id // 100 AS network_id, {SIZES}[id % 100 // 10 + 1]::INT AS size, count(*) AS draws, count(*) FILTER (saving_pct = 0) AS same_cost, {_MEANS} FROM sv GROUP BY ALL"
    )
)
def robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The saving of terrain trees over several draws of nodes and sizes: how far one draw can mislead."""
    sites = graph.stored(frame(spark, sf_dir, DRAWN))
    routes = graph.stored(terrain.all_routes(sites, grid(spark, sf_dir), fx.GRID))
    cost, _ = side_by_side(designs.spanning(sites, routes)[1:], routes, loads(sites))
    out = designs.saving(cost, "mst_map", "mst_terrain").withColumn("saving_pct", F.round("saving_pct", 6))
    size = F.element_at(F.array(*map(F.lit, SIZES)), (F.floor(F.col(K) % 100 / 10) + 1).cast("int"))
    out = out.select(F.floor(F.col(K) / 100).alias(K), size.alias("size"), "saving_pct")
    counts = out.groupBy(K, "size").agg(F.count("*").alias("draws"), F.count(F.when(F.col("saving_pct") == 0, 1)).alias("same_cost"))
    return counts.join(means(out, K, "size"), [K, "size"])


_METRICS = """dp AS (SELECT up.network_id, up.node, max(up.hops) AS hops, sum(coalesce(e.l2d, 0e0)) AS metres FROM up LEFT JOIN e ON e.network_id = up.network_id AND e.v = up.ancestor GROUP BY 1, 2),
  mt AS (SELECT network_id, sum(metres * demand_kw) / sum(demand_kw) / 1000 AS dist_km, sum(hops * demand_kw) / sum(demand_kw) AS mean_hops, max(hops)::DOUBLE AS max_hops FROM dp JOIN nd USING (network_id, node) GROUP BY 1),
  dg AS (SELECT network_id // 10000 AS id, total / greatest(delivered_mwh, 1e-9) AS cost, length_l3d / 1000 AS length_km, dist_km, mean_hops, max_hops FROM cost JOIN mt USING (network_id)),
  rs AS (SELECT id, count(*) AS designs, corr(cost, length_km) AS a, corr(cost, dist_km) AS b, corr(length_km, dist_km) AS c, corr(cost, mean_hops) AS h, corr(cost, max_hops) AS m FROM dg GROUP BY 1)"""


@query(
    duck_text(
        f"WITH RECURSIVE {route_sql(DRAWN)}, {SPANNING_SQL.replace(HUBBED, DRAWN)}, {_METRICS} "
        f"SELECT id AS network_id, designs, round(a, 6) AS r_length, round(b, 6) AS r_dist, round(h, 6) AS r_hops, round(m, 6) AS r_max_hops, round(a * a, 6) AS r2_length, round((a * a + b * b - 2 * a * b * c) / (1 - c * c), 6) AS r2_both FROM rs"
    )
)
def design_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cost of a design goes by, over all topologies, sizes and draws of a network: its length, its distance to the hub, its hops.

    The SQL has the two-predictor fit from the three correlations.
    """
    sites = graph.stored(frame(spark, sf_dir, DRAWN))
    routes = graph.stored(terrain.all_routes(sites, grid(spark, sf_dir), fx.GRID))
    rows = designs.metrics_of(designs.spanning(sites, routes), routes, loads(sites))
    rows = graph.stored(rows.withColumn(K, F.floor(F.col(K) / (100 * designs.VARIANTS))))
    out = rows.groupBy(K).agg(F.count("*").alias("designs"), *(F.corr("cost", c).alias(n) for c, n in (("length_km", "r_length"), ("dist_km", "r_dist"), ("mean_hops", "r_hops"), ("max_hops", "r_max_hops"))))
    for name, xs in (("r2_length", ["length_km"]), ("r2_both", ["length_km", "dist_km"])):
        out = out.join(regression.least_squares(rows, [K], "cost", xs).select(K, F.col("r2").alias(name)), K)
    return rounded(out, **{c: 6 for c in out.columns if c.startswith("r")})


#: Factors of the relief.
FACTORS = {i: f for i, f in enumerate([0.0, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 1.75, 2.0, 2.5, 3.0])}
_SCALED = ", ".join(f"({i}, {f!r}e0)" for i, f in FACTORS.items())
#: The routes of each factor, under network_id * 100 + the factor's number; only differences of height matter, so they are scaled about 0.
_RELIEF_ROUTES = route_sql(HUBBED).replace("smp AS (SELECT * FROM", f"smp AS (SELECT network_id * 100 + si AS network_id, u, v, k, chainage, z * f AS z FROM (VALUES {_SCALED}) sc(si, f),")
_RELIEF_SITES = f"SELECT h.network_id * 100 + si AS network_id, node, x, y FROM ({HUBBED}) h, (VALUES {_SCALED}) sc(si, f)"


@query(
    duck_text(
        f"WITH RECURSIVE {_RELIEF_ROUTES}, {SPANNING_SQL.replace(HUBBED, _RELIEF_SITES)} "
        f"SELECT network_id // 100 AS network_id, factor, n_zones, saving_pct FROM (SELECT a.network_id // 100 AS network_id, [{', '.join(map(repr, FACTORS.values()))}][a.network_id // 100 % 100 + 1]::DOUBLE AS factor, b.n_zones::INT AS n_zones, {_SAVING} FROM cost a JOIN cost b ON a.network_id + 1 = b.network_id AND a.network_id % 100 = 1)"
    )
)
def relief_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The saving of terrain trees, and their pressure zones, as the relief grows."""
    sites = hubbed(spark, sf_dir)
    dem = grid(spark, sf_dir)
    plain = graph.stored(graph.spanning_tree_of_points(sites).select(K, "u", "v"))  # the same for all factors
    made = graph.stored(terrain.trees(sites, dem, fx.GRID, scales=FACTORS, seed=plain))
    routes = terrain.routes_of(plain.unionByName(made.select(K, "u", "v")), sites, dem, fx.GRID, scales=FACTORS)
    routes = graph.stored(routes.withColumn(K, F.col(K) * 100 + F.col("scale")).drop("scale"))
    times = lambda df: functools.reduce(DataFrame.unionByName, [df.withColumn(K, F.col(K) * 100 + i) for i in FACTORS])
    trees = [("mst_map", times(plain)), ("mst_terrain", made.select((F.col(K) * 100 + F.col("variant")).alias(K), "u", "v"))]
    cost, _ = side_by_side(trees, routes, loads(times(sites)))
    out = designs.saving(cost, "mst_map", "mst_terrain").join(cost.filter("topology = 'mst_terrain'").select(K, "n_zones"), K)
    factor = F.element_at(F.array(*map(F.lit, FACTORS.values())), (F.col(K) % 100 + 1).cast("int"))
    return out.select(F.floor(F.col(K) / 100).alias(K), factor.alias("factor"), "n_zones", F.round("saving_pct", 6).alias("saving_pct"))


@query(duck_text(f"WITH RECURSIVE {ABOVE}, {cost_sql()} SELECT network_id, round(total, 2) AS total, 0e0 AS gap, true AS same FROM cost"))
def kept_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual costs written to a table, read again and held against costs worked out anew from the networks."""
    work = lambda: network.annual_cost(graph.stored(design_of(spark, sf_dir)[0]), *of_supply(spark, sf_dir))
    kept = graph.stored(work())
    found = designs.costs_compared(kept, work(), ["capital", "pumping", "heat_loss", "zones", "total"])
    return kept.select(K, F.round("total", 2).alias("total")).join(found.withColumn("gap", F.round("gap", 9)), K)


def of_supply(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ancestors, demand and relief of the supply trees."""
    _, demand, _, above = supply(spark, sf_dir)
    return above, demand, tree_relief(demand)


#: The sweep again over ten draws of sixteen sites; draws are part of the networks' key.
TEN = drawn([16], 10)
_TEN_ROUTES = _RELIEF_ROUTES.replace(HUBBED, TEN)
_TEN_SITES = _RELIEF_SITES.replace(HUBBED, TEN)


@query(
    duck_text(
        f"WITH RECURSIVE {_TEN_ROUTES}, {SPANNING_SQL.replace(HUBBED, _TEN_SITES)}, sv AS (SELECT a.network_id // 100 AS id, b.n_zones::INT AS n_zones, {_SAVING} FROM cost a JOIN cost b ON a.network_id + 1 = b.network_id AND a.network_id % 100 = 1) "
        f"SELECT id // 10000 AS network_id, [{', '.join(map(repr, FACTORS.values()))}][id % 100 + 1]::DOUBLE AS factor, count(*) AS draws, min(n_zones) AS least_zones, max(n_zones) AS most_zones, {_MEANS} FROM sv GROUP BY ALL"
    )
)
def relief_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relief sweep over ten draws: mean, median and range of the saving and the zones of each factor."""
    sites = graph.stored(frame(spark, sf_dir, TEN))
    routes = terrain.all_routes(sites, grid(spark, sf_dir), fx.GRID, scales=FACTORS)
    routes = graph.stored(routes.withColumn(K, F.col(K) * 100 + F.col("scale")).drop("scale"))
    every = graph.stored(sites.withColumn("scale", F.explode(F.array(*map(F.lit, FACTORS)))).withColumn(K, F.col(K) * 100 + F.col("scale")).drop("scale"))
    cost, _ = side_by_side(designs.spanning(every, routes)[1:], routes, loads(every))
    out = designs.saving(cost, "mst_map", "mst_terrain").join(cost.filter("topology = 'mst_terrain'").select(K, "n_zones"), K)
    factor = F.element_at(F.array(*map(F.lit, FACTORS.values())), (F.col(K) % 100 + 1).cast("int"))
    out = graph.stored(out.select(F.floor(F.col(K) / 10_000).alias(K), factor.alias("factor"), "n_zones", F.round("saving_pct", 6).alias("saving_pct")))
    zones = out.groupBy(K, "factor").agg(F.count("*").alias("draws"), F.min("n_zones").alias("least_zones"), F.max("n_zones").alias("most_zones"))
    return zones.join(means(out, K, "factor"), [K, "factor"])


@query()
def trade_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redundancy step by step: up to three chords, each prefix priced anew with pipes for every single failure."""
    sites, dem = hubbed(spark, sf_dir), graph.stored(grid(spark, sf_dir))
    ways = graph.stored(terrain.all_routes(sites, dem, fx.GRID).select(K, "u", "v", "w"))
    trees = graph.stored(graph.spanning_tree(ways))
    return designs.trade_off(trees, graph.outside(ways, trees), lambda edges: terrain.routes_of(edges, sites, dem, fx.GRID), loads(sites), 3)
