"""Networks, points, grids and pipes made of the generic tables, as SQL that both engines read.

Names in braces stand for tables. F1 is a supply tree a region: hub, nations, suppliers. F2 takes embeddings as points, a network a
label. F3 is an elevation grid: hills by formula, and in every cell the mean quantity of the order lines that fall into it. F4 takes order lines as pipes. F5 is F1 with chords between nations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

TREE_NODES = """
SELECT CAST(r_regionkey AS BIGINT) AS network_id, CAST(0 AS BIGINT) AS node, 0e0 AS demand_kw, 0e0 AS z FROM {region}
UNION ALL SELECT CAST(n_regionkey AS BIGINT), CAST(1 + n_nationkey AS BIGINT), 0e0, CAST(n_nationkey * 7 AS DOUBLE) FROM {nation}
UNION ALL SELECT CAST(n_regionkey AS BIGINT), 100 + s_suppkey, coalesce(q, 0e0), CAST((s_suppkey * 13) % 190 AS DOUBLE)
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
LEFT JOIN (SELECT l_suppkey, sum(l_quantity) AS q FROM {lineitem} GROUP BY l_suppkey) ON s_suppkey = l_suppkey"""

TREE_EDGES = """
SELECT CAST(n_regionkey AS BIGINT) AS network_id, CAST(0 AS BIGINT) AS u, CAST(1 + n_nationkey AS BIGINT) AS v, 400e0 + 37 * n_nationkey AS l2d, (400e0 + 37 * n_nationkey) * 1.25e0 AS l3d, (400e0 + 37 * n_nationkey) * 1.5e0 AS w FROM {nation}
UNION ALL SELECT CAST(n_regionkey AS BIGINT), CAST(1 + n_nationkey AS BIGINT), 100 + s_suppkey, 100e0 + 10 * (s_suppkey % 97), (100e0 + 10 * (s_suppkey % 97)) * 1.25e0,
  CASE WHEN s_suppkey % 11 = 0 THEN CAST(NULL AS DOUBLE) ELSE (100e0 + 10 * (s_suppkey % 97)) * 1.5e0 END FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"""

CHORDS = """
SELECT CAST(a.n_regionkey AS BIGINT) AS network_id, CAST(1 + a.n_nationkey AS BIGINT) AS u, CAST(1 + b.n_nationkey AS BIGINT) AS v, 300e0 + 11 * (a.n_nationkey + b.n_nationkey) AS l3d
FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"""

LOOPED = f"""SELECT network_id, u, v, l3d AS length FROM ({TREE_EDGES}) te UNION ALL SELECT network_id, u, v, l3d FROM ({CHORDS}) ch"""

POINTS = """
SELECT CAST(label AS BIGINT) AS network_id, CAST(vec_id AS BIGINT) AS node, CAST(embedding[{one}] AS DOUBLE) * 1000e0 AS x, CAST(embedding[{two}] AS DOUBLE) * 1000e0 AS y FROM {embeddings}"""

PIPES = """
SELECT l_orderkey, l_linenumber, l_quantity * 2e0 AS mdot, l_extendedprice / 100e0 AS length, l_quantity / 100e0 + 0.01e0 AS d, l_discount AS disc, l_quantity * 50e0 AS load_kw, l_tax * 100e0 AS dz FROM {lineitem}"""

GRID = (0.0, 0.0, 100.0, 41, 31)
DEM = """SELECT i, j, 100e0 + 40e0 * sin(i / 5e0) + 25e0 * cos(j / 4e0) + coalesce(rough, 0e0) AS z
FROM (SELECT CAST(i AS INT) AS i FROM ({ri}) a) x CROSS JOIN (SELECT CAST(j AS INT) AS j FROM ({rj}) b) y
LEFT JOIN (SELECT CAST(l_partkey % {nx} AS INT) AS i, CAST(l_suppkey % {ny} AS INT) AS j, avg(l_quantity) / 4e0 AS rough FROM {lineitem} GROUP BY 1, 2) l USING (i, j)"""


def spark_text(text: str, sf_dir: str) -> str:
    nx, ny = GRID[3:]
    names = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    return text.format(**names, one=0, two=1, ri=f"SELECT id AS i FROM range({nx})", rj=f"SELECT id AS j FROM range({ny})", nx=nx, ny=ny)


def duck_text(text: str) -> str:
    nx, ny = GRID[3:]
    return text.format(**{t: t for t in TABLES}, one=1, two=2, ri=f"SELECT range AS i FROM range({nx})", rj=f"SELECT range AS j FROM range({ny})", nx=nx, ny=ny)


def frame(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(spark_text(text, sf_dir))
