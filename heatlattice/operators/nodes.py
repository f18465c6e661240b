"""From cells to the nodes of a network."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heatlattice.operators.graph import KEY


def clustered(cells: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """cells (x, y) with the cluster of each, by MLlib's k-means; one centre a cluster follows by substations()."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    points = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(cells)
    return KMeans(k=k, seed=seed, initSteps=5).fit(points).transform(points).drop("features").withColumnRenamed("prediction", "cluster")


def substations(cells: DataFrame, demand_mwh: float, full_load_hours: float = 2000.0) -> DataFrame:
    """network_id, cluster, x, y, n_cells, demand_kw: each cluster's share of the demand by its cells."""
    groups = cells.groupBy(KEY, "cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n_cells"))
    share = F.col("n_cells") / F.sum("n_cells").over(Window.partitionBy(KEY))
    return groups.withColumn("demand_kw", share * demand_mwh * 1000.0 / full_load_hours)


def hub(cells: DataFrame, mode: str = "medoid") -> DataFrame:
    """network_id, x, y: the cell nearest to the mean of all cells (least id on ties), or that mean itself."""
    mean = cells.groupBy(KEY).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    if mode != "medoid":
        return mean.select(KEY, F.col("mx").alias("x"), F.col("my").alias("y"))
    gap = F.pow(F.col("x") - F.col("mx"), 2) + F.pow(F.col("y") - F.col("my"), 2)
    near = cells.join(mean, KEY).groupBy(KEY).agg(F.min_by(F.struct("x", "y"), F.struct(gap, "cell_id")).alias("p"))
    return near.select(KEY, "p.*")


def assembled(stations: DataFrame, centre: DataFrame) -> DataFrame:
    """network_id, node, x, y, demand_kw, n_cells: the hub first, with minus the sum of all demands."""
    place = F.row_number().over(Window.partitionBy(KEY).orderBy("cluster")).cast("long")
    rest = stations.select(KEY, place.alias("node"), "x", "y", "demand_kw", F.col("n_cells").cast("double").alias("n_cells"))
    totals = stations.groupBy(KEY).agg((-F.sum("demand_kw")).alias("demand_kw"))
    first = centre.join(totals, KEY).select(KEY, F.lit(0).cast("long").alias("node"), "x", "y", "demand_kw", F.lit(0.0).alias("n_cells"))
    return first.unionByName(rest)


def normalised(weights: DataFrame, total: float) -> DataFrame:
    """weights (network_id, node, weight) scaled so that each network sums to ``total``."""
    sums = F.sum("weight").over(Window.partitionBy(KEY))
    return weights.withColumn("demand", F.when(sums != 0, F.col("weight") / sums * total).otherwise(0.0))
