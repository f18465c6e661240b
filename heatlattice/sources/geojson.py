"""District files: GeoJSON feature collections, one or many, as rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """features array<struct<properties: struct<ID string, GEN string, LAN string, area double, DH_demand double,
  DH_supplied_households double, DH_cells string>>>"""


def districts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """ident, name, state, area_km2, dh_demand_mwh, households, cells, file and place of every feature of one or more files or globs.

    DH_cells may be a list or its JSON text; a null number of households counts as 0; unreadable cells are null.
    """
    p = F.col("f.properties")
    rows = spark.read.schema(SCHEMA).json(paths, multiLine=True).select(F.input_file_name().alias("file"), F.posexplode("features").alias("place", "f"))
    cells = F.from_json(p["DH_cells"], "array<array<double>>")
    points = F.transform(cells, lambda c: F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y")))
    return rows.select(
        p["ID"].alias("ident"), p["GEN"].alias("name"), p["LAN"].alias("state"), p["area"].alias("area_km2"), p["DH_demand"].alias("dh_demand_mwh"),
        F.coalesce(p["DH_supplied_households"], F.lit(0.0)).cast("int").alias("households"), points.alias("cells"), "file", "place",
    )


def by_ident(rows: DataFrame) -> DataFrame:
    """One row an ident: the last one, by file name and place in the file."""
    last = F.max_by(F.struct("name", "state", "area_km2", "dh_demand_mwh", "households", "cells"), F.struct("file", "place"))
    return rows.groupBy("ident").agg(last.alias("d")).select("ident", "d.*")


def cells(rows: DataFrame) -> DataFrame:
    """ident, cell_id, x, y."""
    return rows.select("ident", F.posexplode("cells").alias("cell_id", "c")).select("ident", "cell_id", "c.x", "c.y")


def grid(spark: SparkSession, x: tuple[float, float], y: tuple[float, float], step: float = 100.0, margin: float = 500.0) -> DataFrame:
    """i, j, x, y of the elevation grid around an extent; its z comes by a join with a table of elevations."""
    x0, y0 = x[0] - margin, y[0] - margin
    nx, ny = (math.ceil((high - low + 2 * margin) / step) + 1 for low, high in (x, y))
    return spark.range(nx * ny).select((F.col("id") % nx).cast("int").alias("i"), F.floor(F.col("id") / nx).cast("int").alias("j")).withColumn("x", x0 + F.col("i") * step).withColumn("y", y0 + F.col("j") * step)


def write_results(df: DataFrame, path: str, form: str = "json") -> None:
    """A result table as JSON lines or Parquet."""
    df.write.mode("overwrite").format(form).save(path)
