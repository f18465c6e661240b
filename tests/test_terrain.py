import math
import random

import pytest

from heatlattice.operators import terrain


def height(i, j):
    return (i * 7 + j * 13) % 29 + i / 8


def bilinear(x, y, x0, y0, step, nx, ny):
    fi, fj = (min(max((c - at) / step, 0.0), n - 1.0001) for c, at, n in ((x, x0, nx), (y, y0, ny)))
    i, j = math.floor(fi), math.floor(fj)
    a, b = fi - i, fj - j
    return height(i, j) * (1 - a) * (1 - b) + height(i + 1, j) * a * (1 - b) + height(i, j + 1) * (1 - a) * b + height(i + 1, j + 1) * a * b


@pytest.mark.parametrize("most", [0, 1 << 30])
@pytest.mark.parametrize(("nx", "ny"), [(2, 2), (32, 33), (33, 34), (65, 41)])
def test_tiles_give_the_same_heights(spark, monkeypatch, most, nx, ny):
    monkeypatch.setattr(terrain, "BROADCAST_BYTES", most)
    rng = random.Random(nx)
    grid = (10.0, -20.0, 25.0, nx, ny)
    points = [(k, rng.uniform(-200, 25 * nx + 200), rng.uniform(-200, 25 * ny + 200)) for k in range(300)]
    points += [(1000 + 40 * i + j, 10.0 + 25 * i, -20.0 + 25 * j) for i in range(min(nx, 40)) for j in range(min(ny, 40))]
    dem = spark.createDataFrame([(i, j, height(i, j)) for i in range(nx) for j in range(ny)], "i int, j int, z double")
    out = terrain.sampled(spark.createDataFrame(points, "k int, x double, y double"), dem, *grid).collect()
    assert {r.k: r.z for r in out} == pytest.approx({k: bilinear(x, y, *grid) for k, x, y in points})


def test_a_grid_of_100_million_cells_is_not_broadcast(spark):
    n = 10_000
    dem = spark.range(n * n).selectExpr(f"cast(id div {n} as int) AS i", f"cast(id % {n} as int) AS j", "sin(id) AS z")
    points = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    text = terrain.sampled(points, dem, 0.0, 0.0, 25.0, n, n)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in text and "Generate explode" in text
    assert text.count("Aggregate") == 1  # the tiles alone are gathered
