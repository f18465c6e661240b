import random

import numpy as np
import pytest

from heatlattice.operators.regression import least_squares


def test_against_a_dense_solver(spark):
    rng = random.Random(4)
    rows = []
    for group in range(4):
        for _ in range(30):
            a, b, c = (rng.gauss(5, 2) for _ in range(3))
            rows.append((group, a, b, c if group else 2 * a - 3, 3 + 2 * a - b + (0.5 * c if group else 0) + rng.gauss(0, group)))
    rows += [(0, None, 1.0, 1.0, 1.0), (1, 1.0, 1.0, 1.0, None), (9, 1.0, 2.0, 3.0, 4.0), (8, 1.0, 2.0, 3.0, 4.0), (8, 2.0, 2.0, 3.0, 4.0)]
    table = spark.createDataFrame(rows, "g int, a double, b double, c double, y double")
    for xs in (["a"], ["a", "b"], ["a", "b", "c"]):
        out = {r.g: r for r in least_squares(table, ["g"], "y", xs).collect()}
        for group in range(4):
            own = np.array([[dict(zip("abcy", r[1:], strict=True))[c] for c in [*xs, "y"]] for r in rows if r[0] == group and None not in [dict(zip("abcy", r[1:], strict=True))[c] for c in [*xs, "y"]]])
            design, y = np.c_[np.ones(len(own)), own[:, :-1]], own[:, -1]
            fit = design @ np.linalg.lstsq(design, y, rcond=None)[0]
            assert out[group].n == len(own)
            assert out[group].r2 == pytest.approx(1 - ((y - fit) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-9)
            assert np.allclose(out[group].intercept + sum(own[:, i] * out[group][f"b_{x}"] for i, x in enumerate(xs)), fit)
        assert out[9].r2 is None and out[9].intercept == 4 and out[8].r2 is None
    assert least_squares(table.limit(0), ["g"], "y", ["a"]).collect() == []


def test_costs_compared(spark):
    from heatlattice.operators.designs import costs_compared

    a = spark.createDataFrame([(1, 1.0, 2.0), (2, 0.0, 4.0), (3, None, 1.0), (4, 1.0, 1.0), (6, None, 5.0)], "network_id long, x double, y double")
    b = spark.createDataFrame([(1, 1.0, 2.0 + 1e-12), (2, 0.0, 5.0), (3, 1.0, 1.0), (5, 1.0, 1.0), (6, None, 5.0)], "network_id long, x double, y double")
    out = {r.network_id: (r.gap, r.same) for r in costs_compared(a, b, ["x", "y"]).collect()}
    assert out == {1: (pytest.approx(5e-13, rel=1e-3), True), 2: (pytest.approx(0.2), False), 3: (None, False), 4: (None, False), 5: (None, False), 6: (0.0, True)}
