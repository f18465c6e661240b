import random

import pytest

from heatlattice.llm import hamming


def code(v):
    return [i < len(v) and v[i] is not None and v[i] > 0 for i in range(1024)]


def brute(rows, k, every):
    known = {(i, tuple(code(v))) for i, v in rows if i is not None and v is not None}
    out = []
    for q, a in known:
        if q % every == 0:
            near = sorted((sum(x != y for x, y in zip(a, b, strict=True)), i) for i, b in known if i != q)
            out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near[:k])]
    return sorted(out)


def run(spark, rows, k, every):
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, code int, segment int")
    return sorted(map(tuple, hamming.search(table, k=k, every=every).collect()))


def test_against_brute_force(spark):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(4)]
    rows = [(i, [x + rng.gauss(0, 0.4) for x in rng.choice(centres)]) for i in range(300)]
    rows += [(1000 + i, centres[0]) for i in range(60)]  # one common vector
    rows += [(5, rows[5][1]), (2000, None), (None, centres[1]), (2010, [1.0]), (2020, []), (2030, [None, 1.0] * 32)]
    assert run(spark, rows, 5, 20) == brute(rows, 5, 20)


@pytest.mark.parametrize("size", [10, 96, 1000])
def test_vectors_of_any_length(spark, size):
    rng = random.Random(size)
    centres = [[rng.choice((-1.0, 1.0)) for _ in range(size)] for _ in range(3)]
    rows = [(i, [-x if rng.random() < 0.04 else x for x in rng.choice(centres)]) for i in range(90)]
    rows += [(200, centres[0][: size // 2]), (201, [1.0])]  # shorter ones in the same table
    assert run(spark, rows, 4, 10) == brute(rows, 4, 10)


def test_few_and_no_rows(spark):
    rows = [(0, [1.0] * 64), (1, [-1.0] * 64), (2, [1.0] * 32 + [-1.0] * 32)]
    assert run(spark, rows, 10, 100) == brute(rows, 10, 100)
    assert run(spark, [], 10, 100) == []
