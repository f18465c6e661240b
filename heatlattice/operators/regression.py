"""Least squares by group: one aggregation for the second moments, then a few expressions a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A predictor whose part that the ones before it leave open is under this share of its variance adds nothing.
SINGULAR = 1e-10


def least_squares(rows: DataFrame, by: list[str], y: str, xs: list[str]) -> DataFrame:
    """by, n, intercept, b_<x> of every predictor and r2 of y on xs, a row for each group.

    The centred second moments of all columns are sums that each partition adds up by itself; their Cholesky factor,
    and the coefficients from it, are expressions over one row a group. Rows with a null among the columns are left out.
    A predictor that the ones before it determine gets 0. r2 is null where y does not vary. An empty table has no groups.
    """
    columns = [*xs, y]
    used = rows.dropna(subset=columns)
    moments = [F.covar_pop(a, b).alias(f"s_{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if j <= i]
    out = used.groupBy(*by).agg(F.count("*").alias("n"), *moments, *(F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)))
    s = lambda i, j: F.col(f"s_{max(i, j)}_{min(i, j)}")
    k = len(xs)

    def less(start: Column, terms: list[Column]) -> Column:
        for t in terms:
            start = start - t
        return start

    # the factor, row by row; the last row belongs to y, and what is left of its diagonal is the residual
    for i in range(k + 1):
        for j in range(min(i, k - 1) + 1 if i < k else k):
            rest = less(s(i, j), [F.col(f"l_{i}_{q}") * F.col(f"l_{j}_{q}") for q in range(j)])
            value = F.when(rest > SINGULAR * s(i, i), F.sqrt(rest)).otherwise(0.0) if i == j else F.when(F.col(f"l_{j}_{j}") > 0, rest / F.col(f"l_{j}_{j}")).otherwise(0.0)
            out = out.withColumn(f"l_{i}_{j}", value)
    for i in reversed(range(k)):
        rest = less(F.col(f"l_{k}_{i}"), [F.col(f"l_{q}_{i}") * F.col(f"b_{xs[q]}") for q in range(i + 1, k)])
        out = out.withColumn(f"b_{xs[i]}", F.when(F.col(f"l_{i}_{i}") > 0, rest / F.col(f"l_{i}_{i}")).otherwise(0.0))
    intercept = less(F.col(f"m_{k}"), [F.col(f"m_{i}") * F.col(f"b_{x}") for i, x in enumerate(xs)])
    explained = sum((F.col(f"l_{k}_{i}") * F.col(f"l_{k}_{i}") for i in range(k)), F.lit(0.0))
    return out.select(*by, "n", intercept.alias("intercept"), *(f"b_{x}" for x in xs), F.when(s(k, k) > 0, explained / s(k, k)).alias("r2"))
