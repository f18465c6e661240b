"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has a bit for each of its elements: whether it is above 0. The longest vector says how many 64-bit words
a code has. Codes are cut into segments of ``WIDTH`` bits, m in all, and an index lists the distinct codes by each
segment's value. The first round probes, for every query, all segment values at up to 1 flipped bit; round r, for every
query that is not settled, those at exactly r. A code within m * (r + 1) - 1 bits of the query has some segment
within r, so after round r all codes up to that distance have been verified, and a query whose kth verified distance
is no greater is settled. A first bound on the kth distance, from a fixed sample of ``SAMPLE`` codes, and then the kth
distance of the last round, keep the join from putting out codes that cannot matter.

Codes are indexed once, with the k + 1 least ids of each, which is all that a top-k by (distance, id) can need of
equal codes; so a vector that fills a third of the table is one entry. Probes meet the index in an equi-join.

A null vector, or a null id, has no code and is neither searched nor found; missing and null elements are zeros. A
query does not find itself. Rows repeated count once. Ties go to the least id. With fewer than k other rows, all are
found. An empty table gives an empty result. Only the id and vector columns are read, so other columns can have any name.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatlattice.storage import stored

WORD, WIDTH, K, SAMPLE, EVERY = 64, 16, 10, 1024, 100


def codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id and code (a struct of 64-bit words) of every row, and how many words a code has."""
    own = vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].alias("v")).filter("vec_id is not null and v is not null")
    words = max(1, -(-(own.agg(F.max(F.size("v"))).first()[0] or 1) // WORD))
    bits = lambda w: f"aggregate(sequence(0, {WORD - 1}), 0L, (a, i) -> a | if(get(v, i + {w * WORD}) > 0, shiftleft(1L, i), 0L))"
    return own.select("vec_id", F.struct(*(F.expr(bits(w)).alias(f"w{w}") for w in range(words))).alias("code")).distinct(), words


def distance(a: Column, b: Column, words: int) -> Column:
    return functools.reduce(operator.add, (F.bit_count(a[f"w{w}"].bitwiseXOR(b[f"w{w}"])) for w in range(words)))


def segments(code: str, words: int) -> Column:
    value = lambda w, s: F.shiftrightunsigned(F.col(code)[f"w{w}"], s * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")
    places = [(w, s) for w in range(words) for s in range(WORD // WIDTH)]
    return F.explode(F.array(*(F.struct(F.lit(i).alias("segment"), value(*at).alias("value")) for i, at in enumerate(places))))


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, distance: the k nearest other rows of every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows, words = codes(vectors, id_col, vector_col)
    rows, parts = stored(rows), words * WORD // WIDTH
    least = Window.partitionBy("code").orderBy("vec_id")
    entries = stored(rows.withColumn("n", F.row_number().over(least)).filter(F.col("n") <= k + 1).drop("n"))
    index = stored(entries.select("code").distinct().withColumn("at", segments("code", words)).select("at.segment", "at.value", "code"))

    # a bound on the kth distance: that of the sample (one row), without one code that may be the query's own
    sample = entries.select("code").distinct().orderBy(F.xxhash64("code"), "code").limit(SAMPLE).agg(F.collect_list("code").alias("known"))
    spans = F.array_sort(F.transform("known", lambda c: distance(c, F.col("q"), words)))
    queries = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("code").alias("q"))
    active = stored(queries.join(F.broadcast(sample)).select("query_id", "q", F.coalesce(F.get(spans, F.lit(k)), F.lit(words * WORD)).alias("bound")))
    best = settled = None
    kinds = f"query_id {dict(rows.dtypes)['vec_id']}, vec_id {dict(rows.dtypes)['vec_id']}, distance int, rank int"
    for r in range(1, WIDTH + 1):
        masks = spark.range(1 << WIDTH).select(F.col("id").cast("int").alias("mask")).filter(F.bit_count("mask") == r)
        mine = active.withColumn("at", segments("q", words)).select("query_id", "q", "bound", "at.segment", "at.value")
        flips = [m for m in range(1 << WIDTH) if m.bit_count() == r or (r == 1 and m == 0)] if r <= 3 else None
        if flips is not None:
            probes = mine.withColumn("mask", F.explode(F.array(*map(F.lit, flips))))
        else:
            gathered = masks.agg(F.collect_list("mask").alias("masks"))  # one row of at most C(16, 8) masks
            probes = mine.join(F.broadcast(gathered)).withColumn("mask", F.explode("masks")).drop("masks")
        probes = probes.select("query_id", "q", "bound", "segment", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
        # probes are many more than their estimate says: never broadcast them
        near = index.join(probes.hint("merge"), [index.segment == probes.segment, index.value == probes.value, distance(F.col("code"), F.col("q"), words) <= F.col("bound")])
        near = near.select("query_id", "code", distance(F.col("code"), F.col("q"), words).alias("distance")).distinct()
        found = near.join(entries, "code").filter("vec_id <> query_id").select("query_id", "vec_id", "distance")
        found = found if best is None else found.unionByName(best.select("query_id", "vec_id", "distance")).distinct()
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
        best = stored(found.withColumn("rank", place).filter(F.col("rank") <= k))
        kth = best.filter(F.col("rank") == k).select("query_id", F.col("distance").alias("kth"))
        state = active.join(kth, "query_id", "left").withColumn("bound", F.least("bound", F.coalesce("kth", "bound")))
        covered = parts * (r + 1) - 1
        over = (F.col("kth") <= covered) if r < WIDTH else F.lit(True)
        state = stored(state.withColumn("over", F.coalesce(over, F.lit(False))).drop("kth"))
        done = best.join(state.filter("over").select("query_id"), "query_id", "left_semi").select("query_id", "vec_id", "distance", "rank")
        settled = done if settled is None else settled.unionByName(done)
        active = state.filter("not over").drop("over")
        best = best.join(active.select("query_id"), "query_id", "left_semi")
        if active.isEmpty():
            break
    settled = settled if settled is not None else spark.createDataFrame([], kinds)
    return settled.select("query_id", "rank", "vec_id", "distance")


ORACLE_SQL = f"""
WITH c AS (SELECT DISTINCT vec_id, list_transform(range(1, most + 1), lambda i: coalesce(embedding[i] > 0, false)) AS b
           FROM embeddings, (SELECT coalesce(max(len(embedding)), 0) AS most FROM embeddings) WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, e.vec_id, list_sum(list_transform(range(1, len(q.b) + 1), lambda i: (q.b[i] <> e.b[i])::INTEGER))::INTEGER AS distance
      FROM c q JOIN c e ON q.vec_id % {EVERY} = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank, vec_id, distance FROM p)
SELECT * FROM r WHERE rank <= {K}
"""
