"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Sources, in code point order with null last, weigh 1, 2, 3, repeating, and share the words of the whole corpus. A
source stops at ``epochs`` times its own words; what it leaves over is reshared by weight among the others until no
source is above its limit. The limit is tested in whole numbers, so that the rounds end at the exact fixed point.

A source whose target is k whole times its words and a rest takes every document k times; the rest is taken from its
documents in a seeded order (md5 of seed and id), up to the document whose middle would pass the rest. So each
source ends within half a document of its target, and reruns agree. The order is never sorted as a whole: documents
fall into 4,096 buckets by the start of the digest, whose sums show the one bucket in which a source's rest ends.

Null text has size 0; a null source is a source of its own; rows without words take 0. Rows repeated in full are rows
of their own: the sum they take is defined, which of the equal rows takes it is not told apart. Rows of one id and
different texts come in the order of their sizes. An empty table gives an empty result. Only id, text and source
columns are read, so other columns can have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatlattice.llm.common import checked_broadcast, n_words, quoted
from heatlattice.storage import stored

EPOCHS, SEED, BUCKET_DIGITS = 3, 17, 3


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> list[Column]:
    """doc_id, source, size and the seeded place h of each row."""
    key = docs[id_col]
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return [key.alias("doc_id"), docs[source_col].alias("source"), n_words(docs[text_col].cast("string")).alias("size"), place.alias("h")]


def ranked(sources: DataFrame) -> DataFrame:
    """sources with weight, by a global order that no single task has to see: range partitions and their offsets."""
    place, within = F.spark_partition_id(), F.monotonically_increasing_id()
    ordered = stored(sources.orderBy(F.asc_nulls_last("source")).withColumn("p", place).withColumn("k", within.bitwiseAND(F.lit((1 << 33) - 1))))
    counts = ordered.groupBy("p").agg(F.count("*").alias("c"))
    offsets = counts.select("p", F.coalesce(F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    return ordered.join(F.broadcast(offsets), "p").withColumn("weight", ((F.col("offset") + F.col("k")) % 3 + 1).cast("long")).drop("p", "k", "offset")


def targets(sources: DataFrame, epochs: int = EPOCHS) -> tuple[DataFrame, int]:
    """source, source_size and target of each source, and how many sources there are."""
    weighted = stored(ranked(sources))
    total, weight, n = weighted.agg(F.sum("source_size"), F.sum("weight"), F.count("*")).first()
    total, weight, rest = total or 0, weight or 1, total or 0
    big = lambda c: F.col(c).cast("decimal(38,0)")
    seen = 0
    while True:
        above = big("source_size") * F.lit(epochs * weight).cast("decimal(19,0)") < big("weight") * F.lit(rest).cast("decimal(19,0)")
        row = weighted.filter(above).agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if row[0] == seen:
            break
        seen, rest, weight = row[0], total - epochs * row[1], (weighted.agg(F.sum("weight")).first()[0] - row[2]) or 1
    share = (F.lit(rest) * F.col("weight")).cast("double") / F.lit(float(weight))
    return weighted.select("source", "source_size", F.when(above, (F.col("source_size") * epochs).cast("double")).otherwise(share).alias("target")), n


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, repeats (how many times the mix has the document), source of each row."""
    rows = stored(docs.select(*sized(docs, id_col, text_col, source_col, seed)))
    return decided(rows, *planned(rows, epochs)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats", "source")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """docs, each row as many times as the mix has it."""
    own = sized(docs, id_col, text_col, source_col, seed)
    plan = planned(stored(docs.select(*own)), epochs)
    out = decided(docs.select(*own, F.struct(*quoted(docs.columns)).alias("row")), *plan)
    return out.filter("repeats > 0").withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select("row.*")


def planned(rows: DataFrame, epochs: int) -> tuple[DataFrame, int]:
    """Of each source (s): source_size, target, whole repetitions, rest, and the bucket and the words where the rest ends."""
    sources, n = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = sources.withColumn("whole", whole.cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))

    # the one bucket of each source in which its rest ends, and the words in the buckets before it
    buckets = rows.groupBy("source", F.substring("h", 1, BUCKET_DIGITS).alias("bucket")).agg(F.sum("size").alias("words"))
    w = Window.partitionBy("source").orderBy("bucket")
    upto = buckets.withColumn("upto", F.sum("words").over(w)).withColumnRenamed("source", "s")
    ends = upto.join(checked_broadcast(plan.select("source", "rest"), n), upto.s.eqNullSafe(plan.source)).filter("upto > rest")
    ends = ends.groupBy("s").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("e"))
    plan = plan.join(ends, plan.source.eqNullSafe(ends.s), "left").select("source", "source_size", "target", "whole", "rest", F.col("e.bucket").alias("end"), F.col("e.before").alias("before"))
    return stored(plan).withColumnRenamed("source", "s"), n


def decided(rows: DataFrame, plan: DataFrame, n: int) -> DataFrame:
    """rows with their source's plan and repeats."""
    all_rows = rows.withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS)).join(checked_broadcast(plan, n), rows.source.eqNullSafe(F.col("s")), "left")
    at = Window.partitionBy("source").orderBy("h", "doc_id", "size")
    inside = all_rows.filter("bucket = end").withColumn("start", F.sum("size").over(at.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size") + F.col("before"))
    inside = inside.withColumn("more", (F.col("start") + F.col("size") / 2.0 <= F.col("rest")).cast("long")).drop("start")
    outside = all_rows.filter("end is null or bucket <> end").withColumn("more", F.when(F.col("end").isNull() | (F.col("bucket") < F.col("end")), (F.col("rest") > 0).cast("long")).otherwise(F.lit(0)).cast("long"))
    return inside.unionByName(outside).withColumn("repeats", F.col("whole") + F.when(F.col("size") > 0, F.col("more")).otherwise(0))


#: The same rows in plain SQL, with the water level found by running sums instead of rounds.
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
                  md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
o AS (SELECT *, {EPOCHS}.0 * source_size / weight AS level, sum(source_size) OVER () AS total,
             coalesce(sum(source_size) OVER w, 0) AS size_before, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weight_left
      FROM s WINDOW w AS (ORDER BY {EPOCHS}.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, {EPOCHS} * source_size * weight_left < weight * (total - {EPOCHS} * size_before) AS capped FROM o),
r AS (SELECT max(total) - {EPOCHS} * coalesce(sum(source_size) FILTER (capped), 0) AS rest, sum(weight) FILTER (NOT capped) AS weight FROM c),
t AS (SELECT source, source_size, CASE WHEN capped THEN ({EPOCHS} * source_size)::DOUBLE ELSE (r.rest * c.weight)::DOUBLE / r.weight::DOUBLE END AS target FROM c, r),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
m AS (SELECT d.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS extra,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
f AS (SELECT *, whole + CASE WHEN size > 0 AND extra > 0 AND start + size / 2.0 <= extra THEN 1 ELSE 0 END AS repeats FROM m)
SELECT doc_id, size, source_size, target, (size * repeats)::BIGINT AS taken, repeats::BIGINT AS repeats, source FROM f
"""
