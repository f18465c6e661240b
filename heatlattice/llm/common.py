"""What the operators of this subpackage share: reading tables, counting words, sampling, mapping texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatlattice.storage import stored

#: A word, as all operators of this subpackage count them.
WORD = r"[^\x20\x09-\x0D]+"

#: A table of at most so many rows may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checked_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that are used, so that no other column of the input can clash with an own one."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores in front until no column is called so."""
    low = {c.lower() for c in taken}
    while name in low:
        name = f"_{name}"
    return name


def quoted(names: list[str]) -> list[str]:
    """Names of columns as select() takes them, whatever characters they have."""
    return [f"`{c.replace('`', '``')}`" for c in names]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def map_rows(df: DataFrame, keep: str, columns: list[T.StructField], rows: Callable[[list], list[list]]) -> DataFrame:
    """Column ``keep`` as it is, and the columns that ``rows`` makes of the values of ``text``, batch by batch.

    ``rows`` gets a list of texts (None possible) and returns one list of values for each of ``columns``.
    """
    kept = T.StructField(keep, df.schema[keep].dataType)
    schema = T.StructType([kept, *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [_arrow(c.dataType) for c in columns]
        for batch in batches:
            for part in _slices(batch):
                values = rows(part.column("text").to_pylist())
                arrays = [part.column(keep), *(pa.array(v, k) for v, k in zip(values, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(keep, "text").mapInArrow(run, schema)


def keep_rows(df: DataFrame, text_col: str, keeps: Callable[[list], list[bool]]) -> DataFrame:
    """The rows of df whose texts ``keeps`` accepts, with all columns."""

    names = [f"c{i}" for i in range(len(df.columns))]  # a map's columns are named without quotes
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                yield part.filter(pa.array(keeps(part.column(at).to_pylist()), pa.bool_()))

    plain = df.toDF(*names)
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def _slices(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def hash_sample(rows: DataFrame, by: str, per: int, seed: int, key: str = "doc_id") -> DataFrame:
    """At most ``per`` rows of each value of ``by``, those with the least seeded ``digest`` (0 to 1) of ``key``; the same in every run.

    Counts come first, so that of a value with n rows only those under about per / n are ranked, hardly more than ``per``.
    """
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    counts = stored(rows.groupBy(by).agg(F.count("*").alias("in_all")))
    drawn = rows.withColumn("digest", digest).join(checked_broadcast(counts, counts.count()), by)
    near = drawn.filter(F.col("digest") * F.col("in_all") < per + 8 * per**0.5 + 40)
    return near.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("digest", key))).filter(F.col("place") <= per).drop("in_all", "place")


def whole_texts(sample: DataFrame, by: str, chars: int, ties: list[str]) -> list[Row]:
    """The rows of a hash_sample() with their whole texts: of each value of ``by``, by digest, as many as have ``chars`` code points together."""
    upto = F.sum(F.char_length("text").cast("long")).over(Window.partitionBy(by).orderBy("digest", *ties))  # over the sample only
    return stored(sample).withColumn("upto", upto).filter(F.col("upto") <= chars).drop("upto").orderBy("digest", *ties).collect()
