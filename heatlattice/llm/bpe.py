"""Byte-level BPE by overlapping chunk encoding.

A text of up to ``CHUNK + OVERLAP`` code points is encoded where it lies. A longer one is cut into chunks that overlap
by ``OVERLAP``; the chunks are dealt out over all tasks and pre-tokenised in parallel. A chunk begins in the middle of
a pre-token, but as soon as one of its boundaries is also a boundary of the chunk before it, the two agree from there
on, because the pattern looks back at nothing. Chunks are stitched at the first such boundary that has a blank behind it
and none before it. The pattern looks ahead, past a run of blanks, so a piece must not end with one: it is encoded by
itself, and its end is then the end of the text. And no pre-token has a blank behind another character, so such a place
is a boundary for the library too, whose classes of letters may be of another Unicode version. The pieces between
stitches are encoded in parallel; their ids, and the raw bytes they decode to, are hashed in order as they come, one
piece in memory at a time. A text in which two chunks share no such boundary (say, one huge run of letters) is encoded whole.

Null counts as the empty text: 0 tokens and the digests of nothing. Rows with equal long texts are encoded once and
each gets its row; every input row gives exactly one output row. Empty tables give empty results. Only the id and text
columns are read, so other columns can have any name.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatlattice.llm.common import id_and_text, map_rows
from heatlattice.storage import stored

CHUNK, OVERLAP = 32_768, 1_024
#: So many code points at a chunk's end may be cut short of what the pattern looks at.
MARGIN = 8

FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


@functools.lru_cache(maxsize=4)
def encoder(path: str, pattern: str):
    """The vocabulary at ``path``, loaded once in each Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def boundaries(pattern: str, text: str, first: int, last: int) -> list[int]:
    """Starts of pre-tokens in ``[first, last)`` of a text, those with a blank behind and none before."""
    import regex

    return [at for m in regex.compile(pattern).finditer(text) if first <= (at := m.start()) < last and at and blank(text[at]) and not text[at - 1].isspace()]


def blank(c: str) -> bool:
    """Whether the pattern takes a character as a blank; separators of files and fields are none there."""
    return c.isspace() and not "\x1c" <= c <= "\x1f"


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    base = id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))

    def whole(texts: list) -> list[list]:
        coder = encoder(path, pattern)
        out: list[list] = [[], [], []]
        for text in texts:
            ids = coder.encode_ordinary(text)
            out[0].append(len(ids))
            out[1].append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            out[2].append(hashlib.sha256(coder.decode_bytes(ids)).hexdigest())
        return out

    is_long = F.char_length("text") > chunk + overlap
    short = map_rows(base.filter(~is_long), "doc_id", FIELDS, whole)

    long = base.filter(is_long).withColumn("key", F.sha2("text", 256))
    texts = long.groupBy("key").agg(F.first("text").alias("text"))
    chunks = (
        texts.withColumn("length", F.char_length("text"))
        .withColumn("i", F.explode(F.expr(f"sequence(0, cast((length - 1) div {chunk} as int))")))
        .select("key", "i", "length", F.expr(f"substring(text, i * {chunk} + 1, {chunk + overlap})").alias("text"))
        .repartition("key", "i")
    )
    cuts = stitches(chunks, pattern, chunk, overlap)
    lost = cuts.filter("cut is null").select("key").distinct()
    starts = cuts.select("key", "i", F.col("cut").alias("start"))
    ends = cuts.select("key", (F.col("i") - 1).alias("i"), F.col("cut").alias("end"))
    pieces = (
        chunks.join(lost, "key", "left_anti")
        .join(starts, ["key", "i"], "left")
        .join(ends, ["key", "i"], "left")
        .withColumn("start", F.coalesce("start", F.lit(0)))
        .withColumn("end", F.coalesce("end", "length"))
        .select(F.struct("key", "i").alias("place"), F.expr(f"substring(text, start - i * {chunk} + 1, end - start)").alias("text"))
    )

    def parts(texts: list) -> list[list]:
        coder, out = encoder(path, pattern), [[], [], []]
        for text in texts:  # one text's list of ids at a time: it takes ten times the text's memory
            ids = coder.encode_ordinary(text)
            for column, value in zip(out, (len(ids), ",".join(map(str, ids)), coder.decode_bytes(ids)), strict=True):
                column.append(value)
        return out

    encoded = map_rows(pieces, "place", [T.StructField("n", T.LongType()), T.StructField("ids", T.StringType()), T.StructField("raw", T.BinaryType())], parts)
    in_order = encoded.filter("n > 0").select("place.key", "place.i", "n", "ids", "raw").repartition("key").sortWithinPartitions("key", "i")
    joined = in_order.mapInArrow(hashed, T.StructType([T.StructField("key", T.StringType()), *FIELDS]))
    unsynced = map_rows(texts.join(lost, "key", "left_semi"), "key", FIELDS, whole)
    by_key = joined.unionByName(unsynced)
    return short.unionByName(long.select("doc_id", "key").join(by_key, "key").drop("key"))


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, count and digests of the parts of each key, which come in order."""
    parts = (row for batch in batches for at in range(0, batch.num_rows, 16) for row in batch.slice(at, 16).to_pylist())
    for key, of_key in itertools.groupby(parts, key=lambda r: r["key"]):
        n, ids, raw = 0, hashlib.sha256(), hashlib.sha256()
        for part in of_key:
            ids.update(("," if n else "").encode() + part["ids"].encode())
            raw.update(part["raw"])
            n += part["n"]
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([n], pa.int64()), pa.array([ids.hexdigest()]), pa.array([raw.hexdigest()])], names=["key", *(f.name for f in FIELDS)])


def stitches(chunks: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """key, i (from 1) and cut: the first boundary that chunk i shares with the one before it, or null."""

    def zones(texts: list) -> list[list]:
        left = [boundaries(pattern, text, 0, overlap - MARGIN) for text in texts]
        right = [boundaries(pattern, text, chunk, len(text) - MARGIN) if len(text) > chunk else [] for text in texts]
        return [left, [[at - chunk for at in x] for x in right]]

    ints = T.ArrayType(T.IntegerType())
    found = map_rows(chunks.select(F.struct("key", "i").alias("place"), "text"), "place", [T.StructField("left", ints), T.StructField("right", ints)], zones)
    found = stored(found.select("place.key", "place.i", "left", "right"))
    before = found.select("key", (F.col("i") + 1).alias("i"), "right")
    shared = F.array_min(F.array_intersect("left", "right"))
    return found.filter("i > 0").select("key", "i", "left").join(before, ["key", "i"]).select("key", "i", (F.col("i") * chunk + shared).cast("int").alias("cut"))
