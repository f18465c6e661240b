"""Importance resampling towards a target distribution of text.

1. Features (runs of 1 to ``most`` words) of all texts are counted by hashed bucket, in each partition first; likewise
   those of all target texts. The counts are ``buckets`` rows at most. They give an array of gains, one a bucket.
2. Each text is scored with the array: its weight is the floored mean gain of its features, and its score adds a Gumbel
   number made of its id, so that the highest scores are a draw without replacement in proportion to exp(weight / 1000).
3. Eligible rows that can be drawn are sorted within their partitions. Such a run is cut into blocks, each within one
   range of scores. The ranges come from the exact count of rows at every score, so the rank at which a range begins is
   known, and the ranges below the last draw are never sorted or shuffled.
4. A task merges the runs of a range by a tournament tree. It takes the blocks in the order of their first entries, the
   order in which the merge needs them, so it holds one block of each run at most, whatever the range holds. It stops
   after the exact count of draws and puts out ranks.

Scores are whole numbers within the logarithms of 64-bit counts, times 1000: some hundred thousand values at most, which
is what the driver sees. Ties go to the smaller id (null last), then to fewer features; rows equal in all are the same.

A null text has no words. A null id counts as the empty string in the Gumbel number. Repeated rows are drawn each by
itself. Every input row gives one row. Without target texts every word counts as absent from them; an empty table gives
an empty result. Only the id and text columns are read, so other columns can have any name.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatlattice.llm.common import _arrow, id_and_text, map_rows
from heatlattice.storage import stored

MOST, BUCKETS, SCALE, SEED = 1, 10_000, 1000, "2024"
LEAST_WORDS, NUM, DEN = 20, 10, 100
#: Rows of a range, but for those that share its last score; entries of a block.
RANGE_ROWS, BLOCK = 1 << 18, 256

#: A-Z in lower case; every other ASCII character but digits and a-z parts words.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


class Buckets(dict):
    """Buckets of features, kept until there are too many."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[feature] = out = zlib.crc32(feature) % self.buckets
        return out


def hashed(text: str | None, most: int, of: Buckets) -> tuple[int, np.ndarray]:
    """How many words a text has, and the buckets of its features."""
    words = (text or "").encode().translate(FOLD).split(b" ")
    words = [w for w in words if w]
    runs = itertools.chain(words, *(map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)) for n in range(2, most + 1)))
    found = sum(max(0, len(words) - n + 1) for n in range(1, most + 1))
    return len(words), np.fromiter(map(of.__getitem__, runs), dtype=np.int64, count=found)


def counts(texts: DataFrame, text_col: str = "text", most: int = MOST, buckets: int = BUCKETS) -> np.ndarray:
    """Features by bucket in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = Buckets(buckets), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += np.bincount(hashed(text, most, of)[1], minlength=buckets)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int64()), pa.array(total[filled], pa.int64())], names=["bucket", "n"])

    rows = texts.select(texts[text_col].cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():  # as many rows as buckets at most
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """What a feature of each bucket adds: its smoothed log ratio, in whole parts of ``scale``."""
    buckets = len(source)
    up = (target + 1.0) * float(source.sum() + buckets)
    down = (source + 1.0) * float(target.sum() + buckets)
    return np.array([math.floor(scale * math.log(x)) for x in up / down], dtype=np.int64)


def gumbel(doc_id: object, seed: str = SEED, scale: int = SCALE) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-scale * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""
    base = id_and_text(docs, id_col, text_col)

    def weighed(texts: list) -> list[list]:
        of, out = Buckets(len(gain)), []
        for text in texts:
            n, at = hashed(text, most, of)
            out.append((n, len(at), int(gain[at].sum()) // len(at) if len(at) else 0))
        return [list(x) for x in zip(*out, strict=True)] if out else [[], [], []]

    rows = map_rows(base, "doc_id", [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")], weighed)

    def noise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            extra = pa.array([gumbel(x, seed) for x in batch.column("doc_id").to_pylist()], pa.int64())
            score = pa.array(batch.column("weight").to_numpy() + extra.to_numpy(), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*batch.schema.names, "score"])

    return rows.mapInArrow(noise, T.StructType([*rows.schema.fields, T.StructField("score", T.LongType())]))


class Tournament:
    """A tournament tree over the next entries of runs; the least entry wins."""

    def __init__(self) -> None:
        self.size, self.entry, self.winner = 1, [None], [0, 0]

    def better(self, a: int, b: int) -> int:
        x, y = self.entry[a], self.entry[b]
        return b if x is None or (y is not None and y < x) else a

    def put(self, run: int, entry: tuple | None) -> None:
        """The next entry of a run, None at its end; only the matches on its way up are played again."""
        if run >= self.size:
            while run >= self.size:
                self.size *= 2
            self.entry += [None] * (self.size - len(self.entry))
            self.winner = [0] * self.size + list(range(self.size))
            for node in range(self.size - 1, 0, -1):
                self.winner[node] = self.better(self.winner[2 * node], self.winner[2 * node + 1])
        self.entry[run] = entry
        node = (run + self.size) // 2
        while node:
            self.winner[node] = self.better(self.winner[2 * node], self.winner[2 * node + 1])
            node //= 2

    def first(self) -> tuple[int, tuple | None]:
        run = self.winner[1]
        return run, self.entry[run]


#: A block of a run: its range, the partition the run lies in, its first entry, and its entries in order.
BLOCKS = "range int, run int, head_score long, head_null boolean, head_id {id}, head_n long, ids array<{id}>, features array<long>, weights array<long>, scores array<long>"


def entries(block: dict) -> Iterator[tuple]:
    """Entries in the order of the draw: highest score, least id, null ids last, fewest features."""
    for i, n, w, s in zip(block["ids"], block["features"], block["weights"], block["scores"], strict=True):
        yield -s, i is None, i if i is not None else 0, n, w


def merged(blocks: Iterator[dict], take: int) -> Iterator[tuple]:
    """Entries and places (from 0) of a range's runs until ``take``, and then the rest, without places or order.

    ``blocks`` come by their first entries. The next one joins the tournament as soon as its first entry may win, when
    all entries of its run's blocks before have left.
    """
    tree, slots, now, place = Tournament(), {}, {}, 0
    coming = next(blocks, None)
    while place < take:
        run, least = tree.first()
        while coming is not None and (least is None or not least < next(entries(coming))):
            at = slots.setdefault(coming["run"], len(slots))
            now[at] = itertools.chain(now.get(at, ()), entries(coming))
            if tree.size <= at or tree.entry[at] is None:  # else entries equal to the block's first are still to leave
                tree.put(at, next(now[at]))
            coming = next(blocks, None)
            run, least = tree.first()
        if least is None:
            return
        yield least, place
        place += 1
        tree.put(run, next(now[run], None))
    for at, rest in now.items():
        if tree.entry[at] is not None:
            yield tree.entry[at], None
            yield from ((e, None) for e in rest)
    while coming is not None:
        yield from ((e, None) for e in entries(coming))
        coming = next(blocks, None)


def ranges(histogram: list[tuple[int, int]], draws: int, rows: int) -> list[tuple[int, int, int]]:
    """Lowest score, rows before and draws of each range of scores from the highest on, until all draws are in one."""
    out, before, held = [], 0, 0
    for score, n in sorted(histogram, reverse=True):
        if before >= draws:
            break
        held += n
        if held >= rows or before + held >= draws:
            out.append((score, before, min(held, draws - before)))
            before, held = before + held, 0
    return out


def drawn(scored: DataFrame, num: int = NUM, den: int = DEN, least_words: int = LEAST_WORDS, rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of a stored scores() table; rank is null if it is not drawn."""
    can = F.col("n_words") >= least_words
    histogram = [(r[0], r[1]) for r in scored.filter(can).groupBy("score").count().collect()]  # a row a score
    draws = num * sum(n for _, n in histogram) // den
    cut = ranges(histogram, draws, rows)
    columns = ["doc_id", "n_features", "weight", "score"]
    if not cut:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    lowest = cut[-1][0]
    ends = np.array([-low for low, _, _ in cut])
    schema = T._parse_datatype_string(BLOCKS.format(id=dict(scored.dtypes)["doc_id"]))
    arrow = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in schema])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sorted rows of a partition, in blocks that end at the ends of ranges."""
        from pyspark import TaskContext

        run = TaskContext.get().partitionId()
        for batch in batches:
            score = batch.column("score").to_numpy()
            of = np.searchsorted(ends, -score)
            starts = np.unique(np.r_[np.arange(0, len(score), BLOCK), np.flatnonzero(np.diff(of)) + 1])
            out = []
            for a, b in itertools.pairwise([*starts.tolist(), len(score)]):
                part = batch.slice(a, b - a)
                ids, n, w, s = (part.column(c).to_pylist() for c in columns)
                out.append({"range": int(of[a]), "run": run, "head_score": s[0], "head_null": ids[0] is None, "head_id": ids[0], "head_n": n[0], "ids": ids, "features": n, "weights": w, "scores": s})
            yield pa.RecordBatch.from_pylist(out, arrow)

    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    runs = scored.filter(can & (F.col("score") >= lowest)).select(*columns).sortWithinPartitions(*order).mapInArrow(blocks, schema)
    heads = ["range", F.desc("head_score"), "head_null", "head_id", "head_n"]
    dealt = runs.repartition("range").sortWithinPartitions(*heads)
    result = T.StructType([*(scored.schema[c] for c in columns), T.StructField("rank", T.LongType())])
    made = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in result])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for at in range(0, batch.num_rows, 64) for row in batch.slice(at, 64).to_pylist())
        for number, of_range in itertools.groupby(rows, key=lambda r: r["range"]):
            _, before, take = cut[number]
            ranked = ((None if null else i, n, w, -s, None if place is None else before + place + 1) for (s, null, i, n, w), place in merged(of_range, take))
            while part := list(itertools.islice(ranked, 4096)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), made, strict=True)], schema=made)

    rest = scored.filter(~(can & (F.col("score") >= lowest))).select(*columns, F.lit(None).cast("long").alias("rank"))
    return dealt.mapInArrow(merge, result).unionByName(rest)


def resample(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", most: int = MOST, buckets: int = BUCKETS, seed: str = SEED, num: int = NUM, den: int = DEN, least_words: int = LEAST_WORDS, rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; rank 1 is the highest score, null is not drawn."""
    gain = gains(counts(docs, text_col, most, buckets), counts(targets, target_col, most, buckets))
    return drawn(stored(scores(docs, gain, id_col, text_col, most, seed)), num, den, least_words, rows)


def oracle_sql(buckets: int = BUCKETS, scale: int = SCALE, seed: str = SEED, num: int = NUM, den: int = DEN, least_words: int = LEAST_WORDS) -> str:
    """The same rows in SQL for runs of one word. The checksum goes by half bytes, over the distinct words."""
    half = []
    for i in range(16):  # the remainder of a half byte: four steps of the reflected polynomial
        c = i
        for _ in range(4):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        half.append(c)
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    nibbles = "flatten(list_transform(range(0, octet_length(encode(w))), lambda i: [strpos('0123456789ABCDEF', hex(encode(w))[2 * i + 2]) - 1, strpos('0123456789ABCDEF', hex(encode(w))[2 * i + 1]) - 1]))"
    step = f"lambda c, b: xor(c >> 4, {half}[((xor(c, b)) & 15) + 1]::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {nibbles}::BIGINT[]), {step}), 4294967295::BIGINT)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS ws FROM documents),
w AS (SELECT rid, unnest(ws) AS w FROM d),
bw AS (SELECT unnest(ws) AS w FROM (SELECT {words} AS ws FROM benchmark)),
k AS (SELECT w, ({crc} % {buckets})::INTEGER AS b FROM (SELECT w FROM w UNION SELECT w FROM bw)),
s AS (SELECT b, count(*) AS s FROM w JOIN k USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM bw JOIN k USING (w) GROUP BY b),
n AS (SELECT (SELECT count(*) FROM w) AS s_all, (SELECT count(*) FROM bw) AS t_all),
g AS (SELECT b.range::INTEGER AS b, floor({scale}e0 * ln(((coalesce(t, 0) + 1)::DOUBLE * (s_all + {buckets})::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + {buckets})::DOUBLE)))::BIGINT AS gain
      FROM range({buckets}) b LEFT JOIN s ON s.b = b.range LEFT JOIN t ON t.b = b.range CROSS JOIN n),
f AS (SELECT rid, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM w JOIN k USING (w) JOIN g USING (b) GROUP BY rid),
h AS (SELECT rid, doc_id, len(ws) AS n_words, ('0x' || sha256('{seed}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h FROM d),
c AS (SELECT rid, doc_id, n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
             (coalesce(weight, 0) + floor(-{scale}e0 * ln(-ln((h + 0.5e0) / 4294967296e0))))::BIGINT AS score FROM h LEFT JOIN f USING (rid)),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank FROM c WHERE n_words >= {least_words}),
e AS (SELECT count(*) AS n FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {num} * n // {den} THEN rank END AS rank FROM c LEFT JOIN r USING (rid) CROSS JOIN e"""


ORACLE_SQL = oracle_sql()
