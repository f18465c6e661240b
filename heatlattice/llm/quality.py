"""Quality rules by compression bands, beside plain word and line rules.

A text is compressed whole and in fixed chunks of ``CHUNK`` bytes with zstandard. Its ratio (raw bytes by compressed
bytes) has to lie between a lower and an upper limit that depend on its length: above, it is repetitive; below, it
looks random. Bytes left over by whole chunks are judged in one more chunk, which ends at the text's end; a text under
``CHUNK`` bytes is its only chunk. A text fails by its chunks if more than a fifth of them lie outside the limits of
their size.

The limits come from all texts that pass the base rules, each distinct text once: by length class (half octaves of
bytes) the median of the logarithm of the ratio, plus and minus ``DEVIATIONS`` times the spread, which is 1.4826 times
the median absolute deviation, taken as the median over the populated classes up to two away, so that a group of near
copies in one class does not narrow it, and ``LEAST_SPREAD`` at least. A class of fewer than ``POPULATED`` texts takes the limits of the nearest
populated one, wider by ``WIDEN`` for each class between. Chunks of ``CHUNK`` bytes have one class, of all such chunks.
The fixed ``OUTER`` limits hold besides, and alone where nothing is populated; texts under 256 bytes have no limits.

Null counts as the empty text: no words, base_failed, not kept, ratio null. Every input row gives one row; an empty
table gives an empty result. Only the id and text columns are read, so other columns can have any name.
"""

from __future__ import annotations

import functools
import math
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatlattice.llm.common import id_and_text, map_rows
from heatlattice.storage import stored

CHUNK, LEVEL, BAD_SHARE = 2048, 3, 0.2
DEVIATIONS, LEAST_SPREAD, POPULATED, WIDEN = 6.0, 0.01, 30, 0.1
#: Steps of the logarithm of a ratio that medians are found in.
STEPS = 2000
#: Limits for any corpus: (bytes from, least ratio, greatest ratio)
OUTER = [(256, 1.05, 3.0), (1024, 1.4, 3.2), (4096, 1.5, 3.6), (16_384, 1.55, 4.0), (65_536, 1.55, 5.0)]
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

FIELDS = [
    *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("n_bytes", T.LongType()),
    T.StructField("ratio", T.DoubleType()),
    T.StructField("chunk_ratios", T.ArrayType(T.DoubleType())),
]


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    n, done = 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            n += at + 3 - max(at, done)
            done = at + 3
    return n


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return len(lines) - len(set(lines))


@functools.lru_cache(maxsize=4)
def compressor(level: int):
    import zstandard

    return zstandard.ZstdCompressor(level=level, write_content_size=False)


def ratios(raw: bytes, chunk: int, level: int) -> tuple[float | None, list[float]]:
    """The ratio of a text, and those of its chunks."""
    if not raw:
        return None, []
    of = lambda part: len(part) / len(compressor(level).compress(part))
    whole = of(raw)
    if len(raw) <= chunk:
        return whole, [whole]
    starts = [*range(0, len(raw) - chunk + 1, chunk), *([len(raw) - chunk] if len(raw) % chunk else [])]
    return whole, [of(raw[at : at + chunk]) for at in starts]


def length_class(n: int) -> int:
    return math.floor(2 * math.log2(n))


def middle(counts: dict[float, int]) -> float:
    """The (lower) median of values by their counts."""
    half, at = (sum(counts.values()) + 1) // 2, 0
    for value in sorted(counts):
        at += counts[value]
        if at >= half:
            return value
    raise ValueError("no values")


class Limits:
    """Limits of the logarithm of the ratio by length class, and of a chunk, from counts of its steps."""

    def __init__(self, whole: dict[int, dict[int, int]], chunks: dict[int, int], outer: list[tuple[int, float, float]] = OUTER, deviations: float = DEVIATIONS):
        self.outer = outer
        filled = {c: x for c, x in whole.items() if sum(x.values()) >= POPULATED}
        centers = {c: middle(x) / STEPS for c, x in filled.items()}
        own = {c: self.spread(x) for c, x in filled.items()}
        near = {c: sorted(own[d] for d in own if abs(c - d) <= 2) for c in own}
        self.of_class = {c: (centers[c], deviations * max(LEAST_SPREAD, (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2)) for c, x in near.items()}
        self.of_chunk = (middle(chunks) / STEPS, deviations * max(LEAST_SPREAD, self.spread(chunks))) if sum(chunks.values()) >= POPULATED else None

    @staticmethod
    def spread(counts: dict[int, int]) -> float:
        center, away = middle(counts), defaultdict(int)
        for value, n in counts.items():
            away[abs(value - center)] += n
        return 1.4826 * middle(away) / STEPS

    def of(self, c: int) -> tuple[float, float]:
        """The limits of a length class, without the outer ones."""
        if not self.of_class:
            return -math.inf, math.inf
        from_ = min(self.of_class, key=lambda d: (abs(c - d), d))
        center, width = self.of_class[from_]
        width += WIDEN * abs(c - from_)
        return center - width, center + width


def outside(limits: Limits, n: Column, ratio: Column, chunk: bool = False) -> Column:
    """Whether a ratio lies outside the limits for n bytes."""
    bad = F.lit(False)
    for least, low, high in limits.outer:
        bad = F.when(n >= least, (ratio < low) | (ratio > high)).otherwise(bad)
    log = F.ln(ratio)
    if chunk:
        own = F.lit(False) if limits.of_chunk is None else F.abs(log - limits.of_chunk[0]) > limits.of_chunk[1]
        return bad | own
    # one entry for each class that a length can have
    bounds = [limits.of(c) for c in range(64)]
    at = F.least(F.floor(2 * F.log2(n)), F.lit(63)).cast("int")
    low, high = (F.element_at(F.array(*(F.lit(b[i]) for b in bounds)), at + 1) for i in (0, 1))
    return bad | F.when(n >= 256, (log < low) | (log > high)).otherwise(False)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, level: int = LEVEL) -> DataFrame:
    """The counts, base_failed, n_bytes, ratio and chunk_ratios of every row, and a digest of its text."""

    def rows(texts: list) -> list[list]:
        out: list[list] = [[] for _ in FIELDS]
        for text in texts:
            text = text or ""
            raw = text.encode()
            words = raw.split()  # bytes split at exactly the blanks of WORD
            repeats = repeated_words(words)
            failed = len(words) < 50 or 100 * repeats > 50 * len(words)
            symbols, blanks = (sum(map(text.count, x)) for x in (SYMBOLS, BLANKS))
            values = (len(words), len(text) - blanks, symbols, repeated_lines(text), repeats, failed, len(raw), *ratios(raw, chunk, level))
            for column, value in zip(out, values, strict=True):
                column.append(value)
        return out

    base = id_and_text(docs, id_col, text_col).select(F.struct("doc_id", F.xxhash64("text").alias("content")).alias("row"), "text")
    return map_rows(base, "row", FIELDS, rows).select("row.doc_id", "row.content", *(f.name for f in FIELDS))


def learn(measured: DataFrame, chunk: int = CHUNK, **limits) -> Limits:
    """Limits from all distinct texts that pass the base rules. What the driver gets is a count for each step met."""
    distinct = measured.filter("not base_failed").groupBy("content", "n_bytes", "ratio").agg(F.first("chunk_ratios").alias("chunk_ratios"))
    step = lambda ratio: F.round(F.ln(ratio) * STEPS).cast("int")
    whole = distinct.select(F.floor(2 * F.log2("n_bytes")).cast("int").alias("c"), step(F.col("ratio")).alias("s"))
    chunks = distinct.filter(F.col("n_bytes") >= chunk).select(F.lit(-1).alias("c"), F.explode("chunk_ratios").alias("ratio")).select("c", step(F.col("ratio")).alias("s"))
    counts: dict[int, dict[int, int]] = defaultdict(dict)
    for r in whole.unionAll(chunks).groupBy("c", "s").count().collect():
        counts[r.c][r.s] = r["count"]
    return Limits({c: x for c, x in counts.items() if c >= 0}, counts.get(-1, {}), **limits)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, level: int = LEVEL, limits: Limits | None = None) -> DataFrame:
    """The counts, base_failed, kept and the compression figures of every row, by limits of its own corpus or given ones."""
    measured = stored(measure(docs, id_col, text_col, chunk, level))
    limits = limits or learn(measured, chunk)
    of_size = F.size(F.filter("chunk_ratios", lambda r: outside(limits, F.lit(chunk), r, chunk=True)))
    bad_whole = F.coalesce(outside(limits, F.col("n_bytes"), F.col("ratio")), F.lit(True))
    bad = F.when(F.col("n_bytes") >= chunk, of_size).otherwise(F.when(F.col("n_bytes") > 0, bad_whole.cast("int")).otherwise(0)).cast("long")
    out = measured.withColumns({"n_chunks": F.size("chunk_ratios").cast("long"), "n_bad_chunks": bad})
    fine = ~F.col("base_failed") & ~bad_whole & (F.col("n_bad_chunks") <= BAD_SHARE * F.col("n_chunks"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", fine.alias("kept"), "ratio", "n_chunks", "n_bad_chunks")
