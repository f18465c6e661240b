"""Periodic runs of words by the linear tandem-repeat method of Gusfield and Stoye.

A batch of texts is one array of words, those of different texts made different and an end mark behind each. All steps
are array operations over the whole batch.

1. Ranks of all stretches of 1, 2, 4, ... words: the suffix tree in layers. A rank is the place in the order of suffixes
   at which the suffixes with that stretch begin, so a stretch is an interval of suffixes, two stretches of any length
   are compared by two ranks, and the longest common extension of two places, forwards or backwards, takes a descent
   through the layers. Only stretches that occur twice are ranked on.
2. Lempel-Ziv blocks: each the longest stretch that also begins earlier, or one new word. The first occurrence of a
   square reaches over a block's border and no further than the next block. So the first squares of each
   period that hold a word at a border are a leftmost covering set: the first occurrence of every distinct square is one
   of them, or follows one word by word in squares of the same period. Squares whose half is itself a power are left out.
3. Suffix-link walks complete the vocabulary: from a square, drop the first word, and see whether that stretch is
   followed by the word somewhere. As long as it is at the same place, the walk is a stretch of text; else the suffixes
   of the interval are searched for it, and the walk goes on there. It ends at squares that are known.
4. The suffixes of each square's interval are its occurrences. Those of one period at consecutive places are a run.

The occurrences of such squares are O(n log n), whatever the text. A batch holds ``BATCH`` words, or one longer text; its
layers take 4 bytes a word and layer, and there are as many as the longest repeated stretch has binary digits.

Null counts as the empty text: no words, no runs. Repeated rows each give one row; an empty table gives an empty result.
Only the id and text columns are read, so other columns can have any name.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatlattice.llm.common import _arrow, id_and_text

BATCH, LEAST = 1 << 18, 12


class Suffixes:
    """Layers of ranks over an array of numbers whose last one occurs once."""

    def __init__(self, words: np.ndarray):
        n = self.size = len(words)
        order = np.argsort(words, kind="stable")
        rank, twice = np.empty(n, dtype=np.int32), np.empty(n, dtype=bool)
        rank[order], twice[order] = self._groups(words[order])
        self.layers, live, step = [rank], np.flatnonzero(twice), 1
        while live.size:
            key = rank[live].astype(np.int64) * n + rank[live + step]  # a stretch that occurs twice does not reach the end
            order = np.argsort(key, kind="stable")
            old = rank[live][order]
            first = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], np.arange(len(old)), 0))
            place, twice = self._groups(key[order])
            rank = rank.copy()
            rank[live[order]] = old + place - first
            self.layers.append(rank)
            live = np.sort(live[order][twice])
            step *= 2
        self.table = np.stack(self.layers)
        self.order = np.empty(n, dtype=np.int64)
        self.order[rank] = np.arange(n)
        self.rank = rank

    @staticmethod
    def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted keys: the place at which each one's equals begin, and whether it has any."""
        new = np.r_[True, keys[1:] != keys[:-1]]
        place = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
        return place, ~(new & np.r_[new[1:], True])

    def _common(self, x: np.ndarray, y: np.ndarray, at: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> np.ndarray:
        """Length of the common stretch; ``at`` gives the place to compare from a place, the length so far and the layer's."""
        length, top, now = np.zeros(len(x), dtype=np.int64), np.full(len(x), -1), np.arange(len(x))

        def same(j: int, of: np.ndarray) -> np.ndarray:
            a, b = at(x[of], length[of], 1 << j), at(y[of], length[of], 1 << j)
            fits = np.minimum(a, b) >= 0
            return fits & (self.layers[j][np.where(fits, a, 0)] == self.layers[j][np.where(fits, b, 0)])

        for j in range(len(self.layers)):
            now = now[same(j, now)]
            if not now.size:
                break
            top[now] = j
        for j in range(top.max(initial=-1), -1, -1):
            now = np.flatnonzero(top >= j)
            length[now[(top[now] == j) | same(j, now)]] += 1 << j
        return length

    def forward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words from the different places x and y on are the same."""
        return self._common(x, y, lambda p, length, step: p + length)

    def backward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words up to and with x and y are the same."""
        return self._common(x, y, lambda p, length, step: p - length - step + 1)

    def same(self, x: np.ndarray, y: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of a length at x and y are the same; x may be no end of the array."""
        layer = np.frexp(length.astype(float))[1] - 1
        known = layer < len(self.layers)
        layer = np.where(known, layer, 0)
        shift = np.where(known, length - (1 << layer), 0)
        fits = np.maximum(x, y) + shift < self.size
        shift = np.where(fits, shift, 0)
        t = self.table
        return (x == y) | (known & fits & (t[layer, x] == t[layer, y]) & (t[layer, x + shift] == t[layer, y + shift]))

    def interval(self, x: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last suffix that begins with the stretch at x."""
        found = []
        for end in (0, self.size - 1):
            fine, far = self.rank[x].astype(np.int64), np.full(len(x), end, dtype=np.int64)
            way = 1 if end else -1
            while (now := np.flatnonzero(fine != far)).size:  # half the way to the end, or the last step
                mid = fine[now] + way * ((np.abs(far[now] - fine[now]) + 1) // 2)
                ok = self.same(self.order[mid], x[now], length[now])
                fine[now], far[now] = np.where(ok, mid, fine[now]), np.where(ok, far[now], mid - way)
            found.append(fine)
        return found[0], found[1]

    def earlier(self) -> np.ndarray:
        """Length of the longest stretch at each place that also begins before it."""
        out = np.zeros(self.size, dtype=np.int64)
        first = self.layers[0][self.order]  # suffixes with another first word share nothing
        for step in (-1, 1):
            to = np.arange(self.size) + step
            to[(to < 0) | (to >= self.size)] = -1
            to[(to >= 0) & (first[to] != first)] = -1
            now = np.flatnonzero(to >= 0)
            while (now := now[(to[now] >= 0)][self.order[to[now[to[now] >= 0]]] > self.order[now[to[now] >= 0]]]).size:
                to[now] = to[to[now]]
            has = np.flatnonzero(to >= 0)
            x, y = self.order[has], self.order[to[has]]
            out[x] = np.maximum(out[x], self.forward(x, y))
        return out


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``counts`` things: its number, as often as it counts, and 0, 1, ... within it."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def covering(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of a leftmost covering set of squares."""
    lengths, starts, at = s.earlier().tolist(), [], 0
    while at < s.size:
        starts.append(at)
        at += lengths[at] or 1
    starts = np.array([*starts, s.size, s.size])
    h, h1, h2 = starts[:-2], starts[1:-1], starts[2:]
    found = []
    # squares that begin in a block and reach over its end
    of, k = spread(h1 - h)
    k, border = k + 1, h1[of]
    q = border - k
    fits = border < s.size
    fits[fits] = s.layers[0][border[fits]] == s.layers[0][q[fits]]
    k, border, q = k[fits], border[fits], q[fits]
    ahead, behind = s.forward(border, q), s.backward(border - 1, q - 1)
    start = np.maximum(q - behind, q - k + 1)
    found.append((start, k, ahead + behind >= k))
    # squares that begin before a block and have their middle in it, or at its end
    of, k = spread(h2 - h)
    k, here, end = k + 1, h[of], h1[of]
    q = here + k
    fits = (q < s.size) & (here > 0)
    fits[fits] = (s.layers[0][here[fits]] == s.layers[0][q[fits]]) & (s.layers[0][here[fits] - 1] == s.layers[0][q[fits] - 1])
    k, here, end, q = k[fits], here[fits], end[fits], q[fits]
    ahead, behind = s.forward(here, q), s.backward(here - 1, q - 1)
    start = np.maximum(here - behind, here - k + 1)
    found.append((start, k, (ahead + behind >= k) & (start + k <= end)))
    start, k, good = (np.concatenate(x) for x in zip(*found, strict=True))
    start, k = start[good], k[good]
    good = primitive(s, start, k)
    return start[good], k[good]


def primitive(s: Suffixes, start: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the half of each square is no power: it has no period of a prime part of its length."""
    out, rest = np.ones(len(k), dtype=bool), k.copy()
    least = np.arange(k.max(initial=1) + 1)  # least prime factors
    for p in range(2, int(len(least) ** 0.5) + 1):
        if least[p] == p:
            multiples = least[p * p :: p]
            np.minimum(multiples, p, out=multiples)
    while (now := np.flatnonzero(rest > 1)).size:
        p = least[rest[now]]
        d = k[now] // p
        out[now[s.same(start[now], start[now] + d, 2 * k[now] - d)]] = False
        rest[now] //= p
    return out


def squares(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of all occurrences of all squares whose half is no power, by period and start."""
    x, k = covering(s)
    known, lows, highs, periods = np.zeros(0, dtype=np.int64), [], [], []
    while x.size:
        # the walk along the text
        of, t = spread(s.forward(x, x + k) - k + 1)
        low, high = s.interval(x[of] + t, 2 * k[of])
        keys, first = np.unique(low * s.size + k[of], return_index=True)
        new = ~np.isin(keys, known)
        known = np.concatenate([known, keys[new]])
        lows, highs, periods = [*lows, low[first[new]]], [*highs, high[first[new]]], [*periods, k[of][first[new]]]
        # the suffix link of the last square, and the edge on with its first word
        last = np.cumsum(np.bincount(of, minlength=len(x))) - 1
        fresh = np.isin(low[last] * s.size + k, keys[new])
        x, k = (x[of] + t)[last][fresh], k[fresh]
        low, high = s.interval(x + 1, 2 * k - 1)
        word = s.layers[0][x]
        while (now := np.flatnonzero(low < high)).size:
            mid = (low[now] + high[now]) // 2
            less = s.layers[0][s.order[mid] + 2 * k[now] - 1] < word[now]
            low[now], high[now] = np.where(less, mid + 1, low[now]), np.where(less, high[now], mid)
        to = s.order[low]
        found = s.layers[0][np.minimum(to + 2 * k - 1, s.size - 1)] == word
        x, k = to[found], k[found]
    low, high, period = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (lows, highs, periods))
    of, t = spread(high - low + 1)
    start, period = s.order[low[of] + t], period[of]
    order = np.lexsort((start, period))
    return start[order], period[order]


def runs(words: np.ndarray) -> np.ndarray:
    """Start, length and period of every run in an array whose last number occurs once, by period and start."""
    if not len(words):
        return np.zeros((0, 3), dtype=np.int64)
    start, period = squares(Suffixes(words))
    new = np.r_[True, (np.diff(period) != 0) | (np.diff(start) != 1)][: len(start)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(start)][: len(first)] - 1
    return np.stack([start[first], start[last] - start[first] + 2 * period[first], period[first]], axis=1)


def of_texts(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """Start, length and period of the runs of ``least`` words or more of each text, by start and period."""
    ids: defaultdict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    size = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(size + 1) - 1
    numbers = np.empty(int(size.sum()) + len(texts), dtype=np.int64)
    inside = np.ones(len(numbers), dtype=bool)
    inside[ends] = False
    numbers[inside] = np.fromiter(map(ids.__getitem__, itertools.chain.from_iterable(texts)), dtype=np.int64, count=int(size.sum()))
    numbers[ends] = len(ids)
    found = runs(numbers + np.repeat(np.arange(len(texts)), size + 1) * (len(ids) + 1))
    found = found[found[:, 1] >= least]
    of = np.searchsorted(ends, found[:, 0])
    found[:, 0] -= (ends - size)[of]
    order = np.lexsort((found[:, 2], found[:, 0], of))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for text, run in zip(of[order].tolist(), found[order].tolist(), strict=True):
        out[text].append(tuple(run))
    return out


def kept(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds behind its first period."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    inside = np.cumsum(change) > 0
    return [w for w, drop in zip(words, inside.tolist(), strict=False) if not drop]


RUNS = "doc_id {id}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, altered: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (by start and period) and the collapsed text of every row.

    ``altered`` may change the words of a text, by its id, before they are searched.
    """
    base = id_and_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def done() -> pa.RecordBatch:
            found = of_texts(texts, least)
            rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in f] for f in found]
            out = [b" ".join(kept(t, f)).decode() for t, f in zip(texts, found, strict=True)]
            columns = [pa.array(ids, schema.field(0).type), pa.array([len(t) for t in texts], pa.int64()), pa.array(rows, schema.field(2).type), pa.array(out, pa.string())]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").encode().split()  # bytes: blanks as in WORD
                ids.append(doc_id)
                texts.append(altered(doc_id, words) if altered else words)
                size += len(texts[-1]) + 1
                if size >= BATCH:
                    yield done()
                    ids, texts, size = [], [], 0
        if ids:
            yield done()

    kinds = T._parse_datatype_string(RUNS.format(id=dict(base.dtypes)["doc_id"]))
    schema = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in kinds])
    return base.mapInArrow(run, kinds)


def planted(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The words with a periodic end in about one text of ten, by its id; a null id has none."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the longest run, and digests of all runs and of the collapsed text."""
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("a"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.withColumn("best", best).select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.a")).alias("length"), F.col("best.period").alias("period"), F.array_join(lines, "").alias("lines"), "collapsed")
    return rows.select("doc_id", "n_runs", "start", "length", "period", F.floor(1000 * F.col("length") / F.col("period")).alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
