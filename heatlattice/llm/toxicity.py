"""Toxicity by compression distance: two zstandard dictionaries, of toxic and of ordinary text.

Both dictionaries are trained by zstandard's trainer on labelled texts. The ordinary one is trained on ordinary texts
as they are. The toxic one is trained on those words of toxic texts that are, or whose first ``STEM`` bytes are, at
least ``RATIO`` times as frequent among toxic texts as among ordinary ones, and stands behind the ordinary one, so that
the two agree on everything but toxic passages. (Two dictionaries trained apart on raw text mostly differ in which
ordinary words they happen to hold; the README has the figures.) Every whole text is cut into windows of ``WINDOW``
bytes and more, at blanks; a window speaks for toxicity by the bytes that the toxic dictionary saves on it. The mean
saving, the greatest one and the share of windows that save a lot are calibrated to a score by a logistic fit on
labelled texts that trained no dictionary; 0.5 is the threshold.

Learning uses whole texts: at most ``PER_LABEL`` labelled texts of each label, those with the least seeded digests of
their ids among the rows that may be learned from, and of these, in that order, as many as have ``TRAIN_CHARS`` code
points together. Scoring uses all of every text.

A null or empty text has one empty window and gets the score of no evidence. A label other than 0 and 1, or null, is
not learned from; if an id has several label rows, the greatest label counts, if it has several texts, the least.
Without both labels to learn from, every score is 0. Every input row gives one row; rows repeated give equal rows; an
empty table gives an empty result. Only the named columns are read, so other columns can have any name.
"""

from __future__ import annotations

import dataclasses
import functools
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatlattice.llm.common import hash_sample, id_and_text, map_rows, whole_texts

PER_LABEL, TRAIN_CHARS, SEED = 3000, 32_000_000, 11
WINDOW, LEVEL, STEM, RATIO, LEAST_SHARE = 32, 3, 3, 10.0, 0.015
ORDINARY_BYTES, TOXIC_BYTES = 12_000, 2_048
#: A window that saves so many bytes counts as a toxic one.
STRONG = 3

FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def windows(text: str | None) -> list[bytes]:
    """The whole text, cut at blanks into windows of WINDOW bytes and more; a word without blanks is cut as it comes."""
    out, now, n = [], [], 1
    for word in (text or "").lower().encode().split():
        while len(word) > 8 * WINDOW:
            if now:
                out.append(b" %s " % b" ".join(now))
                now, n = [], 1
            out.append(b" " + word[: 8 * WINDOW])
            word = word[8 * WINDOW :]
        now.append(word)
        n += len(word) + 1
        if n >= WINDOW:
            out.append(b" %s " % b" ".join(now))
            now, n = [], 1
    if now or not out:
        out.append(b" %s " % b" ".join(now))
    return out


def marks_of(word: bytes) -> set[bytes]:
    """A word without punctuation, and its stem."""
    bare = word.strip(b".,;:!?\"'()[]")
    return {bare, b" " + bare[:STEM]} if len(bare) >= STEM else set()


@dataclasses.dataclass(frozen=True)
class Model:
    """Contents of the two dictionaries, and the logistic fit: means and scales of the features, weights, intercept."""

    ordinary: bytes
    toxic: bytes
    center: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    intercept: float = 0.0

    def savings(self, text: str | None) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each window."""
        plain, more = compressor(self.ordinary), compressor(self.ordinary + self.toxic)
        return np.array([len(plain.compress(w)) - len(more.compress(w)) for w in windows(text)], dtype=float)

    def features(self, text: str | None) -> np.ndarray:
        saved = self.savings(text)
        return np.array([np.maximum(saved, 0).mean(), min(saved.max(), 12), (saved >= STRONG).mean(), np.log1p((saved >= STRONG).sum())])

    def score(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        x = (self.features(text) - np.array(self.center)) / np.array(self.scale)
        return float(1 / (1 + np.exp(-np.clip(x @ np.array(self.weights) + self.intercept, -30, 30))))


@functools.lru_cache(maxsize=8)
def compressor(content: bytes):
    import zstandard

    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


def trained(size: int, samples: list[bytes]) -> bytes:
    """What zstandard's trainer picks from the samples; the samples themselves if they are too few for it."""
    import zstandard

    samples = [s for s in samples if len(s) >= 8]
    joined = b"".join(samples)
    if len(samples) < 10 or len(joined) < 4 * size:
        samples = samples * (1 + 4 * size // max(1, len(joined))) if len(samples) >= 10 else samples
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return joined[-size:]


def train(toxic: list[str], ordinary: list[str]) -> Model:
    """Dictionaries from half of the texts of each kind, the logistic fit from the other half; copies count once."""
    if not toxic or not ordinary:
        return Model(b"", b"")
    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    words = lambda text: set(text.lower().encode().split())
    of = [[words(t) for t in texts[::2]] for texts in (toxic, ordinary)]
    seen = [Counter(g for ws in kind for g in set().union(*map(marks_of, ws))) for kind in of]
    marks = {g for g, n in seen[0].items() if n >= max(3, LEAST_SHARE * len(of[0])) and n / len(of[0]) >= RATIO * (seen[1][g] + 1) / (len(of[1]) + 1)}
    marked = [b" %s " % b" ".join(sorted(w for w in ws if marks_of(w) & marks)) for ws in of[0]]
    plain = trained(ORDINARY_BYTES, [t.lower().encode() for t in ordinary[::2]])
    model = Model(plain, trained(TOXIC_BYTES, marked))
    rest = [toxic[1::2] or toxic, ordinary[1::2] or ordinary]
    x = np.array([model.features(t) for kind in rest for t in kind])
    y = np.array([1.0] * len(rest[0]) + [0.0] * len(rest[1]))
    center, scale = x.mean(0), x.std(0) + 1e-6
    weights = logistic(np.c_[(x - center) / scale, np.ones(len(x))], y)
    return dataclasses.replace(model, center=tuple(center), scale=tuple(scale), weights=tuple(weights[:-1]), intercept=float(weights[-1]))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T * (p * (1 - p) + 1e-9) @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = PER_LABEL) -> Model:
    """A model from a bounded sample of the labelled rows that are not held out."""
    base = id_and_text(docs, id_col, text_col)
    known = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = hash_sample(known, "label", per_label, SEED)
    texts = base.filter("text is not null").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label", "digest").agg(F.min("text").alias("text"))
    rows = whole_texts(texts, "label", TRAIN_CHARS, ["doc_id"])
    kinds = [[r.text for r in rows if r.label == kind] for kind in (1, 0)]
    return train(*kinds)


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def rows(texts: list) -> list[list]:
        scores = [model.score(t) for t in texts]
        return [scores, [int(s >= 0.5) for s in scores]]

    out = map_rows(id_and_text(docs, id_col, text_col), "doc_id", FIELDS, rows)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
