"""Language identification by a string kernel with Nyström landmarks and one-versus-rest kernel ridge regression.

A text is lower-cased and everything that is no letter becomes a blank. Its blended spectrum is the set of its n-grams
of 1 to 3 code points, each hashed to one of ``BINS`` bins; the kernel of two texts is the number of bins that both
have, over the root of the product of their numbers of bins. Landmarks are texts of each language; with the kernel
matrix of the landmarks, Nyström's method maps a text to features whose products approximate the kernel, and ridge
regression on them learns one language against the rest. As scoring is linear in the presence vector, landmarks,
Nyström map and weights are multiplied once into a bins x languages matrix, and a batch of texts is scored by one
matrix product. Whole texts are scored.

The score is the logistic function of ``SHARPNESS`` times the lead of the best language over the next one; with a
single learned language, over 0. A text without a letter, or null, is ``und`` with score 0, as is every text when
nothing could be learned. Ties go to the first language in code point order. Rows with a null or empty lang are not
learned from. Learning uses whole texts: at most ``PER_LANG`` texts of a language, those with the least seeded digests
of id and text among the rows that may be learned from, and of these, in that order, as many as have ``TRAIN_CHARS``
code points together. Every input row gives one row; an empty table gives an empty result. Only the named columns are
read, so other columns can have any name.
"""

from __future__ import annotations

import dataclasses
import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatlattice.llm.common import hash_sample, id_and_text, map_rows, whole_texts

PER_LANG, LANDMARKS, TRAIN_CHARS, SHORT_CHARS, SEED = 250, 50, 4_000_000, 120, 23
BINS, RIDGE, SHARPNESS = 1 << 14, 1e-3, 4.0
UNKNOWN = "und"
#: Texts are hashed in blocks of so many code points, and scored so many at a time.
BLOCK, BATCH = 1 << 17, 64

FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def mark(text: str | None, row: np.ndarray) -> bool:
    """Sets the bins of a text's n-grams in ``row``; whether the text has a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    known, found = letters(), False
    for at in range(0, len(codes), BLOCK):
        block = codes[at : at + BLOCK + 2]  # n-grams that begin in this block
        alpha = known[block]
        found = found or bool(alpha.any())
        c = np.where(alpha, block, 32).astype(np.uint32)
        c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))] if len(c) else c
        h = c * np.uint32(0x9E3779B1)
        row[h >> np.uint32(18)] = 1
        for _ in range(2):
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c[-len(h) + 1 :] * np.uint32(0x9E3779B1) if len(h) > 1 else h[:0]
            row[(h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(18)] = 1
    return found


def presence(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """A row of 0 and 1 for each text, and whether it has a letter."""
    rows = np.zeros((len(texts), BINS), dtype=np.float32)
    return rows, np.array([mark(t, r) for t, r in zip(texts, rows, strict=True)], dtype=bool)


def normed(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))


@dataclasses.dataclass(frozen=True)
class Model:
    """langs, and the matrix (bins x languages) that a normed presence vector is multiplied by."""

    langs: tuple[str, ...] = ()
    matrix: np.ndarray | None = None

    def predict(self, texts: list) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        for at in range(0, len(texts), BATCH):
            rows, known = presence(texts[at : at + BATCH])
            if not self.langs:
                out += [(UNKNOWN, 0.0)] * len(rows)
                continue
            f = normed(rows) @ self.matrix
            best = f.argmax(1)
            top = f[np.arange(len(f)), best]
            f[np.arange(len(f)), best] = -np.inf
            lead = top - (f.max(1) if len(self.langs) > 1 else 0)
            score = 1 / (1 + np.exp(-SHARPNESS * np.clip(lead.astype(float), -5, 5)))
            out += [(self.langs[b], float(s)) if k else (UNKNOWN, 0.0) for b, s, k in zip(best, score, known, strict=True)]
        return out


def train(samples: list[tuple[str, str]]) -> Model:
    """A model from (text, lang); every text also counts by its first SHORT_CHARS, so that short texts are learned."""
    samples = [s for s in samples if s[0] and s[1]]
    langs = tuple(sorted({lang for _, lang in samples}))
    if not langs:
        return Model()
    texts, ys, marks = [], [], []
    seen = dict.fromkeys(langs, 0)
    for text, lang in samples:
        for part in (text, text[:SHORT_CHARS]):
            if part is text and seen[lang] < LANDMARKS:
                marks.append(len(texts))
                seen[lang] += 1
            texts.append(part)
            ys.append(langs.index(lang))
    land = normed(presence([texts[i] for i in marks])[0])
    values, vectors = np.linalg.eigh((land @ land.T).astype(float))
    good = values > 1e-6 * values.max()
    half = vectors[:, good] / np.sqrt(values[good])  # the landmarks' kernel matrix to the power of -1/2
    parts = (normed(presence(texts[at : at + BATCH])[0]) @ land.T for at in range(0, len(texts), BATCH))
    phi = np.concatenate([part.astype(float) @ half for part in parts])  # a batch at a time: the driver holds no n x bins matrix
    y = np.where(np.array(ys)[:, None] == np.arange(len(langs)), 1.0, -1.0)
    w = np.linalg.solve(phi.T @ phi + RIDGE * len(phi) * np.eye(phi.shape[1]), phi.T @ y)
    return Model(langs, (land.T.astype(float) @ (half @ w)).astype(np.float32))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> Model:
    """A model from a bounded sample of each language's rows that are not held out."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[lang_col].alias("lang"), docs[text_col].cast("string").alias("text"))
    rows = rows.filter("doc_id is not null and lang is not null and lang <> '' and text is not null").filter(~held_out(F.col("doc_id")))
    keyed = rows.withColumn("key", F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text")))
    sample = hash_sample(keyed, "lang", per_lang, SEED, "key").distinct()  # rows repeated count once
    picked = sorted(whole_texts(sample, "lang", TRAIN_CHARS, ["doc_id", "text"]), key=lambda r: (r.lang, r.doc_id, r.text))
    return train([(r.text, r.lang) for r in picked])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""

    def rows(texts: list) -> list[list]:
        return [list(x) for x in zip(*model.predict(texts), strict=True)] if texts else [[], []]

    out = map_rows(id_and_text(docs, id_col, text_col), "doc_id", FIELDS, rows)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
