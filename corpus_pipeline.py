"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again as the next one's input.

1. language_id: documents without a recognised language (no letter, or no text) go.
2. near_duplicates: one document of each class of 5-word Jaccard links (0.8 or more) stays.
3. secret_scan: every span that a rule finds is replaced by a mark; n_chars follows the text.
4. mixing: each document as many times as its source's target weight takes it.
5. bpe: token count and digests of every document of the mix.

All stages but the last return the columns of ``documents``. Each learns, counts and decides on its own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatlattice.llm import bpe, jaccard, langid, mixing, secrets
from heatlattice.llm.common import keep_rows, quoted, read
from heatlattice.llm.queries import tokenizer
from heatlattice.storage import stored

#: The n-grams and the least similarity of near duplicates here; op7_jaccard has its own.
WORDS, NUM, DEN = 5, 80, 100


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.learn(docs)
    if not model.langs:  # nothing to learn from: only texts without a letter are rejected
        model = langid.Model(("?",), langid.np.zeros((langid.BINS, 1), dtype=langid.np.float32))
    return keep_rows(docs, "text", lambda texts: [lang != langid.UNKNOWN for lang, _ in model.predict(texts)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicated(docs, words=WORDS, num=NUM, den=DEN).select(quoted(docs.columns))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(quoted(docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs).select(quoted(docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, *tokenizer())


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("mixing", mix), ("bpe", encode)]

#: Byte-level BPE, among others, has no SQL; the tests hold run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
