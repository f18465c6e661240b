"""The queries of this subpackage, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heatlattice.llm import bpe, chat, hamming, jaccard, langid, licenses, mixing, quality, repeats, resample, secrets, toxicity, warc
from heatlattice.llm.common import read


def tokenizer(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """Where the public vocabulary lies, and its pre-token pattern."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents")).drop("found")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents")).drop("found")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


def op6_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.search(read(spark, sf_dir, "embeddings"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), *tokenizer())


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


#: A conversation whose texts hold the template's own control strings.
QUOTED = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(talk.unionByName(spark.createDataFrame(QUOTED, talk.schema)))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, read(spark, sf_dir, "pages"))


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.collapse(read(spark, sf_dir, "documents"), altered=repeats.planted))


QUERIES = {"op1_secrets": op1_secrets, "op2_licenses": op2_licenses, "op3_toxicity": op3_toxicity, "op4_quality": op4_quality, "op5_langid": op5_langid, "op6_hamming": op6_hamming, "op7_jaccard": op7_jaccard, "op8_bpe": op8_bpe, "op9_mixing": op9_mixing, "op10_chat": op10_chat, "op11_resample": op11_resample, "op12_warc": op12_warc, "op13_repeats": op13_repeats}
ORACLES = {"op6_hamming": hamming.ORACLE_SQL, "op1_secrets": secrets.oracle_sql(), "op7_jaccard": jaccard.ORACLE_SQL, "op9_mixing": mixing.ORACLE_SQL, "op10_chat": chat.oracle_sql(QUOTED), "op11_resample": resample.ORACLE_SQL, "op12_warc": warc.ORACLE_SQL}
