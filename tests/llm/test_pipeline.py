import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from heatlattice.llm import secrets

from test_bpe import brute as encoded
from test_jaccard import corpus


@pytest.fixture
def folder(spark, tmp_path):
    texts = corpus(7, families=4, members=8, size=40)
    texts[3] = "token=abcdefgh " + texts[3] + " AKIA" + "Z9" * 10
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(900, "12 34", "en", "s1", 5), (901, None, None, None, None), (902, texts[0], "en", "s2", 1), (903, texts[0], None, None, 1), (904, "", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def sets(rows):
    out = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text.lower())
        out.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)})
    return out


def test_stages_against_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{name}")
        before, docs = docs.collect(), spark.read.parquet(f"{folder}/{name}")
        after = docs.collect()
        seen[name] = after
        if name != "bpe":
            assert docs.columns == columns
        if name == "language_id":
            assert sorted(after, key=str) == sorted((r for r in before if any(c.isalpha() for c in r.text or "")), key=str)
        if name == "near_duplicates":
            known = sets(before)
            group = {i: {i} for i in range(len(before))}
            for i in range(len(before)):
                for j in range(i):
                    if 100 * len(known[i] & known[j]) >= 90 * len(known[i] | known[j]):
                        both = group[i] | group[j]
                        for k in both:
                            group[k] = both
            assert sorted(r.doc_id for r in after) == sorted({min(before[k].doc_id for k in g) for g in group.values()})
        if name == "secret_scan":
            found = [r for r in before if any(re.search(x.regex, r.text) for x in secrets.RULES if x.kind != "hex")]
            assert len(after) == len(before) and len(found) == sum("[SECRET]" in r.text for r in after) == 1
            assert sorted(r for r in after if "[SECRET]" not in r.text) == sorted(r for r in before if r not in found)
            assert all(r.n_chars == len(r.text) for r in after if "[SECRET]" in r.text)
        if name == "mixing":
            n = Counter(r.doc_id for r in after)
            assert max(n.values()) <= 3 and {r.doc_id for r in after} <= {r.doc_id for r in before}
        if name == "bpe":
            assert sorted(map(tuple, after)) == sorted((r.doc_id, *encoded(r.text)) for r in before)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, seen["bpe"]))


def test_near_duplicates_by_five_words_and_four_fifths(spark, docs):
    words = [f"w{i}" for i in range(100)]
    two, three = list(words), list(words)
    for at in (30, 60):  # 86 of 106 five-word n-grams stay, 92 of 104 three-word ones
        two[at] = f"x{at}"
    for at in (20, 45, 70):  # 81 of 111: under 0.8
        three[at] = f"y{at}"
    table = docs([(1, " ".join(words)), (2, " ".join(two)), (3, " ".join(three))])
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, table, "").collect()) == [1, 3]


def test_any_column_name(spark, docs):
    table = docs([(1, "some words of a text", "en", "s"), (2, "token=abcdefgh and more words", "en", "s"), (3, "12", "en", "s"), (None, None)])
    named = table.withColumnsRenamed({"key": "a.b", "component": "c`d", "n": "e f"}).withColumn("n_chars", F.lit(5).cast("long"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, named, "")
        assert out.columns == named.columns and out.count() > 0, name
