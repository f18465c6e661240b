import math
import random
import zlib

import zstandard

from heatlattice.llm import toxicity
from heatlattice.llm.common import hash_sample

BAD = ["vilegrub", "snotpail", "dregwit", "muckhead"]


def corpus(n, seed=1):
    random.seed(seed)
    plain = ["".join(random.choices("etaoinshrdlu", k=random.randint(2, 8))) for _ in range(600)]
    rows = []
    for i in range(n):
        words = random.choices(plain, k=random.randint(60, 150))
        if toxic := int(random.random() < 0.3):
            for _ in range(5):
                words.insert(random.randrange(len(words)), random.choice(BAD))
        rows.append((i, " ".join(words), toxic))
    return rows


def learned(spark, docs, rows):
    table = docs([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows], "doc_id long, quality int, toxic int")
    return toxicity.classify(table, toxicity.learn(table, labels)), labels


def test_held_out_accuracy(spark, docs):
    rows = corpus(500)
    out = {r.doc_id: r for r in learned(spark, docs, rows)[0].collect()}
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    held = [(out[i].predicted, x) for i, _, x in rows if out[i].held_out]
    assert sum(p == x for p, x in held) / len(held) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())


def test_held_out_labels_are_never_used(spark, docs):
    rows = corpus(200)
    flipped = [(i, t, 1 - x if zlib.crc32(str(i).encode()) % 5 == 0 else x) for i, t, x in rows]
    a, b = (sorted(learned(spark, docs, x)[0].collect()) for x in (rows, flipped))
    assert a == b


def test_edge_cases(spark, docs):
    rows = [*corpus(200), (1000, None, None), (1001, "", 1), (None, "x", 1), (1002, "vilegrub " * 5000 + "y" * 9000, None), (1003, None, 0)]
    rows += [rows[0], rows[0]]
    out = learned(spark, docs, rows)[0].collect()
    assert len(out) == len(rows) and all(r.score is not None and r.held_out is not None for r in out)
    assert len({r.score for r in out if r.doc_id == 0}) == 1
    empty, labels = learned(spark, docs, [(1, "a", None)])
    assert [(r.score, r.predicted) for r in empty.collect()] == [(0.0, 0)]
    assert toxicity.classify(docs([]), toxicity.Model(b"", b"")).collect() == []


def test_sample_is_bounded_and_stable(spark):
    rows = spark.range(5000).selectExpr("id as doc_id", "cast(id % 2 as int) as label")
    a, b = (sorted(r.doc_id for r in hash_sample(x, "label", 30, 1).collect()) for x in (rows, rows.repartition(7)))
    assert a == b and len(a) == 60


def test_windows_cover_the_whole_text():
    text = "One two  three\n" * 50 + "z" * 1000
    assert b"".join(toxicity.windows(text)).replace(b" ", b"") == text.lower().replace(" ", "").replace("\n", "").encode()


def test_scores_against_a_plain_scorer(docs):
    rows = corpus(300)
    model = toxicity.train([t for _, t, x in rows if x], [t for _, t, x in rows if not x])
    texts = [t for _, t, _ in rows[:40]] + ["", "vilegrub", "x" * 700 + " vilegrub y"]

    def size(window, content):
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=3, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False).compress(window))

    def plain(text):
        cut, now = [], []
        for word in text.lower().encode().split():
            while len(word) > 256:
                cut, now = cut + ([b" " + b" ".join(now) + b" "] if now else []) + [b" " + word[:256]], []
                word = word[256:]
            now.append(word)
            if 1 + sum(len(w) + 1 for w in now) >= 32:
                cut, now = [*cut, b" " + b" ".join(now) + b" "], []
        if now or not cut:
            cut.append(b" " + b" ".join(now) + b" ")
        saved = [size(w, model.ordinary) - size(w, model.ordinary + model.toxic) for w in cut]
        strong = sum(s >= 3 for s in saved)
        features = [sum(max(s, 0) for s in saved) / len(saved), min(max(saved), 12), strong / len(saved), math.log(1 + strong)]
        return 1 / (1 + math.exp(-model.intercept - sum(w * (f - c) / s for w, f, c, s in zip(model.weights, features, model.center, model.scale, strict=True))))

    out = {r.doc_id: r.score for r in toxicity.classify(docs(list(enumerate(texts))), model).collect()}
    assert all(abs(out[i] - plain(t)) < 1e-9 for i, t in enumerate(texts))


def test_repeated_ids_learn_the_same(spark, docs):
    rows = corpus(120)
    table = docs([(i, t) for i, t, _ in rows] + [(i, "muckhead other text " * 9) for i, _, _ in rows[:60]])
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows], "doc_id long, quality int, toxic int")
    assert toxicity.learn(table, labels) == toxicity.learn(table.repartition(5), labels.repartition(3))
