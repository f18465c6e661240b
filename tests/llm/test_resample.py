import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from heatlattice.llm import resample


def plain(rows, targets, most=1, buckets=10_000, num=10, den=100, least=20):
    """(doc_id, n_features, weight, score, rank), sorted, one text after the other."""

    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(words) - n + 1)]

    s, t = (Counter(b for x in texts for b in features(x)[1]) for texts in ([r[1] for r in rows], targets))
    big_s, big_t = s.total(), t.total()
    out = []
    for doc_id, text in rows:
        n, at = features(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in at]
        weight = math.floor(sum(gains) / len(gains)) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((n, doc_id, len(at), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in out if r[0] >= least), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2]))
    cut = num * len(order) // den
    ranked = [(*r[1:], i + 1 if i < cut else None) for i, r in enumerate(order)] + [(*r[1:], None) for r in out if r[0] < least]
    return sorted(ranked, key=str)


def texts():
    words = "the Öl pump WATER heat_pipe loss-of 24 ﬁne net, flow zone cost\x00pipe Δp".split(" ")
    rows = [(i, " ".join(words[(i * 7 + j * j) % len(words)] for j in range(10 + i % 37))) for i in range(400)]
    return [*rows, (7, rows[7][1]), (7, rows[7][1]), (7, rows[7][1]), (None, rows[30][1]), (None, rows[30][1]), (None, rows[31][1]), (-1, None), (-2, ""), (-3, "... --"), (-4, "long " * 50_000)]


@pytest.mark.parametrize(("most", "rows", "block", "num"), [(1, 1 << 18, 256, 10), (2, 16, 3, 50), (3, 1, 1, 100), (1, 40, 7, 0)])
def test_same_as_plain(spark, docs, monkeypatch, most, rows, block, num):
    monkeypatch.setattr(resample, "BLOCK", block)
    targets = ["pump water flow", None, "zone Zone", ""]
    bench = spark.createDataFrame([(t,) for t in targets], "text string")
    found = resample.resample(docs(texts()).repartition(5), bench, most=most, rows=rows, num=num)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=str) == plain(texts(), targets, most, num=num)


def test_empty(spark, docs):
    none = spark.createDataFrame([], "text string")
    assert resample.resample(docs([]), none).collect() == []
    assert sorted(map(tuple, resample.resample(docs(texts()), none).collect()), key=str) == plain(texts(), [])


def test_tournament_holds_one_block_a_run():
    """Blocks join only when their first entry may win."""
    block = lambda run, *at: {"run": run, "ids": list(at), "features": [0] * len(at), "weights": [0] * len(at), "scores": [-x for x in at]}
    blocks = [block(0, 1, 2), block(1, 1, 5), block(0, 3, 3), block(0, 3, 9), block(2, 6)]
    read = []
    merge = resample.merged((read.append(b) or b for b in blocks), 7)
    assert [next(merge)[0][2] for _ in range(3)] == [1, 1, 2]
    assert len(read) == 3
    assert [(e[2], place) for e, place in merge] == [(3, 3), (3, 4), (3, 5), (5, 6), (9, None), (6, None)]
