import random
import re

import numpy as np
import pytest

from heatlattice.llm import jaccard
from heatlattice.llm.components import components


def brute(rows, words=3, num=90, den=100):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), d) if x is not None), default=None)
    return sorted(map(str, ((d, len(s), least[find(i)] if s else d, n) for i, ((d, _), s, n) in enumerate(zip(rows, sets, links, strict=True)))))


def corpus(seed, families=12, members=14, size=60):
    random.seed(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for f in range(families):
        base = random.choices(vocab, k=random.choice([1, 2, 3, 5, 9, 12, 13, 25, size, 3 * size]))
        for m in range(members):
            copy = list(base)
            for _ in range(random.choice([0, 0, 1, 1, 2, 3, len(base) // 20])):
                at = random.randrange(len(copy) + 1)
                copy[at : at + random.choice([0, 1])] = [random.choice(vocab)] * random.choice([0, 1])
            texts.append(" ".join(copy) if m % 3 else " ".join(copy).upper())
    passage = " ".join(random.choices(vocab, k=80))
    texts += [passage + " " + " ".join(random.choices(vocab, k=60)) for _ in range(15)]
    return texts


def test_against_brute_force(docs):
    texts = [*corpus(1), None, "", " \n", "É é", "é É", "x y", "X Y", "y x"]
    rows = [*((i * 7 % 5000, t) for i, t in enumerate(texts)), (3, texts[0]), (3, texts[0]), (None, texts[0]), (None, texts[40]), (0, texts[70]), (None, None)]
    out = jaccard.join(docs(rows)).collect()
    assert sorted(map(str, map(tuple, out))) == brute(rows)
    assert jaccard.join(docs([])).collect() == []


def test_frequent_ngrams_change_no_link(docs, monkeypatch):
    """Passages that many texts share, texts of nothing else, and a sample that finds some of them."""
    random.seed(9)
    vocab = [f"w{i}" for i in range(300)]
    passages = [random.choices(vocab, k=k) for k in (30, 60, 90)]
    texts = corpus(7, families=6, members=8)
    for i in range(120):
        own = random.choices(vocab, k=random.choice([0, 3, 10, 30, 60]))
        texts.append(" ".join(own + passages[i % 3] + (passages[(i + 1) % 3] if i % 2 else [])))
    rows = list(enumerate(texts))
    for sample, often in (((8_192, 65_536), 2), ((60, 60), 2), ((8_192, 65_536), 10)):
        monkeypatch.setattr(jaccard, "SAMPLE", sample)
        monkeypatch.setattr(jaccard, "OFTEN", often)
        assert sorted(map(str, map(tuple, jaccard.join(docs(rows), words=2, num=80).collect()))) == brute(rows, 2, 80)


def test_texts_around_a_passage_do_not_meet():
    rng = np.random.default_rng(4)
    fresh = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    passage = np.unique(fresh(80))
    sets = [np.unique(np.concatenate([passage, fresh(240)])) for _ in range(60)]
    together = lambda frequent: sum(len(np.intersect1d(jaccard.signatures(sets[0], 80, 100, frequent), jaccard.signatures(s, 80, 100, frequent))) > 0 for s in sets[1:])
    assert together(jaccard.NONE) > 5 and together(passage) == 0


def test_many_blocks_equal_one(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 5)
    rows = list(enumerate(corpus(2, families=4, members=40)))
    assert sorted(map(str, map(tuple, jaccard.join(docs(rows)).collect()))) == brute(rows)


def test_many_fragments_equal_one(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 7)
    monkeypatch.setattr(jaccard, "FRAGMENT_GRAMS", 50)
    rows = list(enumerate(corpus(5, families=3, members=40, size=100)))
    assert sorted(map(str, map(tuple, jaccard.join(docs(rows), words=2, num=60).collect()))) == brute(rows, 2, 60)


def test_sets_with_several_empty_fragments():
    rng = np.random.default_rng(6)
    for _ in range(30):
        low = lambda n: np.unique(rng.integers(0, 1 << 61, n, dtype=np.uint64))  # noqa: E731  the upper 7/8 of the order is empty
        a, c = low(60), low(60)
        b = np.unique(np.concatenate([a[2:], low(1)]))
        assert len(np.intersect1d(jaccard.signatures(a), jaccard.signatures(b)))
        assert not len(np.intersect1d(jaccard.signatures(a), jaccard.signatures(c)))


@pytest.mark.parametrize(("num", "den"), [(9, 10), (8, 10), (1, 2)])
def test_linked_sets_share_a_signature(num, den):
    rng = np.random.default_rng(3)
    for n in [1, 2, 5, 9, 10, 11, 19, 20, 60, 200, 700]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            # as different as the threshold allows: drop x and add y
            most = n - -(-n * num // den)
            x = int(rng.integers(0, most + 1))
            y = max(0, ((n - x) * den // num) - n)
            b = np.unique(np.concatenate([rng.permutation(a)[x:], rng.integers(0, 1 << 63, y, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]))
            inter = len(np.intersect1d(a, b))
            assert den * inter >= num * (len(a) + len(b) - inter)
            assert len(np.intersect1d(jaccard.signatures(a, num, den), jaccard.signatures(b, num, den)))
            for share in (0.3, 0.7, 0.95, 1):  # frequent ones among what both have, and among what one has
                frequent = np.sort(np.concatenate([rng.permutation(np.intersect1d(a, b))[: int(share * n)], rng.permutation(a)[:x]]))
                assert len(np.intersect1d(jaccard.signatures(a, num, den, frequent), jaccard.signatures(b, num, den, frequent)))


def test_overlaps_by_fragments(monkeypatch):
    monkeypatch.setattr(jaccard, "COLUMNS", 7)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 90, 40).astype(np.uint64)) for _ in range(12)]
    assert jaccard.overlaps(sets[:5], sets[5:]).tolist() == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]


def test_chunks_keep_families_together(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "CHUNK", 50)
    rng = np.random.default_rng(2)
    rows = [(int(s), int(f)) for s, f in rng.integers(0, 40, (400, 2))] + [(99, 5)] * 30
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[i : i + 20], strict=True)], names=["sig", "fp"]) for i in range(0, len(rows), 20)]
    out = [tuple(r.values()) for b in jaccard.first_of_chunk(iter(batches)) for r in b.to_pylist()]
    sent = [(s, f) for s, f, _ in out if s is not None]
    assert len(sent) < 0.8 * len(rows) and sum(s == 99 for s, _ in sent) <= 3 and all(f == m for s, f, m in out if s is not None)
    near = {frozenset((f, m)) for s, f, m in out if s is None}

    def groups(links):
        root = {f: f for _, f in rows}
        for _ in root:
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    by_sig = lambda pairs: [(f, min(g for s, g in pairs if s == sig)) for sig, f in pairs]
    assert groups([*map(tuple, (sorted(x) for x in near if len(x) == 2)), *by_sig(sent)]) == groups(by_sig(rows))


def test_components(spark):
    random.seed(4)
    edges = [(i, i + 1) for i in range(60)] + [(100 + random.randrange(30), 100 + random.randrange(30)) for _ in range(25)] + [(500, 500), (301, 300), (301, 302)]
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        if a != b:
            x, y = root.setdefault(a, {a}), root.setdefault(b, {b})
            for k in x | y:
                root[k] = x | y
    assert out == {k: min(v) for k, v in root.items()}


def test_deduplicated_keeps_one_row_of_each_class(docs):
    text = " ".join(f"w{i}" for i in range(40))
    near = text + " more"
    rows = [(5, text), (5, text), (3, near), (7, text), (None, text), (8, "other words here"), (9, None), (9, None), (10, " "), (None, "lone text of its own"), (11, "other words HERE")]
    out = jaccard.deduplicated(docs(rows))
    assert out.columns == docs(rows).columns
    assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == sorted(map(str, [(3, near), (8, "other words here"), (9, None), (9, None), (10, " "), (None, "lone text of its own")]))
    twice = [(1, text), (1, text), (2, None), (2, None)]
    assert sorted(str((r.doc_id, r.text)) for r in jaccard.deduplicated(docs(twice)).collect()) == sorted(map(str, [(1, text), (2, None), (2, None)]))


def test_deduplicated_takes_any_column_name(docs):
    table = docs([(1, "a b c d"), (2, "a b c d"), (3, "e")]).withColumnRenamed("key", "content").withColumnRenamed("component", "_content").withColumnRenamed("n", "__content")
    assert sorted(r.doc_id for r in jaccard.deduplicated(table).collect()) == [1, 3]


def test_signatures_grow_as_the_set():
    rng = np.random.default_rng(8)
    for n in (1, 10, 100, 1000, 20_000):
        for _ in range(5):
            found = jaccard.signatures(np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)), 80, 100)
            assert len(found) <= 4 * jaccard.FIRST
