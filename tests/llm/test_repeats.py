import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from heatlattice.llm import repeats


def plain(w, least=12):
    """Start, length and period of all runs, period by period."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q) and not any(w[i : i + length - d] == w[i + d : i + length] for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_random_texts(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(1, 9)):
            w = [b"%d" % rng.randrange(rng.choice([1, 2, 2, 3, 4, 20])) for _ in range(rng.randint(0, 70))]
            if w and rng.random() < 0.5:
                s = rng.randrange(len(w))
                p = 1 + rng.randrange(max(1, (len(w) - s) // 2))
                w = w[:s] + [w[s + i % p] for i in range(len(w) - s)]
            texts.append(w)
        assert repeats.of_texts(texts, 1) == [plain(t, 1) for t in texts]


@pytest.mark.parametrize("text", [fibonacci(400), ["a"] * 300, ["a", "b"] * 150, list("abcabcab" * 30) + list("abcabc" * 9), [str(i.bit_count() % 2) for i in range(300)]])
def test_runs_of_highly_repetitive_texts(text):
    assert repeats.of_texts([text, text[::-1]], 1) == [plain(text, 1), plain(text[::-1], 1)]


def test_layers_compare_stretches():
    rng = np.random.default_rng(0)
    w = np.r_[rng.integers(0, 2, 200), 2]
    s = repeats.Suffixes(w)
    assert s.order.tolist() == sorted(range(201), key=lambda i: w[i:].tolist())
    x, y = (np.array(v) for v in zip(*((a, b) for a in range(201) for b in range(201) if a != b), strict=True))
    ahead = [next(k for k in range(202) if max(a, b) + k > 200 or w[a + k] != w[b + k]) for a, b in zip(x, y, strict=True)]
    behind = [next(k for k in range(202) if min(a, b) - k < 0 or w[a - k] != w[b - k]) for a, b in zip(x, y, strict=True)]
    assert s.forward(x, y).tolist() == ahead and s.backward(x, y).tolist() == behind
    longest = [max((next(k for k in range(202) if max(i, j) + k > 200 or w[i + k] != w[j + k]) for j in range(i)), default=0) for i in range(201)]
    assert s.earlier().tolist() == longest


def test_long_text_of_one_word_and_of_many():
    assert repeats.of_texts([[b"a"] * 200_000]) == [[(0, 200_000, 1)]]
    many = [b"%d" % i for i in range(100_000)]
    assert repeats.of_texts([many + [b"x"] + many[:50_000] * 3]) == [[(100_001, 150_000, 50_000)]]
    found = repeats.of_texts([many + many])
    assert found == [[(0, 200_000, 100_000)]]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text, plant):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain(w)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(found), *head, digest("".join(f"{a},{b},{c}\n" for a, b, c in found)), digest(" ".join(x for i, x in enumerate(w) if i not in dropped))


@pytest.mark.parametrize("plant", [False, True])
def test_rows(spark, docs, monkeypatch, plant):
    monkeypatch.setattr(repeats, "BATCH", 300)
    words = "the hot water pump, in   loop B\x0bis\tset".split(" ")
    rows = [(i, " ".join(words[(i * j + j * j // (1 + i % 5)) % len(words)] for j in range(i % 97))) for i in range(200)]
    rows += [(None, "a b\n" * 20), (None, None), (5, None), (6, ""), (7, " \t\r\n"), (8, "x " * 2000), (8, "x " * 2000), (-9, "a b c d e f " * 2), (-10, "a b c d e " * 2)]
    found = repeats.digests(repeats.collapse(docs(rows).repartition(3), altered=repeats.planted if plant else None))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted((expected(*r, plant) for r in rows), key=str)


def test_empty(docs):
    assert repeats.digests(repeats.collapse(docs([]))).collect() == []
