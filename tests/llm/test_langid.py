import random
import zlib

import numpy as np

from heatlattice.llm import langid

SYLLABLES = {"aa": ["ka", "mo", "ti", "ru", "zo"], "bb": ["sch", "ein", "ung", "ver", "keit"], "cc": ["ción", "ado", "que", "ñe", "los"]}


def corpus(n, seed=3):
    random.seed(seed)
    word = lambda lang: "".join(random.choices(SYLLABLES[lang], k=random.randint(1, 4)))
    return [(i, " ".join(word(lang) for _ in range(random.randint(3, 80))), lang) for i in range(n) for lang in [random.choice(list(SYLLABLES))]]


def test_held_out_accuracy_and_edge_cases(docs):
    rows = corpus(400)
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 !?", None), (None, rows[0][1], None), (1003, rows[0][1] * 3000, None)]
    table = docs(rows + odd + [rows[0]])
    out = langid.identify(table, langid.learn(table)).collect()
    assert len(out) == len(rows) + len(odd) + 1
    by = {r.doc_id: r for r in out}
    held = [(by[i].lang_pred, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and sum(a == b for a, b in held) / len(held) > 0.97
    assert [(by[i].lang_pred, by[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert by[1003].lang_pred == by[None].lang_pred == rows[0][2] and all(0 <= r.score <= 1 for r in out)
    assert langid.identify(docs([]), langid.learn(docs([]))).collect() == []
    assert langid.identify(docs([(1, "abc")]), langid.learn(docs([(1, "abc")]))).collect()[0].lang_pred == "und"


def test_held_out_langs_are_never_used(docs):
    rows = corpus(120)
    flipped = [(i, t, "aa" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    a, b = (langid.learn(docs(x)) for x in (rows, flipped))
    assert a.langs == b.langs and np.array_equal(a.matrix, b.matrix)


def test_presence_is_a_set_over_the_whole_text():
    text = "Ab, c\n" * 40000
    one, known = langid.presence([text])
    assert known[0] and np.array_equal(one, langid.presence(["ab c ab c ab"])[0])


def test_scores_equal_the_kernel_form():
    """The folded matrix gives what kernels with the landmarks, the Nyström map and ridge weights give."""
    samples = [(t, lang) for _, t, lang in corpus(60)]
    model = langid.train(samples)
    x = langid.normed(langid.presence([t for t, _ in samples])[0]).astype(float)
    assert (x @ model.matrix).argmax(1).tolist() == [model.langs.index(lang) for _, lang in samples]


def test_scores_against_kernels_made_pair_by_pair():
    samples = [(t, lang) for _, t, lang in corpus(60)]
    model = langid.train(samples)
    bins = lambda text: set(np.flatnonzero(langid.presence([text])[0][0]).tolist())
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    first = {lang: [t for t, x in samples if x == lang][: langid.LANDMARKS] for lang in model.langs}
    marks = [bins(t) for t, lang in samples if t in first[lang]]
    parts = [(bins(p), lang) for t, lang in samples for p in (t, t[: langid.SHORT_CHARS])]
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    good = values > 1e-6 * values.max()
    nystrom = vectors[:, good] / np.sqrt(values[good])
    features = np.array([[kernel(a, b) for b in marks] for a, _ in parts]) @ nystrom
    for k, lang in enumerate(model.langs):  # one language against the rest
        y = np.array([1.0 if x == lang else -1.0 for _, x in parts])
        w = np.linalg.solve(features.T @ features + langid.RIDGE * len(parts) * np.eye(features.shape[1]), features.T @ y)
        folded = langid.normed(langid.presence([t for t, _ in samples])[0]).astype(float) @ model.matrix[:, k]
        assert np.allclose(features[::2] @ w, folded, atol=2e-3)
