import random

from heatlattice.llm import licenses as lic

KNOWN = {n: lic.words_of(t) for n, t in lic.TEMPLATES.items()}


def best_local(template, words):
    """Whole-matrix local alignment (match 2, mismatch and gap -1): first and last word of the text, and matches."""
    table = [[(0, 0, 0)] * (len(words) + 1) for _ in range(len(template) + 1)]  # score, matches, -first
    best, where = 0, (0, -1, 0)
    for i, a in enumerate(template, 1):
        for j, b in enumerate(words, 1):
            s, n, f = table[i - 1][j - 1]
            fresh = s <= 0
            s, n, f = (0, 0, -(j - 1)) if fresh else (s, n, f)
            ways = [(s + (2 if a == b else -1), n + (a == b), f)]
            ways += [(s - 1, n, f) for s, n, f in (table[i - 1][j], table[i][j - 1]) if s > 0]
            table[i][j] = max(ways)
            if a == b and table[i][j][0] > best:
                best, where = table[i][j][0], (-table[i][j][2], j - 1, table[i][j][1])
    return where


def brute(text, least=lic.LEAST):
    """Every template against every place of the text, without index or band."""
    words = lic.words_of(text or "")
    return {(name, first, last, n) for name, t in KNOWN.items() for first, last, n in [best_local(t, words)] if n >= least * len(t)}


def fixture():
    random.seed(9)
    vocab = "the license of a work version under program may alpha beta gamma software free copy".split()
    noise = lambda n: " ".join(random.choices(vocab, k=n))
    rows = []
    for i, (name, text) in enumerate(list(lic.TEMPLATES.items()) * 6):
        words = text.split()
        for _ in range(len(words) // 12):
            words[random.randrange(len(words))] = random.choice(["x", "", "y z"])
        rows.append((i, name, noise(random.randint(0, 60)) + "\n" + " ".join(words) + " é " + noise(random.randint(0, 60))))
    return rows


def test_finds_what_brute_force_finds(docs):
    rows = fixture()
    out = {r.doc_id: r for r in lic.scan(docs([(i, t) for i, _, t in rows])).collect()}
    for i, _, t in rows:
        best = max(brute(t), key=lambda m: (m[3], m[3] / len(KNOWN[m[0]])), default=None)
        if best is None:
            assert out[i].n_licenses == 0
            continue
        got = {f.license: f for f in out[i].found}
        assert best[0] in got and abs(got[best[0]].coverage * len(KNOWN[best[0]]) - best[3]) < 1e-9
        found = got[best[0]]
        words = lic.words_of(t[found.start : found.end])
        assert words[0] == lic.words_of(t)[best[1]] and len(words) == best[2] - best[1] + 1


def test_licenses_that_hold_each_other_are_told_apart(docs):
    rows = [(i, f"Some words. {lic.TEMPLATES[name]} More words.") for i, name in enumerate(KNOWN)]
    out = {r.doc_id: [f.license for f in r.found] for r in lic.scan(docs(rows)).collect()}
    assert out == {i: [name] for i, name in enumerate(KNOWN)}


def test_one_changed_word_in_short_notices(docs):
    cases = []
    for name, text in lic.TEMPLATES.items():
        words = text.split()
        if len(words) <= 15:
            cases += [(name, " ".join([*words[:i], "other", *words[i + 1 :]])) for i in range(1, len(words) - 1)]
    rows = [(i, f"x y {t} z") for i, (_, t) in enumerate(cases)]
    out = {r.doc_id: {f.license for f in r.found} for r in lic.scan(docs(rows)).collect()}
    for i, (_, t) in enumerate(rows):
        assert out[i] == {m[0] for m in brute(t)}, t


def test_repeated_notices_and_edge_cases(docs):
    line = lic.TEMPLATES["MIT"]
    rows = [(1, None), (2, ""), (3, (line + "\n") * 50), (4, "nothing here"), (5, line.upper()), (5, line.upper()), (None, line), (6, "w " * 40000 + line)]
    out = lic.scan(docs(rows)).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and [by[i].n_licenses for i in (1, 2, 3, 4, 5, None, 6)] == [0, 0, 50, 0, 1, 1, 1]
    assert by[5].licenses == "MIT:0:30:1.0000" and by[6].found[0].start == 80000
    assert lic.scan(docs([])).collect() == []


def test_winnowing_keeps_a_gram_of_every_window():
    for words in KNOWN.values():
        kept, size = lic.winnowed(words), lic.gram_of(words)
        places = range(len(lic.grams(words, size)))
        if len(words) < lic.LONG:
            assert list(kept) == list(places)
        else:
            assert all(any(i in kept for i in range(at, at + lic.WINDOW)) for at in range(len(places) - lic.WINDOW + 1)) and len(kept) < 0.6 * len(places)
