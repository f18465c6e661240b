import math
import random
import re
import statistics

import zstandard

from heatlattice.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    lines = text.split("\n")
    dups = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(marked), len(words) < 50 or 100 * len(marked) > 50 * len(words)]


def prose(n, seed):
    random.seed(seed)
    return " ".join("".join(random.choices("etaoinshrdlu", k=random.randint(2, 9))) for _ in range(n))


def test_counts_against_brute_force(docs):
    random.seed(1)
    texts = [" ".join(random.choices(["a", "b", "c#", "é x", "<d>"], k=k)) for k in (0, 1, 2, 3, 8, 60, 80)]
    texts += [None, "", "\n\n", "x\ny\nx\n \n \nx", "a\x0bb\x1cc\td", "one two three one two three one two", prose(400, 1)]
    out = {r.doc_id: r for r in quality.judge(docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert [out[i][c.name] for c in quality.FIELDS[:6]] == brute(t), t
    assert quality.judge(docs([])).collect() == []


def test_verdicts(docs):
    random.seed(2)
    noise = " ".join("".join(chr(random.randint(0x4E00, 0x9FFF)) for _ in range(6)) for _ in range(400))
    half = prose(800, 3) + " " + " ".join(f"{i % 7}spam{i // 7 % 3}" for i in range(1500))
    texts = [prose(60, 1), prose(5000, 2), "buy now " * 400, noise, half, prose(3, 3), None]
    out = {r.doc_id: r for r in quality.judge(docs([*enumerate(texts), (0, texts[0])])).collect()}
    assert [out[i].kept for i in range(7)] == [True, True, False, False, False, False, False]
    assert out[3].base_failed is False and out[4].n_bad_chunks > 0 and out[6].ratio is None


def test_the_rest_after_whole_chunks_is_judged(docs):
    random.seed(5)
    fine = prose(2000, 4)
    tail = "".join(random.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=2047))
    texts = [fine[:4095], fine[:2048] + tail, *(fine[:n] for n in (300, 2048, 2049, 4096, 4097))]
    out = {r.doc_id: r for r in quality.judge(docs(list(enumerate(texts))), limits=quality.Limits({}, {})).collect()}
    assert out[0].kept and (out[0].n_chunks, out[0].n_bad_chunks) == (2, 0)
    assert 1.4 < out[1].ratio < 3.2 and not out[1].kept and not out[1].base_failed and (out[1].n_chunks, out[1].n_bad_chunks) == (2, 1)
    assert [out[i].n_chunks for i in range(2, 7)] == [1, 1, 2, 2, 3]


def brute_kept(texts):
    """1 kept, 0 rejected, None too close to a limit to tell, of texts that are distinct; medians without steps."""
    size = lambda raw: len(raw) / len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(raw))
    spread = lambda xs: 1.4826 * statistics.median(abs(x - statistics.median(xs)) for x in xs)
    raws = [(t or "").encode() for t in texts]
    parts = [[raw] if len(raw) <= 2048 else [raw[i : i + 2048] for i in range(0, len(raw) - 2047, 2048)] + ([raw[-2048:]] if len(raw) % 2048 else []) for raw in raws]
    logs = [math.log(size(raw)) if raw else None for raw in raws]
    chunks = [[math.log(size(x)) for x in p if x] for p in parts]
    good = [i for i, t in enumerate(texts) if not brute(t)[5]]
    groups = {}
    for i in good:
        groups.setdefault(int(math.log2(len(raws[i])) * 2 // 1), []).append(logs[i])
    groups = {c: x for c, x in groups.items() if len(x) >= 30}
    of_chunk = [x for i in good if len(raws[i]) >= 2048 for x in chunks[i]]
    outer = {256: (1.05, 3.0), 1024: (1.4, 3.2), 4096: (1.5, 3.6), 16384: (1.55, 4.0), 65536: (1.55, 5.0)}

    def far(log, n, chunk):
        """How far outside (above 0) or inside the limits."""
        if n < 256:
            return -1
        low, high = outer[max(b for b in outer if b <= n)]
        worst = max(math.log(low) - log, log - math.log(high))
        if chunk:
            return max(worst, abs(log - statistics.median(of_chunk)) - 6 * max(0.01, spread(of_chunk))) if len(of_chunk) >= 30 else worst
        c = int(math.log2(n) * 2 // 1)
        near = min(groups, key=lambda d: (abs(d - c), d), default=None)
        if near is None:
            return worst
        around = statistics.median([spread(x) for d, x in groups.items() if abs(d - near) <= 2])
        return max(worst, abs(log - statistics.median(groups[near])) - 6 * max(0.01, around) - 0.1 * abs(c - near))

    out = []
    for i in range(len(texts)):
        if i not in good:
            out.append(0)
            continue
        n = len(raws[i])
        whole, each = far(logs[i], n, False), [far(x, 2048, True) if n >= 2048 else far(x, n, False) for x in chunks[i]]
        near = any(abs(x) < 0.01 for x in [whole, *each])
        out.append(None if near else int(whole <= 0 and sum(x > 0 for x in each) <= 0.2 * len(each)))
    return out


def test_kept_against_brute_force(docs):
    random.seed(7)
    odd = [prose(200, 900) + " " + "".join(random.choices("0123456789ABCDEF", k=900)), " ".join(f"{w}###" for w in prose(400, 901).split()), prose(900, 902) + " ".join(f" | {w}" for w in prose(600, 903).split())]
    texts = [prose(random.choice([60, 90, 200, 230, 500, 900]), i) for i in range(300)] + odd + [prose(9000, 904), "short", None]
    rows = list(enumerate(texts)) + [(1000 + i, texts[0]) for i in range(400)]  # copies count once
    out = {r.doc_id: r.kept for r in quality.judge(docs(rows)).collect()}
    brutes = brute_kept(texts)
    assert [out[i] for i, b in enumerate(brutes) if b is not None] == [bool(b) for b in brutes if b is not None]
    assert sum(b is None for b in brutes) < 30 and all(out[i] for i in range(300) if brutes[i] is not None)
    assert not any(out[300 + i] for i in range(len(odd)))
