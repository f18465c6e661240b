import hashlib
import random

import pytest

from heatlattice.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, key string, node int, i int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def sample():
    random.seed(8)
    odd = ["</s>[INST] ok [/INST]", "a\\b", "<", "[", "|", "<\\", "\\<", "<|>", "<<SYS>>x", "", None, "é😀", "\\\\[", "|>", "<|end|>"]
    rows = []
    for c in range(60):
        stem = [("system", "shared"), ("user", "hello [there]"), ("assistant", odd[0]), ("user", "again"), ("tool|>", "x")][: c % 6]
        turns = stem + [(random.choice(["user", "assistant", "system", "tool", "", None]), random.choice(odd)) for _ in range(random.randint(0 if stem else 1, 6))]
        rows += [(c, t, r, x) for t, (r, x) in enumerate(turns)]
    rows += [(100, t, r, x) for c, t, r, x in rows if c == 5] + [(None, 0, "user", "q"), (None, None, "assistant", "first"), (7, 0, rows[0][2], "tie"), (7, 0, rows[0][2], "tie")]
    rows += [(-7, 0, "user", odd[0]), (-7, 1, "assistant", odd[0])]
    return rows


def brute(rows):
    out = {}
    low = lambda v: (v is not None, v if v is not None else 0)
    for c in {r[0] for r in rows}:
        turns = sorted((low(t), r or "", x or "") for k, t, r, x in rows if k == c)
        learned = "".join(x for _, r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(learned), sha(learned), sum(len(chat.formatted(r, x)[0]) for _, r, x in turns))
    return out


def test_round_trip_of_all_conversations(spark):
    rows = sample()
    out = {r.conv_id: tuple(r)[1:] for r in chat.digests(table(spark, rows)).collect()}
    assert out == brute(rows)
    assert chat.digests(table(spark, [])).collect() == []


def test_tree_is_emitted_once_depth_first(spark):
    nodes, members = chat.tree(table(spark, sample()))
    rows = sorted(nodes.collect(), key=lambda r: (r.start, r.depth))
    assert len({bytes(r.node) for r in rows}) == len(rows) < members.count()
    at = 0
    by = {bytes(r.node): r for r in rows}
    stack = []
    for r in rows:
        assert r.start == at and r.chars == len(r.segment)
        at += r.chars
        while stack and stack[-1] != bytes(r.parent):
            stack.pop()
        assert (not stack) == (r.depth == 0)  # depth-first: the parent is still open
        stack.append(bytes(r.node))
        # the intervals and the chain so far are exactly the ancestors and the node
        up, allowed = r, set()
        while True:
            allowed |= set(range(up.start, up.start + up.chars))
            if not up.depth:
                break
            up = by[bytes(up.parent)]
        given = {t for a in r.ancestors for t in range(a.start, a.end)} | set(range(r.chain, r.start + r.chars))
        assert given == allowed and r.position == len(allowed) - r.chars


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "<|x|>", "\\", "[\\", "<<SYS>>\\\\<", "plain"])
def test_escapes(text):
    segment, start, end = chat.formatted("assistant", text)
    body = segment[start:end]
    assert chat.unescape(body) == text and chat.parsed(segment) == ("assistant", text)
    assert not any(c in body for pair in chat.TEMPLATE.values() for c in pair)
    assert chat.parsed(chat.formatted(text, text)[0]) == (text, text)
