import hashlib
import random
import re

import pytest

from heatlattice.llm import secrets

BASE = {"assign": (re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 6), "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20), "hex": (re.compile(r"[0-9a-f]+"), 0, 24)}


def brute(text):
    text = text or ""
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, (p, g, n)) in enumerate(BASE.items()) for m in p.finditer(text) if len(m[g]) >= n]
    return ",".join(x[2] for x in sorted(found))


def texts():
    random.seed(4)
    bits = ["password=", "Passwd: ", "SECRET = '", "token:", "api_key=\"", "APIKEY=", "tokenx", "abcdef", "AKIA", "AKIAAKIA", "ABCDEFGHIJ1234567890", "0123456789abcdef", "é", "😀", " ", "\n", "hunter22", "=", "secret:token:abcdefgh", "key", "ret"]
    return ["".join(random.choices(bits, k=random.randint(0, 25))) for _ in range(300)]


def test_against_brute_force(docs):
    rows = [*enumerate(texts()), (1000, None), (1001, ""), (None, "token=abcdefgh"), (5, "token=zzzzzz"), (5, "token=zzzzzz"), (1002, "x" * 50000 + " token=abcdef" * 900)]
    out = secrets.scan(docs(rows)).collect()
    got = sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in out)
    expect = sorted((str(i), *(brute(t).count(k + ":") for k in BASE), hashlib.sha256(brute(t).encode()).hexdigest()) for i, t in rows)
    assert got == expect
    assert {r.spans for r in out if r.doc_id == 1002} == {brute(rows[-1][1])}
    assert secrets.scan(docs([])).collect() == []


def test_added_kinds_and_redaction(docs):
    text = "a ghp_" + "A1b2" * 9 + " b -----BEGIN RSA PRIVATE KEY----- token=ghp_" + "c" * 40 + " end"
    table = docs([(1, text), (2, "plain"), (3, None)])
    rows = {r.doc_id: r for r in secrets.scan(table).collect()}
    assert (rows[1].n_github, rows[1].n_private_key, rows[1].n_assign) == (2, 1, 1)
    assert rows[1].spans.startswith("github:2:42,private_key:45:") and rows[2].spans == ""
    clean = {r.doc_id: r.text for r in secrets.redacted(table).collect()}
    assert clean == {1: "a [SECRET] b [SECRET] [SECRET] end", 2: "plain", 3: ""}


def test_any_column_name_goes_through(docs):
    table = docs([(1, "token=abcdefgh"), (None, None)]).withColumnsRenamed({"key": "found", "component": "spans", "n": "low", "lang": "row", "source": "size_hex"})
    out = secrets.redacted(table)
    assert out.columns == table.columns and sorted(map(tuple, out.collect()), key=str) == sorted([(1, "[SECRET]", None, None, 1, "x", 2), (None, "", None, None, 1, "x", 2)], key=str)
    assert sorted(r.spans for r in secrets.scan(table).collect()) == ["", "assign:0:14"]


def test_candidates_are_the_texts_whose_trigrams_satisfy_a_query(spark):
    table = spark.createDataFrame(list(enumerate(texts())), "id long, text string")
    kinds = {r.id: set(r.kinds) for r in secrets.candidates(secrets.index(table)).collect()}
    for rule in (r for r in secrets.RULES if secrets.derived(r)):
        fit = {i for i, t in enumerate(texts()) if any(all(g in t.lower() for g in s) for s in secrets.derived(rule))}
        assert fit == {i for i, k in kinds.items() if rule.kind in k}, rule.kind


@pytest.mark.parametrize("most", [0, 100_000])
def test_candidates_beyond_the_bound_are_joined_by_a_shuffle(docs, monkeypatch, most):
    from heatlattice.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    rows = [*enumerate(texts()), (7, texts()[7]), (1000, None)]
    found = secrets.scan(docs(rows))
    joins = found._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in joins) == bool(most)
    assert sorted((r.doc_id, r.base_sha256) for r in found.collect()) == sorted((i, hashlib.sha256(brute(t).encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.kind)
def test_every_match_satisfies_its_trigram_query(rule):
    sets = secrets.derived(rule)
    assert bool(sets) == (rule.kind != "hex")
    for text in [*texts(), "ghp_" + "a" * 36, "xoxb-1234567890a", "AIza" + "B" * 35, "eyJ" + "a" * 10 + ".eyJ" + "b" * 10 + ".c", "-----BEGIN PRIVATE KEY-----"]:
        if sets and re.search(rule.regex, text):
            assert any(all(g in text.lower() for g in s) for s in sets)


def test_query_of_the_assign_rule():
    sets = secrets.derived(secrets.RULES[0])
    assert frozenset({"tok", "oke", "ken"}) in sets and frozenset({"sec", "ecr", "cre", "ret"}) in sets and len(sets) == 6
