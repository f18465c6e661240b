import duckdb
import pytest

from heatlattice.llm import mixing


def run(docs, rows):
    return mixing.mix(docs([(i, t, None, s) for i, t, s in rows])).collect()


def test_matches_sql_with_ties_nulls_and_repeats(docs):
    rows = [(i, "w " * (i % 13), f"s{i % 5}") for i in range(200)] + [(7, "w " * 7, "s2")] * 3 + [(None, "a b", None), (9, None, None), (10, "", "empty")]
    out = run(docs, rows)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    cols = ["doc_id", "size", "source_size", "target", "taken", "repeats", "source"]
    got = sorted(map(str, ([r[c] for c in cols] for r in out)))
    assert got == sorted(map(str, map(list, con.sql(mixing.ORACLE_SQL).fetchall())))


def test_targets_are_met_and_capped(docs):
    rows = [(i, "w " * (1 + i % 9), "big" if i % 3 else f"s{i % 4}") for i in range(3000)]
    out = run(docs, rows)
    total = sum(r["size"] for r in out)
    by = {r.source: (r.target, r.source_size) for r in out}
    assert sum(t for t, _ in by.values()) == pytest.approx(total)
    for s, (t, size) in by.items():
        assert t <= 3 * size
        assert abs(sum(r.taken for r in out if r.source == s) - t) <= 9
    assert all(r.taken <= 3 * r["size"] and r.taken == r["size"] * r.repeats for r in out)


def test_many_sources_reach_the_fixed_point(docs):
    rows = [(i, "w " * (1 + (i * i) % 50), f"s{i % 97}") for i in range(500)]
    out = run(docs, rows)
    level = max(r.target for r in out if r.target < 3 * r.source_size)
    assert level > 0 and sum({r.source: r.target for r in out}.values()) == pytest.approx(sum(r["size"] for r in out))


def test_empty_and_wordless(docs):
    assert run(docs, []) == []
    assert [(r["size"], r.taken, r.target) for r in run(docs, [(1, None, "a"), (2, " ", None)])] == [(0, 0, 0.0), (0, 0, 0.0)]
