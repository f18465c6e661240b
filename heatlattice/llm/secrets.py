"""Secret scans by a trigram inverted index; DataFrame functions only.

A Boolean trigram query is derived from each rule's regular expression: an OR of sets of trigrams (of the expression in
lower case), one of which any match must contain whole. A text is a candidate of a rule if the trigrams of one set all
occur in it, and only candidates are verified by the expression itself. A rule without mandatory trigrams scans every
text. All of this is a filter in front of the exact search, so it loses nothing.

``index`` makes the postings: a row for each trigram of a set and each text, by a hash of it, that holds this and the
rarer ones. ``candidates`` intersects the postings of each set, as bits that are summed before the shuffle, and gives the
rules whose query a text satisfies. Their table (hashes and names of rules, no texts) meets the texts again: it is
broadcast while it has few rows, so that no text is shuffled, and beyond that bound texts are joined by the hash once.
Texts of equal hash share candidates, which can only add some. Rules without a query scan in the same pass.

Spans are counted in code points, end exclusive, found leftmost and without overlap for each rule, and listed by start,
then by the rules' order. They follow from the lengths of the matches and of the gaps that the expression splits off,
by running sums in blocks of ``BLOCK`` matches, so that many matches in one text do not cost their square.

Null counts as the empty text: no spans, the digest of nothing. Every input row gives one row; an empty table gives an
empty result. Only the id and text columns are read, so other columns can have any name.
"""

from __future__ import annotations

import dataclasses
import functools
import itertools
import re._parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatlattice.llm.common import checked_broadcast, quoted
from heatlattice.storage import stored

BLOCK = 256
#: So many strings of one part of an expression are followed up at most.
MOST = 64


@dataclasses.dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    #: Group whose length counts, and its least length; matches below it are dropped, yet use up their text.
    group: int = 0
    least: int = 0
    #: Whether the rule is one of the base rules.
    base: bool = False


# The patterns of the base rules, and public token formats.
RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]


def strings(op: object, arg: object) -> set[str] | None:
    """All strings that a part of an expression can match, if they are few; else None."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg)}
    if name == "IN":
        out: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                out.add(chr(value))
            elif str(kind) == "RANGE" and value[1] - value[0] < MOST:
                out |= {chr(c) for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if name == "SUBPATTERN":
        return of_sequence(arg[-1])
    if name == "BRANCH":
        parts = [of_sequence(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if name == "MAX_REPEAT" and arg[1] <= 4:
        inner = of_sequence(arg[2])
        if inner is not None:
            out = {"".join(x) for n in range(arg[0], arg[1] + 1) for x in itertools.islice(itertools.product(inner, repeat=n), MOST + 1)}
            return out if len(out) <= MOST else None
    return None


def of_sequence(items: object) -> set[str] | None:
    out = {""}
    for op, arg in items:
        more = strings(op, arg)
        if more is None or len(out) * len(more) > MOST:
            return None
        out = {a + b for a in out for b in more}
    return out


def both(a: list[frozenset], b: list[frozenset]) -> list[frozenset]:
    return simplest([x | y for x in a for y in b])


def simplest(sets: list[frozenset]) -> list[frozenset]:
    """Without the sets that hold another one."""
    sets = sorted(set(sets), key=lambda s: (len(s), sorted(s)))
    return [s for i, s in enumerate(sets) if not any(t <= s for t in sets[:i])]


def trigrams(run: set[str]) -> list[frozenset]:
    return simplest([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in {x.lower() for x in run}])


def query(items: object) -> list[frozenset]:
    """OR of sets of trigrams, one of which every match contains; a sole empty set stands for no condition."""
    out, run = [frozenset()], {""}
    for op, arg in items:
        more = strings(op, arg)
        if more is not None and len(run) * len(more) <= MOST:
            run = {a + b for a in run for b in more}
            continue
        out, run = both(out, trigrams(run)), {""}
        if more is not None:
            run = more
        elif str(op) == "SUBPATTERN":
            out = both(out, query(arg[-1]))
        elif str(op) == "BRANCH":
            out = both(out, simplest([s for x in arg[1] for s in query(x)]))
        elif str(op) == "MAX_REPEAT" and arg[0] > 0:
            out = both(out, query(arg[2]))
    return both(out, trigrams(run))


def derived(rule: Rule) -> list[frozenset]:
    """The rule's trigram query, empty if it has no mandatory trigrams."""
    sets = query(parser.parse(rule.regex))
    return [] if frozenset() in sets else sets


def clauses(rules: list[Rule]) -> list[tuple[str, int, list[str]]]:
    """kind, number and trigrams of every set of the rules' queries."""
    return [(r.kind, n, sorted(s)) for r in rules for n, s in enumerate(derived(r))]


#: Letters from the most to the least frequent; a trigram with a late one is taken to be rare.
LETTERS = "etaoinshrdlucmfwypvbgkjqxz"


def rare_first(grams: list[str]) -> list[str]:
    return sorted(grams, key=lambda g: (-max(LETTERS.find(c) if c in LETTERS else len(LETTERS) for c in g), g))


def index(texts: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The postings: gram and id of the trigrams of the rules' queries and every text (id, text) that holds them.

    A set's trigrams go from rare to frequent, and one is only posted for texts that have those before it: the others
    leave the intersection there, so most texts are looked through once for each set.
    """
    low = texts.select("id", F.lower("text").alias("low"))  # apart, or it is worked out for each trigram
    none = F.array().cast("array<string>")

    def posted(grams: list[str]) -> Column:
        out = none
        for g in reversed(rare_first(grams)):
            out = F.when(F.col("low").contains(g), F.concat(F.array(F.lit(g)), out)).otherwise(none)
        return out

    present = low.select("id", F.array_distinct(F.concat(*(posted(s) for _, _, s in clauses(rules)))).alias("grams"))
    return present.select(F.explode("grams").alias("gram"), "id")


def candidates(postings: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """id and kinds: the rules whose trigram query the postings of an id satisfy; rules without one are not listed."""
    rows = [(g, k, n, 1 << i, (1 << len(s)) - 1) for k, n, s in clauses(rules) for i, g in enumerate(s)]  # as many as the rules have trigrams
    wanted = postings.sparkSession.createDataFrame(rows, "gram string, kind string, clause int, bit long, every long")
    found = postings.join(F.broadcast(wanted), "gram").groupBy("id", "kind", "clause", "every").agg(F.bit_or("bit").alias("bits")).filter("bits = every")
    return found.groupBy("id").agg(F.collect_set("kind").alias("kinds"))


def spans(rule: Rule, text: Column) -> Column:
    """array<struct<gap, own, kept>> of one rule's matches in a text, null without any, or of a null text."""
    regex, kept = rule.regex, None
    if rule.group == 0 and rule.least:  # dropped matches cannot hide a longer one here: a run is taken whole or not at all
        fixed = len(rule.regex.split("[")[0])
        regex = f"{rule.regex.removesuffix('+')}{{{rule.least - fixed},}}"
    matches = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    if rule.group and rule.least:
        kept = F.transform(F.regexp_extract_all(text, F.lit(regex), F.lit(rule.group)), lambda x: F.char_length(x) >= rule.least)
    found = F.when(F.size(matches) > 0, matches)
    gaps = F.split(F.when(found.isNotNull(), text), regex, -1)
    size = F.transform(found, lambda x, i: F.struct(F.char_length(F.get(gaps, i)).alias("gap"), F.char_length(x).alias("own"), (F.get(kept, i) if kept is not None else F.lit(True)).alias("kept")))
    return size


def placed(sizes: str, order: int, kind: str) -> Column:
    """Spans from the sizes of gaps and matches: running sums within blocks, and of blocks."""
    total = "x -> x.gap + x.own"
    add = "0, (a, x) -> a + x"
    blocks = f"transform(sequence(0, (size({sizes}) - 1) div {BLOCK}), b -> transform(slice({sizes}, b * {BLOCK} + 1, {BLOCK}), {total}))"
    sums = f"transform({blocks}, l -> aggregate(l, {add}))"
    one = (
        f"flatten(transform(sequence(0, (size({sizes}) - 1) div {BLOCK}), b -> flatten(transform(array(aggregate(slice(sums, 1, b), {add})), "
        f"base -> transform(slice({sizes}, b * {BLOCK} + 1, {BLOCK}), (m, i) -> named_struct('start', base + aggregate(slice(blocks[b], 1, i), {add}) + m.gap, "
        f"'order', {order}, 'kind', '{kind}', 'end', base + aggregate(slice(blocks[b], 1, i), {add}) + m.gap + m.own, 'kept', m.kept))))))"
    )
    whole = f"flatten(transform(array({blocks}), blocks -> flatten(transform(array({sums.replace(blocks, 'blocks')}), sums -> {one}))))"
    return F.expr(f"if({sizes} is null, cast(array() as array<struct<start:int,order:int,kind:string,end:int,kept:boolean>>), filter({whole}, s -> s.kept))")


def located(base: DataFrame, rules: list[Rule]) -> DataFrame:
    """base (with text, never null, and no other column called id, kinds, text_*, size_* or found) and found: its spans by start."""
    keyed = base.withColumn("id", F.xxhash64("text"))
    chosen = stored(candidates(index(keyed.select("id", "text"), rules), rules))
    rows = keyed.join(checked_broadcast(chosen, chosen.count()), "id", "left").drop("id")
    # one step after the other, so that nothing is worked out twice and only candidates meet an expression
    may = lambda r: F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)) if derived(r) else F.lit(True)
    rows = rows.withColumns({f"text_{r.kind}": F.when(may(r), F.col("text")) for r in rules}).drop("kinds")
    rows = rows.withColumns({f"size_{r.kind}": spans(r, F.col(f"text_{r.kind}")) for r in rules}).drop(*(f"text_{r.kind}" for r in rules))
    each = [placed(f"size_{r.kind}", order, r.kind) for order, r in enumerate(rules)]
    none = functools.reduce(Column.__and__, (F.col(f"size_{r.kind}").isNull() for r in rules))
    found = F.when(~none, F.array_sort(F.concat(*each)))
    rows = rows.withColumn("found", F.coalesce(found, F.expr("cast(array() as array<struct<start:int,order:int,kind:string,end:int,kept:boolean>>)")))
    return rows.drop(*(f"size_{r.kind}" for r in rules))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """doc_id, n_<kind> of the base rules, base_sha256, spans, n_<kind> of the others, and found (array of start, order, kind, end, kept) of every row."""
    rows = located(docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")), rules)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    in_base = F.filter("found", lambda s: s.order.isin([i for i, r in enumerate(rules) if r.base]))
    counts = lambda base: [F.expr(f"cast(size(filter(found, s -> s.order = {i})) AS long)").alias(f"n_{r.kind}") for i, r in enumerate(rules) if r.base == base]
    return rows.select("doc_id", *counts(True), F.sha2(listed(in_base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), *counts(False), "found")


def redacted(docs: DataFrame, text_col: str = "text", rules: list[Rule] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with each maximal stretch of spans in its texts replaced by ``mark``; a null text becomes the empty one."""
    # all columns in one, so that none can clash with an own one
    rows = located(docs.select(F.struct(*quoted(docs.columns)).alias("row"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")), rules)
    # spans come by start; the running greatest end tells where a stretch ends
    pieces = F.expr(
        f"""aggregate(found, named_struct('at', 0, 'out', cast(array() as array<string>)),
              (a, s) -> if(s.end <= a.at, a, named_struct('at', s.end, 'out', concat(a.out,
                array(if(s.start >= a.at, concat(substring(text, a.at + 1, s.start - a.at), '{mark}'), ''))))),
              a -> concat(array_join(a.out, ''), substring(text, a.at + 1)))"""
    )
    clean = rows.select("row", F.when(F.size("found") > 0, pieces).otherwise(F.col("text")).alias("text"))
    return clean.select(*(F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))


def oracle_sql(rules: list[Rule] = RULES) -> str:
    """The same rows in DuckDB, every text scanned by every rule."""
    quoted = lambda s: s.replace("'", "''")
    d = "SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents"
    parts = []
    for order, r in enumerate(rules):
        regex = quoted(r.regex)
        parts.append(
            f"""SELECT rid, {order} AS o, '{r.kind}' AS kind, i, m, g[i] AS g,
                       list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS start
                FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i, ms[i] AS m FROM (
                  SELECT rid, regexp_extract_all(text, '{regex}') AS ms, regexp_extract_all(text, '{regex}', {r.group}) AS g, string_split_regex(text, '{regex}') AS gaps FROM d))
                WHERE length(g[i]) >= {r.least}"""
        )
    counts = ", ".join(f"count(*) FILTER (o = {i}) AS n_{r.kind}" for i, r in enumerate(rules))
    base = ", ".join(str(i) for i, r in enumerate(rules) if r.base)
    span = "kind || ':' || start::BIGINT || ':' || (start + length(m))::BIGINT"
    return f"""
WITH d AS ({d}), s AS ({' UNION ALL '.join(parts)})
SELECT doc_id, {counts},
       sha256(coalesce(string_agg({span}, ',' ORDER BY start, o) FILTER (o IN ({base})), '')) AS base_sha256,
       coalesce(string_agg({span}, ',' ORDER BY start, o) FILTER (o IS NOT NULL), '') AS spans
FROM d LEFT JOIN s USING (rid) GROUP BY rid, doc_id"""
