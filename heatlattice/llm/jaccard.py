"""N-gram Jaccard join by vertical partitioning of the n-gram order.

An n-gram is a 64-bit hash of its words, and the global order of n-grams is the order of the hashes. Two sets of sizes
a and b that reach the threshold t differ in at most (1 - t) / (1 + t) * (a + b) n-grams. So if the order is cut into
one fragment more than that, one fragment at least holds the same n-grams of both. How many fragments that takes
follows from the size: sizes are cut into classes whose ends have the ratio t, a set is cut by the number for its own
class and by that for the next, and any two sets that can link share a cut.

Fragments of a passage that many texts share would bring all of them together. So n-grams that a sample of texts shows to be
frequent are left out of the cut where the others suffice: if two sets that reach the threshold differ in at most d
n-grams and both have more than d infrequent ones, one of d + 1 fragments of these holds the same of both. If one has d at
most, the other has 2 d at most. So a set with more than d is cut by its infrequent n-grams, and one with up to 2 d by
all. What counts as frequent changes how many sets meet, and never which links are found.

1. Each text gives its set's size, a digest of the set, and signatures of its fragments. Equal sets are one from here.
2. Sets with an equal signature stand in one family (components of the table signature - least set). Only these can
   link. No pairs are made here, and a frequent signature is brought down to one set for each chunk of rows before
   it is shuffled.
3. The order of the n-grams of a family is cut into fragments again, each of bounded size, and a fragment is what a task
   counts: the overlaps, within it, of all pairs of two blocks of sets, as a matrix product. A block holds a bounded
   number of sets; a family of more than one block has blocks by size class, and only those of equal and neighbouring
   classes meet. Another step sums the partial overlaps of two blocks over the fragments and tests every pair. What
   leaves it is a row for each set: its links, and its root among the two blocks.
4. Components over these roots give the classes; no pair is ever written.

Two texts link when den * intersection >= num * union. A set's links are counted exactly, copies included. Texts
without words (null too) have the empty set, 0 links and are alone: their component_id is their own doc_id. A null
doc_id counts as none for the minimum; a class of nothing but null ids has a null component_id. Rows repeated are
copies. Every input row gives one row; an empty table gives an empty result. Only the id and text columns are read, so
other columns can have any name. Sets and n-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatlattice.llm.common import WORD, _arrow, checked_broadcast, free_name, id_and_text, map_rows
from heatlattice.llm.components import components
from heatlattice.storage import discard, stored

WORDS, NUM, DEN = 3, 90, 100
#: A block holds about so many sets, and a fragment about so many n-grams of it.
BLOCK_SETS, FRAGMENT_GRAMS = 1024, 1 << 18
#: (1 - 1/e) ** ENOUGH < 2 ** -64; of a cut into more fragments the first FIRST are looked at.
ENOUGH, FIRST = 97, 128
#: Texts looked at for frequent n-grams are a sixteenth of all, within these bounds; an n-gram of OFTEN of them is frequent, the most frequent MOST_FREQUENT are kept.
SAMPLE, SHARE, OFTEN, MOST_FREQUENT = (8_192, 65_536), 16, 2, 1 << 18
#: Columns of one matrix product.
COLUMNS = 4096

U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Hashes(dict):
    """Hashes of words, kept until there are too many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 1 << 16:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


HASHES = Hashes()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct n-grams of a text in their global order; fewer words than n are one n-gram."""
    found = (text or "").encode().lower().split()  # bytes: A-Z only, blanks as in WORD
    if not found:
        return np.zeros(0, dtype=U)
    h = np.fromiter(map(HASHES.__getitem__, found), dtype=U, count=len(found))
    size = min(words, len(found))
    out = np.full(len(h) - size + 1, size, dtype=U)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = mixed(out * U(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i])
    return np.unique(out)


def classes(num: int, den: int, upto: int) -> list[int]:
    """Last sizes of the size classes, from 1 on, until one exceeds ``upto`` and one more."""
    out, first = [], 1
    while len(out) < 2 or out[-2] < upto:
        out.append(max(first, first * den // num))
        first = out[-1] + 1
    return out


def size_class(n: int, num: int, den: int) -> int:
    """The class of a size; linked sets are of the same class or of neighbouring ones."""
    return next(i for i, end in enumerate(classes(num, den, n)) if n <= end)


NONE = np.zeros(0, dtype=U)


def signatures(grams: np.ndarray, num: int = NUM, den: int = DEN, frequent: np.ndarray = NONE) -> np.ndarray:
    """Numbers for filled fragments of a set, cut for its own size class and for the next. ``frequent`` is sorted.

    Linked sets may share only empty fragments, which say nothing. So while a cut has any, the set is cut again by
    another order. Fewer differences than fragments hit all of m filled ones with a chance under (1 - 1/e) ** m, and
    orders are independent: ENOUGH filled fragments in all make that less than two equal 64-bit hashes. For the same
    reason no more than the first FIRST fragments of a cut are needed.
    """
    n = len(grams)
    if not n:
        return NONE
    seldom = grams
    if len(frequent):
        seldom = grams[frequent[np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)] != grams]
    ends, own, out = classes(num, den, n), size_class(n, num, den), []
    for cls in (own, own + 1):
        differ = (den - num) * 2 * ends[cls] // (den + num)
        if len(seldom) > differ:
            out += fragments(seldom, differ + 1, 2 * cls)
        if len(seldom) <= 2 * differ:
            out += fragments(grams, differ + 1, 2 * cls + 1)
    return np.unique(np.concatenate(out))


def fragments(grams: np.ndarray, k: int, salt: int) -> list[np.ndarray]:
    """The numbers of the filled ones among the first of k fragments, in as many orders as it takes."""
    out, order, met, level = [], grams, 0, 0
    with np.errstate(over="ignore"):
        while True:
            filled = np.bincount(((order >> U(32)) * U(k) >> U(32)).astype(np.int64), minlength=k)[:FIRST] > 0
            out.append(cut(order, k, salt * 1_000_003 + level + 1)[:FIRST][filled])
            met += np.count_nonzero(filled)
            if (k <= FIRST and filled.all()) or met >= ENOUGH:
                return out
            level += 1
            order = mixed(grams + U(level))


def often(base: DataFrame, words: int) -> np.ndarray:
    """The sorted n-grams that are in several of a sample of texts; copies of a text within one task count once.

    A bounded number of texts and of n-grams is looked at. The sample goes by the texts' hashes, so it is the same in every run.
    """
    wanted = min(max(SAMPLE[0], base.count() // SHARE), SAMPLE[1])
    share = wanted / max(1, base.count())
    picked = base.select("text").filter(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if (found := hash(text)) not in seen:
                    seen.add(found)
                    yield pa.RecordBatch.from_arrays([pa.array(shingles(text, words).view(np.int64))], names=["gram"])

    counted = picked.mapInArrow(grams, "gram long").groupBy("gram").count().filter(F.col("count") >= OFTEN)
    kept = counted.orderBy(F.desc("count"), "gram").limit(MOST_FREQUENT).select("gram").toArrow()
    return np.sort(kept.column(0).to_numpy().view(U))


def cut(grams: np.ndarray, k: int, salt: int) -> np.ndarray:
    """A number for the n-grams in each of k equal fragments of the order."""
    at = ((grams >> U(32)) * U(k) >> U(32)).astype(np.int64)
    sums = np.zeros(k, dtype=U)
    np.add.at(sums, at, mixed(grams ^ U(0xD6E8FEB86659FD93)))
    return mixed(sums + mixed(np.arange(k, dtype=U) + U(salt) * U(0x9E3779B97F4A7C15)))


def digest(grams: np.ndarray) -> int:
    import xxhash

    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes()))))


def signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections."""
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    where = np.concatenate([np.full(len(g), i) for i, g in enumerate([*left, *right])] or [np.zeros(0)]).astype(np.int64)
    grams, column, counts = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    shared = counts > 1  # an n-gram of one set only overlaps with nothing
    place = np.cumsum(shared) - 1
    keep = shared[column]
    where, column = where[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    where, column = where[order], column[order]
    for first in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        width = min(COLUMNS, int(shared.sum()) - first)
        rows = np.zeros((len(left) + len(right), width), dtype=np.float32)
        rows[where[a:b], column[a:b] - first] = 1
        total += rows[: len(left)] @ rows[len(left) :].T
    return total


def roots(linked: np.ndarray) -> np.ndarray:
    """The first member of each row's component in a symmetric Boolean matrix."""
    root = np.full(len(linked), -1)
    for start in range(len(linked)):
        if root[start] < 0:
            front = np.zeros(len(linked), dtype=bool)
            front[start] = True
            while front.any():
                root[front] = start
                front = linked[front].any(0) & (root < 0)
    return root


KINDS = {"int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}


def fields(text: str) -> T.StructType:
    """A schema from "name type, ..."; types are KINDS or arrays of them."""
    kind = lambda t: T.ArrayType(KINDS[t[6:-1]]) if t.startswith("array") else KINDS[t]
    return T.StructType([T.StructField(name, kind(t)) for name, t in (x.split() for x in text.split(","))])


#: Two blocks of a family: by size class and number; the second one is the first one again, or of the next class or number.
PAIR = "family long, c long, i int, d long, j int"
MEMBER = fields("fp long, root long, links long")
SEGMENT = fields(f"{PAIR}, fragment int, second boolean, fp long, n long, copies long, grams binary")
PARTIAL = fields(f"{PAIR}, fragment int, fps array<long>, ns array<long>, copies array<long>, seconds array<boolean>, counts binary")


def grouped(keys: list[str], of: T.StructType, work: Callable[[list[dict]], list[dict]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over Arrow batches sorted by ``keys`` that calls ``work`` on the rows of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in of])
        key, now = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (at := tuple(row[k] for k in keys)) != key:
                    if now:
                        yield pa.RecordBatch.from_pylist(work(now), schema)
                    key, now = at, []
                now.append(row)
        if now:
            yield pa.RecordBatch.from_pylist(work(now), schema)

    return run


def counted(rows: list[dict]) -> list[dict]:
    """The partial overlaps of two blocks in one fragment: a packed matrix, first block by second one."""
    import zstandard

    rows = sorted(rows, key=lambda r: (r["second"], r["fp"]))
    grams = [np.frombuffer(r["grams"], dtype=U) for r in rows]
    split = sum(not r["second"] for r in rows)
    left, right = grams[:split], grams[split:]
    both = overlaps(left, left if alone(rows[0]) else right).astype(np.uint32)
    own = {k: rows[0][k] for k in ("family", "c", "i", "d", "j", "fragment")}
    lists = {"fps": "fp", "ns": "n", "copies": "copies", "seconds": "second"}
    return [own | {k: [r[v] for r in rows] for k, v in lists.items()} | {"counts": zstandard.compress(both.tobytes(), 1)}]


def alone(row: dict) -> bool:
    """Whether the two blocks are one."""
    return (row["c"], row["i"]) == (row["d"], row["j"])


def summed(parts: list[dict], num: int, den: int) -> list[dict]:
    """fp, root and links of the sets of two blocks, from their partial overlaps in all fragments."""
    import zstandard

    sets = sorted({x for p in parts for x in zip(p["seconds"], p["fps"], p["ns"], p["copies"], strict=True)})
    place = {(second, fp): at for at, (second, fp, _, _) in enumerate(sets)}
    split, n, copies = sum(not x[0] for x in sets), np.array([x[2] for x in sets]), np.array([x[3] for x in sets])
    one = alone(parts[0])
    both = np.zeros((split, split if one else len(sets) - split), dtype=np.int64)
    for p in parts:
        at = np.array([place[x] for x in zip(p["seconds"], p["fps"], strict=True)], dtype=np.int64)
        rows = at[at < split]
        columns = rows if one else at[at >= split] - split
        both[np.ix_(rows, columns)] += np.frombuffer(zstandard.decompress(p["counts"]), dtype=np.uint32).reshape(len(rows), len(columns))
    sizes = n[:split][:, None] + (n[:split] if one else n[split:])[None]
    link = den * both >= num * (sizes - both)
    if one:
        np.fill_diagonal(link, False)
    else:
        square = np.zeros((len(sets), len(sets)), dtype=bool)
        square[:split, split:], square[split:, :split] = link, link.T
        link = square
    return [{"fp": x[1], "root": sets[k][1], "links": int(m)} for x, k, m in zip(sets, roots(link), link @ copies, strict=True)]


#: Rows of signatures that are looked at together.
CHUNK = 1 << 20
SIGNED = fields("sig long, fp long, least long")


def first_of_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (sig, fp) rows, chunk by chunk: (sig, least fp) of every signature, and (null, fp, least fp) of its other sets."""
    schema = pa.schema([pa.field(f.name, pa.int64()) for f in SIGNED])

    def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        sig, fp = (np.concatenate([p.column(i).to_numpy() for p in parts]) for i in (0, 1))
        order = np.lexsort((fp, sig))
        new = np.r_[True, np.diff(sig[order]) != 0]
        least = np.empty_like(fp)
        least[order] = fp[order][np.maximum.accumulate(np.where(new, np.arange(len(sig)), 0))]
        first = np.sort(order[new])  # in the order of the rows, where equal sets stand together and pack well
        others = least != fp
        pairs = np.unique(np.c_[fp[others], least[others]], axis=0)
        mask = np.arange(len(first) + len(pairs)) >= len(first)
        sigs = pa.array(np.r_[sig[first], np.zeros(len(pairs), dtype=np.int64)], pa.int64(), mask=mask)
        leasts = pa.array(np.r_[fp[first], pairs[:, 1]], pa.int64())
        return pa.RecordBatch.from_arrays([sigs, pa.array(np.r_[fp[first], pairs[:, 0]], pa.int64()), leasts], schema=schema)

    now, size = [], 0
    for batch in batches:
        now.append(batch)
        size += batch.num_rows
        if size >= CHUNK:
            yield done(now)
            now, size = [], 0
    if size:
        yield done(now)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row."""
    light, by_set = classed(docs, id_col, text_col, words, num, den)
    out = light.select("doc_id", "n", F.when(F.col("n") > 0, F.col("fp")).alias("fp")).join(by_set, "fp", "left")
    own = F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """docs with one row of each class: that with the least id (a null id only if there is no other), then text hash.

    Rows without words are classes of their own and stay.
    """
    light, by_set = classed(docs, id_col, text_col, words, num, den)
    first = F.min(F.struct(F.col("head.doc_id").isNull().alias("none"), F.col("head.doc_id").alias("id"), F.col("head.content").alias("hash"))).alias("first")
    linked = by_set.filter("links > 0")  # sets without links have one row, which stays
    firsts = linked.join(linked.groupBy("root").agg(first), "root").select("fp", "first.id", "first.hash")
    rows = light.filter("n > 0").select("fp", "doc_id", "content").join(firsts, "fp")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("content") == F.col("hash"))
    losers = stored(rows.filter(~same).select(F.col("doc_id").alias("loser"), F.col("content").alias("hash")).distinct())
    content = free_name("content", docs.columns)
    at = docs.withColumn(content, F.xxhash64(docs[text_col].cast("string")))
    kept = at.join(checked_broadcast(losers, losers.count()), at[id_col].eqNullSafe(losers.loser) & (at[content] == losers.hash), "left_anti")
    if not rows.filter(same).groupBy("doc_id", "content").count().filter("count > 1").isEmpty():  # rows of one id and text
        worded = F.coalesce(docs[text_col].cast("string").rlike(WORD), F.lit(False))
        kept = kept.filter(worded).dropDuplicates([id_col, content]).unionByName(kept.filter(~worded))
    return kept.drop(content)


def classed(docs: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, content, n and fp of every row; and of every set fp with words: root of its class, class_id, links, head."""
    base = id_and_text(docs, id_col, text_col)
    frequent = docs.sparkSession.sparkContext.broadcast(often(base, words))  # MOST_FREQUENT numbers at most

    def sets(texts: list) -> list[list]:
        grams = [shingles(t, words) for t in texts]
        return [[len(g) for g in grams], [digest(g) for g in grams], [size_class(len(g), num, den) if len(g) else None for g in grams], [signed(signatures(g, num, den, frequent.value)) for g in grams]]

    made = list(fields("n long, fp long, c long, sigs array<long>"))
    keyed = base.select(F.struct("doc_id", F.xxhash64("text").alias("content")).alias("row"), "text")
    signed_rows = stored(map_rows(keyed, "row", made, sets).select("row.doc_id", "row.content", "n", "fp", "c", "sigs"))
    light = stored(signed_rows.drop("sigs"))
    filled = light.filter("n > 0")

    # 2. families of sets with equal signatures; of a frequent one, each chunk of rows sends on one set
    local = signed_rows.filter("n > 0").select(F.explode("sigs").alias("sig"), "fp").mapInArrow(first_of_chunk, SIGNED)
    least = F.first("fp").over(Window.partitionBy("sig").orderBy("fp"))
    across = local.filter("sig is not null").withColumn("b", least).filter("fp <> b").select(F.col("fp").alias("a"), "b")
    family = components(local.filter("sig is null").select(F.col("fp").alias("a"), F.col("least").alias("b")).unionByName(across))
    family = stored(family.select(F.col("node").alias("fp"), F.col("root").alias("family")))
    del local, across  # the signatures are the greatest table here, and done with
    discard(signed_rows)

    # 3. overlaps by fragment, of all pairs of blocks of a family that can link
    heads = filled.groupBy("fp").agg(F.min_by(F.struct("doc_id", "content"), F.struct(F.col("doc_id").isNull(), "doc_id", "content")).alias("head"), F.first("n").alias("n"), F.first("c").alias("c"), F.count("*").alias("copies"), F.min("doc_id").alias("least_id"))
    heads = stored(heads.select("fp", "head.doc_id", "head.content", "n", "c", "copies", "least_id"))
    within = stored(heads.join(checked_broadcast(family, family.count()), "fp"))
    by_class = within.groupBy("family", "c").agg(F.count("*").alias("sets"), F.sum("n").alias("grams"))
    in_all = by_class.groupBy("family").agg(F.sum("sets").alias("sets"), F.sum("grams").alias("grams"), F.map_from_entries(F.collect_list(F.struct("c", F.ceil(F.col("sets") / BLOCK_SETS).cast("int").alias("blocks")))).alias("blocks"))  # an entry a size class
    whole = F.col("sets") <= BLOCK_SETS
    in_block = F.least(F.lit(1.0), F.lit(BLOCK_SETS) / F.col("sets")) * F.col("grams")
    sizes = stored(in_all.select("family", F.when(~whole, F.col("blocks")).alias("blocks"), F.ceil(in_block / FRAGMENT_GRAMS).cast("int").alias("fragments")))
    within = within.join(checked_broadcast(sizes, sizes.count()), "family")
    at = F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("fp"), F.element_at("blocks", F.col("c")))).cast("int")
    within = stored(within.select("fp", "family", F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(F.col("c")).cast("long").alias("c"), at.alias("block"), "blocks", "fragments", "n", "copies", F.col("doc_id").alias("id"), F.col("content").alias("hash")))
    wanted = checked_broadcast(within, within.count())
    texts = base.join(wanted, base.doc_id.eqNullSafe(wanted.id) & (F.xxhash64(base.text) == wanted.hash)).dropDuplicates(["fp"])
    texts = texts.select(F.struct("fp", "family", "c", "block", "blocks", "fragments", "n", "copies").alias("row"), base.text.alias("text"))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row", _arrow(texts_row)), ("segments", pa.list_(pa.struct([("fragment", pa.int32()), ("grams", pa.binary())])))])
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                piece, out = batch.slice(part, 256), []
                for count, text in zip(piece.column("row").field("fragments").to_pylist(), piece.column("text").to_pylist(), strict=True):
                    grams = shingles(text, words)
                    ends = np.searchsorted(((grams >> U(32)) * U(count) >> U(32)).astype(np.int64), np.arange(count + 1))
                    out.append([{"fragment": f, "grams": grams[a:b].tobytes()} for f, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if a < b])
                yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array(out, schema.field(1).type)], schema=schema)

    texts_row = texts.schema["row"].dataType
    cut_schema = T.StructType([texts.schema["row"], T.StructField("segments", T.ArrayType(fields("fragment int, grams binary")))])
    segments = texts.mapInArrow(cut_up, cut_schema).select("row.*", F.explode("segments").alias("s")).select("*", "s.fragment", "s.grams")
    # the blocks that a block meets: the rest of its class, and those of the class before and behind
    own = F.expr("if(blocks is null, array(0), sequence(0, element_at(blocks, c) - 1))")
    other = lambda c: F.expr(f"if(coalesce(try_element_at(blocks, {c}), 0) = 0, cast(array() as array<int>), sequence(0, try_element_at(blocks, {c}) - 1))")
    one = F.transform(own, lambda x: F.struct(F.col("c").alias("c"), F.least("block", x).alias("i"), F.col("c").alias("d"), F.greatest("block", x).alias("j"), (F.col("block") > x).alias("second")))
    behind = F.transform(other("c + 1"), lambda x: F.struct(F.col("c").alias("c"), F.col("block").alias("i"), (F.col("c") + 1).alias("d"), x.alias("j"), F.lit(False).alias("second")))
    before = F.transform(other("c - 1"), lambda x: F.struct((F.col("c") - 1).alias("c"), x.alias("i"), F.col("c").alias("d"), F.col("block").alias("j"), F.lit(True).alias("second")))
    dealt = segments.select("family", F.explode(F.concat(one, behind, before)).alias("p"), "fragment", "fp", "n", "copies", "grams")
    dealt = dealt.select("family", "p.c", "p.i", "p.d", "p.j", "fragment", "p.second", "fp", "n", "copies", "grams")
    pair = [f.name for f in fields(PAIR)]
    dealt = dealt.repartition(*pair, "fragment").sortWithinPartitions(*pair, "fragment")
    partial = dealt.mapInArrow(grouped([*pair, "fragment"], PARTIAL, counted), PARTIAL).repartition(*pair).sortWithinPartitions(*pair)
    found = stored(partial.mapInArrow(grouped(pair, MEMBER, lambda parts: summed(parts, num, den)), MEMBER))

    # 4. classes, and what every row gets of its set
    linked = components(found.filter("fp <> root").select(F.col("fp").alias("a"), F.col("root").alias("b")))
    linked = stored(linked.select(F.col("node").alias("fp"), "root"))
    ids = linked.join(heads.select("fp", "least_id"), "fp").groupBy("root").agg(F.min("least_id").alias("class_id"))
    links = found.groupBy("fp").agg(F.sum("links").alias("links"))
    of_class = linked.join(ids, "root").select("fp", "root", "class_id")
    by_set = heads.join(of_class, "fp", "left").join(links, "fp", "left")
    by_set = by_set.select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("class_id", "least_id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.struct("doc_id", "content").alias("head"))
    return light, stored(by_set)  # as a table, so that joins with it can split a frequent set


#: The same rows in SQL, every two documents that share an n-gram compared.
ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, unnest(list_distinct(CASE WHEN len(w) >= {WORDS} THEN list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM d),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE {DEN} * c >= {NUM} * (x.n + y.n - c)),
t AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rid AS x, rid AS y FROM d UNION SELECT r.x, t.b FROM r JOIN t ON t.a = r.y),
c AS (SELECT x AS rid, min(doc_id) AS component_id FROM r JOIN d ON d.rid = y GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, (SELECT count(*) FROM t WHERE t.a = d.rid) AS n_links
FROM d JOIN c USING (rid) LEFT JOIN n USING (rid)
"""
