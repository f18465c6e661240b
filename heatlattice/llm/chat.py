"""Chat formatting in a prefix tree: turns that conversations share from their start are emitted once.

Each turn is formatted by ``TEMPLATE``; inside texts and roles every character that a control string can start with is
followed by a backslash and a backslash is doubled, so that no control string can arise there and the text can be read
back. A node of the tree is a turn after all turns before it, named by a digest chained over them; equal beginnings of
conversations are thus equal nodes.

Depth-first order comes from a sort: conversations are range-sorted by their paths (16 bytes a turn), where equal
beginnings stand together, and a conversation emits the nodes that it does not share with the conversation before it.
Offsets in the packed sequence are running sums within range partitions, plus one offset a partition. A token here is
a code point of the formatted text; a node's position ids count from the start of its conversation
(``position`` to ``position + chars``), and ``ancestors`` lists the packed intervals, merged where they touch, that its
tokens attend to besides the node's own chain from ``chain`` on. The loss mask covers the texts of assistant turns.

Turns are streamed in order, one at a time, so that a conversation of any length takes bounded memory there. Turns come
by turn, role, text, nulls first; rows repeated are turns of their own. A null text is empty, a null role is the empty
role, null conv_ids make one conversation. An empty table gives empty results. Only the four named columns are read,
so other columns can have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatlattice.llm.common import _arrow, _slices
from heatlattice.storage import stored

#: Control strings before and after the text of a turn, by role; other roles are named in OTHER.
TEMPLATE = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("<|", "|>", "<|end|>")
STARTERS = r"[<\[|]"
LEARNED = "assistant"


def escape(text: str) -> str:
    return re.sub(rf"({STARTERS})", r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(rf"\\\\|({STARTERS})\\", lambda m: m[1] or "\\", text)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn's formatted text, and where its loss mask begins and ends in it."""
    if role in TEMPLATE:
        before, after = TEMPLATE[role]
    else:
        before, after = OTHER[0] + escape(role) + OTHER[1], OTHER[2]
    body = escape(text)
    ends = (len(before), len(before) + len(body)) if role == LEARNED else (0, 0)
    return before + body + after, *ends


def parsed(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    for role, (before, after) in TEMPLATE.items():
        if segment.startswith(before) and segment.endswith(after):
            return role, unescape(segment[len(before) : len(segment) - len(after)])
    role, body = segment[len(OTHER[0]) :].split(OTHER[1], 1)
    return unescape(role), unescape(body.removesuffix(OTHER[2]))


TURN = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("i", T.LongType()),
        T.StructField("node", T.BinaryType()),
        T.StructField("parent", T.BinaryType()),
        T.StructField("segment", T.StringType()),
        T.StructField("chars", T.LongType()),
        T.StructField("position", T.LongType()),
        T.StructField("loss_start", T.LongType()),
        T.StructField("loss_end", T.LongType()),
    ]
)


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns, sorted by conversation and place, with digests chained over each conversation."""
    key, i, node, position = None, 0, b"", 0
    kinds = [_arrow(f.dataType) for f in TURN]
    for batch in batches:
        for part in _slices(batch):
            out: list[list] = [[] for _ in TURN]
            for now, role, text in zip(*(part.column(c).to_pylist() for c in ("key", "role", "text")), strict=True):
                if now != key:
                    key, i, node, position = now, 0, b"", 0
                segment, start, end = formatted(role, text)
                parent, node = node, hashlib.blake2b(node + segment.encode(), digest_size=16).digest()
                for column, value in zip(out, (key, i, node, parent, segment, len(segment), position, start, end), strict=True):
                    column.append(value)
                i, position = i + 1, position + len(segment)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=TURN.names)


def key_of(conv_id):
    return F.coalesce(F.concat(F.lit("#"), conv_id.cast("string")), F.lit("null"))


def tree(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """nodes (each emitted once, with its place in the packed sequence) and members (key, i, node of every turn)."""
    empty = lambda c: F.coalesce(conversations[c].cast("string"), F.lit(""))
    turns = conversations.select(key_of(conversations[conv_col]).alias("key"), conversations[turn_col].alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    turns = stored(turns.repartition("key").sortWithinPartitions("key", "turn", "role", "text").select("key", "role", "text").mapInArrow(chained, TURN))

    paths = turns.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "node", "chars"))).alias("path"))
    paths = paths.select("key", "path.node", "path.chars").orderBy("node", "key")
    paths = stored(paths.withColumn("p", F.spark_partition_id()).withColumn("k", F.monotonically_increasing_id()))
    by_p = Window.partitionBy("p").orderBy("k")
    last = paths.groupBy("p").agg(F.max_by("node", "k").alias("last"))  # a row for each range partition
    last = last.select("p", F.lag("last").over(Window.orderBy("p")).alias("before"))
    paths = paths.join(last, "p").withColumn("previous", F.coalesce(F.lag("node").over(by_p), "before", F.array().cast("array<binary>")))
    paths = paths.withColumn("shared", F.size(F.array_intersect("node", "previous")))
    add = lambda c, what: F.expr(f"aggregate({what}, 0L, (a, x) -> a + x)").alias(c)
    chains = stored(paths.select("key", "p", "k", "shared", add("shared_chars", "slice(chars, 1, shared)"), add("all_chars", "chars")))
    new = F.col("all_chars") - F.col("shared_chars")
    sums = chains.groupBy("p").agg(F.sum(new).alias("c"))
    sums = sums.select("p", F.coalesce(F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    chains = chains.join(sums, "p").withColumn("chain", F.col("offset") + F.sum(new).over(by_p) - new).select("key", "shared", "shared_chars", "chain")

    own = turns.join(chains, "key").filter("i >= shared")
    nodes = own.select("node", "parent", F.col("i").alias("depth"), "key", "shared", "chain", (F.col("chain") + F.col("position") - F.col("shared_chars")).alias("start"), "chars", "position", "loss_start", "loss_end", "segment")
    nodes = stored(nodes)
    members = turns.select("key", "i", "node")
    above = members.join(chains.filter("shared > 0").select("key", "shared"), "key").filter("i < shared")
    above = above.join(nodes.select("node", "start", "chars"), "node").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "start", "chars"))).alias("up"))
    merged = F.expr(
        """aggregate(up, cast(array() as array<struct<start:bigint,end:bigint>>), (a, x) ->
             if(size(a) > 0 and a[size(a) - 1].end = x.start,
                concat(slice(a, 1, size(a) - 1), array(named_struct('start', a[size(a) - 1].start, 'end', x.start + x.chars))),
                concat(a, array(named_struct('start', x.start, 'end', x.start + x.chars)))))"""
    )
    nodes = nodes.join(above.select("key", merged.alias("ancestors")), "key", "left").drop("key", "shared")
    return nodes.withColumn("ancestors", F.coalesce("ancestors", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"))), members


DIGEST = T.StructType(
    [T.StructField("key", T.StringType())]
    + [T.StructField(n, T.LongType() if n != "turns_sha256" and n != "loss_sha256" else T.StringType()) for n in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")]
)


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the formatted turns, sorted by conversation and place, say when they are read back."""
    kinds = [_arrow(f.dataType) for f in DIGEST]
    key, state = None, None

    def row() -> list:
        return [key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

    for batch in batches:
        for part in _slices(batch):
            rows = []
            for now, segment, start, end in zip(*(part.column(c).to_pylist() for c in ("key", "segment", "loss_start", "loss_end")), strict=True):
                if now != key:
                    if state:
                        rows.append(row())
                    key, state = now, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parsed(segment)
                learned = unescape(segment[start:end])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(segment)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(map(list, zip(*rows, strict=True)), kinds, strict=True)], names=DIGEST.names)
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row(), kinds, strict=True)], names=DIGEST.names)


def read_back(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """key and the digests of every conversation, from the emitted nodes."""
    segments = members.join(nodes.select("node", "segment", "loss_start", "loss_end"), "node").drop("node")
    return segments.repartition("key").sortWithinPartitions("key", "i").select("key", "segment", "loss_start", "loss_end").mapInArrow(digested, DIGEST)


def digests(conversations: DataFrame, conv_col: str = "conv_id", **cols: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of every conversation."""
    out = read_back(*tree(conversations, conv_col, **cols))
    kind = conversations.schema[conv_col].dataType
    return out.select(F.when(F.col("key") != "null", F.expr("substring(key, 2)")).cast(kind).alias("conv_id"), *DIGEST.names[1:])


def oracle_sql(extra: list[tuple[int, int, str, str]]) -> str:
    """The digests straight from the table and ``extra`` rows: what reading back has to give."""
    rows = " ".join(f"UNION ALL SELECT {c}, {t}, '{r}', '{x}'" for c, t, r, x in extra)
    escaped = lambda c: f"(length({c}) + length(regexp_replace({c}, '[^<\\[|\\\\]', '', 'g')))"
    marks = " ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, (a, b) in TEMPLATE.items())
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations {rows})),
c AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{LEARNED}'), '') AS learned,
        sum({escaped("text")} + CASE role {marks} ELSE {sum(map(len, OTHER))} + {escaped("role")} END) AS chars FROM t GROUP BY conv_id)
SELECT conv_id, n AS n_turns, sha256(said) AS turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256, chars::BIGINT AS formatted_chars FROM c
"""
