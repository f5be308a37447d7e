"""Chat formatting of reply trees.

Messages form trees (each names its parent). Iterated self-joins double the reach of a pointer table
(parent, grandparent, 4th, 8th ancestor, ...): after log2(depth) joins every message knows its root and the summed
score of its branch. Leaves are ranked by that score within their tree, and the chosen leaves walk up the same tables
from the longest jump to the shortest, which gives every message of a path exactly once. Each path is formatted as one
conversation.

Joins are on (tree, message), so a tree that holds a third of all rows is spread over all tasks; pointers that have
reached their root leave the join. Only the messages of one path meet in one row, as they do in the output.

Template: ``<|im_start|>role LF text <|im_end|> LF`` for each turn. Control strings inside texts are escaped
reversibly: ``<|`` with k backslashes between becomes the same with k + 1. Roles have line feeds and backslashes
escaped besides. The loss mask is a list of code point spans over the formatted text: the texts of the assistant.

Defined results: null texts and roles are empty; rows without a tree are one tree; a message whose parent is missing is a root; messages on or below a
cycle have no root and are left out; messages that repeat an id are ordered by role, text and score and hang one below
the other, so the first answers their parents' message and replies to the id answer the last (where they name several
parents, the first's counts); null scores count 0; ties of score go to the longer, then to the lower leaf; empty tables
give empty tables.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.llm.common import discard, stored, table

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = f"{END}{START}assistant ok"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the code point spans under the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


# --- trees ---------------------------------------------------------------------------------------------------------


def jumps(nodes: DataFrame) -> list[DataFrame]:
    """Tables k = 0, 1, ...: (tree, id, anc: the 2^k-th ancestor or null, top: the highest known, score and steps so far).

    ``nodes``: tree, id, parent, score. The last table has no ancestors left, or only those on cycles.
    """
    known = nodes.select("tree", F.col("id").alias("parent"), F.lit(True).alias("there"))
    first = nodes.join(known, ["tree", "parent"], "left").select(
        "tree", "id", F.when(F.col("there"), F.col("parent")).alias("anc"), F.coalesce(F.when(F.col("there"), F.col("parent")), F.col("id")).alias("top"), F.col("score").alias("total"), F.lit(0).alias("below")
    )
    first = first.withColumn("below", F.when(F.col("anc").isNotNull(), 1).otherwise(0))
    tables, n = [stored(first, "jump")], None
    while not tables[-1].filter(F.col("anc").isNotNull()).isEmpty():
        if n is None:
            n = tables[0].count()
        if 2 ** (len(tables) - 1) > n:
            break  # only cycles are left
        t = tables[-1]
        up = t.select("tree", F.col("id").alias("anc"), F.col("anc").alias("anc2"), F.col("top").alias("top2"), F.col("total").alias("total2"), F.col("below").alias("below2"))
        moved = (
            t.filter(F.col("anc").isNotNull())
            .join(up, ["tree", "anc"])
            .select("tree", "id", F.col("anc2").alias("anc"), F.col("top2").alias("top"), (F.col("total") + F.col("total2")).alias("total"), (F.col("below") + F.col("below2")).alias("below"))
        )
        tables.append(stored(moved.unionByName(t.filter(F.col("anc").isNull())), "jump"))
    return tables


def choose_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, rank, id, back) for every message of the ``top`` best branches of each root; back 0 is the leaf.

    The jump tables stay in the shared folder until the result has been written; see ``discard``.
    """
    tables = jumps(nodes)
    done = tables[-1].filter(F.col("anc").isNull())
    parents = nodes.select("tree", F.col("parent").alias("id")).filter(F.col("id").isNotNull())
    leaves = done.join(parents, ["tree", "id"], "left_anti")
    best = Window.partitionBy("tree", "top").orderBy(F.desc("total"), F.desc("below"), F.asc("id"))
    ranked = leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    path = ranked.select("tree", F.col("id").alias("leaf"), "rank", "id", F.lit(0).cast("long").alias("back"))
    for k in reversed(range(len(tables) - 1)):
        up = tables[k].filter(F.col("anc").isNotNull()).select("tree", "id", "anc")
        further = path.join(up, ["tree", "id"]).select("tree", "leaf", "rank", F.col("anc").alias("id"), (F.col("back") + 2**k).alias("back"))
        longer = stored(path.unionByName(further), "path")
        discard(path)
        path = longer
    out = path if hasattr(path, "_strophe_path") else stored(path, "path")
    discard(*tables)
    return out


_FORMATTED = "tree string, leaf long, rank int, formatted string, loss array<struct<start:int,stop:int>>"


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 50):
            part = batch.slice(at, 50)
            texts, spans = [], []
            for turns in part.column("turns").to_pylist():
                text, loss = render([(t["role"], t["text"]) for t in turns])
                texts.append(text)
                spans.append([{"start": a, "stop": b} for a, b in loss])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("tree", "leaf", "rank")], pa.array(texts, pa.string()), pa.array(spans, kind)], ["tree", "leaf", "rank", "formatted", "loss"])


def _chained(messages: DataFrame) -> DataFrame:
    """Messages whose ids are unique in their tree: (id, nth), those of one id one below the other."""
    same = Window.partitionBy("tree", "id").orderBy("role", "text", "score")
    rows = messages.withColumns({"nth": F.row_number().over(same), "own": F.first("parent").over(same)})
    last = rows.groupBy("tree", "id").agg(F.max("nth").alias("last")).select("tree", F.col("id").alias("own"), "last")
    key = lambda i, n: F.struct(i.alias("id"), n.cast("int").alias("nth"))
    above = F.when(F.col("nth") > 1, key(F.col("id"), F.col("nth") - 1)).when(F.col("own").isNotNull(), key(F.col("own"), F.coalesce("last", F.lit(0))))
    return rows.join(last, ["tree", "own"], "left").select("tree", key(F.col("id"), F.col("nth")).alias("id"), above.alias("parent"), "score", "role", "text")


def format_trees(messages: DataFrame, top: int = 1, unique: bool = False) -> DataFrame:
    """Formatted conversations with their loss spans. ``messages``: tree, id, parent, score, role, text; ``unique`` says
    that no tree has an id twice."""
    # A null tree is one, too, but would not join.
    messages = messages.select(
        F.coalesce(F.concat(F.lit("t"), F.col("tree").cast("string")), F.lit("null")).alias("tree"), "id", "parent", F.coalesce("score", F.lit(0)).alias("score"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    if not unique:
        messages = stored(_chained(messages), "messages")
    path = choose_paths(messages.select("tree", "id", "parent", "score"), top)
    turns = path.join(messages.select("tree", "id", "role", "text"), ["tree", "id"])
    rows = turns.groupBy("tree", "leaf", "rank").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")
    )
    rows = rows.withColumn("leaf", F.col("leaf") if unique else F.col("leaf.id"))
    return rows.mapInArrow(_format, _FORMATTED).withColumn("tree", F.when(F.col("tree") != "null", F.expr("CAST(substring(tree, 2) AS BIGINT)")))


def conversations(table_: DataFrame) -> DataFrame:
    """A table of turns as reply trees: each turn answers the one before it; the score of a turn is its length."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table_.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    k = F.row_number().over(order).cast("long")
    return rows.select(
        F.col("conv_id").alias("tree"), k.alias("id"), F.when(k > 1, k - 1).alias("parent"), F.char_length("text").cast("long").alias("score"), "role", "text"
    )


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[] for _ in range(5)]
        for formatted, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
            turns = parse(formatted)
            told = "".join(unescape(formatted[s["start"] : s["stop"]]) for s in loss)
            digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            for c, v in zip(cols, (len(turns), digest, len(told), hashlib.sha256(told.encode()).hexdigest(), len(formatted)), strict=True):
                c.append(v)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        arrays = [batch.column("tree"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
        yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in _READ.split(", ")])


def query(spark, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    extra = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("x"),
    )
    extra = extra.select("conv_id", "x.turn", "x.role", F.lit(CONTROL).alias("text"))
    return format_trees(conversations(given.unionByName(extra)), unique=True).mapInArrow(_read_back, _READ)


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (
  SELECT *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS body,
         regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g') AS head FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>') + length(head) + length(body) + length('<|im_end|>') + 2) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
