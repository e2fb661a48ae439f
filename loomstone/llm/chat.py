"""Chat formatting of reply trees (operator 4).

Messages name their parents. Repeated self-joins double each message's jump
towards its root, which yields depth and mean score of every branch; branches
are ranked by score, and the jump tables then list each chosen root-to-leaf
path in as many joins. Each path becomes one formatted conversation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.scratch import cut, trimmed

START, END = "<|im_start|>", "<|im_end|>"
#: Role whose texts are under the loss mask.
TRAINED = "assistant"


def escape(text: str) -> str:
    """No control string starts inside the result: a backslash stands inside every ``<|``."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    """As ``escape``, and on one line."""
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the code point spans of its trained texts."""
    parts: list[str] = []
    spans, at = [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == TRAINED:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn, read back from a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(END, line + 1)
        turns.append((unescape(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return turns


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``path, position, tree_id, role, text`` of the chosen root-to-leaf paths.

    ``messages`` has ``tree_id, msg_id, parent_id, role, text, score``. A branch
    scores the mean of its messages' scores (null counts 0); each root keeps its
    ``branches`` best, ties to the longer and then to the smaller msg_id of the
    leaf. A message whose parent is missing is a root. Where a tree repeats a
    msg_id, replies belong to one of its rows and each row is a message. Rows on
    or below a cycle have no root and form no path. An empty table has none.

    Rounds grow with the logarithm of the longest path; each keeps one narrow
    row per unfinished message, so neither deep nor wide trees multiply rows.
    """
    rows = cut(messages.select("tree_id", "msg_id", "parent_id", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")).withColumn("node", F.monotonically_increasing_id()))
    keyed = rows.groupBy("tree_id", "msg_id").agg(F.min("node").alias("parent"))
    links = cut(
        rows.alias("c").join(keyed.alias("p"), F.col("c.tree_id").eqNullSafe(F.col("p.tree_id")) & (F.col("c.parent_id") == F.col("p.msg_id")), "left")
        .select("node", "parent", "score", F.col("c.msg_id").alias("msg_id"))
    )
    state = links.select("node", F.col("parent").alias("jump"), F.when(F.col("parent").isNull(), F.col("node")).alias("root"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth"))
    done = state.where("jump is null")
    active = state.where("jump is not null")
    jumps: list[DataFrame] = []
    left, before = active.count(), None
    while left and left != before:
        jumps.append(active.select("node", "jump"))
        everyone = done.unionByName(active)
        b = everyone.select(F.col("node").alias("b_node"), F.col("jump").alias("b_jump"), F.col("root").alias("b_root"), F.col("total").alias("b_total"), F.col("depth").alias("b_depth"))
        moved = cut(
            active.join(b, F.col("jump") == F.col("b_node"))
            .select("node", F.col("b_jump").alias("jump"), F.col("b_root").alias("root"), (F.col("total") + F.col("b_total")).alias("total"), (F.col("depth") + F.col("b_depth")).alias("depth"))
        )
        done, active = done.unionByName(moved.where("jump is null")), moved.where("jump is not null")
        before, left = left, active.count()
    leaves = links.join(links.select(F.col("parent").alias("node")).where("node is not null").distinct(), "node", "left_anti").select("node", "msg_id")
    order = Window.partitionBy("root").orderBy((F.col("total") / F.col("depth")).desc(), F.col("depth").desc(), "msg_id", "node")
    chosen = cut(done.join(leaves, "node").withColumn("n", F.row_number().over(order)).where(F.col("n") <= branches).select(F.col("node").alias("path"), "depth"))
    members = chosen.select("path", F.col("path").alias("node"), (F.col("depth") - 1).alias("position"))
    for level in reversed(range(len(jumps))):
        step = members.join(jumps[level], "node").select("path", F.col("jump").alias("node"), (F.col("position") - 2**level).alias("position"))
        members = cut(members.unionByName(step))
    return members.join(rows.select("node", "tree_id", "role", "text"), "node").select("path", "position", "tree_id", "role", "text")


def conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``tree_id, formatted, loss_spans``: one row per chosen path of ``paths``.

    Null role or text counts as empty. ``loss_spans`` are the code point spans
    of the trained texts in ``formatted``. Messages are sorted by Spark, which
    spills, and each partition is read as a stream: a worker holds an Arrow
    batch and the conversation that it is writing.
    """

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("tree_id", kind), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
        key, tree, turns = None, None, []

        def made(tree, turns):
            text, spans = format_turns(turns)
            return pa.RecordBatch.from_pylist([{"tree_id": tree, "formatted": text, "loss_spans": [{"start": a, "end": b} for a, b in spans]}], schema)

        for batch in it:
            out = []
            for path, tree_id, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if turns and path != key:
                    out.append(made(tree, turns))
                    turns = []
                key, tree = path, tree_id
                turns.append((role or "", text or ""))
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if turns:
            yield made(tree, turns)

    ordered = paths(messages, branches).repartition("path").sortWithinPartitions("path", "position")
    kind = pa.int64() if dict(messages.dtypes)["tree_id"] == "bigint" else pa.string()
    name = "bigint" if kind == pa.int64() else "string"
    ordered = ordered.withColumn("tree_id", F.col("tree_id").cast(name))
    return ordered.mapInArrow(trimmed(write), f"tree_id {name}, formatted string, loss_spans array<struct<start:bigint,end:bigint>>")


def from_turns(turns: DataFrame) -> DataFrame:
    """Conversations of rows by turn as reply trees: each row answers the one before it.

    Rows of equal turn go by role and text; null conv_id is one conversation.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    n = F.row_number().over(order)
    return turns.select(F.col("conv_id").alias("tree_id"), n.alias("msg_id"), (n - 1).alias("parent_id"), "role", "text", F.lit(1.0).alias("score"))


#: The digests of formatted conversations, by rows of turns ``{turns}`` (conv_id, turn, role, text).
CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, text, coalesce(role, '') AS who, coalesce(text, '') AS said FROM {turns}
), e AS (
  SELECT *, length('<|im_start|>') + length(replace(replace(replace(who, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + 1
            + length(replace(replace(said, '\', '\\'), '<|', '<\|')) + length('<|im_end|>') + 1 AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(who || chr(10) || said || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
       CAST(coalesce(sum(length(said)) FILTER (who = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(said, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (who = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
