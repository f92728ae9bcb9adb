"""Operator 4: chat formatting of reply trees.

Messages (tree, node, parent, role, text, score) form reply trees. Root-to-leaf paths are
enumerated by iterative self-joins that double their reach: after round k each path row
(leaf, node, offset) covers 2**k ancestors, so a tree of depth d takes log2(d) joins and every row
made is part of the result. Branches of a tree are ranked by the sum of their messages' scores (ties: the smaller leaf),
and each chosen path is formatted as one conversation.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. A control string inside a role or
text gets a backslash after its first character, and backslashes are doubled, so reading back is exact. The
loss mask is the list of spans of escaped assistant text, as code points of the formatted string.

Defined cases: null text and null role are empty; a node without a known parent is a root; a node that is its own
ancestor is on no path (cycles have no root); repeated rows are turns of their own; extra columns are
left behind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, new_path

START, END = "<|im_start|>", "<|im_end|>"
# Control strings of common chat templates.
CONTROL = (START, END, "<|im_sep|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|user|>", "<|assistant|>", "<|system|>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.S)
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    """As text, and without line feeds, which end a role."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its loss spans."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        at += len(head)
        if role == LOSS_ROLE:
            spans.append((at, at + len(body)))
        parts += [head, body, END, "\n"]
        at += len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def linear_trees(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations without branches as trees: each turn replies to the one before (by turn, role, text)."""
    own = df.select(
        F.col(f"`{key}`").cast("long").alias("tree"), F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    node = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")).cast("long")
    numbered = own.withColumn("node", node)
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): each root-to-leaf path's nodes, ``up`` steps above the leaf."""
    nodes = messages.select("tree", "node", "parent")
    known = nodes.select("tree", F.col("node").alias("parent"))
    same = lambda a, b: F.expr(f"{a}.tree <=> {b}.tree")
    linked = nodes.alias("n").join(known.alias("p"), same("n", "p") & F.expr("n.parent = p.parent"), "left")
    # jump: each node's ancestor 2**k steps above
    jump = materialize(linked.select("n.tree", "n.node", F.col("p.parent").alias("above")), "jump")
    leaves = nodes.alias("n").join(jump.where("above is not null").select("tree", F.col("above").alias("node")).distinct().alias("p"), same("n", "p") & F.expr("n.node = p.node"), "left_anti")
    rows = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    step = 1
    while True:
        up = jump.where("above is not null")
        if up.isEmpty():
            break
        more = rows.alias("r").join(up.alias("j"), same("r", "j") & F.expr("r.node = j.node")).select("r.tree", "r.leaf", F.col("j.above").alias("node"), (F.col("r.up") + step).alias("up"))
        rows = materialize(rows.unionByName(more), "paths")
        jump = materialize(up.alias("a").join(up.alias("b"), same("a", "b") & F.expr("a.above = b.node")).select("a.tree", "a.node", "b.above"), "jump")
        step *= 2
    return rows


def rank_branches(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, leaf, node, up, place) of the ``branches`` best paths of each tree (None: all)."""
    rows = paths(messages)
    scored = rows.alias("r").join(messages.select("tree", "node", "score").alias("m"), F.expr("r.tree <=> m.tree and r.node = m.node"))
    totals = scored.groupBy("r.tree", "leaf").agg(F.sum("score").alias("total"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf"))
    chosen = totals.withColumn("place", place)
    if branches is not None:
        chosen = chosen.where(F.col("place") <= branches)
    return rows.alias("r").join(chosen.alias("c"), F.expr("r.tree <=> c.tree and r.leaf = c.leaf")).select("r.tree", "r.leaf", "r.node", "r.up", "c.place")


def format_trees(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, leaf, place, formatted, loss_spans) for each chosen path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = [], []
            for turns in batch.column("turns").to_pylist():
                text, loss = render([(t["role"], t["text"]) for t in turns])
                texts.append(text)
                spans.append([{"start": a, "end": b} for a, b in loss])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("tree", "leaf", "place")], pa.array(texts, pa.string()), pa.array(spans, kind)], ["tree", "leaf", "place", "formatted", "loss_spans"])

    chosen = rank_branches(messages, branches)
    full = chosen.alias("c").join(messages.alias("m"), F.expr("c.tree <=> m.tree and c.node = m.node")).select("c.tree", "c.leaf", "c.place", "c.up", "m.role", "m.text")
    turns = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return full.groupBy("tree", "leaf", "place").agg(turns.alias("turns")).mapInArrow(
        run, "tree long, leaf long, place int, formatted string, loss_spans array<struct<start:long,end:long>>"
    )


def write(messages: DataFrame, path: str, branches: int | None = 1) -> None:
    format_trees(messages, branches).write.parquet(path)


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per formatted conversation what can be read back from it: turns, text under the loss mask, sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, turns_hash, loss, loss_hash, size = [], [], [], [], []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()):
                turns = parse(text)
                masked = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                n.append(len(turns))
                turns_hash.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                loss.append(len(masked))
                loss_hash.append(hashlib.sha256(masked.encode()).hexdigest())
                size.append(len(text))
            columns = [pa.array(n, pa.int64()), pa.array(turns_hash, pa.string()), pa.array(loss, pa.int64()), pa.array(loss_hash, pa.string()), pa.array(size, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("tree"), *columns], ["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return spark.read.parquet(path).select("tree", "formatted", "loss_spans").mapInArrow(
        run, "tree long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def format_digest(df: DataFrame) -> DataFrame:
    """Formats linear conversations to a table in the shared folder and reads it back."""
    spark = df.sparkSession
    path = new_path(spark, "chat")
    write(materialize(linear_trees(df), "messages"), path)
    return read_digest(spark, path)
