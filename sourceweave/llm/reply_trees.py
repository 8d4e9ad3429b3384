"""Chat formatting of reply trees.

Messages form trees by their parent. Ancestor tables for 1, 2, 4, ... steps are
built by joining each with itself, so the number of joins grows with the
logarithm of the depth; they carry path length and path score along. Leaves are
ranked by the score of their path from the root (ties: the lesser leaf), and the
chosen paths are spelled out by joining back through the same tables. Each path
becomes one conversation: a marked turn per message, control strings inside
texts escaped reversibly, and the spans of assistant text as loss mask.

Joins run on (tree, message), so a tree with a third of all messages is spread.
Only the finished conversation is one row, as it must be.

Defined results: null texts and roles are empty strings; a null tree is a tree
of its own; a null score counts 0; a message whose parent is missing starts a
path; cycles are left out, as they have no root. Repeated rows of a linear table
are turns of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceweave.llm.common import stored

START, END = "<|im_start|>", "<|im_end|>"
#: fixed values: what follows the opening bracket of a control string
CONTROL = [r"\|im_start\|>", r"\|im_end\|>", r"\|endoftext\|>", r"/?s>", r"/?SYS>", r"/?INST\]"]
_TAIL = "|".join(CONTROL)
#: a control string, or one already escaped with any number of backslashes after its bracket
ESCAPE = rf"([<\[])(\\*)({_TAIL})"
UNESCAPE = rf"([<\[])\\(\\*)({_TAIL})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: str) -> str:
    return re.sub(UNESCAPE, lambda m: m[1] + m[2] + m[3], text)


def _role(text: Column) -> Column:
    """A role as one line."""
    return F.replace(F.replace(escape(text), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _role_back(text: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text))


def ancestors(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(tables (tree, id, up) for 1, 2, 4, ... steps, per message the depth and score of its whole path).

    ``messages`` has tree, id, parent and score.
    """
    known = messages.select("tree", F.col("id").alias("parent")).withColumn("there", F.lit(True))
    step = stored(messages.join(known, ["tree", "parent"], "left").select(
        "tree", "id", F.when(F.col("there"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("length"), F.coalesce("score", F.lit(0.0)).cast("double").alias("total")), "steps")
    tables, done = [], step.where("up IS NULL").drop("up")
    while not step.where("up IS NOT NULL").isEmpty():
        tables.append(step.where("up IS NOT NULL").select("tree", "id", "up"))
        if len(tables) > 62:
            break  # more steps than messages: only cycles are left
        far = step.select("tree", F.col("id").alias("up"), F.col("up").alias("next"), F.col("length").alias("l2"), F.col("total").alias("t2"))
        moved = stored(step.where("up IS NOT NULL").join(far, ["tree", "up"]).select(
            "tree", "id", F.col("next").alias("up"), (F.col("length") + F.col("l2")).alias("length"), (F.col("total") + F.col("t2")).alias("total")), "steps")
        # messages that have reached the root stay in the table for others to jump over
        step = step.where("up IS NULL").unionByName(moved) if len(tables) < 2 else stored(step.where("up IS NULL").unionByName(moved), "steps")
        done = step.where("up IS NULL").drop("up")
    return tables, done


def paths(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """(tree, leaf, rank, step, id): the best ``per_tree`` root-to-leaf paths of each tree, from the root on."""
    tables, whole = ancestors(messages)
    inner = messages.select("tree", F.col("parent").alias("id")).where("id IS NOT NULL").distinct()
    leaves = whole.join(inner, ["tree", "id"], "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc("total"), "id")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_tree)
    found = chosen.select("tree", F.col("id").alias("leaf"), "rank", "length", "id", F.lit(0).cast("long").alias("back"))
    for k in reversed(range(len(tables))):
        up = found.join(tables[k], ["tree", "id"]).select("tree", "leaf", "rank", "length", F.col("up").alias("id"), (F.col("back") + 2**k).alias("back"))
        found = stored(found.unionByName(up), "paths")  # a plan that doubles at each step would not be analysed
    return found.select("tree", "leaf", "rank", (F.col("length") - 1 - F.col("back")).alias("step"), "id")


def format_paths(chosen: DataFrame, texts: DataFrame) -> DataFrame:
    """(tree, leaf, rank, formatted, loss_spans): ``texts`` has tree, id, role, text; spans are (start, chars) in code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = chosen.join(texts, ["tree", "id"]).select("tree", "leaf", "rank", "step", (role == "assistant").alias("loss"),
                                                     F.concat(F.lit(START), _role(role), F.lit("\n")).alias("head"), escape(text).alias("body"))
    rows = rows.withColumn("chars", F.length("body")).withColumn("turn_chars", F.length("head") + F.col("chars") + len(END) + 1)
    before = F.sum("turn_chars").over(Window.partitionBy("tree", "leaf").orderBy("step")) - F.col("turn_chars") + F.length("head")
    rows = rows.withColumn("start", before)
    turn = F.struct("step", F.concat("head", "body", F.lit(END + "\n")).alias("piece"), "loss", "start", "chars")
    whole = rows.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return whole.select("tree", "leaf", "rank", F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("formatted"),
                        F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: F.struct(x["start"].cast("long").alias("start"), x["chars"].cast("long").alias("chars"))).alias("loss_spans"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation."""
    out = []
    for part in formatted.split(END + "\n")[:-1]:
        role, _, text = part[len(START) :].partition("\n")
        out.append((_role_back(role), unescape(text)))
    return out


def digests(conversations: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """``carry`` columns and what is read back from formatted text and loss mask."""
    src = conversations.select(*carry, "formatted", "loss_spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in conversations.select(*carry).schema)
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()):
                turns = parse(text)
                loss = "".join([unescape(text[s["start"] : s["start"] + s["chars"]]) for s in spans])
                out.append((len(turns), hashlib.sha256("".join([f"{r}\n{t}\n" for r, t in turns]).encode()).hexdigest(), len(loss),
                            hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = [pa.array([r[i] for r in out], pa.string() if i in (1, 3) else pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], *cols], names=[*carry, *names])

    return src.mapInArrow(work, schema + ", n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def linear(conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """A table of turns as trees of one path each: tree, id, parent, score, role, text."""
    order = Window.partitionBy(conv).orderBy("turn", "role", "text")
    rows = conversations.select(conv, "turn", "role", "text").withColumn("id", F.row_number().over(order).cast("long"))
    return rows.select(F.struct(F.col(conv)).alias("tree"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"),
                       F.length("text").cast("double").alias("score"), "role", "text")
