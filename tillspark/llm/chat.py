"""Chat formatting: reply trees to root-to-leaf paths, chosen paths to training conversations.

Paths come from iterative self-joins with pointer doubling: after round k every message knows
its ancestor 2 ** k replies up, with the score gathered on the way, so a chain of n replies
needs about log2(n) joins. Branches are ranked by the score of their whole path. The messages
of a chosen path are enumerated by running the same pointers back from its leaf, again one
self-join a round, without listing the paths that were not chosen.

A turn is ``### role:`` on a line, the text, and ``</turn>`` on its line end. Backslashes and
the characters that control strings begin with are escaped by a backslash inside roles and
texts, so no text can end a turn or open one, and :func:`parse` gives back what went in.
The loss mask is a list of spans, in code points, that cover each assistant text.

Defined results: null roles and texts are empty; a message whose parent is missing is a root;
messages on a reply cycle hang from no root and are left out; equal branch scores prefer the
longer path, then the smaller leaf id. Of rows that share a tree and a message id the first by
parent id, score and a hash of role and text counts, nulls first: for its score and its text
alike. Trees and ids may be null (null is a tree of its own; null message ids never occur in
trees made by :func:`linear`). Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, written

END = "</turn>\n"
_TEXT = str.maketrans({"\\": "\\\\", "#": "\\#", "<": "\\<"})
_ROLE = str.maketrans({"\\": "\\\\", "#": "\\#", "<": "\\<", ":": "\\:", "\n": "\\\n"})
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*):\n((?:[^\\<]|\\.)*)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], learned: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation as text, and the spans of it that the loss covers."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"### {role.translate(_ROLE)}:\n", text.translate(_TEXT)
        at += len(head)
        if role == learned:
            spans.append((at, at + len(body)))
        at += len(body) + len(END)
        out += [head, body, END]
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts back from a formatted conversation; anything else in it is an error."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def linear(rows: DataFrame, tree: str = "conv_id", order: str = "turn") -> DataFrame:
    """A table of conversations by turn as a reply tree: every row replies to the one before.

    Equal turns follow role, then text, so repeated rows stay and the result is the same each time.
    """
    w = Window.partitionBy(tree).orderBy(F.col(order).asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    n = F.row_number().over(w).cast("long")
    return rows.select(F.col(tree).alias("tree_id"), n.alias("message_id"), "role", "text").select(
        "tree_id", "message_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1).alias("parent_id"), "role", "text", F.length(F.coalesce("text", F.lit(""))).cast("double").alias("score")
    )


def _standing(messages: DataFrame) -> Column:
    """The order in which one of several rows of a message id is chosen."""
    said = [F.col(c) for c in ("role", "text") if c in messages.columns]
    return F.struct(F.col("parent_id").alias("p"), F.coalesce("score", F.lit(0.0)).alias("score"), (F.xxhash64(*said) if said else F.lit(0)).alias("said"))


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The ``branches`` best root-to-leaf paths of each tree.

    messages: tree_id, message_id, parent_id, score. Returns tree_id, branch (1 is the best),
    position (0 at the root) and message_id.
    """
    plain = messages.select(
        F.coalesce(F.col("tree_id").cast("string"), F.lit("")).alias("t"),
        F.col("tree_id").isNull().alias("tn"),
        F.col("message_id").alias("m"),
        _standing(messages).alias("s"),
    )
    tree = ["t", "tn"]
    plain = plain.groupBy(*tree, "m").agg(F.min("s").alias("s")).select(*tree, "m", "s.p", "s.score")
    known = plain.select(*tree, F.col("m").alias("p"), F.lit(True).alias("known")).distinct()
    start = (
        plain.join(known, [*tree, "p"], "left")
        .select(*tree, "m", F.when(F.col("known"), F.col("p")).alias("up"), F.col("score").alias("gained"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("steps"))
    )
    # ``gained`` and ``steps``: score and replies of the way up that a row knows, its target not counted.
    pointers = [written(start, "reply-up")]
    climbing, limit = pointers[0].where("up is not null").count(), None
    while climbing:
        at = pointers[-1]
        far = at.select(*tree, F.col("m").alias("up"), F.col("up").alias("up2"), F.col("gained").alias("gained2"), F.col("steps").alias("steps2"))
        nxt = (
            at.where("up is not null")
            .join(far, [*tree, "up"])
            .select(*tree, "m", F.col("up2").alias("up"), (F.col("gained") + F.col("gained2")).alias("gained"), (F.col("steps") + F.col("steps2")).alias("steps"))
        )
        # Rows that have reached their root stay as they are: a long chain costs rounds, but not for all.
        pointers.append(written(nxt.unionByName(at.where("up is null")), "reply-up"))
        climbing = pointers[-1].where("up is not null").count()
        if limit is None:
            limit = pointers[0].groupBy(*tree).count().agg(F.max("count")).head()[0] or 0
        if climbing and 2 ** (len(pointers) - 1) > limit:
            break  # what still climbs goes round in a cycle
    rooted = pointers[-1].where("up is null")
    parents = plain.select(*tree, F.col("p").alias("m")).where("m is not null").distinct()
    leaves = rooted.join(parents, [*tree, "m"], "left_anti")
    rank = Window.partitionBy(*tree).orderBy(F.desc("gained"), F.desc("steps"), F.asc("m"))
    chosen = leaves.withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= branches)
    path = chosen.select(*tree, "branch", "m", F.col("steps").alias("position"))
    walked: list[DataFrame] = []
    for k in range(len(pointers) - 2, -1, -1):
        jump = pointers[k].where("up is not null").select(*tree, "m", "up")
        further = path.join(jump, [*tree, "m"]).select(*tree, "branch", F.col("up").alias("m"), (F.col("position") - 2**k).alias("position"))
        # Written each round: the plan would double otherwise.
        walked.append(written(path.unionByName(further), "reply-walk"))
        path = walked[-1]
    out = written(path.select(F.when(~F.col("tn"), F.col("t")).cast(messages.schema["tree_id"].dataType).alias("tree_id"), "branch", "position", F.col("m").alias("message_id")), "reply-paths")
    drop(*pointers, *walked)
    return out


def format_paths(messages: DataFrame, paths: DataFrame, learned: str = "assistant") -> DataFrame:
    """One row for each path: tree_id, branch, ``formatted`` and ``loss_spans``."""

    @F.pandas_udf("formatted string, loss_spans array<struct<start: long, stop: long>>")
    def rendered(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [render([(t["role"], t["text"]) for t in turns], learned) for turns in batch]
            yield pd.DataFrame({"formatted": [t for t, _ in rows], "loss_spans": [[{"start": a, "stop": b} for a, b in s] for _, s in rows]})

    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    m = messages.select(F.col("tree_id").alias("t"), F.col("message_id").alias("m"), F.struct(empty("role"), empty("text")).alias("said"), _standing(messages).alias("s"))
    m = m.groupBy("t", "m").agg(F.min_by("said", "s").alias("said")).select("t", "m", "said.*")
    turns = (
        paths.join(m, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("message_id") == F.col("m")))
        .groupBy("tree_id", "branch")
        .agg(F.array_sort(F.collect_list(F.struct("position", "role", "text"))).alias("turns"))
    )
    return turns.select("tree_id", "branch", rendered("turns").alias("out")).select("tree_id", "branch", "out.*")


def format_trees(messages: DataFrame, branches: int = 1, learned: str = "assistant") -> DataFrame:
    """The best branches of each reply tree, formatted; extra columns of ``messages`` are not used."""
    return format_paths(messages, best_paths(messages, branches), learned)
