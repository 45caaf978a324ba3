"""Reply trees as chat-formatted conversations, by DataFrame operations alone.

Ancestor tables double their reach with every self-join, so the rounds follow
the logarithm of the deepest tree. They carry each node's depth and its path's
summed score to the root, by which a tree's leaves are ranked. The chosen
leaves' members come from the same tables, read once more; texts join only at
the end.

A conversation is one output row, so its turns meet in one task by nature; all
earlier steps are keyed by single messages. Null texts and roles are empty. A
message whose parent isn't in its tree is a root; messages in or below a cycle
of parents are on no path. Equal scores rank by leaf id. Empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written

TURN, BODY, STOP = "<|turn|>", "<|body|>", "<|end|>"
#: Strings that steer a chat template; each has its own two-character escape.
CONTROL = {
    TURN: "\\t", BODY: "\\b", STOP: "\\n", "<s>": "\\s", "</s>": "\\S", "[INST]": "\\i", "[/INST]": "\\I",
    "<<SYS>>": "\\y", "<</SYS>>": "\\Y", "<|im_start|>": "\\m", "<|im_end|>": "\\M", "<|endoftext|>": "\\x",
}


def escape(text: Column) -> Column:
    """No control string is left; ``unescape`` gives the text back.

    Every backslash of the result starts an escape, and no control string holds
    a backslash, so replacements neither meet nor make one another.
    """
    text = F.replace(text, F.lit("\\"), F.lit("\\e"))
    for control, code in CONTROL.items():
        text = F.replace(text, F.lit(control), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for control, code in CONTROL.items():
        text = F.replace(text, F.lit(code), F.lit(control))
    return F.replace(text, F.lit("\\e"), F.lit("\\"))


def jumps(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Ancestor tables tree, node, up at distance 1, 2, 4, ..., and the finished nodes.

    Only nodes whose path goes on take part in the next round. steps and total
    count from the node to just below ``up``; a finished node's ``up`` is null
    and they cover its path to the root. messages: tree, node, parent, score.
    """
    own = messages.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    start = messages.join(own, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.lit(1).alias("steps"), F.coalesce("score", F.lit(0.0)).alias("total")
    )
    table = written(start, "jump")
    size, tables, done = table.count(), [], None
    while True:
        ended = table.where("up is null")
        done = ended if done is None else done.union(ended)
        going = table.where("up is not null")
        if 2 ** len(tables) > size or not going.limit(1).count():
            return tables, done  # what is left after so many rounds lies in or below cycles
        tables.append(going)
        above = done.union(going).select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("steps").alias("s"), F.col("total").alias("v"))
        doubled = going.join(above, ["tree", "up"])
        table = written(doubled.select("tree", "node", F.col("next").alias("up"), (F.col("steps") + F.col("s")).alias("steps"), (F.col("total") + F.col("v")).alias("total")), "jump")


def chosen_paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """tree, leaf, rank, node, depth (from 1 at the root) of each tree's best branches.

    A branch's score is the mean of its messages' scores. branches None: all.
    """
    tables, done = jumps(messages)
    done = done.select("tree", F.col("node").alias("leaf"), F.col("steps").alias("depth"), (F.col("total") / F.col("steps")).alias("branch_score"))
    parents = messages.select("tree", F.col("parent").alias("leaf")).distinct()
    leaves = done.join(parents, ["tree", "leaf"], "left_anti")
    if branches == 1:  # combined before the shuffle, however many leaves a tree has
        best = leaves.groupBy("tree").agg(F.min(F.struct((-F.col("branch_score")).alias("s"), "leaf", "depth")).alias("b"))
        leaves = best.select("tree", "b.leaf", "b.depth", F.lit(1).alias("rank"))
    else:
        w = Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")
        leaves = leaves.select("tree", "leaf", "depth", F.row_number().over(w).alias("rank"))
        if branches is not None:
            leaves = leaves.where(F.col("rank") <= branches)
    members = written(leaves.select("tree", "leaf", "rank", F.col("leaf").alias("node"), "depth"), "members")
    for k, t in enumerate(tables):
        up = t.select("tree", "node", "up")
        above = members.join(up, ["tree", "node"]).select("tree", "leaf", "rank", F.col("up").alias("node"), (F.col("depth") - 2**k).alias("depth"))
        members = written(members.union(above), "members")
    return members


def piece(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN), escape(role), F.lit(BODY), escape(text), F.lit(STOP))


def format_paths(messages: DataFrame, members: DataFrame) -> DataFrame:
    """tree, leaf, rank, formatted, loss: the conversation and its loss mask.

    loss lists the code-point ranges (start, end) of the assistants' texts.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = members.join(messages.select("tree", "node", role.alias("role"), text.alias("text")), ["tree", "node"])
    turns = turns.select("tree", "leaf", "rank", "depth", "role", piece(F.col("role"), F.col("text")).alias("piece"), F.length(escape(F.col("text"))).alias("n"))
    w = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("piece")).over(w) - len(STOP)
    turns = turns.withColumn("end", end)
    loss = F.when(F.col("role") == "assistant", F.struct((F.col("end") - F.col("n")).alias("start"), F.col("end").alias("end")))
    both = F.array_sort(F.collect_list(F.struct("depth", "piece", loss.alias("loss"))))
    out = turns.groupBy("tree", "leaf", "rank").agg(both.alias("t"))
    return out.select("tree", "leaf", "rank", F.array_join("t.piece", "").alias("formatted"), F.filter("t.loss", lambda x: x.isNotNull()).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (role, text) and loss_texts, parsed from the formatted text."""
    parts = F.filter(F.split("formatted", r"<\|end\|>"), lambda p: p != "")
    turns = F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, F.lit(len(TURN) + 1), F.length(p)), BODY, 1)).alias("role"),
            unescape(F.substring_index(p, BODY, -1)).alias("text"),
        ),
    )
    masked = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumn("turns", turns).withColumn("loss_texts", masked)


def linear(rows: DataFrame, tree: str, order: str) -> DataFrame:
    """Rows of plain conversations as trees without branches; ties by role and text."""
    w = Window.partitionBy(tree).orderBy(F.col(order).asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    node = F.row_number().over(w).cast("long")
    out = rows.select(F.coalesce(F.col(tree).cast("string"), F.lit("null")).alias("tree"), node.alias("node"), "role", "text", F.lit(0.0).alias("score"))
    return out.withColumn("parent", F.col("node") - 1)
