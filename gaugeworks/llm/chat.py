"""Reply trees to chat-formatted conversations, in DataFrame operations only.

Messages form trees by parent.  Iterative self-joins double the reach of every node's ancestor
pointer, so a tree of depth d takes about log2(d) rounds, not d; the same pointers then enumerate
the nodes of each chosen root-to-leaf path.  Branches are ranked by the mean score of their path
and each chosen one becomes a conversation.

Template: ``<|turn|>`` role ``<|text|>`` text ``<|end|>`` for each turn.  Inside roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|``, so no control string can appear in them and reading
back restores them exactly.  The loss mask covers the escaped text of assistant turns: a
conversation comes as ``pieces``, whose concatenation it is, each under the mask or not.

Defined results: null texts and roles count as empty; a null conversation id is a conversation of
its own; repeated rows of a conversation are turns of their own.  Of messages that repeat a node id in a tree, or have
none, each is a node: the first by parent, role, text and score answers to the id, the others are leaves beside it.  A parent that is missing makes its child a root;
nodes on a cycle belong to no path; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
KEY = ["conv", "lost"]


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def thread(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as a chain of messages in the order of turns."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    out = conversations.select("conv_id", F.row_number().over(order).cast("long").alias("node"), "role", "text")
    return out.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _nodes(messages: DataFrame) -> DataFrame:
    """(conv, lost, at, up, node, role, text, score): messages with a key of their own and that of their parent.

    ``lost`` marks the conversation without an id, whose conv is the type's zero; the first message of a node id has number 1.
    """
    kind = messages.schema["conv_id"].dataType
    conv = F.coalesce("conv_id", F.lit("0").cast(kind))
    rows = messages.select(
        conv.alias("conv"), F.col("conv_id").isNull().alias("lost"), "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score")
    )
    copy = F.row_number().over(Window.partitionBy(*KEY, "node").orderBy("parent", "role", "text", "score"))
    named = lambda c, n: F.concat_ws(":", c.cast("string"), n.cast("string"))
    at = F.when(F.col("node").isNull(), F.concat(F.lit("~"), F.col("copy").cast("string"))).otherwise(named(F.col("node"), F.col("copy")))
    up = F.when(F.col("parent").isNotNull(), named(F.col("parent"), F.lit(1)))
    return rows.withColumn("copy", copy).select(*KEY, at.alias("at"), up.alias("up"), "node", "role", "text", "score")


def branches(nodes: DataFrame, top: int | None = None) -> DataFrame:
    """(conv, lost, leaf, branch, branch_score, at, depth): the nodes of the best ``top`` paths of each tree of ``_nodes``, or of all."""
    known = nodes.select(*KEY, F.col("at").alias("up"), F.lit(True).alias("there"))
    state = nodes.join(known, [*KEY, "up"], "left").select(*KEY, "at", F.when(F.col("there"), F.col("up")).alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("length"))
    state = checkpointed(state)
    leaves = nodes.select(*KEY, "at", "node").join(state.select(*KEY, F.col("up").alias("at")).where("at is not null"), [*KEY, "at"], "left_anti")
    ended, jumps, rounds = state.where("up is null"), [], max(1, state.count()).bit_length()
    # Each round moves only the nodes whose pointer is not at a root yet, within their trees.
    while len(jumps) <= rounds and not (moving := state.where("up is not null")).isEmpty():
        jumps.append(moving.select(*KEY, "at", "up"))
        trees = state.join(moving.select(*KEY).distinct(), KEY, "left_semi")
        above = trees.select(*KEY, F.col("at").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("length").alias("steps"))
        moved = moving.join(above, [*KEY, "up"], "left").select(*KEY, "at", F.col("next").alias("up"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"), (F.col("length") + F.coalesce("steps", F.lit(0))).alias("length"))
        moved = checkpointed(moved)
        ended = ended.unionByName(moved.where("up is null"))
        state = checkpointed(trees.where("up is null").unionByName(moved))
    score = (F.col("total") / F.col("length")).alias("branch_score")
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("branch_score"), "node", "at")).alias("branch")
    chosen = leaves.join(ended, [*KEY, "at"]).select(*KEY, "at", "node", score).select(*KEY, "at", "branch_score", rank)
    chosen = chosen.where(F.col("branch") <= top) if top is not None else chosen
    paths = checkpointed(chosen.select(*KEY, F.col("at").alias("leaf"), "branch", "branch_score", "at", F.lit(0).cast("long").alias("depth")))
    for i, jump in enumerate(jumps):
        further = paths.join(jump, [*KEY, "at"]).select(*KEY, "leaf", "branch", "branch_score", F.col("up").alias("at"), (F.col("depth") + 2**i).alias("depth"))
        paths = checkpointed(paths.unionByName(further))
    return paths


def format_conversations(messages: DataFrame, top: int | None = None) -> DataFrame:
    """(conv_id, branch, branch_score, formatted, pieces), one row for each chosen path."""
    nodes = _nodes(messages)
    paths = branches(checkpointed(nodes.select(*KEY, "at", "up", "node", "score")), top)
    turn = F.struct((-F.col("depth")).alias("at"), escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), (F.col("role") == "assistant").alias("loss"))
    whole = paths.join(nodes.select(*KEY, "at", "role", "text"), [*KEY, "at"]).groupBy(*KEY, "leaf", "branch", "branch_score").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    piece = lambda text, loss: F.struct(text.alias("piece"), loss.alias("loss"))
    pieces = F.flatten(F.transform("turns", lambda t: F.array(piece(F.concat(F.lit(TURN), t["role"], F.lit(TEXT)), F.lit(False)), piece(t["text"], t["loss"]), piece(F.lit(END), F.lit(False)))))
    out = whole.select(F.when(~F.col("lost"), F.col("conv")).alias("conv_id"), "branch", "branch_score", pieces.alias("pieces"))
    return out.select("conv_id", "branch", "branch_score", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "pieces")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    rows = F.split(formatted, r"<\|end\|>")
    rows = F.slice(rows, F.lit(1), F.size(rows) - 1)
    at = lambda r: F.split(F.substr(r, F.lit(len(TURN) + 1)), r"<\|text\|>", 2)
    return F.transform(rows, lambda r: F.struct(unescape(at(r)[0]).alias("role"), unescape(at(r)[1]).alias("text")))


def read_loss(pieces: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: unescape(p["piece"])), "")
