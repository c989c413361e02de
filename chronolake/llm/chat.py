"""Chat formatting over reply trees, in DataFrame operations only.

Nodes (tree_id, node_id, parent_id, role, text, score) form reply trees. Root-to-leaf paths
are enumerated by self-joins that double the reach each time: after k rounds every leaf knows
its 2^k nearest ancestors, so a chain of n turns takes log2(n) rounds. A branch's score is
the sum over its path; the best branches of a tree are formatted, each as one conversation.
Only ids and scores take part in the rounds; role and text join the chosen paths at the end.

Format: `<s>` then, per turn, `<|role|>\\n` text `</s>\\n`. Inside roles and texts `%`, `<`, `[`
and `|` are written as `%25`, `%3C`, `%5B` and `%7C`, so control strings occur only where the
template puts them, and `parse` gets back what went in. The loss mask is the list of spans
(start, length; in code points of the formatted text) of the escaped assistant texts.

Cases: null role or text: empty; a parent that does not exist: the node is a root; nodes on a
cycle: an error; ties of branch score: the smallest leaf first; repeated rows of a turn table
are turns of their own, in the order of (turn, role, text); null conv_id: one conversation;
empty tables: an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BEGIN, OPEN, MIDDLE, CLOSE = "<s>", "<|", "|>\n", "</s>\n"
#: Escape strings, fixed values; % comes first on the way in and last on the way back.
ESCAPES = (("%", "%25"), ("<", "%3C"), ("[", "%5B"), ("|", "%7C"))
#: Ranks within so many parts of a tree come before the rank within the tree.
PARTS = 64


def escape(x: Column) -> Column:
    for raw, written in ESCAPES:
        x = F.replace(x, F.lit(raw), F.lit(written))
    return x


def unescape(x: Column) -> Column:
    for raw, written in reversed(ESCAPES):
        x = F.replace(x, F.lit(written), F.lit(raw))
    return x


def paths(nodes: DataFrame) -> DataFrame:
    """(tree_id, leaf_id, node_id, up): every node on the way from each leaf to its root; up counts from the leaf."""
    ids = cut(nodes.select("tree_id", "node_id", "parent_id"))
    total = ids.count()
    same = lambda a, b, x, y: F.col(f"{a}.tree_id").eqNullSafe(F.col(f"{b}.tree_id")) & (F.col(f"{a}.{x}") == F.col(f"{b}.{y}"))
    jump = cut(ids.alias("c").join(ids.alias("p"), same("c", "p", "parent_id", "node_id")).select("c.tree_id", "c.node_id", F.col("p.node_id").alias("to")))
    leaf = ids.alias("n").join(jump.alias("c"), same("n", "c", "node_id", "to"), "left_anti")
    reach = leaf.select("tree_id", F.col("node_id").alias("leaf_id"), "node_id", F.lit(0).cast("long").alias("up"))
    step = 1
    while not jump.isEmpty():
        if step > total:
            raise ValueError("the parents of some nodes form a cycle")
        further = reach.alias("r").join(jump.alias("j"), same("r", "j", "node_id", "node_id")).select("r.tree_id", "r.leaf_id", F.col("j.to").alias("node_id"), (F.col("r.up") + step).alias("up"))
        reach = cut(reach.unionByName(further))
        jump = cut(jump.alias("a").join(jump.alias("b"), same("a", "b", "to", "node_id")).select("a.tree_id", "a.node_id", "b.to"))
        step *= 2
    return reach


def best(reach: DataFrame, nodes: DataFrame, branches: int) -> DataFrame:
    """(tree_id, leaf_id, branch): the best branches of each tree; branch counts from 1."""
    scored = reach.alias("r").join(nodes.alias("n"), F.col("r.tree_id").eqNullSafe(F.col("n.tree_id")) & (F.col("r.node_id") == F.col("n.node_id")))
    leaf = scored.groupBy("r.tree_id", "r.leaf_id").agg(F.sum(F.coalesce("n.score", F.lit(0.0))).alias("score"))
    order = [F.desc("score"), F.asc("leaf_id")]
    part = F.pmod(F.xxhash64("leaf_id"), F.lit(PARTS))  # a tree with very many leaves is ranked in parts first
    few = leaf.withColumn("k", F.row_number().over(Window.partitionBy("tree_id", part).orderBy(*order))).where(F.col("k") <= branches)
    return few.withColumn("branch", F.row_number().over(Window.partitionBy("tree_id").orderBy(*order))).where(F.col("branch") <= branches).select("tree_id", "leaf_id", "branch")


def format_trees(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """One row per chosen branch: tree_id, leaf_id, branch, formatted, loss_spans."""
    reach = paths(nodes)
    chosen = reach.alias("r").join(best(reach, nodes, branches).alias("b"), F.col("r.tree_id").eqNullSafe(F.col("b.tree_id")) & (F.col("r.leaf_id") == F.col("b.leaf_id"))).select("r.tree_id", "r.leaf_id", "b.branch", "r.node_id", "r.up")
    turn = chosen.alias("c").join(nodes.alias("n"), F.col("c.tree_id").eqNullSafe(F.col("n.tree_id")) & (F.col("c.node_id") == F.col("n.node_id"))).select("c.tree_id", "c.leaf_id", "c.branch", "c.up", *(F.coalesce(f"n.{x}", F.lit("")).alias(x) for x in ("role", "text")))
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE))
    turn = turn.select("*", head.alias("head"), escape(F.col("text")).alias("body"))
    size = F.length("head") + F.length("body") + len(CLOSE)
    before = Window.partitionBy("tree_id", "leaf_id", "branch").orderBy(F.desc("up"))
    turn = turn.withColumn("start", len(BEGIN) + F.sum(size.cast("long")).over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.length("body") - len(CLOSE))
    span = F.when(F.col("role") == "assistant", F.struct(F.col("start"), F.length("body").cast("long").alias("chars")))
    rows = turn.groupBy("tree_id", "leaf_id", "branch").agg(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), F.concat("head", "body", F.lit(CLOSE)).alias("turn"), span.alias("span")))).alias("turns"))
    return rows.select("tree_id", "leaf_id", "branch", F.concat(F.lit(BEGIN), F.array_join(F.transform("turns", lambda t: t["turn"]), "")).alias("formatted"), F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    whole = F.substring(formatted, len(BEGIN) + 1, 2**31 - 1)
    pieces = F.filter(F.split(whole, CLOSE), lambda x: x != "")

    def turn(x):
        head = F.substring_index(x, MIDDLE, 1)
        return F.struct(unescape(F.substr(head, F.lit(len(OPEN) + 1))).alias("role"), unescape(F.substr(x, F.length(head) + len(MIDDLE) + 1)).alias("text"))

    return F.transform(pieces, turn)


def masked(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["chars"].cast("int")))), "")


def turn_nodes(turns: DataFrame) -> DataFrame:
    """Nodes of a table of turns (conv_id, turn, role, text): each turn replies to the one before it."""
    row = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return turns.select(F.col("conv_id").alias("tree_id"), row.alias("node_id"), "role", "text").select("*", (F.col("node_id") - 1).alias("parent_id"), F.lit(0.0).alias("score"))


def digest(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations."""
    read = formatted.select("*", parse(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss_spans")).alias("loss_text"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
