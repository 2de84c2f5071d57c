"""Chat formatting of reply trees, in DataFrame operations alone.

Root-to-leaf paths are enumerated by iterative self-joins with doubling: tables of the
1st, 2nd, 4th, ... ancestor are joined with themselves until no node has one, and each
leaf then collects all its ancestors in as many joins. Paths are ranked by the sum of
their nodes' scores, and each chosen path becomes one conversation.

Template of a turn: ``<|im_start|>`` role, line end, text, line end ``<|im_end|>`` line
end. A control string inside a text gets a backslash in front, also of backslashes that
stand before it already, so taking one away restores the text. A role has ``%``, line
end and ``<`` percent-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings, fixed values: those of this template and those of other templates in use.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = "|".join(c.translate({ord(x): "\\" + x for x in "|[]"}) for c in CONTROL)
_NO_CONV = -(2**63)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*(?:{_CONTROL}))", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*(?:{_CONTROL}))", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def turns_as_tree(turns: DataFrame, order: str = "turn") -> DataFrame:
    """Nodes of conversations that have no branches: each row's parent is the row before, by ``order``, role and text."""
    by = Window.partitionBy("conv_id").orderBy(F.col(order).asc_nulls_first(), F.col("role"), F.col("text"))
    place = F.row_number().over(by).cast("long")
    return turns.select("conv_id", place.alias("node_id"), F.when(place > 1, place - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def paths(nodes: DataFrame) -> DataFrame:
    """(conv_id, leaf_id, node_id, up): all nodes of each root-to-leaf path, ``up`` steps above the leaf.

    A node whose parent isn't there is a root. Nodes of a cycle, and what hangs below
    one, have no root and are in no path.
    """
    conv = F.coalesce(F.col("conv_id").cast("long"), F.lit(_NO_CONV)).alias("conv")
    links = cut(nodes.where("node_id IS NOT NULL").select(conv, F.col("node_id").alias("node"), F.col("parent_id").alias("parent")).dropDuplicates(["conv", "node"]))
    ids = links.select("conv", F.col("node").alias("parent"))
    step = links.where("parent IS NOT NULL").join(ids, ["conv", "parent"]).select("conv", "node", F.col("parent").alias("up"))
    leaves = links.select("conv", "node").join(step.select("conv", F.col("up").alias("node")).distinct(), ["conv", "node"], "left_anti")
    jumps, most = [], links.count()
    step = cut(step)
    while step.limit(1).count() and 1 << len(jumps) <= most:
        jumps.append(step)
        upper = step.select("conv", F.col("node").alias("up"), F.col("up").alias("upper"))
        step = cut(step.join(upper, ["conv", "up"]).select("conv", "node", F.col("upper").alias("up")))
    held = leaves.select("conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above"))
    endless = step.select("conv", F.col("node").alias("leaf")).distinct()  # steps that are left over go round in a cycle
    held = held.join(endless, ["conv", "leaf"], "left_anti")
    for k, jump in reversed(list(enumerate(jumps))):  # the longest first, so that short paths stay few rows until the last rounds
        both = F.array_compact(F.array(F.struct("node", "above"), F.when(F.col("up").isNotNull(), F.struct(F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above")))))
        held = held.join(jump, ["conv", "node"], "left").select("conv", "leaf", F.explode(both).alias("x")).select("conv", "leaf", "x.node", "x.above")
    return held.select(F.nullif("conv", F.lit(_NO_CONV)).alias("conv_id"), F.col("leaf").alias("leaf_id"), F.col("node").alias("node_id"), "above")


def format_trees(nodes: DataFrame, best: int | None = None, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One conversation for each chosen path of (conv_id, node_id, parent_id, role, text, score).

    Returns conv_id, leaf_id, score (sum over the path), rank (1 is best; ties by
    leaf_id), formatted, and spans: for each turn, in code points of ``formatted``, where
    it begins, where its text begins, and how much text is under the loss mask (0 if the
    role isn't in ``loss_roles``). ``best`` keeps so many paths of a tree; None keeps all.
    Null roles and texts are empty, null scores zero; a null conv_id is one tree. Of rows
    that repeat a node_id one stays. Other columns are not looked at.
    """
    own = nodes.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(_NO_CONV)).alias("conv"),
        F.col("node_id"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    ).dropDuplicates(["conv", "node_id"])
    on_path = paths(nodes).withColumn("conv", F.coalesce("conv_id", F.lit(_NO_CONV))).drop("conv_id")
    rows = on_path.join(own, ["conv", "node_id"])
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    turn = rows.withColumn("head", head).withColumn("body", body).withColumn("whole", F.concat("head", "body", F.lit(f"\n{END}\n")))
    down = Window.partitionBy("conv", "leaf_id").orderBy(F.col("above").desc())
    placed = turn.withColumn("begin", F.coalesce(F.sum(F.length("whole")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    span = F.struct(F.col("begin"), (F.col("begin") + F.length("head")).alias("start"), F.when(F.col("role").isin(*loss_roles), F.length("body")).otherwise(0).alias("length"))
    order = (-F.col("above")).alias("at")
    made = placed.groupBy("conv", "leaf_id").agg(F.sum("score").alias("score"), F.sort_array(F.collect_list(F.struct(order, F.col("whole"), span.alias("span")))).alias("turns"))
    ranked = made.withColumn("rank", F.row_number().over(Window.partitionBy("conv").orderBy(F.col("score").desc(), "leaf_id")))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    return ranked.select(F.nullif("conv", F.lit(_NO_CONV)).alias("conv_id"), "leaf_id", "score", "rank", F.array_join(F.transform("turns", lambda t: t["whole"]), "").alias("formatted"), F.transform("turns", lambda t: t["span"]).alias("spans"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation as they stand in it, each from its role on; a start with a backslash before it is text."""
    parts = F.split(formatted, rf"(?<!\\){START.replace('|', chr(92) + '|')}")
    return F.slice(parts, F.lit(2), F.size(parts) - 1)


def role_of(part: Column) -> Column:
    return unescape_role(F.substring_index(part, "\n", 1))


def text_of_turn(part: Column) -> Column:
    begin = F.length(F.substring_index(part, "\n", 1)) + 2
    return unescape(F.substring(part, begin, F.length(part) - begin + 1 - len(f"\n{END}\n")))
