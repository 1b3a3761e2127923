"""Chat formatting of reply trees, in DataFrame operations only.

Every message names the one it replies to. Iterative self-joins give each node its
ancestors at distance 1, 2, 4, ...; from these every leaf collects its whole path to the
root in as many joins as the depth has binary digits. Branches are ranked by the mean
score of their messages, and each chosen path becomes one conversation with a loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteglass.llm.common import saved

#: Marks of the template. Texts can't hold them: what begins a mark is escaped.
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
#: What is escaped, in this order; read back in the opposite one. "<" and "[" begin the
#: control strings of the usual chat templates, so none survives in a text.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
_ROLE_ESCAPES = (*ESCAPES, ("\n", "&#10;"))
#: Roles whose texts a model learns to write.
LEARNT_ROLES = ("assistant",)


def _swap(text: Column, pairs) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escaped(text: Column) -> Column:
    return _swap(text, ESCAPES)


def unescaped(text: Column) -> Column:
    return _swap(text, [(b, a) for a, b in reversed(_ROLE_ESCAPES)])


def _key(column: str) -> Column:
    """An id as a text that is never NULL."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("none"))


def messages(nodes: DataFrame) -> DataFrame:
    """Nodes (tree_id, node_id, parent_id, role, text, score) with keys in place of ids that may be
    missing; one row per node. Of rows with the same tree and node the first by parent,
    role, text and score counts."""
    first = F.min(F.struct("parent_id", "role", "text", "score", "tree_id", "node_id")).alias("m")
    return nodes.groupBy(_key("tree_id").alias("tree"), _key("node_id").alias("node")).agg(first).select("tree", "node", "m.*")


def leaf_paths(skeleton: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): each leaf's path, itself (up 0) to the root, for ``skeleton`` (tree, node, parent).

    A node whose parent is missing or unknown is a root. Replies that only lead into a
    circle have no root and no path.
    """
    own = skeleton.select("tree", F.col("node").alias("parent"))
    steps = [saved(skeleton.join(own, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("above")), "step")]
    largest = skeleton.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while not steps[-1].isEmpty() and 1 << (len(steps) - 1) <= largest:
        last = steps[-1]
        onward = last.select("tree", F.col("node").alias("above"), F.col("above").alias("next"))
        steps.append(saved(last.join(onward, ["tree", "above"]).select("tree", "node", F.col("next").alias("above")), "step"))
    circling = steps[-1].select("tree", "node")
    answered = steps[0].select("tree", F.col("above").alias("node")).distinct()
    leaves = skeleton.select("tree", "node").join(answered, ["tree", "node"], "left_anti").join(circling, ["tree", "node"], "left_anti")
    paths = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("up"))
    for k in reversed(range(len(steps) - 1)):
        above = paths.join(steps[k], ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        paths = saved(paths.union(above), "paths")
    return paths


def conversations(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """The best ``branches`` root-to-leaf paths of every tree, formatted.

    Columns: tree_id, leaf_id, branch_rank (from 1), branch_score (mean score of the path, missing
    scores as 0; ties to the smaller leaf), n_turns, formatted, loss_spans (array of start and
    size in characters, from 0: the escaped texts of learnt roles). NULL roles and
    texts count as empty. Further columns of ``nodes`` are ignored.
    """
    known = saved(messages(nodes), "messages")
    skeleton = known.select("tree", "node", F.when(F.col("parent_id").isNotNull(), _key("parent_id")).alias("parent"))
    paths = leaf_paths(skeleton)
    scored = paths.join(known.select("tree", "node", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), ["tree", "node"])
    order = Window.partitionBy("tree").orderBy(F.desc("branch_score"), F.length("leaf"), "leaf")
    chosen = (
        scored.groupBy("tree", "leaf").agg(F.avg("score").alias("branch_score"))
        .withColumn("branch_rank", F.row_number().over(order)).where(F.col("branch_rank") <= branches)
    )
    chosen = saved(chosen, "branches")
    turns = paths.join(chosen.select("tree", "leaf"), ["tree", "leaf"], "left_semi").join(known, ["tree", "node"])
    head = F.concat(F.lit(BEGIN), _swap(F.coalesce("role", F.lit("")), _ROLE_ESCAPES), F.lit("\n"))
    parts = turns.select(
        "tree", "leaf", "up", "tree_id", "node_id", head.alias("head"), escaped(F.coalesce("text", F.lit(""))).alias("body"),
        F.coalesce(F.col("role").isin(*LEARNT_ROLES), F.lit(False)).alias("learnt"),
    )
    size = F.length("head") + F.length("body") + len(END)
    so_far = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parts.withColumn("start", F.sum(size.cast("bigint")).over(so_far) - len(END) - F.length("body"))
    turn = F.struct((-F.col("up")).alias("place"), F.concat("head", "body", F.lit(END)).alias("turn"), "start", F.length("body").cast("bigint").alias("size"), "learnt")
    whole = placed.groupBy("tree", "leaf").agg(
        F.first("tree_id").alias("tree_id"), F.max(F.when(F.col("up") == 0, F.col("node_id"))).alias("leaf_id"),
        F.array_sort(F.collect_list(turn)).alias("turns"),
    )
    return whole.join(chosen, ["tree", "leaf"]).select(
        "tree_id", "leaf_id", "branch_rank", "branch_score", F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t.turn), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t.learnt), lambda t: F.struct(t.start.alias("start"), t.size.alias("size"))).alias("loss_spans"),
    )


def read_back(formatted: str = "formatted") -> Column:
    """The turns of a formatted conversation: array of role and text, as they were."""
    blocks = F.split(F.col(formatted), r"<\|im_end\|>\n", -1)
    blocks = F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), lambda b: F.substring(b, len(BEGIN) + 1, 2**31 - 1))

    def turn(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substr(block, F.length(role) + 2)).alias("text"))

    return F.transform(blocks, turn)


def learnt_text(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    cut = lambda s: unescaped(F.substr(F.col(formatted), (s.start + 1).cast("int"), s.size.cast("int")))
    return F.array_join(F.transform(spans, cut), "")
