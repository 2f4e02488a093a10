"""Operator 10: chat formatting of reply trees. DataFrame functions only.

Messages are nodes with a parent. Iterative self-joins double the reach of each node's jump pointer (1, 2, 4, ... replies
up), summing scores on the way, until every pointer has passed its root; so a path of n replies takes log2(n) joins. Leaves
are ranked by the score of their path, and the same jumps, largest first, then enumerate the nodes of every chosen path,
each once. A chosen path becomes one conversation.

Template: each turn is START role, newline, text, END. Control strings inside a role or text get a backslash behind their
first character and backslashes are doubled, so no control string survives in a text and one rule undoes it: drop a
backslash, keep what follows. The loss mask is held by segments: the formatted text is their concatenation.

Defined results: null role and null text are empty; both may be of any length. Nodes of a null tree are one tree. A node
whose parent is missing is a root. Repeated nodes (same tree and id) are reduced to the smallest (role, text). Equal scores go
by the smaller leaf id. Nodes on a cycle have no root and take no part. An empty table gives an empty table. Only the columns
named are read and returned, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalith.session import written

START, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings of common chat templates; fixed values.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|/<>" and c not in "<>/" else c for c in s)


_CONTROL = "|".join(f"(?<={_quoted(c[0])})(?={_quoted(c[1:])})" for c in CONTROL)


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, _CONTROL, r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    """As texts; a newline ends the role and is escaped too."""
    return F.regexp_replace(escape(role), "\n", "\\\\\\\n")


def _matched(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined with right on tree, null trees being equal, and on key."""
    right = right.withColumnsRenamed({"tree": "__tree", key: "__key"})
    return left.join(right.hint("merge"), left["tree"].eqNullSafe(right["__tree"]) & (left[key] == right["__key"]), how).drop("__tree", "__key")


def jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame, list[str]]:
    """Jump tables (tree, node, up) for 1, 2, 4, ... replies, then (tree, node, root, depth, total) and the scratch paths."""
    spark = nodes.sparkSession
    parents = nodes.select("tree", F.col("node").alias("up"))
    first = _matched(nodes.select("tree", "node", F.col("parent").alias("up"), "score"), parents.withColumn("known", F.lit(True)), "up", "left")
    first = first.select("tree", "node", F.when(F.col("known"), F.col("up")).alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth"))
    state, at = written(first)
    tables, paths = [], [at]
    done = state.where(F.col("up").isNull())
    limit = max(1, state.count()).bit_length() + 1
    while True:
        live = state.where(F.col("up").isNotNull())
        if live.isEmpty() or len(tables) > limit:
            break
        tables.append(live.select("tree", "node", "up"))
        reached = live.unionByName(done)  # where the pointers of this round end; only pointers still on their way are joined
        above = reached.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("depth").alias("depth2"))
        joined = _matched(live, above, "up").select(
            "tree", "node", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("depth") + F.col("depth2")).alias("depth")
        )
        state, at = written(joined)
        paths.append(at)
        done = done.unionByName(state.where(F.col("up").isNull()))
    return tables, done.select("tree", "node", "depth", "total"), paths


def paths_of(nodes: DataFrame, keep: int | None = 1) -> DataFrame:
    """The keep best root-to-leaf paths of each tree (all if None): tree, path (rank from 1), leaf, position, role, text.

    nodes: tree, node, parent, role, text, score."""
    nodes = nodes.groupBy("tree", "node").agg(
        F.min("parent").alias("parent"),
        F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("said"),
        F.max(F.coalesce(F.col("score").cast("double"), F.lit(0.0))).alias("score"),
    )
    nodes, nodes_at = written(nodes.select("tree", "node", "parent", "said.role", "said.text", "score"))
    tables, ends, _ = jumps(nodes.select("tree", "node", "parent", "score"))
    inner = nodes.where(F.col("parent").isNotNull()).select("tree", F.col("parent").alias("node"))
    leaves = _matched(ends, inner, "node", "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc("total"), "node")
    leaves = leaves.withColumn("path", F.row_number().over(order))
    if keep is not None:
        leaves = leaves.where(F.col("path") <= keep)
    members = leaves.select("tree", "path", F.col("node").alias("leaf"), "node", F.col("depth").alias("position"))
    for r in reversed(range(len(tables))):
        up = _matched(members, tables[r], "node").select("tree", "path", "leaf", F.col("up").alias("node"), (F.col("position") - F.lit(1 << r)).alias("position"))
        members, _ = written(members.unionByName(up))
    return _matched(members, nodes.select("tree", "node", "role", "text"), "node").select("tree", "path", "leaf", "position", "role", "text")


def format_paths(paths: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row for each path: tree, path, leaf, n_turns, formatted, segments (text, loss)."""
    turns = paths.groupBy("tree", "path", "leaf").agg(F.array_sort(F.collect_list(F.struct("position", "role", "text"))).alias("turns"))

    def segments(t: Column) -> Column:
        head = F.struct(F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("text"), F.lit(False).alias("loss"))
        body = F.struct(escape(t["text"]).alias("text"), (t["role"] == loss_role).alias("loss"))
        return F.array(head, body, F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")))

    out = turns.select("tree", "path", "leaf", F.size("turns").cast("long").alias("n_turns"), F.flatten(F.transform("turns", segments)).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.filter(F.split(formatted, _quoted(END), -1), lambda x: x != "")

    def turn(x: Column) -> Column:
        said = F.substr(x, F.lit(len(START) + 1))
        role = F.regexp_extract(said, r"(?s)^([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n", 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(said, F.char_length(role) + 2)).alias("text"))

    return F.transform(parts, turn)


def loss_text(segments: Column) -> Column:
    """What the loss mask covers, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def conversation_nodes(rows: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees of one path: each row replies to the one before it."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    numbered = rows.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("node"))
    return numbered.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
