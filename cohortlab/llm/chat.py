r"""Operator 10: reply trees to formatted conversations.

The template writes a turn as `<s>role\ntext</s>` for the assistant and `<s>[INST]role\ntext[/INST]</s>`
for everyone else. Inside roles and texts a backslash becomes `\e`, and the first character of a
control string becomes `\l` (for `<`) or `\b` (for `[`); a line break in a role becomes `\n`. So no
control string of a text survives in the output, and reading back restores every text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, let, table

CONTROL = r"(</?s>|<<?/?SYS>>|\[/?INST\])"
OPEN, CLOSE, ASK, ASKED = "<s>", "</s>", "[INST]", "[/INST]"


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\e"))
    out = F.regexp_replace(out, r"<(?=/?s>|</?SYS>>)", r"\\l")
    return F.regexp_replace(out, r"\[(?=/?INST\])", r"\\b")


def unescape(text: Column) -> Column:
    for code, plain in (("\\l", "<"), ("\\b", "["), ("\\e", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def turn_text(role: Column, text: Column) -> Column:
    body = F.concat(escape_role(role), F.lit("\n"), escape(text))
    return F.when(role == "assistant", F.concat(F.lit(OPEN), body, F.lit(CLOSE))).otherwise(F.concat(F.lit(OPEN + ASK), body, F.lit(ASKED + CLOSE)))


def _join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join by tree_id, where nulls are equal, and `on`, where they are not."""
    right = right.withColumnsRenamed({"tree_id": "_tree", on: "_on"})
    return left.join(right, F.col("tree_id").eqNullSafe(F.col("_tree")) & (F.col(on) == F.col("_on")), how).drop("_tree", "_on")


def paths(tree: DataFrame) -> DataFrame:
    """tree: (tree_id, node, parent). Returns (tree_id, leaf, node, depth): the members of each root-to-leaf path.

    Self-joins double the length of jumps: the k-th table holds each node's 2**k-th ancestor, a row
    a node and no list of what lies between. Nodes learn their depth on the way. From the leaves
    alone, the tables are then followed from the longest jump to the shortest, each doubling the
    ancestors known of a leaf, so the rows made are those of the result.

    A parent that is null or missing ends a path; nodes whose ancestors run in a cycle have no
    root and no path. A null tree_id is a tree of its own. An empty table has no paths.
    """
    known = tree.select("tree_id", F.col("node").alias("parent")).distinct()
    nodes = tree.select("tree_id", "node", "parent").dropDuplicates(["tree_id", "node"])
    linked = _join(nodes, known.withColumn("_there", F.lit(1)), "parent", "left").select("tree_id", "node", F.when(F.col("_there") == 1, F.col("parent")).alias("up"))
    # dist: the steps taken from the node; up: where they lead, null once the root is passed
    jumps = [cut(linked.withColumn("dist", F.when(F.col("up").isNotNull(), 1).otherwise(0)))]
    largest = tree.groupBy("tree_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while 1 << (len(jumps) - 1) < largest and jumps[-1].filter("up is not null").limit(1).count():
        last = jumps[-1]
        other = last.select("tree_id", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("dist2"))
        open_ = _join(last.filter("up is not null"), other, "up").select("tree_id", "node", F.col("up2").alias("up"), (F.col("dist") + F.col("dist2")).alias("dist"))
        jumps.append(cut(last.filter("up is null").unionByName(open_)))
    rooted = jumps[-1].filter("up is null")  # what still has an ancestor runs in a cycle
    leaves = _join(rooted.select("tree_id", "node", "dist"), linked.select("tree_id", F.col("up").alias("node")).filter("node is not null").distinct(), "node", "left_anti")
    member = leaves.select("tree_id", F.col("node").alias("leaf"), "node", F.col("dist").alias("depth"))
    for k in range(len(jumps) - 2, -1, -1):
        jump = jumps[k].filter("up is not null").select("tree_id", "node", "up")
        here, above = F.struct("node", "depth"), F.struct(F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"))
        member = _join(member, jump, "node", "left").select("tree_id", "leaf", F.explode(F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, above))).alias("s")).select("tree_id", "leaf", "s.node", "s.depth")
    return member


def format_trees(messages: DataFrame, best: int | None = None) -> DataFrame:
    """messages: (tree_id, node, parent, role, text, score). One row per chosen path: (tree_id, leaf,
    rank, score, n_turns, formatted, mask).

    Paths of a tree are ranked by the mean score of their messages (null: 0), ties by leaf; best
    is how many are formatted (None: all). mask has the (start, length) in code points of every
    assistant text as it stands, escaped, in formatted. Null roles and texts are empty; of
    messages with the same id one is taken. Messages with a null tree_id are one tree. An empty table gives an empty result.
    """
    member = _join(paths(messages), messages.dropDuplicates(["tree_id", "node"]).select("tree_id", "node", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score")), "node")
    role = F.coalesce("role", F.lit(""))
    turns = member.select("tree_id", "leaf", "score", F.struct("depth", role.alias("role"), turn_text(role, F.col("text")).alias("out"), F.length(escape_role(role)).alias("r")).alias("turn"))
    whole = turns.groupBy("tree_id", "leaf").agg(F.avg("score").alias("score"), F.sort_array(F.collect_list("turn")).alias("turns"))
    whole = whole.withColumn("rank", F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("score"), "leaf")))
    if best is not None:
        whole = whole.filter(F.col("rank") <= best)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask"))

    def step(acc: Column, t: Column) -> Column:
        head = len(OPEN) + 1 + t["r"]
        span = F.struct((acc["at"] + head).alias("start"), (F.length(t["out"]) - head - len(CLOSE)).alias("length"))
        mask = F.when(t["role"] == "assistant", F.concat(acc["mask"], F.array(span))).otherwise(acc["mask"])
        return F.struct((acc["at"] + F.length(t["out"])).alias("at"), mask.alias("mask"))

    return whole.select("tree_id", "leaf", "rank", "score", F.size("turns").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["out"]), "").alias("formatted"), F.aggregate("turns", start, step)["mask"].alias("mask"))


def read_back(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation."""

    def turn(x: Column) -> Column:
        body = F.substring(x, F.lit(len(OPEN) + 1), F.length(x))
        asked = body.startswith(ASK)
        body = F.when(asked, F.substring(body, F.lit(len(ASK) + 1), F.length(body) - len(ASK) - len(ASKED))).otherwise(body)
        cut_at = F.instr(body, F.lit("\n"))
        return let(F.struct(body.alias("b"), cut_at.alias("c")), lambda s: F.struct(unescape_role(F.substring(s["b"], F.lit(1), s["c"] - 1)).alias("role"), unescape(F.substring(s["b"], s["c"] + 1, F.length(s["b"]))).alias("text")))

    return F.transform(F.filter(F.split(formatted, CLOSE), lambda x: x != ""), turn)


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped span by span."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, m["start"] + 1, m["length"]))), "")


def linear(conversations: DataFrame) -> DataFrame:
    """conversations as trees with one branch: rows by turn, ties by role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order))
    return rows.select(F.col("conv_id").alias("tree_id"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    src = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(odd).alias("text"))
    out = format_trees(linear(src.unionByName(extra)))
    turns = F.array_join(F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.withColumn("_loss", masked_text(F.col("formatted"), F.col("mask")))
    return out.select(
        F.col("tree_id").alias("conv_id"), F.col("n_turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = r"""
WITH c AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, coalesce(role, '') AS r, regexp_replace(regexp_replace(replace(text, chr(92), chr(92) || 'e'), '<(/?s>|</?SYS>>)', chr(92) || chr(92) || 'l' || chr(92) || '1', 'g'),
  '\[(/?INST\])', chr(92) || chr(92) || 'b' || chr(92) || '1', 'g') AS x FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || text || chr(10), '' ORDER BY turn, r, text)) AS turns_sha256,
  sum(CASE WHEN r = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN r = 'assistant' THEN text END, '' ORDER BY turn, r, text), '')) AS loss_sha256,
  sum(length(x) + length(r) + 8 + CASE WHEN r = 'assistant' THEN 0 ELSE 13 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
