"""Chat formatting from reply trees.

Messages point to the message they answer. Self-joins double the reach of every
pointer per round, so a path of length d takes log2(d) rounds: first upwards to
score each branch from its leaf to its root, then along the same pointers to list the
messages of the branches chosen. Each of these becomes one conversation.

The template gives ``<|turn|>role<|text|>text<|end|>`` and a line break per turn. In roles and
texts, ``\\`` becomes ``\\\\``, ``<`` becomes ``\\l`` and ``[`` becomes ``\\b``; as every control
string of chat templates begins with ``<`` or ``[``, none is left in them, and
the way back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pinwright.sources.shared import staged

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
ESCAPES = (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b"))


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    """Cut at escaped backslashes from the left; what lies between has the other codes only."""
    parts = F.split(text, r"\\\\", -1)

    def plain(part: Column) -> Column:
        for mark, code in ESCAPES[1:]:
            part = F.replace(part, F.lit(code), F.lit(mark))
        return part

    return F.array_join(F.transform(parts, plain), "\\")


def pointers(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables (tree, node, anc, total) of 2^k answers up and the scores on the way, and the ends.

    Only messages that have not reached their root go into the next round; the ends hold each
    of the others with the score of its whole path. A parent that is not there makes a root;
    messages on a circle have no root, and the rounds end when the reach passes the number
    of messages.
    """
    known = messages.select("tree", "node").alias("p")
    first = messages.alias("m").join(
        known, F.col("m.tree").eqNullSafe(F.col("p.tree")) & (F.col("m.parent") == F.col("p.node")), "left")
    jump = staged(first.select(F.col("m.tree").alias("tree"), F.col("m.node").alias("node"),
                               F.col("p.node").alias("anc"), F.col("m.score").alias("total")), "reply-jump")
    size, tables, done = jump.count(), [], jump.where("anc IS NULL")
    while True:
        above = jump.where("anc IS NOT NULL")
        if above.isEmpty() or 1 << len(tables) > 2 * size:
            return tables, done.select("tree", "node", "total")
        tables.append(above)
        a, b = above.alias("a"), above.unionByName(done).alias("b")
        jump = staged(a.join(b, F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.anc") == F.col("b.node")))
                      .select("a.tree", "a.node", F.col("b.anc").alias("anc"),
                              (F.col("a.total") + F.col("b.total")).alias("total")), "reply-jump")
        done = done.unionByName(jump.where("anc IS NULL"))


def best_branches(messages: DataFrame, scored: DataFrame, branches: int) -> DataFrame:
    """(tree, leaf): the leaves whose paths score highest, ``branches`` per tree; ties by leaf."""
    parents = messages.select(F.col("tree").alias("t"), F.col("parent").alias("p")).where("p IS NOT NULL").distinct()
    leaves = scored.join(parents, scored["tree"].eqNullSafe(parents["t"]) & (scored["node"] == parents["p"]), "left_anti")
    order = Window.partitionBy("tree").orderBy(F.col("total").desc(), "node")
    return (leaves.withColumn("place", F.row_number().over(order)).where(F.col("place") <= branches)
            .select("tree", F.col("node").alias("leaf")))


def branch_messages(leaves: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(tree, leaf, node, height): all messages from each leaf (height 0) up to its root."""
    path = leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("height"))
    for k, jump in enumerate(jumps):
        p, j = path.alias("p"), jump.alias("j")
        above = (p.join(j, F.col("p.tree").eqNullSafe(F.col("j.tree")) & (F.col("p.node") == F.col("j.node")))
                 .select("p.tree", "p.leaf", F.col("j.anc").alias("node"), (F.col("p.height") + (1 << k)).alias("height")))
        path = staged(path.unionByName(above), "reply-path")
    return path


def format_branches(messages: DataFrame, branches: int = 1, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(tree, leaf, formatted, loss_spans): one conversation per chosen branch.

    ``messages`` has tree, node (unique in its tree), parent (null: a root), role, text and score.
    ``loss_spans`` lists the stretches (start, chars), in code points of ``formatted``, of the escaped
    texts to learn from. Null roles and texts are empty, null scores zero; a null tree is a tree.
    A conversation is one value by nature, and bounded by what a row may hold.
    """
    messages = staged(messages.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"),
                                      F.coalesce("text", F.lit("")).alias("text"),
                                      F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "messages")
    jumps, scored = pointers(messages)
    path = branch_messages(best_branches(messages, scored, branches), jumps)
    p, m = path.alias("p"), messages.alias("m")
    rows = p.join(m, F.col("p.tree").eqNullSafe(F.col("m.tree")) & (F.col("p.node") == F.col("m.node"))).select(
        "p.tree", "p.leaf", (-F.col("p.height")).alias("place"), escaped(F.col("m.role")).alias("role"),
        escaped(F.col("m.text")).alias("text"), F.col("m.role").isin(*loss_roles).alias("learn"))
    turns = rows.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text", "learn"))).alias("t"))
    whole = F.array_join(F.transform("t", lambda t: F.concat(
        F.lit(TURN), t["role"], F.lit(TEXT), t["text"], F.lit(END))), "")
    frame = len(TURN) + len(TEXT) + len(END)
    spans = F.aggregate(
        "t", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,chars:bigint>>").alias("s")),
        lambda acc, t: F.struct(
            (acc["at"] + frame + F.length(t["role"]) + F.length(t["text"])).alias("at"),
            F.when(t["learn"], F.concat(acc["s"], F.array(F.struct(
                (acc["at"] + len(TURN) + F.length(t["role"]) + len(TEXT)).alias("start"),
                F.length(t["text"]).cast("long").alias("chars"))))).otherwise(acc["s"]).alias("s")),
        lambda acc: acc["s"])
    return turns.select("tree", "leaf", whole.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as (role, text), unescaped."""
    cut = F.slice(F.split(formatted, r"<\|turn\|>", -1), 2, 1 << 30)
    return F.transform(cut, lambda turn: F.struct(
        unescaped(F.substring_index(turn, TEXT, 1)).alias("role"),
        unescaped(F.substring_index(F.substring_index(turn, TEXT, -1), END, 1)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(
        F.substring(formatted, (s["start"] + 1).cast("int"), s["chars"].cast("int")))), "")


def conversation_tree(turns: DataFrame) -> DataFrame:
    """Plain conversations as trees with one branch: each turn answers the one before it.

    Turns of one number are ordered by role and text, null first.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    place = F.row_number().over(order).cast("long")
    return turns.select(F.col("conv_id").alias("tree"), place.alias("node"),
                        F.when(place > 1, place - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


PROBE = "</s>[INST] ok [/INST]"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)],
                                  "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    made = format_branches(conversation_tree(turns.unionByName(probe)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (made.withColumn("turns", read_turns(F.col("formatted")))
            .withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
            .select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
                    F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                    F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")))


OP3_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(role || text) + length(regexp_replace(role || text, '[^\\<\[]', '', 'g')) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
