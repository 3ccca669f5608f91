"""Chat formatting: reply trees to conversations, best branches first, native DataFrame operations throughout."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourselake.llm.common import written

END = "</turn>"


def escape(text: Column) -> Column:
    """Break control strings inside a text with a backslash; `unescape` gives the text back exactly."""
    return F.regexp_replace(text, r"\\|(?<=##)#|(?<=<)/(?=turn>)", r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def branches(messages: DataFrame, top: int = 1) -> DataFrame:
    """Root-to-leaf paths of reply trees as rows (tree, leaf, rank, depth, node), the `top` best of each tree.

    `messages`: tree, node, parent, role, text, score. Links to the 1st, 2nd, 4th, ... ancestor come from self-joins of
    the link table, and each leaf doubles its known ancestors per round, so a thread of n replies takes log2(n) joins.
    A branch scores the sum of its messages (null: 0); ties go to the smallest leaf. A message whose parent is not
    there is a root. Messages on or below a cycle of replies are on no path. Repeated (tree, node) rows count once, the
    smallest. Null trees and nodes are values like others.
    """
    score = F.coalesce(F.col("score").cast("decimal(24,6)"), F.lit(0).cast("decimal(24,6)"))
    nodes = messages.select(F.struct("tree", "node").alias("key"),
                            F.when(F.col("parent").isNotNull(), F.struct("tree", F.col("parent").alias("node"))).alias("up"),
                            score.alias("score"))
    nodes = written(nodes.groupBy("key").agg(F.min(F.struct("up", "score")).alias("m")).select("key", "m.*"))
    links = nodes.where("up is not null").select("key", "up").join(nodes.select(F.col("key").alias("up")), "up")
    links = written(links.select("key", "up"))
    deepest = nodes.groupBy(F.col("key.tree")).count().agg(F.max("count")).first()[0] or 1
    known = nodes.join(links.select(F.col("up").alias("key")), "key", "left_anti").select(
        F.col("key").alias("leaf"), F.col("key").alias("at"), F.lit(0).alias("hops"))
    for k in range(max(1, math.ceil(math.log2(deepest + 1)))):
        further = known.join(links.withColumnRenamed("key", "at"), "at").select(
            "leaf", F.col("up").alias("at"), (F.col("hops") + F.lit(1 << k)).alias("hops"))
        known = written(known.unionByName(further))
        twice = links.join(links.select(F.col("key").alias("up"), F.col("up").alias("next")), "up")
        links = written(twice.select("key", F.col("next").alias("up")))
    known = known.join(links.select(F.col("key").alias("leaf")).distinct(), "leaf", "left_anti")  # these never end: cycles
    best = known.join(nodes.select(F.col("key").alias("at"), "score"), "at").groupBy("leaf").agg(
        F.sum("score").alias("score"), F.max("hops").alias("length"))
    order = Window.partitionBy("leaf.tree").orderBy(F.desc("score"), "leaf")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return known.join(best.drop("score"), "leaf").select(
        F.col("leaf.tree").alias("tree"), F.col("leaf.node").alias("leaf"), "rank",
        (F.col("length") - F.col("hops")).alias("depth"), F.col("at.node").alias("node"))


def format_chat(messages: DataFrame, top: int = 1, learn: str = "assistant") -> DataFrame:
    """One formatted conversation per chosen branch: tree, leaf, rank, formatted, loss.

    A turn is `### <role>: <text></turn>` and a line end; the role is URL-encoded and the text escaped, so turns can be
    read back exactly. `loss` lists the code point spans (start, length) of the texts of role `learn`. Null role or text
    is empty; an empty table gives no rows; texts may have any length.
    """
    said = messages.groupBy("tree", "node").agg(F.min(F.struct("role", "text")).alias("m"))
    said = said.select(F.struct("tree", "node").alias("key"), F.coalesce("m.role", F.lit("")).alias("role"),
                       F.coalesce("m.text", F.lit("")).alias("text"))
    path = branches(messages, top).withColumn("key", F.struct("tree", "node")).drop("node")
    turn = path.join(said, "key").withColumn("head", F.concat(F.lit("### "), F.url_encode("role"), F.lit(": ")))
    turn = turn.withColumn("body", escape(F.col("text"))).withColumn(
        "size", F.length("head") + F.length("body") + len(END) + 1)
    before = Window.partitionBy("tree", "leaf", "rank").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    turn = turn.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)) + F.length("head"))
    piece = F.struct("depth", F.concat("head", "body", F.lit(END + "\n")).alias("turn"), (F.col("role") == learn).alias("learn"),
                     F.struct(F.col("start").cast("int").alias("start"), F.length("body").alias("length")).alias("span"))
    made = turn.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(piece)).alias("all"))
    return made.select("tree", "leaf", "rank", F.array_join(F.transform("all", lambda t: t["turn"]), "").alias("formatted"),
                       F.transform(F.filter("all", lambda t: t["learn"]), lambda t: t["span"]).alias("loss"))


def parse(formatted: Column) -> Column:
    """array<struct<role,text>> read back from a formatted conversation."""
    turns = F.split(formatted, END + "\n", -1)
    return F.transform(F.slice(turns, 1, F.size(turns) - 1), lambda t: F.struct(
        F.url_decode(F.substring_index(F.substr(t, F.lit(5)), ": ", 1)).alias("role"),
        unescape(F.substr(t, F.instr(t, ": ") + 2)).alias("text")))


def learned(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, joined and unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")
