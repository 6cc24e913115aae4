"""Chat formatting of reply trees, on DataFrame functions alone.

A message names its tree, its own number and its parent's. Iterative self-joins double each message's pointer towards
its root, adding up depth and score, so a path of n messages takes log2(n) joins of narrow rows. A tree's branches are
its leaves, ranked by their path's score, then depth, then number; the chosen leaves' paths are marked by the same
doubled pointers, and each path becomes one conversation.

Template: `<|role|>`, newline, text, `<|end|>`, newline. Inside texts and roles `&`, `<` and `[` are written as
entities (`|` too in roles), so no control string can occur there, and reading back undoes it exactly.

Numbers are unique within a tree. A message whose parent is missing begins a path. Messages that answer each other in a
circle have no root: pointers that still move after as many rounds as the number of messages allows are in one or lead to
one, and the circle is cut above its smallest number, which becomes a root.

Nulls, ties and repeats: null texts and roles are empty; rows of equal turn follow each other by role and text; repeated
rows are turns of their own; rows with a null conversation id can't be told to belong together, so each is a conversation
of its own, and they are no hot key; rows of a given conversation -1 join the probe that op6_chat adds under that id. Very
long texts are formatted whole. An empty table gives the probe alone. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import written

END = "<|end|>\n"


def escape(text: Column, role: bool = False) -> Column:
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))
    return F.replace(safe, F.lit("|"), F.lit("&#124;")) if role else safe


def unescape(text: Column) -> Column:
    plain = F.replace(F.replace(F.replace(text, F.lit("&#124;"), F.lit("|")), F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<"))
    return F.replace(plain, F.lit("&amp;"), F.lit("&"))


def without_circles(nodes: DataFrame, rounds: int) -> DataFrame:
    """nodes with the parent of each circle's smallest number removed; no tree has more than 2**rounds messages."""
    low = nodes.where("parent IS NOT NULL").select("tree", "node", F.col("parent").alias("up"), F.least("node", "parent").alias("low"))
    for _ in range(rounds):
        above = low.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("low").alias("low2"))
        low = written(low.join(above, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), F.least("low", "low2").alias("low")), "chat-circles")
    # After that many steps every pointer is on a circle, and every message of a circle is pointed at.
    circles = low.select("tree", F.col("up").alias("node")).distinct().join(low.select("tree", "node", "low"), ["tree", "node"])
    cut = circles.where("node = low").select("tree", "node", F.lit(True).alias("cut"))
    whole = nodes.join(cut, ["tree", "node"], "left").withColumn("parent", F.when(F.col("cut").isNull(), F.col("parent")))
    return written(whole.select(*nodes.columns), "chat-nodes")


def chosen_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """tree, leaf, node, depth of every message on the best `branches` paths of each tree; nodes: tree, node, parent, score."""
    start = written(nodes.select("tree", "node", F.col("parent").alias("up"), F.col("parent").isNotNull().cast("long").alias("depth"), F.col("score").cast("double").alias("score")), "chat-pointers")
    # Messages whose pointer has passed their root are done and join no further.
    going, now, jumps, zero = start.where("up IS NOT NULL"), start, [], F.lit(0)
    rounds = max(start.count(), 1).bit_length()
    while going.limit(1).count():
        if len(jumps) > rounds:
            return chosen_paths(without_circles(nodes, rounds), branches)
        jumps.append(going.select("tree", "node", "up"))
        above = now.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("score").alias("score2"))
        moved = going.join(above, ["tree", "up"], "left").select(
            "tree", "node", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("depth2", zero)).alias("depth"), (F.col("score") + F.coalesce("score2", zero)).alias("score")
        )
        moved = written(moved, "chat-pointers")
        going, now = moved.where("up IS NOT NULL"), now.where("up IS NULL").unionByName(moved)
    parents = nodes.where("parent IS NOT NULL").select("tree", F.col("parent").alias("node")).distinct()
    leaves = now.join(parents, ["tree", "node"], "left_anti")
    place = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("score").desc(), F.col("depth").desc(), "node"))
    marked = leaves.withColumn("place", place).where(F.col("place") <= branches).select("tree", F.col("node").alias("leaf"), "node")
    for jump in jumps:
        marked = written(marked.unionByName(marked.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"))), "chat-marked")
    return marked.join(now.select("tree", "node", "depth"), ["tree", "node"]).select("tree", "leaf", "node", "depth")


def formatted(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """tree, leaf, formatted, loss (character spans of assistant texts in it); messages: tree, node, role, text."""
    turn = F.struct("depth", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = paths.join(messages, ["tree", "node"]).groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    pieces = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit("<|"), escape(t["role"], role=True), F.lit("|>\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("learned")
    ))
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + len(END)).alias("at"),
            F.when(p["learned"], F.array_append(acc["spans"], F.struct((acc["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).cast("long").alias("length")))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    whole = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return turns.select("tree", "leaf", pieces.alias("pieces")).select("tree", "leaf", whole.alias("formatted"), spans["spans"].alias("loss"))


def read_back(output: DataFrame) -> DataFrame:
    """The same rows with `turns` (role, text) and `learned` (the texts under the loss mask), from `formatted` and `loss` alone."""
    cut = F.transform(F.split("formatted", r"<\|end\|>\n"), lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(3)), "|>\n", 1)).alias("role"),
        unescape(F.substr(p, F.instr(p, "|>\n") + 3)).alias("text"),
    ))
    turns = F.slice(cut, F.lit(1), F.size(cut) - 1)
    learned = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return output.withColumn("turns", turns).withColumn("learned", learned)


def chains(conversations: DataFrame) -> DataFrame:
    """Linear conversations as trees: tree, node, parent, score, role, text; every message answers the one before it."""
    alone = F.concat(F.lit("null:"), F.monotonically_increasing_id().cast("string"))
    tree = F.coalesce(F.col("conv_id").cast("string"), alone)
    node = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")).cast("long")
    placed = conversations.select(tree.alias("tree"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).withColumn("node", node)
    return placed.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")


def threads(conversations: DataFrame, width: int = 4) -> DataFrame:
    """Reply trees of `width` conversations with neighbouring ids: the first message of the one with the smallest id is the
    root, the first messages of the others answer it. A message scores one point per 16 characters; null ids are left out."""
    given = conversations.where("conv_id IS NOT NULL")
    group = F.floor(F.col("conv_id") / width).cast("long")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = given.select(group.alias("tree"), "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    placed = placed.withColumn("node", F.row_number().over(Window.partitionBy("tree").orderBy(*order)).cast("long"))
    place = F.row_number().over(Window.partitionBy("tree", "conv_id").orderBy("node"))
    parent = F.when(place > 1, F.col("node") - 1).when(F.col("node") > 1, F.lit(1).cast("long"))
    return placed.select(F.col("tree").cast("string").alias("tree"), "node", parent.alias("parent"), F.floor(F.length("text") / 16).cast("double").alias("score"), "role", "text")


def best_branches(conversations: DataFrame, branches: int = 2) -> DataFrame:
    """tree, leaf, n_turns, turns_sha256 of the best branches of each thread, read back from the formatted output."""
    messages = written(threads(conversations), "chat-messages")
    output = formatted(chosen_paths(messages.select("tree", "node", "parent", "score"), branches), messages.select("tree", "node", "role", "text"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(output).select(F.col("tree").cast("long").alias("tree"), "leaf", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"))


def op6_chat(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    probe = spark.sql("SELECT -1L conv_id, t turn, r role, '</s>[INST] ok [/INST]' text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    messages = written(chains(conversations.select("conv_id", "turn", "role", "text").unionByName(probe)), "chat-messages")
    output = formatted(chosen_paths(messages.select("tree", "node", "parent", "score")), messages.select("tree", "node", "role", "text"))
    back = read_back(written(output, "chat-output"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return back.select(
        F.when(~F.col("tree").startswith("null:"), F.col("tree")).cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
