"""Corpus builders: interaction rows to chat and pre-training samples.

Builders take `uid`, `split` and parallel arrays, keep split 0, truncate before the lookup (unknown ids shorten a list),
render codes and templates, and drop rows whose rendered history or target is empty. Templates are parameters; the
choice among several is by a hash of seed and user, so it does not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import arrays as A
from brindle.functions import text as T
from brindle.operators.lookup import lookup_arrays

SYSTEMS = ["You recommend videos.", "You know what viewers like."]
USERS = ["The viewer watched: {}. What comes next?", "History: {}. Continue it.", "After {} the viewer opens:"]
#: Questions about one item.
ITEMS = [f"{ask} {{}}{end}" for ask, end in (
    ("Describe", ""), ("Describe in detail", ""), ("What does", " show?"), ("What is in", "?"), ("Explain", ""), ("Tell me about", ""), ("Summarise", ""), ("What happens in", "?"), ("Write a caption for", ""), ("Analyse", ""),
    ("What is", " about?"), ("Interpret", ""), ("Say what", " contains"), ("Give the content of", ""), ("Which scenes does", " have?"), ("Introduce", ""), ("Put into words:", ""), ("Read", " and describe it"), ("Who or what is in", "?"), ("List the details of", ""),
)]
ACTIONS = ("longview", "like", "follow", "forward", "not_interested")


def training(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce("split", F.lit(0)) == 0)


def rendered(template: Column, value: Column) -> Column:
    return F.replace(template, F.lit("{}"), value)


def _chat(df: DataFrame, seed: int, prompt: Column, answer: Column, systems: list[str], keep: list[str] | None = None) -> DataFrame:
    system = T.choice(systems, seed, F.col("uid"), "system")
    return df.select("uid", *(keep or []), T.messages_json(T.message("system", system), T.message("user", prompt), T.message("assistant", answer)).alias("messages"))


def pretrain_video(df: DataFrame, codes: DataFrame, oldest: int = 512, targets: int = 10) -> DataFrame:
    """Segments of the oldest history items and the first targets."""
    found = lookup_arrays(training(df), "uid", {"h": A.oldest(F.col("hist_pid"), oldest), "t": A.oldest(F.col("target_pid"), targets)}, codes, "pid", "code")
    text = F.concat(F.array_join("h", ""), F.array_join("t", ""))
    return found.where(F.size("h") > 0).select("uid", T.segments_json(text).alias("segments"))


def pretrain_profile(df: DataFrame, profile: str) -> DataFrame:
    return training(df).where(T.nonblank(F.col(profile))).select("uid", T.segments_json(F.col(profile)).alias("segments"))


def pretrain_item(items: DataFrame, codes: DataFrame, seed: int = 42) -> DataFrame:
    """One of three templates of an item's code and caption, one of them JSON."""
    both = items.where(T.nonblank(F.col("caption"))).join(codes, "pid")
    as_json = F.to_json(F.struct(F.col("code").alias("item"), "caption"))
    text = F.element_at(
        F.array(F.concat_ws(": ", "code", "caption"), F.concat(F.lit("Item "), "code", F.lit(" shows "), "caption"), as_json), (T.seeded(seed, F.col("pid"), "item", 3) + 1).cast("int")
    )
    return both.select("pid", T.segments_json(text).alias("segments"))


def sft_video(df: DataFrame, codes: DataFrame, newest: int = 512, targets: int = 10, seed: int = 42, systems: list[str] = SYSTEMS, users: list[str] = USERS) -> DataFrame:
    """Chat of the newest history items and the first targets."""
    found = lookup_arrays(training(df), "uid", {"h": A.newest(F.col("hist_pid"), newest), "t": A.oldest(F.col("target_pid"), targets)}, codes, "pid", "code")
    usable = found.where((F.size("h") > 0) & (F.size("t") > 0))
    return _chat(usable, seed, rendered(T.choice(users, seed, F.col("uid"), "user"), F.array_join("h", "")), F.array_join("t", ""), systems)


def sft_ad(df: DataFrame, codes: DataFrame, views: int = 100, ads: int = 200, targets: int = 10, seed: int = 42) -> DataFrame:
    """Watched videos and clicked ads, at least one of the two, then target ads."""
    found = lookup_arrays(
        training(df), "uid", {"v": A.newest(F.col("longview_pid"), views), "a": A.newest(F.col("ad_pid"), ads), "t": A.oldest(F.col("target_pid"), targets)}, codes, "pid", "code"
    )
    part = lambda name, title: F.when(F.size(name) > 0, F.concat(F.lit(f"{title}: "), F.array_join(name, "")))
    usable = found.where(((F.size("v") > 0) | (F.size("a") > 0)) & (F.size("t") > 0))
    return _chat(usable, seed, F.concat_ws("\n", part("v", "Watched"), part("a", "Clicked ads")), F.array_join("t", ""), SYSTEMS)


def sft_product(df: DataFrame, videos: DataFrame, products: DataFrame, newest: int = 100, targets: int = 10, seed: int = 42) -> DataFrame:
    """Two code tables: watched videos and bought products, then target products."""
    rows = training(df)
    v = lookup_arrays(rows, "uid", {"v": A.newest(F.col("longview_pid"), newest)}, videos, "pid", "code")
    g = lookup_arrays(rows, "uid", {"g": A.newest(F.col("goods_pid"), newest), "t": A.oldest(F.col("target_goods_pid"), targets)}, products, "pid", "code")
    both = g.where(F.size("t") > 0).join(v, "uid", "left")
    part = lambda name, title: F.when(F.size(name) > 0, F.concat(F.lit(f"{title}: "), F.array_join(name, "")))
    prompt = F.concat_ws("\n", part("v", "Watched"), part("g", "Bought"))
    return _chat(both.where(prompt != ""), seed, prompt, F.array_join("t", ""), SYSTEMS)


def sft_interactive(df: DataFrame, codes: DataFrame, history: int = 512, targets: int = 10, seed: int = 42) -> DataFrame:
    """One sample per keyword of a JSON map keyword -> item ids. A user's history is looked up once, whatever the number of keywords."""
    asked = F.map_entries(F.from_json("keyword_items", "map<string,array<bigint>>"))
    lists = F.concat(
        F.array(F.struct(F.lit(None).cast("string").alias("keyword"), A.newest(F.col("hist_pid"), history).cast("array<bigint>").alias("ids"))),
        F.transform(asked, lambda e: F.struct(e["key"].alias("keyword"), A.oldest(e["value"], targets).alias("ids"))),
    )
    each = training(df).select("uid", F.explode(lists).alias("e")).select("uid", "e.keyword", F.posexplode("e.ids").alias("pos", "id"))
    found = each.join(codes.select(F.col("pid").cast("long").alias("id"), F.col("code")), "id").select("uid", "keyword", "pos", "code")
    # Dealt by user, so that a user's lists meet without another shuffle.
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]), "")
    per = found.repartition("uid").groupBy("uid", "keyword").agg(text.alias("text"))
    whole = per.groupBy("uid").agg(F.max(F.when(F.col("keyword").isNull(), F.col("text"))).alias("h"), F.collect_list(F.when(F.col("keyword").isNotNull(), F.struct("keyword", "text"))).alias("asked"))
    samples = whole.select("uid", "h", F.explode("asked").alias("a")).select("uid", "h", "a.*")
    prompt = F.concat(F.lit("History: "), F.coalesce("h", F.lit("")), F.lit("\nThe viewer asks for: "), "keyword")
    return _chat(samples, seed, prompt, F.col("text"), SYSTEMS, ["keyword"])


def sft_label_cond(df: DataFrame, codes: DataFrame, last: int = 10, targets: int = 10, seed: int = 42) -> DataFrame:
    """History per action (mask, then the last items, then lookup) and the targets of one action chosen among those with any."""
    rows = training(df)
    wanted = F.array_compact(F.array(*[F.when(F.size(A.masked(F.col("target_pid"), F.col(f"target_{a}"))) > 0, F.lit(a)) for a in ACTIONS]))
    picked = rows.withColumn("wanted", wanted).where(F.size("wanted") > 0)
    draw = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("uid").cast("string"), F.lit("action")).cast("binary")), 1, 8), 16, 10).cast("long"), F.size("wanted").cast("long"))
    picked = picked.withColumn("action", F.element_at("wanted", (draw + 1).cast("int")))
    target = F.coalesce(*[F.when(F.col("action") == a, A.masked(F.col("target_pid"), F.col(f"target_{a}"))) for a in ACTIONS])
    slots = {a: A.newest(A.masked(F.col("hist_pid"), F.col(f"hist_{a}")), last) for a in ACTIONS} | {"t": A.oldest(target, targets)}
    found = lookup_arrays(picked, "uid", slots, codes, "pid", "code", ["action"]).where(F.size("t") > 0)
    parts = [F.when(F.size(a) > 0, F.concat(F.lit(f"{a}: "), F.array_join(a, ""))) for a in ACTIONS]
    prompt = F.concat_ws("\n", *parts, F.concat(F.lit("predict: "), "action"))
    return _chat(found, seed, prompt, F.array_join("t", ""), SYSTEMS, ["action"])


def sft_label_pred(df: DataFrame, codes: DataFrame, candidates: int = 10, action: str = "longview", seed: int = 42) -> DataFrame:
    """One yes/no sample per candidate; needs a mask as long as the targets."""
    rows = training(df).where(F.size("target_pid") == F.size(f"target_{action}"))
    pairs = F.slice(F.arrays_zip(F.col("target_pid").alias("p"), F.col(f"target_{action}").alias("m")), 1, candidates)
    each = rows.select("uid", F.posexplode(pairs).alias("pos", "c")).select("uid", "pos", F.col("c.p").alias("pid"), F.col("c.m").alias("label"))
    found = each.join(codes, "pid")
    answer = F.when(F.col("label") == 1, F.lit("是")).otherwise(F.lit("否"))
    return _chat(found, seed, F.concat(F.lit("Will the viewer finish "), "code", F.lit("?")), answer, SYSTEMS, ["pos", "label"])


def sft_item(items: DataFrame, codes: DataFrame, seed: int = 42, systems: list[str] = SYSTEMS, users: list[str] = ITEMS) -> DataFrame:
    """A question about an item's code and its caption as the answer; both prompts are drawn per item."""
    both = items.where(T.nonblank(F.col("caption"))).join(codes, "pid").withColumn("uid", F.col("pid"))
    return _chat(both, seed, rendered(T.choice(users, seed, F.col("uid"), "user"), F.col("code")), F.col("caption"), systems)


def sft_reason(df: DataFrame, seed: int = 42) -> DataFrame:
    """Needs profile, target caption and reasoning; a missing list of similar captions is written as None."""
    usable = training(df).where(T.nonblank(F.col("profile")) & T.nonblank(F.col("target_caption")) & T.nonblank(F.col("cot")))
    prompt = F.concat_ws("\n", F.col("profile"), F.concat(F.lit("Similar: "), F.coalesce("similar", F.lit("None"))), F.concat(F.lit("Target: "), "target_caption"))
    return _chat(usable, seed, prompt, F.trim("cot"), SYSTEMS)


def rl_prompt(df: DataFrame, tag: str) -> DataFrame:
    """All but the last message as prompt, the last one's content as ground truth, a think switch on every user message."""
    usable = df.where(F.size("messages") > 0)
    return usable.withColumn("prompt", T.tagged_users(F.slice("messages", F.lit(1), F.size("messages") - 1), tag)).withColumn("ground_truth", F.element_at("messages", -1)["content"])


def rl_canonical(df: DataFrame, source: str, question: str, answer: str, ability: str, split: str, order: str) -> DataFrame:
    """The canonical reinforcement-learning row with a running index (by range counts, not one task)."""
    from brindle.operators.batch import with_row_id

    rows = with_row_id(df, [order])
    return rows.select(
        F.lit(source).alias("data_source"),
        F.array(F.struct(F.lit("user").alias("role"), F.col(question).alias("content"))).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.col(answer).alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), F.col("row_id").alias("index")).alias("extra_info"),
    )


def preference_pairs(df: DataFrame) -> DataFrame:
    """Chosen and rejected answers as two labelled rows."""
    both = F.array(F.struct(F.lit(1).alias("label"), F.col("chosen").alias("answer")), F.struct(F.lit(0).alias("label"), F.col("rejected").alias("answer")))
    return df.select("prompt", F.explode(both).alias("x")).select("prompt", "x.*")


def shuffled_choices(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Wrong choices in hash order, the gold one put at a hashed place; `letter` names it."""
    order = F.transform(F.array_sort(F.transform("wrong", lambda x, i: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), i.cast("string")).cast("binary")).alias("h"), x.alias("x")))), lambda p: p["x"])
    place = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), F.lit("gold")).cast("binary")), 1, 8), 16, 10).cast("long"), (F.size("wrong") + 1).cast("long")).cast("int")
    rows = df.withColumn("order", order).withColumn("place", place)
    return rows.select(key, F.array_insert("order", F.col("place") + 1, F.col("gold")).alias("choices"), F.chr((F.col("place") + 65).cast("long")).alias("letter"))


def char_count_samples(n: int, spark, seed: int = 42) -> DataFrame:
    """Synthetic counting questions: a word, a letter, a worked answer."""
    word = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.chr(97 + T.seeded(seed, F.concat_ws(":", F.col("id").cast("string"), i.cast("string")), "char", 6))), "")
    rows = spark.range(n).select("id", word.alias("word")).withColumn("letter", F.substring("word", 1, 1))
    steps = F.transform(F.split("word", ""), lambda c: F.concat(c, F.lit(" "), (c == F.col("letter")).cast("int").cast("string")))
    count = (F.length("word") - F.length(F.replace("word", F.col("letter"), F.lit("")))).cast("long")
    return rows.select("id", "word", "letter", F.array_join(steps, "\n").alias("steps"), count.alias("answer"))
