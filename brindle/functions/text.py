"""Text expressions: generations, answers, normalisation, seeded choice, chat messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.arrays import let

MESSAGES = "array<struct<role:string,content:string>>"


def nonblank(c: Column) -> Column:
    return c.isNotNull() & (F.length(F.trim(c)) > 0)


def first_nonempty(*columns: Column) -> Column:
    """The first that is neither NULL nor empty, else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def after_think(text: Column) -> Column:
    return F.trim(F.substring_index(text, "</think>", -1))


def think_content(text: Column) -> Column:
    """Contents of the first think block, '' without one."""
    return F.trim(F.regexp_extract(text, r"(?s)<think>(.*?)</think>", 1))


def has_thought(text: Column, least: int = 10) -> Column:
    return F.length(F.regexp_replace(think_content(text), r"\s", "")) > least


def count_tag(text: Column, tag: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(tag), F.lit("")))) / len(tag)).cast("long")


def most_per_line(text: Column, tag: str) -> Column:
    """The most occurrences of a tag in one line."""
    return F.array_max(F.transform(F.split(text, "\n"), lambda x: count_tag(x, tag)))


def after_keyword(text: Column, keyword: str) -> Column:
    """What follows the last keyword, without leading markup."""
    return F.regexp_replace(F.substring_index(text, keyword, -1), r"^[\s:*#\-]+", "")


def unfenced(text: Column) -> Column:
    """A response without its code fences."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(json)?", ""), r"```$", ""))


def json_from_response(text: Column, schema: str) -> Column:
    """The response's braced part parsed as JSON, or else all of it without fences."""
    plain = unfenced(text)
    return F.coalesce(F.from_json(F.nullif(F.regexp_extract(plain, r"(?s)(\{.*\})", 1), F.lit("")), schema), F.from_json(plain, schema))


def normalised_answer(text: Column) -> Column:
    """Lower case without punctuation, articles and extra white space."""
    plain = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    # (?U): an article beside a letter outside ASCII is part of its word; white space is Unicode's and the four separators.
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?U)\b(a|an|the)\b", " "), r"(?U)[\s\x1c-\x1f]+", " "))


def exact_match(answer: Column, golden: Column) -> Column:
    mine = normalised_answer(answer)
    return F.exists(golden, lambda g: normalised_answer(g) == mine).cast("double")


def contains_match(answer: Column, golden: Column) -> Column:
    mine = normalised_answer(answer)
    return F.exists(golden, lambda g: F.contains(mine, normalised_answer(g))).cast("double")


def last_answer(text: Column) -> Column:
    """Contents of the last <answer> block, NULL without one."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1))
    return F.trim(F.try_element_at(found, F.lit(-1)))


def qa_score(text: Column, golden: Column, format_score: float = 0.0, full: float = 1.0, sub: bool = False) -> Column:
    """0 without an answer, the full score for a match (a quarter of it with more than ten answer tags), else format_score."""
    answer = last_answer(text)
    ok = contains_match(answer, golden) if sub else exact_match(answer, golden)
    many = (count_tag(text, "<answer>") > 10) | (count_tag(text, "</answer>") > 10)
    return F.when(answer.isNull(), 0.0).when(ok == 1.0, F.when(many, full / 4).otherwise(full)).otherwise(F.lit(format_score))


def gsm8k_answer(text: Column, strict: bool = True, window: int = 300) -> Column:
    """The number after the last '####', or the last number; looks at the last `window` characters."""
    tail = F.substring(text, -window, window)
    if strict:
        found = F.regexp_extract_all(tail, F.lit(r"#### (\-?[0-9\.\,]+)"), F.lit(1))
        return F.regexp_replace(F.try_element_at(found, F.lit(-1)), r"[,$]", "")
    found = F.filter(F.regexp_extract_all(tail, F.lit(r"(\-?[0-9\.\,]+)"), F.lit(1)), lambda x: ~x.isin("", "."))
    return F.try_element_at(found, F.lit(-1))


def gsm8k_score(text: Column, truth: Column, strict: bool = True, format_score: float = 0.0) -> Column:
    answer = gsm8k_answer(text, strict)
    return F.when(answer.isNull(), 0.0).when(answer == truth, 1.0).otherwise(F.lit(format_score))


def yes_no(text: Column) -> Column:
    """1 if the text has the positive sign, else 0 if it has the negative one, else NULL."""
    return F.when(F.contains(text, F.lit("是")), 1).when(F.contains(text, F.lit("否")), 0)


def seeded(seed: int, key: Column, slot: str, n: int) -> Column:
    """A number below n that depends on seed, key and slot alone (first 32 bits of an MD5)."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), F.lit(slot)).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(n).cast("long"))


def output_path(path: Column, out: str, base: str | None = None) -> Column:
    """Where a file's result goes below `out`: at its place relative to `base`, or by its name if it is elsewhere."""
    name = F.concat(F.lit(f"{out.rstrip('/')}/"), F.substring_index(path, "/", -1))
    if base is None:
        return name
    root = f"{base.rstrip('/')}/"
    return F.when(F.startswith(path, F.lit(root)), F.concat(F.lit(f"{out.rstrip('/')}/"), F.substr(path, F.lit(len(root) + 1)))).otherwise(name)


def choice(options: list[str], seed: int, key: Column, slot: str) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (seeded(seed, key, slot, len(options)) + 1).cast("int"))


def stable_uuid(*parts: Column) -> Column:
    d = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
    return F.concat_ws("-", *[F.substring(d, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def message(role: str, text: Column) -> Column:
    part = F.struct(F.lit("text").alias("type"), text.alias("text"))
    return F.struct(F.lit(role).alias("role"), F.array(part).alias("content"))


def messages_json(*turns: Column) -> Column:
    return F.to_json(F.array(*turns))


def segments_json(text: Column) -> Column:
    return F.to_json(F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))))


def joined_content(parts: Column) -> Column:
    """The texts of a list of typed parts, joined."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "")


def with_prefix_on_last_user(messages: Column, prefix: Column) -> Column:
    """prefix put before the last message's content if its role is user; else the messages as they are."""
    last = F.size(messages) - 1
    changed = F.transform(messages, lambda m, i: F.when((i == last) & (m["role"] == "user"), F.struct(m["role"].alias("role"), F.concat(prefix, m["content"]).alias("content"))).otherwise(m))
    return F.when(F.size(messages) > 0, changed).otherwise(messages)


def tagged_users(messages: Column, tag: str) -> Column:
    """A think switch appended to every user message."""
    return F.transform(messages, lambda m: F.when(m["role"] == "user", F.struct(m["role"].alias("role"), F.concat(m["content"], F.lit(tag)).alias("content"))).otherwise(m))


def think_switches(messages: Column) -> Column:
    """Assistant messages without a think block get an empty one; the user message before says /think or /no_think."""

    def turned(m: Column, i: Column) -> Column:
        after = F.get(messages, i + 1)
        thinks = F.length(think_content(after["content"])) > 0
        switch = F.when(thinks, F.lit("/think")).otherwise(F.lit("/no_think"))
        user = F.struct(m["role"].alias("role"), F.concat(m["content"], switch).alias("content"))
        helper = F.struct(m["role"].alias("role"), F.concat(F.lit("<think>\n\n</think>\n"), m["content"]).alias("content"))
        return (
            F.when((m["role"] == "user") & (after["role"] == "assistant"), user)
            .when((m["role"] == "assistant") & ~F.contains(m["content"], F.lit("<think>")), helper)
            .otherwise(m)
        )

    return F.transform(messages, turned)


def until_first_exchange(messages: Column) -> Column:
    """Messages up to the first one by which both a user and an assistant have spoken; NULL if that never happens."""
    roles = F.transform(messages, lambda m: m["role"])
    user, helper = F.array_position(roles, "user"), F.array_position(roles, "assistant")
    return F.when((user > 0) & (helper > 0), F.slice(messages, F.lit(1), F.greatest(user, helper).cast("int")))


def tool_calls(text: Column) -> Column:
    """name and arguments of JSON calls between tool_call tags."""
    raw = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    return F.filter(F.transform(raw, lambda x: F.from_json(F.trim(x), "name string, arguments string")), lambda c: c["name"].isNotNull())


def passages(docs: Column) -> Column:
    """Retrieved (title, text) passages as one numbered string."""
    return F.array_join(F.transform(docs, lambda d, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), d["title"], F.lit(")\n"), d["text"], F.lit("\n"))), "\n")


def content_text(content: Column) -> Column:
    """The text of a message's content in any of its forms, parsed once: plain text, a part, or a list of parts and texts.

    Parts of another type than text add nothing. What is no JSON object or list, broken JSON included, is plain text; an
    object that is no text part, and an empty list, are an error for the caller: NULL.
    """

    def read(v: Column) -> Column:
        part = lambda p: F.coalesce(F.when(F.try_variant_get(p, "$.type", "string") == "text", F.try_variant_get(p, "$.text", "string")), F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")), F.lit(""))
        parts = F.try_variant_get(v, "$", "array<variant>")
        kind = F.schema_of_variant(v)
        listed = F.when(F.size(parts) > 0, F.array_join(F.transform(parts, part), ""))
        single = F.when(F.try_variant_get(v, "$.type", "string") == "text", F.coalesce(F.try_variant_get(v, "$.text", "string"), F.lit("")))
        return F.when(kind.startswith("ARRAY"), listed).when(kind.startswith("OBJECT"), single).otherwise(content)

    return let(F.try_parse_json(content), read)
