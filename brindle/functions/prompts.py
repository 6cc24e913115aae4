"""Texts of retrieval prompts: item slots, example blocks, drift of codes."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.arrays import let
from brindle.functions.sid import BEGIN, END, WIDTH

RUN = r"(?:<\|sid_begin\|>.*?<\|sid_end\|>)+"
BLOCK = r"(?s)<\|sid_begin\|>.*?<\|sid_end\|>"
#: Words of a slot's label, the history that fills it, and how many items it takes; the last is the default.
SLOTS = ((("长时间",), "longview", 100), (("商品", "购物"), "product", 100), (("广告",), "ad", 200), ((), "video", 512))

#: Blocks whose codes are drawn once for all texts.
FIRST = 64


def slots_filled(text: Column, histories: dict[str, Column], target: Column | None = None) -> Column:
    """A prompt whose runs of item codes are replaced: the label before a run names the history that fills it.

    histories: by slot name, arrays of codes, the last items of which are taken; a name without one stays empty. The
    target's last code and a newline follow the text.
    """
    pieces = F.split(text, RUN, -1)

    def filling(label: Column) -> Column:
        out = None
        for words, name, limit in SLOTS:
            codes = histories.get(name)
            last = F.lit("") if codes is None else F.coalesce(F.array_join(F.slice(codes, F.greatest(F.size(codes) - limit + 1, F.lit(1)), F.lit(limit)), ""), F.lit(""))
            if not words:
                return last if out is None else out.otherwise(last)
            named = F.contains(label, F.lit(words[0]))
            for w in words[1:]:
                named = named | F.contains(label, F.lit(w))
            out = F.when(named, last) if out is None else out.when(named, last)
        return out

    filled = F.array_join(F.transform(pieces, lambda p, i: F.when(i < F.size(pieces) - 1, F.concat(p, filling(p))).otherwise(p)), "")
    if target is None:
        return filled
    last = F.try_element_at(target, F.lit(-1))
    return F.concat(filled, F.coalesce(F.concat(last, F.lit("\n")), F.lit("")))


def example_users(text: Column) -> Column:
    """The ids in the headers 'User <id>:' of a prompt's example blocks."""
    return F.regexp_extract_all(text, F.lit(r"User (\d+):"), F.lit(1))


def codes_replaced(text: Column, seed: int, width: int = WIDTH) -> Column:
    """Each code of each tagged block replaced by one drawn by hash of seed, block and place; blocks without a code stay."""
    # The same for every text, so those of the first places are drawn when the query is planned.
    first = F.lit([[int(md5(f"{seed}|{i}|{j}".encode()).hexdigest()[:8], 16) % width for j in range(4)] for i in range(FIRST)])
    hashed = lambda i, j: F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), i.cast("string"), j.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(width).cast("long"))
    number = lambda i, j: F.coalesce(F.get(F.get(first, i), j).cast("long"), hashed(i, j))

    def drawn(block: Column, i: Column) -> Column:
        new = lambda levels: F.transform(levels, lambda x, j: F.concat(F.lit("<s_"), x, F.lit("_"), number(i, j).cast("string"), F.lit(">")))
        changed = lambda levels: F.when(F.size(levels) > 0, F.concat(F.lit(BEGIN), F.array_join(new(levels), ""), F.lit(END))).otherwise(block)
        return let(F.regexp_extract_all(block, F.lit(r"<s_([a-z])_\d+>"), F.lit(1)), changed)

    def replaced(whole: Column) -> Column:
        # Each block is drawn once: what stands before it and its replacement are paired by place.
        blocks, between = F.transform(F.regexp_extract_all(whole, F.lit(BLOCK), F.lit(0)), drawn), F.split(whole, BLOCK, -1)
        return F.array_join(F.zip_with(between, blocks, lambda p, new: F.concat(p, F.coalesce(new, F.lit("")))), "")

    return let(text, replaced)


def item_of_code(items: Column, strategy: str, seed: Column) -> Column:
    """One item for a code, 0 for none. items: array of (pid, count, after) by falling count.

    'originally': the first. 'after': the largest count after downsampling, of equal ones one by hash. 'random': any, by hash.
    """
    draw = lambda found: let(found, lambda a: F.get(a, F.pmod(F.conv(F.substring(F.md5(seed.cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.greatest(F.size(a), F.lit(1)).cast("long")).cast("int")))["pid"]
    if strategy == "originally":
        found = F.get(items, 0)["pid"]
    elif strategy == "after":
        found = draw(let(F.array_max(F.transform(items, lambda x: x["after"])), lambda top: F.filter(items, lambda x: x["after"] == top)))
    elif strategy == "random":
        found = draw(items)
    else:
        raise ValueError(strategy)
    return F.coalesce(found, F.lit(0).cast("long"))
