"""Stand-ins for interaction tables, made from orders and line items: in Spark, and the same as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.sid import sid_format
from brindle.plans.registry import Tables

ACTION_TESTS = {"longview": "l_quantity > 25", "like": "l_discount > 0.05", "follow": "l_tax > 0.04", "forward": "l_returnflag = 'R'", "not_interested": "l_returnflag = 'A'"}


def clicks(t: Tables) -> DataFrame:
    """One row per line item: uid, ts, ok, ln, pid, sup, flag and the five action marks."""
    marks = [F.expr(f"CAST({test} AS INT)").alias(a) for a, test in ACTION_TESTS.items()]
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("o_custkey").alias("uid"), F.col("o_orderdate").alias("ts"), F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pid"),
        F.col("l_suppkey").alias("sup"), F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"), *marks,
    )


def interactions(t: Tables) -> DataFrame:
    """uid, split and parallel arrays; the last three items are targets."""
    fields = ["pid", "sup", *ACTION_TESTS]
    rows = clicks(t).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("ts", "ok", "ln", *fields))).alias("x"))
    item = lambda f: F.transform("x", lambda e: e[f])
    past = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 3, F.lit(0)))
    last = lambda a: F.slice(a, F.greatest(F.size(a) - 2, F.lit(1)), F.lit(3))
    wide = rows.select("uid", *[item(f).alias(f) for f in fields])
    picked = lambda f, m: F.transform(F.filter(F.arrays_zip(past(F.col(f)).alias("p"), past(F.col(m)).alias("m")), lambda z: z["m"] == 1), lambda z: z["p"])
    return wide.select(
        "uid", F.when(F.col("uid") % 5 == 4, 1).otherwise(0).alias("split"), past(F.col("pid")).alias("hist_pid"), last(F.col("pid")).alias("target_pid"),
        picked("pid", "longview").alias("longview_pid"), picked("pid", "like").alias("ad_pid"), past(F.col("sup")).alias("goods_pid"), last(F.col("sup")).alias("target_goods_pid"),
        *[past(F.col(a)).alias(f"hist_{a}") for a in ACTION_TESTS], *[last(F.col(a)).alias(f"target_{a}") for a in ACTION_TESTS],
    )


def codes(t: Tables) -> DataFrame:
    """pid -> code text; every seventh item has none."""
    code = F.array((F.col("p_partkey") % 8192).cast("int"), F.col("p_size").cast("int"), F.length("p_name"))
    return t.part.where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("pid"), sid_format(code).alias("code"))


def goods_codes(t: Tables) -> DataFrame:
    code = F.array((F.col("s_suppkey") % 8192).cast("int"), F.col("s_nationkey").cast("int"), F.lit(1))
    return t.supplier.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("pid"), sid_format(code).alias("code"))


def captions(t: Tables) -> DataFrame:
    """pid, caption: part names with some blank."""
    return t.part.select(F.col("p_partkey").alias("pid"), F.when(F.col("p_partkey") % 11 == 0, F.lit("  ")).otherwise(F.col("p_name")).alias("caption"))


def baskets(t: Tables) -> DataFrame:
    """Ranked predictions and truths per user: predictions are an order's items by price, truths the user's last items."""
    rows = interactions(t).where("size(hist_pid) >= 4")
    return rows.select("uid", F.reverse(F.slice("hist_pid", F.greatest(F.size("hist_pid") - 31, F.lit(1)), F.lit(32))).alias("pred"), F.concat("target_pid", F.slice("hist_pid", 1, 2)).alias("truth"))


_PAST, _LAST = "{0}[1:greatest(len({0})-3,0)]", "{0}[greatest(len({0})-2,1):]"
CLICKS = "clicks AS (SELECT o_custkey AS uid, o_orderdate AS ts, l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pid, l_suppkey AS sup, l_returnflag AS flag, l_extendedprice AS price, l_quantity AS qty, " + ", ".join(
    f'CAST({test} AS INT) AS "{a}"' for a, test in ACTION_TESTS.items()
) + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
INTER = (
    CLICKS
    + ", listed AS (SELECT uid, "
    + ", ".join(f'list("{f}" ORDER BY ts, ok, ln, pid, sup, longview, "like", follow, forward, not_interested) AS "{f}"' for f in ("pid", "sup", *ACTION_TESTS))
    + " FROM clicks GROUP BY uid), inter AS (SELECT uid, CASE WHEN uid % 5 = 4 THEN 1 ELSE 0 END AS split, "
    + f"{_PAST.format('pid')} AS hist_pid, {_LAST.format('pid')} AS target_pid, {_PAST.format('sup')} AS goods_pid, {_LAST.format('sup')} AS target_goods_pid, "
    + ", ".join(f"""{_PAST.format(f'"{a}"')} AS hist_{a}, {_LAST.format(f'"{a}"')} AS target_{a}""" for a in ACTION_TESTS)
    + " FROM listed)"
)
_SID = "'<|sid_begin|><s_a_' || {} || '><s_b_' || {} || '><s_c_' || {} || '><|sid_end|>'"
CODES = f"codes AS (SELECT p_partkey AS pid, {_SID.format('p_partkey % 8192', 'p_size', 'length(p_name)')} AS code FROM part WHERE p_partkey % 7 <> 0)"
GOODS = f"goods AS (SELECT s_suppkey AS pid, {_SID.format('s_suppkey % 8192', 's_nationkey', '1')} AS code FROM supplier WHERE s_suppkey % 3 <> 0)"
CAPTIONS = "captions AS (SELECT p_partkey AS pid, CASE WHEN p_partkey % 11 = 0 THEN '  ' ELSE p_name END AS caption FROM part)"
BASKETS = "baskets AS (SELECT uid, list_reverse(hist_pid[greatest(len(hist_pid)-31,1):]) AS pred, list_concat(target_pid, hist_pid[1:2]) AS truth FROM inter WHERE len(hist_pid) >= 4)"


def found(name: str, array: str, source: str = "inter", table: str = "codes", key: str = "uid") -> str:
    """A CTE with the codes of an array's ids, joined in order."""
    return f"{name}_x AS (SELECT {key}, unnest({array}) AS pid, generate_subscripts({array}, 1) AS pos FROM {source}), {name} AS (SELECT {key}, string_agg(code, '' ORDER BY pos) AS {name}_s FROM {name}_x JOIN {table} USING (pid) GROUP BY {key})"


def draw(key: str, n: int | str) -> str:
    return f"CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT) % {n}"


def pick(options: list[str], key: str) -> str:
    named = ", ".join("'" + o.replace("'", "''") + "'" for o in options)
    return f"list_extract([{named}], CAST({draw(key, len(options))} AS BIGINT) + 1)"


def chat(*turns: tuple[str, str]) -> str:
    return "CAST(to_json([" + ", ".join(f"{{'role': '{role}', 'content': [{{'type': 'text', 'text': {text}}}]}}" for role, text in turns) + "]) AS VARCHAR)"
