"""Training-side operators over the driver's tables: losses, estimators, validation, FLOPs, dispatch, tasks, prompts, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import policy as P
from brindle.functions import prompts
from brindle.operators import groupwise as G
from brindle.operators import lookup as L
from brindle.operators import training as T
from brindle.plans import views as V
from brindle.plans.batches import ROWS, rows
from brindle.plans.evaluation import MASKED, RECURSE, RESP, _adv, responses
from brindle.plans.registry import query
from brindle.session import scratch
from brindle.sources import cache, generated, io, tar, tracking, workbook
from brindle.streaming.stateful import requeued

# One row per token: an order's lines.

KEYS = ("row", "pos", "part", "supp")
TOKENS = "k AS (SELECT l_orderkey AS row, l_linenumber AS pos, l_partkey AS part, l_suppkey AS supp, -30 * l_tax AS logp, -30 * l_discount AS old, (l_quantity - 25) / 5 AS adv, CAST(l_returnflag <> 'N' AS INT) AS mask FROM lineitem)"


def tokens(t):
    return t.lineitem.select(
        F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
        (-30 * F.col("l_tax")).alias("logp"), (-30 * F.col("l_discount")).alias("old"), ((F.col("l_quantity") - 25) / 5).alias("adv"), (F.col("l_returnflag") != "N").cast("int").alias("mask"),
    )


COVARIANCE = f"""{TOKENS}, a AS (SELECT avg(adv) AS ma, avg(logp) AS mp, count(*) AS n FROM k WHERE mask > 0),
c AS (SELECT k.*, n, (adv - ma) * (logp - mp) AS cov, -adv * exp(logp - old) AS l1, -adv * least(greatest(exp(logp - old), 0.8), 1.2) AS l2 FROM k, a)"""


@query("fn_policy_loss_clip_cov", f"""WITH {COVARIANCE}, e AS (SELECT *, (mask > 0 AND NOT l2 > l1 AND cov > 1 AND cov < 5) AS open FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY open ORDER BY md5('42|' || row || '|' || pos || '|' || part || '|' || supp), row, pos, part, supp) AS place FROM e),
l AS (SELECT mask, open AND place <= greatest(CAST(floor(0.01 * n) AS BIGINT), 1) AS dropped, greatest(l1, l2) AS loss FROM p)
SELECT round(avg(CASE WHEN dropped THEN 0 ELSE loss END), 6) AS loss, count(*) FILTER (dropped) AS dropped FROM l WHERE mask > 0""")
def _(t):
    out = T.LOSSES.named("clip_cov")(tokens(t), keys=KEYS, share=0.01).where("mask > 0")
    return out.agg(F.round(F.avg("loss"), 6).alias("loss"), F.count_if("dropped").alias("dropped"))


@query("fn_policy_loss_kl_cov", f"""WITH {COVARIANCE}, p AS (SELECT *, row_number() OVER (ORDER BY cov DESC, row, pos, part, supp) AS place FROM c WHERE mask > 0),
l AS (SELECT place <= greatest(CAST(floor(0.01 * n) AS BIGINT), 1) AS dropped, l1, abs(logp - old) AS kl FROM p)
SELECT round(avg(l1 + CASE WHEN dropped THEN 0.5 * kl ELSE 0 END), 6) AS loss, count(*) FILTER (dropped) AS dropped FROM l""")
def _(t):
    out = T.LOSSES.named("kl_cov")(tokens(t), keys=KEYS, share=0.01, coefficient=0.5).where("mask > 0")
    return out.agg(F.round(F.avg("loss"), 6).alias("loss"), F.count_if("dropped").alias("dropped"))


@query("fn_policy_loss_registry", f"""WITH {TOKENS}, r AS (SELECT *, exp(least(sum((logp - old) * mask) OVER w / greatest(sum(mask) OVER w, 1), 10)) AS seq FROM k WINDOW w AS (PARTITION BY row))
SELECT round(avg(greatest(-adv * seq, -adv * least(greatest(seq, 0.8), 1.2))), 6) AS gspo, round(avg(-logp * adv), 6) AS gpg FROM r WHERE mask > 0""")
def _(t):
    rows_ = T.LOSSES.named("gpg")(T.LOSSES.named("gspo")(tokens(t)).withColumnRenamed("loss", "gspo")).where("mask > 0")
    return rows_.agg(F.round(F.avg("gspo"), 6).alias("gspo"), F.round(F.avg("loss"), 6).alias("gpg"))


# Estimators over token arrays.


def arrays(t):
    made = V.interactions(t).where("size(hist_pid) > 0")
    r = F.transform("hist_pid", lambda v: v / F.lit(1000.0))
    return made.select("uid", r.alias("r"), F.transform(r, lambda x: x * 0.5).alias("v"), F.col("hist_like").alias("m"), (F.col("uid") % 5).cast("double").alias("b"))


def first_and_total(df, name: str):
    """The first and the summed entries of an array column, rounded; -0.0 becomes 0.0."""
    add = F.aggregate(name, F.lit(0.0), lambda a, x: a + x)
    return df.select("uid", (F.round(F.get(name, F.lit(0)), 4) + 0.0).alias("first"), (F.round(add, 4) + 0.0).alias("total"))


@query("agg_remax", f"WITH {MASKED}, e AS (SELECT uid, unnest(x) / 1000 AS r, unnest(m) AS m, generate_subscripts(m, 1) AS i FROM m), s AS (SELECT uid, i, sum(r * m) OVER (PARTITION BY uid ORDER BY i DESC) - (uid % 5) * m AS a FROM e) SELECT uid, round(max(CASE WHEN i = 1 THEN a END), 4) + 0.0 AS first, round(sum(a), 4) + 0.0 AS total FROM s GROUP BY uid")
def _(t):
    return first_and_total(T.remax(arrays(t), "r", "m", "b"), "advantage")


WHITEN = "z AS (SELECT sum(m) AS n, sum(x * m) / sum(m) AS mean, (sum(x * x * m) / sum(m) - (sum(x * m) / sum(m)) ** 2) * sum(m) / (sum(m) - 1) AS var FROM y)"


@query("agg_reinforce_plus_plus", f"WITH RECURSIVE {RECURSE}, k AS (SELECT uid, i, m, r AS x, r * m AS run FROM e WHERE i = n UNION ALL SELECT e.uid, e.i, e.m, e.r + 0.9 * k.run, (e.r + 0.9 * k.run) * e.m FROM k JOIN e ON e.uid = k.uid AND e.i = k.i - 1), y AS (SELECT * FROM k), {WHITEN} SELECT uid, round(max(CASE WHEN i = 1 THEN (x - mean) / sqrt(var + 1e-8) * m END), 4) + 0.0 AS first, round(sum((x - mean) / sqrt(var + 1e-8) * m), 4) + 0.0 AS total FROM y, z GROUP BY uid")
def _(t):
    return first_and_total(T.reinforce_plus_plus(arrays(t), "r", "m", 0.9), "advantage")


@query("agg_gae_whitened", f"WITH RECURSIVE {RECURSE}, k AS (SELECT uid, i, m, m * 0.5 * r AS x, m * 0.5 * r AS nv FROM e WHERE i = n UNION ALL SELECT e.uid, e.i, e.m, CASE WHEN e.m > 0 THEN e.r + 0.9 * k.nv - 0.5 * e.r + 0.72 * k.x ELSE k.x END, CASE WHEN e.m > 0 THEN 0.5 * e.r ELSE k.nv END FROM k JOIN e ON e.uid = k.uid AND e.i = k.i - 1), y AS (SELECT * FROM k), {WHITEN} SELECT uid, round(max(CASE WHEN i = 1 THEN (x - mean) / sqrt(var + 1e-8) END), 4) + 0.0 AS first, round(sum((x - mean) / sqrt(var + 1e-8)), 4) + 0.0 AS total FROM y, z GROUP BY uid")
def _(t):
    return first_and_total(T.gae(arrays(t), "r", "v", "m", 0.9, 0.8), "advantage")


@query("agg_loo_vectorised", f"WITH {RESP} SELECT id, round(CASE WHEN count(*) OVER w > 1 THEN (count(*) OVER w * r - sum(r) OVER w) / (count(*) OVER w - 1) ELSE 0 END, 3) + 0.0 AS advantage FROM x WINDOW w AS (PARTITION BY g)")
def _(t):
    return _adv(G.get_estimator("rloo_vectorised")(responses(t), "g", "r"))


# Validation and preferences.


@query("agg_validation_at", """WITH g AS (SELECT o_orderpriority AS source, o_custkey AS prompt, list({'x': o_totalprice, 'v': o_orderstatus} ORDER BY o_orderkey) AS r, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1),
k AS (SELECT *, unnest(list_distinct(list_concat(list_filter([2, 4, 8, 16, 32, 64, 128, 256], lambda z: z < n), [n]))) AS k FROM g),
p AS (SELECT source, prompt, k, d, i, r[CAST('0x' || substr(md5('42|' || source || '|' || prompt || '|' || k || '|' || d || '|' || i), 1, 8) AS BIGINT) % n + 1] AS e FROM (SELECT *, unnest(range(1, k + 1)) AS i FROM k), range(1, 11) t(d)),
v AS (SELECT source, prompt, k, d, e.v AS v, count(*) AS c, min(i) AS f, arg_min(e.x, i) AS m FROM p GROUP BY ALL),
j AS (SELECT source, prompt, k, d, arg_max(m, (c, -f)) AS maj FROM v GROUP BY ALL),
b AS (SELECT source, prompt, k, d, max(e.x) AS best, min(e.x) AS worst FROM p GROUP BY ALL),
s AS (SELECT source, prompt, k, avg(best) AS best, avg(worst) AS worst, avg(maj) AS maj, stddev_pop(best) AS bs, stddev_pop(worst) AS ws, stddev_pop(maj) AS ms FROM b JOIN j USING (source, prompt, k, d) GROUP BY ALL)
SELECT source, k, count(*) AS prompts, round(avg(best), 5) AS best, round(avg(worst), 5) AS worst, round(avg(maj), 5) AS maj, round(avg(bs), 5) AS best_std, round(avg(ws), 5) AS worst_std, round(avg(ms), 5) AS maj_std FROM s GROUP BY ALL""")
def _(t):
    out = T.validation_at(t.orders.withColumnsRenamed({"o_orderpriority": "source", "o_custkey": "prompt"}), "source", "prompt", "o_totalprice", "o_orderstatus", "o_orderkey", 10)
    return out.select("source", F.col("k").cast("long").alias("k"), "prompts", *[F.round(c, 5).alias(c) for c in ("best", "worst", "maj", "best_std", "worst_std", "maj_std")])


@query("agg_detached_preference", """WITH x AS (SELECT o_orderkey AS id, o_custkey AS g, o_totalprice / 100000 AS q, CAST(o_orderstatus = 'F' AS DOUBLE) AS a FROM orders),
p AS (SELECT x.id, x.q, x.a, avg(y.q) FILTER (CASE WHEN x.a > 0 THEN y.a < x.a ELSE y.a > x.a END) AS other, count(*) AS n, avg(CAST(y.q <= x.q AS INT)) AS share FROM x JOIN x y USING (g) GROUP BY ALL)
SELECT id, round(ln(1 + exp(-0.5 * (q - coalesce(other, 0)) * CASE WHEN a > 0 THEN 1 ELSE -1 END)), 6) AS loss, round(n * share ** (n - 1), 6) AS weight FROM p""")
def _(t):
    made = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("g"), (F.col("o_totalprice") / 100000).alias("q"), (F.col("o_orderstatus") == "F").cast("double").alias("a"))
    return T.detached_preference(made, "g", "q", "a", 0.5, "score").select("id", F.round("loss", 6).alias("loss"), F.round("weight", 6).alias("weight"))


@query("agg_is_mask", f"WITH {MASKED}, e AS (SELECT uid, unnest(x) / 2000 - 0.5 AS a, unnest(m) AS m FROM m) SELECT uid, CASE WHEN bool_or(m > 0 AND exp(a) < 0.62) THEN 0 ELSE sum(CASE WHEN exp(a) BETWEEN 1 / 1.5 AND 1.5 THEN m ELSE 0 END) END AS kept FROM e GROUP BY uid")
def _(t):
    a = F.transform("hist_pid", lambda v: v / F.lit(2000.0) - 0.5)
    kept = T.masked_importance(a, F.transform("hist_pid", lambda v: F.lit(0.0)), F.col("hist_like"), "token", 1.5, veto=0.62)
    return V.interactions(t).where("size(hist_pid) > 0").select("uid", F.aggregate(kept, F.lit(0).cast("long"), lambda s, x: s + x).alias("kept"))


@query("fn_kl_reward", f"WITH {MASKED}, e AS (SELECT uid, unnest(x) AS x, unnest(m) AS m FROM m) SELECT uid, round(sum((m - 0.2 * (x % 10) / 10.0) * m), 5) AS reward FROM e GROUP BY uid")
def _(t):
    kl = F.transform("hist_pid", lambda x: (x % 10) / F.lit(10.0))
    r = F.zip_with("hist_like", kl, lambda s, k: P.kl_reward(s.cast("double"), k, 0.2))
    return V.interactions(t).where("size(hist_pid) > 0").select("uid", F.round(P.masked_sum(r, F.col("hist_like")), 5).alias("reward"))


# FLOPs by family.

DENSE = T.Shape(hidden=64, layers=4, heads=8, kv_heads=2, intermediate=256, vocabulary=1000)
MIXTURE = T.Shape(hidden=64, layers=4, heads=8, kv_heads=2, intermediate=0, vocabulary=1000, experts=16, active=4, expert_size=32)
LATENT = T.Shape(hidden=64, layers=6, heads=4, kv_heads=4, intermediate=256, vocabulary=1000, experts=8, active=2, expert_size=32, shared=1, dense_layers=2, rope=8, nope=16, value_head=16, kv_rank=24, q_rank=32)
SLIDING = T.Shape(hidden=64, layers=12, heads=8, kv_heads=2, intermediate=256, vocabulary=1000, window=512)
# Parameters by hand: layers * (gated unit + attention) + both embeddings.
_DENSE, _MIX, _SLIDE = 4 * (64 * 256 * 3 + 64 * (64 + 16 + 16 + 64)) + 128000, 4 * (64 * 4 * 32 * 3 + 64 * 16 + 64 * (64 + 16 + 16 + 64)) + 128000, 12 * (64 * 256 * 3 + 64 * (64 + 16 + 16 + 64)) + 128000
_MLA = 64 * 32 + 4 * 24 * 32 + 64 * (24 + 8) + 24 * 4 * (24 - 8 + 16) + 4 * 16 * 64
_LATENT = (64 * 8 + 64 * 32 * 3 * 3 + _MLA) * 4 + (64 * 256 * 3 + _MLA) * 2 + 128000


@query("agg_flops", f"""SELECT source, sum(6.0 * {_DENSE} * n_chars + 12.0 * 64 * 4 * n_chars * n_chars) / 1e12 AS dense, sum(6.0 * {_MIX} * n_chars + 12.0 * 64 * 4 * n_chars * n_chars) / 1e12 AS mixture,
sum(6.0 * {_LATENT} * n_chars + 12.0 * 24 * 4 * 6 * n_chars * n_chars) / 1e12 AS latent, sum(6.0 * {_SLIDE} * n_chars + 12.0 * 64 * (2 * n_chars * n_chars + 10 * n_chars * least(n_chars, 512))) / 1e12 AS sliding, 0.0 AS unknown FROM documents GROUP BY source""".replace("sum(", "round(sum(").replace("/ 1e12", "/ 1e12, 4)"))
def _(t):
    n = F.col("n_chars")
    of = {"dense": ("qwen3", DENSE), "mixture": ("qwen3_moe", MIXTURE), "latent": ("deepseek_v3", LATENT), "sliding": ("gemma3_text", SLIDING), "unknown": ("none", DENSE)}
    return t.documents.groupBy("source").agg(*[F.round(F.sum(T.training_flops(n, kind, shape)) / 1e12, 4).alias(name) for name, (kind, shape) in of.items()])


# Dispatch, tasks, samplers.


@query("dispatch_modes", f"WITH {ROWS}, c AS (SELECT count(*) AS n FROM b) SELECT rank, count(*) AS n, count(*) FILTER (row_id >= n) AS padded, min(k) AS first FROM (SELECT row_id, k, n, CAST(row_id // ((n + 6) // 7) AS INT) AS rank FROM (SELECT row_id, k FROM b UNION ALL SELECT row_id + n, k FROM b, c WHERE row_id < (7 - n % 7) % 7), c) GROUP BY rank")
def _(t):
    batch, n = rows(t), t.orders.count()
    return T.DISPATCH.named("data_parallel")(batch, 7, n).groupBy("rank").agg(F.count("*").alias("n"), F.count_if("padded").alias("padded"), F.min("k").alias("first"))


@query("dispatch_collected", f"WITH {ROWS} SELECT row_id, k, 'all' AS mode FROM b UNION ALL SELECT row_id, k, 'same' FROM b")
def _(t):
    batch, n = rows(t), t.orders.count()
    parts = T.collected(T.data_parallel(batch, 7, n), "data_parallel").withColumn("mode", F.lit("all"))
    return parts.unionByName(T.collected(T.one_to_all(batch, 3), "one_to_all").withColumn("mode", F.lit("same")))


T.task("label_share", lambda t, least: t.documents.join(t.labels, "doc_id").where(F.col("n_chars") >= least), lambda df: df.groupBy("lang").agg(F.round(F.avg("quality"), 6).alias("share")), least=100)


@query("task_registry", "SELECT lang, round(avg(quality), 6) AS share FROM documents JOIN labels USING (doc_id) WHERE n_chars >= 500 GROUP BY lang")
def _(t):
    return T.TASKS.named("label_share").run(t, least=500)


@query("st_curriculum", """WITH w AS (SELECT o_orderpriority AS g, greatest(4 * avg(CAST(o_orderstatus = 'F' AS INT)) * (1 - avg(CAST(o_orderstatus = 'F' AS INT))), 0.05) AS w FROM orders GROUP BY 1),
r AS (SELECT o_orderkey, -ln((CAST('0x' || substr(md5('45|' || o_orderkey), 1, 12) AS BIGINT) + 1) / 281474976710657.0) / w AS race FROM orders JOIN w ON g = o_orderpriority) SELECT o_orderkey FROM r ORDER BY race, o_orderkey LIMIT 64""")
def _(t):
    sampler = T.Curriculum("o_orderkey", "o_orderpriority")
    sampler.update(t.orders.withColumn("s", (F.col("o_orderstatus") == "F").cast("int")), "s")
    return sampler.batch(t.orders, 64, 3).select("o_orderkey")


@query("reward_manager_limited", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.0 ELSE 0.0 END AS reward FROM orders")
def _(t):
    def score(solution: str, truth: str):
        if solution.startswith("fail"):
            raise ValueError(solution)
        return {"score": 0.5, "why": "near"} if solution == "near" else float(solution == truth)

    kind = F.element_at(F.array(F.lit("x"), F.lit("near"), F.lit("y"), F.lit("fail")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return T.MANAGERS.named("prime")(t.orders.select("o_orderkey", kind.alias("solution"), F.lit("x").alias("truth")), score).select("o_orderkey", "reward")


# Prompts.

_SLOT = "<|sid_begin|><s_a_1><s_b_2><s_c_3><|sid_end|>"
_PROMPT = f"看过{_SLOT}{_SLOT}长时间看过{_SLOT}广告{_SLOT}，请推荐："


@query("fn_rag_template", f"WITH {V.INTER}, {V.CODES}, i AS (SELECT * FROM inter WHERE len(hist_pid) > 0), {V.found('h', 'hist_pid[greatest(len(hist_pid)-511,1):]', 'i')}, {V.found('g', 'hist_pid[greatest(len(hist_pid)-199,1):]', 'i')}, {V.found('l', 'list_transform(list_filter(list_zip(hist_pid, hist_longview), lambda z: z[2] = 1), lambda z: z[1])', 'i')}, {V.found('y', 'target_pid[len(target_pid):]', 'i')} SELECT uid, '看过' || coalesce(h_s, '') || '长时间看过' || coalesce(l_s, '') || '广告' || coalesce(g_s, '') || '，请推荐：' || coalesce(y_s || chr(10), '') AS prompt FROM i LEFT JOIN h USING (uid) LEFT JOIN g USING (uid) LEFT JOIN l USING (uid) LEFT JOIN y USING (uid)")
def _(t):
    made = V.interactions(t).where("size(hist_pid) > 0")
    last = F.slice("target_pid", F.size("target_pid"), F.lit(1))
    found = L.lookup_arrays(made, "uid", {"h": F.col("hist_pid"), "l": F.col("longview_pid"), "y": last}, V.codes(t), "pid", "code")
    all_ = made.select("uid").join(found.select("uid", "h", "l", "y"), "uid", "left")
    return all_.select("uid", prompts.slots_filled(F.lit(_PROMPT), {"video": F.col("h"), "ad": F.col("h"), "longview": F.col("l")}, F.col("y")).alias("prompt"))


@query("fn_rag_parse", "WITH x AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS u FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, len(u) AS n, array_to_string(u, ',') AS users FROM x")
def _(t):
    listed = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: x["l_partkey"].cast("string"))
    text = F.array_join(F.transform("u", lambda u: F.concat(F.lit("Example\nUser "), u, F.lit(": likes user 7: and Users 8:"))), "\n")
    found = t.lineitem.groupBy("l_orderkey").agg(listed.alias("u")).select("l_orderkey", prompts.example_users(text).alias("u"))
    return found.select("l_orderkey", F.size("u").cast("long").alias("n"), F.array_join("u", ",").alias("users"))


@query("fn_slot_replace", """WITH x AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS u FROM lineitem GROUP BY l_orderkey),
h AS (SELECT *, lambda_ AS z FROM (SELECT *, 1 AS lambda_ FROM x)),
e AS (SELECT l_orderkey, unnest(range(len(u))) AS i FROM h),
c AS (SELECT l_orderkey, i, string_agg('<s_' || substr('abc', CAST(j + 1 AS BIGINT), 1) || '_' || CAST('0x' || substr(md5('9|' || i || '|' || j), 1, 8) AS BIGINT) % 8192 || '>', '' ORDER BY j) AS s FROM e, range(3) t(j) GROUP BY ALL)
SELECT l_orderkey, string_agg('x ' || '<|sid_begin|>' || s || '<|sid_end|>', '' ORDER BY i) || '.' AS g FROM c GROUP BY l_orderkey""")
def _(t):
    listed = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: F.concat(F.lit("x <|sid_begin|><s_a_"), x["l_partkey"].cast("string"), F.lit("><s_b_1><s_c_2><|sid_end|>")))
    text = t.lineitem.groupBy("l_orderkey").agg(F.concat(F.array_join(listed, ""), F.lit(".")).alias("g"))
    return text.select("l_orderkey", prompts.codes_replaced(F.col("g"), 9).alias("g"))


ITEMS = "c AS (SELECT l_suppkey AS sid, l_partkey AS pid, count(*) AS n, CAST(floor(sum(l_quantity) / 20) AS BIGINT) AS after FROM lineitem GROUP BY ALL), i AS (SELECT sid, list({'pid': pid, 'after': after} ORDER BY n DESC, pid) AS x FROM c GROUP BY sid)"


@query("fn_sid_to_pid", f"WITH {ITEMS}, m AS (SELECT sid, x, CAST('0x' || substr(md5(CAST(sid AS VARCHAR)), 1, 8) AS BIGINT) AS d, list_filter(x, lambda e: e.after = list_max(list_transform(x, lambda z: z.after))) AS top FROM i) SELECT sid, x[1].pid AS originally, top[d % len(top) + 1].pid AS after, x[d % len(x) + 1].pid AS random FROM m")
def _(t):
    counted = t.lineitem.groupBy(F.col("l_suppkey").alias("sid"), F.col("l_partkey").alias("pid")).agg(F.count("*").alias("n"), F.floor(F.sum("l_quantity") / 20).alias("after"))
    items = counted.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "pid", F.col("n").alias("count"), "after"))).alias("x"))
    return items.select("sid", *[prompts.item_of_code(F.col("x"), s, F.col("sid")).alias(s) for s in ("originally", "after", "random")])


# Sources and reports.


@query("src_shard_list", "SELECT CAST(doc_id AS VARCHAR) AS key, length(coalesce(text, '')) AS chars, count(*) OVER () AS samples FROM documents WHERE doc_id % 2 = 0")
def _(t):
    """Half of the documents in listed shards, the other half in shards that no list names."""
    path = scratch(t.spark, "shardlist")
    member = lambda c: t.documents.where(c).select(F.col("doc_id").alias("key"), F.lit("txt").alias("ext"), F.col("text").alias("data"))
    tar.write(member("doc_id % 2 = 0"), f"{path}/listed")
    tar.write(member("doc_id % 2 = 1"), f"{path}/other")
    held = t.documents.where("doc_id % 2 = 0").count()
    names = [f.rsplit("/", 1)[-1] for f in io.list_files(t.spark, f"{path}/listed", ".tar")]
    io.write_results(t.spark, f"{path}/list.json", {"shardlist": [{"url": f"listed/{n}", "nsamples": held if i == 0 else 0} for i, n in enumerate(names)]})
    shards, samples = io.read_shard_lists(t.spark, [f"{path}/list.json"])
    return tar.read(t.spark, shards).select("key", F.length(F.col("data").cast("string")).cast("long").alias("chars"), F.lit(samples).cast("long").alias("samples"))


@query("src_hdfs_cache", "SELECT n_nationkey, n_name FROM nation")
def _(t):
    folder = scratch(t.spark, "cache")
    for _ in range(2):
        held = cache.cached(t.spark, f"{t.sf_dir}/nation.parquet", folder)
    return t.spark.read.parquet(held).select("n_nationkey", "n_name")


@query("sink_excel_report", "SELECT n_name AS name, n_nationkey AS key, n_nationkey / 8.0 AS part, CASE WHEN n_regionkey > 0 THEN n_regionkey END AS region FROM nation")
def _(t):
    path = scratch(t.spark, "report") + "/report.xlsx"
    made = t.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"), (F.col("n_nationkey") / 8.0).alias("part"), F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("region"))
    workbook.write_workbook(made, path)
    return workbook.read_workbook(t.spark, path, "name string, key int, part double, region int")


@query("sink_markdown", "SELECT '| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |' AS line FROM nation UNION ALL SELECT '| n_nationkey | n_name | n_regionkey |' UNION ALL SELECT '| --- | --- | --- |'")
def _(t):
    path = scratch(t.spark, "markdown")
    io.markdown_lines(t.nation.select("n_nationkey", "n_name", "n_regionkey")).orderBy("place").select("line").write.text(path)
    return t.spark.read.text(path).select(F.col("value").alias("line"))


@query("src_generated", "SELECT i AS id, 'How many ''a'' are in ' || w || '?' AS question, CAST(length(w) - length(replace(w, 'a', '')) AS INT) AS answer FROM (SELECT i, lower(to_hex(CAST((i * 2654435761) % 4294967296 AS BIGINT))) AS w FROM (SELECT row_number() OVER () - 1 AS i FROM orders))")
def _(t):
    """As many samples as there are orders."""
    return generated.read_generated(t.spark, "brindle.sources.generated:Counting", t.orders.count())


@query("sink_tracking", "SELECT CAST(o_orderkey % 5 AS BIGINT) AS step, unnest(['price', 'rows']) AS name, round(unnest([avg(o_totalprice), count(*)]), 4) AS value FROM orders GROUP BY 1")
def _(t):
    folder = scratch(t.spark, "tracked")
    run = tracking.Tracking(t.spark, folder, "file")
    # One row a step.
    for r in t.orders.groupBy((F.col("o_orderkey") % 5).alias("step")).agg(F.avg("o_totalprice").alias("price"), F.count("*").cast("double").alias("rows")).collect():
        run.log({"price": r["price"], "rows": r["rows"]}, r["step"])
    return tracking.read_tracked(t.spark, folder).select("step", "name", F.round("value", 4).alias("value"))


@query("st_partial", "SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END, o_orderkey) - 1 AS place FROM orders")
def _(t):
    return requeued(t.orders.select("o_orderkey", "o_orderstatus"), F.col("o_orderstatus") == "P", "o_orderkey").select("o_orderkey", "place")
