"""Evaluation and group statistics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import arrays as A
from brindle.functions import policy as P
from brindle.operators import batch as B
from brindle.operators import groupwise as G
from brindle.operators import metrics as M
from brindle.plans import views as V
from brindle.plans.registry import query
from brindle.streaming import stateful as S

RANK = f"{V.INTER}, {V.BASKETS}, d AS (SELECT uid, pred, truth, list_distinct(list_filter(truth, lambda x: x <> 0)) AS gt, list_filter(pred[1:10], lambda x: x <> 0) AS p FROM baskets)"


@query("agg_pass_at_k", f"WITH {RANK} SELECT round(avg(CASE WHEN len(list_intersect(p, truth)) > 0 THEN 1.0 ELSE 0.0 END), 6) AS p10, round(avg(CASE WHEN len(list_intersect(list_filter(pred[1:1], lambda x: x <> 0), truth)) > 0 THEN 1.0 ELSE 0.0 END), 6) AS p1 FROM d")
def _(t):
    p, g = F.col("pred"), F.col("truth")
    return M.overall(V.baskets(t), {"p10": M.pass_at(p, g, 10), "p1": M.pass_at(p, g, 1)}).select(F.round("p10", 6).alias("p10"), F.round("p1", 6).alias("p1"))


@query("agg_pos1_pass", f"WITH {RANK} SELECT round(avg(CASE WHEN list_contains(pred[1:10], truth[1]) THEN 1.0 ELSE 0.0 END), 6) AS p10 FROM d")
def _(t):
    return M.overall(V.baskets(t), {"p10": M.first_truth_at(F.col("pred"), F.col("truth"), 10)}).select(F.round("p10", 6).alias("p10"))


@query("agg_recall", f"WITH {RANK} SELECT uid, round(len(list_intersect(p, gt)) / len(gt), 6) AS recall FROM d")
def _(t):
    return V.baskets(t).select("uid", F.round(M.recall_at(F.col("pred"), F.col("truth"), 10), 6).alias("recall"))


@query("agg_pid_metrics", f"WITH {RANK}, z AS (SELECT uid, list_filter(list_transform(p, lambda x: CASE WHEN x % 2 = 0 THEN 0 ELSE x END), lambda x: x <> 0) AS p, gt FROM d) SELECT uid, round(len(list_intersect(p, gt)) / len(gt), 6) AS recall, len(list_intersect(p, gt)) > 0 AS pass FROM z")
def _(t):
    odd = F.transform("pred", lambda x: F.when(x % 2 == 0, 0).otherwise(x))
    rows = V.baskets(t).withColumn("pred", odd)
    return rows.select("uid", F.round(M.recall_at(F.col("pred"), F.col("truth"), 10), 6).alias("recall"), M.pass_at(F.col("pred"), F.col("truth"), 10).alias("pass"))


@query("agg_ndcg", f"WITH {RANK}, g AS (SELECT uid, unnest(pred[1:10]) AS x, generate_subscripts(pred[1:10], 1) AS i FROM d), f AS (SELECT uid, x, min(i) AS i FROM g GROUP BY uid, x), h AS (SELECT f.uid, sum(1 / log2(i + 1)) AS dcg FROM f JOIN d USING (uid) WHERE list_contains(gt, x) AND x <> 0 GROUP BY f.uid) SELECT uid, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(len(gt), 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM d LEFT JOIN h USING (uid)")
def _(t):
    return V.baskets(t).select("uid", F.round(M.ndcg_at(F.col("pred"), F.col("truth"), 10), 6).alias("ndcg"))


@query("agg_overall", f"WITH {RANK} SELECT round(sum(CASE WHEN uid % 4 = 0 THEN 0 ELSE len(list_intersect(p, gt)) / len(gt) END) / count(*), 6) AS recall FROM d")
def _(t):
    return M.overall(V.baskets(t), {"recall": F.when(F.col("uid") % 4 != 0, M.recall_at(F.col("pred"), F.col("truth"), 10))}).select(F.round("recall", 6).alias("recall"))


@query("agg_auc", "WITH x AS (SELECT quality AS y, n_chars AS s FROM documents JOIN labels USING (doc_id)), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM x) SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM r")
def _(t):
    return M.auc(t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id"), "quality", "n_chars").select(F.round("auc", 6).alias("auc"))


@query("agg_prob_norm", "SELECT l_orderkey, round(avg(l_discount / (l_discount + l_tax + 0.01)), 6) AS p FROM lineitem GROUP BY l_orderkey")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.avg(M.normalised_probability(F.col("l_discount"), F.col("l_tax") + 0.01)), 6).alias("p"))


F1_SQL = "WITH m AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS tp, count(*) FILTER (l_returnflag = 'A') AS fp, count(*) FILTER (l_returnflag = 'N') AS fn, sum({w}) FILTER (l_returnflag = 'R') AS wtp, sum({w}) FILTER (l_returnflag = 'A') AS wfp, sum({w}) FILTER (l_returnflag = 'N') AS wfn, sum({w} * {q}) FILTER (l_returnflag = 'R') AS g, sum((8 - {w}) * (1 - {q})) FILTER (l_returnflag = 'R') AS mm, sum({w} * (1 - {q})) FILTER (l_returnflag = 'R') AS mg, count(*) FILTER (l_returnflag = 'R' AND {w} >= 5) AS ctp, count(*) FILTER (l_returnflag = 'A' AND {w} >= 5) AS cfp, count(*) FILTER (l_returnflag = 'N' AND {w} >= 5) AS cfn FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, round(2 * coalesce(tp, 0) / (2 * coalesce(tp, 0) + coalesce(fp, 0) + coalesce(fn, 0)), 6) AS f1, round(CASE WHEN ctp + cfp + cfn > 0 THEN 2 * ctp / (2 * ctp + cfp + cfn) ELSE 0 END, 6) AS f1_core, round(2 * coalesce(wtp, 0) / (2 * coalesce(wtp, 0) + coalesce(wfp, 0) + coalesce(wfn, 0)), 6) AS f1_weighted, round(1e-7 + 2 * coalesce(g, 0) / (2 * coalesce(g, 0) + coalesce(wfp, 0) + coalesce(mm, 0) + coalesce(wfn, 0) + coalesce(mg, 0)), 3) AS f1_double FROM m".format(w="l_linenumber", q="l_discount * 10")


@query("agg_f1_family", F1_SQL)
def _(t):
    of = lambda flag, x: F.collect_list(F.when(F.col("l_returnflag") == flag, x))
    w = F.col("l_linenumber")
    rows = t.lineitem.groupBy("l_orderkey").agg(
        of("R", F.struct(w.alias("gt"), (8 - w).alias("model"), (F.col("l_discount") * 10).alias("quality"))).alias("m"), of("A", w).alias("e"), of("N", w).alias("n")
    )
    return rows.select("l_orderkey", *[F.round(c + 1e-7 if n == "f1_double" else c, 3 if n == "f1_double" else 6).alias(n) for n, c in M.f1_family(F.col("m"), F.col("e"), F.col("n")).items()])


def _f1_query(name: str, *columns: str) -> None:
    @query(name, f"SELECT l_orderkey, {', '.join(columns)} FROM ({F1_SQL})")
    def _(t):
        from brindle.plans.registry import QUERIES

        return QUERIES["agg_f1_family"](t.spark, t.sf_dir).select("l_orderkey", *columns)


_f1_query("agg_f1_unweighted", "f1", "f1_core")
_f1_query("agg_f1_weighted", "f1_weighted")
_f1_query("agg_f1_double", "f1_double")


@query("agg_judge_mean", "SELECT l_returnflag, round(avg(CASE WHEN l_linenumber <= 5 THEN l_linenumber ELSE 3 END), 6) AS score FROM lineitem GROUP BY l_returnflag")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.avg(M.judge_score(F.col("l_linenumber").cast("string"))), 6).alias("score"))


@query("agg_mfu", "SELECT o_orderpriority, round(2 * 1.7e9 * sum(o_custkey) / (312e12 * 8 * 3600), 9) AS mfu FROM orders GROUP BY o_orderpriority")
def _(t):
    return t.orders.groupBy("o_orderpriority").agg(F.round(M.mfu(F.sum("o_custkey"), F.lit(3600.0), 1.7e9, 312, 8), 9).alias("mfu"))


@query("agg_mfu_train", "SELECT lang, round(sum(6.0 * (2*(64*128*3 + 64*(4*16*2 + 2*16*2)) + 2*1000*64) * n_chars + 12.0 * n_chars * n_chars * 16 * 4 * 2) / 1e12, 6) AS tflops FROM documents GROUP BY lang")
def _(t):
    return t.documents.groupBy("lang").agg(F.round(F.sum(M.decoder_flops(F.col("n_chars").cast("double"), 2, 64, 128, 4, 2, 1000)) / 1e12, 6).alias("tflops"))


@query("agg_stage_totals", f"WITH {V.CLICKS}, r AS (SELECT uid, qty, price, row_number() OVER (PARTITION BY uid ORDER BY ts, ok, ln, pid, qty, price) - 1 AS stage FROM clicks) SELECT CAST(stage AS INT) AS stage, sum(qty) AS tokens, max(price) AS seconds FROM r GROUP BY stage")
def _(t):
    rows = V.clicks(t).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("ts", "ok", "ln", "pid", "qty", "price"))).alias("x"))
    return M.stage_totals(rows.select(F.transform("x", lambda e: e["qty"]).alias("q"), F.transform("x", lambda e: e["price"]).alias("p")), "q", "p")


@query("win_unique_first_n", "WITH b AS (SELECT o_custkey AS uid, l_partkey AS pid, max(l_extendedprice) AS price FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY price DESC, pid) AS place FROM b) SELECT uid, pid, price, CAST(place AS INT) AS place FROM r WHERE place <= 5")
def _(t):
    return M.top_unique(V.clicks(t), "uid", "pid", "price", 5)


@query("win_topk_logprob", f"WITH {V.CLICKS} SELECT uid, array_to_string(list(pid ORDER BY price DESC, pid)[1:5], ',') AS top FROM clicks GROUP BY uid")
def _(t):
    rows = V.clicks(t).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct((-F.col("price")).alias("o"), "pid"))).alias("x"))
    return rows.select("uid", F.array_join(F.transform(F.slice("x", 1, 5), lambda e: e["pid"].cast("string")), ",").alias("top"))


@query("win_latest_per_key", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"))


@query("win_consecutive_dedup", "WITH x AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS path FROM x WHERE before IS NULL OR before <> event_type GROUP BY user_id")
def _(t):
    rows = t.events.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda e: e["event_type"]).alias("x"))
    return rows.select("user_id", F.array_join(A.without_repeats(F.col("x")), ",").alias("path"))


@query("agg_distinct", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def _(t):
    return t.lineitem.agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("agg_dedup", "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def _(t):
    return t.documents.groupBy("text").agg(F.min("doc_id").alias("doc_id"))


@query("agg_count_source", "SELECT source, count(*) AS n, round(count(*) FILTER (n_chars > 3000) / count(*), 6) AS share FROM documents GROUP BY source")
def _(t):
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("n_chars") > 3000) / F.count("*"), 6).alias("share"))


@query("agg_token_loss_by_source", "SELECT l_returnflag, round(sum(l_tax), 4) AS loss, count(*) AS tokens, count(*) FILTER (l_discount > 0) AS valid FROM lineitem GROUP BY l_returnflag")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.sum("l_tax"), 4).alias("loss"), F.count("*").alias("tokens"), F.count_if(F.col("l_discount") > 0).alias("valid"))


@query("agg_cond_mean", "SELECT round(sum(l_tax) FILTER (l_discount > 0.05) / (count(*) FILTER (l_discount > 0.05) + 1e-6), 6) AS marked, round(sum(l_tax) FILTER (l_discount <= 0.05) / (count(*) FILTER (l_discount <= 0.05) + 1e-6), 6) AS unmarked FROM lineitem")
def _(t):
    out = G.conditional_means(t.lineitem.withColumn("m", (F.col("l_discount") > 0.05).cast("int")), "l_tax", "m")
    return out.select(F.round("marked", 6).alias("marked"), F.round("unmarked", 6).alias("unmarked"))


# Group estimators: a group is a customer, a response an order.


def responses(t):
    return t.orders.select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("id"), F.round("o_totalprice").alias("r"), (F.col("o_orderkey") % 7 + 1).alias("n"))


RESP = "x AS (SELECT o_custkey AS g, o_orderkey AS id, round(o_totalprice) AS r, o_orderkey % 7 + 1 AS n FROM orders)"


def _adv(df):
    return df.select("id", (F.round("advantage", 3) + 0.0).alias("advantage"))


@query("agg_group_mean_std", f"WITH {RESP} SELECT id, round(CASE WHEN count(*) OVER w = 1 THEN r / (1 + 1e-6) ELSE (r - avg(r) OVER w) / (stddev_samp(r) OVER w + 1e-6) END, 3) + 0.0 AS advantage FROM x WINDOW w AS (PARTITION BY g)")
def _(t):
    return _adv(G.get_estimator("grpo")(responses(t), "g", "r"))


@query("agg_group_floored", f"WITH {RESP} SELECT id, round(CASE WHEN count(*) OVER w = 1 THEN r ELSE (r - avg(r) OVER w) / sqrt(greatest(var_samp(r) OVER w, 1e-6)) END, 3) + 0.0 AS advantage FROM x WINDOW w AS (PARTITION BY g)")
def _(t):
    return _adv(G.get_estimator("grpo_vectorised")(responses(t), "g", "r"))


@query("agg_top2_gap", f"WITH {RESP}, p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY r DESC, id) AS p, stddev_samp(r) OVER (PARTITION BY g) AS s, count(*) OVER (PARTITION BY g) AS c FROM x) SELECT id, round((CASE WHEN p = 1 THEN r - max(CASE WHEN p = 2 THEN r END) OVER (PARTITION BY g) ELSE 0 END) / (s + 1e-6), 3) + 0.0 AS advantage FROM p WHERE c > 1")
def _(t):
    out = G.get_estimator("grpo_passk")(responses(t), "g", "r", "id")
    return _adv(out.where("advantage IS NOT NULL"))


@query("agg_loo", f"WITH {RESP} SELECT id, round(CASE WHEN count(*) OVER w > 1 THEN (r - avg(r) OVER w) * count(*) OVER w / (count(*) OVER w - 1) ELSE r END, 3) + 0.0 AS advantage FROM x WINDOW w AS (PARTITION BY g)")
def _(t):
    return _adv(G.get_estimator("rloo")(responses(t), "g", "r"))


@query("agg_len_weighted", f"WITH {RESP} SELECT id, round(r - CASE WHEN count(*) OVER w > 1 THEN sum(r * n) OVER w / sum(n) OVER w ELSE 0 END, 3) + 0.0 AS advantage FROM x WINDOW w AS (PARTITION BY g)")
def _(t):
    return _adv(G.get_estimator("opo")(responses(t), "g", "r", "n"))


@query("agg_gpg_scale", f"WITH {RESP}, z AS (SELECT id, g, CASE WHEN n > 3 THEN r ELSE 0 END AS r FROM x), a AS (SELECT count(*) / count(*) FILTER (r <> 0) AS alpha FROM z) SELECT id, round(alpha * (r - CASE WHEN count(*) OVER w > 1 THEN avg(r) OVER w ELSE 0 END), 3) + 0.0 AS advantage FROM z, a WINDOW w AS (PARTITION BY g)")
def _(t):
    return _adv(G.get_estimator("gpg")(responses(t).withColumn("r", F.when(F.col("n") > 3, F.col("r")).otherwise(F.lit(0.0))), "g", "r"))


@query("agg_rfpp_baseline", f"WITH {RESP}, c AS (SELECT id, r - CASE WHEN count(*) OVER w > 1 THEN avg(r) OVER w ELSE 0 END AS c FROM x WINDOW w AS (PARTITION BY g)) SELECT id, round((c - avg(c) OVER ()) / sqrt(var_samp(c) OVER () + 1e-8), 3) + 0.0 AS advantage FROM c")
def _(t):
    return _adv(G.get_estimator("reinforce_plus_plus_baseline")(responses(t), "g", "r"))


@query("agg_masked_whiten", "SELECT o_orderkey AS id, round((o_totalprice - avg(o_totalprice) OVER ()) / sqrt(var_samp(o_totalprice) OVER () + 1e-8), 3) + 0.0 AS advantage FROM orders")
def _(t):
    return _adv(G.whitened(t.orders.withColumn("id", F.col("o_orderkey")), "o_totalprice", "advantage"))


MASKED = f"{V.INTER}, m AS (SELECT uid, hist_pid AS x, hist_like AS m FROM inter WHERE len(hist_pid) > 0)"


@query("agg_masked", f"WITH {MASKED}, e AS (SELECT uid, unnest(x) AS x, unnest(m) AS m FROM m) SELECT uid, CAST(sum(x * m) AS DOUBLE) AS total, round(sum(x * m) / (sum(m) + 1e-8), 5) AS mean FROM e GROUP BY uid")
def _(t):
    x, m = F.transform("hist_pid", lambda v: v.cast("double")), F.col("hist_like")
    return V.interactions(t).where("size(hist_pid) > 0").select("uid", P.masked_sum(x, m).alias("total"), F.round(P.masked_mean(x, m), 5).alias("mean"))


def _loss_query(mode: str, sql: str) -> None:
    @query(f"agg_loss_{mode.replace('-', '_')}", sql)
    def _(t):
        return G.loss(t.lineitem, mode, "l_tax", "l_orderkey", 100.0).select(F.round("loss", 6).alias("loss"))


_loss_query("token-mean", "SELECT round(avg(l_tax), 6) AS loss FROM lineitem")
_loss_query("seq-mean-token-sum", "SELECT round(avg(s), 6) AS loss FROM (SELECT sum(l_tax) AS s FROM lineitem GROUP BY l_orderkey)")
_loss_query("seq-mean-token-mean", "SELECT round(avg(s), 6) AS loss FROM (SELECT avg(l_tax) AS s FROM lineitem GROUP BY l_orderkey)")
_loss_query("seq-mean-token-sum-norm", "SELECT round(sum(l_tax) / 100, 6) AS loss FROM lineitem")


@query("win_reverse_cumsum", f"WITH {MASKED}, e AS (SELECT uid, unnest(x) * unnest(m) AS x, generate_subscripts(x, 1) AS i FROM m), s AS (SELECT uid, i, sum(x) OVER (PARTITION BY uid ORDER BY i DESC) AS s FROM e) SELECT uid, string_agg(CAST(CAST(s AS BIGINT) AS VARCHAR), ',' ORDER BY i) AS returns FROM s GROUP BY uid")
def _(t):
    out = P.suffix_sums(F.col("hist_pid"), F.col("hist_like"))
    return V.interactions(t).where("size(hist_pid) > 0").select("uid", F.array_join(F.transform(out, lambda x: x.cast("long").cast("string")), ",").alias("returns"))


RECURSE = f"{MASKED}, e AS (SELECT uid, unnest(x) / 1000 AS r, unnest(m) AS m, generate_subscripts(x, 1) AS i, len(x) AS n FROM m)"


@query("win_discounted_return", f"WITH RECURSIVE {RECURSE}, k AS (SELECT uid, i, r AS ret, r * m AS run FROM e WHERE i = n UNION ALL SELECT e.uid, e.i, e.r + 0.9 * k.run, (e.r + 0.9 * k.run) * e.m FROM k JOIN e ON e.uid = k.uid AND e.i = k.i - 1) SELECT uid, round(sum(ret), 2) AS total, round(max(CASE WHEN i = 1 THEN ret END), 5) AS first FROM k GROUP BY uid")
def _(t):
    r = F.transform("hist_pid", lambda v: v / F.lit(1000.0))
    out = V.interactions(t).where("size(hist_pid) > 0").select("uid", P.discounted_returns(r, F.col("hist_like"), 0.9).alias("x"))
    return out.select("uid", F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 2).alias("total"), F.round(F.get("x", F.lit(0)), 5).alias("first"))


@query("win_gae", f"WITH RECURSIVE {RECURSE}, k AS (SELECT uid, i, m * 0.5 * r AS adv, m * 0.5 * r AS run, m * 0.5 * r AS nv FROM e WHERE i = n UNION ALL SELECT e.uid, e.i, CASE WHEN e.m > 0 THEN e.r + 0.9 * k.nv - 0.5 * e.r + 0.72 * k.run ELSE k.run END, CASE WHEN e.m > 0 THEN e.r + 0.9 * k.nv - 0.5 * e.r + 0.72 * k.run ELSE k.run END, CASE WHEN e.m > 0 THEN 0.5 * e.r ELSE k.nv END FROM k JOIN e ON e.uid = k.uid AND e.i = k.i - 1) SELECT uid, round(max(CASE WHEN i = 1 THEN adv END), 5) AS first FROM k GROUP BY uid")
def _(t):
    r = F.transform("hist_pid", lambda v: v / F.lit(1000.0))
    out = V.interactions(t).where("size(hist_pid) > 0").select("uid", P.gae(r, F.transform(r, lambda x: x * 0.5), F.col("hist_like"), 0.9, 0.8).alias("x"))
    return out.select("uid", F.round(F.get("x", F.lit(0)), 5).alias("first"))


@query("win_cumpos", f"WITH {MASKED}, e AS (SELECT uid, unnest(m) AS m, generate_subscripts(m, 1) AS i FROM m), s AS (SELECT uid, i, sum(m) OVER (PARTITION BY uid ORDER BY i) - 1 AS p FROM e) SELECT uid, string_agg(CAST(p AS VARCHAR), ',' ORDER BY i) AS positions FROM s GROUP BY uid")
def _(t):
    return V.interactions(t).where("size(hist_like) > 0").select("uid", F.array_join(F.transform(A.mask_positions(F.col("hist_like")), lambda x: x.cast("string")), ",").alias("positions"))


@query("agg_min_max_mean", "SELECT round(avg(l_tax), 6) AS mean, max(l_tax) AS max, min(l_tax) AS min, round(avg(CAST(l_quantity >= 50 AS INT)), 6) AS clip_ratio, round(1 - var_samp(l_extendedprice - l_quantity * 1000) / var_samp(l_extendedprice), 6) AS explained FROM lineitem")
def _(t):
    gap = F.col("l_extendedprice") - F.col("l_quantity") * 1000
    return t.lineitem.agg(F.round(F.avg("l_tax"), 6).alias("mean"), F.max("l_tax").alias("max"), F.min("l_tax").alias("min"), F.round(F.avg((F.col("l_quantity") >= 50).cast("int")), 6).alias("clip_ratio"), F.round(1 - F.var_samp(gap) / F.var_samp("l_extendedprice"), 6).alias("explained"))


NAMES = "n AS (SELECT CASE l_returnflag WHEN 'A' THEN 'max_reward' WHEN 'N' THEN 'min_error' ELSE 'loss' END AS name, l_orderkey % 50 AS step, l_tax AS value, l_quantity AS weight, l_orderkey, l_linenumber, l_partkey FROM lineitem)"


def named(t):
    name = F.when(F.col("l_returnflag") == "A", "max_reward").when(F.col("l_returnflag") == "N", "min_error").otherwise("loss")
    return t.lineitem.select(name.alias("name"), (F.col("l_orderkey") % 50).alias("step"), F.col("l_tax").alias("value"), F.col("l_quantity").alias("weight"))


@query("agg_name_rule", f"WITH {NAMES} SELECT name, round(CASE WHEN name LIKE '%max%' THEN max(value) WHEN name LIKE '%min%' THEN min(value) ELSE avg(value) END, 6) AS value FROM n GROUP BY name")
def _(t):
    return G.reduce_by_name(named(t), "name", "value").select("name", F.round("value", 6).alias("value"))


@query("agg_step_rollup", f"WITH {NAMES} SELECT name, round(CASE name WHEN 'loss' THEN sum(value * weight) / sum(weight) WHEN 'max_reward' THEN max(value) ELSE sum(value) END, 4) AS value FROM n GROUP BY name")
def _(t):
    rule = F.when(F.col("name") == "loss", "weighted_avg").when(F.col("name") == "max_reward", "max").otherwise("sum")
    return G.rollup(named(t), "name", "step", "value", "weight", rule).select("name", F.round("value", 4).alias("value"))


@query("st_metric_rollup", f"WITH {NAMES} SELECT CAST(step // 10 AS BIGINT) AS block, name, round(sum(value), 4) AS sum, round(avg(value), 6) AS avg, max(value) AS max, min(value) AS min, count(*) AS n FROM n GROUP BY ALL")
def _(t):
    return S.step_rollup(named(t), "step", 10, "name", "value").select("block", "name", F.round("sum", 4).alias("sum"), F.round("avg", 6).alias("avg"), "max", "min", "n")


@query("agg_bootstrap")
def _(t):
    rows = t.orders.select(F.col("o_custkey").alias("g"), "o_orderkey", "o_totalprice")
    return G.bootstrap(rows, ["g"], "o_totalprice", "o_orderkey", 4, 100)


BOOT = """WITH v AS (SELECT o_custkey AS g, list(CAST(o_totalprice AS DOUBLE) ORDER BY o_orderkey) AS v FROM orders GROUP BY o_custkey),
p AS (SELECT g, d, v[CAST('0x' || substr(md5('42|' || g || '|' || d || '|' || i), 1, 8) AS BIGINT) % len(v) + 1] AS x FROM v, range(1, 21) a(d), range(1, 5) b(i)),
r AS (SELECT g, d, avg(x) AS mean, max(x) AS max, (max(x) + min(x)) / 2 AS midrange FROM p GROUP BY ALL)
SELECT g, round(avg(mean), 6) AS mean_mean, round(stddev_pop(mean), 6) AS mean_std, round(avg(max), 6) AS max_mean, round(stddev_pop(max), 6) AS max_std, round(avg(midrange), 6) AS midrange_mean, round(stddev_pop(midrange), 6) AS midrange_std FROM r GROUP BY g"""


@G.reducer("midrange")
def midrange(x):
    return float(x.max() + x.min()) / 2


@query("agg_bootstrap_reducers", BOOT)
def _(t):
    out = G.bootstrap_by(t.orders.select(F.col("o_custkey").alias("g"), "o_orderkey", "o_totalprice"), "g", "o_totalprice", "o_orderkey", 4, ["mean", "max", "midrange"], 20)
    return out.select("g", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("agg_majority", "WITH v AS (SELECT o_custkey AS g, o_orderstatus AS vote, count(*) AS n, min(o_orderkey) AS f, arg_min(o_totalprice, o_orderkey) AS maj FROM orders GROUP BY ALL) SELECT g, arg_max(maj, (n, -f)) AS maj FROM v GROUP BY g")
def _(t):
    return G.majority(t.orders.withColumn("g", F.col("o_custkey")), ["g"], "o_orderstatus", "o_totalprice", "o_orderkey")


@query("agg_validation", "WITH p AS (SELECT o_orderpriority AS source, o_custkey AS prompt, count(*) AS n, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders GROUP BY ALL) SELECT source, n, round(avg(m), 4) AS mean, round(avg(s), 4) AS std, count(*) AS prompts FROM p GROUP BY source, n")
def _(t):
    out = G.validation(t.orders.withColumnsRenamed({"o_orderpriority": "source", "o_custkey": "prompt"}), "source", "prompt", "o_totalprice")
    return out.select("source", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "prompts")


@query("agg_zero_group", "WITH g AS (SELECT l_orderkey, avg(CAST(l_discount = 0 AS INT)) AS z FROM lineitem GROUP BY l_orderkey) SELECT round(avg(CAST(z = 1 AS INT)), 6) AS all_zero, round(avg(z), 6) AS ratio FROM g")
def _(t):
    g = t.lineitem.groupBy("l_orderkey").agg(F.avg((F.col("l_discount") == 0).cast("int")).alias("z"))
    return g.agg(F.round(F.avg((F.col("z") == 1).cast("int")), 6).alias("all_zero"), F.round(F.avg("z"), 6).alias("ratio"))


@query("agg_score_by_source", "SELECT source, round(avg(m), 4) AS score FROM (SELECT o_orderpriority AS source, o_custkey, avg(o_totalprice) AS m FROM orders GROUP BY ALL) GROUP BY source")
def _(t):
    per = t.orders.groupBy(F.col("o_orderpriority").alias("source"), "o_custkey").agg(F.avg("o_totalprice").alias("m"))
    return per.groupBy("source").agg(F.round(F.avg("m"), 4).alias("score"))


@query("agg_timing", "SELECT event_type, round(sum(value), 4) AS seconds, round(sum(value) * 1000 / count(*), 6) AS ms_per_token, round(count(*) / (sum(value) * 2), 6) AS throughput FROM events GROUP BY event_type")
def _(t):
    s = F.sum("value")
    return t.events.groupBy("event_type").agg(F.round(s, 4).alias("seconds"), F.round(s * 1000 / F.count("*"), 6).alias("ms_per_token"), F.round(F.count("*") / (s * 2), 6).alias("throughput"))


@query("flt_group_variance", "SELECT o_orderkey FROM (SELECT *, stddev_pop(o_totalprice) OVER (PARTITION BY o_custkey) AS s, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE s > 0 OR n = 1")
def _(t):
    return G.with_variance(t.orders, "o_custkey", "o_totalprice").select("o_orderkey")


@query("agg_is_weights", f"WITH {MASKED}, e AS (SELECT uid, unnest(x) / 5000 AS a, unnest(m) AS m FROM m), s AS (SELECT uid, sum(a * m) AS s, sum(a * m) / (sum(m) + 1e-8) AS gm, sum(least(exp(a), 1.2) * m) AS tok, sum(m) AS n FROM e GROUP BY uid) SELECT uid, round(tok, 4) AS token, round(least(exp(s), 1.5) * n, 4) AS sequence, round(least(exp(gm), 1.5) * n, 4) AS geometric FROM s")
def _(t):
    a, m = F.transform("hist_pid", lambda v: v / F.lit(5000.0)), F.col("hist_like")
    zero = F.transform("hist_pid", lambda v: F.lit(0.0))
    add = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 4)
    w = lambda level, high: add(P.importance_weight(a, zero, m, level, high))
    return V.interactions(t).where("size(hist_pid) > 0").select("uid", w("token", 1.2).alias("token"), w("sequence", 1.5).alias("sequence"), w("geometric", 1.5).alias("geometric"))


@query("agg_is_metrics", "WITH p AS (SELECT l_orderkey, sum(l_quantity) AS s, sum(l_quantity * l_quantity) AS q, count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) FILTER (l_quantity > 40) AS o, count(*) FILTER (l_quantity < 3) AS u FROM lineitem GROUP BY l_orderkey) SELECT round(sum(s) / sum(n), 6) AS mean, round(sqrt(sum(q) / sum(n) - (sum(s) / sum(n)) ** 2), 5) AS std, min(lo) AS min, max(hi) AS max, round(sum(o) / sum(n), 6) AS share_high, round(sum(u) / sum(n), 6) AS share_low, round(sum(s) * sum(s) / (sum(n) * sum(q)), 6) AS ess, round(avg(CAST(lo < 3 AS INT)), 6) AS veto FROM p")
def _(t):
    out = G.importance_stats(t.lineitem, "l_quantity", "l_orderkey", 40, 3)
    return out.select(*[F.round(c, 5 if c == "std" else 6).alias(c) if c not in ("min", "max") else F.col(c) for c in out.columns])


@query("agg_ppl", "WITH p AS (SELECT l_orderkey, avg(-l_tax) AS a, avg(-l_discount) AS b, sum(l_discount - l_tax) AS k1, sum(exp(l_tax - l_discount) - (l_tax - l_discount) - 1) AS k3, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT round(avg(exp(-a)), 6) AS ppl, round(avg(exp(-b)), 6) AS ppl_other, round(avg(exp(a - b)), 6) AS ratio, round(sum(k1) / sum(n), 6) AS kl, round(sum(k3) / sum(n), 6) AS k3 FROM p")
def _(t):
    out = G.perplexity(t.lineitem.select("l_orderkey", (-F.col("l_tax")).alias("a"), (-F.col("l_discount")).alias("b")), "l_orderkey", "a", "b")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


RHO = "WITH r AS (SELECT n_regionkey AS g, rank() OVER (PARTITION BY n_regionkey ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY n_regionkey, c_acctbal) - 1) / 2 AS a, rank() OVER (PARTITION BY n_regionkey ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY n_regionkey, c_nationkey) - 1) / 2 AS b FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT g, round(corr(a, b), 6) AS rho FROM r GROUP BY g"


@query("agg_spearman", RHO)
def _(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("g", F.col("n_regionkey"))
    return M.spearman(rows, "c_acctbal", "c_nationkey", "g").select("g", F.round("rho", 6).alias("rho"))


@query("agg_pearson", "SELECT l_returnflag, round(corr(exp(l_tax), exp(l_discount)), 6) AS r, round(max(abs(l_tax - l_discount)), 6) AS max, round(avg(abs(l_tax - l_discount)), 6) AS mean, round(stddev_samp(abs(l_tax - l_discount)), 6) AS std FROM lineitem GROUP BY l_returnflag")
def _(t):
    d = F.abs(F.col("l_tax") - F.col("l_discount"))
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.corr(F.exp("l_tax"), F.exp("l_discount")), 6).alias("r"), F.round(F.max(d), 6).alias("max"), F.round(F.avg(d), 6).alias("mean"), F.round(F.stddev_samp(d), 6).alias("std"))


@query("agg_token_diff", f"WITH {MASKED}, e AS (SELECT uid, unnest(x) AS x, unnest(m) AS m FROM m) SELECT uid, sum(CAST(x % 3 <> 0 AS INT) * m) AS differing FROM e GROUP BY uid")
def _(t):
    pairs = F.arrays_zip(F.col("hist_pid").alias("x"), F.col("hist_like").alias("m"))
    return V.interactions(t).where("size(hist_pid) > 0").select("uid", F.aggregate(pairs, F.lit(0).cast("long"), lambda a, p: a + ((p["x"] % 3 != 0).cast("long") * p["m"])).alias("differing"))


@query("agg_pairwise_acc", "WITH p AS (SELECT a.l_orderkey AS g, sign(b.l_extendedprice - a.l_extendedprice) * sign(b.l_quantity - a.l_quantity) AS s, abs(b.l_quantity - a.l_quantity) AS w FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND (a.l_extendedprice, a.l_quantity, a.rowid_) < (b.l_extendedprice, b.l_quantity, b.rowid_)) SELECT 1".replace("lineitem a", "li a").replace("lineitem b", "li b").replace("WITH p", "WITH li AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rowid_ FROM lineitem), k AS (SELECT DISTINCT l_orderkey AS g FROM lineitem), p").replace("SELECT 1", ", a AS (SELECT g, sum(CASE WHEN s > 0 THEN w WHEN s = 0 AND w > 0 THEN w * 0.5 ELSE 0 END) AS good, sum(w) AS w FROM p GROUP BY g) SELECT round(avg(CASE WHEN coalesce(w, 0) > 0 THEN good / w ELSE 0.5 END), 6) AS accuracy FROM k LEFT JOIN a USING (g)"))
def _(t):
    return M.pair_accuracy(t.lineitem, "l_orderkey", "l_extendedprice", "l_quantity").select(F.round("accuracy", 6).alias("accuracy"))


@query("agg_abs_acc", "SELECT round(avg(CAST(sign(n_chars - 2000) = sign(2 * quality - 1) AS INT)), 6) AS accuracy FROM documents JOIN labels USING (doc_id)")
def _(t):
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id")
    return rows.agg(F.round(F.avg((F.signum(F.col("n_chars") - 2000.0) == F.signum(2.0 * F.col("quality") - 1)).cast("int")), 6).alias("accuracy"))


#: A sample is a user's history: token scores, a mask, and an outcome at the last token the mask names; four samples are one prompt's.
RLOO = f"""WITH {V.INTER}, s AS (SELECT uid, (row_number() OVER (ORDER BY uid) - 1) // 4 AS g, list_transform(hist_pid, lambda p: (p % 7 - 3) / 10.0) AS r, hist_like AS m, uid % 3 / 2.0 AS acc FROM inter WHERE list_sum(hist_like) > 0),
n AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM s), e AS (SELECT uid, g, n, acc, unnest(r) AS r, unnest(m) AS m, generate_subscripts(m, 1) AS i FROM n WHERE n = 4),
a AS (SELECT uid, g, acc, sum(r * m) / sum(m) AS mean, max(i) FILTER (m = 1) AS last FROM e GROUP BY ALL), b AS (SELECT *, sum(mean) OVER (PARTITION BY g) / 3 AS base, sum(acc) OVER (PARTITION BY g) / 3 AS acc_base FROM a),
f AS (SELECT e.uid, e.g, i, m, CASE WHEN m = 1 THEN 0.5 * (r * 4 / 3 - base) + CASE WHEN i = last THEN 2.0 * (e.acc * 4 / 3 - acc_base) ELSE 0 END ELSE 0 END AS x FROM e JOIN b USING (uid)),
c AS (SELECT *, sum(x) OVER (PARTITION BY uid ORDER BY i DESC) AS ret FROM f), w AS (SELECT avg(ret) FILTER (m = 1) AS mean, var_samp(ret) FILTER (m = 1) AS var FROM c)
SELECT uid, count(*) AS tokens, round(sum(ret), 6) + 0.0 AS returns, round(max(ret) FILTER (i = 1), 6) + 0.0 AS whole, round(sum((ret - mean) / sqrt(var + 1e-8) * m), 4) + 0.0 AS advantage FROM c, w GROUP BY uid"""


@query("agg_masked_rloo", RLOO)
def _(t):
    from brindle.operators.batch import split_id, with_row_id

    rows = V.interactions(t).where("aggregate(hist_like, 0, (a, x) -> a + x) > 0").select("uid", F.transform("hist_pid", lambda p: (p % 7 - 3) / 10.0).alias("r"), F.col("hist_like").alias("m"), (F.col("uid") % 3 / 2.0).alias("acc"))
    grouped = with_row_id(rows, ["uid"]).withColumn("g", split_id(4))
    out = G.masked_rloo(grouped, "g", 4, "m", {"r": 0.5}, {"acc": 2.0})
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return out.select("uid", F.size("m").cast("long").alias("tokens"), (F.round(total("returns"), 6) + 0.0).alias("returns"), (F.round(F.get("returns", F.lit(0)), 6) + 0.0).alias("whole"), (F.round(total(F.zip_with("advantages", "m", lambda a, m: a * m)), 4) + 0.0).alias("advantage"))


@query("agg_bce", "SELECT round(avg(ln(1 + exp(-(2 * quality - 1) * (n_chars - 2000) / 1000.0))), 6) AS loss FROM documents JOIN labels USING (doc_id)")
def _(t):
    x = (2 * F.col("quality") - 1) * (F.col("n_chars") - 2000) / 1000.0
    return t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id").agg(F.round(F.avg(F.log1p(F.exp(-x))), 6).alias("loss"))


@query("agg_pair_pref", "WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) SELECT o_orderkey, row_number() OVER (PARTITION BY i // 2 ORDER BY o_totalprice DESC, i) = 1 AS winner FROM r")
def _(t):
    from brindle.operators.batch import with_row_id

    return G.preference_winners(with_row_id(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"]), "o_totalprice").select("o_orderkey", "winner")


@query("agg_dpo_loss", "SELECT round(avg(0.9 * ln(1 + exp(-0.1 * (l_tax - l_discount))) + 0.1 * ln(1 + exp(0.1 * (l_tax - l_discount)))), 6) AS sigmoid, round(avg((l_tax - l_discount - 5) ** 2), 6) AS ipo FROM lineitem")
def _(t):
    a, b = F.col("l_tax"), F.col("l_discount")
    return t.lineitem.agg(F.round(F.avg(G.dpo_loss(a, b, 0.1, 0.1)), 6).alias("sigmoid"), F.round(F.avg(G.dpo_loss(a, b, 0.1, kind="ipo")), 6).alias("ipo"))


@query("agg_percentile", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS avg, max(value) AS max, min(value) AS min FROM events GROUP BY event_type")
def _(t):
    shares = M.percentiles(t.events, ["event_type"], "value", [0.5, 0.95, 0.99]).groupBy("event_type")
    per = shares.agg(*[F.round(F.max(F.when(F.col("share") == p, F.col("value"))), 6).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))])
    rest = t.events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("avg"), F.max("value").alias("max"), F.min("value").alias("min"))
    return rest.join(per, "event_type")


@query("agg_version_stats", "SELECT count(DISTINCT l_linenumber) AS versions, round(avg(CAST(l_suppkey % 5 <> l_partkey % 5 AS INT)), 6) AS changed, max(abs(l_suppkey % 5 - l_partkey % 5)) AS span FROM lineitem")
def _(t):
    d = F.col("l_suppkey") % 5 - F.col("l_partkey") % 5
    return t.lineitem.agg(F.countDistinct("l_linenumber").alias("versions"), F.round(F.avg((d != 0).cast("int")), 6).alias("changed"), F.max(F.abs(d)).alias("span"))


@query("agg_tail_ratio", "SELECT round(avg(CAST(value > q AS INT)), 6) AS ratio, min(value) AS min, max(value) AS max FROM events, (SELECT quantile_cont(value, 0.9) AS q FROM events)")
def _(t):
    edge = M.percentiles(t.events, [], "value", [0.9]).select(F.col("value").alias("q"))
    return t.events.join(F.broadcast(edge)).agg(F.round(F.avg((F.col("value") > F.col("q")).cast("int")), 6).alias("ratio"), F.min("value").alias("min"), F.max("value").alias("max"))


@query("agg_word_count", "SELECT conv_id, sum(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))) AS words FROM conversations WHERE turn >= 2 GROUP BY conv_id")
def _(t):
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return t.conversations.where("turn >= 2").groupBy("conv_id").agg(F.sum(words).alias("words"))


# Each document against the next one, the last against the first.
BLEU = """WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n, coalesce(string_split(text, ' '), []) AS w FROM documents),
p AS (SELECT a.doc_id, a.w AS c, b.w AS r FROM d a JOIN d b ON b.i = (a.i + 1) % a.n),
g AS (SELECT doc_id, k, unnest(list_transform(range(1, len(c) - k + 2), lambda j: array_to_string(c[j:j+k-1], ' '))) AS g, 1 AS mine FROM p, range(1, 5) t(k) UNION ALL SELECT doc_id, k, unnest(list_transform(range(1, len(r) - k + 2), lambda j: array_to_string(r[j:j+k-1], ' '))), 0 FROM p, range(1, 5) t(k)),
h AS (SELECT doc_id, k, sum(least(a, b)) AS h FROM (SELECT doc_id, k, g, sum(mine) AS a, sum(1 - mine) AS b FROM g GROUP BY ALL) GROUP BY ALL),
l AS (SELECT p.doc_id, len(c) AS nc, len(r) AS nr, t.k AS k, coalesce(h, 0) AS h, greatest(len(c) - t.k + 1, 0) AS all_k FROM p CROSS JOIN range(1, 5) t(k) LEFT JOIN h ON h.doc_id = p.doc_id AND h.k = t.k),
s AS (SELECT doc_id, nc, nr, min(h) FILTER (k = 1) AS h1, sum(CASE WHEN k = 1 AND h = 0 THEN 0 ELSE ln((h + CASE WHEN k > 1 THEN 1.0 ELSE 0.0 END) / (all_k + CASE WHEN k > 1 THEN 1.0 ELSE 0.0 END)) END) AS logs FROM l GROUP BY ALL)
SELECT doc_id, round(CASE WHEN nc > 0 AND h1 > 0 THEN exp(logs / 4) * CASE WHEN nc < nr THEN exp(1 - nr / nc) ELSE 1.0 END ELSE 0.0 END, 6) AS bleu FROM s"""


@query("agg_bleu", BLEU)
def _(t):
    rows = B.with_row_id(t.documents.select("doc_id", F.col("text").alias("w")), ["doc_id"])
    ends = rows.agg(F.max("row_id").alias("last"))
    after = rows.join(F.broadcast(ends)).select(F.when(F.col("row_id") == 0, F.col("last")).otherwise(F.col("row_id") - 1).alias("row_id"), F.col("w").alias("ref"))
    both = rows.join(after, "row_id").select("doc_id", *[F.split(c, " ").alias(c) for c in ("w", "ref")])
    return M.bleu_rows(both, "doc_id", "w", "ref").select("doc_id", F.round("bleu", 6).alias("bleu"))


@query("sink_report", "SELECT lang, round(sum(n_chars) FILTER (source = 'src1'), 2) AS recall_src1, round(sum(n_chars) FILTER (source = 'src2'), 2) AS pass_src2 FROM documents GROUP BY lang")
def _(t):
    rows = t.documents.groupBy("lang", F.when(F.col("source") == "src1", "recall_src1").when(F.col("source") == "src2", "pass_src2").alias("metric")).agg(F.sum("n_chars").cast("double").alias("v"))
    return M.report(rows, "lang", "metric", "v", ["recall_src1", "pass_src2"])
