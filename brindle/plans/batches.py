"""Sources, sinks, batch algebra, sampling, retrieval, quantisation and sequences over the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from brindle.operators import batch as B
from brindle.operators import quantize as Z
from brindle.operators import sampling as R
from brindle.operators import sequences as Q
from brindle.operators import similar as U
from brindle.operators import text_index as TI
from brindle.operators import vector_index as VI
from brindle.plans import views as V
from brindle.plans.registry import query
from brindle.session import scratch
from brindle.sources import io


# Sources and sinks, on the driver's files.


@query("src_scan_filter", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_discount > 0.05")
def _(t):
    return t.lineitem.where("l_shipdate >= DATE '1996-01-01' AND l_discount > 0.05").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("src_mixed_paths", "SELECT count(*) AS n FROM (SELECT n_nationkey FROM nation UNION ALL SELECT r_regionkey FROM region)")
def _(t):
    found = [*io.mixed_paths(t.spark, [f"{t.sf_dir}/nation.parquet", f"{t.sf_dir}/nation.parquet", f"{t.sf_dir}/missing", f"{t.sf_dir}/region.parquet"])]
    frames = [t.spark.read.parquet(p).select(F.col(c).alias("k")) for p in found for c in ["n_nationkey" if "nation.parquet" in p else "r_regionkey"]]
    return io.union_by_name(*frames).agg(F.count("*").alias("n"))


@query("src_fragments", "SELECT least(count(*), 100) AS n, CAST(max(len(embedding)) AS INT) AS width FROM embeddings")
def _(t):
    return io.read_column(t.spark, f"{t.sf_dir}/embeddings.parquet", "embedding", 100).agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width"))


@query("src_epochs", "SELECT n_name AS file, e AS epoch FROM nation, range(3) t(e)")
def _(t):
    return io.epochs(t.nation.select(F.col("n_name").alias("file")), "file", 3, 42).select("file", "epoch")


@query("src_assign", "SELECT worker, count(*) AS files FROM (SELECT (row_number() OVER (ORDER BY n_name) - 1) % 8 AS worker FROM nation) GROUP BY worker")
def _(t):
    return B.with_row_id(t.nation.select("n_name"), ["n_name"]).groupBy(io.worker_of(F.col("row_id"), 8).alias("worker")).agg(F.count("*").alias("files"))


@query("src_canonical", "SELECT source, CASE WHEN lang = 'nan' THEN NULL ELSE lang END AS label, count(*) AS n FROM documents GROUP BY ALL")
def _(t):
    return io.canonical(t.documents.withColumnRenamed("lang", "label")).groupBy("source", "label").agg(F.count("*").alias("n"))


@query("src_validation", "SELECT count(*) AS invalid FROM conversations WHERE role NOT IN ('user', 'assistant')")
def _(t):
    part = F.to_json(F.array(F.struct("role", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content"))))
    rows = t.conversations.select(F.when(F.col("role").isin("user", "assistant"), part).alias("messages"), F.lit("{}").alias("metadata"), F.lit(None).cast("string").alias("segments"))
    return io.invalid_rows(rows).agg(F.count("*").alias("invalid"))


@query("sink_sharded", "SELECT shard, count(*) AS n, min(o_orderkey) AS first FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS shard FROM orders) GROUP BY shard")
def _(t):
    return R.shards(t.orders.select("o_orderkey"), 1000, ["o_orderkey"]).groupBy("shard").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("sink_multimap_json", "WITH c AS (SELECT l_suppkey AS sid, l_partkey AS pid, count(*) AS n FROM lineitem GROUP BY ALL) SELECT sid, CAST(to_json(list({'pid': pid, 'count': n} ORDER BY n DESC, pid)) AS VARCHAR) AS items FROM c GROUP BY sid")
def _(t):
    counted = t.lineitem.groupBy(F.col("l_suppkey").alias("sid"), F.col("l_partkey").alias("pid")).agg(F.count("*").alias("n"))
    return io.multimap(counted, "sid", "pid", "n")


# Batch algebra: the batch is the orders table in key order.

ROWS = "b AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, o_orderkey AS k FROM orders)"


def rows(t):
    return B.with_row_id(t.orders.select(F.col("o_orderkey").alias("k")), ["k"])


@query("dp_row_id", f"WITH {ROWS} SELECT * FROM b")
def _(t):
    return rows(t)


@query("dp_slice", f"WITH {ROWS} SELECT row_id, k FROM b WHERE row_id >= 10 AND row_id < 5000 AND (row_id - 10) % 7 = 0")
def _(t):
    return B.take_slice(rows(t), 10, 5000, 7)


@query("dp_select", "SELECT o_orderkey AS key, o_orderstatus FROM orders")
def _(t):
    return t.orders.select("o_orderkey", "o_orderstatus", "o_clerk" if "o_clerk" in t.orders.columns else "o_custkey").drop("o_clerk", "o_custkey").withColumnsRenamed({"o_orderkey": "key"})


@query("dp_pop_rename", f"WITH {ROWS} SELECT row_id, k AS key, -k AS popped FROM b")
def _(t):
    popped, rest = B.pop(rows(t).withColumn("negative", -F.col("k")), "negative")
    return B.rename(B.union_columns(rest, popped), {"k": "key", "negative": "popped"}).select("row_id", "key", "popped")


@query("dp_union", f"WITH {ROWS} SELECT row_id, k, k * 2 AS double FROM b")
def _(t):
    r = rows(t)
    return B.union_columns(r, r.withColumn("double", F.col("k") * 2))


@query("dp_sample_repeat", f"WITH {ROWS} SELECT row_id, k, r AS rep FROM b, range(3) t(r) WHERE r < row_id % 4")
def _(t):
    return B.repeat_each(rows(t), F.col("row_id") % 4)


@query("dp_fold", f"WITH {ROWS} SELECT row_id // 4 AS row_id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY row_id) AS k FROM b GROUP BY row_id // 4")
def _(t):
    return B.fold(rows(t), 4, "k").select("row_id", F.array_join(F.transform("k", lambda x: x.cast("string")), ",").alias("k"))


@query("dp_unfold", f"WITH {ROWS} SELECT row_id, k FROM b")
def _(t):
    return B.unfold(B.fold(rows(t), 4, "k"), 4, "k")


ALL = f"{ROWS}, c AS (SELECT count(*) AS n FROM orders)"


def all_rows(t):
    return rows(t), t.orders.count()


def _step(n: int, least: int) -> int:
    """The smallest step from `least` on that visits every one of n places."""
    return next(m for m in range(least, least + n + 1) if math.gcd(m, n) == 1)


@query("dp_select_idxs", f"WITH {ALL} SELECT r AS row_id, k FROM b JOIN (SELECT r, (r * 31) % n AS row_id FROM c, (SELECT unnest(range(2 * n)) AS r FROM c)) USING (row_id)")
def _(t):
    r, n = all_rows(t)
    return B.take_ids(r, t.spark.range(2 * n).select(F.col("id").alias("new_id"), ((F.col("id") * 31) % n).alias("row_id")))


@query("dp_concat", f"WITH {ALL} SELECT row_id + n * r AS row_id, k FROM b, c, range(2) t(r)")
def _(t):
    r, n = all_rows(t)
    return B.concat((r, n), (r, n))


@query("dp_chunk", f"WITH {ALL} SELECT row_id // ((n + 19) // 20) AS chunk, row_id // 64 AS piece, count(*) AS n FROM b, c GROUP BY ALL")
def _(t):
    # Equal chunks need a size that divides: ids up to the next multiple belong to padding that has no rows.
    r, n = all_rows(t)
    return r.groupBy(B.chunk_id(n + -n % 20, 20).alias("chunk"), B.split_id(64).alias("piece")).agg(F.count("*").alias("n"))


@query("dp_reorder", f"WITH {ALL} SELECT n - 1 - row_id AS row_id, k FROM b, c")
def _(t):
    r, n = all_rows(t)
    return B.take_ids(r, t.spark.range(n).select((n - 1 - F.col("id")).alias("new_id"), F.col("id").alias("row_id")))


@query("dp_repeat", f"WITH {ROWS} SELECT row_id * 3 + r AS row_id, k FROM b, range(3) t(r)")
def _(t):
    return B.repeat(rows(t), 3)


@query("dp_tile", f"WITH {ALL} SELECT r * n + row_id AS row_id, k FROM b, c, range(3) t(r)")
def _(t):
    r, n = all_rows(t)
    return B.repeat(r, 3, interleave=False, rows=n)


@query("dp_iterator", f"WITH {ROWS} SELECT row_id // 100 AS mini, count(*) AS n FROM b GROUP BY ALL")
def _(t):
    r, n = all_rows(t)
    return r.groupBy(B.batch_ids(n + -n % 100, 100).alias("mini")).agg(F.count("*").alias("n"))


@query("dp_reverse_idx", f"WITH {ROWS} SELECT row_id, k FROM b")
def _(t):
    r, n = all_rows(t)
    there = t.spark.range(n).select(F.col("id").alias("row_id"), ((F.col("id") * _step(n, 7)) % n).alias("new_id"))
    back = there.select(F.col("new_id").alias("row_id"), F.col("row_id").alias("new_id"))
    return B.take_ids(B.take_ids(r, there), back)


@query("dp_pad", f"WITH {ALL} SELECT row_id, k FROM b UNION ALL SELECT row_id + n, k FROM b, c WHERE row_id < 1024 - n % 1024 AND n % 1024 > 0")
def _(t):
    r, n = all_rows(t)
    return B.pad_to(r, n, 1024)


@query("dp_unpad", f"WITH {ROWS} SELECT row_id, k FROM b")
def _(t):
    r, n = all_rows(t)
    return B.unpad(B.pad_to(r, n, 1024), n)


@query("dp_collate", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.size(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).cast("long").alias("n"))


@query("set_union_all", "SELECT n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT r_name, NULL FROM region")
def _(t):
    return io.union_by_name(t.nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), t.region.select(F.col("r_name").alias("name")))


@query("set_concat_repeat", "SELECT r_name, e AS epoch FROM region, range(20) t(e)")
def _(t):
    return t.region.select("r_name", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("epoch"))


@query("set_intersect", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def _(t):
    return t.documents.select("doc_id").intersect(t.labels.select("doc_id"))


@query("set_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(t):
    return t.documents.select("doc_id").exceptAll(t.labels.select("doc_id"))


# Samples, splits, orders.


@query("lim_head", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100")
def _(t):
    return t.orders.select("o_orderkey").orderBy("o_orderkey").limit(100)


@query("lim_sample_exact", "SELECT o_orderkey FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 500")
def _(t):
    return R.sample_exact(t.orders.select("o_orderkey"), 500, 42, "o_orderkey")


@query("lim_split_exact", "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5('42|' || o_orderkey)) <= 1000 THEN 'test' ELSE 'train' END AS part FROM orders")
def _(t):
    return R.split_exact(t.orders.select("o_orderkey"), 1000, 42, "o_orderkey")


@query("lim_split_frac", "SELECT o_orderkey, CASE WHEN CAST('0x' || substr(md5('42|' || o_orderkey), 1, 8) AS BIGINT) / 4294967296.0 < 0.1 THEN 'test' ELSE 'train' END AS part FROM orders")
def _(t):
    return R.split_fraction(t.orders.select("o_orderkey"), 0.1, 42, "o_orderkey")


@query("lim_shuffle", "SELECT o_orderkey, row_number() OVER (ORDER BY md5('1042|' || o_orderkey)) - 1 AS place FROM orders")
def _(t):
    return R.shuffle(t.orders.select("o_orderkey"), 1042, "o_orderkey")


@query("lim_max_rows", "SELECT least(count(*), 200) AS n FROM embeddings")
def _(t):
    return t.embeddings.select("embedding").limit(200).agg(F.count("*").alias("n"))


@query("lim_resample_weighted", "WITH w AS (SELECT c_custkey AS k, c_custkey % 10 + 1 AS w FROM customer), c AS (SELECT k, sum(w) OVER (ORDER BY k) AS hi, w, sum(w) OVER () AS total FROM w), d AS (SELECT i AS draw, CAST('0x' || substr(md5('7|' || i), 1, 12) AS BIGINT) / 281474976710656.0 AS u FROM range(1000) t(i)) SELECT draw, k FROM d JOIN c ON u * total >= hi - w AND u * total < hi")
def _(t):
    return R.resample_weighted(t.customer.select(F.col("c_custkey").alias("k")), F.col("k") % 10 + 1, 1000, 7, "k").select("draw", "k")


@query("lim_workload_cost", "SELECT doc_id, 24576 * n_chars + n_chars * n_chars AS cost FROM documents")
def _(t):
    return t.documents.select("doc_id", Q.workload(F.col("n_chars")).alias("cost"))


@query("srt_workload", "SELECT o_custkey, row_number() OVER (ORDER BY s DESC, f) - 1 AS place FROM (SELECT o_custkey, sum(o_orderkey % 100 * (o_orderkey % 100)) AS s, min(o_orderkey) AS f FROM orders GROUP BY o_custkey)")
def _(t):
    per = t.orders.groupBy("o_custkey").agg(F.sum((F.col("o_orderkey") % 100) * (F.col("o_orderkey") % 100)).alias("s"), F.min("o_orderkey").alias("f"))
    return B.with_row_id(per.withColumn("neg", -F.col("s")), ["neg", "f"], "place").select("o_custkey", "place")


@query("srt_score", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def _(t):
    return t.orders.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query("srt_metric_order", "SELECT name, row_number() OVER (ORDER BY CASE WHEN name LIKE 'pass%' THEN 0 WHEN name LIKE 'recall%' THEN 1 ELSE 2 END, name) - 1 AS place FROM (SELECT DISTINCT CASE user_id % 3 WHEN 0 THEN 'pass@' WHEN 1 THEN 'recall@' ELSE 'ndcg@' END || user_id AS name FROM events)")
def _(t):
    kind = F.element_at(F.array(F.lit("pass@"), F.lit("recall@"), F.lit("ndcg@")), (F.col("user_id") % 3 + 1).cast("int"))
    names = t.events.select(F.concat(kind, F.col("user_id").cast("string")).alias("name")).distinct()
    rank = F.when(F.col("name").startswith("pass"), 0).when(F.col("name").startswith("recall"), 1).otherwise(2)
    return B.with_row_id(names.withColumn("rank", rank), ["rank", "name"], "place").select("name", "place")


# Retrieval: users are customers, tokens their parts.


def _tokens(t, last: int | None, prefix: bool = False, index: int | None = None, most: int | None = None):
    rows = V.interactions(t)
    if index is not None:
        # The first users of either side: for a small run the index and the output are capped.
        first = lambda split, n: rows.where(F.col("split") == split).select("uid").orderBy("uid").limit(n)
        rows = rows.join(first(0, index).unionByName(first(1, most)), "uid", "left_semi")
    ids = F.col("hist_pid") if last is None else F.slice("hist_pid", F.greatest(F.size("hist_pid") - last + 1, F.lit(1)), F.lit(last))
    token = F.floor(F.col("pid") / 4) if prefix else F.col("pid")
    path = scratch(t.spark, "tokens")
    # Both sides come from one pass over the histories.
    rows.select("uid", "split", F.explode(ids).alias("pid")).select("uid", "split", token.alias("token")).write.partitionBy("split").parquet(path)
    split = t.spark.read.schema("uid long, token long, split int").parquet(path)
    return split.where("split = 0").select("uid", "token"), split.where("split = 1").select("uid", "token")


def _similar_sql(last: int | None, prefix: bool, k: int, least: float, recall: float | None, most: float | None, other: bool, caps: tuple[int, int] | None = None) -> str:
    ids = "hist_pid" if last is None else f"hist_pid[greatest(len(hist_pid)-{last - 1},1):]"
    token = "pid // 4" if prefix else "pid"
    guards = f"score >= {least}" + (f" AND o / nq < {recall}" if recall is not None else "") + (f" AND score < {most}" if most is not None else "")
    return (
        f"WITH {V.INTER}, f AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY uid) AS place FROM inter), e AS (SELECT DISTINCT uid, split, {token} AS token FROM (SELECT uid, split, unnest({ids}) AS pid FROM f {f'WHERE place <= CASE split WHEN 0 THEN {caps[0]} ELSE {caps[1]} END' if caps else ''})), t AS (SELECT * FROM e WHERE split = 0), q AS (SELECT * FROM e WHERE split = 1), "
        "nt AS (SELECT uid, count(*) AS nc FROM t GROUP BY uid), nqs AS (SELECT uid, count(*) AS nq FROM q GROUP BY uid), "
        f"c AS (SELECT q.uid AS query, t.uid AS candidate, count(*) AS o FROM q JOIN t USING (token) {'WHERE q.uid <> t.uid' if other else ''} GROUP BY ALL), "
        "p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY o DESC, candidate) AS pl FROM c), s AS (SELECT query, candidate, o, nq, o / (nq + nc - o) AS score FROM p JOIN nqs ON nqs.uid = query JOIN nt ON nt.uid = candidate WHERE pl <= 1000), "
        f"r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, o DESC, candidate) AS place FROM s WHERE {guards}) SELECT query, candidate, o AS overlap, round(score, 6) AS score, CAST(place AS INT) AS place FROM r WHERE place <= {k}"
    )


def _similar(name: str, last: int | None, prefix: bool, k: int, least: float, recall: float | None, most: float | None, other: bool = True, caps: tuple[int, int] | None = None) -> None:
    @query(name, _similar_sql(last, prefix, k, least, recall, most, other, caps))
    def _(t):
        tokens, queries = _tokens(t, last, prefix, *(caps or ()))
        return U.similar_users(tokens, queries, k, 1000, least, recall, most, other).select("query", "candidate", "overlap", F.round("score", 6).alias("score"), "place")


_similar("similar_users_v1", None, False, 3, 0.0, None, None, other=False)
_similar("similar_users_v2", 20, True, 3, 0.005, None, None)
_similar("similar_users_v3", 20, False, 3, 0.005, 0.8, None)
_similar("similar_users_v3_capped", None, False, 3, 0.005, None, 0.95)
_similar("similar_users_v4", 20, False, 1, 0.005, 0.8, None)
_similar("similar_users_small", 20, False, 1, 0.005, 0.8, None, caps=(50_000, 50))


@query("join_inverted_overlap", "WITH e AS (SELECT DISTINCT o_custkey AS u, l_partkey AS t FROM lineitem JOIN orders ON o_orderkey = l_orderkey) SELECT a.u AS query, b.u AS candidate, count(*) AS overlap FROM e a JOIN e b ON a.t = b.t AND a.u <> b.u WHERE a.u % 100 = 0 GROUP BY 1, 2")
def _(t):
    e = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("uid"), F.col("l_partkey").alias("token"))
    return U.overlaps(e, e.where("uid % 100 = 0"), pool=None).select("query", "candidate", "overlap")


@query("agg_collect_index", "SELECT l_partkey AS token, string_agg(CAST(s AS VARCHAR), ',' ORDER BY s) AS postings FROM (SELECT DISTINCT l_partkey, l_suppkey AS s FROM lineitem) GROUP BY l_partkey")
def _(t):
    rows = t.lineitem.groupBy(F.col("l_partkey").alias("token")).agg(F.sort_array(F.collect_set("l_suppkey")).alias("p"))
    return rows.select("token", F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("postings"))


KNN = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query, e.vec_id AS candidate, list_dot_product(q.v, e.v) AS score FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, candidate) AS place FROM s)"


@query("join_knn", f"WITH {KNN} SELECT query, candidate, round(score, 4) AS score, CAST(place AS INT) AS place FROM r WHERE place <= 3")
def _(t):
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return U.knn(e, e.where("vec_id % 100 = 0"), "vec_id", "v").select("query", "candidate", F.round("score", 4).alias("score"), "place")


def _indexed(t):
    """The embeddings by an index of all rows; 24 of 32 lists are probed, as these vectors have hardly any clusters."""
    e, path = t.embeddings.select("vec_id", "embedding"), scratch(t.spark, "vector-index")
    VI.build(e, "vec_id", "embedding", path, VI.fit(e, "vec_id", "embedding", 32))
    return VI.search(*VI.load(t.spark, path), e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 10, 24, 100)


@query("join_knn_index")
def _(t):
    return _indexed(t).select("query", "candidate", F.round("score", 4).alias("score"), "place")


@query("knn_index_recall", f"WITH {KNN}, n AS (SELECT count(*) AS queries FROM embeddings WHERE vec_id % 100 = 0) SELECT queries, TRUE AS recalled, round(sum(score), 3) AS best FROM r, n WHERE place = 1 GROUP BY queries")
def _(t):
    """Recall at 10 of the index against the exact search is at least 0.9, and the best scores of the exact search."""
    e = t.embeddings.select("vec_id", "embedding")
    truth = U.knn(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 10)
    return VI.recall(_indexed(t), truth).join(truth.where("place = 1").agg(F.round(F.sum("score"), 3).alias("best"))).select("queries", (F.col("recall") >= 0.9).alias("recalled"), "best")


BM = "WITH d AS (SELECT item_id AS doc, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM benchmark), n AS (SELECT count(*) AS n, avg(len(w)) AS avg FROM d), tf AS (SELECT doc, len(w) AS len, unnest(w) AS term FROM d), tfc AS (SELECT doc, len, term, count(*) AS tf FROM tf GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tfc GROUP BY term), q AS (SELECT DISTINCT doc AS query, term FROM tf WHERE doc % 10 = 0), s AS (SELECT query, doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg))) AS score FROM q JOIN df USING (term) JOIN tfc USING (term), n GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS place FROM s) SELECT query, doc, round(score, 4) AS score, CAST(place AS INT) AS place FROM r WHERE place <= 3"


@query("join_bm25", BM)
def _(t):
    d = t.benchmark.select("item_id", "text")
    return U.bm25(d, d.where("item_id % 10 = 0"), "item_id", "text", "item_id", "text").select("query", "doc", F.round("score", 4).alias("score"), "place")


BM_INDEX = "WITH d AS (SELECT doc_id AS doc, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents), n AS (SELECT count(*) AS n, avg(len(w)) AS avg FROM d), tfc AS (SELECT doc, len, term, count(*) AS tf FROM (SELECT doc, len(w) AS len, unnest(w) AS term FROM d) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tfc GROUP BY term), q AS (SELECT DISTINCT n_nationkey AS query, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS term FROM nation JOIN benchmark ON item_id % 25 = n_nationkey), s AS (SELECT query, doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg))) AS score FROM q JOIN df USING (term) JOIN tfc USING (term), n GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS place FROM s) SELECT query, doc, round(score, 4) AS score, CAST(place AS INT) AS place FROM r WHERE place <= 3"


@query("join_bm25_index", BM_INDEX)
def _(t):
    """Documents by a stored index of all their words; a query is the text of the benchmark items of a nation's number."""
    path = scratch(t.spark, "text-index")
    TI.build(t.documents, "doc_id", "text", path)
    asked = t.benchmark.join(F.broadcast(t.nation.select("n_nationkey")), F.col("item_id") % 25 == F.col("n_nationkey")).groupBy("n_nationkey").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    return TI.search(t.spark, path, asked, "n_nationkey", "text").select("query", "doc", F.round("score", 4).alias("score"), "place")


# Quantiser. Codebooks for the checked queries are given rows; training is checked in tests.


def _book(t, low: int):
    return [[float(x) for x in r["embedding"]] for r in t.embeddings.where(f"vec_id >= {low} AND vec_id < {low + 8}").orderBy("vec_id").collect()]


NEAREST = "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT vec_id AS code, v AS c FROM e WHERE vec_id < 8), d AS (SELECT e.vec_id, v, code, c, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM e, c), b AS (SELECT vec_id, v, arg_min(code, dist) AS code, arg_min(c, dist) AS c FROM d GROUP BY vec_id, v)"


@query("rq_encode", f"{NEAREST} SELECT vec_id, CAST(code AS INT) AS code FROM b")
def _(t):
    import numpy as np

    return Z.encode(t.embeddings, "vec_id", "embedding", [np.array(_book(t, 0))]).select("vec_id", F.get("codes", F.lit(0)).alias("code"))


@query("rq_decode_loss", f"{NEAREST}, x AS (SELECT unnest(v) AS x, unnest(c) AS y FROM b) SELECT round(avg((x - y) ** 2), 6) AS mse, round(avg(abs(x - y) / (greatest(abs(x), abs(y)) + 1e-4)), 6) AS relative_l1 FROM x")
def _(t):
    import numpy as np

    books = [np.array(_book(t, 0))]
    codes = Z.encode(t.embeddings, "vec_id", "embedding", books)
    decoded = Z.decode(codes, "vec_id", Z.codebook_table(t.spark, books)).withColumnRenamed("vector", "decoded")
    out = Z.reconstruction_loss(t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).join(decoded, "vec_id"), "v", "decoded")
    return out.select(F.round("mse", 6).alias("mse"), F.round("relative_l1", 6).alias("relative_l1"))


@query("rq_train")
def _(t):
    books = Z.train(t.embeddings, "embedding", 2, 8, 5)
    return Z.encode(t.embeddings, "vec_id", "embedding", books)


@query("rq_vocab", "WITH n AS (SELECT max(p_size) AS n FROM part) SELECT row_number() OVER (ORDER BY l, i) - 1 AS place, CASE WHEN l < 4 THEN '<s_' || substr('abc', CAST(l AS INT), 1) || '_' || i || '>' WHEN i = 0 THEN '<|sid_begin|>' ELSE '<|sid_end|>' END AS token FROM range(1, 5) a(l), n, range(n) b(i) WHERE l < 4 OR i < 2")
def _(t):
    """A level has as many codes as the largest part."""
    return Z.vocabulary(t.spark, t.part.agg(F.max("p_size").alias("n")).first()["n"])


# Sequential operators.


@query("win_pack")
def _(t):
    # As many lanes as the tokens ask for: each is a sequence of its own, packed in one task.
    lanes = max(1, -(-(t.documents.agg(F.sum("n_chars").alias("n")).first()["n"] or 0) // 500_000))
    rows = t.documents.select(F.pmod(F.xxhash64("doc_id"), F.lit(lanes)).cast("int").alias("shard"), "doc_id", F.col("n_chars").alias("n"), F.md5(F.col("doc_id").cast("string").cast("binary")).alias("o"))
    return Q.pack_greedy(rows, "shard", "doc_id", "n", "o", 4096)


@query("lim_balanced_partition")
def _(t):
    return Q.balanced_partitions(t.documents.withColumn("batch", F.floor(F.col("doc_id") / 128)), "batch", "doc_id", "n_chars", 8)


#: 128 documents are a batch, dealt to four ranks; counts are even and at least two.
MICRO = """WITH d AS (SELECT doc_id // 128 AS batch, CAST(doc_id % 4 AS INT) AS rank, doc_id AS item, n_chars AS n FROM documents),
r AS (SELECT batch, rank, greatest(2, least(count(*), CAST(ceil(sum(n) / 300000.0) AS BIGINT))) AS wish, count(*) AS items, sum(n) AS tokens FROM d GROUP BY ALL), c AS (SELECT batch, CAST(ceil(max(wish) / 2.0) * 2 AS INT) AS micros FROM r GROUP BY batch)
SELECT batch, rank, micros, items, tokens, TRUE AS ordered FROM r JOIN c USING (batch)"""


@query("lim_micro_batches", MICRO)
def _(t):
    """Per rank: the common number of micro-batches, all its items and tokens, and whether squared lengths fall from one to the next."""
    rows = t.documents.select(F.floor(F.col("doc_id") / 128).alias("batch"), (F.col("doc_id") % 4).cast("int").alias("rank"), "doc_id", F.col("n_chars").alias("n"))
    made = Q.rank_micro_batches(rows, "batch", "rank", "doc_id", "n", 300_000, 2, 2).join(rows.select(F.col("doc_id").alias("item"), "n"), "item")
    per = made.groupBy("batch", "rank", "micros", "micro").agg(F.count("*").alias("items"), F.sum("n").alias("tokens"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    listed = per.groupBy("batch", "rank", "micros").agg(F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.array_sort(F.collect_list(F.struct("micro", "squares"))).alias("m"))
    falls = F.forall(F.transform("m", lambda x, i: (i == 0) | (x["squares"] <= F.get("m", i - 1)["squares"])), lambda x: x) & (F.size("m") == F.col("micros"))
    return listed.select("batch", "rank", "micros", "items", "tokens", falls.alias("ordered"))
