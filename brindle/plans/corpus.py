"""Corpus builders over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import sid
from brindle.functions import text as T
from brindle.operators import corpus as C
from brindle.operators import lookup as L
from brindle.plans import views as V
from brindle.plans.registry import query

SYSTEM = V.pick(C.SYSTEMS, "'42|' || uid || '|system'")
LAST512, FIRST10 = "hist_pid[greatest(len(hist_pid)-511,1):]", "target_pid[1:10]"
TRAIN = "train AS (SELECT * FROM inter WHERE split = 0)"


@query("build_pretrain_video", f"WITH {V.INTER}, {V.CODES}, {TRAIN}, {V.found('h', 'hist_pid[1:512]', 'train')}, {V.found('t', FIRST10, 'train')} SELECT uid, CAST(to_json([{{'type': 'text', 'text': h_s || coalesce(t_s, '')}}]) AS VARCHAR) AS segments FROM h LEFT JOIN t USING (uid)")
def _(t):
    return C.pretrain_video(V.interactions(t), V.codes(t))


@query("build_pretrain_profile", "SELECT c_custkey AS uid, CAST(to_json([{'type': 'text', 'text': c_mktsegment}]) AS VARCHAR) AS segments FROM customer WHERE c_custkey % 5 <> 4 AND length(trim(c_mktsegment)) > 0")
def _(t):
    return C.pretrain_profile(t.customer.select(F.col("c_custkey").alias("uid"), F.when(F.col("c_custkey") % 5 == 4, 1).otherwise(0).alias("split"), "c_mktsegment"), "c_mktsegment")


@query("build_pretrain_item", f"WITH {V.CODES}, {V.CAPTIONS}, x AS (SELECT pid, code, caption, {V.draw(chr(39) + '42|' + chr(39) + ' || pid || ' + chr(39) + '|item' + chr(39), 3)} AS c FROM captions JOIN codes USING (pid) WHERE length(trim(caption)) > 0) SELECT pid, CAST(to_json([{{'type': 'text', 'text': CASE c WHEN 0 THEN code || ': ' || caption WHEN 1 THEN 'Item ' || code || ' shows ' || caption ELSE CAST(to_json({{'item': code, 'caption': caption}}) AS VARCHAR) END}}]) AS VARCHAR) AS segments FROM x")
def _(t):
    return C.pretrain_item(V.captions(t), V.codes(t))


ITEM_USER = V.pick(C.ITEMS, "'42|' || uid || '|user'")
VIDEO_USER = V.pick(C.USERS, "'42|' || uid || '|user'")


@query("build_sft_video", f"WITH {V.INTER}, {V.CODES}, {TRAIN}, {V.found('h', LAST512, 'train')}, {V.found('t', FIRST10, 'train')} SELECT uid, {V.chat(('system', SYSTEM), ('user', f'replace({VIDEO_USER}, {chr(39)}{{}}{chr(39)}, h_s)'), ('assistant', 't_s'))} AS messages FROM h JOIN t USING (uid)")
def sft_video(t):
    return C.sft_video(V.interactions(t), V.codes(t))


def _masked(items: str, mask: str) -> str:
    return f"list_transform(list_filter(list_zip({items}, {mask}), lambda z: z[2] = 1), lambda z: z[1])"


ADS = f"{V.INTER}, {V.CODES}, train AS (SELECT *, {_masked('hist_pid', 'hist_longview')} AS longview_pid, {_masked('hist_pid', 'hist_like')} AS ad_pid FROM inter WHERE split = 0)"


@query("build_sft_ad", f"WITH {ADS}, {V.found('v', 'longview_pid[greatest(len(longview_pid)-99,1):]', 'train')}, {V.found('a', 'ad_pid[greatest(len(ad_pid)-199,1):]', 'train')}, {V.found('t', FIRST10, 'train')} SELECT uid, {V.chat(('system', SYSTEM), ('user', 'concat_ws(chr(10), ' + repr('Watched: ') + ' || v_s, ' + repr('Clicked ads: ') + ' || a_s)'), ('assistant', 't_s'))} AS messages FROM t LEFT JOIN v USING (uid) LEFT JOIN a USING (uid) WHERE v_s IS NOT NULL OR a_s IS NOT NULL")
def _(t):
    return C.sft_ad(V.interactions(t), V.codes(t))


@query("build_sft_product", f"WITH {ADS}, {V.GOODS}, {V.found('v', 'longview_pid[greatest(len(longview_pid)-99,1):]', 'train')}, {V.found('g', 'goods_pid[greatest(len(goods_pid)-99,1):]', 'train', 'goods')}, {V.found('t', 'target_goods_pid[1:10]', 'train', 'goods')} SELECT uid, {V.chat(('system', SYSTEM), ('user', 'concat_ws(chr(10), ' + repr('Watched: ') + ' || v_s, ' + repr('Bought: ') + ' || g_s)'), ('assistant', 't_s'))} AS messages FROM t LEFT JOIN v USING (uid) LEFT JOIN g USING (uid) WHERE v_s IS NOT NULL OR g_s IS NOT NULL")
def _(t):
    return C.sft_product(V.interactions(t), V.codes(t), V.goods_codes(t))


@query(
    "build_sft_interactive",
    f"WITH {V.INTER}, {V.CODES}, {TRAIN}, kw AS (SELECT uid, flag AS keyword, list(pid ORDER BY ts, ok, ln, pid) AS items FROM clicks GROUP BY uid, flag), keyed AS (SELECT uid || '|' || keyword AS k, uid, keyword, items[1:10] AS items, {LAST512} AS h FROM kw JOIN train USING (uid)), "
    f"{V.found('hh', 'h', 'keyed', 'codes', 'k')}, {V.found('tt', 'items', 'keyed', 'codes', 'k')} SELECT uid, keyword, {V.chat(('system', SYSTEM), ('user', repr('History: ') + ' || coalesce(hh_s, ' + repr('') + ') || chr(10) || ' + repr('The viewer asks for: ') + ' || keyword'), ('assistant', 'tt_s'))} AS messages FROM keyed JOIN tt USING (k) LEFT JOIN hh USING (k)",
)
def _(t):
    # Line items meet orders once: histories and keywords come from the same list.
    rows = V.clicks(t).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("ts", "ok", "ln", "pid", "flag"))).alias("x"))
    past = F.slice(F.transform("x", lambda e: e["pid"]), F.lit(1), F.greatest(F.size("x") - 3, F.lit(0)))
    flags = F.array_compact(F.array_distinct(F.transform("x", lambda e: e["flag"])))
    items = F.transform(flags, lambda f: F.struct(f.alias("flag"), F.transform(F.filter("x", lambda e: e["flag"] == f), lambda e: e["pid"]).alias("i")))
    split = F.when(F.col("uid") % 5 == 4, 1).otherwise(0)
    return C.sft_interactive(rows.select("uid", split.alias("split"), past.alias("hist_pid"), F.to_json(F.map_from_entries(items)).alias("keyword_items")), V.codes(t))


ACTIONS = list(V.ACTION_TESTS)
WANTED = "list_filter([" + ", ".join(f"CASE WHEN len({_masked('target_pid', f'target_{a}')}) > 0 THEN '{a}' END" for a in ACTIONS) + "], lambda z: z IS NOT NULL)"
COND = (
    f"{V.INTER}, {V.CODES}, w AS (SELECT *, {WANTED} AS wanted FROM inter WHERE split = 0), p AS (SELECT *, list_extract(wanted, CAST({V.draw(chr(39) + '42|' + chr(39) + ' || uid || ' + chr(39) + '|action' + chr(39), 'len(wanted)')} AS BIGINT) + 1) AS action FROM w WHERE len(wanted) > 0), "
    + "q AS (SELECT *, CASE action "
    + " ".join(f"WHEN '{a}' THEN {_masked('target_pid', f'target_{a}')}" for a in ACTIONS)
    + " END AS tgt, "
    + ", ".join(f"{_masked('hist_pid', f'hist_{a}')} AS m_{a}" for a in ACTIONS)
    + " FROM p), "
    + ", ".join(V.found(f"f_{a}", f"m_{a}[greatest(len(m_{a})-9,1):]", "q") for a in ACTIONS)
    + ", "
    + V.found("t", "tgt[1:10]", "q")
)
COND_PROMPT = "concat_ws(chr(10), " + ", ".join(f"'{a}: ' || f_{a}_s" for a in ACTIONS) + ", 'predict: ' || action)"


@query("build_sft_label_cond", f"WITH {COND} SELECT uid, action, {V.chat(('system', SYSTEM), ('user', COND_PROMPT), ('assistant', 't_s'))} AS messages FROM q JOIN t USING (uid) " + " ".join(f"LEFT JOIN f_{a} USING (uid)" for a in ACTIONS))
def _(t):
    return C.sft_label_cond(V.interactions(t), V.codes(t))


@query(
    "build_sft_label_pred",
    f"WITH {V.INTER}, {V.CODES}, {TRAIN}, e AS (SELECT uid, unnest(target_pid[1:10]) AS pid, unnest(target_longview[1:10]) AS label, generate_subscripts(target_pid[1:10], 1) - 1 AS pos FROM train) SELECT uid, CAST(pos AS INT) AS pos, label, {V.chat(('system', SYSTEM), ('user', repr('Will the viewer finish ') + ' || code || ' + repr('?')), ('assistant', 'CASE WHEN label = 1 THEN ' + repr('是') + ' ELSE ' + repr('否') + ' END'))} AS messages FROM e JOIN codes USING (pid)",
)
def _(t):
    return C.sft_label_pred(V.interactions(t), V.codes(t))


@query("agg_posneg", f"WITH {V.INTER}, {V.CODES}, {TRAIN}, e AS (SELECT unnest(target_pid[1:10]) AS pid, unnest(target_longview[1:10]) AS label FROM train) SELECT count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM e JOIN codes USING (pid)")
def _(t):
    return C.sft_label_pred(V.interactions(t), V.codes(t)).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))


@query("build_sft_item", f"WITH {V.CODES}, {V.CAPTIONS}, x AS (SELECT pid AS uid, code, caption FROM captions JOIN codes USING (pid) WHERE length(trim(caption)) > 0) SELECT uid, {V.chat(('system', SYSTEM), ('user', f"replace({ITEM_USER}, '{{}}', code)"), ('assistant', 'caption'))} AS messages FROM x")
def _(t):
    return C.sft_item(V.captions(t), V.codes(t))


REASON = "x AS (SELECT c_custkey AS uid, c_mktsegment AS profile, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS alike, n_name AS target_caption, CASE WHEN c_custkey % 7 = 0 THEN '   ' ELSE ' because ' || c_name END AS cot FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query("build_sft_reason", f"WITH {REASON} SELECT uid, {V.chat(('system', SYSTEM), ('user', 'profile || chr(10) || ' + repr('Similar: ') + ' || coalesce(alike, ' + repr('None') + ') || chr(10) || ' + repr('Target: ') + ' || target_caption'), ('assistant', 'trim(cot)'))} AS messages FROM x WHERE length(trim(cot)) > 0")
def _(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("uid"), F.lit(0).alias("split"), F.col("c_mktsegment").alias("profile"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("similar"),
        F.col("n_name").alias("target_caption"), F.when(F.col("c_custkey") % 7 == 0, F.lit("   ")).otherwise(F.concat(F.lit(" because "), "c_name")).alias("cot"),
    )
    return C.sft_reason(rows)


CONV = "conv AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS messages FROM conversations GROUP BY conv_id)"


def conversations(t):
    turn = F.struct("turn", "role", F.col("text").alias("content"))
    return t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(turn)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


@query("build_rl_prompt", f"WITH {CONV} SELECT conv_id, CAST(to_json(list_transform(messages[1:len(messages)-1], lambda m: {{'role': m.role, 'content': CASE WHEN m.role = 'user' THEN m.content || '/think' ELSE m.content END}})) AS VARCHAR) AS prompt, messages[len(messages)].content AS ground_truth FROM conv")
def _(t):
    return C.rl_prompt(conversations(t), "/think").select("conv_id", F.to_json("prompt").alias("prompt"), "ground_truth")


@query("build_distill_prompt", f"WITH {CONV}, r AS (SELECT *, list_position(list_transform(messages, lambda m: m.role), 'user') AS u, list_position(list_transform(messages, lambda m: m.role), 'assistant') AS a FROM conv) SELECT conv_id, CAST(to_json(messages[1:greatest(u, a)]) AS VARCHAR) AS prompt FROM r WHERE u > 0 AND a > 0")
def _(t):
    return conversations(t).select("conv_id", F.to_json(T.until_first_exchange(F.col("messages"))).alias("prompt")).where("prompt IS NOT NULL")


@query("build_think_tags", f"WITH {CONV} SELECT conv_id, CAST(to_json(list_transform(messages, lambda m, i: {{'role': m.role, 'content': CASE WHEN m.role = 'user' AND messages[i+1].role = 'assistant' THEN m.content || '/no_think' WHEN m.role = 'assistant' THEN '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || m.content ELSE m.content END}})) AS VARCHAR) AS messages FROM conv")
def _(t):
    return conversations(t).select("conv_id", F.to_json(T.think_switches(F.col("messages"))).alias("messages"))


@query("fn_inject_prepend", f"WITH {CONV} SELECT conv_id, CAST(to_json(CASE WHEN messages[len(messages)].role = 'user' THEN list_append(messages[1:len(messages)-1], {{'role': 'user', 'content': 'Similar users follow.' || chr(10) || messages[len(messages)].content}}) ELSE messages END) AS VARCHAR) AS messages FROM conv")
def _(t):
    return conversations(t).select("conv_id", F.to_json(T.with_prefix_on_last_user(F.col("messages"), F.lit("Similar users follow.\n"))).alias("messages"))


@query("build_convert_messages", "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS content FROM conversations GROUP BY conv_id")
def _(t):
    part = F.struct("turn", F.lit("text").alias("type"), F.col("text").alias("text"))
    return t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("p")).select("conv_id", T.joined_content(F.col("p")).alias("content"))


#: Turns of conversations as plain text, a part, a list of parts and texts, broken JSON, and an object that is no part.
CONTENT = "SELECT conv_id, turn, CASE (conv_id * 3 + turn) % 6 WHEN 3 THEN '[' || text WHEN 4 THEN NULL WHEN 5 THEN '42' ELSE coalesce(text, '') END AS said FROM conversations"


@query("build_any_content", CONTENT)
def _(t):
    text, k = F.coalesce("text", F.lit("")), (F.col("conv_id") * 3 + F.col("turn")) % 6
    half = F.floor(F.length(text) / 2).cast("int")
    piece = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    listed = F.concat(F.lit('[{"type": "image", "image": "x"}, {"type": "text", "text": '), piece(F.substr(text, F.lit(1), half)), F.lit("}, "), piece(F.substr(text, half + 1)), F.lit("]"))
    raw = F.when(k == 1, F.concat(F.lit('{"type": "text", "text": '), piece(text), F.lit("}"))).when(k == 2, listed).when(k == 3, F.concat(F.lit("["), F.col("text"))).when(k == 4, F.lit('{"type": "image"}')).when(k == 5, F.lit("42")).otherwise(text)
    return t.conversations.select("conv_id", "turn", T.content_text(raw).alias("said"))


@query("build_loader_sample", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS answer FROM events WHERE event_type IS NOT NULL AND length(trim(coalesce(json_extract_string(props, '$.k'), ''))) > 0")
def _(t):
    answer = F.trim(F.get_json_object("props", "$.k"))
    return t.events.where(F.col("event_type").isNotNull() & T.nonblank(answer)).select("event_id", answer.alias("answer"))


@query("build_rl_canonical", "SELECT 'nations' AS data_source, n_name AS question, 'lookup' AS ability, r_name AS ground_truth, row_number() OVER (ORDER BY n_name) - 1 AS index FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    out = C.rl_canonical(rows, "nations", "n_name", "r_name", "lookup", "train", "n_name")
    return out.select("data_source", F.col("prompt")[0]["content"].alias("question"), "ability", "reward_model.ground_truth", "extra_info.index")


@query("build_search_qa", "SELECT doc_id, 'search_' || source AS data_source, coalesce(lang, 'none') AS golden FROM documents")
def _(t):
    return t.documents.select("doc_id", F.concat(F.lit("search_"), "source").alias("data_source"), F.coalesce("lang", F.lit("none")).alias("golden"))


@query("build_pairs", "SELECT o_custkey AS prompt, 1 AS label, o_orderstatus AS answer FROM orders UNION ALL SELECT o_custkey, 0, o_orderpriority FROM orders")
def _(t):
    return C.preference_pairs(t.orders.select(F.col("o_custkey").alias("prompt"), F.col("o_orderstatus").alias("chosen"), F.col("o_orderpriority").alias("rejected")))


@query("build_multiple_choice", "SELECT p_partkey, trim(regexp_replace(regexp_replace(p_name, '\\[.*?\\]', '', 'g'), '\\s+', ' ', 'g')) AS query, [p_brand, p_type] AS choices, CAST(p_size % 2 AS INT) AS gold FROM part")
def _(t):
    clean = F.trim(F.regexp_replace(F.regexp_replace("p_name", r"\[.*?\]", ""), r"\s+", " "))
    return t.part.select("p_partkey", clean.alias("query"), F.array("p_brand", "p_type").alias("choices"), (F.col("p_size") % 2).cast("int").alias("gold"))


@query(
    "build_shuffle_choices",
    "WITH w AS (SELECT p_partkey, p_brand AS gold, [p_type, p_name, 'none'] AS wrong FROM part), o AS (SELECT p_partkey, unnest(wrong) AS x, md5('42|' || p_partkey || '|' || unnest(range(3))) AS h FROM w), l AS (SELECT p_partkey, list(x ORDER BY h, x) AS xs FROM o GROUP BY p_partkey), "
    f"g AS (SELECT p_partkey, gold, xs, CAST({V.draw(chr(39) + '42|' + chr(39) + ' || p_partkey || ' + chr(39) + '|gold' + chr(39), 4)} AS INT) AS place FROM l JOIN w USING (p_partkey)) SELECT p_partkey, array_to_string(list_concat(list_append(xs[1:place], gold), xs[place+1:]), '#') AS choices, chr(65 + place) AS letter FROM g",
)
def _(t):
    rows = t.part.select("p_partkey", F.col("p_brand").alias("gold"), F.array("p_type", "p_name", F.lit("none")).alias("wrong"))
    return C.shuffled_choices(rows, "p_partkey").select("p_partkey", F.array_join("choices", "#").alias("choices"), "letter")


@query("build_synthetic", "WITH n AS (SELECT row_number() OVER () - 1 AS i FROM customer), c AS (SELECT i AS id, string_agg(chr(CAST(97 + CAST(('0x' || substr(md5('42|' || i || ':' || j || '|char'), 1, 8)) AS BIGINT) % 6 AS INT)), '' ORDER BY j) AS word FROM n, range(1, 6) u(j) GROUP BY i) SELECT id, word, word[1] AS letter, CAST(length(word) - length(replace(word, word[1], '')) AS BIGINT) AS answer FROM c")
def _(t):
    """As many samples as there are customers."""
    return C.char_count_samples(t.customer.count(), t.spark).select("id", "word", "letter", "answer")


@query("build_coalesce_chain", "SELECT doc_id, coalesce(nullif(source, 'src0'), nullif(lang, ''), '') AS truth FROM documents")
def _(t):
    return t.documents.select("doc_id", T.first_nonempty(F.nullif("source", F.lit("src0")), F.col("lang")).alias("truth"))


@query("join_lookup_array", f"WITH {V.INTER}, {V.CODES}, {V.found('h', 'hist_pid')} SELECT uid, h_s AS codes FROM h")
def _(t):
    return L.lookup_arrays(V.interactions(t), "uid", {"h": F.col("hist_pid")}, V.codes(t), "pid", "code").select("uid", F.array_join("h", "").alias("codes"))


@query("join_lookup_scalar", f"WITH {V.CODES} SELECT l_orderkey, l_linenumber, l_partkey AS pid, coalesce(code, '') AS code FROM lineitem LEFT JOIN codes ON pid = l_partkey")
def _(t):
    return L.lookup_scalar(t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("pid")), "pid", V.codes(t), "pid", "code", "code")


@query("join_two_domains", f"WITH {V.CODES}, {V.GOODS} SELECT l_orderkey, l_linenumber, codes.code AS video, goods.code AS product FROM lineitem JOIN codes ON codes.pid = l_partkey JOIN goods ON goods.pid = l_suppkey")
def _(t):
    v, g = V.codes(t).select(F.col("pid").alias("l_partkey"), F.col("code").alias("video")), V.goods_codes(t).select(F.col("pid").alias("l_suppkey"), F.col("code").alias("product"))
    return t.lineitem.join(v, "l_partkey").join(g, "l_suppkey").select("l_orderkey", "l_linenumber", "video", "product")


@query("join_semi", f"WITH {V.CODES}, {V.CAPTIONS} SELECT pid, caption FROM captions WHERE pid IN (SELECT pid FROM codes)")
def _(t):
    return V.captions(t).join(V.codes(t), "pid", "left_semi")


@query("join_anti", f"WITH {V.CODES}, {V.CAPTIONS} SELECT pid, caption FROM captions WHERE pid NOT IN (SELECT pid FROM codes)")
def _(t):
    return V.captions(t).join(V.codes(t), "pid", "left_anti")


@query("join_inner_keys", "SELECT count(*) AS shared FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)")
def _(t):
    return t.documents.select("doc_id").intersect(t.labels.select("doc_id")).agg(F.count("*").alias("shared"))


@query("join_prefix_level", "WITH x AS (SELECT l_orderkey, (l_partkey % 8)*67108864 + (l_suppkey % 4)*8192 + l_linenumber AS p FROM lineitem), y AS (SELECT l_orderkey, list(p ORDER BY p) AS ps FROM x GROUP BY l_orderkey), z AS (SELECT l_orderkey, unnest(ps) AS p, ps[len(ps)] AS t FROM y) SELECT l_orderkey, round(avg(CASE WHEN p = t THEN 100 WHEN p // 8192 = t // 8192 THEN 10 WHEN p // 67108864 = t // 67108864 THEN 1 ELSE 0 END), 6) AS score FROM z GROUP BY l_orderkey")
def _(t):
    code = sid.sid_encode(F.col("l_partkey") % 8, F.col("l_suppkey") % 4, F.col("l_linenumber"))
    rows = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(code)).alias("p"))
    return rows.select("l_orderkey", F.round(sid.partial_hit(F.col("p"), F.array(F.element_at("p", -1))), 6).alias("score"))


@query("join_self_multimap", "SELECT l_suppkey AS sid, arg_max(l_partkey, (n, -l_partkey)) AS pid FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_suppkey")
def _(t):
    counted = t.lineitem.groupBy(F.col("l_suppkey").alias("sid"), F.col("l_partkey").alias("pid")).agg(F.count("*").alias("n"))
    return L.most_popular(counted, "sid", "pid", "n")
