"""DuckDB SQL for the operators that SQL can express, written from the contracts and not from the operators."""

from __future__ import annotations

from brindle.llm import licenses

SPACE = "[ \\t\\n\\x0b\\x0c\\r]+"
WORDS = f"list_filter(string_split_regex({{}}, '{SPACE}'), lambda w: w <> '')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 3, least(len(ws), 1)) + 1), lambda i: array_to_string(ws[i:i+3], ' '))) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.a = w.doc_id"""

OP5 = f"""WITH d AS (SELECT doc_id, source, len({WORDS.format("coalesce(text, '')")}) AS size, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) AS h FROM documents),
s AS (SELECT source, sum(size) AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
f AS (SELECT *, 2.0 * source_size AS cap, (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS level FROM s WINDOW p AS (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT min_by(level, cap / weight) FILTER (level * weight <= cap) AS water FROM f),
t AS (SELECT source, source_size, CAST(coalesce(least(cap, water * weight), cap) AS DOUBLE) AS target FROM f, k),
b AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times, sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, CAST(size * (times + CASE WHEN times * source_size < target AND upto <= target - times * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM b"""

SAFE = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"
OP6 = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', NULL UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', NULL)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(length({SAFE.format('text')}) + length(replace({SAFE.format('role')}, '|', '&#124;')) + 13) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id, alone"""

BRANCHES = """WITH c AS (SELECT CAST(floor(conv_id / 4) AS BIGINT) AS tree, conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY CAST(floor(conv_id / 4) AS BIGINT) ORDER BY conv_id, turn NULLS FIRST, role, text) AS node FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, conv_id = min(conv_id) OVER (PARTITION BY tree) AS trunk, count(*) OVER (PARTITION BY tree, conv_id) AS n FROM c),
p AS (SELECT n.tree, n.conv_id, r.node, r.role, r.text FROM n JOIN c r ON r.tree = n.tree AND (r.conv_id = n.conv_id OR r.node = 1) GROUP BY ALL),
b AS (SELECT p.tree, p.conv_id, max(p.node) AS leaf, count(*) AS n_turns, sum(floor(length(p.text) / 16)) AS score, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY node)) AS turns_sha256 FROM p GROUP BY ALL),
a AS (SELECT b.*, row_number() OVER (PARTITION BY b.tree ORDER BY score DESC, n_turns DESC, leaf) AS place FROM b JOIN (SELECT tree, conv_id, bool_and(trunk) AS trunk, min(n) AS n FROM n GROUP BY ALL) USING (tree, conv_id)
WHERE NOT (trunk AND n = 1 AND (SELECT count(DISTINCT m.conv_id) FROM n m WHERE m.tree = b.tree) > 1))
SELECT tree, leaf, n_turns, turns_sha256 FROM a WHERE place <= 2"""

OP10 = f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
e AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w), g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i+7], ' ')) AS n FROM e),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM g, range(8) t(j) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
u AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE length(regexp_replace(line, '{SPACE}', '', 'g')) > 0 GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(text, '{SPACE}', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, length(text) - length(regexp_replace(text, '\\p{{L}}+', '', 'g')) AS n_letters
FROM w LEFT JOIN u USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, CAST(n_words < 20 AS BIGINT) + CAST(100 * n_repeat_words > 30 * n_words AS BIGINT) * 2 + CAST(10 * n_symbols > 6 * n_words AS BIGINT) * 4 + CAST(n_dup_lines > 4 AND 10 * n_dup_lines > 5 * n_lines AS BIGINT) * 8
+ CAST(n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) AS BIGINT) * 16 + CAST(n_letters = 0 AS BIGINT) * 32 AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM f"""

RULES = [("v1", 0, "too_short", 3), ("v1", 1, "repeats_itself", 3)] + [("v2", i, r, 63) for i, r in enumerate(("too_short", "repeats_itself", "symbols", "repeated_lines", "odd_word_length", "no_letters"))]
ABLATIONS = f"""WITH q AS ({OP10}), t(version, bit, rule, mask) AS (VALUES {", ".join(f"('{v}', {1 << i}, '{r}', {m})" for v, i, r, m in RULES)})
SELECT version, rule, count(*) FILTER (failed & bit <> 0) AS fails, count(*) FILTER (failed & mask = bit) AS only, count(*) FILTER (failed & mask <> 0) AS removed FROM t LEFT JOIN q ON true GROUP BY ALL"""

CRC = "list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
OP12 = f"""WITH RECURSIVE z AS (SELECT {CRC} AS crc),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT o.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fate FROM o, z),
d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]+', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE fate <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, left(role, 1) AS x, regexp_replace(text, '{SPACE}', '', 'g') AS solid FROM d),
e AS (SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(x) OVER (PARTITION BY conv_id ORDER BY i) || x AS pair FROM p),
s AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM e GROUP BY conv_id),
ins(g, g1, added) AS (VALUES (0, 0, ''), (1, 1, ''), (2, 2, ''), (3, 3, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 2, 'I'), (1, 3, 'II'), (2, 3, 'I'), (3, 2, 'I')),
arc(g1, g2, x, label, price) AS (VALUES (0, 1, 's', 'K', 0), (0, 2, 'u', 'K', 0), (1, 2, 'u', 'K', 0), (2, 3, 'a', 'K', 0), (3, 2, 'u', 'K', 0), (0, 2, NULL, 'R', 1), (1, 2, NULL, 'R', 1), (2, 3, NULL, 'R', 1), (3, 2, NULL, 'R', 1), (0, 0, NULL, 'D', 2), (1, 1, NULL, 'D', 2), (2, 2, NULL, 'D', 2), (3, 3, NULL, 'D', 2)),
w AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS g, {{'c': 0, 'a': ''}} AS best FROM o
UNION ALL SELECT w.conv_id, e.i, arc.g2, min({{'c': best.c + 5 * length(added) + price + CASE WHEN fault = 'truncated' AND label <> 'D' THEN 5 ELSE 0 END, 'a': best.a || added || label}})
FROM w JOIN e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 JOIN ins USING (g) JOIN arc ON arc.g1 = ins.g1 AND coalesce(arc.x, e.x) = e.x AND (label = 'D' OR fault NOT IN ('blank', 'duplicate')) GROUP BY w.conv_id, e.i, arc.g2),
b AS (SELECT w.conv_id, min({{'c': best.c + 5 * length(added), 'a': best.a || added}}) AS best FROM w LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id JOIN ins USING (g) WHERE w.i = coalesce(n, 0) AND g1 IN (0, 3) GROUP BY w.conv_id),
l AS (SELECT conv_id, unnest(string_split(best.a, '')) AS label, unnest(range(length(best.a))) AS k FROM b WHERE best.a <> ''),
m AS (SELECT *, sum(CAST(label <> 'I' AS INT)) OVER (PARTITION BY conv_id ORDER BY k) AS i FROM l),
q AS (SELECT m.conv_id, m.k, label, e.role, CASE WHEN label = 'I' THEN '' ELSE text END AS text, sum(CAST(label <> 'K' OR x <> 's' AS INT)) OVER (PARTITION BY m.conv_id ORDER BY m.k) AS said FROM m LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM m.conv_id AND e.i = m.i WHERE label <> 'D'),
t AS (SELECT conv_id, string_agg(CASE WHEN label = 'K' THEN role WHEN said % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS said FROM q GROUP BY conv_id)
SELECT b.conv_id, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))}, CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM b LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM b.conv_id"""

OP13 = f"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT) + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text) AS INT)
+ 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false) AS INT) AS failed, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM t LEFT JOIN l USING (doc_id)),
c AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),
f(x, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT f.x || g.x || h.x || i.x || j.x AS filter_order, [f.b, g.b, h.b, i.b, j.b] AS bits FROM f, f g, f h, f i, f j WHERE f.b | g.b | h.b | i.b | j.b = 31),
s AS (SELECT filter_order, k AS step, substr(filter_order, k, 1) AS x, bits[k] AS bit, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS INT) AS ahead FROM o, range(1, 6) r(k)),
r AS (SELECT part, filter_order, step, x, sum(n) FILTER (failed & (ahead | bit) = 0) AS kept, sum(n) FILTER (failed & ahead = 0 AND failed & bit <> 0) AS removed, sum(n) FILTER (failed & ahead <> 0 AND failed & bit <> 0) AS redundant,
sum(n) FILTER (failed = bit) AS unique_fails, sum(good) FILTER (failed & ahead = 0 AND failed & bit <> 0) AS good_lost, sum(toxic) FILTER (failed & ahead = 0 AND failed & bit <> 0) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, {", ".join(f"CAST(coalesce({x}, 0) AS BIGINT) AS {x}" for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
CAST(coalesce(sum(removed) OVER (PARTITION BY part, x), 0) AS BIGINT) AS shapley FROM r"""

def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


#: Every notice is tried at every place of its first phrase.
NOTICES = [(i, label, words, phrases) for i, (label, words, phrases) in enumerate(licenses.library())]
PHRASES = [(i, k, p, next(j for j in range(len(words)) if words[j : j + len(p)] == p)) for i, _, words, phrases in NOTICES for k, p in enumerate(phrases)]
OP11 = f"""WITH t(notice, label, words, parts, base) AS (VALUES {", ".join(f"({i}, '{label}', {_list(words)}, {len(phrases)}, {i < len(licenses.BASE)})" for i, label, words, phrases in NOTICES)}),
q(notice, k, phrase, place) AS (VALUES {", ".join(f"({i}, {k}, {_list(p)}, {at})" for i, k, p, at in PHRASES)}),
w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex({LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws FROM documents),
v AS (SELECT DISTINCT unnest(words) AS word FROM t), d AS (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(ws)) AS word FROM w) SEMI JOIN v USING (word) GROUP BY word),
i AS (SELECT word, ln(1 + (SELECT count(*) FROM w) / (coalesce(df, 0) + 1)) AS weight FROM v LEFT JOIN d USING (word)),
h AS (SELECT r, notice, k, unnest(list_transform(list_filter(range(0, len(ws) - len(phrase) + 1), lambda i: ws[i + 1:i + len(phrase)] = phrase), lambda i: i - place)) AS s FROM w, q WHERE list_has_all(ws, phrase)),
o AS (SELECT l.r, l.notice, l.s FROM h l JOIN h ON h.r = l.r AND h.notice = l.notice AND abs(h.s - l.s) <= {licenses.SLACK} JOIN t ON t.notice = l.notice WHERE l.k = 0 GROUP BY l.r, l.notice, l.s, parts HAVING count(DISTINCT h.k) = parts),
x AS (SELECT notice, label, base, len(words) AS size, unnest(list_distinct(words)) AS word FROM t),
c AS (SELECT r, notice, label, base, s, round(coalesce(sum(weight) FILTER (list_contains(ws[greatest(s - {licenses.SLACK}, 0) + 1:greatest(s - {licenses.SLACK}, 0) + size + {2 * licenses.SLACK}], word)), 0) / sum(weight), 6) AS score FROM o JOIN w USING (r) JOIN x USING (notice) JOIN i USING (word) GROUP BY ALL),
f AS (SELECT * FROM c WHERE score >= {licenses.COVERED})
SELECT doc_id, len(ws) AS n_words, count(s) FILTER (base) AS n_base, CAST(min(s) FILTER (base) AS BIGINT) AS first_word, CAST(max(s) FILTER (base) AS BIGINT) AS last_word,
coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(score), 0.0) AS score FROM w LEFT JOIN f USING (r) GROUP BY r, doc_id, ws"""

SQL = {"op11_licenses": OP11, "chat_branches": BRANCHES, "op12_repair": OP12, "op13_filter_audit": OP13, "quality_ablations": ABLATIONS, "op2_ngram_join": OP2, "op5_mixing": OP5, "op6_chat": OP6, "op10_quality": OP10}
