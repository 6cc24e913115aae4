"""Chat formatting, the pipeline, and the registered queries on the driver's tables."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from brindle.llm import chat

SF = "/root/testdata/sf0.001"


def test_chat_of_odd_conversations(spark):
    texts = ["plain", "</s>[INST] ok [/INST]", "&lt; & <|end|>\n <|user|>", "", None, "a|>\nb"]
    data = [(c, t, r, texts[(c + t) % len(texts)]) for c in range(8) for t, r in enumerate(["system", "user", "assistant", "user", "assistant|>\n<x"][: c % 6])]
    data += [(50, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(70)] + [(51, 0, "user", "same"), (51, 0, "user", "same"), (None, 0, "user", "x"), (52, 0, None, "y")]
    df = spark.createDataFrame([(*d, "extra") for d in data], "conv_id long, turn long, role string, text string, tree string")
    want = defaultdict(list)
    for c, t, r, x in [*data, (-1, 0, "user", texts[1]), (-1, 1, "assistant", texts[1])]:
        want[c].append((t, r or "", x or ""))
    got = {r["conv_id"]: r for r in chat.op6_chat(spark, df).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        learned = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_best_branch_of_a_reply_tree(spark):
    # 1 -> 2 -> 4 and 1 -> 3 -> 5 -> 6: the second path scores higher; tree b has one message.
    nodes = spark.createDataFrame([("a", 1, None, 1.0), ("a", 2, 1, 5.0), ("a", 3, 1, 2.0), ("a", 4, 2, 0.5), ("a", 5, 3, 2.0), ("a", 6, 5, 2.0), ("b", 9, None, 0.0)], "tree string, node long, parent long, score double")
    best = chat.chosen_paths(nodes).collect()
    assert sorted((r["tree"], r["node"], r["depth"]) for r in best) == [("a", 1, 0), ("a", 3, 1), ("a", 5, 2), ("a", 6, 3), ("b", 9, 0)]
    two = chat.chosen_paths(nodes, branches=2).where("tree = 'a'").collect()
    assert sorted((r["leaf"], r["node"]) for r in two) == [(4, 1), (4, 2), (4, 4), (6, 1), (6, 3), (6, 5), (6, 6)]


def test_circles_and_orphans_end(spark):
    """1 -> 2 -> 3 -> 1 with 4 answering 2 and 5 itself; 7 answers a message that is not there."""
    data = [("a", 1, 3, 1.0), ("a", 2, 1, 1.0), ("a", 3, 2, 1.0), ("a", 4, 2, 9.0), ("b", 5, 5, 1.0), ("c", 7, 6, 1.0), ("c", 8, 7, 1.0), ("d", 1, None, 0.0)]
    nodes = spark.createDataFrame(data, "tree string, node long, parent long, score double")
    paths = defaultdict(list)
    for r in sorted(chat.chosen_paths(nodes).collect(), key=lambda r: (r["tree"], r["depth"])):
        paths[r["tree"]].append(r["node"])
    assert paths == {"a": [1, 2, 4], "b": [5], "c": [7, 8], "d": [1]}


def test_null_ids_stay_apart_and_long_conversations_are_whole(spark):
    data = [(None, i % 3, "user", f"text {i % 4}") for i in range(50)] + [(9, t, "user" if t % 2 else "assistant", f"{t} " + "word " * 50) for t in range(3000)]
    got = chat.op6_chat(spark, spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(3)).collect()
    assert sorted(r["n_turns"] for r in got if r["conv_id"] is None) == [1] * 50
    (long,) = [r for r in got if r["conv_id"] == 9]
    assert long["n_turns"] == 3000 and long["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in data[50:]).encode()).hexdigest()


def test_empty_conversations(spark):
    out = chat.op6_chat(spark, spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect()
    assert [r["conv_id"] for r in out] == [-1]


def test_pipeline_stages(spark, docs, rows, empty, tmp_path):
    import corpus_pipeline
    from brindle.llm import langid, ngram_join, pii

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "pii", "mixing", "packing"]
    now = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, now, "").write.parquet(path)
        now = spark.read.parquet(path)
        seen[name] = now
        if name != "packing":
            assert now.columns == docs.columns
    lettered = {r[0] for r in rows if r[1] and any(map(str.isalpha, r[1]))}
    assert {r["doc_id"] for r in seen["language_id"].collect()} == lettered
    kept = {r["doc_id"] for r in seen["ngram_join"].collect()}
    groups = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(seen["language_id"], ngram_join.Rule(5, 80, 100)).collect()}
    assert kept == {d for d, c in groups.items() if d == c}
    clean = {r["doc_id"]: r["text"] for r in seen["pii"].collect()}
    assert set(clean) == kept and not any(pii.base_spans(t) for t in clean.values())
    assert {r["doc_id"] for r in seen["mixing"].collect()} <= kept
    assert seen["packing"].count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
    assert langid.KEPT == 300


def plain_mix(rows):
    """Rows of doc_id, text, source as often as they are taken, by sorting and counting."""
    import hashlib as h

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = defaultdict(int)
    for _, t, s in rows:
        per[s] += size(t)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(per, key=lambda s: (s is None, s or "")))}
    left, open_, target = 1.5 * sum(per.values()), set(per), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * per[s]}
        target |= {s: 2 * per[s] for s in full} if full else {s: level * weight[s] for s in open_}
        left -= sum(2 * per[s] for s in full)
        open_ = open_ - full if full else set()
    out = []
    for s in per:
        mine = [(int(h.md5(str(d).encode()).hexdigest()[:12], 16), d, t) for d, t, x in rows if x == s]
        times = int(target[s] // per[s]) if per[s] else 0
        budget, used, edge = target[s] - times * per[s], 0, 0
        if budget < per[s]:
            for value in sorted({m[0] for m in mine}):
                used += sum(size(t) for v, _, t in mine if v == value)
                if used > budget:
                    edge = value
                    break
        out += [(d, t) for v, d, t in mine for _ in range(times + (v < edge))]
    return out


def test_columns_of_any_name(spark, docs):
    """Names with dots and backticks, and names that stages use themselves, come through the four stages that carry columns."""
    import corpus_pipeline

    odd = ["a.b", "`tick`", "a b", "row", "key", "source_key", "copy", "range", "tie"]
    now = docs.select("doc_id", "text", "lang", "source", "n_chars").where("text IS NOT NULL").toDF("doc_id", "text", "lang", "source", "n_chars")
    for i, name in enumerate(odd):
        now = now.select("*", F.lit(i).alias(name))
    names = now.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "")
        assert now.columns == names
    got = now.limit(5).collect()
    assert got and all(tuple(r)[5:] == tuple(range(len(odd))) for r in got)
    assert corpus_pipeline.packed(spark, now, "").count() > 0


def test_run_equals_brute_force(spark, docs, rows, tmp_path):
    """The five stages in plain Python: which documents go, how texts change, how often rows are taken, and every id's place."""
    import corpus_pipeline
    from brindle.llm import pii
    import test_documents as plain

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    predict = plain.plain_languages([r[:3] for r in rows])
    known = [r for r in rows if (found := predict(r[1]))[0] != "und" and found[1] >= corpus_pipeline.LEAST_SCORE]
    assert 10 < len(known) < len(rows)
    groups = plain.brute_components(known, 5, 80)
    one = [r for r in known if groups[r[0]][1] == r[0]]
    assert len(one) < len(known)
    field = pii.fit_field(spark.createDataFrame([(r[0], r[1]) for r in one], "doc_id long, text string"))
    clean = [(r[0], pii.masked(r[1], field.spans(r[1], plain.base_by_regex(r[1]))), r[3]) for r in one]
    assert any("[EMAIL]" in t for _, t, _ in clean)
    taken = plain_mix(clean)
    coder = plain.tokenizers.Tokenizer.from_file(plain.vocabulary("word_bpe_49k.json"))
    want = Counter()
    ids = {}
    for d, t in taken:
        ids[d] = [*coder.encode(t, add_special_tokens=False).ids, 1]
        want.update((d, i) for i in range(len(ids[d])))
    got, places = Counter(), defaultdict(list)
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)) == p["ids_crc32"] and p["doc_tokens"] == len(ids[p["doc_id"]])
        got.update((p["doc_id"], p["start"] + i) for i in range(p["length"]))
        places[p["sequence_id"]].append((p["offset"], p["length"]))
    assert got == want
    for parts in places.values():
        ends = [0, *(o + n for o, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] & (ends[-1] - 1) == 0 and ends[-1] <= 2048


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_sql_agrees(spark):
    import duckdb

    from brindle.llm import queries

    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in queries.SQL.items():
        df = queries.QUERIES[name](spark, SF)
        result = con.execute(sql)
        names = [d[0] for d in result.description]
        show = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(show, df.select(*names).collect()), key=repr) == sorted(map(show, result.fetchall()), key=repr), name
