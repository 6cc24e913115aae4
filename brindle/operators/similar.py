"""Similar users by token overlap, lexical top-k by BM25, dense top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from brindle.operators.batch import with_running
from brindle.session import scratch


def overlaps(tokens: DataFrame, queries: DataFrame, pool: int | None = 1000, other: bool = True, block: int = 1 << 20, best: tuple | None = None) -> DataFrame:
    """query, candidate, overlap, nq, nc: for a stated query set, the `pool` users of all with the largest token overlap, or all that share a token if pool is None.

    tokens and queries have (uid, token), repeats allowed. Each user's distinct tokens become one row, once. Queries are dealt to
    parts of about `block` / 16 tokens; a token's list of users goes to each part that asks for it, where all pairs of its queries are
    counted. The work is then that of the pairs. Where tokens are so hot that lists would be sent to many parts, or pairs not
    fit a part, queries go out one block at a time, of about `block` tokens at most, as inverted lists; a task counts the overlaps
    of its users with the block and keeps `pool` a query. The pairs of a token are never rows. Ties go to the smaller id.
    `best` (k, least score, recall and score to stay below) allows leaving out what `similar_users` would.
    """
    spark = tokens.sparkSession
    # A fixed number of partitions: coalesced by their few bytes, the counting below would have few tasks.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def listed(df: DataFrame) -> DataFrame:
        named = df.select(F.col("uid").cast("long").alias("uid"), F.col("token").cast("string").alias("token")).where("token IS NOT NULL")
        return named.repartition(parts, "uid").groupBy("uid").agg(F.collect_set("token").alias("tokens"))

    path, schema = scratch(spark, "overlaps"), "query long, candidate long, overlap long, nq int, nc int"
    for name, df in (("users", tokens), ("queries", queries)):
        listed(df).write.parquet(f"{path}/{name}")
    users, asked = spark.read.parquet(f"{path}/users"), spark.read.parquet(f"{path}/queries")
    if n := _parts(users, asked, parts, block):
        return _listed_pairs(users, asked, n).mapInArrow(_counting(pool, other, best), schema)
    for at, held in enumerate(_blocks(asked, "uid", block, F.size("tokens"))):
        met = users.mapInArrow(_overlapping([r["uid"] for r in held], [r["tokens"] for r in held], pool, other), schema)
        met.write.parquet(f"{path}/met/block={at}")
    first = F.row_number().over(Window.partitionBy("query").orderBy(F.col("overlap").desc(), "candidate"))
    every = spark.read.schema(schema).parquet(f"{path}/met").select("query", "candidate", "overlap", "nq", "nc")
    if pool is None:
        return every
    return every.withColumn("_p", first).where(F.col("_p") <= pool).drop("_p")


def _parts(users: DataFrame, queries: DataFrame, least: int, block: int, copies: int = 64, pairs: int = 128) -> int | None:
    """The number of parts of queries, or None if lists would be sent more than `copies` times, or hold more than the tokens of a block, or a part count more than `pairs` pairs a token."""
    per = lambda df, name: df.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias(name))
    asked = queries.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("n")).first()["n"]
    n = max(least, -(-asked * 16 // block))
    found = per(users, "c").join(per(queries, "q"), "token").agg(F.sum(F.col("c") * F.least("q", F.lit(n))).alias("sent"), F.sum("c").alias("held"), F.max("c").alias("longest"), F.sum(F.col("c") * F.col("q")).alias("pairs")).first()
    if found["held"] is None:
        return n
    return n if found["sent"] <= copies * found["held"] and found["longest"] <= block and found["pairs"] <= pairs * n * (block // 16) else None


def _listed_pairs(users: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """part, q, c: per part and token its queries and users with their numbers of tokens; sorted by part."""
    who = F.struct(F.col("uid").alias("id"), F.size("tokens").alias("n")).alias("who")
    q = queries.select(F.pmod(F.hash("uid"), F.lit(n)).alias("part"), who, F.explode("tokens").alias("token")).groupBy("part", "token").agg(F.collect_list("who").alias("q"))
    c = users.select(who, F.explode("tokens").alias("token")).groupBy("token").agg(F.collect_list("who").alias("c"))
    return q.join(c, "token").select("part", "q", "c").repartition(n, "part").sortWithinPartitions("part")


def _counting(pool: int | None, other: bool, best: tuple | None, most: int = 1 << 22):
    """The overlaps of each part's queries, of which a task holds one part at a time. A step expands about `most` pairs and one list."""

    def sides(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = lists.flatten()
        return np.diff(np.asarray(lists.offsets)).astype(np.int64), np.asarray(flat.field(0)), np.asarray(flat.field(1))

    def counted(rows: list[tuple[pa.ListArray, pa.ListArray]]) -> pa.RecordBatch:
        (many, q, nq), (long, c, nc) = ([np.concatenate(x) for x in zip(*[sides(r[i]) for r in rows], strict=True)] for i in range(2))
        (qs, first_q, q), (cs, first_c, c) = (np.unique(x, return_index=True, return_inverse=True) for x in (q, c))
        nq, nc = nq[first_q], nc[first_c]
        row = np.repeat(np.arange(len(many)), many)
        times, start = long[row], (np.cumsum(long) - long)[row]
        found = []
        for step in np.split(np.arange(len(q)), np.flatnonzero(np.diff(np.cumsum(times) // most)) + 1):
            n = times[step]
            ends = np.cumsum(n)
            users = c[np.repeat(start[step] - ends + n, n) + np.arange(ends[-1])]
            found.append(np.unique(np.repeat(q[step], n) * len(cs) + users, return_counts=True))
        pair, o = found[0]
        if len(found) > 1:
            pair, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
            o = np.bincount(at, np.concatenate([f[1] for f in found])).astype(np.int64)
        q, c = pair // len(cs), pair % len(cs)
        if other:
            keep = qs[q] != cs[c]
            q, c, o = q[keep], c[keep], o[keep]
        if pool is not None and len(q) and np.bincount(q).max() > pool:
            by = np.lexsort((c, -o, q))
            by = by[_places(q[by]) < pool]
            q, c, o = q[by], c[by], o[by]
        if best is not None:
            q, c, o = leading(q, c, o, nq, nc)
        return pa.RecordBatch.from_arrays([pa.array(qs[q]), pa.array(cs[c]), pa.array(o.astype(np.int64)), pa.array(nq[q]), pa.array(nc[c])], names=["query", "candidate", "overlap", "nq", "nc"])

    def leading(q: np.ndarray, c: np.ndarray, o: np.ndarray, nq: np.ndarray, nc: np.ndarray) -> list[np.ndarray]:
        """The rows with one of the k largest scores of a query, of those that pass; rows come by query."""
        k, min_score, max_recall, max_score = best
        score = o / (nq[q] + nc[c] - o)
        keep = score >= min_score
        if max_recall is not None:
            keep &= o / nq[q] < max_recall
        if max_score is not None:
            keep &= score < max_score
        q, c, o, score = q[keep], c[keep], o[keep], score[keep]
        if not len(q):
            return [q, c, o]
        starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        sizes = np.diff(np.append(starts, len(q)))
        rest, edge = score.copy(), np.zeros(0)
        for _ in range(k):
            edge = np.repeat(np.maximum.reduceat(rest, starts), sizes)
            rest[rest == edge] = -np.inf
        keep = score >= edge
        return [q[keep], c[keep], o[keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []
        for batch in batches:
            named = np.asarray(batch.column(0))
            for at in np.split(np.arange(len(named)), np.flatnonzero(np.diff(named)) + 1) if len(named) else []:
                if named[at[0]] != part and rows:
                    yield counted(rows)
                    rows = []
                part = named[at[0]]
                # Copied, as a slice would hold the whole batch and its offsets start elsewhere.
                held = batch.take(pa.array(at))
                rows.append((held.column(1), held.column(2)))
        if rows:
            yield counted(rows)

    return run


def _places(groups: np.ndarray) -> np.ndarray:
    """The place from 0 of each row in its run of equal groups."""
    at = np.arange(len(groups))
    return at - np.maximum.accumulate(np.where(np.concatenate([[True], groups[1:] != groups[:-1]]), at, 0)) if len(groups) else at


def _blocks(queries: DataFrame, key: str, block: int, weight: Column | None = None) -> Iterator[list[Row]]:
    """A stated query set in lists that weigh at most `block` and one row; only one is held at a time. Without queries, one empty list."""
    placed = with_running(queries, [key], F.lit(1) if weight is None else weight, "_ahead").withColumn("_block", F.floor(F.col("_ahead") / block))
    last = placed.agg(F.max("_block").alias("n")).first()["n"]
    if last is None:
        yield []
    for at in range(0, -1 if last is None else last + 1):
        if held := placed.where(F.col("_block") == at).collect():
            yield held


def _overlapping(ids: list[int], tokens: list[list[str]], pool: int | None, other: bool, most: int = 1 << 20):
    """The `pool` largest overlaps of each query among a task's users. A step expands about `most` list entries and four times as many pairs at most."""
    sizes = np.array([len(x) for x in tokens], np.int64)
    flat = pa.array([x for y in tokens for x in y], pa.string()).dictionary_encode()
    names, codes = flat.dictionary, np.asarray(flat.indices)
    order = np.argsort(codes, kind="stable")
    owner = np.repeat(np.arange(len(ids)), sizes)[order]
    counts = np.bincount(codes, minlength=len(names)).astype(np.int64)
    starts, ids = np.cumsum(counts) - counts, np.array(ids, np.int64)

    def pruned(rows: list[np.ndarray]) -> list[np.ndarray]:
        q, c, o, n = (np.concatenate([r[i] for r in rows]) for i in range(4))
        if pool is None:
            return [q, c, o, n]
        by = np.lexsort((c, -o, q))
        q, c, o, n = q[by], c[by], o[by], n[by]
        keep = _places(q) < pool
        return [q[keep], c[keep], o[keep], n[keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(ids):
            return
        rows: list[list[np.ndarray]] = []
        held, edge = 0, 2 * most

        def gathered() -> pa.RecordBatch:
            q, c, o, n = pruned(rows)
            arrays = [pa.array(ids[q]), pa.array(c), pa.array(o.astype(np.int64)), pa.array(sizes[q].astype(np.int32)), pa.array(n.astype(np.int32))]
            return pa.RecordBatch.from_arrays(arrays, names=["query", "candidate", "overlap", "nq", "nc"])

        few = max(1, 4 * most // len(ids))

        def parts() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for b in batches:
                # Tokens are looked up once a batch: each look-up hashes all of the block's.
                flat = pc.fill_null(pc.index_in(b.column(1).flatten(), value_set=names), -1).to_numpy()
                ends = np.asarray(b.column(1).offsets) - b.column(1).offsets[0].as_py()
                for i in range(0, b.num_rows, few):
                    own = ends[i : i + few + 1]
                    yield np.asarray(b.column(0))[i : i + few], np.diff(own).astype(np.int64), flat[own[0] : own[-1]]

        for users, length, code in parts():
            of = np.repeat(np.arange(len(users)), length)[code >= 0]
            code = code[code >= 0]
            steps = np.cumsum(counts[code]) // most
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for part in np.split(np.arange(len(code)), np.flatnonzero(np.diff(steps)) + 1 if len(code) else []):
                if not len(part):
                    continue
                n = counts[code[part]]
                ends = np.cumsum(n)
                hits = owner[np.repeat(starts[code[part]] - ends + n, n) + np.arange(ends[-1])]
                found.append(np.unique(np.repeat(of[part], n) * len(ids) + hits, return_counts=True))
            if not found:
                continue
            # A user whose tokens fall into two steps has two counts with a query: they are added up.
            pair, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
            times = np.bincount(at, np.concatenate([f[1] for f in found])).astype(np.int64)
            query, user = pair % len(ids), pair // len(ids)
            keep = ids[query] != users[user] if other else np.ones(len(pair), bool)
            rows.append([query[keep], users[user][keep], times[keep], length[user][keep]])
            held += int(keep.sum())
            if held > 2 * most and pool is None:
                yield gathered()
                rows, held = [], 0
            elif held > edge:
                # Where queries have fewer than `pool` users yet, hardly anything goes: the next time is at twice the rows.
                rows = [pruned(rows)]
                held = len(rows[0][0])
                edge = 2 * max(most, held)
        if rows:
            yield gathered()

    return run


def similar_users(
    tokens: DataFrame, queries: DataFrame, k: int = 1, pool: int = 1000, min_score: float = 0.005, max_recall: float | None = 0.8, max_score: float | None = None, other: bool = True
) -> DataFrame:
    """query, candidate, overlap, score, place: Jaccard top-k over the `pool` candidates with the largest overlap.

    One operator covers every retrieval variant: the token function and history length are the caller's, the guards are
    parameters. Ties: score, overlap, then the smaller id.
    """
    scored = (
        overlaps(tokens, queries, pool, other, best=(k, min_score, max_recall, max_score))
        .withColumn("score", F.col("overlap") / (F.col("nq") + F.col("nc") - F.col("overlap")))
        .withColumn("recall", F.col("overlap") / F.col("nq"))
        .where(F.col("score") >= min_score)
    )
    if max_recall is not None:
        scored = scored.where(F.col("recall") < max_recall)
    if max_score is not None:
        scored = scored.where(F.col("score") < max_score)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("overlap").desc(), "candidate"))
    return scored.withColumn("place", place).where(F.col("place") <= k).select("query", "candidate", "overlap", "score", "place")


def bm25(docs: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query_text: str, k: int = 3, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Lexical top-k by term statistics: an exploded inverted index, joined on terms."""
    words = lambda c: F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: w != "")
    d = docs.select(F.col(key).alias("doc"), words(F.col(text)).alias("w")).withColumn("len", F.size("w"))
    tf = d.select("doc", "len", F.explode("w").alias("term")).groupBy("doc", "len", "term").agg(F.count("*").alias("tf"))
    stats = d.agg(F.count("*").alias("n"), F.avg("len").alias("avg"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    q = queries.select(F.col(query_key).alias("query"), F.explode(F.array_distinct(words(F.col(query_text)))).alias("term"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    scored = q.join(df, "term").join(tf, "term").join(F.broadcast(stats)).groupBy("query", "doc").agg(F.sum(weight).alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "doc"))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def knn(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 3, block: int = 8192) -> DataFrame:
    """query, candidate, score, place: exact dense top-k by dot product of a stated query set against all other rows.

    Queries go out one block at a time, of at most `block` rows, which bounds what the driver and a task hold. Each task
    multiplies its vectors with the block and keeps k candidates a query; a block's candidates are written before the
    next one starts, so what is shuffled in the end is k rows per query and task and never the pairs.
    Ties: the score rounded to six digits, then the smaller id.
    """
    spark = vectors.sparkSession
    path = scratch(spark, "nearest")
    schema = "query long, candidate long, score double"
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v"))
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("c"), F.col(vector).cast("array<double>").alias("v"))
    for at, held in enumerate(_blocks(asked, "q", block)):
        found = rows.mapInArrow(_nearest(np.array([r["q"] for r in held], np.int64), np.array([r["v"] for r in held], np.float64), k), schema)
        found.write.parquet(f"{path}/block={at}")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.round("score", 6).desc(), "candidate"))
    every = spark.read.schema(schema).parquet(path).select("query", "candidate", "score")
    return every.withColumn("place", place).where(F.col("place") <= k)


def _nearest(ids: np.ndarray, matrix: np.ndarray, k: int):
    """The k best candidates of each query among a task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(ids):
            return
        best, who = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                c = np.asarray(part.column(0))
                scores = matrix @ np.asarray(part.column(1).flatten(), np.float64).reshape(len(c), -1).T
                scores[ids[:, None] == c] = -np.inf
                every, names = np.concatenate([best, scores], axis=1), np.concatenate([who, np.broadcast_to(c, scores.shape)], axis=1)
                order = np.lexsort((names, -np.round(every, 6)), axis=1)[:, :k]
                best, who = np.take_along_axis(every, order, 1), np.take_along_axis(names, order, 1)
        real = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, real.sum(1))), pa.array(who[real]), pa.array(best[real])], names=["query", "candidate", "score"])

    return run
