"""Streaming operators over the driver's tables: relational ones as batches too, stateful ones as replays that drain."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brindle.plans.registry import Tables, query
from brindle.session import scratch
from brindle.streaming import stateful as S
from brindle.streaming.resume import Ledger


def replay(t: Tables, name: str):
    """A table as a finite stream; file listing rides on Spark's own source."""
    schema = getattr(t, name).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", 1).parquet(t.sf_dir)


@query("st_exactly_once", "SELECT DISTINCT event_type, user_id FROM events")
def _(t):
    return S.drained(S.exactly_once(replay(t, "events").select("event_type", "user_id"), "event_type", "user_id"), f"once_{uuid.uuid4().hex}")


@query("st_exactly_once_resume", "SELECT event_type AS file, user_id % 2 AS epoch, event_id AS index, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS run FROM events GROUP BY ALL")
def _(t):
    """A first job sees a third of all samples; a second one replays everything and gives the rest."""
    samples = replay(t, "events").select(F.col("event_type").alias("file"), (F.col("user_id") % 2).alias("epoch"), F.col("event_id").alias("index"))
    ledger = Ledger(t.spark, scratch(t.spark, "ledger"), "file string, epoch long, index long")
    ledger.drain(samples.where("index % 3 = 0"), ledger.begin())
    ledger.drain(samples, ledger.begin())
    return ledger.rows().select("file", "epoch", "index", "run")


#: A lane for every 500 events: hashed, and as many as the input asks for.
LANES = "e AS (SELECT event_id, (SELECT greatest(1, CAST(ceil(count(*) / 500.0) AS BIGINT)) FROM events) AS lanes FROM events), laned AS (SELECT event_id, CAST(CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % lanes AS VARCHAR) AS lane FROM e)"


def laned(t: Tables):
    lanes = max(1, -(-t.events.count() // 500))
    hashed = F.conv(F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return replay(t, "events").withColumn("lane", (hashed % lanes).cast("string"))


@query("st_shuffle_buffer", f"WITH {LANES} SELECT lane, CAST(event_id AS VARCHAR) AS v FROM laned")
def _(t):
    """Every event leaves once, the last ones when the stream ends; tests check the order."""
    keyed = laned(t).withColumn("k", S.shuffle_key(F.lit(0), "event_id", "event_type"))
    return S.drained(S.shuffle_buffer(keyed, "lane", "k", "event_id", 100, "event_id", 0.01), f"shuffle_{uuid.uuid4().hex}", rest=S.left_in_buffer).select("lane", "v")


@query("st_pack", f"WITH {LANES} SELECT lane, sum(event_id % 50 + 1) AS tokens, count(*) AS items FROM laned GROUP BY lane")
def _(t):
    """Packs of 512 tokens; of each lane the tokens and items in all its packs, the last one included."""
    rows = laned(t).withColumn("n", (F.col("event_id") % 50 + 1).cast("int"))
    packs = S.drained(S.running_packs(rows, "lane", "event_id", "n", 512), f"pack_{uuid.uuid4().hex}", rest=S.open_packs)
    items = packs.select("lane", F.explode(F.split("items", ",").cast("array<bigint>")).alias("item"))
    return items.groupBy("lane").agg(F.sum(F.col("item") % 50 + 1).alias("tokens"), F.count("*").alias("items"))


@query("st_staleness_control")
def _(t):
    """Events as submissions, completions and consumptions, with a version every 64 events of a lane's users."""
    n = F.col("event_id") % 16
    kind = F.when(F.col("event_id") % 64 == 63, "version").when(n < 10, "submit").when(n < 13, "done").otherwise("consume")
    steered = laned(t).withColumn("kind", kind)
    return S.drained(S.rollout_control(steered, "lane", "event_id", "kind", "event_id", 8, 0.5, 2), f"steer_{uuid.uuid4().hex}")


@query("st_queue", f"WITH {LANES} SELECT lane, least(count(*), 300) AS queued, greatest(count(*) - 300, 0) AS dropped FROM laned GROUP BY lane")
def _(t):
    out = S.drained(S.bounded_queue(laned(t), "lane", "event_id", 300), f"queue_{uuid.uuid4().hex}", "update")
    return out.groupBy("lane").agg(F.max("queued").cast("long").alias("queued"), F.max("dropped").cast("long").alias("dropped"))


@query("st_staleness", "SELECT event_id FROM events WHERE 100 - event_id % 100 <= 5")
def _(t):
    return S.fresh(t.events.withColumn("version", F.col("event_id") % 100), "version", 100, 5).select("event_id")


@query("st_rolling_timer", "SELECT event_id, round(avg(value) OVER w, 6) AS rolling_avg, round(max(value) OVER w, 6) AS rolling_max FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def _(t):
    return S.rolling(t.events, "event_id", "value", 5, "user_id").select("event_id", F.round("rolling_avg", 6).alias("rolling_avg"), F.round("rolling_max", 6).alias("rolling_max"))


@query("st_dynamic_append", "SELECT event_id, generation FROM (SELECT event_id, event_type, unnest(range(0, 3)) AS generation FROM events) WHERE generation = 0 OR event_type = 'error' AND event_id % (2 * generation) = 0")
def _(t):
    """Errors with an even number are generated again, and of these those that four divides once more."""
    start = t.events.select("event_id", "event_type", F.lit(0).cast("long").alias("generation"))
    again = lambda df: df.where("event_type = 'error' AND event_id % (2 * (generation + 1)) = 0 AND generation < 2").withColumn("generation", F.col("generation") + 1)
    return S.appended(start, again, scratch(t.spark, "appended"), 5).select("event_id", "generation")


@query("st_event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(t):
    out = S.windowed_counts(S.event_time(t.events, "ts"), "ts", "1 hour", None, None, "event_type")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("st_event_windows_stream", "SELECT event_type, count(*) AS n, count(DISTINCT time_bucket(INTERVAL 1 DAY, ts)) AS days FROM events GROUP BY event_type")
def _(t):
    out = S.drained(S.windowed_counts(S.event_time(replay(t, "events"), "ts"), "ts", "1 day", None, "1 day", "event_type"), f"win_{uuid.uuid4().hex}", "complete")
    return out.groupBy("event_type").agg(F.sum("n").alias("n"), F.count("*").alias("days"))


@query("st_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, count(DISTINCT s) AS sessions, count(*) AS n FROM s GROUP BY user_id")
def _(t):
    out = S.sessions(S.event_time(t.events, "ts"), "ts", "30 minutes", "user_id")
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))
