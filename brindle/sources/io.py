"""Readers and writers. Paths go through Hadoop file systems, so object stores and distributed folders need no extra code."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CANONICAL = ("uuid", "source", "metadata", "images", "videos", "messages", "segments", "image", "video", "text", "label")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def make_dir(spark: SparkSession, path: str) -> None:
    fs, p, _ = _fs(spark, path)
    fs.mkdirs(p)


def copy(spark: SparkSession, source: str, target: str) -> None:
    fs, p, jvm = _fs(spark, source)
    to, q, _ = _fs(spark, target)
    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, to, q, False, True, spark.sparkContext._jsc.hadoopConfiguration())


def list_files(spark: SparkSession, path: str, suffix: str = ".parquet", recursive: bool = True) -> list[str]:
    """Sorted paths of files with a suffix."""
    fs, p, _ = _fs(spark, path)
    found, it = [], fs.listFiles(p, recursive)
    while it.hasNext():
        name = it.next().getPath().toString()
        if name.endswith(suffix):
            found.append(name)
    return sorted(found)


def mixed_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """Parquet files named or held by folders; missing and other files are passed over, repeats dropped, the rest sorted."""
    found: set[str] = set()
    for path in paths:
        fs, p, _ = _fs(spark, path)
        if not fs.exists(p):
            continue
        if fs.getFileStatus(p).isDirectory():
            found.update(list_files(spark, path))
        elif path.endswith(".parquet"):
            found.add(fs.resolvePath(p).toString())
    return sorted(found)


def read_dir(spark: SparkSession, path: str, recursive: bool = True, skip_corrupt: bool = False) -> DataFrame:
    """All Parquet files below a folder; unreadable ones can be skipped."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.parquet").option("ignoreCorruptFiles", str(skip_corrupt).lower())
    return reader.parquet(path)


def read_filelist(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet files that a JSON list names."""
    named = json.loads("".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
    return spark.read.parquet(*named)


def read_column(spark: SparkSession, path: str, column: str, rows: int) -> DataFrame:
    """At most `rows` values of one column; the scan reads nothing else and stops early."""
    return spark.read.parquet(path).select(column).limit(rows)


def read_generations(spark: SparkSession, path: str) -> DataFrame:
    """One row per sample of a generation document `{..., samples: {id: {...}}}`."""
    sample = "struct<prompt:string,generations:array<string>,ground_truth:string,logprobs:array<double>,metadata:map<string,string>>"
    raw = spark.read.text(path, wholetext=True)
    doc = raw.select(F.from_json("value", f"struct<model_name:string,task_name:string,split:string,total_time:double,samples:map<string,{sample}>>").alias("d"))
    return doc.select("d.model_name", "d.task_name", "d.split", F.explode("d.samples").alias("sample_id", "s")).select("model_name", "task_name", "split", "sample_id", "s.*")


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A registry with a header, perhaps a byte order mark, and padded numbers."""
    return spark.read.schema(schema).option("header", "true").option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").csv(path)


def read_tar_shards(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Members of tar shards (a folder, or the shards by name): shard, key, ext, data; one shard is read by one task."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    rows = [(shard, *m.name.partition(".")[::2], tar.extractfile(m).read()) for m in tar if m.isfile()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if i == 3 else pa.string()) for i in range(4)], names=["shard", "key", "ext", "data"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(path).select("path", "content")
    return files.mapInArrow(members, "shard string, key string, ext string, data binary")


def read_shard_lists(spark: SparkSession, paths: list[str]) -> tuple[list[str], int]:
    """Shards named by documents `{"shardlist": [{"url", "nsamples"}]}`, relative to each document, sorted; and their samples.

    Shards are tar files of one task each; as a row holds a shard's content, a shard must be below 2 GB.
    """
    kind = "struct<shardlist:array<struct<url:string,nsamples:bigint>>>"
    rows = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("at"), F.inline(F.from_json("value", kind)["shardlist"]))
    found = rows.select(F.concat(F.regexp_replace("at", "[^/]*$", ""), "url").alias("url"), "nsamples").collect()
    return sorted(r["url"] for r in found), sum(r["nsamples"] for r in found)


def epochs(files: DataFrame, path: str, n: int, seed: int) -> DataFrame:
    """(file, epoch) pairs with `place` in a seeded order: each epoch has every file once."""
    each = files.select(path).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    from brindle.operators.sampling import shuffle

    return shuffle(each, seed, "epoch", path)


def worker_of(place: Column, workers: int) -> Column:
    """The worker that a place in the file list falls to."""
    return F.pmod(place, F.lit(workers))


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Rows of all, columns by name, missing ones NULL."""
    out = frames[0].select(*frames[0].columns)
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def write_single(df: DataFrame, path: str) -> None:
    """One snappy Parquet file, for results that are small by contract."""
    df.coalesce(1).write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_sharded(df: DataFrame, path: str, rows: int, order: list[str]) -> list[str]:
    """Files part-%05d-of-%05d.parquet of `rows` rows each, in order, and file_list.json beside them; returns the paths."""
    from brindle.operators.sampling import shards

    spark = df.sparkSession
    placed = shards(df, rows, order)
    staging = f"{path}/_shards"
    placed.repartition("shard").sortWithinPartitions("shard", *order).write.mode("overwrite").partitionBy("shard").parquet(staging)
    fs, _, jvm = _fs(spark, path)
    pieces = sorted(((int(p.rsplit("shard=", 1)[1].split("/")[0]), p) for p in list_files(spark, staging)), key=lambda x: x[0])
    out = []
    for i, (_, piece) in enumerate(pieces):
        name = f"{path}/part-{i:05d}-of-{len(pieces):05d}.parquet"
        fs.rename(jvm.org.apache.hadoop.fs.Path(piece), jvm.org.apache.hadoop.fs.Path(name))
        out.append(name)
    fs.delete(jvm.org.apache.hadoop.fs.Path(staging), True)
    write_text(spark, f"{path}/file_list.json", json.dumps(out, indent=2))
    return out


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small driver-side file."""
    fs, p, _ = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(data))
    out.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small driver-side document, such as a file list or a report."""
    write_bytes(spark, path, text.encode())


def write_results(spark: SparkSession, path: str, results: dict) -> None:
    write_text(spark, path, json.dumps(results, ensure_ascii=False, indent=2))


def write_jsonl(df: DataFrame, path: str, step: int | None = None) -> None:
    """One JSON object per row; rollouts are kept by step."""
    df.write.mode("overwrite").json(path if step is None else f"{path}/step={step}")


def multimap(df: DataFrame, key: str, item: str, count: str) -> DataFrame:
    """key -> items with counts, the most frequent first, as one JSON array per key."""
    entry = F.struct((-F.col(count)).alias("o"), F.col(item).alias("i"))
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("x"))
    return rows.select(key, F.to_json(F.transform("x", lambda e: F.struct(e["i"].alias("pid"), (-e["o"]).alias("count")))).alias("items"))


def markdown_lines(df: DataFrame) -> DataFrame:
    """place, line: a table as Markdown, head first; rows keep the order of their partitions. Nothing passes through the driver."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.array(*cells), " | ", ""), F.lit(" |"))
    head = df.sparkSession.createDataFrame([(-2, f"| {' | '.join(df.columns)} |"), (-1, f"| {' | '.join(['---'] * len(df.columns))} |")], "place long, line string")
    cells = [F.replace(F.replace(df[f"`{c}`"].cast("string"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")) for c in df.columns]
    return head.unionByName(df.select(F.monotonically_increasing_id().alias("place"), line(cells).alias("line")))


def dump_or_load(df: DataFrame, path: str) -> DataFrame:
    """Writes a batch once; later calls read it back instead of computing it."""
    spark = df.sparkSession
    if not exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def canonical(df: DataFrame) -> DataFrame:
    """All columns of the corpus schema, missing ones NULL, NaN strings NULL."""
    have = {c: df[c] for c in df.columns}
    clean = lambda c: F.when(F.lower(have[c].cast("string")) != "nan", have[c].cast("string"))
    return df.select(*[(clean(c) if c in have else F.lit(None).cast("string")).alias(c) for c in CANONICAL])


def invalid_rows(df: DataFrame) -> DataFrame:
    """Rows that break the corpus rules: metadata is an object, roles and part types are known, messages or segments exist."""
    messages = F.from_json("messages", "array<struct<role:string,content:array<struct<type:string,text:string>>>>")
    segments = F.from_json("segments", "array<struct<type:string,text:string>>")
    roles = F.forall(messages, lambda m: m["role"].isin("user", "assistant", "system") & F.coalesce(F.forall(m["content"], lambda p: p["type"] == "text"), F.lit(False)))
    ok = (
        F.coalesce(F.from_json("metadata", "map<string,string>").isNotNull(), F.lit(False))
        & (F.coalesce(roles, F.lit(False)) | F.coalesce(F.forall(segments, lambda s: s["type"].isNotNull()), F.lit(False)))
    )
    return df.where(~ok)
