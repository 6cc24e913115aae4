"""A shared folder that holds copies of remote files, the least recently used of which go first."""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import SparkSession

from brindle.sources.io import _fs, copy, list_files, make_dir


def cached(spark: SparkSession, path: str, folder: str, limit: int = 500, tries: int = 5, wait: float = 0.5) -> str:
    """The path of a copy of `path` in a shared folder, made if it is not there.

    The copy's name is a hash of the path. A failed copy is tried again; it appears under its name only once it is whole.
    With more than `limit` files in the folder, the older half by last use goes.
    """
    suffix = "." + path.rsplit(".", 1)[1] if "." in path.rsplit("/", 1)[-1] else ""
    target = f"{folder.rstrip('/')}/{hashlib.sha256(path.encode()).hexdigest()}{suffix}"
    fs, there, jvm = _fs(spark, target)
    if not fs.exists(there):
        make_dir(spark, folder)
        for attempt in range(tries):
            part = f"{target}.part{attempt}"
            try:
                copy(spark, path, part)
                if not fs.rename(jvm.org.apache.hadoop.fs.Path(part), there) and not fs.exists(there):
                    raise OSError(f"{part} was not renamed")
                break
            except Exception:  # noqa: BLE001
                if attempt == tries - 1:
                    raise
                time.sleep(wait)
    fs.setTimes(there, int(time.time() * 1000), -1)
    evict(spark, folder, limit)
    return target


def evict(spark: SparkSession, folder: str, limit: int) -> list[str]:
    """Deletes the older half of the folder's files if there are more than `limit`; returns them."""
    found = list_files(spark, folder, "", recursive=False)
    if len(found) <= limit:
        return []
    fs, _, jvm = _fs(spark, folder)
    of = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    old = sorted(found, key=lambda p: (fs.getFileStatus(of(p)).getModificationTime(), p))[: len(found) // 2]
    for p in old:
        fs.delete(of(p), True)
    return old
