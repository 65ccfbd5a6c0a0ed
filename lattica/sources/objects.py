"""Objects of a store that Spark reads: listing, facts, content, and the choice of the store by a path."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from itertools import batched

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def listed(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, length, modified of all files below root whose name fits pattern; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def content(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content, md5 of the files at path."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content", F.md5("content").alias("md5"))


def is_local(path: Column) -> Column:
    return path.rlike(r"^(/|[A-Za-z]:)")


def fits_type(name: Column, kinds: tuple[str, ...] = ("xlsx", "xls")) -> Column:
    return F.lower(name).rlike(rf"\.({'|'.join(kinds)})\z")


def stat(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """name, path, length, modified, etag (of what is known without reading) and type of all files below root."""
    files = listed(spark, root, pattern)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), "path", "length", "modified", F.md5(F.concat_ws(":", "path", "length", "modified").cast("binary")).alias("etag"), F.lower(F.regexp_extract(name, r"\.([^.]*)\z", 1)).alias("type"))


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    own = jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), own


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Writes one object; what stands there is replaced."""
    store, own = _file(spark, path)
    out = store.create(own, True)
    try:
        out.write(content)
    finally:
        out.close()


def delete(spark: SparkSession, path: str) -> bool:
    """Deletes an object or a folder; false if there is none."""
    store, own = _file(spark, path)
    return store.delete(own, True)


def delete_all(spark: SparkSession, paths: Iterable[str], lanes: int = 32, lot: int = 1024) -> int:
    """Deletes many objects, lanes of them at a time and a lot of paths in memory; how many of them there were.

    Objects that are gone already count as deleted, so a run that broke off can be run again. All of a lot are tried; then the first
    error of a store is raised.
    """
    n = 0
    with ThreadPoolExecutor(lanes) as pool:
        for some in batched(paths, lot):
            calls = [pool.submit(delete, spark, path) for path in some]
            errors = [e for e in (c.exception() for c in calls) if e is not None]
            if errors:
                raise errors[0]
            n += sum(c.result() for c in calls)
    return n


def presigned(path: str, key: bytes, expires: int) -> str:
    """A link that holds until expires (seconds since 1970), signed by HMAC-SHA256."""
    return f"{path}?expires={expires}&signature={hmac.new(key, f'{path}:{expires}'.encode(), hashlib.sha256).hexdigest()}"


def is_signed(link: str, key: bytes, now: int) -> bool:
    path, _, rest = link.partition("?expires=")
    expires = rest.partition("&")[0]
    return expires.isdigit() and now <= int(expires) and hmac.compare_digest(presigned(path, key, int(expires)), link)
