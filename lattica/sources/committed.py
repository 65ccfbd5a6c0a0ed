"""Spark data source "versions": a table whose writes appear as a whole, or not at all.

A write's tasks put Parquet files below data/, each attempt a file of its own; the driver then puts one line of JSON, the
version's manifest, below log/, and with that line the write has happened: what was current is old and the new rows are there, both at
once. A write that fails leaves no manifest, so readers see the version before; its files are deleted, and those of attempts
that were lost are named by no manifest. Manifests are numbered, and a number is taken by one writer only: another one that wants
it fails or, where it only adds, takes the next.

    rows.write.format("versions").mode("append").option("path", p).option("op", "insert").save()
    committed.read(spark, p)

op: insert keeps older rows of the tasks written as history; replace takes them out; amend takes the last version's rows of them
out, and keeps older ones. All are by the column of the option key (task_id). read() tells is_current from the manifests: a row is current if its version is the last that wrote its key.

Defined results: a write of no rows is a version without files; null keys are a key; an empty folder is no table (read raises);
a write whose columns differ from the table's raises, before any file is written. Paths are those that pyarrow opens.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

OPS = ("insert", "replace", "amend")
TRIES = 20


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def manifests(path: str, version: int | None = None) -> list[dict]:
    """The manifests of a table in order, up to a version; a line that is not whole is no manifest."""
    store, root = _store(path)
    found = []
    for x in store.get_file_info(fs.FileSelector(f"{root}/log", allow_not_found=True)):
        if x.base_name.endswith(".json"):
            with store.open_input_stream(x.path) as f:
                line = f.read()
            if line.endswith(b"\n"):
                found.append(json.loads(line))
    found.sort(key=lambda m: m["version"])
    return [m for m in found if version is None or m["version"] <= version]


def _put(path: str, manifest: dict) -> bool:
    """Writes a manifest unless its number is taken."""
    store, root = _store(path)
    name, line = f"{root}/log/{manifest['version']:012d}.json", json.dumps(manifest).encode() + b"\n"
    store.create_dir(f"{root}/log", recursive=True)
    if isinstance(store, fs.LocalFileSystem):
        part = f"{root}/log/{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.write(line)
        try:
            os.link(part, name)  # fails if the name is taken
        except FileExistsError:
            return False
        finally:
            os.unlink(part)
        return True
    if store.get_file_info(name).type != fs.FileType.NotFound:
        return False
    with store.open_output_stream(name) as f:
        f.write(line)
    return True


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


class Writer(DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, options):
        self.path, self.op, self.key = options["path"], options.get("op", "insert"), options.get("key", "task_id")
        self.schema, self.expected = schema.json(), options.get("expected")
        if self.op not in OPS:
            raise ValueError(f"no operation {self.op!r}")
        if self.key not in schema.names:
            raise ValueError(f"rows have no column {self.key!r}")
        before = manifests(self.path)
        if before and [(f.name, f.dataType) for f in T.StructType.fromJson(json.loads(before[-1]["schema"]))] != [(f.name, f.dataType) for f in schema]:
            raise ValueError(f"the table's columns are others: {before[-1]['schema']}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.path)
        name, out, rows = f"{uuid.uuid4().hex}.parquet", None, 0
        try:
            for batch in iterator:
                if batch.num_rows:
                    if out is None:
                        store.create_dir(f"{root}/data", recursive=True)
                        out = pq.ParquetWriter(f"{root}/data/{name}", batch.schema, filesystem=store)
                    out.write_batch(batch)
                    rows += batch.num_rows
        except BaseException:
            if out is not None:
                out.close()
                store.delete_file(f"{root}/data/{name}")
            raise
        if out is None:
            return Written(None, 0)
        out.close()
        return Written(name, rows)

    def commit(self, messages) -> None:
        done = [m for m in messages if m is not None and m.file]
        for _ in range(TRIES):
            version = (manifests(self.path) or [{"version": 0}])[-1]["version"] + 1
            if self.expected is not None and version != int(self.expected) + 1:
                break
            if _put(self.path, {"version": version, "op": self.op, "key": self.key, "files": [m.file for m in done], "rows": sum(m.rows for m in done), "schema": self.schema}):
                return
        self.abort(messages)
        raise RuntimeError(f"another write came first: version {version} of {self.path} was not expected")

    def abort(self, messages) -> None:
        store, root = _store(self.path)
        for m in messages:
            if m is not None and m.file and store.get_file_info(f"{root}/data/{m.file}").type == fs.FileType.File:
                store.delete_file(f"{root}/data/{m.file}")


class VersionsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "versions"

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("versions are added; mode must be append")
        return Writer(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VersionsSource)


def write(rows: DataFrame, path: str, op: str = "insert", key: str = "task_id", expected: int | None = None) -> None:
    """Commits rows as a version; with expected (a version's number) only if none came after it."""
    register(rows.sparkSession)
    out = rows.write.format("versions").mode("append").option("path", path).option("op", op).option("key", key)
    (out if expected is None else out.option("expected", str(expected))).save()


def latest(path: str) -> int:
    """The number of the last version; 0 where there is none."""
    return (manifests(path) or [{"version": 0}])[-1]["version"]


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table's columns with version and is_current, as of the last version or an older one.

    Files meet their versions by name, and rows what has become of their key's version: one row for each key and version, counted up
    before the shuffle.
    """
    log = manifests(path, version)
    if not log:
        raise ValueError(f"no versions below {path}")
    schema, key = T.StructType.fromJson(json.loads(log[-1]["schema"])), log[-1]["key"]
    names = [(f, m["version"], m["op"]) for m in log for f in m["files"]]
    if not names:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("version", T.LongType()), T.StructField("is_current", T.BooleanType())]))
    files = spark.createDataFrame(names, "_file string, _version long, _op string")
    rows = spark.read.schema(schema).parquet(*[f"{path}/data/{f}" for f, _, _ in names]).withColumn("_file", F.col("_metadata.file_name")).join(files, "_file").drop("_file")
    by = Window.partitionBy("_key")
    made = rows.groupBy(F.col(key).alias("_key"), F.col("_version").alias("_of"), "_op").agg(F.count(F.lit(1)).alias("_n"))
    last, since = F.max("_of").over(by), F.coalesce(F.max(F.when(F.col("_op") == "replace", F.col("_of"))).over(by), F.lit(0))
    seen = made.select("_key", "_of", (F.col("_of") == last).alias("is_current"), ((F.col("_of") >= since) & (F.coalesce(F.lead("_op").over(by.orderBy("_of")), F.lit("")) != "amend")).alias("_seen"))
    met = rows.join(seen.filter("_seen"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_version") == F.col("_of")))
    return met.select(*[F.col(f"`{c}`") for c in schema.names], F.col("_version").alias("version"), "is_current")


def changed(spark: SparkSession, path: str, changes: DataFrame, columns: list[str], by: list[str]) -> None:
    """Sets non-null columns of changes in the current rows with the same by (one change each), as a version that amends those tasks' last one."""
    now = latest(path)
    table = read(spark, path, now)
    key = manifests(path, now)[-1]["key"]
    tasks = changes.select(key).distinct()
    new = changes.select(*by, *[F.col(c).alias(f"_{c}") for c in columns])
    own = table.filter("is_current").drop("version", "is_current").join(tasks, key, "left_semi").join(new, by, "left")
    write(own.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns if c not in ("version", "is_current")]), path, "amend", key, now)


def history(spark: SparkSession, path: str) -> DataFrame:
    """version, op, rows and whether a version is the last of some key."""
    log = spark.createDataFrame([(m["version"], m["op"], m["rows"]) for m in manifests(path)], "version long, op string, rows long")
    kept = read(spark, path).groupBy("version").agg(F.count(F.lit(1)).alias("n_rows"), F.max("is_current").alias("has_current"))
    return log.join(kept, "version", "left").select("version", "op", "rows", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("has_current", F.lit(False)).alias("has_current")).orderBy("version")
