"""Session helpers: the shared folder, written tables, and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.sources import folders

_SHIPPED: set[str] = set()
_BATCH_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir; see lattica.sources.folders."""
    return f"{folders.shared(spark)}/lattica-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Cuts lineage: writes df as Parquet into the shared folder and reads it again with the known schema; deleted when the session's process ends."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    deleted_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def deleted_at_exit(spark: SparkSession, path: str) -> None:
    """Has a folder that exists deleted when the driver's process ends, on whatever store it is."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(own)


def ship(spark: SparkSession) -> None:
    """Adds this package to the Python path of the executors, once per application, and bounds Arrow batches by bytes where the session does not."""
    if spark.conf.get(_BATCH_BYTES, None) in ("67108864b", "67108864"):  # Spark's own default
        spark.conf.set(_BATCH_BYTES, BATCH_BYTES)
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "lattica.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("lattica", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def held_out(column: str, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves the remainder; a null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(True))


def free_name(taken: Iterable[str], stem: str) -> str:
    """A column name that clashes with none of those taken (case does not count)."""
    low = {x.lower() for x in taken}
    while stem.lower() in low:
        stem = "_" + stem
    return stem


def map_rows(docs: DataFrame, run, extra: list[T.StructField] | None = None) -> DataFrame:
    """docs.mapInArrow(run) for a run that passes all columns on, whatever their names, and may add some."""
    fields = [T.StructField(f"c{k}", f.dataType, True) for k, f in enumerate(docs.schema.fields)]
    out = docs.toDF(*[f.name for f in fields]).mapInArrow(run, T.StructType([*fields, *(extra or [])]))
    return out.toDF(*docs.columns, *[f.name for f in extra or []])
