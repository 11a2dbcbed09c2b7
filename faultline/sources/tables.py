"""Tables that are replaced whole: a reader sees the rows of one version, the old one or the new one.

Each version is a folder of its own. A small file names the one that counts; it is replaced by a rename that overwrites,
which file systems such as HDFS do in one step. A writer that fails leaves a folder that no one reads.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "_current"


def _store(spark: SparkSession, folder: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return jvm, path, path.getFileSystem(conf)


def current(spark: SparkSession, folder: str) -> dict | None:
    """version and note of the version that counts; None if nothing was saved yet."""
    jvm, path, store = _store(spark, folder)
    pointer = jvm.org.apache.hadoop.fs.Path(path, POINTER)
    if not store.exists(pointer):
        return None
    stream = store.open(pointer)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def save(df: DataFrame, folder: str, *, note: dict | None = None, keep: int = 2) -> str:
    """Replaces the table in this folder by df, and returns the new version's name.

    The last `keep` versions that counted stay, for readers that have begun; df may itself read the old one. An empty df is
    a table without rows. Of two writers at once, the one that ends last counts.
    """
    spark = df.sparkSession
    version = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    was = current(spark, folder)
    earlier = [was["version"], *was["earlier"]] if was else []
    df.write.parquet(f"{folder}/{version}")
    jvm, path, store = _store(spark, folder)
    fs = jvm.org.apache.hadoop.fs
    staged = fs.Path(path, f"_staged-{version}")
    out = store.create(staged, True)
    try:
        out.write(bytearray(json.dumps({"version": version, "note": note or {}, "earlier": earlier[: keep - 1]}).encode()))
    finally:
        out.close()
    kind = getattr(fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    fs.FileContext.getFileContext(store.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(store.makeQualified(staged), store.makeQualified(fs.Path(path, POINTER)), how)
    for old in earlier[keep - 1 :]:
        store.delete(fs.Path(path, old), True)
    return version


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the version that counts now; later replacements don't change them."""
    now = current(spark, folder)
    if now is None:
        raise ValueError(f"no table was saved in {folder}")
    return spark.read.parquet(f"{folder}/{now['version']}")
