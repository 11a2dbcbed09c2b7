"""A sink of a stream that leaves each row once, whatever is replayed: batches under their numbers, the last row of a key counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.sources import tables


def once(stream: DataFrame, time: str, delay: str, keys: list[str]) -> DataFrame:
    """The stream's rows without those whose keys came before, within this delay of event time."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def upserts(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: saves each batch in whole under its number.

    A batch that is replayed, after a failure before or after its save, replaces itself; batches that a compaction has
    taken in are not saved again.
    """

    def write(batch: DataFrame, number: int) -> None:
        base = tables.current(batch.sparkSession, f"{folder}/base")
        if base is None or number > base["note"]["upto"]:
            tables.save(batch, f"{folder}/batches/{number}", keep=1)

    return write


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that are saved, in order, but for those that the base holds."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/batches")
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [int(f.getPath().getName()) for f in store.listStatus(path)] if store.exists(path) else []
    base = tables.current(spark, f"{folder}/base")
    upto = -1 if base is None else base["note"]["upto"]
    return [n for n in sorted(names) if n > upto and tables.current(spark, f"{folder}/batches/{n}")]


def latest(spark: SparkSession, folder: str, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Of each key (nulls are equal) the row that is last by these columns, whatever batch it came in; of equal ones the last batch's."""
    parts = [tables.load(spark, f"{folder}/batches/{n}").withColumn("batch_number", F.lit(n)) for n in _batches(spark, folder)]
    if tables.current(spark, f"{folder}/base"):
        parts.insert(0, tables.load(spark, f"{folder}/base").withColumn("batch_number", F.lit(-1)))
    if not parts:
        raise ValueError(f"no batch was saved in {folder}")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    columns = [c for c in rows.columns if c != "batch_number"]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*(order or []), "batch_number", F.xxhash64(*columns))).alias("row"))
    return last.select("row.*")


def compact(spark: SparkSession, folder: str, keys: list[str], order: list[str] | None = None) -> None:
    """Takes the saved batches into one table. Readers see either the batches or that, with the same rows."""
    numbers = _batches(spark, folder)
    if not numbers:
        return
    tables.save(latest(spark, folder, keys, order), f"{folder}/base", note={"upto": numbers[-1]})
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/batches")
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for n in numbers:
        store.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, str(n)), True)
