"""Incremental writing: a stream of points appended entity by entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _is_there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _write(rows: DataFrame, path: str, key: str, row_group_bytes: int) -> None:
    rows.repartition(F.col(key)).sortWithinPartitions(key).write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", str(row_group_bytes)).parquet(path)


def append_points(stream: DataFrame, path: str, checkpoint: str, key: str = "index", trigger: dict | None = None, row_group_bytes: int = 512 << 20) -> StreamingQuery:
    """Append each micro-batch as files sorted by entity; a batch written again after a failure replaces itself.

    Entities arrive in the order of their keys, as a run writes them, and an entity may go on in the next
    batch. So the highest key of a batch is held back, in a folder of its own (``held/batch=N``), and
    written with the batch that brings a higher one: an entity never straddles two batches. ``finish``
    writes what is held at the end. Every batch has its folder (``data/batch=N``), so exactly one copy of
    each stays; row groups are closed at row_group_bytes.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/held/batch={epoch - 1}"
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(before)) if epoch and _is_there(spark, before) else batch
        rows = rows.persist()
        try:
            last = rows.agg(F.max(key)).first()[0]
            _write(rows.where(F.lit(False) if last is None else F.col(key) < last), f"{path}/data/batch={epoch}", key, row_group_bytes)
            _write(rows.where(F.lit(False) if last is None else F.col(key) == last), f"{path}/held/batch={epoch}", key, row_group_bytes)
        finally:
            rows.unpersist()

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def finish(spark: SparkSession, path: str, key: str = "index", row_group_bytes: int = 512 << 20) -> None:
    """Write the entity that is held back, when no more points will come; again has no effect."""
    if not _is_there(spark, f"{path}/held"):
        return
    held = spark.read.parquet(f"{path}/held")
    last = held.agg(F.max("batch")).first()[0]
    if last is not None:
        # the folder behind the last batch's: the same each time
        _write(held.where(F.col("batch") == last).drop("batch"), f"{path}/data/batch={last + 1}", key, row_group_bytes)


def windowed_trace(stream: DataFrame, time: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Summed intensity, count and highest value per window of event time, with late rows up to a bound."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("highest")).select("window.start", "window.end", "n", "total", "highest")
