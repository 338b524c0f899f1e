"""Session helpers shared by operators, tests and the bench."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Only a local master may do with a folder of this machine, gone at exit."""
    sc = spark.sparkContext
    jsc = sc._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="slabworks-ckpt-"))
        _forget_at_exit(spark, jsc.getCheckpointDir().get())
    return jsc.getCheckpointDir().get()


def _forget_at_exit(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def forget() -> None:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone
            pass

    atexit.register(forget)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so a lost executor costs a re-read and not a re-run. For small frames."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same as a table written in the shared folder: compact, read by column, gone when the driver ends."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _forget_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, most_rows: int = 200_000, most_chars: int = 32_000_000) -> DataFrame:
    """A lookup side, written once and measured: marked for broadcast within these bounds, else left to a shuffled join."""
    df = materialise(df)
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    chars = F.sum(sum((F.coalesce(F.length(c), F.lit(0)) for c in texts), F.lit(0)))
    rows, size = df.agg(F.count("*"), chars).first()
    return F.broadcast(df) if rows <= most_rows and (size or 0) <= most_chars else df


def local_session(cores: int | str = "*", app: str = "slabworks") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", os.environ.get("SLABWORKS_PARTITIONS", "8"))
        .config("spark.driver.memory", os.environ.get("SLABWORKS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
