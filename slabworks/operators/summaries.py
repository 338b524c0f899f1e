"""Per-entity summaries and the traces made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entity_summary(points: DataFrame) -> DataFrame:
    """Point count, base peak, total and range of every entity; of equal peaks the lowest m/z; null points count nowhere."""
    peak = F.struct(F.col("intensity"), -F.col("mz"))
    return points.where("mz is not null and intensity is not null").groupBy("index").agg(
        F.count("*").alias("n_points"), F.max_by("mz", peak).alias("base_peak_mz"), F.max("intensity").alias("base_peak_intensity"),
        F.sum("intensity").alias("total_ion_current"), F.min("mz").alias("lowest_mz"), F.max("mz").alias("highest_mz"),
    )


def trace(meta: DataFrame, measure: str) -> DataFrame:
    """A chromatogram of a stored per-spectrum measure; rows where time or measure is null or not a number are left out."""
    told = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return meta.where(told("time") & told(measure)).select("index", "time", F.col(measure).alias("intensity"))


def totals(points: DataFrame) -> DataFrame:
    """How many points and entities there are."""
    return points.agg(F.count("*").alias("n_points"), F.countDistinct("index").alias("n_entities"))


def counts_by(df: DataFrame, column: str, name: str, key: str | None = None) -> DataFrame:
    """(name, n) per value of a column: rows, or different keys."""
    return df.groupBy(F.col(column).alias(name)).agg((F.count("*") if key is None else F.countDistinct(key)).alias("n"))


def filled_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many rows have a value in each column: one aggregate."""
    return df.agg(*[F.count(c).alias(c) for c in columns])


def error_statistics(pairs: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Count, mean, deviation, median and most of the absolute differences of two columns."""
    e = F.abs(F.col(a) - F.col(b))
    return pairs.groupBy(*by).agg(F.count(e).alias("n"), F.avg(e).alias("mean_error"), F.stddev_pop(e).alias("std_error"), F.percentile(e, 0.5).alias("median_error"), F.max(e).alias("max_error"))


def histogram(values: DataFrame, column: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts per bin of equal width; values outside go to bin 0 or bins + 1."""
    return values.where(F.col(column).isNotNull()).groupBy(F.width_bucket(F.col(column), F.lit(lo), F.lit(hi), F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def all_null_columns(df: DataFrame) -> list[str]:
    """Columns without any value: one aggregate over the table."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first().asDict()
    return [c for c, n in counts.items() if not n]


def drop_all_null(df: DataFrame) -> DataFrame:
    return df.drop(*all_null_columns(df))


def plain_frame(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """A table as people read it: without empty columns, the others by the plain names their column names tell."""
    from slabworks.functions.cv import rename_by_vocabulary

    return rename_by_vocabulary(drop_all_null(df), names)
