"""Range extraction, lookups and selections over runs of spectra.

Metadata frames have a key (``index``), ``time`` and maybe ``ms_level``; point frames have the same key
(``index``) and ``mz``, ``intensity``, maybe ``im``. Ranges include both ends; null coordinates never match.
Everything is a filter or an equi-join, so Catalyst pushes it to the scan; a key set is broadcast by
Spark only if its measured size allows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slabworks.session import materialise

Range = tuple[float | None, float | None]


def contains(c: Column | str, lo=None, hi=None) -> Column:
    """Interval membership, both ends included; an open end is None."""
    c = F.col(c) if isinstance(c, str) else c
    test = c.isNotNull()
    if lo is not None:
        test = test & (c >= lo)
    if hi is not None:
        test = test & (c <= hi)
    return test


def overlaps(start: Column | str, end: Column | str, lo, hi) -> Column:
    """Interval overlap of a (start, end) pair; an end before its start counts as the start."""
    start, end = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    return (start <= hi) & (F.greatest(start, end) >= lo) & end.isNotNull()


def select_entities(meta: DataFrame, time: Range | None = None, ms_level: Range | None = None) -> DataFrame:
    """(index, time) of the entities within time and MS-level ranges."""
    keep = F.lit(True)
    if time:
        keep = keep & contains("time", *time)
    if ms_level:
        keep = keep & contains("ms_level", *ms_level)
    return meta.where(keep).select("index", "time")


def key_bounds(keys: DataFrame) -> tuple[int, int] | None:
    """Lowest and highest key, None for an empty set: literals that prune the point scan."""
    lo, hi = keys.agg(F.min("index"), F.max("index")).first()
    return None if lo is None else (lo, hi)


def extract_points(
    points: DataFrame, meta: DataFrame, time: Range | None = None, mz: Range | None = None, im: Range | None = None, ms_level: Range | None = None, prune: bool = False, with_time: bool = False, fill: str = "drop",
    model: DataFrame | None = None, pos: str = "pos",
) -> DataFrame:
    """Points of a slab of time, m/z, ion mobility and MS level.

    prune: look up the key range first and give it to the scan as literals (one small job more). An ion
    mobility range is ignored where the points have none. fill: "drop" leaves out points whose m/z is null;
    "interpolate" fills them first, from the points around them in the order of `pos` and the entity's
    spacing model, and shows their intensity as zero, so whole entities are read before the m/z range applies.
    """
    if fill == "interpolate":
        from slabworks.operators.chunks import fill_coordinates

        whole = fill_coordinates(extract_points(points, meta, time, None, None, ms_level, prune, with_time), "index", pos, "mz", model)
        whole = whole.withColumn("intensity", F.coalesce(F.col("intensity"), F.lit(0).cast(points.schema["intensity"].dataType)))
        for name, bounds in (("mz", mz), ("im", im)):
            if bounds and name in points.columns:
                whole = whole.where(contains(name, *bounds))
        return whole
    keep = F.lit(True)
    if mz:
        keep = keep & contains("mz", *mz)
    if im and "im" in points.columns:
        keep = keep & contains("im", *im)
    rows = points.where(keep)
    if not (time or ms_level or with_time):
        return rows
    keys = select_entities(meta, time, ms_level)
    if prune:
        bounds = key_bounds(keys)
        rows = rows.where(F.lit(False) if bounds is None else contains("index", *bounds))
    return rows.join(keys, "index") if with_time else rows.join(keys.select("index"), "index", "left_semi")


def extract_naive(points: DataFrame, meta: DataFrame, time: Range | None = None, mz: Range | None = None, im: Range | None = None, ms_level: Range | None = None) -> DataFrame:
    """The slab by brute force, to measure and test the others against: all points meet their entity, then every row is looked at."""
    rows = points.join(meta.select("index", F.struct("time", *[c for c in ("ms_level",) if c in meta.columns]).alias("_m")), "index")
    for c, bounds in (("_m.time", time), ("mz", mz), ("im", im if "im" in points.columns else None), ("_m.ms_level", ms_level)):
        if bounds:
            rows = rows.where(contains(c, *bounds))
    return rows.drop("_m")


def attach_time(points: DataFrame, meta: DataFrame) -> DataFrame:
    return points.join(meta.select("index", "time"), "index")


def xic(points: DataFrame, meta: DataFrame, time: Range | None, mz: Range) -> DataFrame:
    """Extracted ion chromatogram: summed intensity per entity."""
    return extract_points(points, meta, time, mz, with_time=True).groupBy("index", "time").agg(F.sum("intensity").alias("intensity"), F.count("*").alias("n_points"))


def entities_with_ion(selected_ion: DataFrame, mz: Range) -> DataFrame:
    """Keys of the spectra that have a selected ion in an m/z range."""
    return selected_ion.where(contains("mz", *mz)).select("index").distinct()


def by_mask(rows: DataFrame, keys: DataFrame, lo=None, hi=None) -> DataFrame:
    """Rows whose index is in an interval and in a sparse key set."""
    return rows.where(contains("index", lo, hi)).join(keys.select("index").distinct(), "index", "left_semi")


def mask_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("index").intersect(b.select("index"))


def split_mask(lo: int, hi: int) -> tuple[tuple[int, int], tuple[int, int]] | None:
    """The two halves of a key interval, None if a half would have fewer than two keys."""
    half = (hi - lo) // 2
    return None if half < 2 else ((lo, lo + half), (lo + half + 1, hi))


def by_index(rows: DataFrame, index: int | list[int]) -> DataFrame:
    """Rows of one entity, or of a few."""
    return rows.where(F.col("index") == index if isinstance(index, int) else F.col("index").isin(index))


def either(rows: DataFrame, *selections: Column) -> DataFrame:
    """Rows that any of the selections has; a selection that is null has none."""
    test = F.lit(False)
    for s in selections:
        test = test | F.coalesce(s, F.lit(False))
    return rows.where(test)


CORE = ("index", "mz", "intensity", "im")


def core_columns(points: DataFrame) -> DataFrame:
    """What extraction needs of points: key, coordinate, intensity and the mobility if there is one."""
    return points.select(*[c for c in CORE if c in points.columns])


def with_signal(meta: DataFrame, points: DataFrame) -> DataFrame:
    """Entities with their points; entities without points stay, as in a sequential scan."""
    return meta.join(core_columns(points), "index", "left")


def in_sequence(meta: DataFrame, points: DataFrame, pos: str | None = None) -> DataFrame:
    """The sequential scan: every entity with its points in order, from range to range of the index; each
    partition holds whole entities, which `foreachPartition` or `toLocalIterator` meet one after the other."""
    order = ["index", pos or "mz"]
    rows = meta.join(points, "index", "left")
    return rows.repartitionByRange("index").sortWithinPartitions(*order)


def slice_by_index(rows: DataFrame, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Keys from start up to, not including, stop."""
    return rows.where(contains("index", 0 if start is None else start, None if stop is None else stop - 1))


def nearest_time(meta: DataFrame, at: float) -> DataFrame:
    """The entity nearest in time, the lowest index of several; of infinite times the first or last in time."""
    if math.isinf(at):
        near = F.struct(F.col("time") if at < 0 else -F.col("time"), F.col("index"))
    else:
        near = F.struct(F.abs(F.col("time") - F.lit(at)), F.col("index"))
    return meta.where("time is not null").agg(F.min_by("index", near).alias("index"), F.min_by("time", near).alias("time")).where("index is not null")


def nearest_times(meta: DataFrame, queries: DataFrame) -> DataFrame:
    """As-of form for many queries (query_id, at): the nearest entity of each, the lowest index of several.

    Entities and queries are put into one order by range partitioning. Within a range each query takes
    the last entity before and the first after it; what a range can't tell comes from the ranges beside
    it, of which a row each is looked at. No pairs of the two sides are built.
    """
    side = meta.where("time is not null").groupBy(F.col("time").cast("double").alias("t")).agg(F.min("index").alias("index")).select("t", F.struct(F.col("t").alias("time"), "index").alias("e"), F.lit(None).cast("bigint").alias("query_id"))
    ask = queries.where("at is not null").select(F.col("at").cast("double").alias("t"), F.lit(None).cast(side.schema["e"].dataType).alias("e"), F.col("query_id").cast("bigint"))
    both = materialise(side.unionByName(ask).repartitionByRange("t").withColumn("_part", F.spark_partition_id()))
    edges = both.groupBy("_part").agg(F.max("e").alias("last"), F.min("e").alias("first"))  # structs of nulls are skipped
    by_part, back = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1), W.orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, -1)
    beside = edges.select("_part", F.max("last").over(by_part).alias("lo0"), F.min("first").over(back).alias("hi0"))
    before = W.partitionBy("_part").orderBy("t", F.col("query_id").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    # backwards, as a frame up to the end would be summed anew for every row
    after = W.partitionBy("_part").orderBy(F.desc("t"), F.col("query_id").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("lo", F.last("e", ignorenulls=True).over(before)).withColumn("hi", F.last("e", ignorenulls=True).over(after)).where("query_id is not null")
    told = found.join(beside, "_part").withColumn("lo", F.coalesce("lo", "lo0")).withColumn("hi", F.coalesce("hi", "hi0"))
    below, above = F.abs(F.col("t") - F.col("lo.time")), F.abs(F.col("hi.time") - F.col("t"))
    lower = F.col("hi").isNull() | (below < above) | ((below == above) & (F.col("lo.index") <= F.col("hi.index")))
    return told.select("query_id", F.col("t").alias("at"), F.when(lower, F.col("lo")).otherwise(F.col("hi")).alias("e")).select("query_id", "at", F.col("e.index").alias("index"), F.col("e.time").alias("time"))


def time_slice(meta: DataFrame, start: float, stop: float) -> DataFrame:
    """Entities from the one nearest to start to the one nearest to stop, both included.

    The two are looked up first, so the scan gets their indexes as literals.
    """
    first = [nearest_time(meta, at).first() for at in (start, stop)]
    if None in first:
        return meta.where(F.lit(False))
    return meta.where(contains("index", first[0]["index"], first[1]["index"]))


def start_from(rows: DataFrame, meta: DataFrame, index: int | None = None, id: str | None = None, time: float | None = None) -> DataFrame:
    """Rows from an entity on, named by its index, its id or the time it is nearest to; none if it isn't there."""
    if index is None:
        at = (meta.where(F.col("id") == id).agg(F.min("index").alias("index")) if id is not None else nearest_time(meta, 0.0 if time is None else time)).first()
        index = None if at is None else at["index"]
    return rows.where(F.lit(False) if index is None else F.col("index") >= index)


def by_id(meta: DataFrame, ids: list[str] | DataFrame) -> DataFrame:
    """Entities by their id."""
    return meta.join(ids, "id", "left_semi") if isinstance(ids, DataFrame) else meta.where(F.col("id").isin(ids))

