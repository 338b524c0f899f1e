"""Order-dependent kernels on one entity's points.

Frames have an entity key, a position that orders its rows (coordinates may be null, so they can't), and
values. The kernels are window expressions, chunking alone is a loop over ordered rows; nulls are never zeros.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec


def in_order(key: str, pos: str) -> WindowSpec:
    return W.partitionBy(key).orderBy(pos)


def _neighbours(x: str, w: WindowSpec) -> tuple[Column, Column, Column, Column]:
    """previous and next value, and whether there is none."""
    return F.lag(x).over(w), F.lead(x).over(w), F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()


def is_zero_run(x: str, w: WindowSpec) -> Column:
    """Inside a run of zeros: zero, with a zero or the start before it and a zero or the end behind it."""
    prev, nxt, first, last = _neighbours(x, w)
    return F.coalesce((F.col(x) == 0) & (first | F.coalesce(prev == 0, F.lit(False))) & (last | F.coalesce(nxt == 0, F.lit(False))), F.lit(False))


def strip_zero_runs(df: DataFrame, key: str, pos: str, x: str) -> DataFrame:
    return df.withColumn("_drop", is_zero_run(x, in_order(key, pos))).where("not _drop").drop("_drop")


def is_zero_pair(x: str, w: WindowSpec) -> Column:
    """A zero next to a zero."""
    prev, nxt, _, _ = _neighbours(x, w)
    return F.coalesce((F.col(x) == 0) & (F.coalesce(prev == 0, F.lit(False)) | F.coalesce(nxt == 0, F.lit(False))), F.lit(False))


def null_mark(df: DataFrame, key: str, pos: str, x: str, also: list[str]) -> DataFrame:
    """Value and coordinates null where zeros are paired."""
    marked = df.withColumn("_pair", is_zero_pair(x, in_order(key, pos)))
    return marked.withColumns({c: F.when(~F.col("_pair"), F.col(c)) for c in [x, *also]}).drop("_pair")


def nulls_as_zero(df: DataFrame, *columns: str) -> DataFrame:
    """What the read of an entity gives for null values other than coordinates."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in columns})


def deltas(df: DataFrame, key: str, pos: str, x: str, name: str = "delta") -> DataFrame:
    return df.withColumn(name, F.col(x) - F.lag(x).over(in_order(key, pos)))


def delta_encode(df: DataFrame, key: str, pos: str, x: str, name: str = "encoded") -> DataFrame:
    """Null-aware deltas: absolute after a null, nulls pass; a first row that isn't null is left to the start value."""
    w = in_order(key, pos)
    prev, _, first, _ = _neighbours(x, w)
    return df.withColumn(name, F.when(F.col(x).isNull(), None).when(prev.isNull(), F.col(x)).otherwise(F.col(x) - prev)).withColumn("_skip", first & F.col(x).isNotNull()).where("not _skip").drop("_skip")


def delta_decode(df: DataFrame, key: str, pos: str, encoded: str, start: str, name: str = "decoded") -> DataFrame:
    """Values from null-aware deltas by a running sum per stretch between nulls; start is the entity's first value.

    The stretch before the first null runs on from start; every later one begins with an absolute value.
    """
    w = in_order(key, pos)
    stretch = df.withColumn("_s", F.sum(F.col(encoded).isNull().cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    inside = W.partitionBy(key, "_s").orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    value = F.sum(encoded).over(inside) + F.when(F.col("_s") == 0, F.col(start)).otherwise(0.0)
    return stretch.withColumn(name, F.when(F.col(encoded).isNotNull(), value)).drop("_s")


def run_ids(df: DataFrame, key: str, pos: str, x: str, name: str = "run_id") -> DataFrame:
    """Numbers for the stretches of equal values (nulls equal)."""
    w = in_order(key, pos)
    changed = F.when(F.lag(F.lit(1)).over(w).isNull(), 0).otherwise((~F.lag(x).over(w).eqNullSafe(F.col(x))).cast("int"))
    return df.withColumn("_c", changed).withColumn(name, F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_c")


def chunk_ids(df: DataFrame, key: str, pos: str, x: str, width: float, name: str = "chunk_id") -> DataFrame:
    """Chunks of a given width over ascending values, null-aware; only an entity's last chunk may have one row.

    Bins closed on the right from the first value on. A value in a later bin opens a chunk, or, with nulls
    behind it, closes one: of a run of nulls the last opens the next chunk and the others stay with the value
    before them. A cut that would leave one row alone is passed over. Nulls before the first value are in the
    first chunk. What a cut does depends on the cuts before it, so the rows pass in order through a loop
    that holds one row back.
    """
    fields = df.schema
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entity, first, chunk, level, offset, at = object(), None, 0, 0, 0, 0
        # held: nothing, a value in a later bin, a null behind such a value, or another null
        held = ""
        carry: pa.Table | None = None
        ids: list[int] = []

        def release(opens: bool, place: int) -> None:
            nonlocal chunk, offset
            if opens:
                chunk, offset = chunk + 1, place
            ids.append(chunk)

        for batch in batches:
            keys, values = batch.column(fields.names.index(key)).to_pylist(), batch.column(fields.names.index(x)).to_pylist()
            for k, v in zip(keys, values):
                if k != entity:
                    if held:
                        release(held in ("value", "behind") and at - 1 - offset != 1, at - 1)
                    entity, first, chunk, level, offset, at, held = k, None, 0, 0, 0, 0, ""
                if v is None:
                    if held:
                        ids.append(chunk)
                    held = "behind" if held in ("value", "behind") else "null"
                else:
                    v = float(v)
                    if first is None:
                        first = v
                    in_bin = max(0, ceil((v - first) / width) - 1)
                    if held in ("value", "behind"):
                        release(at - 1 - offset != 1, at - 1)
                    elif held == "null":
                        release(in_bin > level, at - 1)
                        level = max(level, in_bin)
                    held = "value" if in_bin > level else ""
                    level = max(level, in_bin)
                    if not held:
                        ids.append(chunk)
                at += 1
            rows = pa.Table.from_batches([batch])
            rows = rows if carry is None else pa.concat_tables([carry, rows])
            n = len(ids)
            carry = rows.slice(n)
            yield from rows.slice(0, n).append_column(name, pa.array(ids, pa.int64())).combine_chunks().to_batches()
            ids.clear()
        if held:
            release(held in ("value", "behind") and at - 1 - offset != 1, at - 1)
            yield from carry.append_column(name, pa.array(ids, pa.int64())).combine_chunks().to_batches()

    ordered = df.repartition(parts, key).sortWithinPartitions(key, pos)
    return ordered.mapInArrow(cut, T.StructType([*fields, T.StructField(name, T.LongType())]))


def null_segments(df: DataFrame, key: str, pos: str, x: str, name: str = "segment") -> DataFrame:
    """Stretches between nulls. Of a run of nulls the first closes a stretch and the last opens the next, so those
    between them stand alone; a null between two values only closes one, and the value behind it opens the next."""
    w = in_order(key, pos)
    before, before_that = F.lag(x).over(w), F.lag(x, 2).over(w)
    there = F.lag(F.lit(1)).over(w).isNotNull()
    opens = (there & F.col(x).isNull() & before.isNull()) | (there & F.col(x).isNotNull() & before.isNull() & before_that.isNotNull())
    return df.withColumn("_o", opens.cast("int")).withColumn(name, F.sum("_o").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_o")


def fill_nulls(df: DataFrame, key: str, pos: str, x: str, model: Column | None = None, name: str = "filled") -> DataFrame:
    """Null coordinates from their stretch: its edge value less or plus its second median step; alone, the model's step.

    model: the step predicted at a single value, an expression on ``_edge``; without one a single value
    leaves its nulls. The second median is the median of the steps up to the median.
    """
    seg = null_segments(df, key, pos, x, "_seg")
    whole, w = W.partitionBy(key, "_seg"), W.partitionBy(key, "_seg").orderBy(pos)
    steps = seg.withColumn("_d", F.col(x) - F.lag(x).over(w))
    once = steps.withColumn("_m1", F.percentile("_d", 0.5).over(whole))
    stats = once.withColumn("_m2", F.percentile(F.when(F.col("_d") <= F.col("_m1"), F.col("_d")), 0.5).over(whole)).withColumns({
        "_n": F.count(x).over(whole), "_lo": F.first(x, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
        "_hi": F.last(x, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
        "_before": F.count(x).over(w.rowsBetween(W.unboundedPreceding, 0)) == 0,
    })
    edged = stats.withColumn("_edge", F.when(F.col("_before"), F.col("_lo")).otherwise(F.col("_hi")))
    step = F.when(F.col("_n") > 1, F.col("_m2")).otherwise(F.lit(None).cast("double") if model is None else model)
    value = F.coalesce(F.col(x), F.when(F.col("_before"), F.col("_edge") - step).otherwise(F.col("_edge") + step))
    return edged.withColumn(name, value).drop("_seg", "_d", "_m1", "_m2", "_n", "_lo", "_hi", "_before", "_edge")
