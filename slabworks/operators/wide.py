"""Attribute-value rows as a wide table, by positional stitching.

Cells are reduced to one per (entity, attribute) with map-side combining; a range exchange on the
entity brings each entity's cells together, in order. Every range assigns its entities consecutive
ordinals (global: the range's number in the upper bits), writes each attribute as a typed column
aligned to those ordinals by scatter, and the columns are assembled by position, without a pivot or a
join per attribute.

Defined results: a cell is filled if a row has a usable value; of several the one with the lowest
param_id holds; an int attribute takes whole numbers exactly, rounds a fraction (halves away from zero)
and takes none beyond a bigint; placeholders, blanks and not-a-number are not usable; rows that belong to no attribute
are left out; an entity without any filled cell has no row; null run or index form no entity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slabworks.functions import params as P
from slabworks.session import small_side

ARROW = {"double": pa.float64(), "int": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
SPARK = {"double": T.DoubleType(), "int": T.LongType(), "boolean": T.BooleanType(), "string": T.StringType()}


def attribute_columns(attributes: DataFrame, owner_kind: str = "spectrum", most: int = 2000) -> list[tuple[str, str, str]]:
    """(accession, column name, type) of the attributes that become columns: a vocabulary, at most `most` of them."""
    rows = attributes.where(F.col("owner_kind") == owner_kind).select("accession", "attribute_name", "value_type").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} attributes can't become columns")
    return sorted((r.accession, "_".join(r.attribute_name.lower().split()), r.value_type) for r in rows)


def cells(params: DataFrame, columns: list[tuple[str, str, str]]) -> DataFrame:
    """One row per filled cell: (run_id, spectrum_index, slot, num, whole, flag, text); slot is the column's place."""
    spark = params.sparkSession
    by_accession = {accession_key(a): i for i, (a, _, _) in enumerate(columns)}
    by_name = {"".join(ch for ch in name if ch.isalnum()): i for i, (_, name, _) in enumerate(columns)}
    look = lambda table, c: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)
    if not columns:
        return spark.createDataFrame([], "run_id string, spectrum_index bigint, slot int, num double, whole bigint, flag boolean, text string")
    blank = P.filled(F.col("accession")).isNull()
    slot = F.when(blank, look(by_name, P.name_key(F.col("name")))).otherwise(look(by_accession, P.canonical_curie(F.col("accession"))))
    # each way to write accession and name is read once, not on every row
    said = params.select("accession", "name").distinct().select(F.col("accession").alias("w_accession"), F.col("name").alias("w_name"), slot.cast("int").alias("slot")).where("slot is not null")
    on = F.col("accession").eqNullSafe(F.col("w_accession")) & F.col("name").eqNullSafe(F.col("w_name"))
    rows = params.where("run_id is not null and spectrum_index is not null").select("run_id", "spectrum_index", "param_id", "value", "accession", "name").join(small_side(said), on)
    of_type = lambda *ts: F.col("slot").isin([i for i, c in enumerate(columns) if c[2] in ts])
    value = F.col("value")
    typed = rows.select(
        "run_id", "spectrum_index", "slot", "param_id",
        F.when(of_type("double"), P.number_of(value)).alias("num"), F.when(of_type("int"), P.whole_of(value)).alias("whole"),
        F.when(of_type("boolean"), P.boolean_of(value)).alias("flag"), F.when(of_type("string"), P.text_of(value)).alias("text"),
    ).where("num is not null or whole is not null or flag is not null or text is not null")
    best = F.min(F.struct("param_id", "num", "whole", "flag", "text")).alias("c")
    return typed.groupBy("run_id", "spectrum_index", "slot").agg(best).select("run_id", "spectrum_index", "slot", "c.num", "c.whole", "c.flag", "c.text")


def accession_key(accession: str) -> str:
    prefix, _, digits = accession.strip().upper().replace("_", ":").partition(":")
    return f"{prefix}:{digits.lstrip('0').rjust(7, '0')}"


def stitch(cell_rows: DataFrame, columns: list[tuple[str, str, str]]) -> DataFrame:
    """The wide table: entity_ordinal, run_id, spectrum_index and a typed column per attribute."""
    types = [c[2] for c in columns]
    schema = T.StructType(
        [T.StructField("entity_ordinal", T.LongType()), T.StructField("run_id", T.StringType()), T.StructField("spectrum_index", T.LongType())] + [T.StructField(c[1], SPARK[c[2]]) for c in columns]
    )
    names = schema.names

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ordinal = TaskContext.get().partitionId() << 33
        rest: pa.Table | None = None

        def emit(t: pa.Table, first: int) -> tuple[pa.RecordBatch, int]:
            run, index = t.column("run_id").combine_chunks(), t.column("spectrum_index").to_numpy()
            codes = run.dictionary_encode().indices.to_numpy()
            new = np.concatenate([[True], (codes[1:] != codes[:-1]) | (index[1:] != index[:-1])])
            at = np.cumsum(new) - 1  # ordinal of each cell's entity within this block
            n, slot = int(at[-1]) + 1, t.column("slot").to_numpy()
            head = pa.array(np.flatnonzero(new))
            out = [pa.array(np.arange(first, first + n)), run.take(head), pa.array(index).take(head)]
            for i, kind in enumerate(types):
                mine = np.flatnonzero(slot == i)
                where = np.full(n, -1, dtype=np.int64)
                where[at[mine]] = mine
                pick = pa.array(where, mask=where < 0)
                source = t.column({"double": "num", "int": "whole", "boolean": "flag", "string": "text"}[kind])
                out.append(source.combine_chunks().take(pick).cast(ARROW[kind]))
            return pa.RecordBatch.from_arrays(out, names=names), n

        for batch in batches:
            t = pa.Table.from_batches([batch])
            if rest is not None:
                t = pa.concat_tables([rest, t])
            if not t.num_rows:
                continue
            # the last entity may go on in the next batch; an entity has at most one cell per attribute
            run, index = t.column("run_id").combine_chunks(), t.column("spectrum_index").to_numpy()
            codes = run.dictionary_encode().indices.to_numpy()
            edge = np.flatnonzero((codes[1:] != codes[:-1]) | (index[1:] != index[:-1]))
            if not len(edge):
                rest = t
                continue
            cut = int(edge[-1]) + 1
            rest = t.slice(cut)
            done, n = emit(t.slice(0, cut), ordinal)
            ordinal += n
            yield done
        if rest is not None and rest.num_rows:
            yield emit(rest, ordinal)[0]

    parts = cell_rows.repartitionByRange("run_id", "spectrum_index").sortWithinPartitions("run_id", "spectrum_index")
    return parts.mapInArrow(assemble, schema)


def wide_table(params: DataFrame, attributes: DataFrame) -> DataFrame:
    columns = attribute_columns(attributes)
    return stitch(cells(params, columns), columns)


def filled_cells(wide: DataFrame, columns: list[tuple[str, str, str]]) -> DataFrame:
    """(run_id, spectrum_index, accession) of the cells that are filled."""
    each = F.array_compact(F.array(*[F.when(F.col(name).isNotNull(), F.lit(acc)) for acc, name, _ in columns])) if columns else F.array().cast("array<string>")
    return wide.select("run_id", "spectrum_index", F.explode(each).alias("accession"))


def empty_wide(spark: SparkSession, columns: list[tuple[str, str, str]]) -> DataFrame:
    return stitch(spark.createDataFrame([], "run_id string, spectrum_index bigint, slot int, num double, whole bigint, flag boolean, text string"), columns)
