"""Inputs that the smallest tables don't show: every row, nulls in any column, long chains."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slabworks.functions import params
from slabworks.operators import chunks as C
from slabworks.operators import digest, nested, signal
from slabworks.operators import units as U
from slabworks.plans import reference_queries
from slabworks.session import table


def test_value_text_of_every_slot(spark, sf):
    slots = [(5, 2.5, "s", True), (None, 2.5, "s", True), (None, -0.0, None, None), (None, 1e-300, None, None), (None, 1.25e7, None, None), (None, float("nan"), "s", None), (None, float("-inf"), None, None), (None, None, "s", True), (None, None, None, False), (None, None, None, None), None]
    df = spark.createDataFrame(list(enumerate(slots)), "i int, value struct<integer:bigint,float:double,string:string,boolean:boolean>")
    told = [r.text for r in df.orderBy("i").select(params.value_text(F.col("value")).alias("text")).collect()]
    assert told == ["5", "2.5", "-0.0", "1.0E-300", "1.25E7", "NaN", "-Infinity", "s", "false", None, None]

    def same(v, text):
        first = next((x for x in (v or ()) if x is not None), None)
        return float(text) == first if isinstance(first, float) else text == (str(first).lower() if isinstance(first, bool) else None if first is None else str(first))

    rows = table(spark, sf, "spectrum_parameter").select("param_id", "value").collect()
    got = reference_queries.QUERIES["param_value_text"](spark, sf).collect()
    values = {}
    for r in rows:
        values.setdefault(r.param_id, []).append(tuple(r.value) if r.value is not None else None)
    either = lambda v, r: same(v, r.text if r.number is None else str(r.number)) or (v is not None and v[1] is not None and v[1] != v[1])
    assert len(got) == len(rows) and all(any(either(v, r) for v in values[r.param_id]) for r in got)
    assert sum(v[1] is not None for vs in values.values() for v in vs if v) > len(rows) / 3


def chunk_starts(v, width):
    """The rows that open a chunk, by a loop over places that steps over nulls."""
    first = next((x for x in v if x is not None), None)
    if first is None:
        return [0]
    starts, k, i, n = [0], 1, 0, len(v)
    while i < n:
        at = v[i]
        if at is not None and at > first + k * width:
            while i + 1 < n and v[i + 1] is None:
                i += 1
            if i - starts[-1] != 1:
                starts.append(i)
        elif at is None and i + 1 < n and v[i + 1] is not None:
            at = v[i + 1]
            if at > first + k * width:
                starts.append(i)
            else:
                i += 1
        while at is not None and first + k * width < at:
            k += 1
        i += 1
    return starts


def marked_lists(n, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        v, most = [], r.choice([0.1, 0.4, 0.7])
        for x in sorted(r.sample(range(1, 61), r.randint(1, 14))):
            v += [float(x)] + [None] * (r.random() < most and r.choice([1, 2, 2, 2, 3]))
        out.append([None] * r.choice([0, 0, 1, 2]) + v)
    return [*out, [None], [None, None, None], [5.0], [None, 5.0], [5.0, None], [None, None, 5.0, 50.0], [1.0, 50.0, None, None, 51.0], [1.0, None, None, 50.0, None, None, 99.0, None]]


def test_null_aware_chunks_as_the_loop(spark):
    lists = marked_lists(400, 3)
    df = spark.createDataFrame([(k, i, x) for k, v in enumerate(lists) for i, x in enumerate(v)], "index bigint, pos bigint, x double")
    got = {(r["index"], r.pos): r.chunk_id for r in signal.chunk_ids(df, "index", "pos", "x", 5.0).collect()}
    for k, v in enumerate(lists):
        assert [i for i in range(len(v)) if i == 0 or got[k, i] != got[k, i - 1]] == chunk_starts(v, 5.0), v
        assert got[k, 0] == 0 and len(v) == sum(a == k for a, _ in got)


def test_null_aware_chunks_over_many_batches(spark):
    lists = marked_lists(60, 4)
    df = spark.createDataFrame([(k, i, x) for k, v in enumerate(lists) for i, x in enumerate(v)], "index bigint, pos bigint, x double")
    want = {tuple(r) for r in signal.chunk_ids(df, "index", "pos", "x", 5.0).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert {tuple(r) for r in signal.chunk_ids(df, "index", "pos", "x", 5.0).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("encoding", [C.PLAIN, C.DELTA, C.NUMPRESS_LINEAR])
def test_null_marked_points_come_back(spark, encoding):
    lists = marked_lists(200, 5)
    df = spark.createDataFrame([(k, i, x, float(i)) for k, v in enumerate(lists) for i, x in enumerate(v)], "index bigint, pos bigint, mz double, intensity double")
    coded = C.encode_chunks(df, 5.0, encoding)
    back = {}
    for r in C.decode_chunks(coded).orderBy("index", "chunk_id", "place").collect():
        back.setdefault(r["index"], []).append((r.mz, r.intensity))
    for k, v in enumerate(lists):
        assert [y for _, y in back[k]] == list(range(len(v)))
        assert [x is None for x, _ in back[k]] == [x is None for x in v] and [x for x, _ in back[k] if x is not None] == pytest.approx([x for x in v if x is not None], abs=1e-4)
    near = C.extract_from_chunks(coded, 19.5, 40.5).count()
    assert near == sum(x is not None and 20 <= x <= 40 for v in lists for x in v)


def test_deltas_behind_nulls_are_absolute(spark):
    df = spark.createDataFrame([(0, i, x, 0.0) for i, x in enumerate([None, 10.0, 10.5, None, None, 12.0])] + [(1, i, x, 0.0) for i, x in enumerate([10.0, None, None, 12.0])], "index bigint, pos bigint, mz double, intensity double")
    rows = {r["index"]: r for r in C.encode_chunks(df, 50.0).collect()}
    assert rows[0].mz_chunk_values == [None, 10.0, 0.5, None, None, 12.0] and rows[1].mz_chunk_values == [None, None, 12.0]
    assert all((r.mz_chunk_start, r.mz_chunk_end) == (10.0, 12.0) for r in rows.values())


def test_numpress_keeps_second_differences_in_range():
    for k in range(2, 200):
        v = np.array([0, 0x7FFFFFFF / 2 / k, 0, 0x7FFFFFFF / 2 / k])
        back = C.linear_decode(C.linear_encode(v))
        assert np.abs(np.nan_to_num(back) - v).max() <= 1 + v.max() * 1e-6


def test_children_of_records_without_loaded_at(spark):
    P = "struct<value:struct<integer:bigint,float:double,string:string,boolean:boolean>,accession:string,name:string,unit:string>"
    p = lambda i: ((i, None, None, None), None, None, None)
    s = spark.createDataFrame([(1, [p(1)], None, None), (1, [p(1)], None, None), (2, [p(2)], None, None), (2, [p(3), p(4)], None, "2025")], f"spectrum_key bigint, parameters array<{P}>, auxiliary_arrays array<struct<data:array<smallint>,parameters:array<{P}>>>, loaded_at string")
    i = spark.createDataFrame([(9, [p(5)], None)], f"ion_id bigint, parameters array<{P}>, loaded_at string")
    found = nested.parameter_table(nested.run_children(s, i, with_record=True)).collect()
    assert sorted((r.owner_table, r.owner_id, r.value_integer) for r in found) == [("selected_ion", 9, 5), ("spectrum", 1, 1), ("spectrum", 2, 3), ("spectrum", 2, 4)]


def test_labels_are_told_along_a_chain_of_attributes(spark):
    ms = "UO:0000028"
    units = spark.createDataFrame(
        [("UO:0000010", "s", "second", "duration", 1.0, 0.0), (ms, "ms", "millisecond", "duration", 1e-3, 0.0), ("UO:0000031", "min", "minute", "duration", 60.0, 0.0)],
        "unit_curie string, symbol string, unit_name string, quantity_kind string, to_base_factor double, to_base_shift double",
    )
    names = ["ms", "msec", "msecs", "millisec", "millisecs", "millis"]
    q = [float(x) for x in range(100, 1000, 100)]
    rows = [(f"A{i}", ms, label, 1000, q) for i in range(len(names) - 1) for label in names[i : i + 2]]
    stats = spark.createDataFrame(rows, "attribute string, common_unit string, label string, n bigint, q array<double>")
    told = {r.label: r.unit for r in U.resolve_labels(stats, units).collect()}
    assert {n: told.get(n) for n in names} == dict.fromkeys(names, ms)


def test_values_of_records_without_loaded_at_are_counted(spark):
    at = dt.datetime(2025, 3, 1)
    s = spark.createDataFrame([(1, "r", 0, 1, 10.0, None), (1, "r", 0, 1, 10.0, None), (2, "r", 1, 1, 20.0, None), (2, "r", 1, 1, 30.0, at)], "spectrum_key bigint, run_id string, spectrum_index bigint, ms_level int, total_ion_current double, loaded_at timestamp")
    i = spark.createDataFrame([(9, "r", 0, 5.0, None)], "ion_id bigint, run_id string, spectrum_index bigint, intensity double, loaded_at timestamp")
    v = digest.run_values(s, i)
    day = dt.date(2025, 3, 1)
    assert {(r.field_name, r.day, r.value) for r in v.collect()} == {("total_ion_current", None, 10.0), ("total_ion_current", day, 30.0), ("intensity", None, 5.0)}
    told = digest.percentiles(v, digest.daily_digests(v), digest.DAY_KEYS).where("quantile = 0.5").collect()
    assert {(r.field_name, r.day, r.n, r.value) for r in told} == {("total_ion_current", None, 1, 10.0), ("total_ion_current", day, 1, 30.0), ("intensity", None, 1, 5.0)}


def test_member_kinds_under_any_spelling(spark, tmp_path):
    said = ['{"name": "a", "data_kind": "peaks", "entity_type": "spectrum"}', '{"fileName": "b", "dataKind": " Peaks ", "entityType": "chromatogram"}', '{"file_name": "c", "kind": "metadata", "entity": "spectrum"}', '{"name": "d", "data-kind": "data arrays", "entity_type": null}', "{"]
    rows = [("file_entry", "f", 1, "x", i, line, None) for i, line in enumerate(said)]
    lines = spark.createDataFrame(rows + rows[1:2], "record_kind string, feed_id string, file_seq bigint, file_id string, line_no bigint, raw_json string, loaded_at timestamp")
    lines.write.parquet(f"{tmp_path}/archive_line.parquet")
    got = sorted(tuple(r) for r in reference_queries.QUERIES["member_kinds"](spark, str(tmp_path)).collect())
    assert got == [("a", "peaks", "spectrum"), ("b", "peaks", "chromatogram"), ("c", "metadata", "spectrum"), ("d", "data arrays", "other")]


def test_empty_columns_of_the_whole_table(spark, sf):
    ions = table(spark, sf, "selected_ion")
    rows = ions.collect()
    got = reference_queries.QUERIES["drop_all_null_columns"](spark, sf)
    assert got.columns == [c for c in ions.columns if any(r[c] is not None for r in rows)] and "charge_state" in got.columns and got.count() == len(rows)
