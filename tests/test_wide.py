from slabworks.operators import wide as W

P = "param_id bigint, run_id string, spectrum_index bigint, accession string, name string, value struct<integer:bigint,float:double,string:string,boolean:boolean>, unit string, loaded_at string"
A = [("MS:1", "dwell time", "double", None, "spectrum"), ("MS:0000002", "scan count", "int", None, "spectrum"), ("LX:0000003", "lock found", "boolean", None, "spectrum"), ("LX:0000004", "title", "string", None, "spectrum"), ("LX:0000005", "oven", "double", None, "run")]


def test_cells(spark):
    v = lambda i=None, f=None, s=None, b=None: (i, f, s, b)
    rows = [
        (2, "r", 0, "ms_2", "x", v(s="4"), None), (1, "r", 0, "MS:0000002", "scan count", v(s="n/a"), None), (3, "r", 0, None, "Dwell_Time (ms)", v(s="1,5 ms"), None), (4, "r", 0, "LX:0000003", "lock found", v(s="No"), None),
        (5, "r", 1, "LX:0000004", "title", v(s="  "), None), (6, "r", 1, "LX:0000004", "title", v(s=" a b "), None), (7, "r", 1, "LX:0000004", "title", v(s="later"), None), (8, "r", 2, "LX:0000003", "lock found", v(i=3), None),
        (9, None, 2, "LX:0000003", "lock found", v(b=True), None), (10, "r", None, "LX:0000003", "lock found", v(b=True), None), (11, "s", 0, "LX:0000003", "lock found", v(i=1), None), (11, "s", 0, "LX:0000003", "lock found", v(i=1), None),
        (12, "s", 0, "LX:0000005", "oven", v(f=1.0), None), (13, "s", 0, "ZZ:7", "title", v(s="t"), None), (14, "s", 0, "LX:0000004", "title", None, None), (15, "s", 0, "MS:0000002", "x", v(f=float("nan")), None),
    ]
    attrs = spark.createDataFrame(A, "accession string, attribute_name string, value_type string, common_unit string, owner_kind string")
    params = spark.createDataFrame([(*r, "now") for r in rows], P)
    w = {(r.run_id, r.spectrum_index): r for r in W.wide_table(params, attrs).collect()}
    assert set(w) == {("r", 0), ("r", 1), ("s", 0)}
    assert w["r", 0].scan_count == 4 and w["r", 0].dwell_time == 1.5 and w["r", 0].lock_found is False and w["r", 0].title is None
    assert w["r", 1].title == " a b " and w["s", 0].lock_found is True and w["s", 0].scan_count is None
    found = {tuple(r) for r in W.filled_cells(W.wide_table(params, attrs), W.attribute_columns(attrs)).collect()}
    assert found == {("r", 0, "MS:0000002"), ("r", 0, "MS:1"), ("r", 0, "LX:0000003"), ("r", 1, "LX:0000004"), ("s", 0, "LX:0000003")}


def test_ordinals_are_unique_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        attrs = spark.createDataFrame(A, "accession string, attribute_name string, value_type string, common_unit string, owner_kind string")
        rows = [(i, f"r{i % 3}", i // 6, a, "n", (i, None, None, None), None, "") for i, a in enumerate(["MS:0000002", "MS:0000001"] * 300)]
        w = W.wide_table(spark.createDataFrame(rows, P), attrs).collect()
        assert len(w) == len({(r.run_id, r.spectrum_index) for r in w}) == len({r.entity_ordinal for r in w}) == 300
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_empty(spark):
    attrs = spark.createDataFrame(A, "accession string, attribute_name string, value_type string, common_unit string, owner_kind string")
    assert W.wide_table(spark.createDataFrame([], P), attrs).count() == 0
    assert W.wide_table(spark.createDataFrame([], P), attrs.limit(0)).count() == 0


def test_whole_numbers_are_exact(spark):
    attrs = spark.createDataFrame(A, "accession string, attribute_name string, value_type string, common_unit string, owner_kind string")
    v = lambda i=None, f=None, s=None: (i, f, s, None)
    values = [v(i=9007199254740993), v(s="9,007,199,254,740,993"), v(f=4.6), v(s="4.5 ms"), v(f=-4.5), v(s="99999999999999999999"), v(f=1e30), v(s="1e3"), v(s="9223372036854775807")]
    rows = [(i, "r", i, "MS:0000002", "scan count", x, None, "") for i, x in enumerate(values)]
    got = {r.spectrum_index: r.scan_count for r in W.wide_table(spark.createDataFrame(rows, P), attrs).collect()}
    assert got == {0: 9007199254740993, 1: 9007199254740993, 2: 5, 3: 5, 4: -5, 7: 1000, 8: 9223372036854775807}
