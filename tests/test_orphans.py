import datetime as dt

from slabworks.operators import orphans as O

S = "spectrum_key bigint, run_id string, spectrum_index bigint, data_procesing_ref string, loaded_at timestamp, deleted_at timestamp, key string"
I = "ion_id bigint, run_id string, spectrum_index bigint, precursor_index bigint, loaded_at timestamp"
D = "dp_id string, loaded_at timestamp, deleted_at timestamp"
day = lambda n: dt.datetime(2025, 3, n)


def case(spark, max_heavy, few=O.FEW_GROUPS):
    spectra = [(1, "a", 0, " DP-x ", day(2), None, "k"), (1, "a", 0, " DP-x ", day(5), None, "k"), (2, "a", 1, "dp-gone", day(2), None, None), (3, "a", 2, "dp_x", day(2), day(9), None), (4, "a", 3, "dp-late", day(2), None, None), (5, "b", 0, None, day(8), None, None), (6, "b", 1, "  ", day(2), None, None)]
    ions = [(10, "a", 0, 1, day(3)), (11, "a", 2, None, day(3)), (12, "a", 7, -1, day(3)), (13, "b", 0, 0, day(3)), (13, "b", 0, 0, day(9)), (14, "b", 0, 1, day(8)), (15, None, 0, None, day(3)), (16, "a", None, None, day(3))]
    ions += [(100 + i, "a", 2, None, day(4)) for i in range(40)]
    dps = [("dp-X", day(1), None), ("dp-gone", day(1), day(20)), ("dp-late", day(3), None)]
    s, i, d = spark.createDataFrame(spectra, S), spark.createDataFrame(ions, I), spark.createDataFrame(dps, D)
    found = {(r.field_name, r.row_id): r.reason for r in O.run_orphans(s, i, d, max_heavy, few).collect()}
    counts = {}
    for r in O.run_orphan_counts(s, i, d, max_heavy).collect():
        counts[r.field_name, r.reason] = counts.get((r.field_name, r.reason), 0) + r.n_orphans
    assert counts == {k: sum((f, x) == k for (f, _), x in found.items()) for k in {(f, x) for (f, _), x in found.items()}}
    return found


WANT = {("data_procesing_ref", 2): "deleted", ("data_procesing_ref", 3): "missing", ("data_procesing_ref", 4): "later", ("spectrum_index", 11): "deleted", ("spectrum_index", 12): "missing",
        ("spectrum_index", 13): "later", ("precursor_index", 13): "later", ("spectrum_index", 15): "missing"} | {("spectrum_index", 100 + i): "deleted" for i in range(40)}


def test_reasons(spark):
    assert case(spark, 2000) == WANT


def test_heavy_keys_give_the_same(spark):
    assert case(spark, 4) == WANT  # more than 25 rows make a key heavy
    assert case(spark, 4, few=0) == WANT  # groups too many to be broadcast
    assert case(spark, 2000, few=0) == WANT


def test_groups_that_are_orphans_in_part(spark):
    at = lambda h: dt.datetime(2025, 3, 4, h)
    s = spark.createDataFrame([(1, "a", 0, None, at(12), None, ""), (2, "a", 1, None, None, None, "")], S)
    i = spark.createDataFrame([(10, "a", 0, None, at(11)), (11, "a", 0, None, at(12)), (12, "a", 0, None, at(13)), (13, "a", 0, None, None), (14, "a", 1, None, at(1)), (15, None, 0, None, at(13))], I)
    d = spark.createDataFrame([], D)
    assert {(r.row_id, r.reason) for r in O.run_orphans(s, i, d).collect()} == {(10, "later"), (15, "missing")}
    assert {(r.reason, r.n_orphans) for r in O.run_orphan_counts(s, i, d).collect()} == {("later", 1), ("missing", 1)}


def test_empty(spark):
    assert O.run_orphans(spark.createDataFrame([], S), spark.createDataFrame([], I), spark.createDataFrame([], D)).count() == 0
