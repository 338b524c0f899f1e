import json

from slabworks.operators import drift as R

L = "feed_id string, file_seq int, file_id bigint, record_kind string, line_no int, raw_json string, loaded_at string"


def lines(spark, files, kind="selected_ion"):
    rows = [("f", seq, 100 + seq, kind, n, x if isinstance(x, str) or x is None else json.dumps(x), "") for seq, recs in files.items() for n, x in enumerate(recs)]
    return spark.createDataFrame(rows + rows[:2], L)


def test_changes(spark):
    files = {
        0: [{"spectrum_index": 1, "intensity": 2.0, "charge": None}, {"spectrum_index": 2, "intensity": 2.5}],
        1: [{"spectrumIndex": 1, "intensity": "2.0", "charge": 2}, '{"oops": ', None, "[1]", "7", ""],
        2: [{"source_index": 1.0, "intensity": None, "charge": 2, "lane_tag": "x"}],
        3: [{"source_index": 1.0, "intensity": 1.0, "charge": 2, "lane_tag": {"a": 1}}],
        5: [{"intensity": 1}],
    }
    got = {(r.file_seq, r.field_name, r.change_kind) for r in R.schema_changes(lines(spark, files)).collect()}
    assert got == {(1, "spectrum_index", "renamed"), (1, "intensity", "retyped"), (2, "spectrum_index", "renamed"), (2, "spectrum_index", "retyped"), (2, "lane_tag", "added"), (3, "lane_tag", "retyped")}


def test_file_without_good_lines(spark):
    got = {(r.field_name, r.change_kind) for r in R.schema_changes(lines(spark, {0: [{"intensity": 1.5}], 1: ["{"]})).collect()}
    assert got == {("intensity", "removed")}


def test_ingest_rescues_and_replays(spark):
    recs = [{"spectrum_idx": "7", "intensity": "1e3", "MS_1000041_charge_state": 2.0, "lane_tag": "b", "parameters": [{"a": 1}]}, {"spectrum_index": "seven", "intensity": None, "charge_state": 2.5}]
    a, b = sorted(R.ingest(lines(spark, {0: recs}), "selected_ion").collect(), key=lambda r: r.line_no)
    assert (a.spectrum_index, a.intensity, a.charge_state, a.parameters, json.loads(a._rescued)) == (7, 1000.0, 2, '[{"a":1}]', {"lane_tag": "b"})
    assert b.spectrum_index is None and b.intensity is None and json.loads(b._rescued) == {"spectrum_index": "seven", "charge_state": 2.5}
    first = sorted(R.ingest(lines(spark, {0: recs}), "selected_ion", replay=False).collect(), key=lambda r: r.line_no)[0]
    assert first.spectrum_index is None and set(json.loads(first._rescued)) == {"spectrum_idx", "MS_1000041_charge_state", "lane_tag"}


def test_empty(spark):
    e = spark.createDataFrame([], L)
    assert R.schema_changes(e).count() == 0 and R.ingest(e, "file_entry").count() == 0


def test_targets_and_approvals_are_the_callers(spark):
    files = {0: [{"depth": 1, "Colour": "red"}], 1: [{"deepness": "2", "hue": "x", "extra": None}]}
    rows = lines(spark, files, "rock")
    target, approved = {"depth": "int", "colour": "string"}, {"deepness": "depth"}
    got = sorted(R.ingest(rows, "rock", target, approved).collect(), key=lambda r: r.file_seq)
    assert [(r.depth, r.colour) for r in got] == [(1, "red"), (2, None)] and json.loads(got[1]._rescued) == {"hue": "x", "extra": None}
    told = {(r.field_name, r.change_kind) for r in R.schema_changes(rows, {"rock": target}, {"rock": approved}).collect()}
    assert told == {("depth", "renamed"), ("depth", "retyped"), ("colour", "removed"), ("hue", "added"), ("extra", "added")}
    # a kind nobody gave a target for is rescued whole and reported by its keys
    assert {(r.field_name, r.change_kind) for r in R.schema_changes(rows).collect()} == {("depth", "removed"), ("deepness", "added"), ("Colour", "removed"), ("hue", "added"), ("extra", "added")}


def test_the_first_good_delivery_counts(spark):
    rows = [("f", 0, 1, "selected_ion", 0, "{", "1"), ("f", 0, 1, "selected_ion", 0, '{"intensity": 1.0}', "2"), ("f", 0, 1, "selected_ion", 0, '{"intensity": 2.0}', "3"), ("f", 0, 1, "selected_ion", 1, '{"intensity": 3.0}', None), ("f", 0, 1, "selected_ion", 1, '{"intensity": 4.0}', "1")]
    got = sorted((r.line_no, r.intensity) for r in R.ingest(spark.createDataFrame(rows, L), "selected_ion").collect())
    assert got == [(0, 1.0), (1, 3.0)]
