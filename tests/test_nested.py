import json
import random

import numpy as np
import pytest

from slabworks.operators import nested as N


def brute(texts, path, hollow):
    def filled(x):
        return any(map(filled, x.values())) if isinstance(x, dict) else any(map(filled, x)) if isinstance(x, list) else x is not None

    out = []
    for i, t in enumerate(texts):
        level = [((), json.loads(t))] if t else []
        for k in path:
            level = [((*p, n), e) for p, x in level if isinstance(x, dict) and isinstance(x.get(k), list) for n, e in enumerate(x[k])]
        out += [(i, p) for p, e in level if e is not None and (hollow or filled(e))]
    return out


def run(texts, path, hollow):
    raw = [t.encode() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    buf = np.frombuffer(b"".join(raw), dtype=np.uint8).copy()
    got = N.children(N.StructuralIndex(buf, starts) if len(buf) else None, path, hollow)
    spans = [b"".join(raw)[a:b].decode() for a, b in zip(got["head"], got["stop"])]
    return [(int(r), tuple(int(x) for x in p)) for r, p in zip(got["row"], got["places"].T)], spans


def value(r, depth):
    k = r.random()
    if depth == 0 or k < 0.4:
        return r.choice([None, 1, -2.5, True, "", 'a "q" \\', "p\\\\", "[{,:}]", "é{", {}, []])
    if k < 0.7:
        return [value(r, depth - 1) for _ in range(r.randint(0, 3))]
    return {r.choice(["parameters", "aux", "parametersx", "x\"parameters", "a"]): value(r, depth - 1) for _ in range(r.randint(0, 3))}


@pytest.mark.parametrize("path", [("parameters",), ("aux", "parameters")])
@pytest.mark.parametrize("blank", [None, (", ", ": "), (",\n ", " : ")])
def test_same_as_a_parser(path, blank):
    r = random.Random(5)
    texts = ["" if r.random() < 0.1 else json.dumps({k: value(r, 4) for k in r.sample(["parameters", "aux", "z"], r.randint(0, 3))}, ensure_ascii=False, separators=blank or (",", ":")) for _ in range(1500)]
    for hollow in (True, False):
        got, spans = run(texts, path, hollow)
        assert sorted(got) == sorted(brute(texts, path, hollow))
        for s in spans:
            json.loads(s)


def test_damaged_texts_raise_nothing():
    r = random.Random(7)
    good = json.dumps({"parameters": [{"a": 1}, None, {"a": "x"}]})
    for _ in range(300):
        cut = good[: r.randint(0, len(good))] + r.choice(["", "}", "]", '"', "\\"])
        run([cut, good, "", cut], ("parameters",), True)


def test_run_tables(spark):
    from slabworks.functions import params  # noqa: F401

    p = lambda i=None, a=None: ((i, None, None, None), a, None, None)
    P = "struct<value:struct<integer:bigint,float:double,string:string,boolean:boolean>,accession:string,name:string,unit:string>"
    aux = f"array<struct<data:array<smallint>,name:{P},data_type:string,parameters:array<{P}>>>"
    s = spark.createDataFrame(
        [(1, [p(1), None, p(), (None, None, "n", None)], [([1], None, None, None), None, ([], None, None, [None, p(2), p()]), (None, None, None, [])], "2025"), (1, [p(1), None, p(), (None, None, "n", None)], [([1], None, None, None), None, ([], None, None, [None, p(2), p()]), (None, None, None, [])], "2024"), (2, None, [], "2025"), (3, [], None, "2025")],
        f"spectrum_key bigint, parameters array<{P}>, auxiliary_arrays {aux}, loaded_at string",
    )
    i = spark.createDataFrame([(9, [p(), p(5)], "2025")], f"ion_id bigint, parameters array<{P}>, loaded_at string")
    found = N.run_children(s, i, with_record=True)
    assert {tuple(r)[:5] for r in found.collect()} == {
        ("spectrum", 1, "parameters", 0, -1), ("spectrum", 1, "parameters", 3, -1), ("spectrum", 1, "auxiliary_arrays", 0, -1), ("spectrum", 1, "auxiliary_arrays", 2, -1), ("spectrum", 1, "auxiliary_arrays", 3, -1),
        ("spectrum", 1, "auxiliary_arrays.parameters", 2, 1), ("selected_ion", 9, "parameters", 1, -1),
    }
    assert {r.value_integer for r in N.parameter_table(found).collect()} == {1, None, 2, 5}
    assert N.run_children(s.limit(0), i.limit(0)).count() == 0
    assert '"data":[1]' not in str(found.collect()) and '"data":[1]' in str(N.run_children(s, i, with_record=True, payload=True).collect())


def test_batches_are_cut_by_bytes(spark, monkeypatch):
    rows = [(k, json.dumps({"parameters": [{"a": k}, None, {"b": "x" * (k % 7) * 40}]}) if k % 5 else None) for k in range(200)]
    df = spark.createDataFrame(rows, "key bigint, json string").coalesce(1)
    want = {tuple(r) for r in N.flatten(df, "key", "json", "t", [("parameters",)], with_record=True).collect()}
    monkeypatch.setattr(N, "BATCH_BYTES", 100)
    part = N.flatten(df, "key", "json", "t", [("parameters",)], with_record=True)
    assert {tuple(r) for r in part.collect()} == want and len(want) == 320


def test_later_deliveries_without_a_column_take_nothing_away(spark):
    P = "struct<value:struct<integer:bigint,float:double,string:string,boolean:boolean>,accession:string,name:string,unit:string>"
    p = lambda i: ((i, None, None, None), None, None, None)
    s = spark.createDataFrame(
        [(1, [p(1)], [([1], [p(2)])], "2024"), (1, None, None, "2025"), (2, [p(3)], [([2], None)], "2024"), (2, [p(4)], None, "2025"), (3, [p(5)], [([3], None)], "2024"), (3, [], [], "2025")],
        f"spectrum_key bigint, parameters array<{P}>, auxiliary_arrays array<struct<data:array<smallint>,parameters:array<{P}>>>, loaded_at string",
    )
    i = spark.createDataFrame([(9, [p(6)], "2024"), (9, None, "2025")], f"ion_id bigint, parameters array<{P}>, loaded_at string")
    found = N.run_children(s, i, with_record=True)
    assert sorted((r.owner_table, r.owner_id, r.field_path, r.value_integer) for r in N.parameter_table(found).collect()) == [
        ("selected_ion", 9, "parameters", 6), ("spectrum", 1, "auxiliary_arrays.parameters", 2), ("spectrum", 1, "parameters", 1), ("spectrum", 2, "parameters", 4),
    ]
    assert sorted(r.owner_id for r in found.where("field_path = 'auxiliary_arrays'").collect()) == [1, 2]


def test_arrays_come_out_with_their_data(spark):
    P = "struct<value:struct<integer:bigint,float:double,string:string,boolean:boolean>,accession:string,name:string,unit:string>"
    p = lambda s: ((None, None, s, None), "MS:1", None, "u")
    aux = f"array<struct<data:array<smallint>,name:{P},data_type:string,compression:string,unit:string,parameters:array<{P}>,data_processing_ref:string>>"
    s = spark.createDataFrame(
        [(1, None, [([1, None, -32768], p('"data":[7]'), "f", "z", "m", [p("x")], "dp"), None, ([], None, None, None, None, None, None), (None,) * 7], "2025")],
        f"spectrum_key bigint, parameters array<{P}>, auxiliary_arrays {aux}, loaded_at string",
    )
    i = spark.createDataFrame([], f"ion_id bigint, parameters array<{P}>, loaded_at string")
    got = {r.pos_outer: r for r in N.array_table(N.run_children(s, i, with_record=True, payload=True)).collect()}
    assert {k: r.data for k, r in got.items()} == {0: [1, None, -32768], 2: [], 3: None}
    assert (got[0].name_string, got[0].name_accession, got[0].name_unit, got[0].data_type, got[0].compression, got[0].unit, got[0].data_processing_ref) == ('"data":[7]', "MS:1", "u", "f", "z", "m", "dp")
