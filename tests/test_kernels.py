"""Kernels on literal cases and against loops written from their definitions."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slabworks.operators import chunks as C
from slabworks.operators import extract, facets, models, signal


def seq(spark, *lists):
    return spark.createDataFrame([(k, i, None if v is None else float(v)) for k, xs in enumerate(lists) for i, v in enumerate(xs)] or [], "index bigint, pos bigint, x double")


def by_key(df, col):
    out = {}
    for r in df.orderBy("index", "pos").collect():
        out.setdefault(r["index"], []).append(r[col])
    return out


def test_zero_runs(spark):
    tails = [0] * 8 + [1, 2, 3, 2, 1] + [0] * 8 + [1, 2, 3, 2, 1] + [0] * 8
    kept = signal.strip_zero_runs(seq(spark, [0, 101, 101.01, 101.02, 0, 0, 0, 101.5, 0], tails, [None, 0, 0]), "index", "pos", "x")
    places = by_key(kept.withColumn("p", F.col("pos")), "p")
    assert places[0] == [0, 1, 2, 3, 4, 6, 7, 8]
    assert 5 not in places[1] and 6 not in places[1] and 27 not in places[1] and 7 in places[1] and 26 in places[1]


def strip_loop(xs):
    keep = []
    for i, v in enumerate(xs):
        z = v == 0
        before = i == 0 or xs[i - 1] == 0
        after = i == len(xs) - 1 or xs[i + 1] == 0
        if not (z and before and after):
            keep.append(i)
    return keep


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from([None, 0, 0, 0, 1, 2]), min_size=1, max_size=14), min_size=20, max_size=60))
def test_zero_runs_as_the_loop(spark, lists):
    got = by_key(signal.strip_zero_runs(seq(spark, *lists), "index", "pos", "x").withColumn("p", F.col("pos")), "p")
    assert all(got.get(k, []) == strip_loop(xs) for k, xs in enumerate(lists))


def test_fill_bounded_and_single(spark):
    n = None
    lists = [[n, 101, 101.01, 101.02, n, n, 101.5, n], [n, 101, 101.01, 101.02, n, n, 101.5], [101, 101.01, 101.02, n, n, 101.5], [n, n], []]
    got = by_key(signal.fill_nulls(seq(spark, *lists), "index", "pos", "x", model=F.lit(0.015)), "filled")
    assert got[0] == pytest.approx([100.99, 101, 101.01, 101.02, 101.03, 101.485, 101.5, 101.515])
    assert got[1] == pytest.approx([100.99, 101, 101.01, 101.02, 101.03, 101.485, 101.5])
    assert got[2] == pytest.approx([101, 101.01, 101.02, 101.03, 101.485, 101.5])
    assert got[3] == [None, None]


def test_segments_of_single_and_paired_nulls(spark):
    n = None
    cases = [
        ([n, 50.0, n], [0, 0, 0]), ([n, 50.0], [0, 0]), ([50.0, n, 50.2], [0, 0, 1]), ([50.0, 50.1, n, 50.2, n, 50.3, n], [0, 0, 0, 1, 1, 2, 2]), ([101.0, n], [0, 0]),
        ([101.0, 101.01, 101.02, n, n, 101.5], [0, 0, 0, 0, 1, 1]), ([n, 101.0, 101.01, 101.02, n, n, n, 101.5], [0, 0, 0, 0, 0, 1, 2, 2]),
    ]
    df = seq(spark, *[c for c, _ in cases])
    got = by_key(signal.null_segments(df, "index", "pos", "x"), "segment")
    assert [got[k] for k in range(len(cases))] == [want for _, want in cases]
    filled = by_key(signal.fill_nulls(df, "index", "pos", "x", model=F.lit(0.015)), "filled")
    assert filled[2] == pytest.approx([50.0, 50.015, 50.2]) and filled[0] == pytest.approx([49.985, 50.0, 50.015]) and filled[4] == pytest.approx([101.0, 101.015])


def test_delta_round_trip_with_nulls(spark):
    lists = [[1, 2, 4, None, 7, 9], [None, 3, 4, None, None, 8], [None], [5], [2, None, None, 3, 3]]
    df = seq(spark, *lists)
    start = df.groupBy("index").agg(F.coalesce(F.min_by("x", "pos"), F.lit(0.0)).alias("start"))
    enc = signal.delta_encode(df, "index", "pos", "x")
    dec = by_key(signal.delta_decode(enc.join(start, "index"), "index", "pos", "encoded", "start"), "decoded")
    assert all(dec.get(k, []) == (xs if xs[0] is None else xs[1:]) for k, xs in enumerate(lists))


def chunk_loop(v, width):
    """Boundaries at first + k * width, right-closed; a boundary that would leave one row alone is passed over."""
    starts, k = [0], 1
    for i in range(1, len(v)):
        if v[i] > v[0] + k * width:
            while v[i] > v[0] + k * width:
                k += 1
            if i - starts[-1] != 1:
                starts.append(i)
    return starts


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), min_size=1, max_size=14, unique=True).map(sorted), min_size=20, max_size=60))
def test_chunks_as_the_loop(spark, lists):
    got = by_key(signal.chunk_ids(seq(spark, *lists), "index", "pos", "x", 5.0), "chunk_id")
    for k, xs in enumerate(lists):
        starts = [i for i in range(len(xs)) if i == 0 or got[k][i] != got[k][i - 1]]
        assert starts == chunk_loop(xs, 5.0), xs


@pytest.mark.parametrize("encoding", [C.PLAIN, C.DELTA, C.NUMPRESS_LINEAR])
def test_chunk_round_trip(spark, encoding):
    v = np.cumsum(np.random.default_rng(2).random(400)) + 100
    pts = spark.createDataFrame([(1, i, float(x), float(i)) for i, x in enumerate(v)] + [(2, 0, 5.0, 1.0)], "index bigint, pos bigint, mz double, intensity double")
    back = C.decode_chunks(C.encode_chunks(pts, 10.0, encoding)).orderBy("index", "chunk_id", "place").collect()
    assert [r.mz for r in back if r["index"] == 1] == pytest.approx(v.tolist(), abs=1e-6) and [r.intensity for r in back if r["index"] == 1] == list(range(400))
    near = C.extract_from_chunks(C.encode_chunks(pts, 10.0, encoding), 120.0, 140.0).count()
    assert near == int(((v >= 120) & (v <= 140)).sum())


@given(st.lists(st.floats(-1e4, 1e4), max_size=60))
def test_numpress_linear(xs):
    v = np.array(xs)
    back = C.linear_decode(C.linear_encode(v))
    tol = max(np.abs(v).max() if len(v) else 0, np.abs(v[2:] - 2 * v[1:-1] + v[:-2]).max() if len(v) > 2 else 0) / 2**30 * max(1, len(v)) + 1e-9
    assert len(back) == len(v) and np.all(np.abs(np.nan_to_num(back) - v) <= tol)


@given(st.lists(st.integers(-(2**31), 2**31 - 1), max_size=60))
def test_half_bytes(xs):
    assert C._from_half_bytes(C._half_bytes(np.array(xs, dtype=np.int64))).tolist() == xs


@given(st.lists(st.floats(0, 1e6), max_size=60))
def test_slof(xs):
    back = C.slof_decode(C.slof_encode(np.array(xs)))
    assert np.all(np.abs(back - np.array(xs)) <= 1e-3 * (np.array(xs) + 1))


def test_auxiliary_arrays():
    import zlib

    raw = np.array([1.5, -2.0]).astype("<f8").tobytes()
    of = lambda *a: None if (v := C.decode_array(*a)) is None else list(v)
    assert of(list(raw), "MS:1000576", "MS:1000523") == [1.5, -2.0]
    assert of(list(zlib.compress(raw)), "MS:1000574", "MS:1000523") == [1.5, -2.0]
    assert of([b - 256 if b > 127 else b for b in raw], "MS:1000576", "MS:1000523") == [1.5, -2.0]
    assert of(list(b"ab\0c"), None, "MS:1001479") == ["ab", "c"]
    assert of(None, "MS:1000576", "MS:1000523") == [] and of([1, 2, 3], "MS:1000576", "MS:1000523") is None and of([1], "MS:1000574", "MS:1000523") is None and of([1], None, None) is None


@pytest.mark.parametrize("compression", ["MS:1000576", "MS:1000574"])
@pytest.mark.parametrize("data_type, values", [("MS:1000519", [1, -2, 2**31 - 1]), ("MS:1000522", [2**62 + 1, -5]), ("MS:1000521", [1.5, -0.25]), ("MS:1000523", [1e300, 0.1]), ("MS:1001479", ["a", "bc d"])])
def test_auxiliary_round_trip(compression, data_type, values):
    assert list(C.decode_array(list(C.encode_array(values, compression, data_type)), compression, data_type)) == values


def test_auxiliary_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 2.5]), (2, []), (3, None)], "k int, v array<double>")
    coded = df.select("k", C.encode_auxiliary(F.col("v"), "MS:1000574", "MS:1000523").alias("d"))
    got = {r.k: r.v for r in coded.select("k", C.decode_auxiliary("d", F.lit("MS:1000574"), F.lit("MS:1000523")).alias("v")).collect()}
    assert got[1].floats == [1.0, 2.5] and got[1].integers is None and got[2].floats == []
    assert {r.k: r.v.integers for r in df.where("k = 1").select("k", C.decode_auxiliary(F.expr("array(1S, 0S, 0S, 0S, -1S, -1S, -1S, -1S)"), F.lit(None).cast("string"), F.lit("MS:1000519")).alias("v")).collect()} == {1: [1, -1]}


def test_long_chunks_are_linear(spark):
    """32,000 points in one chunk: appending to a copy for every step took seconds."""
    import time

    pts = spark.range(32000).select(F.lit(1).cast("bigint").alias("index"), F.col("id").alias("pos"), (F.col("id") / 64.0).alias("mz"), F.when(F.col("id") % 9 > 0, F.col("id").cast("double")).alias("intensity"))
    for encoding in (C.DELTA, C.NUMPRESS_LINEAR):
        coded = C.encode_chunks(pts, 1e6, encoding, transforms={"intensity": C.NUMPRESS_PIC}).cache()
        assert coded.count() == 1
        began = time.time()
        got = C.decode_chunks(coded).agg(F.count("mz").alias("n"), F.sum("mz").alias("s"), F.sum("intensity").alias("i")).first()
        assert time.time() - began < 20 and got.n >= 31999 and got.s == pytest.approx(sum(range(32000)) / 64, rel=1e-6) and got.i == sum(i for i in range(32000) if i % 9)


CODECS = {"linear": (C.encode_linear, C.decode_linear, C.linear_encode, C.linear_decode), "slof": (C.encode_slof, C.decode_slof, C.slof_encode, C.slof_decode), "pic": (C.encode_pic, C.decode_pic, C.pic_encode, C.pic_decode)}


@pytest.mark.parametrize("codec", CODECS)
def test_many_lists_in_numpress_as_one_by_one(spark, codec, monkeypatch):
    """Null, empty, short and long lists in one batch, and damaged bytes among whole ones, which spoil only themselves."""
    import pyarrow as pa

    encode, decode, one_encoded, one_decoded = CODECS[codec]
    rng = np.random.default_rng(5)
    lists = [None if k % 17 == 3 else np.round(rng.random(k % 9 if k % 50 else k) * 1e4, k % 3).tolist() for k in range(300)]
    blobs = [None if v is None else one_encoded(np.array(v)) for v in lists]
    damaged = [b if b is None or k % 4 else b[: k % (len(b) + 1)] for k, b in enumerate(blobs)]
    want = [C._or_none(one_decoded, b) for b in damaged]
    want = [None if v is None else [None if np.isnan(x) else x for x in v.tolist()] for v in want]
    assert sum(v is None for v in want) > sum(v is None for v in lists)
    for at_once in (1 << 18, 10):
        monkeypatch.setattr(C, "AT_ONCE", at_once)
        assert encode.func(pa.array(lists, pa.list_(pa.float64()))).to_pylist() == blobs
        assert decode.func(pa.array(damaged, pa.binary())).to_pylist() == want
        assert decode.func(pa.array(damaged, pa.binary())[5:-4]).to_pylist() == want[5:-4]
        assert decode.func(pa.array([], pa.binary())).to_pylist() == []


WRITTEN = [
    "41547ae140000000b7f52820c97a14407121ea7410404a0778",
    "40b63c00000000000000952ffcff",
    "871ff6ff307111",
]


def test_numpress_bytes():
    """Bytes as they were written list by list."""
    assert C.linear_encode([100.5, 200.25, 300.0, 400.0, 123.25]).hex() == WRITTEN[0] and C.slof_encode([0.0, 7.5, 1e5]).hex() == WRITTEN[1] and C.pic_encode([0, 1, -1, 255, 70000]).hex() == WRITTEN[2]


def test_many_short_lists_in_numpress(spark):
    """40,000 lists of four through the three codecs: a few numpy calls for each list took a minute or so."""
    import time

    lists = spark.range(0, 40000, 1, 1).select(F.transform(F.array(*map(F.lit, range(4))), lambda i: 900.0 + (F.col("id") * 7919 + i * 104729) % 100000 / 100.0).alias("v"))
    back = lists.select("v", C.decode_linear(C.encode_linear("v")).alias("l"), C.decode_slof(C.encode_slof("v")).alias("s"), C.decode_pic(C.encode_pic("v")).alias("p"))
    near = lambda c, by: F.count_if(F.forall(F.zip_with("v", c, lambda a, b: F.abs(a - b) <= by), lambda ok: ok))
    lists.limit(1).select(C.encode_pic("v")).collect()  # starting Python is nobody's
    began = time.time()
    got = back.agg(near("l", 1e-3), near("s", 2.0), near("p", 0.5)).first()
    assert tuple(got) == (40000, 40000, 40000) and time.time() - began < 15


@pytest.mark.parametrize("transform, near", [(C.NUMPRESS_SLOF, 1e-3), (C.NUMPRESS_PIC, 0.5)])
def test_secondary_lists_in_numpress(spark, transform, near):
    rows = [(1, i, 100.0 + i, float(i * 7 % 50)) for i in range(60)]
    coded = C.encode_chunks(spark.createDataFrame(rows, "index bigint, pos bigint, mz double, intensity double"), 20.0, transforms={"intensity": transform})
    assert "intensity" not in coded.columns
    back = C.decode_chunks(coded).orderBy("mz").collect()
    assert [r.mz for r in back] == pytest.approx([r[2] for r in rows]) and all(abs(r.intensity - x[3]) <= near * (1 + x[3]) for r, x in zip(back, rows))


def profile(n=400):
    """Peaks between long stretches of zeros, two of them alone in their stretch."""
    out = []
    for i in range(n):
        out.append((200 + i * 0.01 + i * i * 1e-6, float((i % 40 > 25) * (i % 7 + 1)) if i != 100 else 9.0))
    return [(1, i, mz, v) for i, (mz, v) in enumerate(out)] + [(2, i, mz + 1, 0.0) for i, (mz, v) in enumerate(out[:50])]


def test_write_path_and_filled_reading(spark):
    rows = profile()
    pts = spark.createDataFrame(rows, "index bigint, pos bigint, mz double, intensity double")
    model = spark.createDataFrame([(1, [0.0105])], "index bigint, mz_delta_model array<double>")
    coded = C.encode_profile(pts, 1.0)
    read = C.read_chunks(coded, model=model).orderBy("chunk_id", "place").where("index = 1").collect()
    raw = [r for r in C.decode_chunks(coded).where("index = 1").collect() if r.mz is None]
    assert len(raw) > 10 and all(r.mz is not None and r.intensity is not None for r in read)
    assert [r.mz for r in read] == sorted(r.mz for r in read)
    kept = {round(mz, 6): v for k, _, mz, v in rows if k == 1 and v}
    assert {round(r.mz, 6): r.intensity for r in read if r.intensity} == kept
    truth = np.array([r[2] for r in rows if r[0] == 1])
    assert max(np.abs(truth - r.mz).min() for r in read) < 5e-3  # filled ones lie near where they were
    other = C.encode_profile(pts, 1.0, is_profile=False)
    assert {r.chunk_encoding for r in other.collect()} == {C.PLAIN} and C.decode_chunks(other).count() == len(rows)
    one = C.entity_from_chunks(coded, 1, model=model).collect()
    assert [r.mz for r in one] == [r.mz for r in read]


def test_both_layouts_give_the_same_slab(spark):
    pts = spark.createDataFrame(profile(), "index bigint, pos bigint, mz double, intensity double")
    meta = spark.createDataFrame([(1, 5.0, 1), (2, 50.0, 1)], "index bigint, time double, ms_level int")
    model = spark.createDataFrame([(1, [0.0105]), (2, [0.0105])], "index bigint, mz_delta_model array<double>")
    marked = signal.null_mark(signal.strip_zero_runs(pts, "index", "pos", "intensity"), "index", "pos", "intensity", ["mz"])
    coded = C.encode_chunks(marked, 1.0)
    slab = lambda df: sorted((r["index"], round(r.mz, 9), r.intensity) for r in df.collect())
    a = slab(extract.extract_points(marked, meta, (0, 10), (200.5, 203.0), fill="interpolate", model=model))
    b = slab(C.extract_from_chunks(coded, 200.5, 203.0, meta=meta, time=(0, 10), fill=C.NULL_INTERPOLATE, model=model))
    assert a == b and len(a) > len(slab(extract.extract_points(marked, meta, (0, 10), (200.5, 203.0)))) > 0
    assert slab(C.extract_from_chunks(coded, 200.5, 203.0, meta=meta, time=(0, 10))) == slab(extract.extract_points(marked, meta, (0, 10), (200.5, 203.0)))
    timed = C.extract_from_chunks(coded, 200.5, 203.0, meta=meta, time=(0, 10), with_time=True)
    assert {r.time for r in timed.collect()} == {5.0}


def test_spacing_model():
    x = np.cumsum(0.001 + 1e-6 * np.arange(3000)) + 200
    m = models.fit_spacing(x, np.ones(len(x)) * 50)
    d, at = np.diff(x), x[1:]
    assert len(m) == 3 and np.abs(m[0] + m[1] * at + m[2] * at**2 - d).max() < 1e-3
    assert len(models.fit_spacing(np.arange(5) * 2.0, np.ones(5))) == 1 and len(models.fit_spacing(np.array([1.0]), np.ones(1))) == 0


def test_nearest_times_as_brute_force(spark):
    r = np.random.default_rng(4)
    e = [(i, float(round(t, 1))) for i, t in enumerate(r.random(300) * 50)] + [(999, None)]
    q = [(i, float(round(t, 2))) for i, t in enumerate(r.random(200) * 60 - 5)] + [(500, None)]
    got = {x.query_id: x["index"] for x in extract.nearest_times(spark.createDataFrame(e, "index bigint, time double"), spark.createDataFrame(q, "query_id bigint, at double")).collect()}
    for k, t in q[:-1]:
        d = min(abs(a - t) for _, a in e[:-1])
        assert abs(e[got[k]][1] - t) == pytest.approx(d)
    assert 500 not in got


def test_pack_and_facets(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "index bigint, id string")
    b = spark.createDataFrame([(1, 5.0)], "source_index bigint, mz double")
    packed = facets.pack({"spectrum": a, "selected_ion": b})
    assert packed.count() == 2 and facets.facet(packed, "spectrum").count() == 2 and facets.facet(packed, "selected_ion").collect()[0].mz == 5.0


def test_split_mask():
    assert extract.split_mask(10, 30) == ((10, 20), (21, 30)) and extract.split_mask(1, 3) is None
