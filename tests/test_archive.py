import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from slabworks.functions import cv
from slabworks.operators.extract import extract_points
from slabworks.sources import archive as A


@pytest.fixture(scope="module")
def tables(spark):
    meta = spark.createDataFrame([(i, f"scan={i}", float(i), 1 + i % 2) for i in range(20)], "index bigint, id string, time double, ms_level int")
    pts = spark.createDataFrame([(i % 20, 100.0 + i, float(i)) for i in range(400)], "index bigint, mz double, intensity double")
    from pyspark.sql import functions as F

    return {"spectra_metadata": meta.select(F.struct("*").alias("spectrum")), "spectra_data": pts.repartition(3).select(F.struct("*").alias("point"))}, meta, pts


def test_directory_and_zip_round_trip(spark, tables, tmp_path):
    members, meta, pts = tables
    root = str(tmp_path / "run")
    A.write_directory(root, members, {"writer": "t"}, {"spectra_data": ["point.index"]}, extra={"method.bin": b"\x00\x01"})
    a = A.open_archive(spark, root)
    assert a.metadata == {"writer": "t"} and a.listing().count() == 3
    assert bytes(a.raw("method.bin").first().content) == b"\x00\x01"
    a.register("d_")
    assert spark.table("d_spectra").count() == 20 and spark.table("d_points").count() == 400
    A.pack_zip(root, str(tmp_path / "run.zip"))
    inside = A.open_archive(spark, str(tmp_path / "run.zip"))
    assert inside.member("spectra_data").count() == 400 and bytes(inside.raw("method.bin").first().content) == b"\x00\x01"
    assert sorted(map(tuple, inside.signal()[1].collect())) == sorted(map(tuple, pts.collect()))
    z = A.open_archive(spark, str(tmp_path / "run.zip"), str(tmp_path / "shared"))
    z.register("z_")
    slab = extract_points(spark.table("z_points"), spark.table("z_spectra"), (3.0, 9.0), (150.0, 300.0), None, (1, 1), prune=True)
    want = extract_points(pts, meta, (3.0, 9.0), (150.0, 300.0), None, (1, 1))
    assert sorted(map(tuple, slab.collect())) == sorted(map(tuple, want.collect()))
    sizes = A.column_sizes(spark, [str(tmp_path / "shared" / "spectra_data.parquet")])
    assert {r.path for r in sizes.collect()} == {"point.index", "point.mz", "point.intensity"}
    assert ("point.mz", "double") in A.schema_rows(z.member("spectra_data"))


def test_without_index_members_are_told_by_name(spark, tables, tmp_path):
    root = tmp_path / "noindex"
    A.write_directory(str(root), tables[0])
    (root / A.INDEX).unlink()
    with pytest.warns(UserWarning):
        a = A.open_directory(spark, str(root))
    assert a.member("spectra_data").count() == 400


def test_compressed_or_escaping_members_are_refused(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "c.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x_index.json", json.dumps({"files": []}))
    with pytest.raises(ValueError, match="stored"):
        A.open_archive(spark, str(tmp_path / "c.zip"), str(tmp_path / "s1"))
    with zipfile.ZipFile(tmp_path / "e.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("../x", "y")
    with pytest.raises(ValueError, match="leads out"):
        A.open_archive(spark, str(tmp_path / "e.zip"), str(tmp_path / "s2"))


def test_names_and_options():
    assert cv.parse_column_name("MS_1000016_scan_start_time_unit_UO_0000031") == ("MS:1000016", "scan_start_time", "UO:0000031", False)
    assert cv.parse_column_name("MS_1000511_ms_level") == ("MS:1000511", "ms_level", None, False) and cv.parse_column_name("time").accession is None
    assert cv.parse_column_name("MS_1000927_ion_injection_time_unit").is_unit_column
    assert cv.array_column_name("m/z array", "chunk_start") == "mz_chunk_start" and cv.array_column_name("time array", primary=False, data_type="MS:1000521", unit="min") == "time_f32_min"
    assert cv.array_column_name("my/own array") == "my_own_array" and cv.array_column_name("intensity array", "chunk_transform", transform="numpress_slof") == "intensity_numpress_slof_bytes"
    assert cv.chunk_option("numpress:20") == ("numpress", 20.0) and cv.chunk_option("x") == ("delta", 50.0) and cv.chunk_option("plain:20") == ("basic", 20.0) and cv.chunk_option("delta:abc") == ("delta", 50.0) and cv.size_option("4K") == 4096 and cv.size_option("3") == 3
    assert cv.slice_bounds(slice(None, 5), 9) == (0, 5) and A.classify_by_name("a/spectra_peaks.parquet") == "spectra_peaks" and A.classify(" Spectrum", "DATA arrays") == "spectra_data"


def test_stream_appends_whole_entities(spark, tmp_path):
    from slabworks.streaming.append import append_points, finish, windowed_trace

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(i % 5, float(i), f"2025-03-01 0{i % 9}:00:00") for i in range(90)], "index bigint, mz double, ts string").selectExpr("index", "mz", "timestamp(ts) ts").write.parquet(src)
    stream = lambda: spark.readStream.schema("index bigint, mz double, ts timestamp").parquet(src)
    append_points(stream(), out, str(tmp_path / "ck")).awaitTermination()
    append_points(stream(), out, str(tmp_path / "ck")).awaitTermination()  # nothing new: nothing twice
    read = lambda: spark.read.parquet(f"{out}/data")
    assert read().where("index = 4").count() == 0  # may go on
    spark.createDataFrame([(4, 900.0, "2025-03-02 00:00:00"), (5, 901.0, "2025-03-02 00:00:00")], "index bigint, mz double, ts string").selectExpr("index", "mz", "timestamp(ts) ts").write.mode("append").parquet(src)
    append_points(stream(), out, str(tmp_path / "ck")).awaitTermination()
    finish(spark, out)
    finish(spark, out)
    assert read().count() == 92 and read().groupBy("index").agg({"batch": "min"}).join(read().groupBy("index").agg({"batch": "max"}), "index").where("`min(batch)` <> `max(batch)`").count() == 0
    q = windowed_trace(stream(), "ts", "mz").writeStream.outputMode("complete").format("memory").queryName("traced").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("traced").agg({"n": "sum"}).first()[0] == 92


def test_cli(spark, tables, tmp_path):
    from slabworks import cli

    A.write_directory(str(tmp_path / "r"), tables[0])
    cli.main([str(tmp_path / "r"), str(tmp_path / "o"), "--time-range", "3-9", "--mz-range", "150-300"])
    assert spark.read.parquet(str(tmp_path / "o")).count() > 0


@pytest.mark.parametrize("layout", ["chunk", "point"])
def test_run_written_and_extracted(spark, tmp_path, layout):
    from slabworks import cli
    from slabworks.operators import peaks as K
    from tests.test_kernels import profile

    rows = profile() + [(3, i, 200.0 + i, float(i)) for i in range(9)]
    pts = spark.createDataFrame(rows, "index bigint, pos bigint, mz double, intensity double")
    meta = spark.createDataFrame([(1, "a", 1.0, 1, True), (2, "b", 2.0, 1, True), (3, "c", 3.0, 2, False)], "index bigint, id string, time double, ms_level int, is_profile boolean")
    root = str(tmp_path / layout)
    peaks = K.as_peaks(pts.where("intensity > 5"), K.CENTROID)
    A.write_run(root, meta, pts, layout, 1.0, peaks=peaks, types={"intensity": "float"}, hooks=[lambda m: m.withColumn("lane", F.lit("x"))])
    a = A.open_archive(spark, root)
    told = {(r.what, r.value) for r in a.describe().collect()}
    assert {("spectra", "3"), ("layout", layout), ("peaks", "true"), ("chromatograms", "false")} <= told
    got = cli.slab(a, (0, 10), (200.0, 204.0), ms_level=(2, 2)).collect()
    assert sorted((r["index"], r.mz, r.intensity, r.time) for r in got) == [(3, 200.0 + i, float(i), 3.0) for i in range(5)]
    filled = cli.slab(a, (0, 1.5), (200.0, 210.0), fill="interpolate").collect()
    dropped = cli.slab(a, (0, 1.5), (200.0, 210.0), fill="drop").collect()
    kept = sorted(mz for k, _, mz, v in rows if k == 1 and v)
    assert sorted(r.mz for r in dropped if r.intensity) == pytest.approx(kept) and len(filled) > len(dropped)
    assert cli.slab(a, None, (200.0, 210.0), peaks=True).count() == peaks.where("mz <= 210").count()
    assert a.member("spectra_metadata").select("spectrum.lane").distinct().first()[0] == "x"
    cli.main([root, str(tmp_path / "out"), "--time-range", "0-10", "--mz-range", "200-204"])
    cli.main([root])


def test_peak_kinds(spark):
    from slabworks.operators import peaks as K

    df = spark.createDataFrame([(1, 1000.0, 2, 5.0, "x")], "index bigint, neutral_mass double, charge int, intensity double, other string")
    r = K.as_peaks(df, K.MOBILITY_DECONVOLUTED).first()
    assert r.asDict() == {"index": 1, "mz": pytest.approx(501.007276, abs=1e-5), "ion_mobility": None, "intensity": 5.0, "charge": 2}
    own = K.PeakKind("own", {"mz": "double", "snr": "float"}, {"snr": lambda d: F.col("intensity") / 2})
    assert K.as_peaks(df, own).first().snr == 2.5 and set(K.KINDS) == {"centroid", "mobility centroid", "deconvoluted", "mobility deconvoluted"}
    pts = spark.createDataFrame([(i, float(i), None if i < 15 else 1.0) for i in range(20)], "index bigint, mz double, im double")
    assert K.observed_schema(pts) == [("index", "bigint"), ("mz", "double")]


def test_columns_in_order():
    arrays = [{"array_type": "intensity array"}, {"array_type": "zz array"}, {"array_type": "m/z array"}, {"array_type": "pressure array"}, {"array_type": "m/z array", "primary": False, "data_type": "MS:1000521"}]
    assert [(a["array_type"], a.get("primary", True)) for a in cv.column_order(arrays)] == [("m/z array", True), ("m/z array", False), ("intensity array", True), ("pressure array", True), ("zz array", True)]
    assert cv.array_column_name("time array", primary=False, data_type="MS:1000521", unit="UO:0000031") == "time_f32_min"


def test_plain_column_names(spark):
    r = spark.createDataFrame([("MS:1000744", "selected ion m/z (best)")], "a string, n string").select(cv.plain_column_name(F.col("a"), F.col("n")).alias("x")).first()
    assert r.x == "MS_1000744_selected_ion_m_z_best_"


def test_median_modes(spark):
    from slabworks.operators import models

    for values, middle, upper in (([1.0, 5.0], 3.0, 1.0), ([1.0, 2.0, 9.0], 2.0, 2.0), ([1.0, 2.0, 3.0, 9.0], 2.5, 6.0), ([4.0], 4.0, 4.0)):
        assert (models.median(np.array(values)), models.median(np.array(values), "upper")) == (middle, upper)
        df = spark.createDataFrame([(1, v) for v in values], "k int, d double")
        for mode, want in (("middle", middle), ("upper", upper)):
            assert models.second_median(df, ["k"], "d", mode).first().median == want


def test_convert(spark, tmp_path, capsys):
    from slabworks import cli, convert
    from tests.test_kernels import profile

    spark.createDataFrame(profile(), "index bigint, pos bigint, mz double, intensity double").write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([(1, "a", 1.0, 1), (2, "b", 2.0, 1)], "index bigint, id string, time double, ms_level int").write.parquet(str(tmp_path / "m"))
    convert.main([str(tmp_path / "m"), str(tmp_path / "p"), str(tmp_path / "run"), "--chunk", "numpress:2", "--packed", str(tmp_path / "run.zip")])
    line = capsys.readouterr().out.strip().splitlines()[-1].split(",")
    assert line[4] == "ok" and int(line[1]) > 0 and int(line[2]) > 0
    slab = lambda path: sorted((r["index"], r.mz, r.intensity) for r in cli.slab(A.open_archive(spark, path), (0, 10), (201.0, 203.0)).collect())
    assert slab(str(tmp_path / "run.zip")) == slab(str(tmp_path / "run")) != []
    assert convert.convert(spark, str(tmp_path / "m"), str(tmp_path / "m"), str(tmp_path / "bad"))[4] != "ok"


def test_frames_as_people_read_them(spark):
    from slabworks.operators import facets, summaries

    df = spark.createDataFrame([(1, None, 2.0)], "index bigint, MS_1_empty double, MS_1000016_scan_start_time_unit_UO_0000031 double")
    assert summaries.plain_frame(df).columns == ["index", "scan_start_time"]
    pre = spark.createDataFrame([(2, 1), (1, 2), (1, 1)], "source_index bigint, precursor_index bigint")
    assert [tuple(r) for r in facets.sorted_precursors(pre).collect()] == [(1, 1), (1, 2), (2, 1)]
