import pytest

from slabworks.functions import params as P
from slabworks.operators import units as U
from pyspark.sql import functions as F

UNITS = [("UO:0000010", "s", "second", "duration", 1.0, 0.0), ("UO:0000028", "ms", "millisecond", "duration", 1e-3, 0.0), ("UO:0000031", "min", "minute", "duration", 60.0, 0.0),
         ("UO:0000012", "K", "kelvin", "temperature", 1.0, 0.0), ("UO:0000027", "°C", "degree Celsius", "temperature", 1.0, 273.15), ("UO:0000187", "%", "percent", "ratio", 0.01, 0.0)]
ATTRS = [("MS:1000016", "scan start time", "double", "UO:0000031", "spectrum"), ("LX:0000021", "tube temperature", "double", "UO:0000027", "spectrum"), ("LX:0000099", "free", "double", None, "spectrum")]
SP = "param_id bigint, run_id string, accession string, name string, value struct<integer:bigint,float:double,string:string,boolean:boolean>, unit string, spectrum_index bigint, extra string"
MP = "meta_id bigint, run_id string, accession string, name string, value string, unit string"


def frames(spark, rows, metas=()):
    return (spark.createDataFrame([(i, "r", a, n, v, u, 0, "x") for i, (a, n, v, u) in enumerate(rows)], SP), spark.createDataFrame([(i, "r", *m) for i, m in enumerate(metas)], MP),
            spark.createDataFrame(ATTRS, "accession string, attribute_name string, value_type string, common_unit string, owner_kind string"),
            spark.createDataFrame(UNITS, "unit_curie string, symbol string, unit_name string, quantity_kind string, to_base_factor double, to_base_shift double"))


def num(x):
    return (None, float(x), None, None)


def txt(s):
    return (None, None, s, None)


def test_found_in_unit_name_or_text(spark):
    rows = [
        ("MS:1000016", "scan start time", num(60), "UO:0000010"), ("ms_1000016", "whatever", num(1), " UO:31 "), (None, "Scan_Start_Time (s)", txt("12,5"), None),
        (None, "MS_1000016_scan_start_time_unit_UO_0000028", num(5), None), ("MS:1000016", "scan start time", txt(" 1,032.5 [ms] "), ""), ("MS:1000016", "scan start time", txt("n/a"), "UO:0000010"),
        ("MS:1000016", "scan start time", num(3), None), ("MS:1000016", "scan start time", num(3), "UO:0000187"), ("LX:0000099", "free", num(3), "UO:0000010"), (None, None, None, None),
        ("LX:0000021", "tube temperature", txt("300.15 K"), None), ("XX:1", "scan start time", num(1), "s"), ("MS:1000016", "scan start time", (None, float("nan"), None, None), "s"),
    ]
    n = U.normalise_units(*frames(spark, rows + rows[:1], [("LX:0000021", "tube temperature", "300 K", None), ("LX:0000021", "tube temperature", "tessel 4", "UO:0000012")]))
    got = {(r.table_name, r.row_id): r.recorded_unit for r in U.recorded_in_other_units(n).collect()}
    sec, ms, k = "UO:0000010", "UO:0000028", "UO:0000012"
    assert got == {("spectrum_parameter", i): u for i, u in {0: sec, 13: sec, 2: sec, 3: ms, 4: ms, 10: k}.items()} | {("meta_param", 0): k}
    values = {r.row_id: r.common_value for r in n.where("table_name = 'spectrum_parameter'").collect()}
    assert values[0] == pytest.approx(1.0) and values[10] == pytest.approx(27.0) and values[4] == pytest.approx(1032.5 / 60000)


def test_unknown_labels_are_told_by_their_scale(spark):
    rows = [("MS:1000016", "scan start time", num(1 + i / 10), "UO:0000031") for i in range(100)] + [("MS:1000016", "scan start time", num(60 * (1 + i / 10)), "Sec.") for i in range(100)]
    rows += [("MS:1000016", "scan start time", num(60000 * (1 + i / 10)), "mSec") for i in range(100)] + [("MS:1000016", "scan start time", num(7), "parsec blorb") for i in range(3)]
    sp, mp, attrs, units = frames(spark, rows)
    labels = {r.label: r.unit for r in U.resolve_labels(U.source_statistics(U.observations(sp, U.spellings([sp], attrs), "param_id", True)), units).collect()}
    assert labels["Sec"] == "UO:0000010" and labels["mSec"] == "UO:0000028" and "parsec blorb" not in labels


def test_an_affine_unit_told_by_its_values_alone(spark):
    rows = [("LX:0000021", "tube temperature", num(20 + i), "UO:0000027") for i in range(200)] + [("LX:0000021", "tube temperature", num(20.3 + i + 273.15), "grd") for i in range(200)]
    rows += [("LX:0000021", "tube temperature", num(20 + i), "rrr") for i in range(20)] + [("LX:0000021", "tube temperature", num(-4000 + i), "Kelv") for i in range(200)]
    sp, mp, attrs, units = frames(spark, rows)
    stats = U.source_statistics(U.observations(sp, U.spellings([sp], attrs), "param_id", True))
    labels = U.resolve_labels(stats, units)
    report = {r.label: (r.unit, r.told_by, r.n_values) for r in U.label_report(stats, labels).collect()}
    # told by the values; too few values; letters that the values contradict
    assert report["grd"] == ("UO:0000012", "values", 200) and report["rrr"] == (None, "unresolved", 20) and report["Kelv"] == (None, "unresolved", 200) and report["UO:0000027"][1] == "name"


def test_scale_and_offset_from_entities_that_both_recorded(spark):
    """Two sources of different populations: only what both recorded of the same entities tells the unit."""
    rows = [("LX:0000021", "tube temperature", num(200 + i), "UO:0000027", i) for i in range(3000)] + [("LX:0000021", "tube temperature", num(20.0 + i / 10), "UO:0000027", 9000 + i) for i in range(300)]
    rows += [("LX:0000021", "tube temperature", num(20.0 + i / 10 + 273.15), "grd", 9000 + i) for i in range(300)]
    df = spark.createDataFrame([(i, "r", a, n, v, u, at, "x") for i, (a, n, v, u, at) in enumerate(rows)], SP)
    _, _, attrs, units = frames(spark, [])
    obs = U.observations(df, U.spellings([df], attrs), "param_id", True)
    stats = U.source_statistics(obs)
    links = U.source_links(obs, stats)
    assert {(r.label, r.other, r.n) for r in links.collect()} == {("grd", "UO:0000027", 300), ("UO:0000027", "grd", 300)}
    told = lambda labels: {r.label: r.unit for r in labels.collect()}.get("grd")
    assert told(U.resolve_labels(U.source_statistics(obs), units, links)) == "UO:0000012"
    assert told(U.resolve_labels(U.source_statistics(obs), units)) is None


def test_labels_are_not_shuffled(spark):
    rows = [("MS:1000016", "scan start time", num(i), "s") for i in range(50)]
    plan = U.recorded_in_other_units(U.normalise_units(*frames(spark, rows)))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(label" not in plan and "hashpartitioning(common_unit" not in plan


def test_empty(spark):
    assert U.normalise_units(*frames(spark, [])).count() == 0


@pytest.mark.parametrize("text, number, unit", [("1,5", 1.5, None), ("1,032.5 ms", 1032.5, "ms"), ("1.604.144,1", 1604144.1, None), ("1,604,144", 1604144.0, None), ("1.2e+01[nm]", 12.0, "nm"),
                                                 ("  7 (deg C) ", 7.0, "deg C"), ("teal 7", None, None), ("12:30", None, None), ("", None, None), ("−", None, None), ("NaN?", None, None), (None, None, None), ("-.5 V", -0.5, "V"), ("1e999", None, None)])
def test_numbers_in_text(spark, text, number, unit):
    r = spark.createDataFrame([(text,)], "t string").select(P.number_in_text(F.col("t")).alias("n"), P.unit_in_text(F.col("t")).alias("u")).first()
    assert (r.n, r.u) == (number, unit)
