import datetime as dt

import numpy as np
import pytest

from slabworks.operators import digest as G

SCHEMA = "field_name string, ms_level int, day date, value double"


@pytest.mark.parametrize("make", [lambda r, n: r.normal(size=n), lambda r, n: r.pareto(0.5, n), lambda r, n: np.round(r.normal(size=n)), lambda r, n: np.zeros(n), lambda r, n: -r.random(n) ** 9])
def test_merged_digests_keep_their_rank_error(make):
    r = np.random.default_rng(3)
    v = make(r, 60000)
    parts = [G.cluster(p, np.ones(len(p))) for p in np.array_split(v, 13)]
    m, w = G.cluster(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    assert len(m) <= G.DELTA + 1 and w.sum() == len(v)
    s = np.sort(v)
    for q, x in zip(G.PERCENTS, G.quantiles(m, w, v.min(), v.max(), G.PERCENTS)):
        lo, hi = np.searchsorted(s, x, "left") / len(v), np.searchsorted(s, x, "right") / len(v)
        err = max(0, lo - q, q - hi)
        assert err <= 2 * np.pi / G.DELTA * np.sqrt(q * (1 - q)) + 2.5 * np.pi**2 / G.DELTA**2 or len(set(np.round(s, 9))) < 50


def test_days_combine_and_are_certified(spark):
    r = np.random.default_rng(1)
    rows = [("f", int(x) if x < 3 else None, dt.date(2025, 3, 1 + i % 3), float(v)) for i, (x, v) in enumerate(zip(r.integers(1, 4, 6000), r.pareto(1, 6000)))]
    rows += [("f", 1, dt.date(2025, 3, 1), None), ("f", 1, dt.date(2025, 3, 1), float("nan")), ("f", 1, dt.date(2025, 3, 1), float("inf")), ("one", 1, dt.date(2025, 3, 1), 7.0), ("none", 1, None, None)]
    v = spark.createDataFrame(rows, SCHEMA)
    daily = G.daily_digests(v)
    whole = G.percentiles(v, daily, G.WHOLE_KEYS).withColumn("bound", G.stated_error()).collect()
    by_day = G.percentiles(v, daily, G.DAY_KEYS).withColumn("bound", G.stated_error()).collect()
    assert all(x.rank_error <= x.bound for x in whole + by_day)
    assert {x.field_name for x in whole} == {"f", "one"} and all(x.value == 7.0 for x in whole if x.field_name == "one")
    assert sum(x.n for x in whole if x.field_name == "f" and x["quantile"] == 0.5) == 6000
    assert any(x.ms_level is None for x in by_day)
    exact = np.median([x[3] for x in rows if x[0] == "f" and x[1] == 1 and x[3] is not None and np.isfinite(x[3])])
    assert next(x.value for x in whole if x.ms_level == 1 and x["quantile"] == 0.5 and x.field_name == "f") == pytest.approx(exact, rel=0.05)


def test_empty(spark):
    v = spark.createDataFrame([], SCHEMA)
    assert G.percentiles(v, G.daily_digests(v), G.DAY_KEYS).count() == 0


def test_many_groups_are_flushed(spark):
    v = spark.createDataFrame([(f"f{i}", 1, None, float(i)) for i in range(1500)], SCHEMA)
    assert G.merge(G.build(v, G.WHOLE_KEYS), G.WHOLE_KEYS).count() == 1500


def test_hot_groups_are_merged_in_steps(spark):
    r = np.random.default_rng(2)
    v = spark.createDataFrame([("f", 1, None, float(x)) for x in r.normal(size=4000)] + [("g", 1, None, 3.0)], SCHEMA).repartition(16)
    d = G.build(v, G.WHOLE_KEYS)
    assert d.where("field_name = 'f'").count() == 16
    one = {x.field_name: x for x in G.merge(d, G.WHOLE_KEYS, fan=2).collect()}
    assert sum(one["f"].weights) == 4000 and len(one["f"].means) <= G.DELTA + 1 and one["g"].means == [3.0]
    told = G.percentiles(v, d.select(*G.WHOLE_KEYS, "means", "weights", "low", "high").limit(0), G.WHOLE_KEYS)
    assert told.count() == 0
