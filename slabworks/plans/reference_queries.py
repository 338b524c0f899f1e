"""The operators on whole tables, by name, each with the same in SQL where SQL can say it.

Roles: ``orders`` are spectra (time in days, the priority's digit as MS level) and ``lineitem`` their
points; ``events`` are ordered signals per user; the run tables play themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slabworks.functions import cv, params
from slabworks.operators import chunks, drift, extract, facets, models, signal, summaries
from slabworks.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def meta(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("index"), F.datediff("o_orderdate", F.lit("1995-01-01")).cast("double").alias("time"), F.substring("o_orderpriority", 1, 1).cast("int").alias("ms_level"), F.col("o_totalprice").alias("measure"))


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("index"), F.col("l_extendedprice").alias("mz"), F.col("l_quantity").alias("intensity"), F.col("l_discount").alias("im"))


PLACE = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
SIGNAL_FLOOR = 35.0


def signals(spark: SparkSession, d: str) -> DataFrame:
    """Events as a signal per user: values below a floor are zeros."""
    return table(spark, d, "events").select(F.col("user_id").alias("index"), F.col("event_id").alias("pos"), F.when(F.col("value") < SIGNAL_FLOOR, 0.0).otherwise(F.col("value")).alias("x"))


def axis(spark: SparkSession, d: str) -> DataFrame:
    """An ascending coordinate per user, without repeats: event numbers scaled."""
    return table(spark, d, "events").select(F.col("user_id").alias("index"), F.col("event_id").alias("pos"), (F.col("event_id") / 64.0).alias("mz"), F.col("value").alias("intensity"))


META = "meta AS (SELECT o_orderkey AS index, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS time, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS ms_level, o_totalprice AS measure FROM orders)"
POINTS = "points AS (SELECT l_orderkey AS index, l_extendedprice AS mz, l_quantity AS intensity, l_discount AS im FROM lineitem)"
SIGNALS = f"sig AS (SELECT user_id AS index, event_id AS pos, CASE WHEN value < {SIGNAL_FLOOR} THEN 0.0 ELSE value END AS x FROM events)"
NEAR = """near AS (SELECT *, lag(x) OVER w AS prev, lead(x) OVER w AS nxt, row_number() OVER w = 1 AS is_first, lead(1) OVER w IS NULL AS is_last FROM sig WINDOW w AS (PARTITION BY index ORDER BY pos))"""
AXIS = "ax AS (SELECT user_id AS index, event_id AS pos, event_id / 64.0 AS mz, value AS intensity FROM events)"
MARKED = f"WITH {SIGNALS}, {NEAR}, marked AS (SELECT index, pos, CASE WHEN x = 0 AND (coalesce(prev = 0, false) OR coalesce(nxt = 0, false)) THEN NULL ELSE x END AS x FROM near)"

# --- range extraction, filters and selections --------------------------------------------------------

TIME, MZ, IM, LEVEL = (600.0, 1200.0), (20000.0, 40000.0), (0.02, 0.05), (1, 3)
_SLAB = f"WITH {META}, {POINTS} SELECT p.* FROM points p SEMI JOIN meta m ON p.index = m.index AND m.time BETWEEN 600 AND 1200 AND m.ms_level BETWEEN 1 AND 3 WHERE p.mz BETWEEN 20000 AND 40000"


@query(_SLAB)
def extract_slab(spark, d):
    return extract.extract_points(points(spark, d), meta(spark, d), TIME, MZ, None, LEVEL)


@query(_SLAB)
def extract_slab_pruned(spark, d):
    return extract.extract_points(points(spark, d), meta(spark, d), TIME, MZ, None, LEVEL, prune=True)


@query(_SLAB)
def extract_slab_naive(spark, d):
    """The same by a join and filters on everything, the measure for the others."""
    return extract.extract_naive(points(spark, d), meta(spark, d), TIME, MZ, None, LEVEL)


@query(_SLAB + " AND p.im BETWEEN 0.02 AND 0.05")
def extract_slab_mobility(spark, d):
    return extract.extract_points(points(spark, d), meta(spark, d), TIME, MZ, IM, LEVEL)


@query(f"WITH {META}, {POINTS} SELECT p.*, m.time FROM points p JOIN meta m ON p.index = m.index WHERE m.time BETWEEN 600 AND 1200 AND p.mz BETWEEN 20000 AND 40000")
def extract_slab_with_time(spark, d):
    return extract.extract_points(points(spark, d), meta(spark, d), TIME, MZ, with_time=True)


@query(f"WITH {META}, {POINTS} SELECT p.*, m.time FROM points p JOIN meta m ON p.index = m.index")
def attach_time(spark, d):
    return extract.attach_time(points(spark, d), meta(spark, d))


@query(f"WITH {META} SELECT index, time FROM meta WHERE time BETWEEN 600 AND 1200 AND ms_level BETWEEN 1 AND 3")
def select_entities(spark, d):
    return extract.select_entities(meta(spark, d), TIME, LEVEL)


@query(f"WITH {META} SELECT min(index) AS lo, max(index) AS hi FROM meta WHERE time BETWEEN 600 AND 1200")
def key_set_bounds(spark, d):
    return extract.select_entities(meta(spark, d), TIME).agg(F.min("index").alias("lo"), F.max("index").alias("hi"))


@query(f"WITH {POINTS} SELECT * FROM points WHERE index = 77")
def index_equals(spark, d):
    return extract.by_index(points(spark, d), 77)


@query(f"WITH {POINTS} SELECT * FROM points WHERE index >= 100 AND index < 400")
def index_slice(spark, d):
    return extract.slice_by_index(points(spark, d), 100, 400)


@query(f"WITH {META} SELECT * FROM meta WHERE index >= 500")
def start_from_index(spark, d):
    return extract.slice_by_index(meta(spark, d), 500)


@query(f"WITH {META}, {POINTS} SELECT * FROM points WHERE index BETWEEN 10 AND 900 AND index IN (SELECT index FROM meta WHERE measure > 300000)")
def sparse_mask(spark, d):
    return extract.by_mask(points(spark, d), meta(spark, d).where("measure > 300000"), 10, 900)


@query(f"WITH {META} SELECT index FROM meta WHERE ms_level = 2 INTERSECT SELECT index FROM meta WHERE time < 1000")
def mask_intersect(spark, d):
    m = meta(spark, d)
    return extract.mask_intersect(m.where("ms_level = 2"), m.where("time < 1000"))


@query(f"WITH {META} SELECT * FROM meta WHERE ms_level = 1 OR time < 100")
def selection_union(spark, d):
    return extract.either(meta(spark, d), F.col("ms_level") == 1, F.col("time") < 100)


@query(f"WITH {POINTS} SELECT * FROM points WHERE index < 300 UNION ALL SELECT * FROM points WHERE index >= 300 AND index < 600")
def half_scans_chained(spark, d):
    p = points(spark, d)
    lo, hi = extract.split_mask(0, 599)
    return p.where(extract.contains("index", *lo)).unionByName(p.where(extract.contains("index", *hi)))


@query("WITH c AS (SELECT l_orderkey, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1) SELECT * FROM c WHERE lo <= 52000 AND hi >= 50000")
def interval_overlap(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    return c.where(extract.overlaps("lo", "hi", 50000, 52000))


@query("SELECT DISTINCT run_id || '#' || spectrum_index AS index FROM selected_ion WHERE selected_ion_mz BETWEEN 500 AND 700 AND spectrum_index IS NOT NULL AND run_id IS NOT NULL")
def entities_with_ion(spark, d):
    ions = table(spark, d, "selected_ion").select(F.concat("run_id", F.lit("#"), F.col("spectrum_index").cast("string")).alias("index"), F.col("selected_ion_mz").alias("mz"))
    return extract.entities_with_ion(ions.where("index is not null"), (500.0, 700.0))


@query("SELECT run_id, spectrum_index, id, ms_level, scan_time FROM spectrum WHERE id IN (SELECT id FROM spectrum WHERE ms_level = 1)")
def lookup_by_id(spark, d):
    s = table(spark, d, "spectrum").select("run_id", "spectrum_index", "id", "ms_level", "scan_time")
    return extract.by_id(s, s.where("ms_level = 1").select("id").distinct())


@query(f"WITH {META} SELECT index, time FROM meta ORDER BY abs(time - 777.4), index LIMIT 1")
def nearest_time(spark, d):
    return extract.nearest_time(meta(spark, d), 777.4)


@query(f"""WITH {META}, e AS (SELECT time, min(index) AS index FROM meta GROUP BY 1), q AS (SELECT event_id AS query_id, value * 6 AS at FROM events),
lo AS (SELECT q.query_id, q.at, e.time, e.index FROM q ASOF LEFT JOIN e ON q.at >= e.time), hi AS (SELECT q.query_id, e.time, e.index FROM q ASOF LEFT JOIN e ON q.at <= e.time)
SELECT lo.query_id, lo.at, CASE WHEN hi.time IS NULL OR abs(lo.at - lo.time) < abs(hi.time - lo.at) OR (abs(lo.at - lo.time) = abs(hi.time - lo.at) AND lo.index <= hi.index) THEN lo.index ELSE hi.index END AS index,
CASE WHEN hi.time IS NULL OR abs(lo.at - lo.time) < abs(hi.time - lo.at) OR (abs(lo.at - lo.time) = abs(hi.time - lo.at) AND lo.index <= hi.index) THEN lo.time ELSE hi.time END AS time FROM lo JOIN hi USING (query_id)""")
def nearest_times(spark, d):
    asked = table(spark, d, "events").select(F.col("event_id").alias("query_id"), (F.col("value") * 6).alias("at"))
    return extract.nearest_times(meta(spark, d), asked)


@query(f"WITH {META} SELECT index, time FROM meta ORDER BY time DESC, index LIMIT 1")
def nearest_time_at_the_end(spark, d):
    """An infinite time is nearest to the last entity."""
    return extract.nearest_time(meta(spark, d), float("inf"))


@query(f"WITH {META} SELECT * FROM meta WHERE index >= (SELECT index FROM meta ORDER BY abs(time - 1100.2), index LIMIT 1)")
def start_from_time(spark, d):
    m = meta(spark, d)
    return extract.start_from(m, m, time=1100.2)


@query(f"""WITH {META}, b AS (SELECT (SELECT index FROM meta ORDER BY abs(time - 100), index LIMIT 1) AS a, (SELECT index FROM meta ORDER BY abs(time - 1100.2), index LIMIT 1) AS z)
SELECT meta.* FROM meta, b WHERE index BETWEEN a AND z""")
def time_slice(spark, d):
    return extract.time_slice(meta(spark, d), 100.0, 1100.2)


@query(f"WITH {POINTS} SELECT index, mz, intensity FROM points")
def project_core_columns(spark, d):
    return extract.core_columns(points(spark, d).drop("im"))


@query(f"WITH {META}, {POINTS} SELECT m.index, m.time, p.mz, p.intensity FROM meta m LEFT JOIN points p ON p.index = m.index")
def metadata_with_signal(spark, d):
    """Entities without points stay, as in a sequential scan."""
    return extract.with_signal(meta(spark, d), points(spark, d)).select("index", "time", "mz", "intensity")


# --- summaries, traces and errors --------------------------------------------------------------------


@query(f"""WITH {POINTS} SELECT index, count(*) AS n_points, arg_max(mz, (intensity, -mz)) AS base_peak_mz, max(intensity) AS base_peak_intensity, sum(intensity) AS total_ion_current,
min(mz) AS lowest_mz, max(mz) AS highest_mz FROM points GROUP BY 1""".replace("arg_max(mz, (intensity, -mz))", "-max(row(intensity, -mz))[2]"))
def entity_summary(spark, d):
    return summaries.entity_summary(points(spark, d))


def _run_trace(measure: str) -> Query:
    def f(spark, d):
        s = table(spark, d, "spectrum").select(F.concat("run_id", F.lit("#"), F.col("spectrum_index").cast("string")).alias("index"), F.col("scan_time").alias("time"), measure).distinct()
        return summaries.trace(s, measure)

    return f


for _name, _measure in (("tic", "total_ion_current"), ("bpc", "base_peak_intensity")):
    QUERIES[_name] = _run_trace(_measure)
    ORACLES[_name] = f"SELECT DISTINCT run_id || '#' || spectrum_index AS index, scan_time AS time, {_measure} AS intensity FROM spectrum WHERE CAST(scan_time AS VARCHAR) <> 'nan' AND CAST({_measure} AS VARCHAR) <> 'nan'"


@query(f"WITH {META}, {POINTS} SELECT p.index, m.time, sum(p.intensity) AS intensity, count(*) AS n_points FROM points p JOIN meta m ON p.index = m.index WHERE m.time BETWEEN 600 AND 1200 AND p.mz BETWEEN 20000 AND 40000 GROUP BY ALL")
def xic(spark, d):
    return extract.xic(points(spark, d), meta(spark, d), TIME, MZ)


@query(f"WITH {POINTS} SELECT count(*) AS n_points, count(DISTINCT index) AS n_entities FROM points")
def totals_read(spark, d):
    return summaries.totals(points(spark, d))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, d):
    return summaries.counts_by(table(spark, d, "orders"), "o_orderstatus", "status")


_PAIRS = f"""WITH a AS (SELECT l_orderkey, l_extendedprice AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(PLACE)}, l_quantity, l_discount, l_tax) AS place FROM lineitem WHERE l_returnflag = 'A'),
b AS (SELECT l_orderkey, l_extendedprice AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(PLACE)}, l_quantity, l_discount, l_tax) AS place FROM lineitem WHERE l_returnflag = 'R'), p AS (SELECT a.l_orderkey, place, x, y FROM a JOIN b USING (l_orderkey, place))"""


def _pairs(spark, d):
    li, order = table(spark, d, "lineitem"), [*PLACE, "l_quantity", "l_discount", "l_tax"]
    side = lambda flag: li.where(F.col("l_returnflag") == flag).select("l_orderkey", *order)
    return facets.pair_by_position(side("A"), side("R"), "l_orderkey", order, order).select("l_orderkey", "place", F.col("a.l_extendedprice").alias("x"), F.col("b.l_extendedprice").alias("y"))


@query(_PAIRS + " SELECT l_orderkey, CAST(place AS INTEGER) AS place, x, y FROM p")
def pair_by_position(spark, d):
    return _pairs(spark, d)


@query(_PAIRS + " SELECT CAST(place AS INTEGER) AS place, count(*) AS n, round(avg(abs(x - y)), 4) AS mean_error, round(stddev_pop(abs(x - y)), 4) AS std_error, round(quantile_cont(abs(x - y), 0.5), 4) AS median_error, round(max(abs(x - y)), 4) AS max_error FROM p GROUP BY 1")
def error_statistics(spark, d):
    e = summaries.error_statistics(_pairs(spark, d), "x", "y", ["place"])
    return e.select("place", "n", *[F.round(c, 4).alias(c) for c in ("mean_error", "std_error", "median_error", "max_error")])


@query(_PAIRS + " SELECT CAST(CASE WHEN e >= 100000 THEN 51 ELSE floor(e / 2000) + 1 END AS INTEGER) AS bin, count(*) AS n FROM (SELECT abs(x - y) AS e FROM p) GROUP BY 1")
def error_histogram(spark, d):
    return summaries.histogram(_pairs(spark, d).select(F.abs(F.col("x") - F.col("y")).alias("e")), "e", 0.0, 100000.0, 50)


@query("SELECT count(total_ion_current) AS total_ion_current, count(ms_level) AS ms_level, count(deleted_at) AS deleted_at, count(parameters) AS parameters FROM spectrum")
def filled_counts(spark, d):
    return summaries.filled_counts(table(spark, d, "spectrum"), ["total_ion_current", "ms_level", "deleted_at", "parameters"])


@query("SELECT * REPLACE (CAST(len(parameters) AS INTEGER) AS parameters, CASE WHEN CAST(intensity AS VARCHAR) <> 'nan' THEN intensity END AS intensity) FROM selected_ion")
def drop_all_null_columns(spark, d):
    """The whole table with a column of nulls, which goes; parameters are shown by their number, not-a-number as null."""
    kept = summaries.drop_all_null(table(spark, d, "selected_ion").withColumn("nothing", F.lit(None).cast("double")))
    size = F.when(F.col("parameters").isNotNull(), F.size("parameters"))
    return kept.withColumns({"parameters": size, "intensity": F.when(~F.isnan("intensity"), F.col("intensity"))})


# --- kernels -----------------------------------------------------------------------------------------


@query(f"WITH {SIGNALS} SELECT index, pos, x, x - lag(x) OVER (PARTITION BY index ORDER BY pos) AS delta FROM sig")
def deltas(spark, d):
    return signal.deltas(signals(spark, d), "index", "pos", "x")


@query(f"WITH {SIGNALS}, {NEAR} SELECT index, pos, x FROM near WHERE NOT coalesce(x = 0 AND (is_first OR coalesce(prev = 0, false)) AND (is_last OR coalesce(nxt = 0, false)), false)")
def zero_run_strip(spark, d):
    return signal.strip_zero_runs(signals(spark, d), "index", "pos", "x")


@query(f"WITH {SIGNALS}, {NEAR} SELECT index, pos, coalesce(x = 0 AND (coalesce(prev = 0, false) OR coalesce(nxt = 0, false)), false) AS is_pair FROM near")
def zero_pair_mask(spark, d):
    return signals(spark, d).select("index", "pos", signal.is_zero_pair("x", signal.in_order("index", "pos")).alias("is_pair"))


def _marked(spark, d):
    return signal.null_mark(signals(spark, d), "index", "pos", "x", [])


@query(MARKED + " SELECT index, pos, x FROM marked")
def null_mark(spark, d):
    return _marked(spark, d)


_ENCODED = MARKED + """, enc AS (SELECT index, pos, x, CASE WHEN x IS NULL THEN NULL WHEN lag(x) OVER w IS NULL THEN x ELSE x - lag(x) OVER w END AS encoded, row_number() OVER w = 1 AND x IS NOT NULL AS skip FROM marked WINDOW w AS (PARTITION BY index ORDER BY pos))"""


@query(_ENCODED + " SELECT index, pos, x, encoded FROM enc WHERE NOT skip")
def delta_encode(spark, d):
    return signal.delta_encode(_marked(spark, d), "index", "pos", "x")


@query(_ENCODED + " SELECT index, pos, round(x, 6) AS decoded FROM enc WHERE NOT skip")
def delta_decode(spark, d):
    """Decoding gives back what was encoded."""
    marked = _marked(spark, d)
    start = marked.groupBy("index").agg(F.coalesce(F.min_by("x", "pos"), F.lit(0.0)).alias("start"))
    decoded = signal.delta_decode(signal.delta_encode(marked, "index", "pos", "x").join(start, "index"), "index", "pos", "encoded", "start")
    return decoded.select("index", "pos", F.round("decoded", 6).alias("decoded"))


@query(MARKED + """, o AS (SELECT *, CASE WHEN x IS NULL AND lag(x) OVER w IS NULL AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS o FROM marked WINDOW w AS (PARTITION BY index ORDER BY pos))
SELECT index, pos, x, CAST(sum(o) OVER (PARTITION BY index ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM o""")
def null_segments(spark, d):
    return signal.null_segments(_marked(spark, d), "index", "pos", "x")


_HOLED = f"WITH {AXIS}, holed AS (SELECT index, pos, CASE WHEN row_number() OVER w % 7 IN (3, 4) THEN NULL ELSE mz END AS x FROM ax WINDOW w AS (PARTITION BY index ORDER BY pos))"


def _holed(spark, d):
    """Coordinates with a pair of nulls in every seven."""
    n = F.row_number().over(W.partitionBy("index").orderBy("pos"))
    return axis(spark, d).select("index", "pos", F.when(~(n % 7).isin(3, 4), F.col("mz")).alias("x"))


@query(_HOLED + """, o AS (SELECT *, CASE WHEN x IS NULL AND lag(x) OVER w IS NULL AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS o FROM holed WINDOW w AS (PARTITION BY index ORDER BY pos)),
s AS (SELECT index, pos, x, sum(o) OVER (PARTITION BY index ORDER BY pos ROWS UNBOUNDED PRECEDING) AS seg FROM o),
dd AS (SELECT *, x - lag(x) OVER (PARTITION BY index, seg ORDER BY pos) AS d FROM s), m1 AS (SELECT index, seg, quantile_cont(d, 0.5) AS m FROM dd GROUP BY ALL),
m2 AS (SELECT dd.index, dd.seg, quantile_cont(d, 0.5) AS m FROM dd JOIN m1 ON m1.index = dd.index AND m1.seg = dd.seg AND d <= m1.m GROUP BY ALL),
e AS (SELECT index, seg, arg_min(x, pos) FILTER (WHERE x IS NOT NULL) AS lo, arg_max(x, pos) FILTER (WHERE x IS NOT NULL) AS hi, min(pos) FILTER (WHERE x IS NOT NULL) AS lo_pos FROM s GROUP BY ALL)
SELECT s.index, s.pos, round(CASE WHEN s.x IS NOT NULL THEN s.x WHEN e.lo_pos IS NULL OR s.pos < e.lo_pos THEN e.lo - coalesce(m2.m, 0.25) ELSE e.hi + coalesce(m2.m, 0.25) END, 6) AS filled
FROM s JOIN e ON e.index = s.index AND e.seg = s.seg LEFT JOIN m2 ON m2.index = s.index AND m2.seg = s.seg""")
def null_fill(spark, d):
    filled = signal.fill_nulls(_holed(spark, d), "index", "pos", "x", model=F.lit(0.25))
    return filled.select("index", "pos", F.round("filled", 6).alias("filled"))


@query("WITH r AS (SELECT user_id AS index, event_id AS pos, event_type, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT index, pos, event_type, CAST(sum(c) OVER (PARTITION BY index ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM r")
def entity_runs(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("index"), F.col("event_id").alias("pos"), "event_type")
    return signal.run_ids(e, "index", "pos", "event_type")


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS index FROM orders")
def dense_index(spark, d):
    return facets.dense_index(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "index")


WIDTH = 2.0
_CHUNKED = f"""WITH {AXIS}, b AS (SELECT *, greatest(0, ceil((mz - first_value(mz) OVER (PARTITION BY index ORDER BY pos)) / {WIDTH}) - 1) AS bin FROM ax),
n AS (SELECT index, bin, count(*) = 1 AS one FROM b GROUP BY ALL), g AS (SELECT *, sum(CASE WHEN one THEN 0 ELSE 1 END) OVER (PARTITION BY index ORDER BY bin ROWS UNBOUNDED PRECEDING) AS grp FROM n),
v AS (SELECT *, one AND (row_number() OVER (PARTITION BY index, grp, one ORDER BY bin) - 1) % 2 = 0 AS even FROM g),
s AS (SELECT index, bin, CASE WHEN one THEN even ELSE NOT coalesce(lag(even) OVER (PARTITION BY index ORDER BY bin), false) END AS start FROM v),
c AS (SELECT index, bin, sum(CASE WHEN start THEN 1 ELSE 0 END) OVER (PARTITION BY index ORDER BY bin ROWS UNBOUNDED PRECEDING) - 1 AS chunk_id FROM s),
ch AS (SELECT b.index, b.pos, b.mz, b.intensity, CAST(c.chunk_id AS BIGINT) AS chunk_id FROM b JOIN c ON c.index = b.index AND c.bin = b.bin)"""


@query(_CHUNKED + " SELECT index, pos, mz, intensity, chunk_id FROM ch")
def chunk_grid(spark, d):
    return signal.chunk_ids(axis(spark, d), "index", "pos", "mz", WIDTH)


@query(_CHUNKED + """, q AS (SELECT *, mz - lag(mz) OVER (PARTITION BY index, chunk_id ORDER BY pos) AS dx FROM ch)
SELECT index, chunk_id, min(mz) AS mz_chunk_start, max(mz) AS mz_chunk_end, round(coalesce(sum(dx), 0), 6) AS sum_deltas, count(dx) AS n_deltas, 'MS:1003089' AS chunk_encoding, count(*) AS n_points FROM q GROUP BY index, chunk_id""")
def chunk_encode(spark, d):
    c = chunks.encode_chunks(axis(spark, d), WIDTH)
    total = F.aggregate("mz_chunk_values", F.lit(0.0), lambda s, x: s + x)
    return c.select("index", "chunk_id", "mz_chunk_start", "mz_chunk_end", F.round(total, 6).alias("sum_deltas"), F.size("mz_chunk_values").cast("bigint").alias("n_deltas"), "chunk_encoding", F.size("intensity").cast("bigint").alias("n_points"))


def _decoded(encoding: str) -> Query:
    def f(spark, d):
        c = chunks.decode_chunks(chunks.encode_chunks(axis(spark, d), WIDTH, encoding))
        return c.select("index", "chunk_id", F.round(F.col("mz") * 64).cast("bigint").alias("event"), "intensity")

    return f


for _name, _encoding in (("chunk_decode_delta", chunks.DELTA), ("chunk_decode_plain", chunks.PLAIN), ("chunk_decode_numpress", chunks.NUMPRESS_LINEAR)):
    QUERIES[_name] = _decoded(_encoding)
    ORACLES[_name] = _CHUNKED + " SELECT index, chunk_id, CASE WHEN pos = 0 THEN NULL ELSE pos END AS event, intensity FROM ch" if _encoding == chunks.NUMPRESS_LINEAR else _CHUNKED + " SELECT index, chunk_id, pos AS event, intensity FROM ch"


@query(_CHUNKED + " SELECT index, chunk_id, round(mz, 4) AS mz, intensity FROM ch WHERE mz BETWEEN 10 AND 20")
def chunk_extract(spark, d):
    c = chunks.extract_from_chunks(chunks.encode_chunks(axis(spark, d), WIDTH), 10.0, 20.0)
    return c.select("index", "chunk_id", F.round("mz", 4).alias("mz"), "intensity")


def _marked_axis(spark, d):
    """Coordinates of the signals, ascending and above zero, null with the value where zeros are paired."""
    s = signals(spark, d).select("index", "pos", (F.col("pos") / 64.0 + 1).alias("mz"), F.col("x").alias("intensity"))
    return signal.null_mark(s, "index", "pos", "intensity", ["mz"])


_MARKED_AXIS = MARKED + ", pts AS (SELECT index, pos, CASE WHEN x IS NULL AND raw IS NOT NULL THEN NULL ELSE pos END AS event, x AS intensity FROM (SELECT m.*, sig.x AS raw FROM marked m JOIN sig USING (index, pos)))"


@query(_MARKED_AXIS + " SELECT index, count(*) AS n_points, count(event) AS n_coordinates, min(event) AS first_event, max(event) AS last_event FROM pts GROUP BY 1")
def chunk_encode_marked(spark, d):
    """Chunks of null-marked points: points, coordinates and bounds of each entity."""
    c = chunks.encode_chunks(_marked_axis(spark, d), WIDTH)
    event = lambda x: F.round((F.col(x) - 1) * 64).cast("bigint")
    absolute = F.size(F.array_compact("mz_chunk_values")) + (F.size("mz_chunk_values") < F.size("intensity")).cast("int")
    return c.groupBy("index").agg(F.sum(F.size("intensity")).alias("n_points"), F.sum(absolute).alias("n_coordinates"), F.min(event("mz_chunk_start")).alias("first_event"), F.max(event("mz_chunk_end")).alias("last_event"))


def _decoded_marked(encoding: str) -> Query:
    def f(spark, d):
        c = chunks.decode_chunks(chunks.encode_chunks(_marked_axis(spark, d), WIDTH, encoding))
        n = F.row_number().over(W.partitionBy("index").orderBy("chunk_id", "place")).cast("bigint")
        return c.select("index", n.alias("n"), F.round((F.col("mz") - 1) * 64).cast("bigint").alias("event"), "intensity")

    return f


for _name, _encoding in (("chunk_decode_delta_marked", chunks.DELTA), ("chunk_decode_plain_marked", chunks.PLAIN), ("chunk_decode_numpress_marked", chunks.NUMPRESS_LINEAR)):
    QUERIES[_name] = _decoded_marked(_encoding)
    ORACLES[_name] = _MARKED_AXIS + " SELECT index, row_number() OVER (PARTITION BY index ORDER BY pos) AS n, event, intensity FROM pts"


@query(_MARKED_AXIS + " SELECT index, event, intensity FROM pts WHERE event BETWEEN 576 AND 1216")
def chunk_extract_marked(spark, d):
    c = chunks.extract_from_chunks(chunks.encode_chunks(_marked_axis(spark, d), WIDTH), 10.0, 20.0)
    return c.select("index", F.round((F.col("mz") - 1) * 64).cast("bigint").alias("event"), "intensity")


def _profile(spark, d):
    """The signals with an ascending coordinate, in their order."""
    return signals(spark, d).select("index", "pos", (F.col("pos") / 64.0 + 1).alias("mz"), F.col("x").alias("intensity"))


_STRIPPED = f"""WITH {SIGNALS}, {NEAR}, kept AS (SELECT index, pos, x FROM near WHERE NOT coalesce(x = 0 AND (is_first OR coalesce(prev = 0, false)) AND (is_last OR coalesce(nxt = 0, false)), false)),
n2 AS (SELECT index, pos, x, lag(x) OVER w AS prev, lead(x) OVER w AS nxt FROM kept WINDOW w AS (PARTITION BY index ORDER BY pos)),
mk AS (SELECT index, pos, x = 0 AND (coalesce(prev = 0, false) OR coalesce(nxt = 0, false)) AS gone, x FROM n2),
pts AS (SELECT index, pos, CASE WHEN NOT coalesce(gone, false) THEN pos / 64.0 + 1 END AS mz, CASE WHEN NOT coalesce(gone, false) THEN x END AS intensity FROM mk)"""
_FILLED = _STRIPPED + """, o AS (SELECT *, CASE WHEN mz IS NULL AND lag(mz) OVER w IS NULL AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS o FROM pts WINDOW w AS (PARTITION BY index ORDER BY pos)),
s AS (SELECT index, pos, mz, intensity, sum(o) OVER (PARTITION BY index ORDER BY pos ROWS UNBOUNDED PRECEDING) AS seg FROM o),
dd AS (SELECT *, mz - lag(mz) OVER (PARTITION BY index, seg ORDER BY pos) AS d FROM s), m1 AS (SELECT index, seg, quantile_cont(d, 0.5) AS m FROM dd GROUP BY ALL),
m2 AS (SELECT dd.index, dd.seg, quantile_cont(d, 0.5) AS m FROM dd JOIN m1 ON m1.index = dd.index AND m1.seg = dd.seg AND d <= m1.m GROUP BY ALL),
e AS (SELECT index, seg, arg_min(mz, pos) FILTER (WHERE mz IS NOT NULL) AS lo, arg_max(mz, pos) FILTER (WHERE mz IS NOT NULL) AS hi, min(pos) FILTER (WHERE mz IS NOT NULL) AS lo_pos FROM s GROUP BY ALL),
f AS (SELECT s.index, s.pos, CASE WHEN s.mz IS NOT NULL THEN s.mz WHEN e.lo_pos IS NULL OR s.pos < e.lo_pos THEN e.lo - coalesce(m2.m, 0.25) ELSE e.hi + coalesce(m2.m, 0.25) END AS mz, coalesce(s.intensity, 0) AS intensity
  FROM s JOIN e ON e.index = s.index AND e.seg = s.seg LEFT JOIN m2 ON m2.index = s.index AND m2.seg = s.seg)"""


@query(_STRIPPED + " SELECT index, row_number() OVER (PARTITION BY index ORDER BY pos) AS n, round(mz, 6) AS mz, intensity FROM pts")
def chunk_pipeline(spark, d):
    """The write path and back: zero runs stripped, paired zeros marked, cut, encoded and decoded."""
    c = chunks.decode_chunks(chunks.encode_profile(_profile(spark, d), WIDTH))
    n = F.row_number().over(W.partitionBy("index").orderBy("chunk_id", "place")).cast("bigint")
    return c.select("index", n.alias("n"), F.round("mz", 6).alias("mz"), "intensity")


def _spacing(spark, d):
    """A spacing model for each signal: a constant step."""
    return signals(spark, d).select("index").distinct().withColumn("mz_delta_model", F.array(F.lit(0.25)))


@query(_STRIPPED + " SELECT index, round(mz, 6) AS mz, intensity FROM pts WHERE mz BETWEEN 10 AND 20")
def extract_fill_drop(spark, d):
    marked = signal.null_mark(signal.strip_zero_runs(_profile(spark, d), "index", "pos", "intensity"), "index", "pos", "intensity", ["mz"])
    return extract.extract_points(marked, marked.select("index"), mz=(10.0, 20.0)).select("index", F.round("mz", 6).alias("mz"), "intensity")


@query(_FILLED + " SELECT index, round(mz, 6) AS mz, intensity FROM f WHERE mz BETWEEN 10 AND 20")
def extract_fill_interpolate(spark, d):
    marked = signal.null_mark(signal.strip_zero_runs(_profile(spark, d), "index", "pos", "intensity"), "index", "pos", "intensity", ["mz"])
    rows = extract.extract_points(marked, marked.select("index"), mz=(10.0, 20.0), fill="interpolate", model=_spacing(spark, d))
    return rows.select("index", F.round("mz", 6).alias("mz"), "intensity")


@query(_FILLED + " SELECT index, round(mz, 6) AS mz, intensity FROM f WHERE mz BETWEEN 10 AND 20")
def chunk_fill_interpolate(spark, d):
    """The same slab from the chunk layout."""
    coded = chunks.encode_profile(_profile(spark, d), WIDTH)
    rows = chunks.extract_from_chunks(coded, 10.0, 20.0, fill=chunks.NULL_INTERPOLATE, model=_spacing(spark, d))
    return rows.select("index", F.round("mz", 6).alias("mz"), "intensity")


@query("SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS place, unnest(embedding) AS x FROM embeddings")
def list_explode(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("place", "x"))


# --- models ------------------------------------------------------------------------------------------

_DELTAS = f"WITH {AXIS}, dd AS (SELECT *, mz - lag(mz) OVER (PARTITION BY index ORDER BY pos) AS delta FROM ax)"


@query(_DELTAS + ", m AS (SELECT index, quantile_cont(delta, 0.5) AS median FROM dd GROUP BY 1) SELECT dd.index, round(any_value(m.median), 6) AS median, round(quantile_cont(delta, 0.5), 6) AS second_median FROM dd JOIN m ON m.index = dd.index AND dd.delta <= m.median GROUP BY 1")
def second_median(spark, d):
    m = models.second_median(signal.deltas(axis(spark, d), "index", "pos", "mz"), ["index"], "delta")
    return m.select("index", *[F.round(c, 6).alias(c) for c in ("median", "second_median")])


_SUMS = """sums AS (SELECT l_returnflag, l_linestatus, count(*) AS n, sum(w) AS s0, sum(w*x) AS s1, sum(w*x*x) AS s2, sum(w*x*x*x) AS s3, sum(w*x*x*x*x) AS s4, sum(w*y) AS t0, sum(w*y*x) AS t1, sum(w*y*x*x) AS t2
FROM (SELECT l_returnflag, l_linestatus, (l_quantity - 25) / 15 AS x, l_extendedprice / 10000 AS y, ln(1 + l_quantity) AS w FROM lineitem) GROUP BY ALL)"""
_FITS = f"""WITH {_SUMS}, det AS (SELECT *, s0*(s2*s4 - s3*s3) - s1*(s1*s4 - s3*s2) + s2*(s1*s3 - s2*s2) AS d FROM sums),
fit AS (SELECT l_returnflag, l_linestatus, n, (t0*(s2*s4 - s3*s3) - s1*(t1*s4 - s3*t2) + s2*(t1*s3 - s2*t2))/d AS b0, (s0*(t1*s4 - s3*t2) - t0*(s1*s4 - s3*s2) + s2*(s1*t2 - t1*s2))/d AS b1,
(s0*(s2*t2 - t1*s3) - s1*(s1*t2 - t1*s2) + t0*(s1*s3 - s2*s2))/d AS b2 FROM det)"""


def _fits(spark, d):
    li = table(spark, d, "lineitem")
    x, y = (F.col("l_quantity") - 25) / 15, F.col("l_extendedprice") / 10000
    return models.solve_quadratic(models.power_sums(li, ["l_returnflag", "l_linestatus"], x, y, models.regression_weight(F.col("l_quantity"))))


@query(_FITS + " SELECT l_returnflag, l_linestatus, n, round(b0, 6) AS b0, round(b1, 6) AS b1, round(b2, 6) AS b2 FROM fit")
def wls_normal_equations(spark, d):
    return _fits(spark, d).select("l_returnflag", "l_linestatus", "n", *[F.round(b, 6).alias(b) for b in ("b0", "b1", "b2")])


_ERRORS = _FITS + """, e AS (SELECT l.l_returnflag, l.l_linestatus, l_extendedprice / 10000 AS y, (l_quantity - 25) / 15 AS x FROM lineitem l), c AS (SELECT l_returnflag, l_linestatus, avg(y) AS c FROM e GROUP BY ALL),
er AS (SELECT e.l_returnflag, e.l_linestatus, sum(pow(c.c - y, 2)) AS e_const, sum(pow(b0 + b1*x + b2*x*x - y, 2)) AS e_reg, avg(pow(b0 + b1*x + b2*x*x - y, 2)) AS mse FROM e JOIN c USING (l_returnflag, l_linestatus) JOIN fit USING (l_returnflag, l_linestatus) GROUP BY ALL)"""


def _errors(spark, d):
    keys = ["l_returnflag", "l_linestatus"]
    e = table(spark, d, "lineitem").select(*keys, (F.col("l_extendedprice") / 10000).alias("y"), ((F.col("l_quantity") - 25) / 15).alias("x"))
    c = e.groupBy(*keys).agg(F.avg("y").alias("c"))
    return models.model_errors(e, keys, F.col("x"), F.col("y"), c, _fits(spark, d).select(*keys, F.array("b0", "b1", "b2").alias("beta")))


@query(_ERRORS + " SELECT l_returnflag, l_linestatus, round(e_const, 3) AS e_const, round(e_reg, 3) AS e_reg, round(mse, 5) AS mse FROM er")
def model_errors(spark, d):
    return _errors(spark, d).select("l_returnflag", "l_linestatus", F.round("e_const", 3).alias("e_const"), F.round("e_reg", 3).alias("e_reg"), F.round("mse", 5).alias("mse"))


@query(_ERRORS + " SELECT l_returnflag, l_linestatus, CASE WHEN e_const < e_reg / 10 THEN 'constant' ELSE 'quadratic' END AS model FROM er")
def model_select(spark, d):
    return _errors(spark, d).select("l_returnflag", "l_linestatus", models.selected_model(F.col("e_const"), F.col("e_reg")).alias("model"))


_SPACING = f"""WITH {AXIS}, dd AS (SELECT index, mz, lag(mz) OVER w AS before, mz - lag(mz) OVER w AS d, ln(1 + intensity) AS w FROM ax WINDOW w AS (PARTITION BY index ORDER BY pos)),
m1 AS (SELECT index, quantile_cont(d, 0.5) AS m FROM dd GROUP BY 1), m2 AS (SELECT dd.index, quantile_cont(d, 0.5) AS c FROM dd JOIN m1 ON m1.index = dd.index AND d <= m1.m GROUP BY 1),
k AS (SELECT * FROM dd WHERE d <= 1), p AS (SELECT index, avg(mz) AS mid, stddev_pop(mz) AS scale, count(*) AS n FROM k GROUP BY 1),
z AS (SELECT k.index, (mz - mid) / scale AS z, d AS y, w FROM k JOIN p USING (index)),
s AS (SELECT index, sum(w) AS s0, sum(w*z) AS s1, sum(w*z*z) AS s2, sum(w*z*z*z) AS s3, sum(w*z*z*z*z) AS s4, sum(w*y) AS t0, sum(w*y*z) AS t1, sum(w*y*z*z) AS t2 FROM z GROUP BY 1),
f AS (SELECT *, s0*(s2*s4 - s3*s3) - s1*(s1*s4 - s3*s2) + s2*(s1*s3 - s2*s2) AS det FROM s),
q AS (SELECT index, (t0*(s2*s4 - s3*s3) - s1*(t1*s4 - s3*t2) + s2*(t1*s3 - s2*t2))/det AS c0, (s0*(t1*s4 - s3*t2) - t0*(s1*s4 - s3*s2) + s2*(s1*t2 - t1*s2))/det AS c1, (s0*(s2*t2 - t1*s3) - s1*(s1*t2 - t1*s2) + t0*(s1*s3 - s2*s2))/det AS c2 FROM f),
e AS (SELECT dd.index, sum(pow(c - d, 2)) AS e_const, sum(pow(c0 + c1 * ((before - mid) / scale) + c2 * pow((before - mid) / scale, 2) - d, 2)) AS e_reg FROM dd JOIN m2 USING (index) LEFT JOIN q USING (index) LEFT JOIN p USING (index) WHERE d IS NOT NULL GROUP BY 1),
r AS (SELECT index, coalesce(p.n, 0) < 3 OR e_const < e_reg / 10 AS is_const, c, c0, c1, c2, mid, scale FROM m2 JOIN e USING (index) LEFT JOIN q USING (index) LEFT JOIN p USING (index)),
b AS (SELECT index, unnest([min(mz), max(mz)]) AS mz FROM ax GROUP BY 1)"""


@query(_SPACING + " SELECT index, round(b.mz, 6) AS mz, CASE WHEN is_const THEN 1 ELSE 3 END AS n_coefficients, round(CASE WHEN is_const THEN c ELSE c0 + c1 * ((b.mz - mid) / scale) + c2 * pow((b.mz - mid) / scale, 2) END, 4) AS step FROM r JOIN b USING (index)")
def spacing_models(spark, d):
    """The model of every entity, shown by the steps it predicts at the lowest and highest coordinate."""
    ax = axis(spark, d)
    ends = ax.groupBy("index").agg(F.array(F.min("mz"), F.max("mz")).alias("ends")).select("index", F.explode("ends").alias("mz"))
    told = models.spacing_models(ax).where(F.size("mz_delta_model") > 0).join(ends, "index")
    return told.select("index", F.round("mz", 6).alias("mz"), F.size("mz_delta_model").alias("n_coefficients"), F.round(models.predict(F.col("mz_delta_model"), F.col("mz")), 4).alias("step"))


@query("SELECT spectrum_key, CAST(generate_subscripts(mz_delta_model, 1) - 1 AS INTEGER) AS place, unnest(mz_delta_model) AS coefficient, CAST(len(mz_delta_model) AS INTEGER) AS n FROM (SELECT DISTINCT spectrum_key, mz_delta_model FROM spectrum WHERE mz_delta_model IS NOT NULL)")
def delta_model_column(spark, d):
    return models.model_coefficients(table(spark, d, "spectrum"), "spectrum_key")


# --- facets, joins and parameters --------------------------------------------------------------------

_SCANS = "scans AS (SELECT l_orderkey AS source_index, l_linenumber AS n, l_quantity AS q FROM lineitem)"


def _packed(spark, d):
    """Orders and their customers' numbers as a packed table: unrelated facets side by side."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("index"), F.col("o_orderpriority").alias("id"))
    i = table(spark, d, "selected_ion").select("ion_id", F.col("spectrum_index").alias("source_index"), F.col("selected_ion_mz").alias("mz"))
    left = o.select(F.struct("index", "id").alias("spectrum"), F.lit(None).cast("struct<ion_id:bigint,source_index:bigint,mz:double>").alias("selected_ion"))
    right = i.select(F.lit(None).cast("struct<index:bigint,id:string>").alias("spectrum"), F.struct("ion_id", "source_index", "mz").alias("selected_ion"))
    return left.unionByName(right)


@query("SELECT ion_id, spectrum_index AS source_index, selected_ion_mz AS mz FROM selected_ion WHERE spectrum_index IS NOT NULL")
def facet_of_packed(spark, d):
    return facets.facet(_packed(spark, d), "selected_ion")


@query("SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM selected_ion WHERE spectrum_index IS NOT NULL) AS n_rows")
def any_facet_filled(spark, d):
    return facets.any_facet(_packed(spark, d)).agg(F.count("*").alias("n_rows"))


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderkey = 7) AS n_spectra, (SELECT count(*) FROM selected_ion WHERE spectrum_index = 7) AS n_ions, (SELECT sum(selected_ion_mz) FROM selected_ion WHERE spectrum_index = 7) AS sum_mz")
def entity_lookup(spark, d):
    """One entity's rows of all facets."""
    own = facets.entity(_packed(spark, d), 7)
    return own["spectrum"].agg(F.count("*").alias("n_spectra")).join(own["selected_ion"].agg(F.count("*").alias("n_ions"), F.sum("mz").alias("sum_mz")))


@query("""SELECT ion_id, CAST(coalesce(len(parameters), 0) + (charge_state IS NOT NULL)::INTEGER + (intensity IS NOT NULL)::INTEGER AS INTEGER) AS n_after,
CASE WHEN charge_state IS NOT NULL OR intensity IS NOT NULL THEN CASE WHEN intensity IS NOT NULL THEN 'MS:1000042' ELSE 'MS:1000041' END END AS last_accession, CASE WHEN intensity IS NOT NULL THEN 'MS:1000131' END AS last_unit FROM selected_ion""")
def unknown_columns_to_parameters(spark, d):
    """Columns a reader doesn't know, by their inflected names."""
    ions = table(spark, d, "selected_ion").select("ion_id", "parameters", F.col("charge_state").alias("MS_1000041_charge_state"), F.col("intensity").alias("MS_1000042_peak_intensity_unit_MS_1000131"))
    after = facets.unknown_columns_to_parameters(ions, "parameters", ["ion_id"])
    last = F.try_element_at(F.coalesce("parameters", F.array().cast(after.schema["parameters"].dataType)), F.lit(-1))
    added = F.col("had_charge") | F.col("had_intensity")
    told = after.join(ions.select("ion_id", F.col("MS_1000041_charge_state").isNotNull().alias("had_charge"), F.col("MS_1000042_peak_intensity_unit_MS_1000131").isNotNull().alias("had_intensity")).distinct(), "ion_id")
    return told.select("ion_id", F.coalesce(F.size(F.col("parameters")), F.lit(0)).alias("n_after"), F.when(added, last["accession"]).alias("last_accession"), F.when(F.col("had_intensity"), last["unit"]).alias("last_unit"))


@query("""SELECT DISTINCT ion_id, CAST(len(list_filter(parameters, lambda p: p IS NOT NULL)) AS INTEGER) AS n, list_filter(parameters, lambda p: p IS NOT NULL)[1].accession AS accession, list_filter(parameters, lambda p: p IS NOT NULL)[1].unit AS unit FROM selected_ion WHERE parameters IS NOT NULL""")
def param_normalise(spark, d):
    p = facets.normalised_parameters(F.col("parameters"))
    first = F.try_element_at(p, F.lit(1))
    return table(spark, d, "selected_ion").where("parameters is not null").select("ion_id", F.size(p).alias("n"), first["accession"].alias("accession"), first["unit"].alias("unit")).distinct()


@query(f"WITH {META}, {_SCANS}, a AS (SELECT source_index AS index, count(*) AS n_scans, min(n) AS first_scan, sum(q) AS total FROM scans GROUP BY 1) SELECT m.index, coalesce(n_scans, 0) AS n_scans, first_scan, total FROM meta m LEFT JOIN a ON a.index = m.index")
def facet_assembly(spark, d):
    scans = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_index"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"))
    whole = facets.assemble(meta(spark, d), scans, "scans", ["n", "q"])
    total = F.when(F.size("scans") > 0, F.aggregate("scans", F.lit(0.0), lambda s, x: s + x["q"]))
    return whole.select("index", F.size("scans").cast("bigint").alias("n_scans"), F.try_element_at("scans", F.lit(1))["n"].alias("first_scan"), total.alias("total"))


_SIDES = """pre AS (SELECT l_orderkey AS source_index, nullif(l_linenumber, 1) AS precursor_index, min(l_extendedprice) AS target FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL),
ion AS (SELECT l_orderkey AS source_index, nullif(l_linenumber, 1) AS precursor_index, l_partkey AS ion FROM lineitem WHERE l_returnflag = 'R')"""


def _sides(spark, d):
    li = table(spark, d, "lineitem").withColumns({"source_index": F.col("l_orderkey"), "precursor_index": F.nullif(F.col("l_linenumber"), F.lit(1))})
    pre = li.where("l_returnflag = 'N'").groupBy("source_index", "precursor_index").agg(F.min("l_extendedprice").alias("target"))
    return pre, li.where("l_returnflag = 'R'").select("source_index", "precursor_index", F.col("l_partkey").alias("ion"))


@query(f"WITH {_SIDES} SELECT i.source_index, i.precursor_index, i.ion, p.target FROM ion i JOIN pre p ON p.source_index = i.source_index AND p.precursor_index IS NOT DISTINCT FROM i.precursor_index")
def nullsafe_pair_join(spark, d):
    pre, ion = _sides(spark, d)
    return facets.precursors_with_ions(pre, ion, fallback=False).select("source_index", "precursor_index", "ion", F.col("precursor.target").alias("target"))


@query(f"""WITH {_SIDES}, l AS (SELECT source_index, arg_max(target, coalesce(precursor_index, -1)) AS target FROM pre GROUP BY 1)
SELECT i.source_index, i.precursor_index, i.ion, CASE WHEN p.source_index IS NULL THEN l.target ELSE p.target END AS target FROM ion i
LEFT JOIN pre p ON p.source_index = i.source_index AND p.precursor_index IS NOT DISTINCT FROM i.precursor_index LEFT JOIN l ON l.source_index = i.source_index""")
def precursors_with_ions(spark, d):
    pre, ion = _sides(spark, d)
    return facets.precursors_with_ions(pre, ion).select("source_index", "precursor_index", "ion", F.col("precursor.target").alias("target"))


@query("""WITH m AS (SELECT o_orderkey AS index, 'c' || o_custkey AS id FROM orders), p AS (SELECT l_orderkey AS source_index, 'c' || (l_partkey % 1500) AS precursor_id FROM lineitem)
SELECT p.source_index, p.precursor_id, (SELECT max(m.index) FROM m WHERE m.id = p.precursor_id AND m.index <= p.source_index) AS precursor_index FROM p""")
def resolve_precursor_ids(spark, d):
    m = table(spark, d, "orders").select(F.col("o_orderkey").alias("index"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id"))
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_index"), F.concat(F.lit("c"), (F.col("l_partkey") % 1500).cast("string")).alias("precursor_id"), F.lit(None).cast("bigint").alias("precursor_index"))
    return facets.resolve_precursors(p, m)


@query("SELECT count(*) AS n, count(missing) AS n_missing, min(id) AS first_id FROM (SELECT o_orderkey AS id, NULL AS missing FROM orders)")
def promote_to_nested(spark, d):
    flat = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    n = facets.to_nested(flat, [("id", "bigint"), ("missing", "double")], "spectrum")
    return n.agg(F.count("*").alias("n"), F.count("spectrum.missing").alias("n_missing"), F.min("spectrum.id").alias("first_id"))


@query("SELECT DISTINCT ion_id, list_filter(parameters, lambda p: p.accession = 'LX:0000062')[1].value.integer AS frame FROM selected_ion")
def param_lookup(spark, d):
    return table(spark, d, "selected_ion").select("ion_id", facets.parameter(F.col("parameters"), "LX:0000062", "integer").alias("frame")).distinct()


@query("SELECT DISTINCT ion_id, CAST(len(list_filter(parameters, lambda p: p.accession IS NULL OR p.accession <> 'LX:0000062')) AS INTEGER) AS n_left FROM selected_ion WHERE parameters IS NOT NULL")
def param_masked(spark, d):
    kept = facets.without_parameters(F.col("parameters"), ["LX:0000062"])
    return table(spark, d, "selected_ion").where("parameters is not null").select("ion_id", F.size(kept).alias("n_left")).distinct()


@query("SELECT DISTINCT ion_id, CAST(coalesce(len(parameters), 0) + CASE WHEN ion_mobility IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n_after, ion_mobility AS added FROM selected_ion")
def column_to_param(spark, d):
    after = facets.with_parameter(F.col("parameters"), F.col("ion_mobility"), "float", "MS:1002476", "ion mobility drift time")
    added = F.when(F.col("ion_mobility").isNotNull(), F.try_element_at(after, F.lit(-1))["value"]["float"])
    return table(spark, d, "selected_ion").select("ion_id", F.size(F.coalesce(after, F.array().cast(table(spark, d, "selected_ion").schema["parameters"].dataType))).alias("n_after"), added.alias("added")).distinct()


@query("""SELECT param_id, CASE WHEN value.integer IS NOT NULL OR value.float IS NULL THEN coalesce(CAST(value.integer AS VARCHAR), value.string, CAST(value.boolean AS VARCHAR)) END AS text,
CASE WHEN value.integer IS NULL AND CAST(value.float AS VARCHAR) <> 'nan' THEN value.float END AS number FROM spectrum_parameter""")
def param_value_text(spark, d):
    """Every parameter's value as text. Engines write floats differently, so the text of a float is read again as a number; not-a-number is shown as null."""
    v = F.col("value")
    is_float = v["integer"].isNull() & v["float"].isNotNull()
    told = table(spark, d, "spectrum_parameter").select("param_id", params.value_text(v).alias("text"), is_float.alias("is_float"))
    number = F.col("text").try_cast("double")
    return told.select("param_id", F.when(~F.coalesce("is_float", F.lit(False)), F.col("text")).alias("text"), F.when(F.col("is_float") & ~F.isnan(number), number).alias("number"))


@query("SELECT attribute_name, replace(accession, ':', '_') || '_' || regexp_replace(replace(attribute_name, 'm/z', 'mz'), '[^a-zA-Z0-9]', '_', 'g') || coalesce('_unit_' || replace(common_unit, ':', '_'), '') AS column_name FROM attribute_ref")
def cv_inflect(spark, d):
    return table(spark, d, "attribute_ref").select("attribute_name", cv.column_name(F.col("accession"), F.col("attribute_name"), F.col("common_unit")).alias("column_name"))


@query(r"""SELECT DISTINCT name, nullif(replace(regexp_extract(name, '^((MS|UO)_[^_]+)_.', 1), '_', ':'), '') AS accession,
CASE WHEN regexp_matches(name, '^(MS|UO)_[^_]+_.') THEN regexp_replace(regexp_replace(name, '^[A-Z]+_[^_]+_', ''), '_unit_[A-Za-z]+_[0-9]+$', '') ELSE name END AS bare,
nullif(replace(regexp_extract(name, '_unit_([A-Za-z]+_[0-9]+)$', 1), '_', ':'), '') AS unit FROM spectrum_parameter""")
def cv_parse(spark, d):
    n = F.col("name")
    return table(spark, d, "spectrum_parameter").select("name").distinct().select("name", cv.accession_of(n).alias("accession"), cv.name_of(n).alias("bare"), cv.unit_of(n).alias("unit"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'MS:' || o_custkey ELSE 'UO:' || lpad(CAST(o_custkey AS VARCHAR), 7, '0') END AS curie FROM orders")
def curie_format(spark, d):
    return table(spark, d, "orders").select("o_orderkey", cv.curie(F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(2), F.col("o_custkey")).alias("curie"))


_ENTRY_FORMS = ", ".join(f"('{form}', '{field}')" for form, field in drift.approved_forms(drift.TARGETS["file_entry"], drift.APPROVED["file_entry"]).items() if field in ("name", "data_kind", "entity_type"))


@query(f"""WITH f(form, field) AS (VALUES {_ENTRY_FORMS}),
l AS (SELECT DISTINCT file_id, line_no, raw_json FROM archive_line WHERE record_kind = 'file_entry' AND json_valid(raw_json) AND json_type(raw_json) = 'OBJECT'),
k AS (SELECT file_id, line_no, raw_json, unnest(json_keys(raw_json)) AS key FROM l),
v AS (SELECT file_id, line_no, f.field, min(raw_json ->> ('$."' || key || '"')) AS v FROM k JOIN f ON f.form = lower(regexp_replace(regexp_replace(regexp_replace(key, '^[A-Z]+_[0-9]+_', ''), '_unit(_[A-Z]+_[0-9]+)?$', ''), '[^A-Za-z0-9]+', '', 'g')) GROUP BY ALL),
w AS (SELECT l.file_id, l.line_no, max(v) FILTER (WHERE field = 'name') AS name, lower(trim(max(v) FILTER (WHERE field = 'data_kind'))) AS data_kind, lower(trim(max(v) FILTER (WHERE field = 'entity_type'))) AS entity_type FROM l LEFT JOIN v USING (file_id, line_no) GROUP BY ALL)
SELECT name, CASE WHEN data_kind IN ('data arrays', 'peaks', 'metadata', 'proprietary') THEN data_kind ELSE 'other' END AS data_kind, CASE WHEN entity_type IN ('spectrum', 'chromatogram') THEN entity_type ELSE 'other' END AS entity_type FROM w""")
def member_kinds(spark, d):
    """The kinds of all file entries, whatever approved spelling their keys have."""
    entries = drift.ingest(table(spark, d, "archive_line"), "file_entry")
    return entries.select("name", cv.data_kind(F.col("data_kind")).alias("data_kind"), cv.entity_type(F.col("entity_type")).alias("entity_type"))


@query("SELECT DISTINCT spectrum_key, CAST(CASE polarity WHEN 1 THEN 1 WHEN -1 THEN -1 END AS TINYINT) AS polarity, CASE WHEN ms_level = 1 THEN 'MS:1000579' WHEN ms_level > 1 THEN 'MS:1000580' END AS spectrum_type FROM spectrum")
def polarity_and_type(spark, d):
    return table(spark, d, "spectrum").select("spectrum_key", cv.polarity(F.col("polarity")).alias("polarity"), cv.default_spectrum_type(F.col("ms_level")).alias("spectrum_type")).distinct()


@query(f"WITH {POINTS} SELECT index, mz, round(sqrt(ln(1 + intensity)), 9) AS weight FROM points")
def regression_weights(spark, d):
    return points(spark, d).select("index", "mz", F.round(F.sqrt(models.regression_weight(F.col("intensity"))), 9).alias("weight"))


@query("SELECT number_of_auxiliary_arrays AS n_arrays, count(DISTINCT spectrum_key) AS n_spectra FROM spectrum GROUP BY 1")
def auxiliary_counts(spark, d):
    return summaries.counts_by(table(spark, d, "spectrum"), "number_of_auxiliary_arrays", "n_arrays", "spectrum_key").withColumnRenamed("n", "n_spectra")


# Bytes in SQL: the i-th little-endian number of a payload by its digits; lengths tell how many values there are.
_BYTE = "(a.data[{at} + {k}] & 255)"
_INT = " + ".join(f"CAST({_BYTE.format(at='4 * i', k=k + 1)} AS BIGINT) * {256**k}" for k in range(4))
_AT = lambda i: f"CAST(a.data[{i}] & 255 AS BIGINT)"
_HIGH4 = f"(({_AT(4)} & 127) * 2 + ({_AT(3)} >> 7))"
_FRACTION4 = f"(({_AT(3)} & 127) * 65536 + {_AT(2)} * 256 + {_AT(1)})"
_HIGH8 = f"(({_AT(8)} & 127) * 16 + ({_AT(7)} >> 4))"
_FRACTION8 = f"(({_AT(7)} & 15) * 281474976710656 + " + " + ".join(f"{_AT(k + 1)} * {256**k}" for k in range(6)) + ")"
_AUXILIARY = f"""WITH one AS (SELECT spectrum_key, min(row(loaded_at, auxiliary_arrays))[2] AS arrays FROM spectrum WHERE number_of_auxiliary_arrays > 0 GROUP BY 1),
e AS (SELECT spectrum_key, unnest(arrays) AS a, CAST(generate_subscripts(arrays, 1) - 1 AS INTEGER) AS place FROM one),
t AS (SELECT spectrum_key, place, a.name.name AS name, a, coalesce(len(a.data), 0) AS n,
  CASE WHEN a.compression IN ('MS:1002312', 'MS:1002313', 'MS:1002314') THEN CASE WHEN coalesce(len(a.data), 0) = 0 OR (len(a.data) >= 8 AND len(a.data) % 4 = 0) THEN 'floats' END
    WHEN a.compression = 'MS:1000574' THEN NULL WHEN a.data_type = 'MS:1001479' THEN 'texts'
    WHEN a.data_type = 'MS:1000519' AND coalesce(len(a.data), 0) % 4 = 0 THEN 'integers' WHEN a.data_type = 'MS:1000521' AND coalesce(len(a.data), 0) % 4 = 0 THEN 'floats' WHEN a.data_type = 'MS:1000523' AND coalesce(len(a.data), 0) % 8 = 0 THEN 'floats' END AS kind FROM e WHERE a IS NOT NULL)
SELECT spectrum_key, place, name, kind,
  CAST(CASE WHEN kind IS NULL THEN NULL WHEN a.compression = 'MS:1002312' THEN CASE WHEN n = 0 THEN 0 ELSE (n - 8) / 4 END
    WHEN kind = 'texts' THEN len(list_filter(string_split(array_to_string(list_transform(coalesce(a.data, []), lambda b: CASE WHEN b & 255 = 0 THEN '|' ELSE 'x' END), ''), '|'), lambda p: p <> ''))
    WHEN a.data_type = 'MS:1000523' THEN n / 8 ELSE n / 4 END AS INTEGER) AS n_values,
  CASE WHEN kind = 'integers' AND n > 0 THEN list_sum(list_transform(range(0, n // 4), lambda i: ({_INT}) - CASE WHEN a.data[4 * i + 4] & 128 > 0 THEN 4294967296 ELSE 0 END))::BIGINT END AS total,
  CASE WHEN kind = 'floats' AND a.compression = 'MS:1000576' AND n > 0 THEN CASE
    WHEN a.data_type = 'MS:1000521' AND {_HIGH4} BETWEEN 1 AND 254 THEN CASE WHEN a.data[4] & 128 > 0 THEN -1 ELSE 1 END * pow(2.0, {_HIGH4} - 127) * (1 + {_FRACTION4} / 8388608.0)
    WHEN a.data_type = 'MS:1000523' AND {_HIGH8} BETWEEN 1 AND 2046 THEN CASE WHEN a.data[8] & 128 > 0 THEN -1 ELSE 1 END * pow(2.0, {_HIGH8} - 1023) * (1 + {_FRACTION8} / 4503599627370496.0) END END AS first_float FROM t"""


@query(_AUXILIARY)
def auxiliary_values(spark, d):
    """Decoded auxiliary arrays: what they hold, how many, the sum of whole numbers and the first plainly written float.

    SQL has neither of the codecs: the test tables' Zlib payloads are damaged, and their Numpress ones end
    with the two values written in full, which is what it counts. Not-a-number, infinite and subnormal values are shown as null.
    """
    s = table(spark, d, "spectrum").where("number_of_auxiliary_arrays > 0").groupBy("spectrum_key").agg(F.min(F.struct("loaded_at", "number_of_auxiliary_arrays", "auxiliary_arrays")).alias("r")).select("spectrum_key", "r.*")
    v = chunks.auxiliary_values(s)
    kind = F.when(F.col("integers").isNotNull(), "integers").when(F.col("floats").isNotNull(), "floats").when(F.col("texts").isNotNull(), "texts")
    size = F.coalesce(*[F.when(F.col(c).isNotNull(), F.size(c)) for c in ("integers", "floats", "texts")])
    total = F.when(F.size("integers") > 0, F.aggregate("integers", F.lit(0).cast("bigint"), lambda a, x: a + x))
    first = F.when(F.col("compression") == chunks.PLAIN, F.try_element_at("floats", F.lit(1)))
    least = F.when(F.col("data_type") == "MS:1000521", 2.0**-126).otherwise(2.2250738585072014e-308)
    shown = F.when(~F.isnan(first) & (F.abs(first) != float("inf")) & (F.abs(first) >= least), first)
    return v.select("spectrum_key", "place", "name", kind.alias("kind"), size.alias("n_values"), total.alias("total"), shown.alias("first_float"))


@query("SELECT l_orderkey, count(*) AS n, round(sum(l_extendedprice), 2) AS linear_total, sum(floor(l_extendedprice + 0.5)) AS pic_total, true AS slof_fits FROM lineitem GROUP BY 1")
def numpress_round_trip(spark, d):
    """Each order's prices through the three codecs and back: to the cent, to the whole, and within a thousandth."""
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_extendedprice")).alias("v"))
    back = lists.select("l_orderkey", "v", chunks.decode_linear(chunks.encode_linear("v")).alias("l"), chunks.decode_slof(chunks.encode_slof("v")).alias("s"), chunks.decode_pic(chunks.encode_pic("v")).alias("p"))
    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda t, x: t + f(x))
    near = F.forall(F.zip_with("v", "s", lambda a, b: F.abs(a - b) <= a * 1e-3), lambda ok: ok)
    return back.select("l_orderkey", F.size("v").cast("bigint").alias("n"), F.round(total("l", lambda x: F.round(x, 2)), 2).alias("linear_total"), total("p", lambda x: x).alias("pic_total"), near.alias("slof_fits"))


_MGF = f"""WITH {META}, {POINTS}, pk AS (SELECT index, string_agg(printf('%.4f %.4f', mz, intensity), chr(10) ORDER BY mz, intensity) AS body FROM points GROUP BY 1),
ion AS (SELECT l_orderkey AS index, min(l_extendedprice) AS mz, arg_min(l_linenumber, (l_extendedprice, l_linenumber)) AS charge FROM lineitem GROUP BY 1)
SELECT concat_ws(chr(10), 'BEGIN IONS', 'TITLE=order=' || m.index, printf('RTINSECONDS=%.4f', m.time * 60), printf('PEPMASS=%.4f', ion.mz), 'CHARGE=' || ion.charge || '+', body, 'END IONS' || chr(10)) AS value
FROM meta m JOIN pk USING (index) LEFT JOIN ion USING (index)""".replace("arg_min(l_linenumber, (l_extendedprice, l_linenumber))", "min(row(l_extendedprice, l_linenumber))[2]")


@query(_MGF)
def mgf_export(spark, d):
    """Orders as MGF text blocks."""
    from slabworks.sources.archive import mgf_text

    m = meta(spark, d).withColumn("id", F.concat(F.lit("order="), F.col("index").cast("string")))
    ions = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("index"), F.col("l_extendedprice").alias("mz"), F.col("l_linenumber").alias("charge"))
    return mgf_text(points(spark, d), m, ions)


@query("SELECT spectrum_key, scan_time AS scan_start_time, CASE WHEN CAST(total_ion_current AS VARCHAR) <> 'nan' THEN total_ion_current END AS total_ion_current FROM spectrum")
def rename_by_vocabulary(spark, d):
    """Inflected column names, nested ones too, as plain names; not-a-number is shown as null, as nothing was measured."""
    s = table(spark, d, "spectrum").select("spectrum_key", F.col("scan_time").alias("MS_1000016_scan_start_time_unit_UO_0000031"), F.struct(F.col("total_ion_current").alias("MS_1000285_total_ion_current_unit_MS_1000131")).alias("measures"))
    named = cv.rename_by_vocabulary(s).select("spectrum_key", "scan_start_time", "measures.total_ion_current")
    return named.withColumn("total_ion_current", F.when(~F.isnan("total_ion_current"), F.col("total_ion_current")))


@query(MARKED + " SELECT index, pos, coalesce(x, 0) AS x FROM marked")
def null_intensity_as_zero(spark, d):
    """What a single-entity read gives for null intensities."""
    return signal.nulls_as_zero(_marked(spark, d), "x")


@query(f"WITH {_SIDES} SELECT source_index, count(*) AS n, arg_max(target, coalesce(precursor_index, -1)) AS first_target, arg_min(target, coalesce(precursor_index, -1)) AS last_target FROM pre GROUP BY 1")
def precursors_in_reverse(spark, d):
    """Precursors of each source from the highest index down, so the lowest comes last; a null index is the lowest."""
    pre, _ = _sides(spark, d)
    lists = facets.precursors_reversed(pre, ["target"], "p")
    return lists.select("source_index", F.size("p").cast("bigint").alias("n"), F.element_at("p", 1)["target"].alias("first_target"), F.element_at("p", -1)["target"].alias("last_target"))
