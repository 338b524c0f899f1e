"""Queries p1 to p6: upkeep of run metadata for training data, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slabworks.operators import digest, drift, nested, orphans, units, wide
from slabworks.session import materialise, table

Query = Callable[[SparkSession, str], DataFrame]


def _normalised(spark: SparkSession, d: str) -> DataFrame:
    return units.normalise_units(table(spark, d, "spectrum_parameter"), table(spark, d, "meta_param"), table(spark, d, "attribute_ref"), table(spark, d, "unit_ref"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return units.recorded_in_other_units(_normalised(spark, d))


def p1_common_values(spark: SparkSession, d: str) -> DataFrame:
    """Values per attribute and recorded unit, brought into the common unit."""
    n = _normalised(spark, d).dropDuplicates(["table_name", "row_id"])
    return n.where("recorded_unit is not null").groupBy("attribute", "common_unit", "recorded_unit").agg(
        F.count("*").alias("n_values"), F.round(F.min("common_value"), 4).alias("lowest"), F.round(F.max("common_value"), 4).alias("highest")
    )


def p1_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every way a unit is written: the unit it was told to be, by what, and how many values have it."""
    obs = units.read_parameters(table(spark, d, "spectrum_parameter"), table(spark, d, "meta_param"), table(spark, d, "attribute_ref"))
    stats = materialise(units.source_statistics(obs))
    return units.label_report(stats, units.resolve_labels(stats, table(spark, d, "unit_ref"), units.source_links(obs, stats)))


def _referring(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("spectrum", "selected_ion", "data_processing")]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.run_orphans(*_referring(spark, d)).select("table_name", "field_name", "row_id")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.run_orphan_counts(*_referring(spark, d))


def _values(spark: SparkSession, d: str) -> DataFrame:
    return digest.run_values(table(spark, d, "spectrum"), table(spark, d, "selected_ion"))


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Certified percentiles per field, MS level and day."""
    v = _values(spark, d)
    return digest.percentiles(v, digest.daily_digests(v), digest.DAY_KEYS).withColumn("stated_error", digest.stated_error())


def p3_combined(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per field and MS level over all days, from the digests of the days."""
    v = _values(spark, d)
    return digest.percentiles(v, digest.daily_digests(v), digest.WHOLE_KEYS).withColumn("stated_error", digest.stated_error())


def p3_certified(spark: SparkSession, d: str) -> DataFrame:
    """Whether each answer's counted rank error is within the stated one; the extremes are exact."""
    return p3_percentiles(spark, d).select("field_name", "ms_level", "day", "quantile", "n", "low", "high", (F.col("rank_error") <= F.col("stated_error")).alias("within"))


def p3_combined_certified(spark: SparkSession, d: str) -> DataFrame:
    return p3_combined(spark, d).select("field_name", "ms_level", "quantile", "n", "low", "high", (F.col("rank_error") <= F.col("stated_error")).alias("within"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    attributes = table(spark, d, "attribute_ref")
    return wide.filled_cells(wide.wide_table(table(spark, d, "spectrum_parameter"), attributes), wide.attribute_columns(attributes))


def p4_wide(spark: SparkSession, d: str) -> DataFrame:
    return wide.wide_table(table(spark, d, "spectrum_parameter"), table(spark, d, "attribute_ref")).drop("entity_ordinal")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "archive_line")).select("file_id", "field_name", "change_kind")


def _ingest(kind: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return drift.ingest(table(spark, d, "archive_line"), kind).drop("loaded_at")

    return query


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """All children, told from whole records with the data of their arrays."""
    return nested.run_children(table(spark, d, "spectrum"), table(spark, d, "selected_ion"), payload=True)


def p6_parameters(spark: SparkSession, d: str) -> DataFrame:
    """The parameter children with their typed values."""
    return nested.parameter_table(nested.run_children(table(spark, d, "spectrum"), table(spark, d, "selected_ion"), with_record=True))


def p6_arrays(spark: SparkSession, d: str) -> DataFrame:
    """The auxiliary arrays with their own columns and their data."""
    return nested.array_table(nested.run_children(table(spark, d, "spectrum"), table(spark, d, "selected_ion"), with_record=True, payload=True))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_common_values": p1_common_values,
    "p1_labels": p1_labels,
    "p2_found": p2_found,
    "p2_counts": p2_counts,
    "p3_percentiles": p3_percentiles,
    "p3_combined": p3_combined,
    "p3_certified": p3_certified,
    "p3_combined_certified": p3_combined_certified,
    "p4_found": p4_found,
    "p4_wide": p4_wide,
    "p5_found": p5_found,
    "p5_selected_ion": _ingest("selected_ion"),
    "p5_array_index_entry": _ingest("array_index_entry"),
    "p5_file_entry": _ingest("file_entry"),
    "p6_found": p6_found,
    "p6_parameters": p6_parameters,
    "p6_arrays": p6_arrays,
}

# --- the same in SQL ---------------------------------------------------------------------------------

#: What each written unit means, in plain words.
_LABELS = {
    "UO:0000010": ["s", "second", "seconds", "sec"], "UO:0000028": ["ms", "millisecond", "milliseconds", "msec", "mSec"],
    "UO:0000029": ["us", "µs", "usec", "microsecond", "microseconds"], "UO:0000031": ["min", "minute", "minutes", "Min"], "UO:0000032": ["h", "hr", "hour", "hours"],
    "UO:0000012": ["K", "kelvin", "Kelvin"], "UO:0000027": ["°C", "℃", "degC", "deg C", "Celsius"], "UO:0000195": ["°F", "degF", "deg F", "Fahrenheit"],
    "UO:0000218": ["V", "volt", "Volts"], "UO:0000247": ["mV", "millivolt", "millivolts"], "UO:0000248": ["kV", "kilovolt", "kilovolts"],
    "UO:0000018": ["nm", "nanometer", "nanometres"], "UO:0000017": ["um", "µm", "micron", "micrometer"], "UO:0000016": ["mm", "millimeter", "millimetres"],
    "UO:0000187": ["%", "pct", "percent"], "UO:0000191": ["fraction"], "UO:0000169": ["ppm", "parts per million"], "UO:0000266": ["eV", "electronvolt", "electron volts"],
}
_LABEL_ROWS = ", ".join(f"('{x}', '{u}')" for u, xs in _LABELS.items() for x in [*xs, "Sec"] if x != "Sec" or u == "UO:0000010")
_SQ = r"trim(regexp_replace({}, '[\s\x{{00A0}}]+', ' ', 'g'))"
_CURIE = r"(CASE WHEN regexp_matches(upper({0}), '^[A-Z]+[:_ ][0-9]+$') THEN regexp_extract(upper({0}), '^([A-Z]+)', 1) || ':' || lpad(regexp_extract({0}, '[:_ ]0*([0-9]+)$', 1), 7, '0') END)"
_NAME = r"regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace({0}, '^[A-Za-z]+_[0-9]+_', ''), '_unit(_[A-Za-z]+_[0-9]+)?$', ''), ' *(\([^()]*\)|\[[^\[\]]*\]|,[^,]*)$', '')), '[^a-z0-9]+', '', 'g')"
_NUM = r"'^([+-]?([0-9]+([.,][0-9]+)*[.]?|[.,][0-9]+)([eE][+-]?[0-9]+)?) *[\[(]? *([^0-9\[\]()]*?) *[\])]?$'"


def _sq(x: str) -> str:
    return _SQ.format(x)


_P1_BASE = f"""
WITH lab(label, unit) AS (VALUES {_LABEL_ROWS}),
rows0 AS (
  SELECT 'spectrum_parameter' AS table_name, param_id AS row_id, {_sq('accession')} AS acc, {_sq('name')} AS name, {_sq('unit')} AS unit,
         coalesce(CAST(value.integer AS DOUBLE), CASE WHEN CAST(value.float AS VARCHAR) NOT IN ('nan', 'inf', '-inf') THEN value.float END) AS number, {_sq('value.string')} AS v FROM spectrum_parameter
  UNION ALL
  SELECT 'meta_param', meta_id, {_sq('accession')}, {_sq('name')}, {_sq('unit')}, NULL, {_sq('value')} FROM meta_param),
rows1 AS (
  SELECT table_name, row_id, acc, name, number, regexp_extract(v, {_NUM}, 1) AS t,
    coalesce(nullif(unit, ''), nullif(regexp_extract(name, '_unit_([A-Za-z]+_[0-9]+)$', 1), ''), nullif(trim(regexp_extract(name, '\\(([^()]*)\\)$', 1)), ''),
             nullif(trim(regexp_extract(name, '\\[([^\\[\\]]*)\\]$', 1)), ''), nullif(trim(regexp_extract(name, ',([^,]*)$', 1)), ''),
             CASE WHEN number IS NULL THEN nullif(trim(regexp_extract(v, {_NUM}, 5)), '') END) AS label
  FROM rows0 WHERE number IS NOT NULL OR regexp_matches(v, {_NUM})),
rows2 AS (
  SELECT *, regexp_replace(replace(label, 'μ', 'µ'), '[.]$', '') AS lab, regexp_extract(t, '([.,])[^.,]*$', 1) AS mark, regexp_extract(t, '^(.*)[.,][^.,]*$', 1) AS front, regexp_extract(t, '[.,]([^.,]*)$', 1) AS back FROM rows1),
rows3 AS (
  SELECT DISTINCT table_name, row_id, coalesce(a.accession, b.accession) AS attribute, coalesce(a.common_unit, b.common_unit) AS common_unit, coalesce({_CURIE.format('r.lab')}, l.unit) AS recorded_unit,
    coalesce(number, CASE WHEN mark = '' THEN CAST(t AS DOUBLE) WHEN contains(front, mark) THEN CAST(regexp_replace(t, '[.,]', '', 'g') AS DOUBLE) ELSE CAST(regexp_replace(front, '[.,]', '', 'g') || '.' || back AS DOUBLE) END) AS number
  FROM rows2 r LEFT JOIN lab l ON l.label = r.lab
  LEFT JOIN attribute_ref a ON a.accession = {_CURIE.format('r.acc')}
  LEFT JOIN attribute_ref b ON coalesce(r.acc, '') = '' AND regexp_replace(b.attribute_name, '[^a-z0-9]+', '', 'g') = {_NAME.format('r.name')}),
seen AS (
  SELECT coalesce({_CURIE.format('r.lab')}, r.lab) AS label, count(*) AS n_values FROM rows2 r
  LEFT JOIN attribute_ref a ON a.accession = {_CURIE.format('r.acc')}
  LEFT JOIN attribute_ref b ON coalesce(r.acc, '') = '' AND regexp_replace(b.attribute_name, '[^a-z0-9]+', '', 'g') = {_NAME.format('r.name')}
  WHERE r.lab <> '' AND coalesce(a.common_unit, b.common_unit) IS NOT NULL GROUP BY 1),
plain AS (SELECT unit_curie AS label, unit_curie AS unit FROM unit_ref UNION SELECT symbol, unit_curie FROM unit_ref UNION SELECT unit_name, unit_curie FROM unit_ref),
told AS (
  SELECT r.*, (number * u.to_base_factor + u.to_base_shift - c.to_base_shift) / c.to_base_factor AS common_value FROM rows3 r
  JOIN unit_ref u ON u.unit_curie = r.recorded_unit JOIN unit_ref c ON c.unit_curie = r.common_unit WHERE u.quantity_kind = c.quantity_kind)
"""

_P2_BASE = """
WITH s AS (SELECT spectrum_key AS k, any_value(run_id) AS run_id, any_value(spectrum_index) AS i, any_value(data_procesing_ref) AS dp, min(loaded_at) AS loaded, max(deleted_at) AS gone FROM spectrum GROUP BY 1),
t AS (SELECT run_id, spectrum_index AS i, min(loaded_at) AS loaded, max(deleted_at) AS gone FROM spectrum GROUP BY 1, 2),
dp AS (SELECT lower(trim(dp_id)) AS dp, min(loaded_at) AS loaded, max(deleted_at) AS gone FROM data_processing GROUP BY 1),
i AS (SELECT ion_id AS k, any_value(run_id) AS run_id, any_value(spectrum_index) AS si, any_value(precursor_index) AS pi, min(loaded_at) AS loaded FROM selected_ion GROUP BY 1),
r AS (
  SELECT 'selected_ion' AS table_name, 'spectrum_index' AS field_name, i.k AS row_id, i.loaded AS loaded, t.loaded AS t_loaded, t.gone AS gone FROM i LEFT JOIN t ON t.run_id = i.run_id AND t.i = i.si WHERE i.si >= 0
  UNION ALL
  SELECT 'selected_ion', 'precursor_index', i.k, i.loaded, t.loaded, t.gone FROM i LEFT JOIN t ON t.run_id = i.run_id AND t.i = i.pi WHERE i.pi >= 0
  UNION ALL
  SELECT 'spectrum', 'data_procesing_ref', s.k, s.loaded, dp.loaded, dp.gone FROM s LEFT JOIN dp ON dp.dp = lower(regexp_replace(s.dp, '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g'))
  WHERE regexp_replace(s.dp, '[\\s\\x{00A0}]+', '', 'g') <> ''),
o AS (SELECT *, CASE WHEN t_loaded IS NULL THEN 'missing' WHEN gone IS NOT NULL THEN 'deleted' WHEN t_loaded > loaded THEN 'later' END AS reason FROM r)
"""

_P3_BASE = """
WITH l AS (SELECT run_id, spectrum_index, max(ms_level) AS ms_level FROM spectrum GROUP BY 1, 2),
s AS (SELECT spectrum_key, any_value(ms_level) AS ms_level, min(loaded_at) AS loaded, any_value(total_ion_current) AS v FROM spectrum GROUP BY 1),
i AS (SELECT ion_id, any_value(run_id) AS run_id, any_value(spectrum_index) AS spectrum_index, min(loaded_at) AS loaded, any_value(intensity) AS v FROM selected_ion GROUP BY 1),
v AS (
  SELECT 'total_ion_current' AS field_name, CAST(ms_level AS INTEGER) AS ms_level, CAST(loaded AS DATE) AS day, v FROM s
  UNION ALL SELECT 'intensity', CAST(l.ms_level AS INTEGER), CAST(i.loaded AS DATE), i.v FROM i LEFT JOIN l ON l.run_id = i.run_id AND l.spectrum_index = i.spectrum_index),
w AS (SELECT * FROM v WHERE v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v)),
q AS (SELECT unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])::DOUBLE AS quantile)
"""

_P4_BASE = f"""
WITH r0 AS (SELECT run_id, spectrum_index, param_id, value, {_sq('accession')} AS acc, {_sq('name')} AS name, {_sq('value.string')} AS s FROM spectrum_parameter WHERE run_id IS NOT NULL AND spectrum_index IS NOT NULL),
r1 AS (
  SELECT r.*, coalesce(a.accession, b.accession) AS accession, coalesce(a.attribute_name, b.attribute_name) AS attribute_name, coalesce(a.value_type, b.value_type) AS value_type, regexp_extract(s, {_NUM}, 1) AS t
  FROM r0 r LEFT JOIN attribute_ref a ON a.owner_kind = 'spectrum' AND a.accession = {_CURIE.format('r.acc')}
  LEFT JOIN attribute_ref b ON b.owner_kind = 'spectrum' AND coalesce(r.acc, '') = '' AND regexp_replace(b.attribute_name, '[^a-z0-9]+', '', 'g') = {_NAME.format('r.name')}),
r2 AS (SELECT *, regexp_extract(t, '([.,])[^.,]*$', 1) AS mark, regexp_extract(t, '^(.*)[.,][^.,]*$', 1) AS front, regexp_extract(t, '[.,]([^.,]*)$', 1) AS back FROM r1),
r3 AS (
  SELECT *, CASE WHEN t = '' THEN NULL WHEN mark = '' THEN t WHEN contains(front, mark) THEN regexp_replace(t, '[.,]', '', 'g') ELSE regexp_replace(front, '[.,]', '', 'g') || '.' || back END AS plain,
    CASE WHEN CAST(value.float AS VARCHAR) NOT IN ('nan', 'inf', '-inf') THEN value.float END AS f, lower(s) AS ls FROM r2),
cells AS (
  SELECT run_id, spectrum_index, accession, attribute_name, param_id,
    CASE WHEN value_type = 'double' THEN coalesce(CAST(value.integer AS DOUBLE), f, CAST(plain AS DOUBLE)) END AS num,
    CASE WHEN value_type = 'int' THEN coalesce(value.integer, CAST(round(f) AS BIGINT), TRY_CAST(plain AS BIGINT), CAST(round(CAST(plain AS DOUBLE)) AS BIGINT)) END AS whole,
    CASE WHEN value_type = 'boolean' THEN CASE WHEN value.boolean IS NOT NULL THEN value.boolean WHEN value.integer IN (0, 1) THEN value.integer = 1 WHEN value.float IN (0, 1) THEN value.float = 1
      WHEN ls IN ('true', 't', 'yes', 'y', 'on', '1', '1.0') THEN true WHEN ls IN ('false', 'f', 'no', 'n', 'off', '0', '0.0') THEN false END END AS flag,
    CASE WHEN value_type = 'string' THEN coalesce(CASE WHEN s <> '' AND ls NOT IN ('unknown', 'not set', 'nan?', 'nan', '--', '-', 'n/a', 'na', '#ref', '#ref!', 'pending', 'null', 'none', 'tbd', '?') THEN value.string END,
      CAST(value.integer AS VARCHAR), CAST(f AS VARCHAR), CAST(value.boolean AS VARCHAR)) END AS text
  FROM r3 WHERE accession IS NOT NULL),
filled AS (SELECT * FROM cells WHERE num IS NOT NULL OR whole IS NOT NULL OR flag IS NOT NULL OR text IS NOT NULL)
"""
#: The spectrum attributes of the attribute table, by type.
_P4_TYPES = {
    "num": ["ion injection time", "scan start time", "ion mobility drift time", "collision energy", "source potential", "declustering potential", "transfer tube temperature", "trap gas temperature",
            "wavelength", "laser spot width", "isolation purity", "mass resolving power"],
    "whole": ["preset scan configuration", "microscan count"], "flag": ["lock mass found", "detector saturated"], "text": ["filter string", "spectrum title"],
}
_P4_WIDE = ", ".join(f"arg_min({c}, param_id) FILTER (WHERE attribute_name = '{a}') AS {a.replace(' ', '_')}" for c, names in _P4_TYPES.items() for a in names)

#: What keys the files use for each field beside its name, as they are written there.
_KEYS = {
    "selected_ion": {
        "spectrum_index": ["spectrumIndex", "spectrum_idx", "source_index"], "precursor_index": ["precursorIndex", "precursor_idx"], "selected_ion_mz": ["selectedIonMz", "MS_1000744_selected_ion_mz_unit_MS_1000040"],
        "charge_state": ["charge", "MS_1000041_charge_state"], "intensity": ["ion_intensity", "MS_1000042_intensity_unit_MS_1000131"], "ion_mobility": ["ionMobility", "ion_mobility_value"], "parameters": [],
    },
    "array_index_entry": {
        "context": [], "path": [], "data_type": [], "array_type": [], "array_name": ["arrayName", "name"], "unit": ["unit_curie"], "buffer_format": ["bufferFormat", "format", "buffer_layout"], "transform": [],
        "data_processing_id": ["data_processing_ref"], "buffer_priority": [], "sorting_rank": ["sortingRank", "sort_rank"],
    },
    "file_entry": {"name": ["fileName", "file_name"], "entity_type": ["entityType", "entity"], "data_kind": ["dataKind", "data-kind", "kind"], "size_bytes": ["sizeBytes"], "row_count": []},
}
_KEY_ROWS = ", ".join(f"('{kind}', '{key}', '{field}', {str(key == field).lower()})" for kind, fields in _KEYS.items() for field, keys in fields.items() for key in [field, *keys])
_P5_LINES = f"""
WITH f(kind, key, field, exact) AS (VALUES {_KEY_ROWS}),
l AS (SELECT DISTINCT record_kind, feed_id, file_seq, file_id, line_no, raw_json FROM archive_line WHERE json_valid(raw_json) AND json_type(raw_json) = 'OBJECT'),
k AS (SELECT record_kind, feed_id, file_seq, file_id, line_no, raw_json, unnest(json_keys(raw_json)) AS key FROM l),
"""
_P5 = _P5_LINES + """ty AS (SELECT DISTINCT record_kind, feed_id, file_seq, file_id, key, json_type(raw_json, '$."' || key || '"') AS t FROM k),
o AS (
  SELECT ty.record_kind, feed_id, file_seq, file_id, coalesce(f.field, ty.key) AS field_name, list_sort(list(DISTINCT ty.key)) AS keys,
         list_sort(coalesce(list(DISTINCT CASE WHEN t IN ('BIGINT', 'UBIGINT') THEN 'INT' ELSE t END) FILTER (WHERE t <> 'NULL'), [])) AS types
  FROM ty LEFT JOIN f ON f.kind = ty.record_kind AND f.key = ty.key
  GROUP BY ALL),
files AS (SELECT DISTINCT record_kind, feed_id, file_seq, file_id FROM archive_line),
pairs AS (SELECT b.record_kind, b.feed_id, b.file_seq, b.file_id FROM files b JOIN files a ON a.record_kind = b.record_kind AND a.feed_id = b.feed_id AND a.file_seq = b.file_seq - 1),
d AS (
  SELECT p.file_id, coalesce(n.field_name, q.field_name) AS field_name, q.keys AS k0, n.keys AS k1, q.types AS t0, n.types AS t1
  FROM (SELECT p.*, o.* EXCLUDE (record_kind, feed_id, file_seq, file_id) FROM pairs p JOIN o ON o.record_kind = p.record_kind AND o.feed_id = p.feed_id AND o.file_seq = p.file_seq) n
  FULL JOIN (SELECT p.*, o.* EXCLUDE (record_kind, feed_id, file_seq, file_id) FROM pairs p JOIN o ON o.record_kind = p.record_kind AND o.feed_id = p.feed_id AND o.file_seq = p.file_seq - 1) q
    ON q.file_id = n.file_id AND q.field_name = n.field_name
  JOIN pairs p ON p.file_id = coalesce(n.file_id, q.file_id))
SELECT file_id, field_name, 'added' AS change_kind FROM d WHERE k0 IS NULL
UNION ALL SELECT file_id, field_name, 'removed' FROM d WHERE k1 IS NULL
UNION ALL SELECT file_id, field_name, 'renamed' FROM d WHERE k0 <> k1
UNION ALL SELECT file_id, field_name, 'retyped' FROM d WHERE len(t0) > 0 AND len(t1) > 0 AND t0 <> t1"""


#: The types of the fields that aren't text.
_P5_NUMBERS = {"spectrum_index": "BIGINT", "precursor_index": "BIGINT", "selected_ion_mz": "DOUBLE", "charge_state": "INTEGER", "intensity": "DOUBLE", "ion_mobility": "DOUBLE", "sorting_rank": "INTEGER", "size_bytes": "BIGINT", "row_count": "BIGINT"}


def _p5_table(kind: str) -> str:
    """The consistent table of a record kind: of a field's keys the exact one first, then the others in their order."""

    def cast(field: str) -> str:
        to = _P5_NUMBERS.get(field)
        if to in (None, "DOUBLE"):
            return "t" if to is None else "TRY_CAST(t AS DOUBLE)"
        return f"CASE WHEN TRY_CAST(t AS DOUBLE) = floor(TRY_CAST(t AS DOUBLE)) THEN TRY_CAST(TRY_CAST(t AS DOUBLE) AS {to}) END"

    columns = ", ".join(f"arg_min({cast(f)}, (NOT exact, key)) FILTER (WHERE field = '{f}' AND {cast(f)} IS NOT NULL) AS {f}" for f in _KEYS[kind])
    took = "CASE " + " ".join(f"WHEN field = '{f}' THEN {f} IS NOT NULL" for f in _KEYS[kind]) + " END"
    return _P5_LINES + f"""e AS (SELECT k.*, f.field, f.exact, json_extract(raw_json, '$."' || k.key || '"') AS j, raw_json ->> ('$."' || k.key || '"') AS t FROM k LEFT JOIN f ON f.kind = k.record_kind AND f.key = k.key WHERE record_kind = '{kind}'),
r AS (SELECT feed_id, file_seq, file_id, line_no, {columns} FROM e GROUP BY feed_id, file_seq, file_id, line_no),
x AS (SELECT e.file_id, e.line_no, '{{' || string_agg('"' || key || '":' || coalesce(CAST(j AS VARCHAR), 'null'), ',' ORDER BY key) || '}}' AS _rescued FROM e JOIN r ON r.file_id = e.file_id AND r.line_no = e.line_no
  WHERE field IS NULL OR (json_type(j) <> 'NULL' AND NOT {took}) GROUP BY ALL)
SELECT r.*, _rescued FROM r LEFT JOIN x ON x.file_id = r.file_id AND x.line_no = r.line_no"""


_FILLED = "(p.value.integer IS NOT NULL OR p.value.float IS NOT NULL OR p.value.string IS NOT NULL OR p.value.boolean IS NOT NULL OR p.accession IS NOT NULL OR p.name IS NOT NULL OR p.unit IS NOT NULL)"
_P6_BASE = """
WITH s AS (SELECT spectrum_key AS k, arg_max(parameters, loaded_at) AS parameters, arg_max(auxiliary_arrays, loaded_at) AS aux FROM spectrum GROUP BY 1),
i AS (SELECT ion_id AS k, arg_max(parameters, loaded_at) AS parameters FROM selected_ion GROUP BY 1),
sp AS (SELECT k, unnest(parameters) AS p, CAST(generate_subscripts(parameters, 1) - 1 AS INTEGER) AS o FROM s),
ip AS (SELECT k, unnest(parameters) AS p, CAST(generate_subscripts(parameters, 1) - 1 AS INTEGER) AS o FROM i),
sa AS (SELECT k, unnest(aux) AS a, CAST(generate_subscripts(aux, 1) - 1 AS INTEGER) AS o FROM s),
ap AS (SELECT k, o, unnest(a.parameters) AS p, CAST(generate_subscripts(a.parameters, 1) - 1 AS INTEGER) AS n FROM sa WHERE a IS NOT NULL),
rows0 AS (
  SELECT 'spectrum' AS owner_table, k AS owner_id, 'parameters' AS field_path, o AS pos_outer, CAST(-1 AS INTEGER) AS pos_inner, p FROM sp
  UNION ALL SELECT 'selected_ion', k, 'parameters', o, CAST(-1 AS INTEGER), p FROM ip
  UNION ALL SELECT 'spectrum', k, 'auxiliary_arrays.parameters', o, n, p FROM ap)
"""

ORACLES: dict[str, str] = {
    "p1_found": _P1_BASE + "SELECT DISTINCT table_name, row_id, recorded_unit FROM told WHERE recorded_unit <> common_unit",
    "p1_common_values": _P1_BASE + "SELECT attribute, common_unit, recorded_unit, count(*) AS n_values, round(min(common_value), 4) AS lowest, round(max(common_value), 4) AS highest FROM told GROUP BY ALL",
    "p1_labels": _P1_BASE + "SELECT s.label, coalesce(p.unit, l.unit) AS unit, CASE WHEN p.unit IS NOT NULL THEN 'name' WHEN l.unit IS NOT NULL THEN 'letters' ELSE 'unresolved' END AS told_by, n_values FROM seen s LEFT JOIN plain p ON p.label = s.label LEFT JOIN lab l ON l.label = s.label",
    "p2_found": _P2_BASE + "SELECT table_name, field_name, row_id FROM o WHERE reason IS NOT NULL",
    "p2_counts": _P2_BASE + "SELECT table_name, field_name, CAST(loaded AS DATE) AS period, reason, count(*) AS n_orphans FROM o WHERE reason IS NOT NULL GROUP BY ALL",
    "p3_certified": _P3_BASE + "SELECT field_name, ms_level, day, quantile, n, low, high, true AS within FROM (SELECT field_name, ms_level, day, count(*) AS n, CAST(min(v) AS DOUBLE) AS low, CAST(max(v) AS DOUBLE) AS high FROM w GROUP BY ALL) CROSS JOIN q",
    "p3_combined_certified": _P3_BASE + "SELECT field_name, ms_level, quantile, n, low, high, true AS within FROM (SELECT field_name, ms_level, count(*) AS n, CAST(min(v) AS DOUBLE) AS low, CAST(max(v) AS DOUBLE) AS high FROM w GROUP BY ALL) CROSS JOIN q",
    "p4_found": _P4_BASE + "SELECT DISTINCT run_id, spectrum_index, accession FROM filled",
    "p4_wide": _P4_BASE + f"SELECT run_id, spectrum_index, {_P4_WIDE} FROM filled GROUP BY ALL",
    "p5_found": _P5,
    **{f"p5_{kind}": _p5_table(kind) for kind in _KEYS},
    "p6_found": _P6_BASE + f"""SELECT owner_table, owner_id, field_path, pos_outer, pos_inner FROM rows0 WHERE p IS NOT NULL AND {_FILLED}
UNION ALL SELECT 'spectrum', k, 'auxiliary_arrays', o, CAST(-1 AS INTEGER) FROM sa WHERE a IS NOT NULL""",
    "p6_parameters": _P6_BASE + f"""SELECT owner_table, owner_id, field_path, pos_outer, pos_inner, p.value.integer AS value_integer, p.value.float AS value_float, p.value.string AS value_string,
  p.value.boolean AS value_boolean, p.accession AS accession, p.name AS name, p.unit AS unit FROM rows0 WHERE p IS NOT NULL AND {_FILLED}""",
    "p6_arrays": _P6_BASE + """SELECT 'spectrum' AS owner_table, k AS owner_id, 'auxiliary_arrays' AS field_path, o AS pos_outer, CAST(-1 AS INTEGER) AS pos_inner, a.name.value.integer AS name_integer, a.name.value.float AS name_float,
  a.name.value.string AS name_string, a.name.value.boolean AS name_boolean, a.name.accession AS name_accession, a.name.name AS name_name, a.name.unit AS name_unit, a.data_type AS data_type, a.compression AS compression,
  a.unit AS unit, a.data_processing_ref AS data_processing_ref, a.data AS data FROM sa WHERE a IS NOT NULL""",
}
