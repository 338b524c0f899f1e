"""Controlled-vocabulary names, identifiers and option texts."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIXES = ("MS", "UO")

#: Short names of signal arrays, in the order columns are written.
ARRAY_NAMES = {
    "m/z array": "mz", "time array": "time", "intensity array": "intensity", "charge array": "charge", "signal to noise array": "signal_to_noise", "wavelength array": "wavelength",
    "ion mobility array": "ion_mobility", "mean ion mobility array": "mean_ion_mobility", "mean drift time array": "mean_drift_time", "mean inverse reduced ion mobility array": "mean_inverse_reduced_ion_mobility",
    "raw ion mobility array": "raw_ion_mobility", "raw drift time array": "raw_drift_time", "raw inverse reduced ion mobility array": "raw_inverse_reduced_ion_mobility",
    "deconvoluted ion mobility array": "deconvoluted_ion_mobility", "deconvoluted drift time array": "deconvoluted_drift_time__array",
    "deconvoluted inverse reduced ion mobility array": "deconvoluted_inverse_reduced_ion_mobility__array", "baseline array": "baseline", "resolution array": "resolution",
    "pressure array": "pressure__array", "temperature array": "temperature__array", "flow rate array": "flow_rate__array",
}
#: Units within the names of arrays that aren't the primary one of their type.
UNIT_NAMES = {
    "MS:1000040": "mz", "UO:0000221": "da", "UO:0000169": "ppm", "UO:0000018": "nm", "UO:0000031": "min", "UO:0000010": "sec", "UO:0000028": "msec", "MS:1002814": "vspc", "MS:1000131": "dc",
    "MS:1000132": "bp", "MS:1000905": "bpp", "UO:0000269": "au", "MS:1000814": "cps", "UO:0000266": "ev", "UO:0000218": "v", "UO:0000027": "c", "UO:0000012": "k", "UO:0000110": "pa",
    "UO:0010052": "psi", "UO:0000271": "mlpmin", "UO:0000187": "pct",
}
#: What a column of each buffer format is called behind the array's name.
FORMAT_ENDINGS = {"point": "", "chunk_secondary": "", "chunk_values": "_chunk_values", "chunk_start": "_chunk_start", "chunk_end": "_chunk_end"}
#: Data types within column names.
DTYPE_NAMES = {"MS:1000523": "f64", "MS:1000521": "f32", "MS:1000522": "i64", "MS:1000519": "i32", "MS:1001479": "ascii"}


def column_name(accession: Column, name: Column, unit: Column | None = None) -> Column:
    """``MS:1000016``, ``scan start time``, ``UO:0000031`` as ``MS_1000016_scan_start_time_unit_UO_0000031``; m/z is mz."""
    plain = F.regexp_replace(F.replace(name, F.lit("m/z"), F.lit("mz")), "[^a-zA-Z0-9]", "_")
    base = F.concat(F.replace(accession, F.lit(":"), F.lit("_")), F.lit("_"), plain)
    return base if unit is None else F.when(unit.isNull(), base).otherwise(F.concat(base, F.lit("_unit_"), F.replace(unit, F.lit(":"), F.lit("_"))))


def plain_column_name(accession: Column, name: Column) -> Column:
    """The other spelling in use: runs of odd characters as one ``_``, hyphens stay, and m/z is no exception."""
    return F.concat(F.replace(accession, F.lit(":"), F.lit("_")), F.lit("_"), F.regexp_replace(name, r"[^a-zA-Z0-9_\\-]+", "_"))


def accession_of(column: Column) -> Column:
    """The accession told by a column name, null if it tells none."""
    return F.regexp_replace(F.regexp_substr(column, F.lit(r"^(MS|UO)_[^_]+(?=_.)")), "_", ":")


def name_of(column: Column) -> Column:
    """The name within a column name; a name without accession stays as it is."""
    return F.when(accession_of(column).isNull(), column).otherwise(F.regexp_replace(F.regexp_replace(column, r"^[A-Z]+_[^_]+_", ""), r"_unit_[A-Za-z]+_[0-9]+$", ""))


def unit_of(column: Column) -> Column:
    """The unit's accession told by a column name, null if it tells none."""
    return F.regexp_replace(F.regexp_replace(F.regexp_substr(column, F.lit(r"_unit_[A-Za-z]+_[0-9]+$")), "^_unit_", ""), "_", ":")


class ColumnName(NamedTuple):
    accession: str | None
    name: str
    unit: str | None
    is_unit_column: bool


def parse_column_name(column: str) -> ColumnName:
    """The driver-side form, for schemas."""
    m = re.fullmatch(r"((?:MS|UO)_[^_]+)_(.+)", column)
    if not m:
        return ColumnName(None, column, None, False)
    u = re.fullmatch(r"(.+)_unit_([A-Za-z]+_[0-9]+)", m[2])
    name, unit = (u[1], u[2].replace("_", ":", 1)) if u else (m[2], None)
    return ColumnName(m[1].replace("_", ":", 1), name, unit, name.endswith("_unit"))


def curie(cv_id: Column, number: Column) -> Column:
    """``{cv_id, accession}`` of older files as text; UO numbers have seven digits. cv_id is 1 for MS, 2 for UO, or the prefix."""
    prefix = F.when(cv_id.cast("string").isin("1", "MS"), "MS").when(cv_id.cast("string").isin("2", "UO"), "UO")
    return F.when(prefix == "UO", F.concat(F.lit("UO:"), F.lpad(number.cast("string"), 7, "0"))).otherwise(F.concat(prefix, F.lit(":"), number.cast("string")))


def array_column_name(array_type: str, buffer_format: str = "point", primary: bool = True, data_type: str | None = None, unit: str | None = None, transform: str | None = None) -> str:
    """The column of a signal array: its short name, for others than the primary one with type and unit, and its format's ending."""
    base = ARRAY_NAMES.get(array_type) or re.sub(r"[/ .]", "_", array_type)
    if buffer_format == "chunk_encoding" and primary:
        return "chunk_encoding"
    if not primary:
        base = "_".join(x for x in (base, DTYPE_NAMES.get(data_type or "", "unknown"), UNIT_NAMES.get(unit or "", unit)) if x)
    if buffer_format == "chunk_transform":
        if not transform:
            raise ValueError("a transformed array needs a transform")
        return f"{base}_{transform}_bytes"
    return base + (FORMAT_ENDINGS[buffer_format] if primary else "")


def array_order(array_type: str) -> int:
    """Where an array's column stands: known arrays in their order, others behind them, by their names."""
    return list(ARRAY_NAMES).index(array_type) if array_type in ARRAY_NAMES else len(ARRAY_NAMES)


#: The order of buffer formats within a row.
_FORMATS = ["point", "chunk_start", "chunk_end", "chunk_values", "chunk_encoding", "chunk_secondary", "chunk_transform"]


def column_order(arrays: list[dict]) -> list[dict]:
    """Arrays (array_type, buffer_format, primary, data_type) in the order their columns are written, behind the index."""
    place = lambda x: _FORMATS.index(x.get("buffer_format", "point"))
    return sorted(arrays, key=lambda x: (place(x), array_order(x["array_type"]), x["array_type"], not x.get("primary", True), DTYPE_NAMES.get(x.get("data_type", ""), "")))


def data_kind(c: Column) -> Column:
    s = F.lower(F.trim(c))
    return F.when(s.isin("data arrays", "peaks", "metadata", "proprietary"), s).otherwise("other")


def entity_type(c: Column) -> Column:
    s = F.lower(F.trim(c))
    return F.when(s.isin("spectrum", "chromatogram"), s).otherwise("other")


def polarity(c: Column) -> Column:
    """+ and - as 1 and -1; anything else, also 0, is null."""
    s = c.cast("string")
    return F.when(s.isin("+", "1", "positive"), 1).when(s.isin("-", "-1", "negative"), -1).cast("tinyint")


def default_spectrum_type(ms_level: Column) -> Column:
    return F.when(ms_level == 1, "MS:1000579").when(ms_level > 1, "MS:1000580")


def chunk_option(text: str) -> tuple[str, float]:
    """``method:width``; plain is another word for basic, an unknown method is delta, a width that is no number is 50."""
    method, _, width = text.strip().partition(":")
    method = {"plain": "basic"}.get(method.lower(), method.lower())
    try:
        number = float(width)
    except ValueError:
        number = 50.0
    return method if method in ("basic", "delta", "numpress") else "delta", number


def size_option(text: str) -> int:
    """``4K``, ``2M``, ``1G`` or a plain number of bytes."""
    m = re.fullmatch(r"\s*(\d+)\s*([KMG]?)\s*", text, re.I)
    if not m:
        raise ValueError(f"no size: {text!r}")
    return int(m[1]) << {"": 0, "K": 10, "M": 20, "G": 30}[m[2].upper()]


def slice_bounds(s: slice, n: int) -> tuple[int, int]:
    """Start and stop of a slice with its defaults."""
    return (0 if s.start is None else s.start, n if s.stop is None else s.stop)


def plain_type(t: T.DataType, names: dict[str, str] | None = None) -> T.DataType:
    """A type whose fields, at any depth, have the plain names their column names tell.

    names: accession -> name to show instead, as an ontology would tell it. Of fields that would get the
    same name only the first is renamed.
    """
    if isinstance(t, T.ArrayType):
        return T.ArrayType(plain_type(t.elementType, names), t.containsNull)
    if not isinstance(t, T.StructType):
        return t
    taken, fields = {f.name for f in t.fields}, []
    for f in t.fields:
        told = parse_column_name(f.name)
        name = (names or {}).get(told.accession or "", told.name)
        if name != f.name and name in taken:
            name = f.name
        taken.add(name)
        fields.append(T.StructField(name, plain_type(f.dataType, names), f.nullable))
    return T.StructType(fields)


def rename_by_vocabulary(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Columns and nested fields by their plain names; values stay as they are."""
    plain = plain_type(df.schema, names)
    return df.select(*[F.col(f"`{a.name}`").cast(b.dataType).alias(b.name) for a, b in zip(df.schema.fields, plain.fields)])
