"""Chunk layout and binary array codecs.

A chunk is a row with the entity's key, the chunk's first and last coordinate, its coordinates in an
encoding, and lists of the other columns. Plain and delta chunks keep the first coordinate only as the
start; a chunk of one point has end = start. Coordinates may be null: start and end are the first and last
that aren't, deltas behind a null are absolute, and where the first point's coordinate is null it is listed,
so the list is as long as the others. Other columns may be kept as Numpress bytes. A range query filters
chunks by their bounds before any list is opened. Encoding deltas is one pass of higher-order functions;
decoding them, Numpress and byte payloads are numpy over Arrow batches, linear in the points.

Defined results: null and empty lists stay so; not-a-number in a list counts as null; bytes that don't fit
their type or are damaged give nulls in place of values.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slabworks.operators import extract, models, signal

#: Accessions of encodings, compressions, transforms and data types.
PLAIN, DELTA, NUMPRESS_LINEAR = "MS:1000576", "MS:1003089", "MS:1002312"
NUMPRESS_PIC, NUMPRESS_SLOF, ZLIB = "MS:1002313", "MS:1002314", "MS:1000574"
NULL_INTERPOLATE, NULL_ZERO = "MS:1003901", "MS:1003902"
DTYPES = {"MS:1000519": "<i4", "MS:1000521": "<f4", "MS:1000522": "<i8", "MS:1000523": "<f8"}
ASCII = "MS:1001479"
#: How the columns of transformed lists end.
TRANSFORMED = {NUMPRESS_SLOF: "_numpress_slof_bytes", NUMPRESS_PIC: "_numpress_pic_bytes"}


def encode_chunks(
    points: DataFrame, width: float, encoding: str = DELTA, key: str = "index", pos: str = "pos", axis: str = "mz", others: tuple[str, ...] = ("intensity",), transforms: dict[str, str] | None = None
) -> DataFrame:
    """Chunk rows of an entity's points (ascending coordinates, nulls between them).

    transforms: other column -> NUMPRESS_SLOF or NUMPRESS_PIC; it is kept as bytes in that form.
    """
    cut = signal.chunk_ids(points.select(key, pos, axis, *others), key, pos, axis, width)
    lists = cut.groupBy(key, "chunk_id").agg(F.sort_array(F.collect_list(F.struct(pos, axis, *others))).alias("r"))
    # columns of their own, so that no list is taken out of the structs again for every element
    lists = lists.select(key, "chunk_id", F.size("r").alias("_n"), F.col(f"r.{axis}").alias("_x"), *[F.col(f"r.{o}").alias(o) for o in others])
    x, n = F.col("_x"), F.col("_n")
    head = F.when(F.try_element_at(x, F.lit(1)).isNull(), F.slice(x, 1, 1)).otherwise(F.slice(x, 1, 0))
    tail = F.slice(x, 2, F.greatest(n - 1, F.lit(0)))
    step = lambda b, a: F.when(a.isNull(), b).otherwise(b - a)
    kept = {PLAIN: F.concat(head, tail), DELTA: F.concat(head, F.zip_with(tail, F.slice(x, 1, F.greatest(n - 1, F.lit(0))), step)), NUMPRESS_LINEAR: x}[encoding]
    some = F.array_compact(x)
    transforms = transforms or {}
    told = [F.col(o) if o not in transforms else {NUMPRESS_SLOF: encode_slof, NUMPRESS_PIC: encode_pic}[transforms[o]](F.col(o).cast("array<double>")).alias(o + TRANSFORMED[transforms[o]]) for o in others]
    out = lists.select(
        key, "chunk_id", F.try_element_at(some, F.lit(1)).alias(f"{axis}_chunk_start"), F.try_element_at(some, F.lit(-1)).alias(f"{axis}_chunk_end"), kept.alias(f"{axis}_chunk_values"),
        F.lit(encoding).alias("chunk_encoding"), *told,
    )
    if encoding != NUMPRESS_LINEAR:
        return out
    return out.withColumn(f"{axis}_numpress_linear_bytes", encode_linear(F.col(f"{axis}_chunk_values").cast("array<double>"))).withColumn(f"{axis}_chunk_values", F.array().cast("array<double>"))


def encode_profile(points: DataFrame, width: float, encoding: str = DELTA, is_profile: bool = True, key: str = "index", pos: str = "pos", axis: str = "mz", intensity: str = "intensity", others: tuple[str, ...] = ()) -> DataFrame:
    """The write path of an entity's points: zero runs stripped, paired zeros marked null, cut and encoded.

    Only profile data is stripped and marked; delta encoding gives way to the plain one for other data.
    """
    if is_profile:
        points = signal.null_mark(signal.strip_zero_runs(points, key, pos, intensity), key, pos, intensity, [axis])
    elif encoding == DELTA:
        encoding = PLAIN
    return encode_chunks(points, width, encoding, key, pos, axis, (intensity, *others))


def _lists(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list array behind each other, nulls as not-a-number, and where each list begins."""
    lens = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False)
    flat = a.flatten()
    values = (pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat).cast(pa.float64()).to_numpy(zero_copy_only=False)
    return values, np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)


def _list_array(values: np.ndarray, at: np.ndarray, there: np.ndarray) -> pa.Array:
    """A list array of values behind each other, each list beginning where ``at`` says; not-a-number becomes null."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, mask=np.isnan(values)), mask=pa.array(~there))


def _as_lists(parts: list[np.ndarray]) -> pa.Array:
    """A list array of the parts."""
    return _list_array(np.concatenate([np.zeros(0), *parts]).astype(np.float64), _begins([len(p) for p in parts]), np.ones(len(parts), dtype=bool))


def running_sums(deltas: np.ndarray) -> np.ndarray:
    """Coordinates from null-aware deltas: a value behind a null is absolute, nulls (not-a-number) stay."""
    null = np.isnan(deltas)
    if not null.any():
        return np.cumsum(deltas)
    total = np.cumsum(np.where(null, 0.0, deltas))
    last = np.maximum.accumulate(np.where(null, np.arange(len(deltas)), -1))
    return np.where(null, np.nan, total - np.where(last >= 0, total[np.maximum(last, 0)], 0.0))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _from_deltas(start: pa.Array, values: pa.Array, listed: pa.Array) -> pa.Array:
    flat, at = _lists(values)
    first = start.cast(pa.float64()).to_numpy(zero_copy_only=False)
    whole = listed.fill_null(False).to_numpy(zero_copy_only=False)
    parts = [flat[a:b] if w else np.concatenate([[s], flat[a:b]]) for a, b, s, w in zip(at[:-1], at[1:], first, whole)]
    return _as_lists([running_sums(p) for p in parts])


def decoded_axis(axis: str = "mz", others: tuple[str, ...] = ("intensity",)) -> Column:
    """A chunk's coordinates from its encoding, as an expression.

    The lists of other columns tell whether the first coordinate is listed. Without them it is taken to be
    if it is null and the second isn't: two nulls at the front stand behind a start of their own.
    """
    start, values = F.col(f"{axis}_chunk_start").cast("double"), F.coalesce(F.col(f"{axis}_chunk_values").cast("array<double>"), F.array().cast("array<double>"))
    null_at = lambda i: F.try_element_at(values, F.lit(i)).isNull()
    listed = F.size(values) == F.size(others[0]) if others else (F.size(values) > 0) & null_at(1) & ((F.size(values) == 1) | ~null_at(2) | start.isNull())
    plain = F.when(listed, values).otherwise(F.concat(F.array(start), values))
    return F.when(F.col("chunk_encoding") == DELTA, _from_deltas(start, values, listed)).otherwise(plain)


def decode_chunks(chunks: DataFrame, key: str = "index", axis: str = "mz", others: tuple[str, ...] = ("intensity",)) -> DataFrame:
    """Points of chunks: key, chunk_id, place in the chunk, coordinate and the other columns, transformed ones too."""
    for o in others:
        for transform, ending in TRANSFORMED.items():
            if o + ending in chunks.columns:
                chunks = chunks.withColumn(o, (decode_slof if transform == NUMPRESS_SLOF else decode_pic)(F.col(o + ending)))
    coords = decoded_axis(axis, others)
    if f"{axis}_numpress_linear_bytes" in chunks.columns:
        coords = F.when(F.col("chunk_encoding") == NUMPRESS_LINEAR, decode_linear(F.col(f"{axis}_numpress_linear_bytes"))).otherwise(coords)
    zipped = chunks.withColumn(axis, coords).select(key, "chunk_id", F.posexplode(F.arrays_zip(axis, *others)).alias("place", "p"))
    return zipped.select(key, "chunk_id", "place", f"p.{axis}", *[f"p.{o}" for o in others])


def read_chunks(chunks: DataFrame, fill: str | None = NULL_INTERPOLATE, key: str = "index", axis: str = "mz", others: tuple[str, ...] = ("intensity",), model: DataFrame | None = None) -> DataFrame:
    """Points of whole entities: decoded, null coordinates interpolated (or left, with fill=None), null intensities zero.

    model: (key, mz_delta_model) for stretches of one value. A coordinate that nothing tells stays null.
    """
    points = decode_chunks(chunks, key, axis, others)
    if fill is None:
        return points
    points = points.withColumn("_pos", F.struct("chunk_id", "place"))
    filled = fill_coordinates(points, key, "_pos", axis, model)
    zero = [F.coalesce(F.col(o), F.lit(0)).cast(points.schema[o].dataType).alias(o) if points.schema[o].dataType.typeName() in ("float", "double", "integer", "long") else F.col(o) for o in others]
    return filled.select(key, "chunk_id", "place", axis, *zero)


def fill_coordinates(points: DataFrame, key: str, pos: str, axis: str, model: DataFrame | None = None) -> DataFrame:
    """Null coordinates from their stretches; an entity's spacing model tells the step of a single value."""
    if model is None:
        return signal.fill_nulls(points, key, pos, axis, name="_filled").withColumn(axis, F.col("_filled")).drop("_filled")
    told = points.join(model.select(key, F.col("mz_delta_model").alias("_model")), key, "left")
    filled = signal.fill_nulls(told, key, pos, axis, models.predict(F.col("_model"), F.col("_edge")), name="_filled")
    return filled.withColumn(axis, F.col("_filled")).drop("_filled", "_model")


def entity_from_chunks(chunks: DataFrame, index: int, key: str = "index", axis: str = "mz", others: tuple[str, ...] = ("intensity",), model: DataFrame | None = None) -> DataFrame:
    """The points of one entity in order, as a single read gives them: filled, without columns that are null throughout."""
    points = read_chunks(chunks.where(F.col(key) == index), NULL_INTERPOLATE, key, axis, others, model)
    return points.orderBy("chunk_id", "place")


def extract_from_chunks(
    chunks: DataFrame, lo: float | None, hi: float | None, key: str = "index", axis: str = "mz", others: tuple[str, ...] = ("intensity",), meta: DataFrame | None = None, time: extract.Range | None = None,
    ms_level: extract.Range | None = None, im: extract.Range | None = None, fill: str | None = None, model: DataFrame | None = None, with_time: bool = False,
) -> DataFrame:
    """Points in a slab of coordinate, time, MS level and mobility (other column ``im``).

    Chunks are selected by entity and by their bounds before a list is opened, then decoded and trimmed.
    fill=NULL_INTERPOLATE decodes the selected entities whole, as a stretch between nulls may lie in
    several chunks, fills null coordinates and trims then; else null coordinates are in no range.
    """
    near = chunks
    keys = extract.select_entities(meta, time, ms_level) if meta is not None and (time or ms_level or with_time) else None
    if keys is not None:
        near = near.join(keys.select(F.col("index").alias(key)), key, "left_semi")
    if fill is None and (lo is not None or hi is not None):
        far = float("inf")
        near = near.where(extract.overlaps(f"{axis}_chunk_start", f"{axis}_chunk_end", -far if lo is None else lo, far if hi is None else hi))
    points = decode_chunks(near, key, axis, others) if fill is None else read_chunks(near, fill, key, axis, others, model)
    if lo is not None or hi is not None:
        points = points.where(extract.contains(axis, lo, hi))
    if im and "im" in points.columns:
        points = points.where(extract.contains("im", *im))
    return points.join(keys.select(F.col("index").alias(key), "time"), key) if with_time and keys is not None else points


# --- numpress, as published --------------------------------------------------------------------------


# Kernels take many lists at once, behind each other, with ``at`` where each begins and the last ends: lists are
# often short, and numpy's calls then cost far more than their values. Encoders give all bytes and where those of each
# list begin; decoders all values, where those of each list begin, and which lists could be read.

#: Values or bytes that are worked on at a time, lists being kept whole.
AT_ONCE = 1 << 18
_POWERS = [np.uint32(1 << 4 * k) for k in range(8)]


def _begins(lengths) -> np.ndarray:
    """Where lists of these lengths begin, and the last one ends."""
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _places(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of every value's list, and its place there."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return owner, np.arange(len(owner)) - at[owner]


def _most(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The largest value of every list, 0 for an empty one."""
    out, some = np.zeros(len(at) - 1), at[1:] > at[:-1]
    if some.any():
        out[some] = np.maximum.reduceat(values, at[:-1][some])
    return out


def _second_differences(values: np.ndarray, place: np.ndarray) -> np.ndarray:
    """From the third value of every list on, 0 before."""
    out = np.zeros_like(values)
    out[2:] = values[2:] - 2 * values[1:-1] + values[:-2]
    out[place < 2] = 0
    return out


def _sums(values: np.ndarray, at: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Sums of every list's whole numbers up to each of them."""
    total = _begins(values)
    return total[1:] - total[at[:-1]][owner]


def _to_half_bytes(numbers: np.ndarray, at: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers as half-bytes: a count of leading zero (0-8) or one (9-16) half-bytes, then the others, lowest first.

    free: as many bytes stay zero in front of each list's.
    """
    u = numbers.astype(np.int64).astype(np.uint32)
    zeros = sum((u < p).view(np.int8) for p in _POWERS)
    ones = sum((~u < p).view(np.int8) for p in _POWERS[1:])
    kept = 8 - np.maximum(zeros, ones)
    ends = _begins(1 + kept.astype(np.int64))
    # an odd count gets a filler: a count of no zeros needs eight half-bytes behind it, so at the very end it is none
    begins = _begins(free + (np.diff(ends[at]) + 1) // 2)
    where = ends[:-1] + np.repeat(2 * (begins[:-1] + free) - ends[at[:-1]], np.diff(at))
    out = np.zeros(2 * int(begins[-1]), dtype=np.uint8)
    out[where] = np.where(ones > 0, ones + 8, zeros)
    for k in range(8):
        some = np.flatnonzero(kept > k)
        out[where[some] + 1 + k] = (u[some] >> np.uint32(4 * k)) & np.uint32(0xF)
    return (out[0::2] << 4) | out[1::2], begins


def _of_half_bytes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The integers; a list whose last one is cut off can't be read."""
    halves = np.stack([raw >> 4, raw & 0xF], axis=1).ravel()
    owner = np.repeat(np.arange(len(at) - 1), 2 * np.diff(at))
    end = 2 * at[1:][owner]
    lead = np.where(halves <= 8, halves, halves - 8).astype(np.int64)
    behind = np.arange(len(halves)) + 9 - lead
    follows = np.minimum(behind, end).tolist()
    heads, i, n = [], 0, len(halves)
    while i < n:  # where a number begins only the one before it tells
        heads.append(i)
        i = follows[i]
    head = np.array(heads, dtype=np.int64)
    cut = behind[head] > end[head]
    filler = cut & (head == end[head] - 1) & (halves[head] == 0)
    whole = np.ones(len(at) - 1, dtype=bool)
    whole[owner[head[cut & ~filler]]] = False
    head = head[~cut & whole[owner[head]]]
    kept = 8 - lead[head]
    u = np.where(halves[head] > 8, np.uint32(0xFFFFFFFF), np.uint32(0))
    for k in range(8):
        some = np.flatnonzero(kept > k)
        shift = np.uint32(4 * k)
        u[some] = (u[some] & ~(np.uint32(0xF) << shift)) | (halves[head[some] + 1 + k].astype(np.uint32) << shift)
    return u.view(np.int32).astype(np.int64), _begins(np.bincount(owner[head], minlength=len(at) - 1)), whole


def _linear_bytes(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fixed point, then the second differences as half-bytes; nulls are written as zeros."""
    v, n = np.nan_to_num(values, nan=0.0), np.diff(at)
    owner, place = _places(at)
    # a difference that isn't a number counts for nothing
    most = np.fmax(np.maximum(_most(np.abs(v), at), 1e-12), _most(np.abs(_second_differences(v, place)), at))
    point = np.floor(0x7FFFFFFF / most)
    ints = np.floor(v * point[owner] + 0.5).astype(np.int64)
    second = _second_differences(ints, place)
    over = _most(np.abs(second), at) > 0x7FFFFFFF  # rounding adds up to 2 to a second difference
    if over.any():
        point = np.where(over, np.floor((0x7FFFFFFF - 4) / most), point)
        ints = np.floor(v * point[owner] + 0.5).astype(np.int64)
        second = _second_differences(ints, place)
    out, begins = _to_half_bytes(second[place >= 2], _begins(np.maximum(n - 2, 0)), 8 + 4 * np.minimum(n, 2))
    out[begins[:-1, None] + np.arange(8)] = point.astype(">f8").view(np.uint8).reshape(-1, 8)
    first = place < 2
    out[(begins[owner[first]] + 8 + 4 * place[first])[:, None] + np.arange(4)] = ints[first].astype("<i4").view(np.uint8).reshape(-1, 4)
    return out, begins


def _linear_values(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decoded values; zeros stand for nulls and come back as NaN."""
    n = np.diff(at)
    second, second_at, whole = _of_half_bytes(raw[_places(at)[1] >= 16], _begins(np.maximum(n - 16, 0)))
    whole &= (n == 8) | (n == 12) | (n >= 16)
    written = np.where(whole, np.minimum((n - 8) // 4, 2), 0)
    out = _begins(written + np.diff(second_at))
    owner, place = _places(out)
    steps = np.zeros(len(owner), dtype=np.int64)
    steps[place >= 2] = second
    first = np.zeros((len(n), 2), dtype=np.int64)
    for k in (0, 1):
        some = np.flatnonzero(written > k)
        first[some, k] = raw[(at[some] + 8 + 4 * k)[:, None] + np.arange(4)].view("<i4").ravel()
    steps[place == 1] = (first[:, 1] - first[:, 0])[written == 2]
    ints = first[:, 0][owner] + _sums(_sums(steps, out, owner), out, owner)
    v = ints.astype(float) / _points(raw, at, whole)[owner]
    return np.where(v == 0, np.nan, v), out, whole


def _points(raw: np.ndarray, at: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The fixed points that whole lists begin with."""
    out = np.ones(len(whole))
    out[whole] = raw[at[:-1][whole][:, None] + np.arange(8)].view(">f8").ravel()
    return out


def _slof_bytes(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms as 16-bit fixed point; nulls are written as zeros."""
    logs = np.log1p(np.nan_to_num(values, nan=0.0))
    owner, place = _places(at)
    point = np.floor(0xFFFF / np.maximum(_most(logs, at), 1e-9))
    begins = _begins(8 + 2 * np.diff(at))
    out = np.zeros(int(begins[-1]), dtype=np.uint8)
    out[begins[:-1, None] + np.arange(8)] = point.astype(">f8").view(np.uint8).reshape(-1, 8)
    out[(begins[owner] + 8 + 2 * place)[:, None] + np.arange(2)] = np.floor(logs * point[owner] + 0.5).clip(0, 0xFFFF).astype("<u2").view(np.uint8).reshape(-1, 2)
    return out, begins


def _slof_values(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.diff(at)
    whole = (n >= 8) & (n % 2 == 0)
    owner, place = _places(at)
    codes = raw[(place >= 8) & whole[owner]].view("<u2")
    out = _begins(np.where(whole, (n - 8) // 2, 0))
    return np.expm1(codes / _points(raw, at, whole)[_places(out)[0]]), out, whole


def _pic_bytes(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rounded counts as half-bytes; nulls are written as zeros."""
    return _to_half_bytes(np.floor(np.nan_to_num(values, nan=0.0) + 0.5), at, np.zeros(len(at) - 1, dtype=np.int64))


def _pic_values(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    numbers, out, whole = _of_half_bytes(raw, at)
    return numbers.astype(float), out, whole


def _bytes_of_one(f, values) -> bytes:
    v = np.asarray(values, dtype=float)
    return f(v, _begins([len(v)]))[0].tobytes()


def _values_of_one(f, data: bytes) -> np.ndarray:
    """Raises ValueError for bytes that can't be read."""
    values, _, whole = f(np.frombuffer(data, dtype=np.uint8), _begins([len(data)]))
    if not whole.all():
        raise ValueError("the bytes are cut off")
    return values


def _half_bytes(values: np.ndarray) -> bytes:
    v = np.asarray(values)
    return _to_half_bytes(v, _begins([len(v)]), np.zeros(1, dtype=np.int64))[0].tobytes()


def _from_half_bytes(data: bytes) -> np.ndarray:
    return _values_of_one(_of_half_bytes, data)


def linear_encode(values: np.ndarray) -> bytes:
    return _bytes_of_one(_linear_bytes, values)


def linear_decode(data: bytes) -> np.ndarray:
    return _values_of_one(_linear_values, data)


def slof_encode(values: np.ndarray) -> bytes:
    return _bytes_of_one(_slof_bytes, values)


def slof_decode(data: bytes) -> np.ndarray:
    return _values_of_one(_slof_values, data)


def pic_encode(values: np.ndarray) -> bytes:
    return _bytes_of_one(_pic_bytes, values)


def pic_decode(data: bytes) -> np.ndarray:
    return _values_of_one(_pic_values, data)


def _in_groups(f, values: np.ndarray, at: np.ndarray) -> list[tuple]:
    """What a kernel gives for groups of lists of about AT_ONCE values; a longer list goes alone."""
    out, i = [], 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + AT_ONCE, "right")) - 1)
        out.append(f(values[at[i] : at[j]], at[i : j + 1] - at[i]))
        i = j
    return out


def _joined(parts: list[tuple], kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The groups' values behind each other, and where each list begins."""
    return np.concatenate([np.zeros(0, dtype=kind), *[p[0] for p in parts]]), _begins(np.concatenate([np.zeros(0, dtype=np.int64), *[np.diff(p[1]) for p in parts]]))


def _encoder(f):
    @F.arrow_udf(T.BinaryType())
    def encode(lists: pa.Array) -> pa.Array:
        raw, at = _joined(_in_groups(f, *_lists(lists)), np.uint8)
        return pa.Array.from_buffers(pa.binary(), len(lists), [lists.is_valid().buffers()[1], pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)])

    return encode


def _decoder(f):
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def decode(blobs: pa.Array) -> pa.Array:
        there = blobs.is_valid().to_numpy(zero_copy_only=False)
        kept = pa.concat_arrays([blobs.cast(pa.large_binary()).fill_null(b"")])
        _, at, raw = kept.buffers()
        at = np.frombuffer(at, dtype=np.int64)[kept.offset : kept.offset + len(kept) + 1]
        parts = _in_groups(f, np.frombuffer(raw or b"", dtype=np.uint8)[at[0] : at[-1]], at - at[0])
        return _list_array(*_joined(parts, np.float64), there & np.concatenate([np.zeros(0, dtype=bool), *[p[2] for p in parts]]))

    return decode


def _values_of_many(f, blobs: list[bytes]) -> list[np.ndarray | None]:
    """What a decoding kernel gives for each, None for damaged bytes."""
    parts = _in_groups(f, np.frombuffer(b"".join(blobs), dtype=np.uint8), _begins([len(b) for b in blobs]))
    return [values[a:b] if w else None for values, at, whole in parts for a, b, w in zip(at[:-1], at[1:], whole)]


def _or_none(f, blob: bytes | None) -> np.ndarray | None:
    """What a decoder gives, None for no or damaged bytes."""
    try:
        return None if blob is None else f(bytes(blob))
    except (ValueError, IndexError):
        return None


encode_linear, decode_linear = _encoder(_linear_bytes), _decoder(_linear_values)
encode_slof, decode_slof = _encoder(_slof_bytes), _decoder(_slof_values)
encode_pic, decode_pic = _encoder(_pic_bytes), _decoder(_pic_values)


# --- auxiliary arrays --------------------------------------------------------------------------------

_CODECS = {NUMPRESS_SLOF: (slof_encode, slof_decode), NUMPRESS_PIC: (pic_encode, pic_decode), NUMPRESS_LINEAR: (linear_encode, linear_decode)}


_KERNELS = {NUMPRESS_SLOF: _slof_values, NUMPRESS_PIC: _pic_values, NUMPRESS_LINEAR: _linear_values}


def _raw(data) -> bytes:
    return b"" if data is None else np.asarray(data).astype(np.int64).astype(np.uint8).tobytes()


def decode_array(data, compression: str | None, data_type: str | None) -> np.ndarray | list[str] | None:
    """The values of an encoded array: int64, float64 or a list of texts; None where bytes and type don't fit."""
    raw = _raw(data)
    if compression in _CODECS:
        return _or_none(_CODECS[compression][1], raw) if raw else np.zeros(0)
    if compression == ZLIB:
        try:
            raw = zlib.decompress(raw)
        except zlib.error:
            return None
    if data_type == ASCII:
        return [part.decode("ascii", "replace") for part in raw.split(b"\0") if part]
    kind = DTYPES.get(data_type or "")
    if kind is None or len(raw) % np.dtype(kind).itemsize:
        return None
    return np.frombuffer(raw, dtype=kind).astype(np.int64 if kind[1] == "i" else np.float64)


def encode_array(values, compression: str | None, data_type: str) -> bytes:
    """The bytes of an array: numbers in their type or by Numpress, texts behind each other with a NUL each."""
    if compression in _CODECS:
        return _CODECS[compression][0](np.asarray(values, dtype=float))
    raw = b"".join(str(v).encode("ascii", "replace") + b"\0" for v in values) if data_type == ASCII else np.asarray(values).astype(DTYPES[data_type]).tobytes()
    return zlib.compress(raw) if compression == ZLIB else raw


_TYPED = T.StructType([T.StructField("integers", T.ArrayType(T.LongType())), T.StructField("floats", T.ArrayType(T.DoubleType())), T.StructField("texts", T.ArrayType(T.StringType()))])


@F.pandas_udf(_TYPED)
def decode_auxiliary(data: pd.Series, compression: pd.Series, data_type: pd.Series) -> pd.DataFrame:
    """Typed: one of the three is filled, none where the bytes can't be read."""
    out: dict[str, list] = {"integers": [], "floats": [], "texts": []}
    packed = {c: iter(_values_of_many(f, [_raw(d) for d in data[compression == c] if d is not None and len(d)])) for c, f in _KERNELS.items()}
    for d, c, t in zip(data, compression, data_type):
        v = next(packed[c]) if c in packed and d is not None and len(d) else decode_array(d, c, t)
        kind = None if v is None else "texts" if isinstance(v, list) else "integers" if v.dtype.kind == "i" else "floats"
        for name, column in out.items():
            column.append(v if name == kind else None)
    return pd.DataFrame({name: pd.Series(column, dtype=object) for name, column in out.items()})


def encode_auxiliary(values: Column, compression: str | None, data_type: str) -> Column:
    """A list of numbers or texts as the byte payload of an auxiliary array."""

    @F.pandas_udf(T.ArrayType(T.ShortType()))
    def encode(lists: pd.Series) -> pd.Series:
        return lists.map(lambda v: None if v is None else np.frombuffer(encode_array(v, compression, data_type), dtype=np.uint8).astype(np.int16))

    return encode(values)


def auxiliary_values(spectrum: DataFrame, key: str = "spectrum_key") -> DataFrame:
    """(key, place, name, compression, data_type, integers, floats, texts) of the auxiliary arrays; spectra that count none are not opened."""
    some = spectrum.where("number_of_auxiliary_arrays > 0").select(key, F.posexplode("auxiliary_arrays").alias("place", "a")).where("a is not null")
    told = some.withColumn("v", decode_auxiliary("a.data", "a.compression", "a.data_type"))
    return told.select(key, "place", F.col("a.name.name").alias("name"), "a.compression", "a.data_type", "v.integers", "v.floats", "v.texts")
