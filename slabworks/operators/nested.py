"""Deeply nested semi-structured records as linked flat tables.

Records come as JSON text (typed nested columns are written as such by ``to_json``, inside the JVM).
A batch of texts is one byte buffer on which everything is vectorised: bitmaps of quotes, brackets and
delimiters; strings from the prefix sum of quotes; nesting depth from the prefix sum of brackets; a
stable sort of the structural characters by depth brings each container's delimiters together, which
gives spans and places. Each child row names its parent, its path and its place.

Defined results: null records and null or empty arrays have no children; null elements, and parameters
in which nothing is filled, are no rows but keep their place; damaged texts raise no error, they give
the children that can be told before the damage. Texts may be empty or of any length: batches are cut so
that about BATCH_BYTES are indexed at a time (one longer text is a batch of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text indexed at once; the bitmaps and sums take some 25 bytes for each.
BATCH_BYTES = 4_000_000
_OPEN_ARRAY, _CLOSE_ARRAY, _OPEN_OBJECT, _CLOSE_OBJECT, _COMMA, _COLON = b"[]{},:"


class StructuralIndex:
    """Containers and value spans of all texts of a buffer.

    A node is the span of one value; it starts behind the structural character ``start`` and ends before
    the structural character ``end`` (both numbered in order of position).
    """

    def __init__(self, buf: np.ndarray, starts: np.ndarray):
        quote = buf == 0x22
        slash = buf == 0x5C
        if slash.any():  # a quote behind an odd run of backslashes is text
            at = np.flatnonzero(quote)
            run_end = np.flatnonzero(~slash)
            last_plain = np.searchsorted(run_end, at, side="left") - 1
            begin = np.where(last_plain >= 0, run_end[np.maximum(last_plain, 0)], -1)
            quote[at[(at - begin - 1) % 2 == 1]] = False
        wide = np.int32 if len(buf) < 2**31 - 1 else np.int64
        inside = np.cumsum(quote, dtype=wide)
        first = np.repeat(np.concatenate([np.zeros(1, dtype=wide), inside])[starts[:-1]], np.diff(starts))
        outside = (inside - first) & 1 == 0
        del inside, first
        kind = np.zeros(256, dtype=np.int8)
        kind[[_OPEN_ARRAY, _OPEN_OBJECT]] = 1
        kind[[_CLOSE_ARRAY, _CLOSE_OBJECT]] = -1
        kind[[_COMMA, _COLON]] = 2
        self.pos = np.flatnonzero((kind[buf] != 0) & outside & ~quote)
        self.char = buf[self.pos]
        k = kind[self.char]
        self.row = np.searchsorted(starts, self.pos, side="right") - 1
        step = np.where(k == 2, 0, k).astype(np.int64)
        depth = np.cumsum(step)
        begins = np.searchsorted(self.pos, starts[:-1])
        base = np.concatenate([[0], depth])[begins]
        depth = depth - base[self.row] + (k == -1)  # opening and closing bracket have the depth of their content
        order = np.lexsort((self.pos, depth, self.row))
        opens = k[order] == 1
        group = np.cumsum(opens) - 1
        container = np.empty(len(order), dtype=np.int64)
        container[order] = group
        self.container = container
        self.opener = order[opens] if len(order) else np.zeros(0, dtype=np.int64)  # token that opens each container
        self.container_of_open = np.full(len(order), -1, dtype=np.int64)
        self.container_of_open[self.opener] = np.arange(len(self.opener))
        # nodes: neighbours in a container's own order
        a, b = order[:-1], order[1:]
        same = (group[:-1] == group[1:]) & (group[:-1] >= 0)
        is_array = np.zeros(len(order), dtype=bool)
        if len(self.opener):
            is_array = self.char[self.opener][np.maximum(container, 0)] == _OPEN_ARRAY
        starts_value = np.where(is_array[a], True, self.char[a] == _COLON)
        visible = ~np.isin(buf, np.frombuffer(b" \t\r\n", dtype=np.uint8))
        solid = np.concatenate([np.zeros(1, dtype=wide), np.cumsum(visible, dtype=wide)])
        self._solid = solid
        self._last_visible = np.maximum.accumulate(np.where(visible, np.arange(len(buf)), -1)) if not visible.all() else None
        filled = solid[self.pos[b]] - solid[self.pos[a] + 1] > 0
        keep = same & starts_value & filled
        self.start, self.end = a[keep], b[keep]
        self.in_array = is_array[self.start]
        # the place of an array's element: delimiters of its container before it
        rank = np.arange(len(order)) - np.concatenate([np.flatnonzero(opens), [0]])[np.maximum(group, 0)]
        place = np.empty(len(order), dtype=np.int64)
        place[order] = rank
        self.place = place[self.start]
        # a scalar that is filled: it starts with something else than a bracket or the n of null
        head = self.pos[self.start] + 1
        gap = np.flatnonzero(np.isin(buf[np.minimum(head, len(buf) - 1)], np.frombuffer(b" \t\r\n", dtype=np.uint8)))
        for i in gap:  # JSON with blanks behind its delimiters
            while head[i] < self.pos[self.end[i]] and buf[head[i]] in b" \t\r\n":
                head[i] += 1
        self.head = head
        lead = buf[np.minimum(head, len(buf) - 1)]
        self.is_null = lead == 0x6E
        scalar = ~self.is_null & ~np.isin(lead, np.frombuffer(b"[{", dtype=np.uint8))
        self._scalars = np.cumsum(np.bincount(self.start[scalar] + 1, minlength=len(order) + 1))
        self.buf = buf

    def is_filled(self, nodes: np.ndarray) -> np.ndarray:
        """Whether anything at all is filled within a node."""
        return self._scalars[self.end[nodes]] - self._scalars[self.start[nodes]] > 0

    def with_key(self, nodes: np.ndarray, key: str) -> np.ndarray:
        """Those object members whose key it is."""
        want = np.frombuffer(b'"' + key.encode() + b'"', dtype=np.uint8)
        colon = self.pos[self.start[nodes]]
        if self._last_visible is not None:  # blanks before a colon
            colon = self._last_visible[np.maximum(colon - 1, 0)] + 1
        fit = colon >= len(want)
        nodes, colon = nodes[fit], colon[fit]
        if not len(nodes):
            return nodes
        text = self.buf[colon[:, None] - np.arange(len(want), 0, -1)[None, :]]
        prev = self.pos[np.maximum(self.start[nodes] - 1, 0)]
        whole = (text == want).all(axis=1) & (self._solid[np.maximum(colon - len(want), 0)] - self._solid[np.minimum(prev + 1, colon)] <= 0)
        return nodes[whole]

    def content_of(self, nodes: np.ndarray) -> np.ndarray:
        """The container each node consists of, -1 for scalars."""
        nxt = self.start[nodes] + 1
        return self.container_of_open[np.minimum(nxt, len(self.container_of_open) - 1)]


def _members(ix: StructuralIndex, parents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent's number, node) for the nodes directly inside the parents' containers."""
    inside = ix.content_of(parents) if len(parents) else np.zeros(0, dtype=np.int64)
    holder = np.full(len(ix.opener) + 1, -1, dtype=np.int64)
    ok = inside >= 0
    holder[inside[ok]] = np.flatnonzero(ok)
    own = holder[ix.container[ix.start]]
    nodes = np.flatnonzero(own >= 0)
    return own[nodes], nodes


def children(ix: StructuralIndex | None, path: tuple[str, ...], hollow_counts: bool) -> dict[str, np.ndarray]:
    """Elements of the array at path (each step an array of objects): their row, places along the path, span.

    ix: the index of a batch, for whatever paths; None for an empty one. hollow_counts: whether an element in
    which nothing is filled is a row (null elements never are).
    """
    empty = np.zeros(0, dtype=np.int64)
    none = {"row": empty, "places": np.zeros((len(path), 0), dtype=np.int64), "head": empty, "stop": empty}
    if ix is None or not len(ix.opener):
        return none
    # root objects: the first container of each row
    roots = np.unique(ix.row[ix.opener], return_index=True)[1]
    holder = np.full(len(ix.opener), -1, dtype=np.int64)
    holder[roots] = 1
    nodes = np.flatnonzero(holder[ix.container[ix.start]] >= 0)
    places = np.zeros((0, len(nodes)), dtype=np.int64)
    for step in path:
        keep = np.isin(nodes, ix.with_key(nodes, step))
        arrays, places = nodes[keep], places[:, keep]
        own, elements = _members(ix, arrays)
        on = ix.in_array[elements]
        own, elements = own[on], elements[on]
        places = np.vstack([places[:, own], ix.place[elements][None, :]])
        final = step is path[-1] and len(places) == len(path)
        if final:
            alive = ~ix.is_null[elements]
            if not hollow_counts:
                alive &= ix.is_filled(elements)
            elements, places = elements[alive], places[:, alive]
            return {"row": ix.row[ix.start[elements]], "places": places, "head": ix.head[elements], "stop": ix.pos[ix.end[elements]]}
        own, nodes = _members(ix, elements)
        places = places[:, own]
    return none


def flatten(records: DataFrame, key: str, json: str, owner_table: str, paths: list[tuple[str, ...]], hollow: tuple[tuple[str, ...], ...] = (), with_record: bool = False) -> DataFrame:
    """Child rows of JSON records: (owner_table, owner_id, field_path, pos_outer, pos_inner[, record]).

    paths have one or two steps. No shuffle: each Arrow batch is indexed where it was read.
    """

    def of_part(owners: pa.Array, buf: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ix = StructuralIndex(buf, starts) if len(buf) else None
        raw = buf.tobytes() if with_record else b""
        for path in paths:
            got = children(ix, path, path in hollow)
            n = len(got["row"])
            if not n:
                continue
            same = pa.array(np.zeros(n, dtype=np.int32))
            columns = [
                pa.array([owner_table]).take(same), owners.take(pa.array(got["row"])), pa.array([".".join(path)]).take(same), pa.array(got["places"][0].astype(np.int32)),
                pa.array(got["places"][1].astype(np.int32) if len(path) > 1 else np.full(n, -1, dtype=np.int32)),
            ]
            names = ["owner_table", "owner_id", "field_path", "pos_outer", "pos_inner"]
            if with_record:
                columns.append(pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(got["head"], got["stop"])], pa.string()))
                names.append("record")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = texts.buffers()[2]
            whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
            first = 0
            while first < len(texts):  # at least one text, and those behind it that fit
                stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BATCH_BYTES, side="right")) - 1)
                yield from of_part(batch.column(0).slice(first, stop - first), whole[offsets[first] : offsets[stop]].copy(), offsets[first : stop + 1] - offsets[first])
                first = stop

    schema = "owner_table string, owner_id bigint, field_path string, pos_outer int, pos_inner int" + ", record string" * with_record
    return records.select(F.col(key).cast("bigint").alias("owner_id"), F.col(json).alias("json")).mapInArrow(index, schema)


def as_json(*columns: Column | str) -> Column:
    """Nested columns as one JSON text; nulls inside are left out, null elements keep their place."""
    return F.to_json(F.struct(*columns))


PARAM_DDL = "value struct<integer:bigint,float:double,string:string,boolean:boolean>, accession string, name string, unit string"
ARRAY_DDL = f"data array<smallint>, name struct<{PARAM_DDL}>, data_type string, compression string, unit string, data_processing_ref string"


def run_children(spectrum: DataFrame, selected_ion: DataFrame, with_record: bool = False, payload: bool = False) -> DataFrame:
    """Children of spectra (parameters, auxiliary arrays and their parameters) and of ions (parameters).

    Repeated deliveries of a record are one record; each column is read from the latest that holds it, so a
    later one without it takes no children away, and an empty array does. A null loaded_at is the earliest.
    payload: whether the records of auxiliary arrays hold their data too; else it is neither written as text
    nor shuffled. array_table needs it.
    """
    arrays = spectrum.schema["auxiliary_arrays"].dataType.elementType
    if not payload and "data" in arrays.names and len(arrays.names) > 1:
        spectrum = spectrum.withColumn("auxiliary_arrays", F.transform("auxiliary_arrays", lambda a: a.dropFields("data")))
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("loaded_at"))).alias(c)
    once = lambda df, key, *cols: df.groupBy(key).agg(*map(latest, cols)).select(key, as_json(*cols).alias("json"))
    outer, aux, inner = ("parameters",), ("auxiliary_arrays",), ("auxiliary_arrays", "parameters")
    spectra = flatten(once(spectrum, "spectrum_key", "parameters", "auxiliary_arrays"), "spectrum_key", "json", "spectrum", [outer, aux, inner], (aux,), with_record)
    ions = flatten(once(selected_ion, "ion_id", "parameters"), "ion_id", "json", "selected_ion", [outer], (), with_record)
    return spectra.unionByName(ions)


def parameter_table(found: DataFrame) -> DataFrame:
    """The parameter children with typed columns: parent, place, the four value slots, accession, name, unit."""
    p = F.from_json("record", PARAM_DDL)
    return found.where("field_path <> 'auxiliary_arrays'").select("owner_table", "owner_id", "field_path", "pos_outer", "pos_inner", p.alias("p")).select(
        "owner_table", "owner_id", "field_path", "pos_outer", "pos_inner", *[F.col(f"p.value.{s}").alias(f"value_{s}") for s in ("integer", "float", "string", "boolean")], "p.accession", "p.name", "p.unit"
    )


def array_table(found: DataFrame) -> DataFrame:
    """The auxiliary arrays with typed columns: parent, place, the parameter that names them, how they are stored, their data."""
    a = F.from_json("record", ARRAY_DDL)
    return found.where("field_path = 'auxiliary_arrays'").select("owner_table", "owner_id", "field_path", "pos_outer", "pos_inner", a.alias("a")).select(
        "owner_table", "owner_id", "field_path", "pos_outer", "pos_inner", *[F.col(f"a.name.value.{s}").alias(f"name_{s}") for s in ("integer", "float", "string", "boolean")],
        *[F.col(f"a.name.{s}").alias(f"name_{s}") for s in ("accession", "name", "unit")], "a.data_type", "a.compression", "a.unit", "a.data_processing_ref", "a.data"
    )
