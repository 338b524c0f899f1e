"""Run archives: a directory or an uncompressed ZIP of Parquet members with a JSON index.

A directory is read where it is, by any Hadoop URI Spark knows. Members of a ZIP are stored uncompressed:
they are read as ranges of the archive by ``stored_zip``, or, where a shared folder is named, copied there
first, which gives Spark's own Parquet scan with its pushed filters.
"""

from __future__ import annotations

import json
import shutil
import warnings
import zipfile
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slabworks.sources.stored_zip import StoredZip, member_range, open_file

#: The index is the one member so named, whatever precedes it; archives written here use INDEX.
INDEX_ENDING, INDEX = "_index.json", "run_index.json"
#: File names of the table members.
MEMBERS = {
    ("spectrum", "metadata"): "spectra_metadata", ("spectrum", "data arrays"): "spectra_data", ("spectrum", "peaks"): "spectra_peaks",
    ("chromatogram", "metadata"): "chromatograms_metadata", ("chromatogram", "data arrays"): "chromatograms_data",
}


def classify(entity_type: str | None, data_kind: str | None) -> str:
    """The member kind of an index entry: one of the table members, proprietary or other."""
    entity, kind = (entity_type or "").strip().lower(), (data_kind or "").strip().lower()
    return MEMBERS.get((entity, kind), "proprietary" if kind == "proprietary" else "other")


def classify_by_name(name: str) -> str:
    """The member kind by a file name's ending, where no index tells it."""
    return next((m for m in MEMBERS.values() if name.rstrip("/").endswith(f"{m}.parquet")), "other")


class Archive:
    """An opened archive: its members by kind, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, root: str, entries: list[dict], metadata: dict):
        self.spark, self.root, self.entries, self.metadata = spark, root, entries, metadata

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def member(self, kind: str) -> DataFrame | None:
        """A table member, of several files all of them; whether by row, where a column's encoding needs it, is left to the session's Parquet settings."""
        out = None
        for name in (e["name"] for e in self.entries if e["kind"] == kind):
            out = self._read(name) if out is None else out.unionByName(self._read(name), allowMissingColumns=True)
        return out

    def signal(self, peaks: bool = False) -> tuple[str, DataFrame] | None:
        """The layout (point or chunk) and rows of the points or peaks, with their key as ``index``."""
        df = self.member("spectra_peaks" if peaks else "spectra_data")
        if df is None:
            return None
        shape = next((c for c in ("point", "chunk") if c in df.columns), None)
        rows = df.select(f"{shape}.*") if shape else df
        return shape or ("chunk" if "chunk_encoding" in rows.columns else "point"), rows.withColumnRenamed("spectrum_index", "index")

    def describe(self) -> DataFrame:
        """(what, value): spectra, points, whether there are peaks and chromatograms, and the arrays of the signal tables."""
        from slabworks.operators.facets import facet

        rows: list[tuple[str, str]] = []
        meta = self.member("spectra_metadata")
        if meta is not None:
            rows.append(("spectra", str((facet(meta, "spectrum") if "spectrum" in meta.columns else meta).count())))
        signal = self.signal()
        if signal is not None:
            layout, points = signal
            rows.append(("layout", layout))
            rows.append((f"{layout}s", str(points.count())))
            rows += [("spectrum array", c) for c in points.columns if c != "index"]
        rows.append(("peaks", str(self.member("spectra_peaks") is not None).lower()))
        rows.append(("chromatograms", str(self.member("chromatograms_metadata") is not None).lower()))
        return self.spark.createDataFrame(rows, "what string, value string")

    def listing(self) -> DataFrame:
        return self.spark.createDataFrame([(e["name"], e["entity_type"], e["data_kind"], e["kind"]) for e in self.entries], "name string, entity_type string, data_kind string, member_kind string")

    def raw(self, name: str) -> DataFrame:
        """Any member's bytes."""
        return self.spark.read.format("binaryFile").load(f"{self.root}/{name}").select("content", "length")

    def register(self, prefix: str = "") -> list[str]:
        """Temporary views of all tables, packed metadata taken apart into its facets."""
        from slabworks.operators.facets import FACET_KEYS, facet

        views = []
        for kind, names in (("spectra_metadata", {"spectrum": "spectra", "scan": "scans", "precursor": "precursors", "selected_ion": "selected_ions"}), ("chromatograms_metadata", {"chromatogram": "chromatograms"})):
            df = self.member(kind)
            for f, view in names.items():
                if df is not None and f in df.columns and f in FACET_KEYS:
                    facet(df, f).createOrReplaceTempView(prefix + view)
                    views.append(prefix + view)
        for kind, view in (("spectra_data", "points"), ("spectra_peaks", "peaks"), ("chromatograms_data", "traces")):
            df = self.member(kind)
            if df is not None:
                shape = next((c for c in ("point", "chunk") if c in df.columns), None)
                (df.select(f"{shape}.*") if shape else df).createOrReplaceTempView(prefix + ("chunks" if shape == "chunk" and view == "points" else view))
                views.append(prefix + ("chunks" if shape == "chunk" and view == "points" else view))
        return views


def _entries(index: dict | None, names: list[str]) -> list[dict]:
    if index is None:
        warnings.warn("no index in the archive; members are told by their names", stacklevel=3)
        return [{"name": n, "entity_type": None, "data_kind": None, "kind": classify_by_name(n)} for n in names]
    return [{"name": e["name"], "entity_type": e.get("entity_type"), "data_kind": e.get("data_kind"), "kind": classify(e.get("entity_type"), e.get("data_kind"))} for e in index.get("files", [])]


def open_directory(spark: SparkSession, root: str) -> Archive:
    """An unpacked archive at a path or Hadoop URI."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(fs_path))
    index = None
    found = [n for n in names if n.endswith(INDEX_ENDING)]
    if found:
        index = json.loads(spark.read.text(f"{root}/{found[0]}", wholetext=True).first()[0])
    return Archive(spark, root, _entries(index, [n for n in names if n not in found]), (index or {}).get("metadata", {}))


class PackedArchive(Archive):
    """An archive whose members are read within the ZIP."""

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.format("stored_zip").option("path", self.root).option("member", name).load()

    def raw(self, name: str) -> DataFrame:
        start, size = member_range(self.root, name)
        with open_file(self.root) as f:
            f.seek(start)
            content = f.read(size)
        return self.spark.createDataFrame([(bytearray(content), size)], "content binary, length bigint")


def open_packed(spark: SparkSession, path: str) -> PackedArchive:
    """A packed archive at a path or URI, read in place: every task opens the ranges of its row groups."""
    spark.dataSource.register(StoredZip)
    with open_file(path) as f, zipfile.ZipFile(f) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        for info in infos:
            if info.compress_type != zipfile.ZIP_STORED:
                raise ValueError(f"{info.filename} is compressed; members must be stored")
        found = [i.filename for i in infos if i.filename.endswith(INDEX_ENDING)]
        index = json.loads(z.read(found[0])) if found else None
    return PackedArchive(spark, path, _entries(index, [i.filename for i in infos if i.filename not in found]), (index or {}).get("metadata", {}))


def open_zip(spark: SparkSession, path: str, shared: str) -> Archive:
    """A packed archive; its members are copied to the folder `shared`, which executors must be able to read."""
    with zipfile.ZipFile(path) as z:
        for info in z.infolist():
            if info.compress_type != zipfile.ZIP_STORED:
                raise ValueError(f"{info.filename} is compressed; members must be stored")
        for info in z.infolist():
            target = (Path(shared) / info.filename).resolve()
            if not target.is_relative_to(Path(shared).resolve()):
                raise ValueError(f"{info.filename} leads out of the archive")
            if not info.is_dir():
                target.parent.mkdir(parents=True, exist_ok=True)
                with z.open(info) as src, target.open("wb") as out:
                    shutil.copyfileobj(src, out, 1 << 20)
    return open_directory(spark, str(shared))


def open_archive(spark: SparkSession, path: str, shared: str | None = None) -> Archive:
    """A directory, or a ZIP read in place, or, if a shared folder is named, from a copy there."""
    if path.endswith(".zip") or ("://" not in path and Path(path).is_file() and zipfile.is_zipfile(path)):
        return open_packed(spark, path) if shared is None else open_zip(spark, path, shared)
    return open_directory(spark, path)


def writer_options(row_group_bytes: int = 512 << 20, page_bytes: int = 1 << 20, dictionary_bytes: int = 1 << 20, compression: str = "zstd", bloom: tuple[str, ...] = (), no_dictionary: tuple[str, ...] = ()) -> dict[str, str]:
    """Parquet options by name: sizes, compression, and columns (paths) with a bloom filter or without a dictionary."""
    told = {"compression": compression, "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.dictionary.page.size": dictionary_bytes}
    told |= {f"parquet.bloom.filter.enabled#{c}": "true" for c in bloom} | {f"parquet.enable.dictionary#{c}": "false" for c in no_dictionary}
    return {k: str(v) for k, v in told.items()}


def write_run(
    root: str, meta: DataFrame, points: DataFrame, layout: str = "chunk", width: float = 50.0, encoding: str | None = None, profile: str | None = "is_profile", peaks: DataFrame | None = None, pos: str = "pos",
    types: dict[str, str] | None = None, hooks: list | None = None, metadata: dict | None = None, extra: dict[str, bytes] | None = None,
) -> None:
    """An archive from spectra and their points.

    meta has a row per spectrum (index, id, time, ...) and maybe a boolean column `profile`: only profile
    spectra are stripped of zero runs and marked with nulls, others are written plainly. layout: chunk or
    point. types: columns of points in other types; hooks: what a caller adds to meta. Spectra are sorted by
    index and have a bloom filter on id; points are sorted by index and coordinate. Every spectrum gets its
    spacing model, with which its nulls are filled again.
    """
    from slabworks.operators import chunks, models, peaks as peak_lists, signal

    points = peak_lists.cast_columns(points, types or {})
    meta = peak_lists.with_hooks(meta, hooks or [])
    flags = meta.select("index", (F.coalesce(F.col(profile), F.lit(False)) if profile in meta.columns else F.lit(True)).alias("_profile"))
    parts = [points.join(flags.where(F.col("_profile") == is_profile).select("index"), "index", "left_semi") for is_profile in (True, False)]
    rows = None
    for is_profile, part in zip((True, False), parts):
        if layout == "chunk":
            one = chunks.encode_profile(part, width, encoding or chunks.DELTA, is_profile, pos=pos)
        elif is_profile:
            one = signal.null_mark(signal.strip_zero_runs(part, "index", pos, "intensity"), "index", pos, "intensity", ["mz"])
        else:
            one = part
        rows = one if rows is None else rows.unionByName(one)
    # a single column of struct is the file format; order within a spectrum is the order of its rows
    order = ["index", "chunk_id"] if layout == "chunk" else ["index", pos]
    data = rows.repartitionByRange("index").sortWithinPartitions(*order)
    told = meta.join(models.spacing_models(points), "index", "left")
    members = {"spectra_metadata": told.repartitionByRange("index").sortWithinPartitions("index").select(F.struct("*").alias("spectrum")), "spectra_data": data.select(F.struct("*").alias(layout))}
    if peaks is not None:
        members["spectra_peaks"] = peaks.repartitionByRange("index").sortWithinPartitions("index", "mz").select(F.struct("*").alias("point"))
    write_directory(root, members, metadata, None, writer_options(bloom=("spectrum.id",)), extra)


def write_directory(root: str, members: dict[str, DataFrame], metadata: dict | None = None, sort: dict[str, list[str]] | None = None, options: dict[str, str] | None = None, extra: dict[str, bytes] | None = None) -> None:
    """An unpacked archive: a Parquet dataset per member kind, an index, and any further files.

    sort: columns by which each member's files are sorted, so row-group and page statistics prune ranges.
    """
    kinds = {m: k for k, m in MEMBERS.items()}
    files = []
    for kind, df in members.items():
        rows = df.sortWithinPartitions(*sort[kind]) if sort and kind in sort else df
        w = rows.write.mode("overwrite").option("compression", "zstd")
        for k, v in (options or {}).items():
            w = w.option(k, v)
        w.parquet(f"{root}/{kind}.parquet")
        entity, data = kinds[kind]
        files.append({"name": f"{kind}.parquet", "entity_type": entity, "data_kind": data})
    spark = next(iter(members.values())).sparkSession
    for name, content in (extra or {}).items():
        _put(spark, f"{root}/{name}", content)
        files.append({"name": name, "entity_type": "other", "data_kind": "proprietary"})
    _put(spark, f"{root}/{INDEX}", json.dumps({"files": files, "metadata": metadata or {}}, indent=1).encode())


def _put(spark: SparkSession, path: str, content: bytes) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(content))
    out.close()


def pack_zip(root: str, path: str) -> None:
    """A packed archive of a directory: every member stored, one Parquet file per member, the index at the end."""
    base = Path(root)
    index = json.loads((base / INDEX).read_text())
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for e in index["files"]:
            src = base / e["name"]
            parts = sorted(src.glob("part-*.parquet")) if src.is_dir() else [src]
            if len(parts) == 1:
                z.write(parts[0], e["name"])
            else:  # members are single files in a ZIP: row groups are copied over, one at a time
                with z.open(e["name"], "w", force_zip64=True) as out, pq.ParquetWriter(out, pq.read_schema(parts[0]), compression="zstd") as w:
                    for p in parts:
                        f = pq.ParquetFile(p)
                        for g in range(f.num_row_groups):
                            w.write_table(f.read_row_group(g))
        z.writestr(INDEX, json.dumps(index, indent=1))


def column_sizes(spark: SparkSession, files: list[str]) -> DataFrame:
    """Compressed and plain bytes per column path, from the footers; each footer is read where its task runs."""

    def walk(batches):
        import pandas as pd
        import pyarrow.parquet as pq

        for pdf in batches:
            for name in pdf["file"]:
                m = pq.read_metadata(name)
                rows = [(m.row_group(g).column(c).path_in_schema, m.row_group(g).column(c).total_compressed_size, m.row_group(g).column(c).total_uncompressed_size) for g in range(m.num_row_groups) for c in range(m.num_columns)]
                yield pd.DataFrame(rows, columns=["path", "compressed", "plain"])

    return spark.createDataFrame([(f,) for f in files], "file string").mapInPandas(walk, "path string, compressed bigint, plain bigint").groupBy("path").agg(F.sum("compressed").alias("compressed"), F.sum("plain").alias("plain"))


def footer_documents(path: str) -> dict:
    """The JSON documents of a Parquet footer, by key; other entries as text."""
    out = {}
    for k, v in (pq.read_metadata(path).metadata or {}).items():
        text = v.decode("utf-8", "replace")
        try:
            out[k.decode()] = json.loads(text)
        except ValueError:
            out[k.decode()] = text
    return out


def schema_rows(df: DataFrame) -> list[tuple[str, str]]:
    """(path, type) of every field, nested ones too."""
    from pyspark.sql import types as T

    def walk(prefix: str, t) -> list[tuple[str, str]]:
        if isinstance(t, T.StructType):
            return [r for f in t.fields for r in [(f"{prefix}{f.name}", f.dataType.simpleString()), *walk(f"{prefix}{f.name}.", f.dataType)]]
        if isinstance(t, T.ArrayType):
            return walk(f"{prefix}element.", t.elementType)
        return []

    return walk("", df.schema)


def mgf_text(points: DataFrame, meta: DataFrame, ions: DataFrame, digits: int = 4) -> DataFrame:
    """Spectra as MGF text, one value per spectrum: ready for ``write.text``. Of a spectrum's ions the lowest is told."""
    number = lambda c: F.format_string(f"%.{digits}f", c.cast("double"))
    peaks = points.groupBy("index").agg(F.sort_array(F.collect_list(F.struct("mz", "intensity"))).alias("p"))
    first = ions.groupBy("index").agg(F.min(F.struct("mz", "charge")).alias("ion"))
    body = F.concat_ws("\n", F.transform("p", lambda x: F.concat_ws(" ", number(x["mz"]), number(x["intensity"]))))
    rows = meta.join(peaks, "index").join(first, "index", "left")
    told = lambda label, c, text: F.when(c.isNotNull(), F.concat(F.lit(label), text))
    head = F.concat_ws(
        "\n", F.lit("BEGIN IONS"), F.concat(F.lit("TITLE="), "id"), told("RTINSECONDS=", F.col("time"), number(F.col("time") * 60)), told("PEPMASS=", F.col("ion.mz"), number(F.col("ion.mz"))),
        told("CHARGE=", F.col("ion.charge"), F.concat(F.col("ion.charge").cast("string"), F.lit("+"))),
    )
    return rows.select(F.concat_ws("\n", head, body, F.lit("END IONS\n")).alias("value"))
