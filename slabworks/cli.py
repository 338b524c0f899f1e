"""spark-submit entry: extract a slab of an archive's points, chunks or peaks to Parquet or CSV, or describe it."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slabworks.operators import chunks
from slabworks.operators.extract import extract_points
from slabworks.operators.facets import facet
from slabworks.sources.archive import Archive, open_archive


def _range(text: str) -> tuple[float | None, float | None]:
    lo, _, hi = text.partition("-")
    return (float(lo) if lo else None, float(hi) if hi else None)


def slab(archive: Archive, time, mz, im=None, ms_level=None, peaks: bool = False, fill: str | None = None) -> DataFrame:
    """A slab of an archive, whatever the layout of its signal; fill: drop or interpolate, by default as the layout has it."""
    packed = archive.member("spectra_metadata")
    meta = facet(packed, "spectrum") if "spectrum" in packed.columns else packed
    found = archive.signal(peaks)
    if found is None:
        raise SystemExit("the archive has no peaks" if peaks else "the archive has no signal")
    layout, rows = found
    model = meta.select("index", "mz_delta_model") if "mz_delta_model" in meta.columns else None
    if layout == "chunk":
        others = tuple(c for c in rows.columns if c not in ("index", "chunk_id", "chunk_encoding") and not c.startswith("mz_"))
        plain = tuple(dict.fromkeys(c.removesuffix(e) for c in others for e in [next((e for e in chunks.TRANSFORMED.values() if c.endswith(e)), "")]))
        coded = rows if "chunk_id" in rows.columns else rows.withColumn("chunk_id", F.col("mz_chunk_start"))
        how = None if fill == "drop" else chunks.NULL_INTERPOLATE
        lo, hi = mz or (None, None)
        return chunks.extract_from_chunks(coded, lo, hi, others=plain, meta=meta, time=time, ms_level=ms_level, im=im, fill=how, model=model, with_time=True)
    fill = fill if fill and "pos" in rows.columns else "drop"
    return extract_points(rows, meta, time, mz, im, ms_level, prune=True, with_time=True, fill=fill, model=model)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("archive", help="a directory or packed archive, by path or URI")
    p.add_argument("out", nargs="?", help="where the slab goes; without it the archive is described")
    p.add_argument("--shared", help="folder all executors can read, to which a packed archive is copied first")
    p.add_argument("--time-range", type=_range, default=(10.0, 21.0))
    p.add_argument("--mz-range", type=_range, default=(623.0, 625.0))
    p.add_argument("--im-range", type=_range)
    p.add_argument("--ms-level-range", type=_range)
    p.add_argument("--peaks", action="store_true")
    p.add_argument("--fill", choices=["drop", "interpolate"])
    p.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    a = p.parse_args(argv)
    archive = open_archive(SparkSession.builder.getOrCreate(), a.archive, a.shared)
    if a.out is None:
        archive.describe().show(1000, truncate=False)
        return
    rows = slab(archive, a.time_range, a.mz_range, a.im_range, a.ms_level_range, a.peaks, a.fill)
    rows.write.format(a.format).option("header", "true").mode("overwrite").save(a.out)


if __name__ == "__main__":
    main()
