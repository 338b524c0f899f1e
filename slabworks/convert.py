"""spark-submit entry: tables of spectra and points as an archive, with what it took as a line of CSV."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession

from slabworks.functions.cv import chunk_option
from slabworks.operators import chunks
from slabworks.sources.archive import pack_zip, write_run

ENCODINGS = {"basic": chunks.PLAIN, "delta": chunks.DELTA, "numpress": chunks.NUMPRESS_LINEAR}


def _size(spark: SparkSession, path: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def convert(spark: SparkSession, meta: str, points: str, out: str, layout: str = "chunk", option: str = "delta:50", peaks: str | None = None, packed: str | None = None) -> tuple[str, int, int, float, str]:
    """(name, bytes before, bytes after, seconds, status); packed: a path for the same archive as one file."""
    began, status = time.perf_counter(), "ok"
    method, width = chunk_option(option)
    read = lambda path: spark.read.parquet(path)
    try:
        peak_rows: DataFrame | None = read(peaks) if peaks else None
        write_run(out, read(meta), read(points), layout, width, ENCODINGS[method], peaks=peak_rows)
        if packed:
            pack_zip(out, packed)
    except Exception as x:  # noqa: BLE001 - a run of many conversions goes on
        status = f"{type(x).__name__}: {str(x).splitlines()[0][:200]}"
    done = _size(spark, out) if status == "ok" else 0
    return points, sum(_size(spark, p) for p in (meta, points, *([peaks] if peaks else []))), done, round(time.perf_counter() - began, 3), status


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("meta", help="Parquet of spectra: index, id, time, ms_level, maybe is_profile")
    p.add_argument("points", help="Parquet of points: index, pos, mz, intensity")
    p.add_argument("out")
    p.add_argument("--layout", choices=["chunk", "point"], default="chunk")
    p.add_argument("--chunk", default="delta:50", help="method:width")
    p.add_argument("--peaks", help="Parquet of peaks: index, mz, intensity")
    p.add_argument("--packed", help="also pack the archive into this file")
    a = p.parse_args(argv)
    print("filename,originalsize,finalsize,timetaken,status")
    print(*convert(SparkSession.builder.getOrCreate(), a.meta, a.points, a.out, a.layout, a.chunk, a.peaks, a.packed), sep=",")


if __name__ == "__main__":
    main()
