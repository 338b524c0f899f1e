"""Percentiles of very large numeric columns by merging centroid digests.

A digest is a list of centroids (mean, weight) of sorted values, clustered so that a cluster near
quantile q holds about q(1-q) of what one in the middle may hold (an arcsine size function). Digests
merge by sorting their centroids together and clustering again, so days, runs or partitions combine into
the whole. What a digest answers is then certified: a second pass counts the values below and at each
answer, which bounds its rank exactly.

Defined results: nulls, NaN and infinities are no values; a group without values has no row; zeros,
negative values and ties count as they are; of one value all percentiles are that value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabworks.session import materialise, written

#: Clusters of a digest; its rank error is about pi * sqrt(q(1-q)) / DELTA.
DELTA = 400
PERCENTS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
#: About so many digests of a group meet in one step; there are as many steps as that takes.
FAN = 32
_BUFFER, _GROUPS = 65536, 512
DIGEST_DDL = "means array<double>, weights array<double>, low double, high double"


def cluster(means: np.ndarray, weights: np.ndarray, delta: int = DELTA) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of the given ones, at most delta + 1."""
    order = np.argsort(means, kind="stable")
    means, weights = means[order], weights[order]
    total = weights.sum()
    middle = (np.cumsum(weights) - weights / 2) / total
    bucket = np.floor(delta * (np.arcsin(np.clip(2 * middle - 1, -1, 1)) / np.pi + 0.5)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    w = np.add.reduceat(weights, first)
    return np.add.reduceat(means * weights, first) / w, w


def quantiles(means: np.ndarray, weights: np.ndarray, low: float, high: float, qs: list[float]) -> np.ndarray:
    """Values at the quantiles, by interpolation between the centroids' middles and the extremes."""
    total = weights.sum()
    middle = np.cumsum(weights) - weights / 2
    at = np.concatenate([[0.0], middle, [total]])
    return np.interp(np.array(qs) * total, at, np.concatenate([[low], means, [high]]))


def build(values: DataFrame, keys: list[str], delta: int = DELTA) -> DataFrame:
    """Digests of each partition's values: keys, part, means, weights, low, high; value is the column digested.

    A partition keeps one buffer per group and gives its digests away when it holds many groups, so its
    memory has a bound whatever the number of groups. part is a number of a digest's own, by which those of
    a group are spread when they meet.
    """
    plain = values.select(*keys, F.col("value").cast("double").alias("value")).where("value is not null and not isnan(value) and abs(value) <> double('infinity')")
    names = [*keys, "part", "means", "weights", "low", "high"]
    fields = plain.schema
    schema = ", ".join(f"{k} {fields[k].dataType.simpleString()}" for k in keys) + ", part bigint, " + DIGEST_DDL

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 24
        raw: dict[tuple, list[np.ndarray]] = {}
        size: dict[tuple, int] = {}
        done: dict[tuple, list] = {}

        def squeeze(g: tuple) -> None:
            v = np.sort(np.concatenate(raw.pop(g)))
            m, w, lo, hi = done.get(g, (np.zeros(0), np.zeros(0), np.inf, -np.inf))
            done[g] = [*cluster(np.concatenate([m, v]), np.concatenate([w, np.ones(len(v))]), delta), min(lo, v[0]), max(hi, v[-1])]
            size[g] = 0

        def flush() -> pd.DataFrame:
            nonlocal part
            for g in list(raw):
                squeeze(g)
            part += 1
            rows = [(*g, part, m.tolist(), w.tolist(), float(lo), float(hi)) for g, (m, w, lo, hi) in done.items()]
            done.clear()
            size.clear()
            return pd.DataFrame(rows, columns=names)

        for pdf in batches:
            for g, v in pdf.groupby(keys, dropna=False, sort=False)["value"]:
                g = tuple(None if x is None or x is pd.NaT or x != x else x for x in (g if isinstance(g, tuple) else (g,)))
                raw.setdefault(g, []).append(v.to_numpy(dtype=np.float64))
                size[g] = size.get(g, 0) + len(v)
                if size[g] >= _BUFFER:
                    squeeze(g)
            if len(size) > _GROUPS:
                yield flush()
        if size or done:
            yield flush()

    return plain.mapInPandas(digest, schema)


def merge(digests: DataFrame, keys: list[str], delta: int = DELTA, fan: int = FAN) -> DataFrame:
    """One digest per group of keys, by clustering again, in as many steps as the largest group needs.

    In each step about `fan` digests of a group meet, chosen by the hash of their ``part``, so a hot group's
    digests are merged by many tasks and no task's work grows with their number. Digests without ``part``
    are of finer groups, whose other keys take its place.
    """
    kinds = {f.name: f.dataType.simpleString() for f in digests.schema}
    own = [c for c in digests.columns if c not in [*keys, "means", "weights", "low", "high"]]
    digests = written(digests.withColumn("part", F.xxhash64(*own)).select(*keys, "part", "means", "weights", "low", "high"))

    def once(df: DataFrame, by: list[str]) -> DataFrame:
        names = [*by, "means", "weights", "low", "high"]
        schema = ", ".join(f"{k} {kinds.get(k, 'bigint')}" for k in by) + ", " + DIGEST_DDL

        def join(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            m, w = cluster(np.concatenate(pdf["means"].to_list()), np.concatenate(pdf["weights"].to_list()), delta)
            return pd.DataFrame([(*group, m.tolist(), w.tolist(), pdf["low"].min(), pdf["high"].max())], columns=names)

        # few bytes but much work a row: a number of partitions of their own, which isn't merged again by size
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return df.select(*names).repartition(parts, *by).groupBy(*by).applyInPandas(join, schema)

    most = digests.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    while most > fan:
        most = -(-most // fan)
        digests = once(digests.withColumn("part", F.pmod("part", F.lit(most))), [*keys, "part"]).withColumn("part", F.xxhash64("part"))
    return once(digests, keys)


def answers(digests: DataFrame, keys: list[str], qs: list[float] = PERCENTS) -> DataFrame:
    """keys, n, low, high and ``at``: the digests' extremes, which are exact, and values at the quantiles, in their order."""
    kinds = {f.name: f.dataType.simpleString() for f in digests.schema}

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = pdf[[*keys, "low", "high"]].copy()
            got["n"] = [int(round(sum(w))) for w in pdf["weights"]]
            got["at"] = [quantiles(np.array(m), np.array(w), lo, hi, qs).tolist() for m, w, lo, hi in zip(pdf["means"], pdf["weights"], pdf["low"], pdf["high"])]
            yield got

    return digests.mapInPandas(ask, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", low double, high double, n bigint, at array<double>")


def certify(values: DataFrame, told: DataFrame, keys: list[str], qs: list[float] = PERCENTS, broadcast_rows: int = 50_000) -> DataFrame:
    """keys, quantile, value, n, low, high, rank_low, rank_high, rank_error of every answer, by counting.

    rank_low and rank_high: the shares of values below, and not above, the answer. rank_error: how far
    the quantile lies outside of them, 0 if between.
    """
    told = materialise(told)
    few = told.count() <= broadcast_rows
    on = [F.col(f"v.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    side = F.broadcast(told.alias("t")) if few else told.alias("t")
    plain = values.where("value is not null and not isnan(value) and abs(value) <> double('infinity')").select(*keys, F.col("value").cast("double").alias("value"))
    both = plain.alias("v").join(side, on).select(*[f"v.{k}" for k in keys], "v.value", "t.at", "t.low", "t.high")
    counts = both.groupBy(*keys).agg(
        F.first("at").alias("at"), F.first("low").alias("low"), F.first("high").alias("high"), F.count("*").alias("n"),
        F.array(*[F.count_if(F.col("value") < F.col("at")[i]) for i in range(len(qs))]).alias("below"),
        F.array(*[F.count_if(F.col("value") <= F.col("at")[i]) for i in range(len(qs))]).alias("upto"),
    )
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, qs)).alias("quantile"), F.col("at").alias("value"), F.col("below").alias("below"), F.col("upto").alias("upto")))
    rows = counts.select(*keys, "n", "low", "high", each.alias("e")).select(*keys, F.col("e.quantile").alias("quantile"), F.col("e.value").alias("value"), "n", "low", "high", (F.col("e.below") / F.col("n")).alias("rank_low"), (F.col("e.upto") / F.col("n")).alias("rank_high"))
    return rows.withColumn("rank_error", F.greatest(F.lit(0.0), F.col("rank_low") - F.col("quantile"), F.col("quantile") - F.col("rank_high")))


def stated_error(n: str = "n", quantile: str = "quantile", delta: int = DELTA):
    """The rank error promised for an answer: two clusters of the size function there, or two values of few."""
    q = F.col(quantile)
    return F.greatest(F.lit(2 * np.pi / delta) * F.sqrt(q * (1 - q)) + F.lit(2.5 * np.pi**2 / delta**2), F.lit(2.0) / F.col(n))


def run_values(spectrum: DataFrame, selected_ion: DataFrame) -> DataFrame:
    """(field_name, ms_level, day, value) of ion intensities and total ion currents, of each record once, written once.

    An ion has the MS level of the spectrum it names, null if there is none; ions that name none meet no
    spectra, so they can't gather in one task. A record's row is its latest; a null loaded_at is the earliest,
    and the day is null where all of a record's are. Digests and counts both read what is written here.
    """
    spectra = spectrum.groupBy("spectrum_key").agg(
        F.min("loaded_at").alias("loaded_at"), F.max_by(F.struct("run_id", "spectrum_index", "ms_level", "total_ion_current"), F.struct("loaded_at")).alias("s")
    )
    tic = spectra.select(F.lit("total_ion_current").alias("field_name"), F.col("s.ms_level").cast("int").alias("ms_level"), F.to_date("loaded_at").alias("day"), F.col("s.total_ion_current").cast("double").alias("value"))
    ions = selected_ion.groupBy("ion_id").agg(F.min("loaded_at").alias("loaded_at"), F.max_by(F.struct("run_id", "spectrum_index", "intensity"), F.struct("loaded_at")).alias("i")).select("loaded_at", "i.*")
    levels = spectrum.where("run_id is not null and spectrum_index is not null").groupBy("run_id", "spectrum_index").agg(F.max("ms_level").cast("int").alias("ms_level"))
    names_one = F.col("run_id").isNotNull() & F.col("spectrum_index").isNotNull()
    with_level = ions.where(names_one).join(levels, ["run_id", "spectrum_index"], "left").select("loaded_at", "intensity", "ms_level")
    without = ions.where(~names_one).select("loaded_at", "intensity", F.lit(None).cast("int").alias("ms_level"))
    intensity = with_level.unionByName(without).select(F.lit("intensity").alias("field_name"), "ms_level", F.to_date("loaded_at").alias("day"), F.col("intensity").cast("double").alias("value"))
    return written(tic.unionByName(intensity).where("value is not null and not isnan(value) and abs(value) <> double('infinity')"))


DAY_KEYS, WHOLE_KEYS = ["field_name", "ms_level", "day"], ["field_name", "ms_level"]


def daily_digests(values: DataFrame) -> DataFrame:
    return merge(build(values, DAY_KEYS), DAY_KEYS)


def percentiles(values: DataFrame, digests: DataFrame, keys: list[str]) -> DataFrame:
    """Certified percentiles per keys from digests of those or finer groups."""
    own = [c for c in digests.columns if c in DAY_KEYS]
    merged = digests if own == keys else merge(digests, keys)
    return certify(values, answers(merged, keys), keys)
