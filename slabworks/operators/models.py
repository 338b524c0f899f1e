"""Spacing models of a coordinate: a constant step or a quadratic one.

A model is a list of coefficients: one is a constant step, three are a quadratic. Any expression of
(coefficients, coordinate) can stand in for ``predict`` where nulls are filled, so further kinds of models
need no change here.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps above this are gaps and take no part in a fit; a fit needs so many steps; a constant holds if its error is less than this share of the other's.
WIDEST_STEP, FEWEST_STEPS, CONSTANT_SHARE = 1.0, 3, 0.1


def median(values: np.ndarray, mode: str = "middle") -> float:
    """Of sorted values. mode "middle" is the usual median; "upper" takes the first of up to two values, and
    of an even number the mean of the two behind the middle, as some writers do. Nothing has no median (NaN)."""
    n = len(values)
    if not n:
        return float("nan")
    if mode == "middle":
        return float(np.median(values))
    if n <= 2:
        return float(values[0])
    return float(values[n // 2] if n % 2 else (values[n // 2] + values[n // 2 + 1]) / 2)


def _median_of(sorted_values: Column, mode: str) -> Column:
    """The same of a sorted array column."""
    n = F.size(sorted_values)
    at = lambda i: F.try_element_at(sorted_values, i.cast("int"))
    half = F.floor(n / 2)
    if mode == "middle":
        return F.when(n % 2 == 1, at(half + 1)).otherwise((at(half) + at(half + 1)) / 2)
    return F.when(n <= 2, at(F.lit(1))).when(n % 2 == 1, at(half + 1)).otherwise((at(half + 1) + at(half + 2)) / 2)


def second_median(df: DataFrame, by: list[str], delta: str, mode: str = "middle") -> DataFrame:
    """Per group: the median, and the median of the values up to it. Groups are of an entity's size in mode "upper"."""
    some = df.where(F.col(delta).isNotNull())
    if mode != "middle":
        lists = some.groupBy(*by).agg(F.array_sort(F.collect_list(delta)).alias("_d")).withColumn("median", _median_of(F.col("_d"), mode))
        return lists.withColumn("_low", F.filter("_d", lambda d: d <= F.col("median"))).select(*by, "median", _median_of(F.col("_low"), mode).alias("second_median"))
    first = some.groupBy(*by).agg(F.percentile(delta, 0.5).alias("median"))
    low = df.join(first, by).where(F.col(delta) <= F.col("median"))
    return low.groupBy(*by).agg(F.first("median").alias("median"), F.percentile(delta, 0.5).alias("second_median"))


def regression_weight(intensity: Column) -> Column:
    """Weight of a step by the intensity at its end."""
    return F.log1p(intensity)


def predict(coefficients: Column, x: Column) -> Column:
    """The step at x: one coefficient is a constant, three are a quadratic."""
    return F.when(F.size(coefficients) == 1, coefficients[0]).when(F.size(coefficients) == 3, coefficients[0] + coefficients[1] * x + coefficients[2] * x * x)


def power_sums(df: DataFrame, by: list[str], x: Column, y: Column, w: Column) -> DataFrame:
    """What a quadratic fit needs of each group, whatever its size: n, the middle and scale of x, and eight weighted
    power sums of the centred and scaled x. Two partial aggregates, as sums of raw fourth powers lose all digits."""
    cols = df.select(*by, x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w")).where("x is not null and y is not null and w is not null")
    place = cols.groupBy(*by).agg(F.avg("x").alias("mid"), F.greatest(F.stddev_pop("x"), F.lit(1e-12)).alias("scale")).select(*[F.col(b).alias(f"_{b}") for b in by], "mid", "scale")
    on = F.lit(True)
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_{b}"))
    near = cols.join(place, on).withColumn("z", (F.col("x") - F.col("mid")) / F.col("scale"))
    sums = {f"s{k}": F.sum(F.col("w") * F.pow("z", F.lit(k))) for k in range(5)} | {f"t{k}": F.sum(F.col("w") * F.col("y") * F.pow("z", F.lit(k))) for k in range(3)}
    return near.groupBy(*by).agg(F.count("*").alias("n"), F.first("mid").alias("mid"), F.first("scale").alias("scale"), *[e.alias(k) for k, e in sums.items()])


def solve_quadratic(sums: DataFrame) -> DataFrame:
    """b0, b1, b2 of the raw x by Cramer's rule; null where the points can't tell them."""
    s0, s1, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))
    det = lambda a, b, c, d, e, f, g, h, i: a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    d = det(s0, s1, s2, s1, s2, s3, s2, s3, s4)
    safe = F.when(F.abs(d) > 1e-10 * s0 * s0 * s0, d)
    near = sums.select("*", (det(t0, s1, s2, t1, s2, s3, t2, s3, s4) / safe).alias("_c0"), (det(s0, t0, s2, s1, t1, s3, s2, t2, s4) / safe).alias("_c1"), (det(s0, s1, t0, s1, s2, t1, s2, s3, t2) / safe).alias("_c2"))
    m, k = F.col("mid"), F.col("scale")
    b2 = F.col("_c2") / (k * k)
    b1 = F.col("_c1") / k - 2 * m * b2
    return near.select("*", (F.col("_c0") - F.col("_c1") * m / k + b2 * m * m).alias("b0"), b1.alias("b1"), b2.alias("b2")).drop("_c0", "_c1", "_c2")


def model_errors(df: DataFrame, by: list[str], x: Column, y: Column, constant: DataFrame, quadratic: DataFrame) -> DataFrame:
    """Per group: e_const and e_reg, the squared errors of both models summed, and mse, the latter's mean.

    constant has (by, c), quadratic (by, beta). Groups without a quadratic model have null for it.
    """
    rows = df.select(*by, x.alias("_x"), y.alias("_y")).join(constant.select(*by, "c"), by).join(quadratic.select(*by, "beta"), by, "left")
    off = F.pow(predict(F.col("beta"), F.col("_x")) - F.col("_y"), 2)
    return rows.groupBy(*by).agg(F.sum(F.pow(F.col("c") - F.col("_y"), 2)).alias("e_const"), F.sum(off).alias("e_reg"), F.avg(off).alias("mse"))


def selected_model(e_const: Column, e_reg: Column) -> Column:
    """The constant only if its error is less than a tenth of the other's, or if there is no other."""
    return F.when(e_reg.isNull() | (e_const < e_reg * CONSTANT_SHARE), "constant").otherwise("quadratic")


def model_coefficients(meta: DataFrame, key: str) -> DataFrame:
    """(key, place, coefficient, n) of the spacing models that a table stores, each entity once."""
    s = meta.where("mz_delta_model is not null").select(key, "mz_delta_model").distinct()
    return s.select(key, F.posexplode("mz_delta_model").alias("place", "coefficient"), F.size("mz_delta_model").alias("n"))


def fit_spacing(x: np.ndarray, intensity: np.ndarray, median_mode: str = "middle") -> np.ndarray:
    """The spacing model of one ascending coordinate: [step] or [b0, b1, b2].

    The quadratic takes each step that is no gap at the coordinate it leads to, weighted by ln(intensity + 1)
    there, and is fitted by QR on centred and scaled coordinates. For the choice the errors of both models
    are summed over all steps, gaps too, at the coordinates they lead from.
    """
    x = np.asarray(x, dtype=float)
    d = np.diff(x)
    if not len(d):
        return np.array([])
    ranked = np.sort(d)
    constant = np.array([median(ranked[ranked <= median(ranked, median_mode)], median_mode)])
    ok = d <= WIDEST_STEP
    if ok.sum() < FEWEST_STEPS:
        return constant
    at, step, w = x[1:][ok], d[ok], np.sqrt(np.log1p(np.asarray(intensity, dtype=float)[1:][ok]))
    mid, scale = at.mean(), max(at.std(), 1e-12)
    z = (at - mid) / scale
    q, r = np.linalg.qr(np.stack([np.ones_like(z), z, z * z], axis=1) * w[:, None])
    if np.abs(np.diag(r)).min() < 1e-12:
        return constant
    c = np.linalg.solve(r, q.T @ (w * step))
    at_start = (x[:-1] - mid) / scale
    e_reg = float(((c[0] + c[1] * at_start + c[2] * at_start**2 - d) ** 2).sum())
    if float(((constant[0] - d) ** 2).sum()) < e_reg * CONSTANT_SHARE:
        return constant
    b2 = c[2] / scale**2
    return np.array([c[0] - c[1] * mid / scale + b2 * mid**2, c[1] / scale - 2 * mid * b2, b2])


def spacing_models(points: DataFrame, key: str = "index", median_mode: str = "middle") -> DataFrame:
    """(key, mz_delta_model) of every entity; an entity's points fit one task, as they do in a reader."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.dropna(subset=["mz", "intensity"]).sort_values("mz")
        return pd.DataFrame({key: [pdf[key].iloc[0]], "mz_delta_model": [fit_spacing(p["mz"].to_numpy(), p["intensity"].to_numpy(), median_mode).tolist()]})

    kind = points.schema[key].dataType.simpleString()
    return points.select(key, F.col("mz").cast("double"), F.col("intensity").cast("double")).groupBy(key).applyInPandas(one, f"{key} {kind}, mz_delta_model array<double>")
