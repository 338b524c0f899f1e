"""Peak lists: kinds of peaks as columns, and columns of a caller's own.

A peak kind is a name and the typed columns its rows have beside the key. A table of another shape becomes
one by casting what it has; what it lacks is null. Extraction over peaks is extraction over points.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PeakKind:
    """columns: name -> type, in the order they are written; made: columns computed from others, by name."""

    name: str
    columns: dict[str, str]
    made: dict[str, Callable[[DataFrame], Column]] = field(default_factory=dict)


#: The mass of a proton, with which a charge and a neutral mass give an m/z.
PROTON = 1.00727646677


def _mz(df: DataFrame) -> Column:
    """m/z of a deconvoluted peak: as it is told, else from mass and charge."""
    told = F.col("mz") if "mz" in df.columns else F.lit(None).cast("double")
    return F.coalesce(told, F.try_divide(F.col("neutral_mass") + F.col("charge") * PROTON, F.abs("charge"))) if {"neutral_mass", "charge"} <= set(df.columns) else told


CENTROID = PeakKind("centroid", {"mz": "double", "intensity": "float"})
MOBILITY_CENTROID = PeakKind("mobility centroid", {"mz": "double", "ion_mobility": "double", "intensity": "float"})
DECONVOLUTED = PeakKind("deconvoluted", {"mz": "double", "intensity": "float", "charge": "int"}, {"mz": _mz})
MOBILITY_DECONVOLUTED = PeakKind("mobility deconvoluted", {"mz": "double", "ion_mobility": "double", "intensity": "float", "charge": "int"}, {"mz": _mz})
KINDS = {k.name: k for k in (CENTROID, MOBILITY_CENTROID, DECONVOLUTED, MOBILITY_DECONVOLUTED)}


def as_peaks(df: DataFrame, kind: PeakKind, key: str = "index") -> DataFrame:
    """The key and the kind's columns, typed, null where the table lacks them."""
    made = {name: f(df) for name, f in kind.made.items()}
    source = lambda c: made[c] if c in made else F.col(c) if c in df.columns else F.lit(None)
    return df.select(key, *[source(c).cast(t).alias(c) for c, t in kind.columns.items()])


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns in the types a writer asks for instead of their own; others stay."""
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items() if c in df.columns})


def observed_schema(points: DataFrame, key: str = "index", entities: int = 10) -> list[tuple[str, str]]:
    """(column, type) of the columns with any value among the first entities: what a writer prepares for.

    A sample is the feature here: a writer has to settle its columns before it has seen everything.
    """
    first = points.select(key).distinct().orderBy(key).limit(entities)
    some = points.join(F.broadcast(first), key, "left_semi").agg(*[F.count(c).alias(c) for c in points.columns]).first().asDict()
    return [(f.name, f.dataType.simpleString()) for f in points.schema.fields if some[f.name] or f.name == key]


Hook = Callable[[DataFrame], DataFrame]


def with_hooks(df: DataFrame, hooks: list[Hook]) -> DataFrame:
    """A table as a caller's hooks leave it: each takes the table and gives it back with columns of its own."""
    for hook in hooks:
        df = hook(df)
    return df
