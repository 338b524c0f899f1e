"""References to records that do not exist.

Rows of one key are one record: loaded at its earliest ``loaded_at``, deleted if any of its rows says so.
A reference is an orphan if its target is missing, deleted (whenever) or loaded later than the record
that refers. References are counted per field, key and period first, with the first and last time they
were loaded; from there on a key has a row per period, however often it is referred to. Keys that carry
more than their share of all references meet a broadcast table, whose size has a bound by construction;
the other keys meet the targets in a shuffled join, and what is left of both, the groups with orphans,
is united. Groups give the counts; single references are looked up only for groups with orphans.

Keys of any type go by two 64-bit hashes, 128 bits in all, so only numbers are aggregated and shuffled.

Defined results: null, blank and negative values are no references; a reference with a null scope has no
target; deleted records refer too; text keys are compared without case and outer blanks; of a record's
deliveries the latest tells its references; a null ``loaded_at`` is never later than another time;
repeated rows count once; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabworks.functions.params import BLANK
from slabworks.session import materialise

#: At most so many keys are heavy, whatever the data: a heavy key has more than 1/MAX_HEAVY of the rows.
MAX_HEAVY = 2000
#: So many groups at most are broadcast (some 60 bytes each).
FEW_GROUPS = 200_000


@dataclass(frozen=True)
class Reference:
    """A field of a table that points at a key of another one; key: (scope, value)."""

    table_name: str
    field_name: str
    row_id: str
    scope: Column
    value: Column
    target: str


def text_key(c: Column) -> Column:
    """Lower case without outer blanks; null if nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")), F.lit(""))


def index_key(c: Column) -> Column:
    return F.when(c >= 0, c.cast("bigint"))


def _hashes(target: str, scope: Column, key: Column) -> Column:
    """The two hashes of a key; null where the key is."""
    parts = [F.lit(target), F.coalesce(scope, F.lit("\0")), key]  # no target has a null scope
    return F.when(key.isNotNull(), F.struct(F.xxhash64(*parts).alias("k1"), F.xxhash64(*parts[::-1], F.lit(1)).alias("k2")))


def references_of(rows: DataFrame, refs: list[Reference], first: int = 0) -> DataFrame:
    """One row per record and reference field: (field, k1, k2, row_id, loaded_at, period); field is its number, from first on.

    All fields of a table come from one aggregate per record, so the table is shuffled once.
    """
    one = rows.groupBy(F.col(refs[0].row_id).alias("row_id")).agg(
        F.min("loaded_at").alias("loaded_at"), *[F.max(F.struct(F.col("loaded_at"), _hashes(r.target, r.scope, r.value).alias("k"))).alias(f"ref{i}") for i, r in enumerate(refs)]
    )
    each = F.array(*[F.struct(F.lit(first + i).alias("field"), F.col(f"ref{i}.k").alias("k")) for i in range(len(refs))])
    rows = one.select("row_id", "loaded_at", F.explode(each).alias("r")).where("r.k is not null")
    return rows.select("r.field", "r.k.k1", "r.k.k2", "row_id", "loaded_at", F.to_date("loaded_at").alias("period"))


def targets_of(rows: DataFrame, target: str, scope: Column, key: Column) -> DataFrame:
    """One row per record that can be pointed at: (k1, k2, t_loaded, t_deleted)."""
    known = rows.select(scope.alias("scope"), _hashes(target, scope, key).alias("k"), "loaded_at", "deleted_at").where("k is not null and scope is not null")
    return known.groupBy("k.k1", "k.k2").agg(F.min("loaded_at").alias("t_loaded"), F.count("deleted_at").alias("t_deleted"))


_KEY = ["k1", "k2"]
_GROUP = ["field", *_KEY, "period"]


def orphan_groups(refs: DataFrame, targets: DataFrame, rows: int, max_heavy: int = MAX_HEAVY) -> tuple[DataFrame, DataFrame]:
    """The groups of references (field, key, period) with orphans: n, reason, t_loaded, is_heavy; and the heavy keys.

    reason is null where only a part of a group may be orphans: its target was loaded between its first and
    its last reference. rows: an upper bound of the number of references (file footers tell it), from which a
    heavy key's share follows.
    """
    floor = max(1, rows // max_heavy)
    groups = refs.groupBy(*_GROUP).agg(F.count("*").alias("n"), F.min("loaded_at").alias("first"), F.max("loaded_at").alias("last"))
    heavy = groups.groupBy(*_KEY).agg(F.sum("n").alias("n")).where(F.col("n") > floor).select(*_KEY, F.lit(True).alias("is_heavy"))  # at most max_heavy keys
    marked = groups.join(F.broadcast(heavy), _KEY, "left")
    known = targets.withColumn("there", F.lit(True))
    hot = marked.where("is_heavy").join(F.broadcast(known.join(F.broadcast(heavy.select(*_KEY)), _KEY, "left_semi")), _KEY, "left")  # a heavy key that is missing has no row there
    cold = marked.where("is_heavy is null").join(known, _KEY, "left")
    fate = hot.unionByName(cold).where("there is null or t_deleted > 0 or t_loaded > first")
    reason = F.when(F.col("there").isNull(), "missing").when(F.col("t_deleted") > 0, "deleted").when(F.col("t_loaded") > F.col("last"), "later")
    return fate.select(*_GROUP, "n", reason.alias("reason"), "t_loaded", F.coalesce("is_heavy", F.lit(False)).alias("is_heavy")), heavy.select(*_KEY)


def orphans(refs: DataFrame, groups: DataFrame, heavy: DataFrame, few: int = FEW_GROUPS) -> DataFrame:
    """The references behind groups with orphans: (field, row_id, period, reason).

    If the groups are few the references stay where they are. Else those of heavy keys do, whose groups are
    few by construction (keys times periods), and only those of other keys meet their groups in a shuffled join.
    """
    found = materialise(groups.select(*[F.col(c).alias(f"g_{c}") for c in _GROUP], "reason", "t_loaded", "is_heavy"))
    on = F.lit(True)
    for c in _GROUP:
        on = on & (F.col(c).eqNullSafe(F.col(f"g_{c}")) if c == "period" else F.col(c) == F.col(f"g_{c}"))
    if found.count() <= few:
        both = refs.join(F.broadcast(found), on)
    else:
        cold = refs.join(F.broadcast(heavy), _KEY, "left_anti").join(found.where("not is_heavy"), on)
        both = refs.join(F.broadcast(found.where("is_heavy")), on).unionByName(cold)
    return both.where("reason is not null or t_loaded > loaded_at").select("field", "row_id", "period", F.coalesce("reason", F.lit("later")).alias("reason"))


def _run_fields() -> list[Reference]:
    run = F.col("run_id")
    return [
        Reference("selected_ion", "spectrum_index", "ion_id", run, index_key(F.col("spectrum_index")), "spectrum"),
        Reference("selected_ion", "precursor_index", "ion_id", run, index_key(F.col("precursor_index")), "spectrum"),
        Reference("spectrum", "data_procesing_ref", "spectrum_key", F.lit(""), text_key(F.col("data_procesing_ref")), "data_processing"),
    ]


def _named(rows: DataFrame, fields: list[Reference]) -> DataFrame:
    """table_name and field_name in place of the field's number."""
    told = lambda names: F.element_at(F.array(*map(F.lit, names)), F.col("field") + 1)
    return rows.select(told([r.table_name for r in fields]).alias("table_name"), told([r.field_name for r in fields]).alias("field_name"), *[c for c in rows.columns if c != "field"])


def _run_parts(spectrum: DataFrame, selected_ion: DataFrame, data_processing: DataFrame, max_heavy: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """References of a run archive's three fields, their groups with orphans, and the heavy keys."""
    fields = _run_fields()
    refs = references_of(selected_ion, fields[:2]).unionByName(references_of(spectrum, fields[2:], 2))
    targets = targets_of(spectrum, "spectrum", F.col("run_id"), index_key(F.col("spectrum_index"))).unionByName(
        targets_of(data_processing, "data_processing", F.lit(""), text_key(F.col("dp_id")))
    )
    return refs, *orphan_groups(refs, targets, 2 * selected_ion.count() + spectrum.count(), max_heavy)


def run_orphans(spectrum: DataFrame, selected_ion: DataFrame, data_processing: DataFrame, max_heavy: int = MAX_HEAVY, few: int = FEW_GROUPS) -> DataFrame:
    """The orphan references of a run archive's three reference fields: (table_name, field_name, row_id, period, reason)."""
    return _named(orphans(*_run_parts(spectrum, selected_ion, data_processing, max_heavy), few), _run_fields())


def run_orphan_counts(spectrum: DataFrame, selected_ion: DataFrame, data_processing: DataFrame, max_heavy: int = MAX_HEAVY) -> DataFrame:
    """Orphans per table, field, period and reason, from the groups; only groups that are orphans in part are looked into."""
    refs, groups, heavy = _run_parts(spectrum, selected_ion, data_processing, max_heavy)
    whole = groups.where("reason is not null").select("field", "period", "reason", "n")
    part = orphans(refs, groups.where("reason is null"), heavy).select("field", "period", "reason", F.lit(1).cast("bigint").alias("n"))
    counts = whole.unionByName(part).groupBy("field", "period", "reason").agg(F.sum("n").alias("n_orphans"))
    return _named(counts, _run_fields())
