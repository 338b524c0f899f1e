"""Schemas that drift between files.

Ingestion with a rescue column: each record is parsed once, the fields of the target schema are cast,
whatever is unknown or can't be cast is kept as JSON in ``_rescued``, and keys that were approved as
another spelling of a target field are replayed from there into its typed column. The same pass tells of
every key which field it went to and which JSON type it had (``_seen``); the report of changes aggregates
that per file and compares two consecutive files of a feed.

Defined results: lines that are no JSON object (damaged, null, empty) add nothing; of repeated deliveries
of a line the first that is well formed counts (a null ``loaded_at`` is the earliest); a field whose
values are all null is present and has no type; a feed's first file and a file whose predecessor wasn't
delivered have no changes; records of a kind without a target schema are rescued whole and reported by
their keys. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a caller who names no others gets. The target schema of each record kind.
TARGETS: dict[str, dict[str, str]] = {
    "selected_ion": {
        "spectrum_index": "bigint", "precursor_index": "bigint", "selected_ion_mz": "double", "charge_state": "int",
        "intensity": "double", "ion_mobility": "double", "parameters": "string",
    },
    "array_index_entry": {
        "context": "string", "path": "string", "data_type": "string", "array_type": "string", "array_name": "string", "unit": "string",
        "buffer_format": "string", "transform": "string", "data_processing_id": "string", "buffer_priority": "string", "sorting_rank": "int",
    },
    "file_entry": {"name": "string", "entity_type": "string", "data_kind": "string", "size_bytes": "bigint", "row_count": "bigint"},
}
#: Approved keys beside those that differ only in case, separators or CV inflection.
APPROVED: dict[str, dict[str, str]] = {
    "selected_ion": {
        "source_index": "spectrum_index", "spectrum_idx": "spectrum_index", "precursor_idx": "precursor_index", "mz": "selected_ion_mz", "ion_mz": "selected_ion_mz",
        "charge": "charge_state", "ion_intensity": "intensity", "peak_intensity": "intensity", "ion_mobility_value": "ion_mobility", "mobility": "ion_mobility", "params": "parameters",
    },
    "array_index_entry": {
        "name": "array_name", "unit_curie": "unit", "format": "buffer_format", "buffer_layout": "buffer_format", "layout": "buffer_format",
        "data_processing_ref": "data_processing_id", "priority": "buffer_priority", "sort_rank": "sorting_rank", "rank": "sorting_rank",
    },
    "file_entry": {"file_name": "name", "entity": "entity_type", "kind": "data_kind", "size": "size_bytes", "rows": "row_count", "n_rows": "row_count"},
}


def key_form(c: Column) -> Column:
    """A key without CV inflection, case and separators: what spellings of one field share."""
    bare = F.regexp_replace(F.regexp_replace(c, r"^[A-Z]+_\d+_", ""), r"_unit(_[A-Z]+_\d+)?$", "")
    return F.lower(F.regexp_replace(bare, r"[^A-Za-z0-9]+", ""))


def approved_forms(target: dict[str, str], approved: dict[str, str]) -> dict[str, str]:
    """Key form -> target field: the fields themselves and the approved other spellings."""
    return {alias.replace("_", ""): field for alias, field in approved.items() if field in target} | {f.replace("_", ""): f for f in target}


def _field_of(forms: dict[str, str], key: Column) -> Column:
    """The target field a key stands for, else the key itself."""
    if not forms:
        return key
    text = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    table = F.expr("map(" + ", ".join(f"{text(form)}, {text(field)}" for form, field in forms.items()) + ")")
    return F.coalesce(F.try_element_at(table, key_form(key)), key)


def json_type(s: Column) -> Column:
    """integer, fraction, string, boolean, array or object from a variant's schema; null for JSON null."""
    return (
        F.when(s == "BIGINT", "integer")
        .when(s == "STRING", "string")
        .when(s.startswith("DECIMAL"), F.when(s.endswith(",0)") & s.rlike(r"^DECIMAL\((19|[23]\d),0\)$"), "integer").otherwise("fraction"))  # an integer longer than a bigint
        .when(s.isin("DOUBLE", "FLOAT"), "fraction")
        .when(s == "BOOLEAN", "boolean")
        .when(s.startswith("ARRAY"), "array")
        .when(s.startswith("OBJECT"), "object")
    )


def parsed(lines: DataFrame) -> DataFrame:
    """Lines with ``members``: a map from key to variant, null where a line is no well-formed record.

    They aren't filtered here: a filter on members would be pushed to the scan and parse each line again.
    """
    return lines.withColumn("members", F.try_variant_get(F.try_parse_json("raw_json"), "$", "map<string,variant>"))


PLACE = ["feed_id", "file_seq", "file_id", "line_no"]


def ingest_records(lines: DataFrame, target: dict[str, str], approved: dict[str, str], replay: bool = True) -> DataFrame:
    """Every line with its place, typed target fields, ``_rescued`` and ``_seen``; deliveries aren't merged.

    _seen: an array of (key, schema) of all the record's keys, null where a line is no well-formed record.
    replay=False leaves approved spellings in ``_rescued`` too, as a first delivery finds them.
    """
    forms = approved_forms(target, approved)
    rows = parsed(lines)
    keep = [c for c in ("record_kind", *PLACE, "loaded_at") if c in lines.columns]

    def cast(value: Column, to: str) -> Column:
        if to == "string":
            return F.when(~F.is_variant_null(value), F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value)))
        number = F.coalesce(F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string").try_cast("double"))
        exact = F.coalesce(F.try_variant_get(value, "$", to), F.try_variant_get(value, "$", "string").try_cast(to))
        return exact if to == "double" else F.when(number.isNull() | (number == F.floor(number)), F.coalesce(exact, number.try_cast(to)))

    seen = F.transform(F.map_entries("members"), lambda e: F.struct(e["key"].alias("key"), F.schema_of_variant(e["value"]).alias("schema")))
    typed = rows.select(*keep, "members", seen.alias("_seen"), *[cast(F.try_element_at("members", F.lit(f)), t).alias(f"t_{f}") for f, t in target.items()])
    unmet = lambda k, prefix: F.coalesce(*[F.when(k == f, F.col(f"{prefix}_{f}").isNull()) for f in target], F.lit(False))
    known = lambda k: k.isin(list(target)) if target else F.lit(False)
    rescued = typed.withColumn("unmatched", F.map_filter("members", lambda k, x: ~known(k) | (~F.is_variant_null(x) & unmet(k, "t"))))
    if not replay:
        return rescued.select(*keep, *[F.col(f"t_{f}").alias(f) for f in target], F.to_json("unmatched").alias("_rescued"), "_seen")
    again = F.transform(F.map_entries("unmatched"), lambda e: F.struct(_field_of(forms, e["key"]).alias("field"), e["key"].alias("key"), e["value"].alias("value")))
    entries = rescued.withColumn("again", again)

    def of_field(field: str, to: str) -> Column:
        return F.transform(F.filter("again", lambda e: e["field"] == field), lambda e: cast(e["value"], to))

    values = {f: of_field(f, t) for f, t in target.items()}
    replayed = entries.select("*", *[F.coalesce(f"t_{f}", F.try_element_at(F.array_compact(values[f]), F.lit(1))).alias(f"r_{f}") for f in target])
    # what no target field could take stays: unknown keys, and values of a field that stayed empty
    left = F.filter("again", lambda e: ~known(e["field"]) | (~F.is_variant_null(e["value"]) & unmet(e["field"], "r")))
    rest = F.map_from_entries(F.transform(left, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    return replayed.select(*keep, *[F.col(f"r_{f}").alias(f) for f in target], F.when(F.size(left) > 0, F.to_json(rest)).alias("_rescued"), "_seen")


def ingest(lines: DataFrame, kind: str, target: dict[str, str] | None = None, approved: dict[str, str] | None = None, replay: bool = True) -> DataFrame:
    """One consistent table of a record kind: place, loaded_at, typed target fields and ``_rescued``; each line once.

    Lines are typed where they are read, so deliveries are merged on typed columns and not on texts.
    """
    target = TARGETS.get(kind, {}) if target is None else target
    approved = APPROVED.get(kind, {}) if approved is None else approved
    rows = ingest_records(lines.where(F.col("record_kind") == kind), target, approved, replay).where("_seen is not null").drop("record_kind", "_seen")
    first = F.min(F.struct("loaded_at", *[c for c in rows.columns if c not in ("file_id", "line_no", "loaded_at")])).alias("r")
    return rows.groupBy("file_id", "line_no").agg(first).select(*[f"r.{c}" if c not in ("file_id", "line_no") else c for c in rows.columns])


def observed_fields(lines: DataFrame, targets: dict[str, dict[str, str]] | None = None, approved: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """(record_kind, feed_id, file_seq, file_id, field_name, keys, types) of every file, from what ingestion saw.

    Keys and schemas are pre-aggregated per file before the shuffle, so a feed or file with a third of all
    lines leaves as many rows as it has keys, and no text is shuffled: lines delivered twice add nothing new.
    What field a key is of and what type its schema is are read once per file and not on every line.
    """
    targets, approved = targets or TARGETS, approved or APPROVED
    file = ["record_kind", "feed_id", "file_seq", "file_id"]
    kinds = [(lines.where(F.col("record_kind") == kind), target, approved.get(kind, {})) for kind, target in targets.items()]
    kinds.append((lines.where(~F.col("record_kind").isin(list(targets))), {}, {}))
    seen = None
    for some, target, other in kinds:
        keys = ingest_records(some, target, other, replay=False).select(*file, F.explode_outer("_seen").alias("s")).select(*file, "s.key", "s.schema").where("key is not null").distinct()
        one = keys.select(*file, _field_of(approved_forms(target, other), F.col("key")).alias("field_name"), "key", json_type(F.col("schema")).alias("json_type"))
        seen = one if seen is None else seen.unionByName(one)
    return seen.groupBy(*file, "field_name").agg(F.array_sort(F.collect_set("key")).alias("keys"), F.array_sort(F.collect_set("json_type")).alias("types"))


def schema_changes(lines: DataFrame, targets: dict[str, dict[str, str]] | None = None, approved: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """(record_kind, feed_id, file_seq, file_id, field_name, change_kind, before, after) against the file before."""
    seen = observed_fields(lines, targets, approved)
    place = ["record_kind", "feed_id", "file_seq"]
    files = lines.select(*place, "file_id").distinct()
    before = seen.select("record_kind", "feed_id", (F.col("file_seq") + 1).alias("file_seq"), "field_name", F.col("keys").alias("keys0"), F.col("types").alias("types0"))
    has_previous = files.join(files.select("record_kind", "feed_id", (F.col("file_seq") + 1).alias("file_seq")).distinct(), place, "left_semi")
    both = seen.drop("file_id").join(before, [*place, "field_name"], "full").join(has_previous, place)
    told = lambda c: F.concat_ws(",", c)
    change = lambda kind, when, a, b: F.when(when, F.struct(F.lit(kind).alias("change_kind"), told(a).alias("before"), told(b).alias("after")))
    k0, k1, t0, t1 = (F.col(x) for x in ("keys0", "keys", "types0", "types"))
    changes = F.array_compact(F.array(
        change("added", k0.isNull(), k0, k1),
        change("removed", k1.isNull(), k0, k1),
        change("renamed", k0 != k1, k0, k1),
        change("retyped", (F.size(t0) > 0) & (F.size(t1) > 0) & (t0 != t1), t0, t1),
    ))
    return both.select(*place, "file_id", "field_name", F.explode(changes).alias("c")).select(*place, "file_id", "field_name", "c.*")
