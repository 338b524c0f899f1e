"""Packed parallel tables, their facets and the joins that put entities together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slabworks.session import materialise

#: The key column of each facet, with the names older files use.
FACET_KEYS = {"spectrum": ["index"], "scan": ["source_index", "spectrum_index"], "precursor": ["source_index", "spectrum_index"], "selected_ion": ["source_index", "spectrum_index"], "chromatogram": ["index"]}


def facet(packed: DataFrame, name: str) -> DataFrame:
    """One facet of a packed table as a table of its own: the rows where its key is filled."""
    key = next(k for k in FACET_KEYS[name] if k in packed.schema[name].dataType.names)
    return packed.where(F.col(f"{name}.{key}").isNotNull()).select(f"{name}.*").withColumnRenamed("spectrum_index", "source_index")


def any_facet(packed: DataFrame) -> DataFrame:
    """Rows in which some facet's key is filled."""
    keys = [F.col(f"{f}.{k}").isNotNull() for f, ks in FACET_KEYS.items() if f in packed.columns for k in ks if k in packed.schema[f].dataType.names]
    test = keys[0]
    for k in keys[1:]:
        test = test | k
    return packed.where(test)


def any_facet_equals(packed: DataFrame, index: int) -> DataFrame:
    """Rows in which some facet belongs to an entity: the predicate of a single lookup, pushed to the scan."""
    keys = [F.col(f"{f}.{k}") == index for f, ks in FACET_KEYS.items() if f in packed.columns for k in ks if k in packed.schema[f].dataType.names]
    test = F.lit(False)
    for k in keys:
        test = test | k
    return packed.where(test)


def entity(packed: DataFrame, index: int) -> dict[str, DataFrame]:
    """Everything of one entity: its row of each facet, as tables of their own."""
    near = any_facet_equals(packed, index)
    out = {}
    for name in FACET_KEYS:
        if name in packed.columns:
            own = facet(near, name)
            out[name] = own.where(F.col("index" if "index" in own.columns and FACET_KEYS[name] == ["index"] else "source_index") == index)
    return out


def pack(facets: dict[str, DataFrame]) -> DataFrame:
    """A packed table: row i of each facet side by side, whatever it belongs to; facets are numbered by their key."""
    out = None
    for name, df in facets.items():
        key = next(k for k in FACET_KEYS[name] if k in df.columns)
        numbered = dense_index(df.withColumn("_key", F.col(key)), ["_key"], "_row").select("_row", F.struct(*df.columns).alias(name))
        out = numbered if out is None else out.join(numbered, "_row", "full")
    return out.drop("_row")


def assemble(meta: DataFrame, children: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Each entity with its child rows as an ordered list, empty if it has none. children have source_index."""
    cols = [c for c in children.columns if c != "source_index"]
    lists = children.groupBy(F.col("source_index").alias("index")).agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in cols if c not in order]))).alias(name))
    return meta.join(lists, "index", "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(lists.schema[name].dataType)))


def precursors_with_ions(precursor: DataFrame, ion: DataFrame, fallback: bool = True) -> DataFrame:
    """Ions with their precursor by (source_index, precursor_index), nulls equal.

    fallback: an ion without such a precursor takes the last one of its source, a null key counting as
    the first. Columns of the precursor come as the struct ``precursor``.
    """
    p = precursor.select("source_index", "precursor_index", F.struct(*precursor.columns).alias("precursor"))
    on = (F.col("i.source_index") == F.col("p.source_index")) & F.col("i.precursor_index").eqNullSafe(F.col("p.precursor_index"))
    exact = ion.alias("i").join(p.alias("p"), on, "left").select("i.*", "p.precursor")
    if not fallback:
        return exact.where("precursor is not null")
    last = precursor.groupBy("source_index").agg(F.max_by(F.struct(*precursor.columns), F.coalesce("precursor_index", F.lit(-1))).alias("last_precursor"))
    return exact.join(last, "source_index", "left").withColumn("precursor", F.coalesce("precursor", "last_precursor")).drop("last_precursor")


def resolve_precursors(precursor: DataFrame, meta: DataFrame, run: tuple[str, ...] = ()) -> DataFrame:
    """precursor_index from precursor_id: the last spectrum of that id up to the source itself, null if there is none.

    run: columns both tables have within which ids hold. Spectra and references of an id are put into one
    order, in which each reference takes the last spectrum before it: no pairs are built.
    """
    rest = [c for c in precursor.columns if c not in ("precursor_index", "precursor_id", "source_index", *run)]
    none = F.lit(None).cast("bigint")
    at = meta.select(*run, F.col("id").alias("precursor_id"), F.col("index").cast("bigint").alias("_order"), F.col("index").cast("bigint").alias("_hit"), F.lit(None).cast(precursor.select(F.struct("source_index", *rest)).schema[0].dataType).alias("_row")).where("precursor_id is not null")
    refs = precursor.select(*run, "precursor_id", F.col("source_index").cast("bigint").alias("_order"), none.alias("_hit"), F.struct("source_index", *rest).alias("_row"))
    upto = W.partitionBy(*run, "precursor_id").orderBy("_order", F.col("_row").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    told = at.unionByName(refs).withColumn("_hit", F.last("_hit", ignorenulls=True).over(upto)).where("_row is not null")
    found = F.when(F.col("precursor_id").isNotNull() & F.col("_order").isNotNull(), F.col("_hit")).alias("precursor_index")
    return told.select(*run, "_row.source_index", "precursor_id", *[f"_row.{c}" for c in rest], found)


def sorted_precursors(precursor: DataFrame) -> DataFrame:
    """Precursors by source and their own index, from range to range."""
    return precursor.repartitionByRange("source_index").sortWithinPartitions("source_index", "precursor_index")


def precursors_reversed(precursor: DataFrame, columns: list[str], name: str = "precursors") -> DataFrame:
    """(source_index, precursors): each source's precursors from the highest index down, so the lowest comes last; a null index is the lowest."""
    order = F.coalesce("precursor_index", F.lit(-1)).alias("order")
    return precursor.groupBy("source_index").agg(F.sort_array(F.collect_list(F.struct(order, *columns)), asc=False).alias(name))


def pair_by_position(a: DataFrame, b: DataFrame, key: str, order_a: list[str], order_b: list[str]) -> DataFrame:
    """Rows of two tables paired by their place within an entity."""
    number = lambda df, order, name: df.select(key, F.row_number().over(W.partitionBy(key).orderBy(*order)).alias("place"), F.struct(*[c for c in df.columns if c != key]).alias(name))
    return number(a, order_a, "a").join(number(b, order_b, "b"), [key, "place"])


def dense_index(df: DataFrame, order: list[str], name: str = "index") -> DataFrame:
    """Numbers from 0 in the given order, without a single-task window: counts per range, then places within it."""
    # written once: both uses below must see the same ranges
    ranged = materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row per partition
    numbered = ranged.withColumn("_place", F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1)
    return numbered.join(before, "_part").withColumn(name, (F.col("_before") + F.col("_place")).cast("bigint")).drop("_part", "_place", "_before")


def to_nested(df: DataFrame, fields: list[tuple[str, str]], name: str) -> DataFrame:
    """Flat columns as one struct of the given (field, type); fields the table lacks are null."""
    return df.select(F.struct(*[(F.col(f) if f in df.columns else F.lit(None)).cast(t).alias(f) for f, t in fields]).alias(name))


def with_parameter(params: Column, value: Column, slot: str, accession: str | None, name: str, unit: Column | None = None) -> Column:
    """A parameter list with a column's value added as one parameter, unchanged where the value is null."""
    slots = F.struct(*[(value if s == slot else F.lit(None)).cast(t).alias(s) for s, t in (("integer", "bigint"), ("float", "double"), ("string", "string"), ("boolean", "boolean"))])
    one = F.struct(slots.alias("value"), F.lit(accession).cast("string").alias("accession"), F.lit(name).alias("name"), (F.lit(None) if unit is None else unit).cast("string").alias("unit"))
    return F.when(value.isNull(), params).otherwise(F.concat(F.coalesce(params, F.array().cast("array<struct<value:struct<integer:bigint,float:double,string:string,boolean:boolean>,accession:string,name:string,unit:string>>")), F.array(one)))


def parameter(params: Column, accession: str, slot: str) -> Column:
    """A slot of the first parameter with an accession, null if there is none."""
    return F.try_element_at(F.filter(params, lambda p: p["accession"] == accession), F.lit(1))["value"][slot]


def without_parameters(params: Column, accessions: list[str]) -> Column:
    """A parameter list without those that became columns."""
    return F.filter(params, lambda p: p["accession"].isNull() | ~p["accession"].isin(accessions))


def columns_from_parameters(df: DataFrame, params: str, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """Parameters promoted to columns: name -> (accession, slot); they leave the list."""
    told = df.withColumns({name: parameter(F.col(params), accession, slot) for name, (accession, slot) in wanted.items()})
    return told.withColumn(params, without_parameters(F.col(params), [a for a, _ in wanted.values()]))


def unknown_columns_to_parameters(df: DataFrame, params: str, known: list[str]) -> DataFrame:
    """Columns that aren't known become parameters of their row and go: their accession, name and unit come from
    the column's name, the unit also from a column ``<name>_unit`` beside it, which is no parameter of its own."""
    from slabworks.functions.cv import parse_column_name

    units = {c for c in df.columns if c.endswith("_unit") and c[: -len("_unit")] in df.columns}
    slots = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "float": "float", "double": "float", "string": "string", "boolean": "boolean"}
    taken = [f.name for f in df.schema.fields if f.name not in known and f.name != params and f.name not in units and f.dataType.simpleString() in slots]
    out = df
    for c in taken:
        told = parse_column_name(c)
        unit = F.col(f"{c}_unit") if f"{c}_unit" in units else F.lit(told.unit)
        out = out.withColumn(params, with_parameter(F.col(params), F.col(c), slots[df.schema[c].dataType.simpleString()], told.accession, told.name, unit))
    return out.drop(*taken, *[u for u in units if u[: -len("_unit")] in taken])


def normalised_parameters(params: Column) -> Column:
    """Each parameter with its value as text, its accession and unit as CURIEs; null elements go."""
    from slabworks.functions.params import canonical_curie, value_text

    curie = lambda c: F.coalesce(canonical_curie(c), c)
    some = F.filter(params, lambda p: p.isNotNull())
    return F.transform(some, lambda p: F.struct(value_text(p["value"]).alias("value"), curie(p["accession"]).alias("accession"), p["name"].alias("name"), curie(p["unit"]).alias("unit")))
