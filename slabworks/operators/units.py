"""Quantities recorded in different units.

Every way of writing a unit is a *source*. Two sources of an attribute are linked by the entities for
which both recorded it, and the robust scale (median of the slopes between matched quantiles) and offset
(median of what remains) between them are estimated on those; where two sources share too few entities,
the quantiles of all their values stand in. The known conversion nearest in location, scale and offset is
what an estimate snaps to. Sources that name their unit plainly (a CURIE, symbol or name of the unit
table) anchor the graph; what a label means is then propagated from attribute to attribute along shared
labels, until a round tells nothing new. The letters of a label choose among the conversions that the
values allow; where they are silent the values alone decide, if they are many and fit closely.

Defined results: null, blank and placeholder values and rows without any sign of a unit are no
observations; a label that neither its values nor its letters tell stays unresolved and is reported so
(``label_report``); repeated rows of one key count once in the result. Empty inputs give empty results.
Columns beyond those named are ignored.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slabworks.functions import params as P
from slabworks.session import materialise, small_side, written

QUANTILES = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
#: A snap farther than so many spreads of the anchor's values is none: where the label's letters agree, and where they are silent.
LOOSE, STRICT = 1.0, 0.35
#: Values alone tell a label from so many on; entities shared by two sources stand for themselves from so many on.
FEWEST, LINKED = 30, 100
#: British and short spellings within unit labels, each as the unit table writes it.
SPELLINGS = [("metre", "meter"), ("µ", "micro"), ("μ", "micro"), ("℃", "°C"), ("℉", "°F"), ("°", "deg")]


def label_key(c: Column) -> Column:
    """One spelling per label: CURIEs in canonical form, both micro signs as one, no final dot; case stays (mV is not MV)."""
    s = F.regexp_replace(F.translate(P.squeeze(c), "μ", "µ"), r"\.$", "")
    return F.coalesce(P.canonical_curie(c), F.nullif(s, F.lit("")))


SPELLED = ["accession", "name", "unit"]


def spellings(tables: list[DataFrame], attributes: DataFrame) -> DataFrame:
    """What each way to write (accession, name, unit) says: attribute, common_unit, label; those of no such attribute are left out.

    Sources repeat their spellings, so each is read once here and not on every row. The result is a
    lookup side of measured size.
    """
    acc = attributes.where("common_unit is not null").select(
        P.canonical_curie(F.col("accession")).alias("acc_key"), F.col("accession").alias("attribute"),
        P.name_key(F.col("attribute_name")).alias("attr_name_key"), "common_unit",
    )
    pairs = [t.select(*SPELLED).distinct() for t in tables]
    written = pairs[0]
    for more in pairs[1:]:
        written = written.unionByName(more)
    rows = written.distinct().select(
        *SPELLED, P.canonical_curie(F.col("accession")).alias("r_acc"), F.when(P.filled(F.col("accession")).isNull(), P.name_key(F.col("name"))).alias("r_name"),
        F.coalesce(P.filled(F.col("unit")), P.unit_in_name(F.col("name"))).alias("told"),
    )
    by_acc = acc.select(F.struct("attribute", "common_unit").alias("a1"), "acc_key").dropDuplicates(["acc_key"])
    by_name = acc.select(F.struct("attribute", "common_unit").alias("a2"), "attr_name_key").dropDuplicates(["attr_name_key"])
    found = (
        rows.join(by_acc, F.col("r_acc") == F.col("acc_key"), "left")
        .join(by_name, F.col("r_name") == F.col("attr_name_key"), "left")
        .withColumn("a", F.coalesce("a1", "a2"))
        .where("a is not null")
    )
    return small_side(found.select(*[F.col(c).alias(f"w_{c}") for c in SPELLED], F.col("a.attribute").alias("attribute"), F.col("a.common_unit").alias("common_unit"), label_key(F.col("told")).alias("told")))


def observations(params: DataFrame, said: DataFrame, key: str, structured: bool) -> DataFrame:
    """(row_id, run_id, entity, attribute, common_unit, label, number) of every parameter that reads as a number.

    said: the spellings; structured: the value is a struct of slots, else text. entity: a hash of run, place
    in the run and attribute; it only links estimates, so two entities with one hash do no harm.
    """
    value = F.col("value")
    text = F.col("value.string") if structured else value
    on = F.lit(True)
    for c in SPELLED:
        on = on & F.col(c).eqNullSafe(F.col(f"w_{c}"))
    number = P.number_of(value) if structured else P.number_in_text(value)
    place = [c for c in ("spectrum_index", "section") if c in params.columns]
    rows = params.select(F.col(key).alias("row_id"), "run_id", *place, *SPELLED, "value").join(said, on)
    return rows.select(
        "row_id", "run_id", F.xxhash64("run_id", *place, "attribute").alias("entity"), "attribute", "common_unit", F.coalesce("told", label_key(P.unit_in_text(text))).alias("label"), number.alias("number")
    ).where("number is not null")


def units_with_keys(units: DataFrame) -> DataFrame:
    """(unit, kind, factor, shift, label) for each plain way to name a unit."""
    base = units.select(
        F.col("unit_curie").alias("unit"), F.col("quantity_kind").alias("kind"), F.col("to_base_factor").alias("factor"), F.col("to_base_shift").alias("shift"), "symbol", "unit_name"
    ).dropDuplicates(["unit"])
    return base.select("unit", "kind", "factor", "shift", F.explode(F.array_distinct(F.array(label_key(F.col("unit")), label_key(F.col("symbol")), label_key(F.col("unit_name"))))).alias("label")).where("label is not null")


def _median(a: Column) -> Column:
    """Of an array without nulls; the upper one of two middles."""
    return F.try_element_at(F.array_sort(a), (F.floor(F.size(a) / 2) + 1).cast("int"))


def _readable(label: str, symbol: str, name: str) -> bool:
    """Whether a label can be a short or long form of a unit: its letters occur in the unit's name or symbol, in order."""

    def plain(s: str) -> str:
        for a, b in SPELLINGS:
            s = s.replace(a, b)
        return re.sub(r"[^a-z0-9%/]+", "", unicodedata.normalize("NFKC", s).lower())

    def within(short: str, long: str) -> bool:
        it = iter(long)
        return short[:1] == long[:1] and all(ch in it for ch in short)

    lab, sym, full = plain(label), plain(symbol or ""), plain(name or "")
    forms = {lab, lab[:-1] if lab.endswith("s") and len(lab) > 1 else lab}
    forms |= {"micro" + f[1:] for f in forms if f[:1] == "u" and len(f) > 1}
    last = plain((name or "").split(" ")[-1])
    return any(f and (f == sym or within(f, full) or (len(f) > 2 and (f == last or full.startswith(f[:5])))) for f in forms)


@F.pandas_udf(T.BooleanType())
def readable(label: pd.Series, symbol: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([_readable(a or "", b or "", c or "") for a, b, c in zip(label, symbol, name)], dtype=bool)


def source_statistics(obs: DataFrame) -> DataFrame:
    """Quantiles of every (attribute, label): one partial aggregate over the observations, a row per source."""
    return (
        obs.where("label is not null")
        .groupBy("attribute", "common_unit", "label")
        .agg(F.count("*").alias("n"), F.percentile_approx("number", F.array(*map(F.lit, QUANTILES)), 1000).alias("q"))
    )


def source_links(obs: DataFrame, stats: DataFrame) -> DataFrame:
    """(attribute, label, other, n, q, oq): quantiles of what two sources recorded of the same entities, each pair both ways.

    stats names the sources. An entity gives one link, between the first and the last of its sources, so
    there are never more links than entities. Up to there labels go by their hash: only numbers are aggregated and shuffled.
    """
    quantiles = lambda c: F.percentile_approx(c, F.array(*map(F.lit, QUANTILES)), 1000)
    hashed = obs.where("label is not null").select("attribute", "entity", F.xxhash64("label").alias("l"), "number")
    ends = hashed.groupBy("attribute", "entity").agg(F.min("l").alias("la"), F.max("l").alias("lb"), F.min_by("number", "l").alias("va"), F.max_by("number", "l").alias("vb")).where("la <> lb")
    pairs = ends.groupBy("attribute", "la", "lb").agg(F.count("*").alias("n"), quantiles("va").alias("qa"), quantiles("vb").alias("qb"))
    ways = F.explode(F.array(F.struct(F.col("la").alias("l"), F.col("lb").alias("o"), F.col("qa").alias("q"), F.col("qb").alias("oq")), F.struct(F.col("lb").alias("l"), F.col("la").alias("o"), F.col("qb").alias("q"), F.col("qa").alias("oq"))))
    both = pairs.select("attribute", "n", ways.alias("w")).select("attribute", "n", "w.*")
    names = stats.select("attribute", "label")
    own = names.select("attribute", "label", F.xxhash64("label").alias("l"))
    other = names.select("attribute", F.col("label").alias("other"), F.xxhash64("label").alias("o"))
    return both.join(own, ["attribute", "l"]).join(other, ["attribute", "o"]).select("attribute", "label", "other", "n", "q", "oq")


def conversion_estimates(edges: DataFrame) -> DataFrame:
    """Edges (q against aq, the anchor's factor af and shift ash, and a candidate's factor and shift) with ``far``.

    slope and offset are estimated robustly; far is how many spreads of the anchor's values the source lies
    off the known conversion in location, and how far its scale and offset are off, both within bounds.
    """
    n = len(QUANTILES)
    slopes = F.transform(F.sequence(F.lit(1), F.lit(n - 4)), lambda i: F.try_divide(F.element_at("q", i + 4) - F.element_at("q", i), F.element_at("aq", i + 4) - F.element_at("aq", i)))
    told = edges.withColumn("slope", _median(F.filter(slopes, lambda x: x.isNotNull() & ~F.isnan(x)))).withColumn(
        "offset", _median(F.transform(F.arrays_zip("q", "aq"), lambda z: z["q"] - F.col("slope") * z["aq"]))
    )
    k, o = F.col("af") / F.col("factor"), (F.col("ash") - F.col("shift")) / F.col("factor")
    middle = F.abs(k * F.element_at("aq", 5) + o)
    spread = F.greatest(F.abs(k) * (F.element_at("aq", 8) - F.element_at("aq", 2)), 0.2 * middle, F.lit(1e-12))
    location = F.aggregate(F.arrays_zip("q", "aq"), F.lit(0.0), lambda s, z: s + F.abs(z["q"] - (k * z["aq"] + o))) / n / spread
    scale = F.abs(F.log10(F.greatest(F.abs(F.coalesce("slope", k)), F.lit(1e-12)) / F.abs(k)))
    # a scale that is off moves the offset along: only what lies beyond that counts
    beyond = F.greatest(F.abs(F.coalesce(F.col("offset"), o) - o) - F.abs((F.coalesce("slope", k) - k) * F.element_at("aq", 5)), F.lit(0.0)) / spread
    return told.withColumn("far", location + 0.5 * F.least(scale, F.lit(1.0)) + 0.25 * F.least(beyond, F.lit(1.0)))


def resolve_labels(stats: DataFrame, units: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(label, unit, told_by) for every label that can be told; told_by: name, letters or values.

    stats has a row per (attribute, label) and links one per linked pair of them, so each step here works on
    aggregates: the pairs made are labels times the units of one kind, never labels times labels. Newly told
    labels serve as anchors, also for attributes that have none of their own, round after round, until a
    round tells none.
    """
    named = units_with_keys(units).dropDuplicates(["label"])
    unit_rows = units.select(
        F.col("unit_curie").alias("unit"), F.col("quantity_kind").alias("kind"), F.col("to_base_factor").alias("factor"), F.col("to_base_shift").alias("shift"), "symbol", "unit_name"
    ).dropDuplicates(["unit"])
    kinds = unit_rows.select(F.col("unit").alias("common_unit"), F.col("kind").alias("a_kind"))
    stats = materialise(stats.join(kinds, "common_unit"))
    links = None if links is None else materialise(links)
    labels = materialise(named.select("label", "unit", F.lit("name").alias("told_by")))
    while True:
        told = stats.join(labels, "label").join(unit_rows, "unit").where("kind = a_kind")
        # the anchors of an attribute: per unit the best-filled source, so at most one per unit of its kind
        anchors = told.groupBy("attribute", "unit", "kind", "factor", "shift").agg(F.max_by(F.struct("n", "q"), "n").alias("best")).select(
            "attribute", F.col("factor").alias("af"), F.col("shift").alias("ash"), F.col("best.n").alias("an"), F.col("best.q").alias("aq")
        )
        unknown = stats.join(labels, "label", "left_anti").select("attribute", "a_kind", "label", "n", "q")
        if unknown.isEmpty():
            break
        edges = unknown.join(anchors, "attribute").withColumn("w", F.least("n", "an")).select("attribute", "a_kind", "label", "q", "aq", "af", "ash", "w", F.lit(False).alias("linked"))
        if links is not None:
            known = told.select("attribute", F.col("label").alias("other"), F.col("factor").alias("af"), F.col("shift").alias("ash"))
            shared = links.join(unknown.select("attribute", "label", "a_kind"), ["attribute", "label"]).join(known, ["attribute", "other"])
            edges = edges.unionByName(shared.select("attribute", "a_kind", "label", "q", F.col("oq").alias("aq"), "af", "ash", F.col("n").alias("w"), F.lit(True).alias("linked")))
        scored = conversion_estimates(edges.join(unit_rows.withColumnRenamed("kind", "u_kind"), F.col("a_kind") == F.col("u_kind")))
        # few values tell quantiles badly: what a readable label may be off grows as their number falls
        scored = scored.withColumn("w", F.col("w").cast("double")).withColumn("room", LOOSE * (1 + 8 / F.sqrt("w")))
        mean = lambda c, linked: F.sum(F.when(F.col("linked") == linked, F.col(c) * F.col("w"))) / F.sum(F.when(F.col("linked") == linked, F.col("w")))
        weight = lambda linked: F.coalesce(F.sum(F.when(F.col("linked") == linked, F.col("w"))), F.lit(0.0))
        votes = scored.groupBy("label", "unit", "symbol", "unit_name").agg(*[mean(c, x).alias(f"{c}{int(x)}") for c in ("far", "room") for x in (False, True)], *[weight(x).alias(f"w{int(x)}") for x in (False, True)])
        pick = lambda c: F.when((F.col("w1") >= LINKED) | F.col(f"{c}0").isNull(), F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
        judged = votes.select("label", "unit", pick("far").alias("far"), pick("room").alias("room"), pick("w").alias("w"), readable("label", "symbol", "unit_name").alias("reads"))
        fitting = judged.where(f"(reads and far <= room) or (far <= {STRICT} and w >= {FEWEST} and label rlike '^[A-Za-z°µ%][A-Za-z°µ% ./]*$')")
        best = F.min_by(F.struct("unit", F.when(F.col("reads"), "letters").otherwise("values").alias("told_by")), F.struct((~F.col("reads")).cast("int"), "far", "unit"))
        new = materialise(fitting.groupBy("label").agg(best.alias("b")).select("label", "b.unit", "b.told_by"))
        if new.isEmpty():
            break
        labels = labels.unionByName(new)  # parts that are written already
    return labels


def label_report(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, unit, told_by, n_values) of every label that occurs; told_by is unresolved where unit is null."""
    seen = stats.groupBy("label").agg(F.sum("n").alias("n_values"))
    return seen.join(labels, "label", "left").select("label", "unit", F.coalesce("told_by", F.lit("unresolved")).alias("told_by"), "n_values")


def in_common_units(obs: DataFrame, labels: DataFrame, units: DataFrame) -> DataFrame:
    """Observations with recorded_unit and common_value; both null where the unit is unknown or of another kind."""
    u = units.select(F.col("unit_curie").alias("recorded_unit"), F.col("quantity_kind").alias("r_kind"), F.col("to_base_factor").alias("r_f"), F.col("to_base_shift").alias("r_s")).dropDuplicates(["recorded_unit"])
    c = units.select(F.col("unit_curie").alias("common_unit"), F.col("quantity_kind").alias("c_kind"), F.col("to_base_factor").alias("c_f"), F.col("to_base_shift").alias("c_s")).dropDuplicates(["common_unit"])
    # a row per label and common unit of its kind: small, and measured before it is broadcast
    told = small_side(labels.join(u, labels["unit"] == u["recorded_unit"]).join(c, F.col("r_kind") == F.col("c_kind")).select(F.col("label").alias("t_label"), F.col("common_unit").alias("t_common"), "recorded_unit", "r_f", "r_s", "c_s", "c_f"))
    both = obs.join(told, (F.col("label") == F.col("t_label")) & (F.col("common_unit") == F.col("t_common")), "left")
    return both.select(*obs.columns, "recorded_unit", ((F.col("number") * F.col("r_f") + F.col("r_s") - F.col("c_s")) / F.col("c_f")).alias("common_value"))


def read_parameters(spectrum_parameter: DataFrame, meta_param: DataFrame, attributes: DataFrame) -> DataFrame:
    """The observations of both tables with table_name: every value is read once and written compactly for what follows."""
    tag = lambda df, name: df.select(F.lit(name).alias("table_name"), "*")
    said = spellings([spectrum_parameter, meta_param], attributes)
    return written(tag(observations(spectrum_parameter, said, "param_id", True), "spectrum_parameter").unionByName(tag(observations(meta_param, said, "meta_id", False), "meta_param")))


def normalise_units(spectrum_parameter: DataFrame, meta_param: DataFrame, attributes: DataFrame, units: DataFrame) -> DataFrame:
    """Every numeric parameter with its recorded unit and its value in the common one.

    Columns: table_name, row_id, run_id, attribute, common_unit, label, number, recorded_unit, common_value.
    """
    obs = read_parameters(spectrum_parameter, meta_param, attributes)
    stats = materialise(source_statistics(obs))
    labels = resolve_labels(stats, units, source_links(obs, stats))
    return in_common_units(obs, labels, units).drop("entity")


def recorded_in_other_units(normalised: DataFrame) -> DataFrame:
    """(table_name, row_id, recorded_unit) of parameters recorded in another unit than the common one, each once.

    Only those are shuffled; should the deliveries of one row name several units, the first of them holds.
    """
    other = normalised.where("recorded_unit is not null and recorded_unit <> common_unit").select("table_name", "row_id", "recorded_unit").distinct()
    return other.groupBy("table_name", "row_id").agg(F.min("recorded_unit").alias("recorded_unit"))
