"""Mixing sources to target weights, by Pareto order sampling.

Sizes are tokens of a public vocabulary. For each mix the largest total is found that all its sources
can feed within their repeat caps. A document is then due x copies: its source's repetition rate times
its weight, at most the cap. floor(x) copies are certain; the rest is the inclusion probability p of one
more, drawn by order sampling: documents are ranked by the random odds u/(1-u) divided by the inclusion
odds p/(1-p), and taken in that order until the source's share is met. The rank at which it is met is
found on a histogram in two levels, so no task sorts a source.

Defined results: documents without tokens (null, empty) and with null source are in no mix; a source of
a mix without documents gets nothing and the other sources keep their proportions; shares that are
null, zero or negative ask for nothing; max_repeats below 1 lets a source in not at all; the draw is the
same at each run with one seed. The share reached is off by less than one document per source.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slabworks.llm.bytepair import count_tokens
from slabworks.session import materialise

#: Buckets per level of the rank histogram, and of the histogram of weights.
BUCKETS, WEIGHT_STEPS = 4096, 8


def document_sizes(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens), written once: every later step reads these few bytes per document."""
    return materialise(count_tokens(documents.where("source is not null"), ["doc_id", "source"], path).where("n_tokens > 0"))


def repetition_rates(sizes: DataFrame, targets: DataFrame) -> pd.DataFrame:
    """Per (mix_name, source): target_share, max_repeats, tokens and documents available, the largest of them, tokens due, and the rate of copies per weight.

    Works on a histogram of weights per source: its rows are bounded by sources times weight classes.
    """
    classes = sizes.groupBy("source", F.floor(F.log2("weight") * WEIGHT_STEPS).alias("w_class")).agg(
        F.sum("n_tokens").cast("double").alias("tokens"), F.sum(F.col("n_tokens") * F.col("weight")).alias("weighted"), F.count("*").alias("n"), F.max("n_tokens").alias("largest")
    )
    wanted = targets.where("target_share > 0 and max_repeats >= 1 and source is not null").groupBy("mix_name", "source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = classes.join(F.broadcast(wanted.select("source").distinct()), "source").toPandas()
    plan = wanted.toPandas()
    for name, column, how in (("available", "tokens", "sum"), ("n_available", "n", "sum"), ("largest", "largest", "max")):
        plan[name] = plan["source"].map(rows.groupby("source")[column].agg(how) if len(rows) else pd.Series(dtype=float)).astype(float).fillna(0.0)
    live = plan["available"] > 0
    plan["share"] = np.where(live, plan["target_share"], 0.0)
    if not len(plan):
        return plan.assign(due=[], rate=[])
    plan["share"] /= plan.groupby("mix_name")["share"].transform("sum").replace(0, np.nan)
    room = np.where(live, plan["available"] * plan["max_repeats"] / plan["share"], np.inf)
    total = pd.Series(room, index=plan.index).groupby(plan["mix_name"]).transform("min")
    plan["due"] = np.where(live, plan["share"].fillna(0) * total.replace(np.inf, 0), 0.0)
    rates = []
    for source, cap, due in zip(plan["source"], plan["max_repeats"], plan["due"]):
        own = rows[rows["source"] == source]
        if due <= 0 or not len(own):
            rates.append(0.0)
            continue
        tokens, mean_w = own["tokens"].to_numpy(), (own["weighted"] / own["tokens"]).to_numpy()
        lo, hi = 0.0, float(cap / mean_w.min()) * 1.0001
        for _ in range(80):  # the rate at which copies, capped, add up to what is due
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (tokens * np.minimum(cap, mid * mean_w)).sum() < due else (lo, mid)
        rates.append(hi)
    return plan.assign(rate=rates)


def uniform(seed: int, *columns: str) -> Column:
    """A number in (0, 1) that depends on the columns' values and the seed only."""
    return (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def draw(documents: DataFrame, targets: DataFrame, weight: Column | None = None, seed: int = 17, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(drawn, plan): drawn has mix_name, doc_id, source, n_tokens, copies; plan has a row per mix and source.

    weight: how often a document should come relative to others of its source, positive; made of
    columns of (doc_id, source, n_tokens).
    """
    spark = documents.sparkSession
    sizes = document_sizes(documents, path).withColumn("weight", (F.lit(1.0) if weight is None else weight).cast("double")).where("weight > 0")
    plan_rows = repetition_rates(sizes, targets)
    plan = spark.createDataFrame(
        [(r.mix_name, r.source, float(r.target_share), int(r.max_repeats), float(r.available), int(r.n_available), int(r.largest), float(r.due), float(r.rate)) for r in plan_rows.itertuples()],
        "mix_name string, source string, target_share double, max_repeats int, available double, n_available bigint, largest bigint, due double, rate double",
    )
    x = F.least(F.col("max_repeats").cast("double"), F.col("rate") * F.col("weight"))
    # The plan and the two cut-offs have a row per mix and source of the targets and came from the driver: they
    # are the sides broadcast. A frame of driver rows tells no size, so without the hint the documents would be.
    due = sizes.join(F.broadcast(plan.where("due > 0")), "source").select("mix_name", "source", "doc_id", "n_tokens", "max_repeats", "due", x.alias("x"))
    certain = F.when(F.col("x") >= F.col("max_repeats"), F.col("max_repeats") - 1).otherwise(F.floor("x")).cast("int")
    ranked = due.withColumn("certain", certain).withColumn("p", F.col("x") - F.col("certain")).withColumn("u", uniform(seed, "mix_name", "doc_id"))
    odds = F.try_divide(F.col("u") / (1 - F.col("u")) * (1 - F.col("p")), F.col("p"))
    # the order of the odds as a number in [0, 1); certain ones (p = 1) come first, in random order among themselves
    order = F.when(F.col("p") >= 1 - 1e-9, F.col("u") / 2).when(F.col("p") <= 0, F.lit(1.0 - 1e-12)).otherwise(F.least(0.5 + odds / (1 + odds) / 2, F.lit(1.0 - 1e-12)))
    ranked = ranked.withColumn("r", order)
    ranked = ranked.withColumn("b1", F.floor(F.col("r") * BUCKETS).cast("int")).withColumn("b2", F.floor((F.col("r") * BUCKETS - F.col("b1")) * BUCKETS).cast("int"))
    keys = ["mix_name", "source"]
    # what is still due after the certain copies, and in which bucket of either level it is met
    level1 = ranked.groupBy(*keys, "b1").agg(F.sum("n_tokens").alias("t"), F.sum(F.col("n_tokens") * F.col("certain")).alias("c"), F.first("due").alias("due"))
    upto = W.partitionBy(*keys).orderBy("b1").rowsBetween(W.unboundedPreceding, -1)
    all_ = W.partitionBy(*keys)
    crit1 = (
        level1.withColumn("rest", F.col("due") - F.sum("c").over(all_)).withColumn("before", F.coalesce(F.sum("t").over(upto), F.lit(0)))
        .where("before < rest").groupBy(*keys).agg(F.max("b1").alias("cb1"), F.max_by("before", "b1").alias("before"), F.first("rest").alias("rest"))
    )
    crit1 = materialise(crit1)
    level2 = ranked.join(F.broadcast(crit1), keys).where("b1 = cb1").groupBy(*keys, "b1", "b2").agg(F.sum("n_tokens").alias("t"), F.first("before").alias("before0"), F.first("rest").alias("rest"))
    upto2 = W.partitionBy(*keys).orderBy("b2").rowsBetween(W.unboundedPreceding, -1)
    crit2 = (
        level2.withColumn("before", F.col("before0") + F.coalesce(F.sum("t").over(upto2), F.lit(0))).where("before < rest")
        .groupBy(*keys).agg(F.max("b2").alias("cb2"), F.max_by("before", "b2").alias("before"), F.first("rest").alias("rest"))
    )
    crit2 = materialise(crit2.join(crit1.select(*keys, "cb1"), keys))
    placed = ranked.join(F.broadcast(crit2), keys, "left")
    at = (F.col("b1") == F.col("cb1")) & (F.col("b2") == F.col("cb2"))
    sure = placed.where(~F.coalesce(at, F.lit(False))).withColumn("extra", F.coalesce(((F.col("b1") < F.col("cb1")) | ((F.col("b1") == F.col("cb1")) & (F.col("b2") < F.col("cb2")))).cast("int"), F.lit(0)))
    # within the last bucket, a 1/BUCKETS^2 of a source (ties apart), document by document
    inside = W.partitionBy(*keys).orderBy("r", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    edge = placed.where(at).withColumn("sofar", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).withColumn("extra", (F.col("sofar") + F.col("n_tokens") / 2 <= F.col("rest")).cast("int"))
    cols = ["mix_name", "doc_id", "source", "n_tokens", (F.col("certain") + F.col("extra")).cast("int").alias("copies")]
    return sure.select(*cols).unionByName(edge.select(*cols)).where("copies > 0"), plan


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: target_share, actual_share, tokens, documents drawn, most copies of one."""
    got = drawn.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("n_documents"), F.max("copies").alias("most_copies"))
    rows = targets.where("source is not null").groupBy("mix_name", "source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).join(got, ["mix_name", "source"], "left")
    total = F.sum("tokens").over(W.partitionBy("mix_name"))
    return rows.select(
        "mix_name", "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce(F.col("tokens") / total, F.lit(0.0)).alias("actual_share"),
    )


def certify(drawn: DataFrame, targets: DataFrame, plan: DataFrame) -> DataFrame:
    """Per mix and source, what the draw promises: n_available, share_met, repeats_kept, mix_exhausted.

    share_met: the tokens drawn are off the source's share of its mix's tokens by less than a document per
    source. repeats_kept: no document came oftener than it may. mix_exhausted: some source of the mix gave
    all its copies but for a document, so no larger mix has these shares.
    """
    got = shares(drawn, targets).select("mix_name", "source", "tokens", "most_copies")
    mix = W.partitionBy("mix_name")
    share = F.when(F.col("n_available") > 0, F.col("target_share")).otherwise(0.0)
    rows = plan.join(got, ["mix_name", "source"]).withColumn("share", F.coalesce(share / F.nullif(F.sum(share).over(mix), F.lit(0.0)), F.lit(0.0)))
    off = F.abs(F.col("tokens") - F.col("share") * F.sum("tokens").over(mix))
    full = F.col("tokens") >= F.col("available") * F.col("max_repeats") - F.col("largest")
    return rows.select(
        "mix_name", "source", "n_available", (off <= F.col("largest") + F.col("share") * F.sum("largest").over(mix)).alias("share_met"),
        (F.col("most_copies") <= F.col("max_repeats")).alias("repeats_kept"), F.coalesce(F.max(F.when(F.col("n_available") > 0, full)).over(mix), F.lit(True)).alias("mix_exhausted"),
    )
