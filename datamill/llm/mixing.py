"""Mixing sources to target weights by Pareto order sampling.

The mix holds ``share`` times the words of all documents. Sources share it by
weight; a source whose target is above ``most`` times its size stops there, and
the excess is shared out again by weight until none is above. The whole part of
target / size is certain: so many copies of each document. What is left of the target
is a sample of one more copy of some documents, with probabilities proportional to
size: a document's chance is its words times a factor, at most 1, and the factor makes
the words expected from all of them those due. The sample is drawn by Pareto order
sampling: documents are ranked by their random odds divided by the odds of their
inclusion, and taken in that order until the words due are reached (nearest document
boundary). Random numbers come from a digest of the seed and doc_id, so reruns agree.

The place where a source's ranks are cut is found from sums over 65,536 ranges of the
rank's logarithm, then over as many parts of one range, then inside one part alone, so no
source is ever sorted as a whole; the factor comes from one row for each size of a source.

Null texts have no words, and documents without words are never drawn. Null sources are
one source, last in order. Documents of any length count in whole. Rows that repeat
(same doc_id and size) have the same rank and are taken or left together; ties of rank
are in order of doc_id, null first. An empty table gives an empty mix; sources without
words get target 0. Other columns pass through ``with_copies``; those that the plan
names give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datamill.tables import materialize

SHARE = 1.5
MOST = 2.0
#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
SEED = "mix:"
RANGES = 65536
WORD = r"[^\x20\x09-\x0D]+"


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target), one row for each source of ``sizes`` (source, size).

    The windows are over one row for each source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1)).withColumn(
        "cap", F.col("source_size").cast("double") * most
    )
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.sum("source_size").over(everything).cast("double") * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = weighed.withColumn("level", level).withColumn("place", F.row_number().over(by_room))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("place", "level"))
    return levels.withColumn("fit", F.min(fits).over(everything)).select(
        "source", "source_size", F.least("cap", F.col("weight") * F.col("fit.level")).alias("target")
    )


def with_order(df: DataFrame, seed: str = SEED) -> DataFrame:
    """``order``: random odds over inclusion odds, from doc_id and ``size`` and ``factor``; null for what is never drawn."""
    hexes = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 12)
    u = (F.conv(hexes, 16, 10).cast("double") + 0.5) / float(1 << 48)
    chance = F.least(F.lit(1.0), F.col("size") * F.col("factor"))
    return (
        df.withColumn("__u", u)
        .withColumn("__p", chance)
        .withColumn("order", F.when(F.col("__p") > 0, (F.col("__u") / (1.0 - F.col("__u"))) * ((1.0 - F.col("__p")) / F.col("__p"))))
        .drop("__u", "__p")
    )


def factors(sizes: DataFrame, due: DataFrame) -> DataFrame:
    """(source, factor) such that the chances min(1, size * factor) of a source give its words due.

    Sizes are looked at from the largest on, one row each: as long as the factor would give them a chance above 1,
    they are certain and the others share what is left.
    """
    counted = sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").cast("decimal(38,0)").alias("n"))
    from_largest = Window.partitionBy("source").orderBy(F.col("size").desc())
    larger = F.sum(F.col("n") * F.col("size")).over(from_largest.rowsBetween(Window.unboundedPreceding, -1))
    rest = F.sum(F.col("n") * F.col("size") * F.col("size")).over(from_largest.rowsBetween(0, Window.unboundedFollowing))
    levels = counted.withColumn("larger", F.coalesce(larger.cast("double"), F.lit(0.0))).withColumn("rest", rest.cast("double"))
    each = levels.alias("l").join(due.alias("s"), F.col("l.source").eqNullSafe(F.col("s.source"))).select(
        "l.source", "l.size", ((F.col("s.due") - F.col("l.larger")) / F.col("l.rest")).alias("factor")
    )
    return each.where(F.col("factor") * F.col("size") <= 1.0).groupBy("source").agg(F.max_by("factor", "size").alias("factor"))


def same_source(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def crossing(rows: DataFrame, part: str) -> DataFrame:
    """(source, part, before): the part of each source in which the words due are reached, and the words before it.

    ``rows`` has source, part, size, due, before.
    """
    upto = Window.partitionBy("source").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", part).agg(F.sum("size").alias("words"), F.first("due").alias("due"), F.first("before").alias("start"))
    ahead = F.col("start") + F.coalesce(F.sum("words").over(upto), F.lit(0))
    return sums.withColumn("before", ahead).where("before < due and due <= before + words").select("source", part, "before")


def source_plan(sizes: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """One row for each source: source_size, target, whole (certain copies), factor, and where its order is cut."""
    shares = (
        source_targets(sizes, **how)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("due", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    due = shares.alias("s").join(factors(sizes, shares).alias("f"), same_source("s", "f"), "left").select(
        "s.*", F.when(F.col("s.due") > 0, F.coalesce("f.factor", F.lit(0.0))).otherwise(0.0).alias("factor")
    )
    due = materialize(due, "shares")
    ranked = with_order(
        sizes.alias("d").join(due.alias("s"), same_source("d", "s")).select("d.doc_id", "d.source", "d.size", "s.factor", "s.due"), seed
    ).where("order is not null")
    # Orders lie between 2^-64 and 2^64; what is certain has order 0.
    fine = F.when(F.col("order") > 0, F.least(F.greatest((F.log2("order") + 64.0) / 128.0, F.lit(0.0)), F.lit(1.0))).otherwise(0.0) * (float(RANGES) * RANGES)
    ranked = ranked.withColumn("fine", F.floor(fine)).withColumn("range", F.floor(F.col("fine") / RANGES)).withColumn("before", F.lit(0).cast("long"))
    first = crossing(ranked, "range")
    within = ranked.alias("d").join(first.alias("c"), same_source("d", "c") & (F.col("d.range") == F.col("c.range"))).select(
        "d.source", "d.doc_id", "d.size", "d.order", "d.due", "d.fine", "c.before"
    )
    second = crossing(within, "fine")
    inside = Window.partitionBy("source").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        within.drop("before").alias("d").join(second.alias("c"), same_source("d", "c") & (F.col("d.fine") == F.col("c.fine"))).select("d.*", "c.before")
        .withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("taken", F.col("ahead") + F.col("size") / 2.0 < F.col("due"))
        .groupBy("source").agg(
            F.min("order").alias("least"),
            F.max(F.when(F.col("taken"), F.struct("order", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id")))).alias("last"),
        )
    )
    # If nothing of the part is taken, the cut lies before its first order.
    return due.alias("s").join(last.alias("l"), same_source("s", "l"), "left").select(
        "s.source", "s.source_size", "s.target", "s.whole", "s.factor",
        F.coalesce("l.last.order", "l.least").alias("cut_order"), F.col("l.last.doc_id").alias("cut_id"),
    )


PLAN = ("source_size", "target", "whole", "factor", "cut_order", "cut_id")


def with_copies(documents: DataFrame, plan: DataFrame, seed: str = SEED) -> DataFrame:
    """``documents`` (with doc_id, source, size) and source_size, target, copies."""
    kept = [f"d.`{c}`" for c in documents.columns if c.lower() not in (*PLAN, "order", "copies")]
    joined = documents.alias("d").join(plan.alias("s"), same_source("d", "s")).select(*kept, *[f"s.{c}" for c in PLAN])
    here = F.coalesce("doc_id", F.lit(-(1 << 63)))
    under = (F.col("order") < F.col("cut_order")) | ((F.col("order") == F.col("cut_order")) & (here <= F.col("cut_id")))
    return (
        with_order(joined, seed)
        .withColumn("copies", F.col("whole") + F.coalesce(under, F.lit(False)).cast("long"))
        .drop("order", "whole", "factor", "cut_order", "cut_id")
    )
