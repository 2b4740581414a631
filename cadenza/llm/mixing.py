"""Curriculum mixing: sources whose weights change over training, met by whole documents.

Each source has a schedule of weights, linear between points of training time 0 to 1. Its integral is
the source's share of the mix; shares are of ``total`` times all words, no source gives more than
``repeats`` times its own, and what it cannot give is shared again by the others' weights. Within a
source documents follow each other in hash order, pass after pass, and the words before a document's
middle decide whether the pass still takes it. The cumulative demand of the source, inverted, gives
the moment at which a copy is due, and copies are range-sorted by it.

Sources, their sizes and targets are tables, so there may be any number of them; targets are found in
rounds, each one aggregate over the sources that are not full yet.

Null and empty texts, and texts of white space, have size 0 and are taken 0 times. A null source is a source
of its own and comes last. Repeated rows are separate documents; an empty table gives no rows. Documents
that share a key are ordered by size. Sources without a schedule are not mixed: their
target is 0. ``plan`` reads key, text and source only, so other names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cadenza.llm.common import content, numbered, stored
from cadenza.operators.pieces import running_total

WORD = r"[^\x20\x09-\x0D]+"
SCHEDULE = "source string, times array<double>, weights array<double>"


def turns(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), source: str = "source") -> DataFrame:
    """``SCHEDULE`` of all sources of ``docs`` in code-point order, null last, weighing ``weights`` in turn.

    Each begins at one and a half times its weight and ends at half of it or the other way round,
    so that the weight is the integral and the mix moves from some sources to others.
    """
    names = docs.select(F.col(source).alias("source")).distinct().orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("row") % len(weights) + 1).cast("int"))
    high = F.when(F.col("row") % 2 == 0, 1.5).otherwise(0.5)
    return numbered(names, "sources").select(
        "source", F.array(F.lit(0.0), F.lit(1.0)).alias("times"), F.array(high * weight, (2 - high) * weight).alias("weights"))


def integral(times: Column, weights: Column) -> Column:
    """Area below a schedule."""
    steps = F.sequence(F.lit(1), F.size(times) - 1)
    area = lambda i: (F.get(times, i) - F.get(times, i - 1)) * (F.get(weights, i) + F.get(weights, i - 1)) / 2
    return F.when(F.size(times) > 1, F.aggregate(F.transform(steps, area), F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)


def targets(sources: DataFrame, total: float, repeats: float) -> DataFrame:
    """``sources`` (with ``source_size`` and ``weight``; null: no schedule) with ``target``, the words each is to give.

    Shares go by weight and stop at ``repeats`` times the source's own size. A round raises the level
    (words per unit of weight) to what the sources that are not full yet must give; it ends when no
    further one is full at the new level. Levels only rise, so a source once full stays so.
    """
    most = F.col("source_size") * repeats
    mixed = sources.filter("weight > 0")
    wanted = total * (mixed.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        at = F.col("weight") * level >= most if full >= 0 else F.lit(False)
        found = mixed.agg(
            F.count_if(at), F.coalesce(F.sum(F.when(at, most)), F.lit(0.0)), F.sum(F.when(~at, F.col("weight")))).first()
        if found[0] == full or not found[2]:
            break
        full, level = found[0], max(level, (wanted - found[1]) / found[2])
    given = F.when(F.col("weight") > 0, F.least(F.col("weight") * level, most)).otherwise(0.0)
    return sources.withColumn("target", given)


def inverse_demand(schedule_times: Column, schedule_weights: Column, share: Column) -> Column:
    """Training time by which ``share`` (0 to 1) of a source's demand has come: the integral, inverted."""
    n = F.size(schedule_times)
    pieces = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(
        F.get(schedule_times, i).alias("t"), (F.get(schedule_times, i + 1) - F.get(schedule_times, i)).alias("d"),
        F.get(schedule_weights, i).alias("w"), (F.get(schedule_weights, i + 1) - F.get(schedule_weights, i)).alias("s"),
    ))
    area = lambda p: p["d"] * (p["w"] + p["s"] / 2)
    whole = F.aggregate(pieces, F.lit(0.0), lambda a, p: a + area(p))
    state = F.struct((share * whole).alias("left"), F.lit(None).cast("double").alias("time"))

    def walk(a, p):
        # Within a piece the area up to x of its width is d (w x + s x^2 / 2).
        need = a["left"] / p["d"]
        root = 2 * need / (p["w"] + F.sqrt(F.greatest(F.lit(0.0), p["w"] * p["w"] + 2 * p["s"] * need)))
        inside = F.least(F.lit(1.0), F.coalesce(root, F.lit(0.0)))
        here = a["time"].isNull() & (a["left"] <= area(p)) & (p["d"] > 0)
        return F.struct(
            F.when(here, F.lit(0.0)).otherwise(a["left"] - area(p)).alias("left"),
            F.coalesce(a["time"], F.when(here, p["t"] + p["d"] * inside)).alias("time"),
        )

    return F.coalesce(F.aggregate(pieces, state, walk)["time"], F.lit(1.0))


def plan(
    docs: DataFrame, schedules: DataFrame, total: float = 1.5, repeats: int = 2,
    key: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """One row a document: key, source, size, source_size, target, copies, taken, and the positions of its copies.

    ``schedules`` are rows of ``SCHEDULE``. ``positions`` holds the training time of each copy, ascending.
    """
    sized = stored(docs.select(
        F.col(key).alias("key"), F.col(source).alias("source"),
        F.regexp_count(content(text), F.lit(WORD)).cast("long").alias("size"), F.monotonically_increasing_id().alias("at"),
    ), "sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    known = schedules.select(F.col("source").alias("of"), "times", "weights", integral(F.col("times"), F.col("weights")).alias("weight"))
    sources = stored(sizes.join(known, F.col("source").eqNullSafe(F.col("of")), "left").drop("of"), "sources")
    settings = stored(targets(sources, total, repeats).withColumnRenamed("source", "of"), "targets")
    digest = F.md5(F.col("key").cast("string").cast("binary"))
    same = F.struct(digest.alias("digest"), "key", "size")
    # Rows that agree in all of that are alike, so any order among them gives the same rows; one key is cut too.
    upto = running_total(
        sized, ["source"], [same, F.col("at")],
        [F.substring(digest, 1, 3), same, F.shiftright("at", 16)], F.col("size"), "upto")
    joined = upto.join(settings, F.col("source").eqNullSafe(F.col("of")))
    # Pass k begins at k times the source's size; a copy is taken if its middle comes before the target.
    passes = F.sequence(F.lit(0), F.lit(repeats - 1))
    middle = lambda k: k * F.col("source_size") + F.col("upto") - F.col("size") / 2
    due = F.filter(passes, lambda k: (F.col("size") > 0) & (middle(k) <= F.col("target")))
    positions = F.transform(due, lambda k: inverse_demand(
        F.col("times"), F.col("weights"), F.least(F.lit(1.0), middle(k) / F.col("target"))))
    return joined.withColumn("positions", positions).select(
        F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target",
        F.size("positions").alias("copies"), (F.size("positions") * F.col("size")).alias("taken"), "positions",
    )


def in_training_order(copies: DataFrame, position: str = "position", *ties: str) -> DataFrame:
    """Rows range-sorted by training time, then ``ties``: each output partition is one stretch of training."""
    return copies.repartitionByRange(position, *ties).sortWithinPartitions(position, *ties)
