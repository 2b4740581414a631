"""Preference learning: a logistic model updated by mini-batch gradients.

The model is one weight per position of the input vector (audio features, day
part, session energy, constant), so it is as small as one row; the gradient is an
ordinary aggregation over the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cadenza.functions.scalars import day_part
from cadenza.functions.vectors import dot
from cadenza.operators.pieces import lookup
from cadenza.session import durable

RATE = 0.5
EXTRA_INPUTS = 5  # three day parts, session energy, constant


def inputs(vector: Column, ts: Column, session_energy: Column) -> Column:
    part = day_part(ts)
    flags = [(part == name).cast("double") for name in ("morning", "afternoon", "evening")]
    return F.concat(vector.cast("array<double>"), F.array(*flags, session_energy, F.lit(1.0)))


def training_rows(labelled: DataFrame, features: DataFrame) -> DataFrame:
    """``label, x`` of labelled events that carry ``session_energy``."""
    x = inputs(F.col("full_vector"), F.col("ts"), F.col("session_energy"))
    return labelled.join(features.select("song_id", "full_vector"), "song_id").select(
        F.col("label").cast("double").alias("label"), x.alias("x")
    )


def score(x: Column, weights: list[float]) -> Column:
    """Chance of a positive label, between 0 and 1."""
    literal = F.array(*[F.lit(float(w)) for w in weights])
    return 1 / (1 + F.exp(-dot(x, literal)))


def gradient(rows: DataFrame, weights: list[float]) -> DataFrame:
    """``position, gradient``: mean of (label - score) * input per position.

    Each task sends one partial sum per position, whatever it read.
    """
    # The miss is a column before the rows are multiplied, so it is worked out once per row.
    missed = rows.withColumn("_miss", F.col("label") - score(F.col("x"), weights))
    return (
        missed.select("_miss", F.posexplode("x").alias("position", "_x"))
        .groupBy("position").agg(F.avg(F.col("_miss") * F.col("_x")).alias("gradient"))
    )


def update(rows: DataFrame, weights: list[float], rate: float = RATE) -> list[float]:
    """Weights after one step over ``rows``; unchanged where there are none."""
    stepped = list(weights)
    for row in gradient(rows, weights).collect():  # one row per weight
        stepped[row.position] += rate * row.gradient
    return stepped


def train(rows: DataFrame, width: int, steps: int, rate: float = RATE) -> list[float]:
    """``steps`` full passes from zero weights; ``width`` is the length of ``x``."""
    if steps > 1:
        rows = durable(rows)
    weights = [0.0] * width
    for _ in range(steps):
        weights = update(rows, weights, rate)
    return weights


def preference_scores(features: DataFrame, weights: list[float], ts: Column, session_energy: Column) -> DataFrame:
    """``song_id, preference`` of every song at a time of day and session energy."""
    x = inputs(F.col("full_vector"), ts, session_energy)
    return features.select("song_id", score(x, weights).alias("preference"))


def fit_logistic(rows: DataFrame):
    """The batch alternative: MLlib's logistic regression on the same rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    prepared = rows.select("label", array_to_vector("x").alias("features"))
    return LogisticRegression(regParam=0.01).fit(prepared)


# One model per listener: keyed rows, updated by one grouped gradient.

MODELS = "listener string, version bigint, weights array<double>"


def listener_rows(labelled: DataFrame, features: DataFrame) -> DataFrame:
    """``listener, label, x`` of labelled events that carry ``session_energy``."""
    x = inputs(F.col("full_vector"), F.col("ts"), F.col("session_energy"))
    return labelled.join(features.select("song_id", "full_vector"), "song_id").select(
        "listener", F.col("label").cast("double").alias("label"), x.alias("x")
    )


def current_models(models: DataFrame) -> DataFrame:
    """``listener, weights`` of the last version of every listener in ``models`` (rows of ``MODELS``)."""
    return models.groupBy("listener").agg(F.max_by("weights", "version").alias("weights"))


def step_listeners(rows: DataFrame, models: DataFrame, version: int, rate: float = RATE) -> DataFrame:
    """Rows of ``MODELS``: the models of all listeners in ``rows`` (``listener, label, x``) after one step.

    ``models`` are their models so far, zero where there is none. The gradient is a mean per listener
    and position: every task sends one partial sum for each, so a listener with a third of all rows
    is no different from others. Listeners without rows keep their version.
    """
    known = current_models(models).withColumnRenamed("weights", "_weights")
    given = rows.join(lookup(known), "listener", "left")
    zeros = F.transform("x", lambda x: F.lit(0.0))
    weights = F.coalesce("_weights", zeros)
    missed = given.withColumn("_miss", F.col("label") - 1 / (1 + F.exp(-dot(F.col("x"), weights))))
    steps = (
        missed.select("listener", "_miss", F.posexplode("x").alias("position", "_x"))
        .groupBy("listener", "position").agg(F.avg(F.col("_miss") * F.col("_x")).alias("gradient"))
    )
    lists = steps.groupBy("listener").agg(F.array_sort(F.collect_list(F.struct("position", "gradient"))).alias("_steps"))
    moved = lists.join(known, "listener", "left").withColumn("_from", F.coalesce("_weights", F.transform("_steps", lambda s: F.lit(0.0))))
    return moved.select(
        "listener", F.lit(version).cast("bigint").alias("version"),
        F.zip_with("_from", "_steps", lambda w, s: w + rate * s["gradient"]).alias("weights"),
    )
