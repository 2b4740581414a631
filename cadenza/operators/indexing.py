"""The indexing job: one outcome per requested path, restartable, and its report."""

from __future__ import annotations

from datetime import datetime, timezone
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from cadenza.operators.catalog import register_paths, upsert_features
from cadenza.operators.features import stamp
from cadenza.operators.pieces import lookup
from cadenza.session import durable

SECONDS_PER_SONG = 2  # fixed value: rate behind the remaining-time estimate

EXTRACTED, INDEXED, FAILED, MISSING = "extracted", "already indexed", "error", "missing"


class IndexRun(NamedTuple):
    outcomes: DataFrame
    songs: DataFrame
    features: DataFrame


def index_files(
    requested: DataFrame, listing: DataFrame, songs: DataFrame, features: DataFrame,
    analysed: DataFrame, as_of=None, force: bool = False,
) -> IndexRun:
    """Index every path of ``requested`` (``seq, file_path``) once.

    ``listing`` holds the paths that exist. ``analysed`` is what extraction gives
    per path: the feature columns, and ``error`` where it failed; a path it does
    not have failed without a message. A missing file makes no song row; a failed
    one keeps the row just registered and is tried again by the next run. With
    ``force`` songs that have features are extracted again. The result per path is
    written once and all three tables are made from it, with one clock.
    """
    as_of = datetime.now(timezone.utc) if as_of is None else as_of
    columns = [c for c in features.columns if c not in ("song_id", "extracted_at")]
    per_path = requested.groupBy("file_path").agg(F.min("seq").alias("_first"))
    per_path = per_path.join(
        listing.select("file_path").distinct().withColumn("_exists", F.lit(True)), "file_path", "left"
    )
    present = per_path.filter("_exists").select("file_path")
    registered = songs.unionByName(register_paths(present, songs, as_of).select(*songs.columns))

    known = registered.select("file_path", F.col("id").alias("song_id"))
    done = features.select("song_id").withColumn("_done", F.lit(True))
    results = analysed.select("file_path", "error", *columns).withColumn("_analysed", F.lit(True))
    paths = (
        per_path.join(known, "file_path", "left").join(done, "song_id", "left")
        .join(results, "file_path", "left")
    )
    skip = F.col("_done").isNotNull() & F.lit(not force)
    failed = F.col("_analysed").isNull() | F.col("error").isNotNull()
    paths = durable(paths.withColumn(
        "_result",
        F.when(F.col("_exists").isNull(), MISSING).when(skip, INDEXED).when(failed, FAILED).otherwise(EXTRACTED),
    ))

    result = F.col("_result")
    again = (result == EXTRACTED) & (F.col("seq") > F.col("_first")) & F.lit(not force)
    outcomes = requested.join(
        lookup(paths.select("file_path", "song_id", "_first", "_result", "error")), "file_path"
    ).select(
        "seq",
        "file_path",
        F.when(result != MISSING, F.col("song_id")).alias("song_id"),
        F.when(again, INDEXED).when(result == MISSING, FAILED).otherwise(result).alias("status"),
        (~again & (result == EXTRACTED)).alias("features_extracted"),
        F.when(result == MISSING, "File not found")
        .when(result == FAILED, F.coalesce("error", F.lit("No audio could be read"))).alias("error"),
        F.when(again | (result == INDEXED), "Already indexed").alias("message"),
    )

    extracted = paths.filter(result == EXTRACTED).select("song_id", *columns, F.col("_first").alias("_version"))
    saved = upsert_features(features, extracted, "_version", as_of)
    return IndexRun(outcomes, stamp(registered, extracted, as_of), saved)


def index_one(path: str, listing, songs, features, analysed, as_of=None, force: bool = False) -> IndexRun:
    """The same job for a single path."""
    request = listing.sparkSession.range(1).select(F.col("id").alias("seq"), F.lit(path).alias("file_path"))
    return index_files(request, listing, songs, features, analysed, as_of, force)


def index_status(log: DataFrame) -> DataFrame:
    """One-row report of a job log (``file_path, started_at, finished_at``).

    ``completed`` counts attempts that ended, failed ones too.
    """
    counted = log.agg(
        F.count(F.lit(1)).cast("int").alias("total"),
        F.count_if(F.col("finished_at").isNotNull()).cast("int").alias("completed"),
        F.max(F.when(F.col("finished_at").isNull(), F.struct("started_at", "file_path")))
        .getField("file_path").alias("current_file"),
    )
    running = F.col("completed") < F.col("total")
    return counted.select(
        "total", "completed", "current_file",
        F.when(running, (F.col("total") - F.col("completed")) * SECONDS_PER_SONG).otherwise(0).alias("eta_seconds"),
        F.when(running, "running").otherwise("idle").alias("status"),
    )


def index_progress(status: DataFrame) -> DataFrame:
    """Share done (0 for an empty job), its percent text, and whether all is done."""
    ratio = F.when(F.col("total") > 0, F.col("completed") / F.col("total")).otherwise(F.lit(0.0))
    done = (F.col("status") == "idle") & (F.col("completed") == F.col("total")) & (F.col("total") > 0)
    return status.select(
        "*", ratio.alias("ratio"),
        F.concat(F.format_string("%.1f", ratio * 100), F.lit("%")).alias("percent"),
        done.alias("is_done"),
    )


def index_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("status").agg(F.count(F.lit(1)).alias("files"))
