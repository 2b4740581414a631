"""Frame tables to song features: pooling, scalars, the unified vector, the tag."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cadenza.functions.scalars import mood_tag, now
from cadenza.functions.vectors import assemble, average
from cadenza.operators.catalog import patch

# Coefficients per frame of the three blocks.
MFCC, CHROMA, CONTRAST = 20, 12, 7


def pool(frames: DataFrame, vector: str, width: int | None = None) -> DataFrame:
    """``song_id, means, stds``: mean and population deviation per coefficient over all frames.

    With a known ``width`` every coefficient is an aggregate of its own and no row
    is multiplied; else the coefficients become rows, reduced to one partial state
    per (song, coefficient) before the shuffle.
    """
    if width is not None:
        cells = [F.element_at(vector, i + 1) for i in range(width)]
        pooled = frames.groupBy("song_id").agg(
            *[F.avg(c).alias(f"_mean{i}") for i, c in enumerate(cells)],
            *[F.stddev_pop(c).alias(f"_std{i}") for i, c in enumerate(cells)],
        )
        listed = lambda name: F.array(*[F.col(f"{name}{i}") for i in range(width)])
        return pooled.select("song_id", listed("_mean").alias("means"), listed("_std").alias("stds"))
    by_place = (
        frames.select("song_id", F.posexplode(vector).alias("_place", "_x"))
        .groupBy("song_id", "_place")
        .agg(F.avg("_x").alias("_mean"), F.stddev_pop("_x").alias("_std"))
    )
    lists = by_place.groupBy("song_id").agg(
        F.array_sort(F.collect_list(F.struct("_place", "_mean", "_std"))).alias("_cells")
    )
    return lists.select("song_id", F.col("_cells._mean").alias("means"), F.col("_cells._std").alias("stds"))


def pooled_vector(frames: DataFrame, vector: str, name: str) -> DataFrame:
    """``song_id`` and the means of ``vector`` followed by its deviations."""
    return pool(frames, vector).select("song_id", F.concat("means", "stds").alias(name))


def scalar_means(frames: DataFrame) -> DataFrame:
    return frames.groupBy("song_id").agg(F.avg("rms").alias("energy"), F.avg("zcr").alias("zcr"))


def song_features(frames: DataFrame, tempo: DataFrame, as_of=None) -> DataFrame:
    """Complete feature rows from ``frames`` and per-song ``tempo``.

    The three blocks are pooled as one array and cut apart afterwards, so the
    frames are read and shuffled once.
    """
    joined = frames.withColumn("_all", F.concat("mfcc", "chroma", "contrast", F.array("rms", "zcr")))
    pooled = pool(joined, "_all", MFCC + CHROMA + CONTRAST + 2)

    def block(start, width):
        return F.concat(F.slice("means", start + 1, width), F.slice("stds", start + 1, width))

    scalars = MFCC + CHROMA + CONTRAST
    chroma_mean = average(F.slice("means", MFCC + 1, CHROMA))
    rows = pooled.join(tempo.select("song_id", "tempo"), "song_id").select(
        "song_id",
        block(0, MFCC).alias("mfcc_vector"),
        block(MFCC, CHROMA).alias("chroma_vector"),
        block(MFCC + CHROMA, CONTRAST).alias("contrast_vector"),
        F.col("tempo").cast("double").alias("tempo"),
        F.element_at("means", scalars + 1).alias("energy"),
        F.element_at("means", scalars + 2).alias("zcr"),
        chroma_mean.alias("_brightness"),
    )
    rows = rows.withColumn("valence_proxy", F.col("_brightness") * F.col("energy")).drop("_brightness")
    parts = ["mfcc_vector", "chroma_vector", "contrast_vector", "tempo", "energy", "zcr", "valence_proxy"]
    return rows.withColumn("full_vector", assemble(*[F.col(c) for c in parts])).withColumn(
        "extracted_at", now(as_of)
    )


def stamp(songs: DataFrame, features: DataFrame, as_of=None) -> DataFrame:
    """Songs with the tag and time of their indexing; others unchanged."""
    changes = features.select(
        F.col("song_id").alias("id"),
        mood_tag(F.col("energy"), F.col("tempo")).alias("genre_tag"),
        now(as_of).alias("indexed_at"),
    )
    return patch(songs, changes)
