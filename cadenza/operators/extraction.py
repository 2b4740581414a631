"""From decoded recordings to feature rows, file by file, and the indexing job over them.

A file that cannot be analysed is one row with its reason; it never fails the others. Reasons are found
from the chunks alone, before any signal work, so a broken file costs one pass over its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cadenza.operators import dsp
from cadenza.operators.features import song_features
from cadenza.operators.indexing import IndexRun, index_files
from cadenza.operators.pieces import lookup
from cadenza.session import durable


def file_errors(pcm: DataFrame, sr: int = dsp.SAMPLE_RATE) -> DataFrame:
    """``file_path, error`` of every file of ``pcm`` (``file_path, chunk_idx, sr, samples``); null: sound.

    A file is sound if its chunks are numbered 0, 1, 2, ... once each, have the rate ``sr``, hold
    finite numbers only and at least one of them. Silence is sound. Only flags are shuffled.
    """
    bad = F.exists("samples", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    chunks = pcm.groupBy("file_path", "chunk_idx").agg(
        F.count(F.lit(1)).alias("copies"),
        F.max((F.col("sr") != sr) | F.col("sr").isNull()).alias("off_rate"),
        F.max(F.coalesce(bad, F.lit(False))).alias("bad"),
        F.max(F.col("samples").isNull()).alias("unread"),
        F.sum(F.coalesce(F.size("samples"), F.lit(0)).cast("bigint")).alias("n"),
    )
    files = chunks.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("chunks"), F.max("copies").alias("copies"), F.min("chunk_idx").alias("first"),
        F.max("chunk_idx").alias("last"), F.count_if(F.col("chunk_idx").isNull()).alias("unnumbered"),
        *[F.max(name).alias(name) for name in ("off_rate", "bad", "unread")],
        F.sum(F.greatest("n", F.lit(0))).alias("n"),
    )
    gaps = (F.col("unnumbered") > 0) | (F.col("first") != 0) | (F.col("last") + 1 != F.col("chunks"))
    return files.select("file_path", F.when(gaps, "Chunks are missing")
                        .when(F.col("copies") > 1, "Chunks are repeated")
                        .when(F.col("unread"), "Chunks cannot be decoded")
                        .when(F.col("off_rate"), f"Sample rate is not {sr}")
                        .when(F.col("bad"), "Samples are not finite numbers")
                        .when(F.col("n") == 0, "No audio").alias("error"))


def extract(
    pcm: DataFrame, as_of=None, sr: int = dsp.SAMPLE_RATE, frame: int = dsp.FRAME, hop: int = dsp.HOP
) -> DataFrame:
    """``file_path, error`` and the feature columns of every file of ``pcm``; those of a failed file are null."""
    checked = durable(file_errors(pcm, sr))
    sound = checked.filter(F.col("error").isNull()).select("file_path")
    songs = pcm.join(lookup(sound), "file_path").withColumnRenamed("file_path", "song_id")
    frames, tempo = dsp.analyse(songs, sr, frame, hop)
    rows = song_features(frames, tempo, as_of).withColumnRenamed("song_id", "file_path").drop("extracted_at")
    return checked.join(rows, "file_path", "left")


def index_audio(
    requested: DataFrame, listing: DataFrame, songs: DataFrame, features: DataFrame, pcm: DataFrame,
    as_of=None, force: bool = False, sr: int = dsp.SAMPLE_RATE, frame: int = dsp.FRAME, hop: int = dsp.HOP,
) -> IndexRun:
    """``index_files`` over decoded recordings: only files that the job has to extract are analysed.

    Those are the requested ones that exist and, without ``force``, have no features yet.
    """
    wanted = requested.select("file_path").distinct().join(listing.select("file_path"), "file_path", "left_semi")
    if not force:
        done = songs.join(features.select(F.col("song_id").alias("id")), "id", "left_semi")
        wanted = wanted.join(done.select("file_path"), "file_path", "left_anti")
    needed = pcm.join(lookup(wanted), "file_path", "left_semi")
    analysed = durable(extract(needed, as_of, sr, frame, hop))
    return index_files(requested, listing, songs, features, analysed, as_of, force)
