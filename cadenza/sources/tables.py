"""Catalog tables: readers with fixed schemas, writers that reruns do not break."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cadenza import schemas
from cadenza.functions.vectors import from_text, to_text
from cadenza.operators.pieces import lookup

AUDIO_FILES = "*.{mp3,flac,m4a,wav,MP3,FLAC,M4A,WAV}"
_VECTORS = ("mfcc_vector", "chroma_vector", "contrast_vector", "full_vector")


def read_songs(spark: SparkSession, path: str) -> DataFrame:
    """All songs, of tables in one piece or written in batches."""
    if (batches := _commits(spark, path)) is not None:
        return _committed(spark, path, schemas.SONGS, batches).select(*schemas.SONGS.names)
    return spark.read.schema(schemas.SONGS).parquet(path).select(*schemas.SONGS.names)


def read_features(spark: SparkSession, path: str, as_text: bool = False) -> DataFrame:
    """All feature rows; ``as_text`` for tables that hold vectors as JSON arrays."""
    if not as_text:
        return spark.read.schema(schemas.SONG_FEATURES).parquet(path)
    return features_from_text(spark.read.schema(schemas.SONG_FEATURES_TEXT).parquet(path))


def features_from_text(rows: DataFrame) -> DataFrame:
    return rows.select(*[
        from_text(F.col(c)).alias(c) if c in _VECTORS else F.col(c) for c in rows.columns
    ])


def features_to_text(rows: DataFrame) -> DataFrame:
    return rows.select(*[to_text(F.col(c)).alias(c) if c in _VECTORS else F.col(c) for c in rows.columns])


def read_pcm(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PCM_CHUNKS).parquet(path)


def list_audio_files(spark: SparkSession, folder: str) -> DataFrame:
    """``file_path, bytes, modified_at`` of all audio files; contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", AUDIO_FILES).load(folder)
    )
    return files.select(
        F.regexp_replace("path", r"^file:/+", "/").alias("file_path"),
        F.col("length").alias("bytes"), F.col("modificationTime").alias("modified_at"),
    )


# Tables written in batches: every attempt at a batch has a folder of its own, and a pointer, one row appended
# to the table's commits, says which attempt counts. A reader goes by the commits it finds when it starts:
# it sees a batch that is written again either as it was or as it is, and never an attempt that failed.

COMMITS = "batch string, attempt string, number bigint"


def commit_batch(rows: DataFrame, path: str, batch: str, written: Callable[[], None] = lambda: None) -> None:
    """Write ``rows`` as the batch; ``written`` is called when they are there but do not count yet.

    The pointer is one file that appears by a rename. Attempts that no longer count stay for readers that
    have begun before; ``superseded`` names them.
    """
    spark, attempt = rows.sparkSession, uuid.uuid4().hex
    rows.write.parquet(f"{path}/data/batch={quote(batch, safe='')}/attempt={attempt}")
    written()
    before = _commits(spark, path)
    number = 1 if before is None else 1 + before.agg(F.max("number")).first()[0]
    pointer = spark.createDataFrame([(batch, attempt, number)], COMMITS).coalesce(1)
    pointer.write.mode("append").parquet(f"{path}/commits")


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    """All pointers of a table; None for a table without any."""
    try:
        return spark.read.schema(COMMITS).parquet(f"{path}/commits")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _committed(spark: SparkSession, path: str, schema: StructType, commits: DataFrame) -> DataFrame:
    """Rows of the attempts that count, with the ``batch`` and ``number`` of their commit."""
    last = commits.groupBy("batch").agg(F.max_by(F.struct("attempt", "number"), "number").alias("_last"))
    last = last.select(F.col("batch").alias("_of"), "_last.*")
    folders = [StructField("batch", StringType()), StructField("attempt", StringType())]
    rows = spark.read.schema(StructType([*schema.fields, *folders])).parquet(f"{path}/data")
    return rows.drop("batch").join(last, "attempt").drop("attempt").withColumnRenamed("_of", "batch")


def read_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows that were committed, with the ``batch`` and ``number`` of their commit; none before the first."""
    if (commits := _commits(spark, path)) is None:
        return spark.createDataFrame([], StructType([*schema.fields, StructField("batch", StringType()), StructField("number", LongType())]))
    return _committed(spark, path, schema, commits)


def superseded(spark: SparkSession, path: str) -> DataFrame:
    """``batch, attempt`` of committed attempts that another one has replaced: what a clean-up may delete."""
    commits = _commits(spark, path)
    if commits is None:
        return spark.createDataFrame([], "batch string, attempt string")
    last = commits.groupBy("batch").agg(F.max("number").alias("_last"))
    return commits.join(last, "batch").filter("number < _last").select("batch", "attempt")


def append_songs(songs: DataFrame, path: str, batch: str, written: Callable[[], None] = lambda: None) -> None:
    """One batched insert; run again under the same name, it is still one."""
    commit_batch(songs, path, batch, written)


def write_playlist_songs(entries: DataFrame, folder: str, batch: str) -> None:
    """First half of an import: entries, not seen until ``write_playlists``."""
    commit_batch(entries, f"{folder}/playlist_songs", batch)


def write_playlists(headers: DataFrame, folder: str, batch: str) -> None:
    """Second half of an import: a playlist exists from the moment its header does.

    The ids must be those of the entries, so random ones have to be stored before.
    """
    commit_batch(headers, f"{folder}/playlists", batch)


def read_playlist_songs(spark: SparkSession, folder: str) -> DataFrame:
    """Entries whose playlist the same import committed; what a failed one left is not seen.

    A playlist that several imports have committed is that of the last one.
    """
    headers = read_batches(spark, f"{folder}/playlists", schemas.PLAYLISTS)
    owner = headers.groupBy(F.col("id").alias("playlist_id")).agg(F.max_by("batch", F.struct("number", "batch")).alias("batch"))
    entries = read_batches(spark, f"{folder}/playlist_songs", schemas.PLAYLIST_SONGS)
    return entries.join(lookup(owner), ["playlist_id", "batch"], "left_semi").select(*schemas.PLAYLIST_SONGS.names)


def publish(df: DataFrame, folder: str, version: str) -> str:
    """Write a new version of a table beside the old ones and return its path.

    Plain files cannot be merged in place; readers are pointed to the new path
    once the write has ended.
    """
    path = f"{folder}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def write_daily_picks(picks: DataFrame, pick_date: str, path: str) -> None:
    """Replace one day's picks and leave the other days alone."""
    (
        picks.withColumn("pick_date", F.lit(pick_date)).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("pick_date").parquet(path)
    )


def read_daily_picks(spark: SparkSession, path: str, pick_date: str) -> DataFrame:
    return spark.read.schema(schemas.DAILY_PICKS).parquet(path).filter(F.col("pick_date") == pick_date)


def stale(picks: DataFrame) -> bool:
    """True when a day has no picks yet and they are to be generated."""
    return picks.isEmpty()


def picks_of_day(spark: SparkSession, path: str, pick_date: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The day's stored picks, made and stored first where there are none."""
    try:
        found = read_daily_picks(spark, path, pick_date)
        if not stale(found):
            return found
    except AnalysisException as error:  # the first day of all
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    write_daily_picks(make(), pick_date, path)
    return read_daily_picks(spark, path, pick_date)
