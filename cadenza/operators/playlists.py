"""Playlist import: paths to songs, positions without gaps, all files at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cadenza.functions.scalars import now, random_id, stable_id
from cadenza.operators.catalog import unique_paths
from cadenza.operators.pieces import lookup, number_rows, span
from cadenza.session import durable

LINES_PER_PIECE = 65536


def _known(entries: DataFrame, songs: DataFrame) -> DataFrame:
    return entries.join(lookup(unique_paths(songs).withColumnRenamed("file_path", "path")), "path")


def resolve(entries: DataFrame, songs: DataFrame, order: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """Known entries with their song, numbered 0, 1, 2, … per playlist.

    ``entries``: ``playlist_id, path`` and the ``order`` columns, the first of
    which is a line number. Unknown paths are skipped and take no number.
    """
    return _numbered(_known(entries, songs), order)


def _numbered(known: DataFrame, order) -> DataFrame:
    piece = span(F.col(order[0]), LINES_PER_PIECE)
    numbered = number_rows(known, ["playlist_id"], list(order), [piece], "position")
    return numbered.withColumn("position", F.col("position").cast("int"))


def rejected(entries: DataFrame, songs: DataFrame) -> DataFrame:
    """Playlists whose import fails because one song is in them twice."""
    return _repeating(_known(entries, songs))


def _repeating(known: DataFrame) -> DataFrame:
    repeated = known.groupBy("playlist_id", "song_id").agg(F.count(F.lit(1)).alias("times"))
    return (
        repeated.filter("times > 1").groupBy("playlist_id")
        .agg(F.count(F.lit(1)).alias("repeated_songs"))
    )


def import_entries(
    entries: DataFrame, songs: DataFrame, order: tuple[str, ...] = ("line_no",), on_duplicate: str = "fail"
) -> DataFrame:
    """``playlist_id, song_id, position`` of every playlist that can be imported.

    ``on_duplicate="fail"`` drops a playlist that repeats a song as a whole (see
    ``rejected``); ``"first"`` keeps the first place of each song. The looked-up
    entries are written once: counting, rejecting and numbering all read them.
    """
    known = _known(entries, songs).select("playlist_id", "song_id", *order)
    if on_duplicate == "fail":
        known = durable(known)
        kept = known.join(lookup(_repeating(known)), "playlist_id", "left_anti")
    elif on_duplicate == "first":
        firsts = known.groupBy("playlist_id", "song_id").agg(F.min(F.struct(*order)).alias("_at"))
        kept = durable(firsts.select("playlist_id", "song_id", "_at.*"))
    else:
        raise ValueError("on_duplicate is 'fail' or 'first'")
    return _numbered(kept, order).select("playlist_id", "song_id", "position")


def headers(playlists: DataFrame, as_of=None, key: Column | None = None) -> DataFrame:
    """Header rows for ``playlists`` (``name``); ids are random unless ``key`` is given."""
    return playlists.select(
        (random_id() if key is None else stable_id(key)).alias("id"),
        "name",
        F.lit("manual").alias("type"),
        now(as_of).alias("created_at"),
        F.lit("{}").alias("metadata"),
    )


def genre_distribution(playlist_songs: DataFrame, genres: DataFrame) -> DataFrame:
    """Songs and share of each genre per playlist; ``genres``: ``song_id, genre``."""
    counted = (
        playlist_songs.join(genres, "song_id").groupBy("playlist_id", "genre")
        .agg(F.count(F.lit(1)).alias("songs"))
    )
    # At most one row per genre reaches this window.
    total = F.sum("songs").over(Window.partitionBy("playlist_id"))
    return counted.withColumn("share", F.col("songs") / total)
