"""Listening behaviour in batch: labels, counts, sessions, mood shifts and targets.

Events: ``id, listener, song_id, event_type, skip_position_pct, ts``. Event types
are ``play``, ``skip`` and ``replay``; percentages run from 0 to 100.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cadenza.operators.pieces import PIECE, number_rows, running_total, span, time_span, with_halo
from cadenza.session import durable

# Fixed values of the behaviour rules.
PLAYED_PCT = 80
SKIPPED_PCT = 20
SHIFT_SKIPS = 3
SHIFT_SECONDS = 60
TARGET_SONGS = 10

PIECE_SECONDS = 86400
_ORDINALS_PER_PIECE = 4096
IN_ORDER = ["ts", "id"]


def from_logs(logs: DataFrame) -> DataFrame:
    """Rows of the documented log table (``session_id``, ``timestamp``) under the names used here.

    That table does not say who listened: without a ``listener`` the session stands for one.
    """
    columns = logs.columns
    if "timestamp" in columns and "ts" not in columns:
        logs = logs.withColumnRenamed("timestamp", "ts")
    if "session_id" in columns and "listener" not in columns:
        logs = logs.withColumn("listener", F.col("session_id"))
    return logs


def label(event_type: Column, pct: Column) -> Column:
    """1 = played past 80 %, 0 = skipped before 20 %, null = says nothing."""
    skipped = event_type == "skip"
    return F.when(~skipped & (pct > PLAYED_PCT), 1).when(skipped & (pct < SKIPPED_PCT), 0)


def label_events(events: DataFrame) -> DataFrame:
    labelled = events.withColumn("label", label(F.col("event_type"), F.col("skip_position_pct")))
    return labelled.filter(F.col("label").isNotNull())


def merge_stores(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Events of several stores, one row per event key, the lowest id kept."""
    key = ["listener", "song_id", "event_type", "ts"]
    rest = [c for c in first.columns if c not in key]
    everything = reduce(DataFrame.unionByName, others, first)
    kept = everything.groupBy(*key).agg(F.min(F.struct("id", *[c for c in rest if c != "id"])).alias("_kept"))
    return kept.select(*key, "_kept.*").select(*first.columns)


def play_counts(events: DataFrame, keys: tuple[str, ...] = ("song_id",)) -> DataFrame:
    """Plays, skips, replays and last time heard per song (or listener and song)."""
    kind = F.col("event_type")
    return events.groupBy(*keys).agg(
        F.count_if(kind == "play").alias("plays"),
        F.count_if(kind == "skip").alias("skips"),
        F.count_if(kind == "replay").alias("replays"),
        F.max(F.when(kind != "skip", F.col("ts"))).alias("last_played"),
    )


def preference(labelled: DataFrame, keys: tuple[str, ...] = ("listener", "song_id")) -> DataFrame:
    """Share of positive labels with one more of each added: 0.5 where none is known."""
    return labelled.groupBy(*keys).agg(
        ((F.sum("label") + 1) / (F.count(F.lit(1)) + 2)).alias("preference")
    )


def sessionize(events: DataFrame, gap_seconds: float, piece_seconds: float = PIECE_SECONDS) -> DataFrame:
    """Add ``session_no`` (1, 2, …) per listener: a gap longer than ``gap_seconds`` splits.

    The event before the first one of a time piece is the last of the latest
    earlier piece that has any, and one row per piece is enough to know it.
    """
    cut = events.withColumn(PIECE, time_span(F.col("ts"), piece_seconds))
    by_piece = Window.partitionBy("listener").orderBy(PIECE)
    borders = (
        cut.groupBy("listener", PIECE).agg(F.max("ts").alias("_last"))
        .select("listener", PIECE, F.lag("_last").over(by_piece).alias("_carried"))
    )
    inside = Window.partitionBy("listener", PIECE).orderBy(*IN_ORDER)
    before = F.coalesce(F.lag("ts").over(inside), F.col("_carried"))
    gap = F.unix_micros("ts") - F.unix_micros(before)
    opened = (
        cut.join(borders, ["listener", PIECE])
        .withColumn("_opens", F.coalesce(gap > int(gap_seconds * 1_000_000), F.lit(True)).cast("int"))
        .drop("_carried")
    )
    # Same pieces as above, so the rows are shuffled once.
    return running_total(opened, ["listener"], IN_ORDER, [F.col(PIECE)], F.col("_opens"), "session_no").drop("_opens", PIECE)


def session_summary(events: DataFrame, features: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Dominant genre (ties by name), average energy and bounds of each session.

    All events count and set the bounds; genre and energy come from the songs that have
    features, and are null where none has.
    """
    by_genre = (
        events.join(features.select("song_id", "genre", "energy"), "song_id", "left")
        .groupBy(*keys, "genre").agg(
            F.count(F.lit(1)).alias("_n"), F.count("energy").alias("_known"), F.sum("energy").alias("_energy"),
            F.min("ts").alias("_start"), F.max("ts").alias("_end"),
        )
    )
    return by_genre.groupBy(*keys).agg(
        _dominant().alias("dominant_genre"), _average().alias("avg_energy"), F.sum("_n").alias("events"), F.min("_start").alias("started_at"), F.max("_end").alias("ended_at"),
    )


def _dominant() -> Column:
    """The genre with most events, ties by name; null is no genre."""
    known = F.when(F.col("genre").isNotNull(), F.struct(-F.col("_n"), F.col("genre")))
    return F.min(known).getField("genre")


def _average() -> Column:
    return F.sum("_energy") / F.nullif(F.sum("_known"), F.lit(0))


def skip_runs(
    events: DataFrame, skips: int = SHIFT_SKIPS, seconds: float = SHIFT_SECONDS,
    piece_seconds: float = PIECE_SECONDS, key: str = "listener",
) -> DataFrame:
    """Add ``completes_run``: this skip ends ``skips`` in a row within ``seconds``."""
    return _runs_in_pieces(events, skips, seconds, piece_seconds, key).drop(PIECE)


def _runs_in_pieces(events, skips, seconds, piece_seconds, key):
    width = max(piece_seconds, seconds) * 1_000_000
    cut = with_halo(events, F.unix_micros("ts"), seconds * 1_000_000, width)
    inside = Window.partitionBy(key, PIECE).orderBy(*IN_ORDER)
    is_skip = (F.col("event_type") == "skip").cast("int")
    run = reduce(lambda total, i: total + F.lag(is_skip, i).over(inside), range(1, skips), is_skip)
    took = F.unix_micros("ts") - F.unix_micros(F.lag("ts", skips - 1).over(inside))
    hit = F.coalesce((run == skips) & (took <= int(seconds * 1_000_000)), F.lit(False))
    return cut.withColumn("completes_run", hit).filter(~F.col("_halo")).drop("_halo")


def mood_shifts(
    events: DataFrame, skips: int = SHIFT_SKIPS, seconds: float = SHIFT_SECONDS,
    reset: bool = True, piece_seconds: float = PIECE_SECONDS, key: str = "listener",
) -> DataFrame:
    """Skips at which the listener's mood is taken to have shifted.

    With ``reset`` a shift uses up its skips: the next one needs as many new ones.
    Without, every further skip of a longer run counts again.
    """
    runs = _runs_in_pieces(events, skips, seconds, piece_seconds, key)
    if not reset:
        return runs.filter("completes_run").drop("completes_run", PIECE)
    numbered = number_rows(runs, [key], IN_ORDER, [F.col(PIECE)], "_ordinal").drop(PIECE)
    # Few events complete a run; written once, they are linked without reading all events again.
    hits = durable(numbered.filter("completes_run").drop("completes_run"))
    fired = _spaced(hits.select(key, "_ordinal"), key, skips)
    return hits.join(fired, [key, "_ordinal"], "left_semi").drop("_ordinal")


def _spaced(hits: DataFrame, key: str, stride: int) -> DataFrame:
    """Hits taken greedily from the first, each ``stride`` ordinals after the last.

    Which hits of a piece are taken depends on the pieces before only through how
    many of its first ordinals are blocked: fewer than ``stride`` cases. Each piece
    works out all of them; the pieces are then linked, and most need no link as
    they end the same way in every case.
    """
    width = _ORDINALS_PER_PIECE
    lists = hits.groupBy(key, span(F.col("_ordinal"), width).alias(PIECE)).agg(
        F.array_sort(F.collect_list("_ordinal")).alias("_hits")  # at most ``width`` entries
    )
    start = F.col(PIECE) * width

    def free_after(blocked: int) -> Column:
        return F.aggregate(
            "_hits", start + blocked, lambda free, o: F.when(o >= free, o + stride).otherwise(free)
        )

    ends = lists.select(
        key, PIECE, "_hits", start.alias("_start"), F.array(*[free_after(b) for b in range(stride)]).alias("_free")
    )
    # A piece is open to the next if what is free after it depends on how it began.
    same = F.array_min("_free") == F.array_max("_free")
    order = Window.partitionBy(key).orderBy(PIECE)
    linked = F.coalesce(~F.lag(same).over(order) & (F.lag(PIECE).over(order) == F.col(PIECE) - 1), F.lit(False))
    carried = F.coalesce(F.when(~linked, F.lag(F.element_at("_free", 1)).over(order)), F.lit(0))
    marked = ends.withColumn("_linked", linked).withColumn("_carried", carried)
    segments = marked.withColumn(
        "_segment", F.sum((~F.col("_linked")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    )

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(PIECE)
        free, begins = int(pdf._carried.iloc[0]), []
        for start_at, ends_at in zip(pdf._start, pdf._free):
            begins.append(free)
            free = int(ends_at[min(max(free - start_at, 0), stride - 1)])
        return pdf[[key, PIECE]].assign(_begin=np.array(begins, dtype="int64"))

    kind = hits.schema[key].dataType.simpleString()
    chained = (
        segments.filter("_linked").select(key, "_segment").distinct()
        .join(segments.select(key, "_segment", PIECE, "_start", "_free", "_carried"), [key, "_segment"])
        .groupBy(key, "_segment").applyInPandas(link, f"`{key}` {kind}, {PIECE} bigint, _begin bigint")
    )
    begun = segments.join(chained, [key, PIECE], "left").withColumn("_begin", F.coalesce("_begin", "_carried"))
    taken = F.aggregate(
        "_hits",
        F.struct(F.col("_begin").alias("free"), F.array().cast("array<bigint>").alias("taken")),
        lambda acc, o: F.when(
            o >= acc.free,
            F.struct((o + stride).alias("free"), F.array_append(acc.taken, o).alias("taken")),
        ).otherwise(acc),
        lambda acc: acc.taken,
    )
    return begun.select(key, F.explode(taken).alias("_ordinal"))


def mood_targets(
    events: DataFrame, shifts: DataFrame, features: DataFrame, last: int = TARGET_SONGS,
    piece_seconds: float = PIECE_SECONDS,
) -> DataFrame:
    """Energy and genre of the last songs each listener did not skip before a shift.

    Events that are not skips are counted along each listener's events; a shift then
    needs the ``last`` counts up to its own, an equality join of that many rows. Songs
    without features are among the ``last`` and in ``songs``, but say nothing of energy and
    genre; these are null where no song has any.
    """
    heard = (F.col("event_type") != "skip").cast("int")
    counted = running_total(
        events, ["listener"], IN_ORDER, [time_span(F.col("ts"), piece_seconds)], heard, "_count"
    )
    songs = counted.filter(F.col("event_type") != "skip").select("listener", "_count", "song_id")
    wanted = F.sequence(F.greatest(F.col("_count") - (last - 1), F.lit(1)), F.col("_count"))
    asked = (
        counted.select("listener", "id", "_count").filter("_count > 0")
        .join(shifts.select("listener", "id"), ["listener", "id"], "left_semi")
        .select("listener", F.col("id").alias("shift_id"), F.explode(wanted).alias("_count"))
    )
    by_genre = (
        asked.join(songs, ["listener", "_count"])
        .join(features.select("song_id", "genre", "energy"), "song_id", "left")
        .groupBy("listener", "shift_id", "genre")
        .agg(F.count(F.lit(1)).alias("_n"), F.count("energy").alias("_known"), F.sum("energy").alias("_energy"))
    )
    return by_genre.groupBy("listener", "shift_id").agg(
        _average().alias("target_energy"), _dominant().alias("target_genre"), F.sum("_n").alias("songs"),
    )
