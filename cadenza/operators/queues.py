"""Edits of many listening queues at once.

``queues``: ``queue_id, position, song_id`` with positions 0, 1, 2, …;
``state``: one row per queue with ``current_index`` (-1 where nothing plays).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cadenza.operators.pieces import hash_span, lookup, number_rows, span

POSITIONS_PER_PIECE = 65536


def replace(queues: DataFrame, lists: DataFrame) -> DataFrame:
    """Queues named in ``lists`` take the new songs; the others stay."""
    return queues.join(lookup(lists.select("queue_id").distinct()), "queue_id", "left_anti").unionByName(
        lists.select("queue_id", "position", "song_id")
    )


def start_at(state: DataFrame, lists: DataFrame, initial_index: int = 0) -> DataFrame:
    """State after ``replace``: the replaced queues play from ``initial_index``."""
    fresh = lists.select("queue_id").distinct().withColumn("current_index", F.lit(initial_index).cast("long"))
    return state.join(fresh.select("queue_id"), "queue_id", "left_anti").unionByName(fresh)


def append(queues: DataFrame, additions: DataFrame) -> DataFrame:
    """Put ``additions`` (``queue_id, seq, song_id``) at the end, in ``seq`` order."""
    ends = queues.groupBy("queue_id").agg((F.max("position") + 1).alias("_end"))
    piece = span(F.col("seq"), POSITIONS_PER_PIECE)
    numbered = number_rows(additions, ["queue_id"], ["seq"], [piece], "_offset")
    tail = numbered.join(lookup(ends), "queue_id", "left").select(
        "queue_id", (F.coalesce("_end", F.lit(0)) + F.col("_offset")).cast("long").alias("position"), "song_id"
    )
    return queues.select("queue_id", F.col("position").cast("long"), "song_id").unionByName(tail)


def play_next(queues: DataFrame, state: DataFrame, inserts: DataFrame) -> DataFrame:
    """Put ``inserts`` (``queue_id, seq, song_id``) right after the current song.

    Each insert goes directly behind the current song, so of several the last
    stands first. Nothing happens to a queue where nothing plays.
    """
    playing = state.filter("current_index <> -1").select("queue_id", "current_index")
    piece = span(F.col("seq"), POSITIONS_PER_PIECE)
    allowed = inserts.join(playing, "queue_id")
    numbered = number_rows(allowed, ["queue_id"], ["seq"], [piece], "_offset")
    counts = allowed.groupBy("queue_id", "current_index").agg(F.count(F.lit(1)).alias("_inserted"))
    moved = queues.join(lookup(counts), "queue_id", "left").select(
        "queue_id",
        F.when(F.col("position") > F.col("current_index"), F.col("position") + F.col("_inserted"))
        .otherwise(F.col("position")).cast("long").alias("position"),
        "song_id",
    )
    new = numbered.join(lookup(counts.drop("current_index")), "queue_id").select(
        "queue_id",
        (F.col("current_index") + F.col("_inserted") - F.col("_offset")).cast("long").alias("position"),
        "song_id",
    )
    return moved.unionByName(new)


def current_songs(queues: DataFrame, state: DataFrame) -> DataFrame:
    """The playing song of every queue, null when the index is out of bounds."""
    at = queues.select("queue_id", F.col("position").alias("current_index"), "song_id")
    return state.join(at, ["queue_id", "current_index"], "left")


def shuffle(queues: DataFrame, seed: str, enabled: bool = True, hash_digits: int = 2) -> DataFrame:
    """Every queue in a seeded random order, or in its own order when not enabled.

    Rows are ordered by a hash of their key; its first digits are the pieces, so
    even one queue with most of the rows is sorted by 16 ** hash_digits tasks.
    """
    if not enabled:
        return queues.withColumn("play_order", F.col("position").cast("long"))
    key = F.concat_ws("|", F.lit(seed), "queue_id", "position", "song_id")
    order = [F.md5(key), "position"]
    return number_rows(queues, ["queue_id"], order, [hash_span(key, hash_digits)], "play_order")


def next_index(queues: DataFrame, state: DataFrame, mode: str) -> DataFrame:
    """Where each queue goes when its song ends: repeat ``off``, ``one`` or ``all``."""
    sizes = queues.groupBy("queue_id").agg((F.max("position") + 1).alias("_size"))
    current = F.col("current_index")
    following = {
        "one": current,
        "all": F.pmod(current + 1, F.col("_size")),
        "off": F.when(current + 1 < F.col("_size"), current + 1),
    }
    if mode not in following:
        raise ValueError("mode is 'off', 'one' or 'all'")
    return state.join(sizes, "queue_id").select(
        "queue_id", "current_index", following[mode].cast("long").alias("next_index")
    )
