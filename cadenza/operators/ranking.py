"""Ranking: behaviour weights, genre diversity, queues for a context, mood shifts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from cadenza.operators.picks import random_queue
from cadenza.operators.pieces import lookup, number_rows, score_order, score_pieces, top_rows
from cadenza.operators.similarity import nearest
from cadenza.session import durable

# Fixed values of the ranking rules.
OTHER_GENRE_SHARE = 0.2
QUEUE_SONGS = 20
ACCEPTED_PCT = 50


def final_rank(candidates: DataFrame, weights: DataFrame, n: int, on: tuple[str, ...] = ("song_id",)) -> DataFrame:
    """Top ``n`` per request by similarity * (1 + weight); an unseen song weighs 0.

    ``candidates``: ``request_id, song_id, similarity`` and what ``on`` needs;
    ``weights``: the ``on`` columns and ``weight``.
    """
    scored = candidates.join(weights, list(on), "left").withColumn(
        "score", F.round(F.col("similarity") * (1 + F.coalesce("weight", F.lit(0.0))), 6)
    )
    return top_rows(scored.drop("weight"), ["request_id"], [F.desc("score"), "song_id"], n)


def diversify(scored: DataFrame, n: int, share: float = OTHER_GENRE_SHARE) -> DataFrame:
    """Top ``n`` per request with at least ``share`` of ``n`` outside the dominant genre.

    ``scored``: ``request_id, song_id, score, genre, dominant_genre``. Places kept
    for other genres stay empty when there are too few of them.
    """
    order = [F.desc("score"), "song_id"]
    dominant = F.coalesce(F.col("genre") == F.col("dominant_genre"), F.lit(False))
    most = n - math.ceil(share * n)
    kept = top_rows(scored.filter(dominant), ["request_id"], order, most).unionByName(
        top_rows(scored.filter(~dominant), ["request_id"], order, n)
    )
    return top_rows(kept.drop("rank"), ["request_id"], order, n)


def context_queue(
    requests: DataFrame, features: DataFrame, weights: DataFrame, n: int = QUEUE_SONGS,
    pool: int | None = None, **options,
) -> DataFrame:
    """Queues for ``requests`` (``request_id, listener, current_song_id, genre_context``).

    The ``pool`` nearest songs of the wanted genre (twice ``n`` by default) are
    ranked with the listener's ``weights`` (``listener, song_id, weight``).
    Requests for the same song and genre share one search.
    """
    pool = pool or 2 * n
    asked = requests.select("current_song_id", "genre_context").distinct()
    queries = asked.join(
        features.select(F.col("song_id").alias("current_song_id"), F.col("full_vector").alias("vector")),
        "current_song_id",
    ).select(
        F.to_json(F.struct("current_song_id", "genre_context")).alias("query_id"),
        F.col("genre_context").alias("scope"), "vector", "current_song_id", "genre_context",
    )
    base = features.select("song_id", F.col("genre").alias("scope"), F.col("full_vector").alias("vector"))
    found = nearest(queries, base, pool + 1, scoped=True, **options)
    others = found.join(queries.select("query_id", "current_song_id", "genre_context"), "query_id").filter(
        F.col("song_id") != F.col("current_song_id")
    )
    kept = top_rows(others.drop("rank"), ["current_song_id", "genre_context"], [F.desc("similarity"), "song_id"], pool)
    candidates = requests.join(lookup(kept), ["current_song_id", "genre_context"]).select(
        "request_id", "listener", "song_id", "similarity"
    )
    return final_rank(candidates, weights, n, on=("listener", "song_id"))


def answered_queue(
    requests: DataFrame, features: DataFrame, weights: DataFrame, songs: DataFrame, n: int = QUEUE_SONGS,
    share: float = OTHER_GENRE_SHARE, seed: str = "queue", spare: int = 5, **options,
) -> DataFrame:
    """A queue of up to ``n`` songs for every request, whatever is known: ``request_id, rank, song_id, score, source``.

    ``requests`` are those of ``context_queue`` with ``dominant_genre`` (that of the session; null: the wanted
    one). First come songs of the wanted genre; songs of other genres near the current one have the ``share``
    of places that the dominant genre must leave, or all of them where the wanted genre has none. Requests
    that are still short (a song without features, an unknown genre) are filled up from the library
    ``songs`` (``id``) in an order of their own: ``spare`` times ``n`` songs are looked at. No song comes twice,
    and the current one not at all. A queue stays short only where the library has no other songs to give.
    """
    wanted = context_queue(requests, features, weights, n, **options).select("request_id", "song_id", "score")
    pool = nearest(
        requests.select(F.col("current_song_id").alias("query_id")).distinct().join(
            features.select(F.col("song_id").alias("query_id"), F.col("full_vector").alias("vector")), "query_id"),
        features.select("song_id", F.col("full_vector").alias("vector")), 2 * n, **options,
    ).withColumnRenamed("query_id", "current_song_id").drop("rank")
    genres = features.select("song_id", "genre")
    beside = requests.join(lookup(pool), "current_song_id").join(genres, "song_id").filter(
        ~F.col("genre").eqNullSafe(F.col("genre_context")))
    beside = final_rank(beside.select("request_id", "listener", "song_id", "similarity"), weights, n, on=("listener", "song_id"))
    answered = durable(wanted.select("request_id").distinct().withColumn("_answered", F.lit(True)))
    beside = beside.join(lookup(answered), "request_id", "left").filter(
        F.col("_answered").isNull() | (F.col("rank") <= math.ceil(share * n)))
    found = durable(
        wanted.withColumn("source", F.lit("context"))
        .unionByName(beside.select("request_id", "song_id", "score", F.lit("beside").alias("source"))))
    drawn = random_queue(requests, songs, seed, spare * n).join(found.select("request_id", "song_id"), ["request_id", "song_id"], "left_anti")
    # Recommended songs score between -2 and 2, so drawn ones come after them, in the order they were drawn.
    drawn = drawn.select("request_id", "song_id", (-10.0 - F.col("position")).alias("score"), F.lit("random").alias("source"))
    asked = requests.select(
        "request_id", F.col("current_song_id").alias("_current"), F.coalesce("dominant_genre", "genre_context").alias("dominant_genre"))
    scored = (
        found.unionByName(drawn).join(lookup(asked), "request_id").join(genres, "song_id", "left")
        .filter(~F.col("song_id").eqNullSafe(F.col("_current")))
    )
    return diversify(scored, n, share).select("request_id", "rank", "song_id", "score", "source")


def rerank_for_mood(queue: DataFrame, targets: DataFrame, energies: DataFrame) -> DataFrame:
    """Reorder queues (``listener, song_id, score``) after a mood shift.

    Scores shrink with the distance of a song's energy from the target; listeners
    without a target keep their order. Scores lie between -2 and 2; equal ones are
    put in hash order, which also cuts a score many songs share into pieces. The
    first rounding takes off what the order of additions left in the last digits.
    """
    wanted = targets.select("listener", "target_energy")
    distance = F.abs(F.col("energy") - F.col("target_energy"))
    shrunk = F.col("score") * (1 - F.coalesce(distance, F.lit(0.0)))
    adjusted = (
        queue.join(energies.select("song_id", "energy"), "song_id", "left").join(lookup(wanted), "listener", "left")
        .withColumn("adjusted", F.round(F.round(shrunk, 12), 6))
        .drop("energy", "target_energy")
    )
    by = (F.col("adjusted"), F.col("song_id"))
    return number_rows(adjusted, ["listener"], score_order(*by), score_pieces(*by, -2, 2), "position")


def boosts(labelled: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Weight added to the neighbours of songs a listener played past 80 %.

    Plays are counted per listener and song first; each count then meets the
    song's short neighbour list (``query_id, song_id, similarity``).
    """
    liked = (
        labelled.filter("label = 1").groupBy("listener", F.col("song_id").alias("query_id"))
        .agg(F.count(F.lit(1)).alias("_times"))
    )
    return (
        liked.join(neighbours.select("query_id", "song_id", "similarity"), "query_id")
        .groupBy("listener", "song_id")
        .agg(F.sum(F.col("_times") * F.col("similarity")).alias("boost"))
    )


def acceptance(recommended: DataFrame, events: DataFrame) -> DataFrame:
    """Per week the share of recommended songs the listener played past 50 %.

    ``recommended``: ``listener, song_id, week`` (the Monday of the week).
    """
    accepted = (
        events.filter((F.col("event_type") != "skip") & (F.col("skip_position_pct") > ACCEPTED_PCT))
        .select("listener", "song_id", F.date_trunc("week", "ts").cast("date").alias("week")).distinct()
        .withColumn("_accepted", F.lit(1))
    )
    return (
        recommended.join(accepted, ["listener", "song_id", "week"], "left").groupBy("week")
        .agg(F.count(F.lit(1)).alias("recommended"), F.count("_accepted").alias("accepted"))
        .withColumn("rate", F.col("accepted") / F.col("recommended"))
    )
