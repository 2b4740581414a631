"""Daily picks, weekend playlists, recently played, browsing and genre views."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from cadenza.functions.scalars import EVENING, NOON, mood_tag, uniform
from cadenza.functions.vectors import unit
from cadenza.operators.pieces import number_rows, score_order, score_pieces, span, top_rows
from cadenza.operators.queues import shuffle
from cadenza.operators.similarity import nearest
from cadenza.session import durable

# Fixed values of the daily and weekend rules.
REST_DAYS = 3
LEAST_PREFERENCE = 0.4
DAILY_SONGS = 8
WEEK_DAYS = 7
CLUSTERS = 5
WEEKEND_SONGS = 25
DISCOVERY_SHARE = 0.1
RECENT_TILES = 4

NEUTRAL = 0.5  # preference of a song nothing is known about
ENERGY_TARGETS = {"morning": 0.5, "afternoon": 0.7, "evening": 0.4}
_RING_PIECES = 4096


def _micros(moment: datetime) -> Column:
    return F.lit(moment).cast("timestamp")


def energy_fit(features: DataFrame, as_of: datetime) -> DataFrame:
    """``song_id, fit``: closeness of the min-max scaled energy to the hour's target."""
    part = "morning" if as_of.hour < NOON else "afternoon" if as_of.hour < EVENING else "evening"
    low, high = features.agg(F.min("energy"), F.max("energy")).first()
    spread = high is not None and high > low
    scaled = (F.col("energy") - low) / (high - low) if spread else F.lit(0.0)
    return features.select("song_id", F.round(1 - F.abs(scaled - ENERGY_TARGETS[part]), 6).alias("fit"))


def daily_picks(
    events: DataFrame, preferences: DataFrame, features: DataFrame, as_of: datetime, n: int = DAILY_SONGS
) -> DataFrame:
    """Each listener's ``n`` songs for the day: ``listener, rank, song_id, score``.

    Score is preference * recency * energy fit, for songs not heard in three days
    and liked above 0.4. Songs a listener never heard score 0.5 * fit for everyone,
    so they are ranked once; a listener's best ones are the first ranks missing
    among the songs heard, found without pairing listeners with the library.
    Equal scores come in hash order.
    """
    by = (F.col("score"), F.col("song_id"))
    fit = energy_fit(features, as_of)
    heard = events.filter(F.col("ts") < _micros(as_of)).groupBy("listener", "song_id").agg(
        F.max("ts").alias("_last")
    )
    days = (F.unix_micros(_micros(as_of)) - F.unix_micros("_last")) / 86_400_000_000
    again = (
        heard.filter(F.col("_last") < _micros(as_of - timedelta(days=REST_DAYS)))
        .join(preferences, ["listener", "song_id"], "left")
        .withColumn("_liked", F.coalesce("preference", F.lit(NEUTRAL)))
        .filter(F.col("_liked") > LEAST_PREFERENCE).join(fit, "song_id")
        .select("listener", "song_id",
                F.round(F.col("_liked") * (1 - F.exp(-days / WEEK_DAYS)) * F.col("fit"), 6).alias("score"))
    )

    fresh = fit.withColumn("score", F.round(NEUTRAL * F.col("fit"), 6)).select("song_id", "score")
    ranked = number_rows(fresh, [], score_order(*by), score_pieces(*by, 0, 1), "_place")
    ranked = ranked.withColumn("_place", F.col("_place") + 1)
    unheard = _first_missing(heard.join(ranked.select("song_id", "_place"), "song_id", "left"), n)
    never = unheard.join(ranked, "_place").select("listener", "song_id", "score")
    return top_rows(again.unionByName(never), ["listener"], score_order(*by), n)


def _first_missing(heard: DataFrame, n: int) -> DataFrame:
    """``listener, _place``: the first ``n`` places of each listener not in ``heard``.

    The k-th heard place p has p - k missing places before it, so the j-th missing
    place is j plus the number of heard places with p - k < j: n counts per listener.
    """
    placed = number_rows(
        heard.filter(F.col("_place").isNotNull()).select("listener", "_place"),
        ["listener"], ["_place"], [span(F.col("_place"), 65536)], "_k",
    )
    missing_before = F.col("_place") - 1 - F.col("_k")
    found = placed.groupBy("listener").agg(
        F.array(*[F.lit(j) + F.count_if(missing_before < j) for j in range(1, n + 1)]).alias("_places")
    )
    nothing_heard = F.array(*[F.lit(j).cast("long") for j in range(1, n + 1)])
    return (
        heard.select("listener").distinct().join(found, "listener", "left")
        .select("listener", F.explode(F.coalesce("_places", nothing_heard)).alias("_place"))
    )


def pick_clusters(vectors: DataFrame, k: int = CLUSTERS, steps: int | None = None, seed: int = 7) -> DataFrame:
    """``song_id, cluster`` of ``vectors`` (``song_id, full_vector``).

    MLlib's KMeans, or with ``steps`` that many Lloyd steps from the first ``k``
    songs by id, which any engine can repeat.
    """
    if steps is None:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        points = vectors.select("song_id", array_to_vector("full_vector").alias("features"))
        fitted = KMeans(k=k, seed=seed).fit(points)
        return fitted.transform(points).select("song_id", F.col("prediction").alias("cluster"))

    first = vectors.orderBy("song_id").limit(k).collect()
    centres = [list(row.full_vector) for row in first]
    for _ in range(steps):
        moved = (
            assign(vectors, centres).select("cluster", F.posexplode("full_vector").alias("_place", "_x"))
            .groupBy("cluster", "_place").agg(F.avg("_x").alias("_x"))
        )
        for row in moved.collect():  # k rows per position
            centres[row.cluster][row._place] = row._x
    return assign(vectors, centres).select("song_id", "cluster")


def assign(vectors: DataFrame, centres: list[list[float]]) -> DataFrame:
    """Add the nearest of a handful of ``centres``, ties to the first."""
    def distance(centre):
        there = F.array(*[F.lit(float(x)) for x in centre])
        squares = F.zip_with("full_vector", there, lambda a, b: (a - b) * (a - b))
        return F.round(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x), 9)

    options = [F.struct(distance(c).alias("d"), F.lit(i).alias("cluster")) for i, c in enumerate(centres)]
    return vectors.withColumn("cluster", F.array_min(F.array(*options)).getField("cluster"))


def weekend_playlist(
    events: DataFrame, preferences: DataFrame, features: DataFrame, as_of: datetime, seed: str,
    songs: int = WEEKEND_SONGS, steps: int | None = None, **options,
) -> DataFrame:
    """Each listener's weekend playlist: ``listener, position, song_id, kind``.

    Songs of the last week are clustered; the listener's own are drawn without
    replacement, weighted by preference, one of each cluster in turn: five of each, and
    more of some where others have fewer. One in ten places goes to songs nobody has
    played, nearest to the listener's average.
    """
    discoveries = math.ceil(DISCOVERY_SHARE * songs)
    recent = events.filter(
        (F.col("ts") >= _micros(as_of - timedelta(days=WEEK_DAYS))) & (F.col("ts") < _micros(as_of))
    ).select("listener", "song_id").distinct()
    vectors = features.select("song_id", unit(F.col("full_vector")).alias("full_vector"))
    played = durable(vectors.join(recent.select("song_id").distinct(), "song_id", "left_semi"))
    clusters = pick_clusters(played, steps=steps)

    # The k-th smallest of -ln(u) / w is a draw without replacement by weight w.
    weight = F.coalesce("preference", F.lit(NEUTRAL))
    drawn = (
        recent.join(clusters, "song_id").join(preferences, ["listener", "song_id"], "left")
        .withColumn("_draw", F.round(-F.log(uniform(seed, F.col("listener"), F.col("song_id"))) / weight, 9))
    )
    best = top_rows(drawn, ["listener", "cluster"], ["_draw", "song_id"], songs - discoveries, "_turn")
    kept = top_rows(best, ["listener"], ["_turn", "_draw", "song_id"], songs - discoveries, "position").select(
        "listener", "position", "song_id", F.lit("sampled").alias("kind")
    )

    tastes = (
        recent.join(vectors, "song_id").select("listener", F.posexplode("full_vector").alias("_place", "_x"))
        .groupBy("listener", "_place").agg(F.avg("_x").alias("_x"))
        .groupBy("listener").agg(F.array_sort(F.collect_list(F.struct("_place", "_x"))).alias("_cells"))
        .select(F.col("listener").alias("query_id"), F.col("_cells._x").alias("vector"))
    )
    unplayed = vectors.join(events.select("song_id").distinct(), "song_id", "left_anti")
    base = unplayed.select("song_id", F.col("full_vector").alias("vector"))
    found = nearest(tastes.withColumn("query_id", F.concat(F.lit("listener:"), "query_id")), base, discoveries, **options)
    counts = kept.groupBy("listener").agg(F.count(F.lit(1)).alias("_sampled"))
    new = (
        found.withColumn("listener", F.expr("substring(query_id, 10)")).join(counts, "listener", "left")
        .select("listener", (F.coalesce("_sampled", F.lit(0)) + F.col("rank")).cast("int").alias("position"),
                "song_id", F.lit("discovery").alias("kind"))
    )
    return kept.unionByName(new)


def recently_played(events: DataFrame, n: int = RECENT_TILES) -> DataFrame:
    """The ``n`` songs each listener heard last, latest first."""
    last = events.filter(F.col("event_type") != "skip").groupBy("listener", "song_id").agg(
        F.max("ts").alias("played_at")
    )
    return top_rows(last, ["listener"], [F.desc("played_at"), "song_id"], n)


def browse(songs: DataFrame, by: str) -> DataFrame:
    """Songs and total duration per ``album`` or ``artist``."""
    return songs.groupBy(by).agg(F.count(F.lit(1)).alias("songs"), F.sum("duration_ms").alias("duration_ms"))


def filter_genre(songs: DataFrame, genre: str, column: str = "genre_tag") -> DataFrame:
    return songs if genre == "All" else songs.filter(F.col(column) == genre)


# Words that name a genre in a file name or tag, tried in this order.
GENRE_WORDS = {
    "Punjabi": ["punjabi", "bhangra"],
    "Hindi": ["hindi", "bollywood"],
    "English": ["english"],
    "Instrumental": ["instrumental", "karaoke"],
}


def tag_genres(songs: DataFrame, words: dict[str, list[str]] = GENRE_WORDS) -> DataFrame:
    """Genre by words in title, artist, album or path, else by energy and tempo."""
    text = F.lower(F.concat_ws(" ", "title", "artist", "album", "file_path"))
    tag = mood_tag(F.col("energy"), F.col("tempo"))
    for genre, names in reversed(words.items()):
        tag = F.when(text.rlike("|".join(rf"\Q{name.lower()}\E" for name in names)), genre).otherwise(tag)
    return songs.withColumn("genre_tag", tag)


def shuffle_genre(queues: DataFrame, genres: DataFrame, genre: str, seed: str) -> DataFrame:
    """Seeded random order of the songs of one genre in every queue."""
    inside = filter_genre(queues.join(genres.select("song_id", "genre"), "song_id"), genre, "genre")
    return shuffle(inside.select("queue_id", "position", "song_id"), seed)


def random_queue(requests: DataFrame, songs: DataFrame, seed: str, n: int) -> DataFrame:
    """Fallback queues when nothing can be recommended: seeded, different per request.

    All songs lie on a ring in hash order; a request starts at a place its own
    hash gives and takes the next ``n``. So no request meets the whole library.
    """
    ring = number_rows(
        songs.select(F.col("id").alias("song_id"), uniform(seed, F.col("id")).alias("_at")),
        [], ["_at", "song_id"], [F.floor(F.col("_at") * _RING_PIECES)], "_place",
    )
    size = songs.select(F.count(F.lit(1))).scalar()
    start = F.floor(uniform(seed, F.col("request_id")) * F.col("_size"))
    steps = F.sequence(F.lit(0), F.least(F.lit(n).cast("long"), F.col("_size")) - 1)
    asked = (
        requests.select("request_id").withColumn("_size", size).filter("_size > 0")
        .select("request_id", "_size", start.alias("_start"), F.posexplode(steps).alias("position", "_step"))
        .select("request_id", "position", F.pmod(F.col("_start") + F.col("_step"), F.col("_size")).alias("_place"))
    )
    return asked.join(ring.select("_place", "song_id"), "_place").select("request_id", "position", "song_id")
