"""Queries over behaviour: labels, counts, sessions, mood shifts, the learner."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import behavior, learner
from cadenza.plans.registry import query
from cadenza.plans.standins import view
from cadenza.session import durable

_GAP = 6 * 3600
_DAY = 86400


@query("select id, listener, song_id, label from labelled")
def labelled_events(spark, folder):
    return behavior.label_events(view(spark, folder, "behavior")).select("id", "listener", "song_id", "label")


@query("""
    select song_id, count(*) filter (event_type = 'play') plays, count(*) filter (event_type = 'skip') skips,
           count(*) filter (event_type = 'replay') replays, epoch_us(max(ts) filter (event_type <> 'skip')) last_us
    from behavior group by song_id""")
def song_play_counts(spark, folder):
    counts = behavior.play_counts(view(spark, folder, "behavior"))
    return counts.select("song_id", "plays", "skips", "replays", F.unix_micros("last_played").alias("last_us"))


@query("select listener, song_id, round(preference, 6) preference from listener_preference")
def preferences(spark, folder):
    scores = behavior.preference(view(spark, folder, "labelled"))
    return scores.select("listener", "song_id", F.round("preference", 6).alias("preference"))


@query("""
    select min(id) id, listener, song_id, event_type, count(*) > 0 as kept, epoch_us(ts) us
    from behavior group by listener, song_id, event_type, ts""")
def merged_stores(spark, folder):
    """The events met twice: in the backend's store and, numbered anew, in a client's."""
    backend = view(spark, folder, "behavior")
    client = backend.withColumn("id", F.col("id") + 1_000_000_000_000)
    merged = behavior.merge_stores(client, backend)
    return merged.select("id", "listener", "song_id", "event_type", F.lit(True).alias("kept"), F.unix_micros("ts").alias("us"))


@query("select id, listener, session_no from session_events")
def sessions(spark, folder):
    return behavior.sessionize(view(spark, folder, "behavior"), _GAP).select("id", "listener", "session_no")


@query("""
    with counted as (
        select listener, session_no, genre, count(*) n, count(energy) k, sum(energy) e, min(ts) s, max(ts) t
        from session_events b left join features f on f.song_id = b.song_id group by listener, session_no, genre)
    select listener, session_no, (min({'n': -n, 'g': genre}) filter (where genre is not null)).g dominant_genre,
           round(sum(e) / nullif(sum(k), 0), 6) avg_energy,
           cast(sum(n) as bigint) events, epoch_us(min(s)) started_us, epoch_us(max(t)) ended_us
    from counted group by listener, session_no""")
def session_summary(spark, folder):
    events = behavior.sessionize(view(spark, folder, "behavior"), _GAP)
    summary = behavior.session_summary(events, view(spark, folder, "features"), ("listener", "session_no"))
    return summary.select(
        "listener", "session_no", "dominant_genre", F.round("avg_energy", 6).alias("avg_energy"), "events",
        F.unix_micros("started_at").alias("started_us"), F.unix_micros("ended_at").alias("ended_us"),
    )


@query("select id, listener, song_id, epoch_us(ts) us from runs where hit")
def skip_runs(spark, folder):
    found = behavior.mood_shifts(view(spark, folder, "behavior"), seconds=_DAY, reset=False)
    return found.select("id", "listener", "song_id", F.unix_micros("ts").alias("us"))


@query("select id, listener, song_id, epoch_us(ts) us from shifts")
def mood_shifts(spark, folder):
    found = behavior.mood_shifts(view(spark, folder, "behavior"), seconds=_DAY)
    return found.select("id", "listener", "song_id", F.unix_micros("ts").alias("us"))


@query("select listener, shift_id, round(target_energy, 6) target_energy, songs from targets")
def mood_targets(spark, folder):
    events = view(spark, folder, "behavior")
    shifts = behavior.mood_shifts(events, seconds=_DAY)
    targets = behavior.mood_targets(events, shifts, view(spark, folder, "features"))
    return targets.select("listener", "shift_id", F.round("target_energy", 6).alias("target_energy"), "songs")


_TRAINING = """
    energies as (
        select listener, session_no, sum(energy) / count(*) session_energy
        from session_events b join features f on f.song_id = b.song_id group by listener, session_no),
    training as (
        select l.id, l.label, list_concat(cast(f.full_vector as double[]), [
                   cast(hour(l.ts) < 12 as int)::double, cast(hour(l.ts) between 12 and 16 as int)::double,
                   cast(hour(l.ts) >= 17 as int)::double, session_energy, 1.0::double]) x
        from labelled l join session_events b on b.id = l.id
        join energies e on e.listener = b.listener and e.session_no = b.session_no
        join features f on f.song_id = l.song_id),
    cells as (select label, unnest(x) x, generate_subscripts(x, 1) - 1 place from training),
    step as (select cast(place as int) place, avg((label - 0.5) * x) g from cells group by place)"""


def _training(spark, folder):
    features = view(spark, folder, "features")
    events = durable(behavior.sessionize(view(spark, folder, "behavior"), _GAP))
    energy = behavior.session_summary(events, features, ("listener", "session_no")).select(
        "listener", "session_no", F.col("avg_energy").alias("session_energy")
    )
    # A fit reads its rows more than once: sessions are worked out before, long vectors are not kept.
    labelled = durable(behavior.label_events(events).join(energy, ["listener", "session_no"])
                       .select("song_id", "label", "ts", "session_energy"))
    return learner.training_rows(labelled, features)


def _width(spark, folder):
    width = view(spark, folder, "features").select(F.size("full_vector")).first()[0]
    return width + learner.EXTRA_INPUTS


@query(f'with {_TRAINING} select place "position", round(g, 6) gradient from step')
def learner_gradient(spark, folder):
    found = learner.gradient(_training(spark, folder), [0.0] * _width(spark, folder))
    return found.select("position", F.round("gradient", 6).alias("gradient"))


@query(f"""with {_TRAINING},
    weights as (select list(0.5 * g order by place) w from step)
    select song_id, round(1 / (1 + exp(-list_inner_product(list_concat(cast(full_vector as double[]),
               [0.0::double, 1.0::double, 0.0::double, 0.2::double, 1.0::double]), w))), 6) preference
    from features, weights""")
def learned_preferences(spark, folder):
    """Scores for an afternoon session of energy 0.2 after one step."""
    weights = learner.train(_training(spark, folder), _width(spark, folder), steps=1)
    afternoon = F.lit("2024-01-31 15:00:00").cast("timestamp")
    scores = learner.preference_scores(view(spark, folder, "features"), weights, afternoon, F.lit(0.2))
    return scores.select("song_id", F.round("preference", 6).alias("preference"))


@query()
def learned_by_logistic(spark, folder):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    model = learner.fit_logistic(_training(spark, folder))
    afternoon = F.lit("2024-01-31 15:00:00").cast("timestamp")
    x = learner.inputs(F.col("full_vector"), afternoon, F.lit(0.2))
    songs = view(spark, folder, "features").select("song_id", array_to_vector(x).alias("features"))
    chance = F.element_at(vector_to_array("probability"), 2)
    return model.transform(songs).select("song_id", F.round(chance, 4).alias("preference"))
