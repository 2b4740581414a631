"""Streams run over the whole events table once, compared with the batch meaning.

Each run writes to its own new folder below the shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from cadenza.operators import indexing, learner
from cadenza.plans.registry import query
from cadenza.plans.audio import NOW
from cadenza.plans.standins import VIEWS, table, view
from cadenza.session import durable, shared_folder
from cadenza.streaming import behavior as streams
from cadenza.streaming.indexing import REQUESTS, JobStore, start_indexing


def _folder(spark):
    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _events(spark, folder):
    """The behaviour view over the events table read as a stream."""
    schema = table(spark, folder, "events").schema
    raw = streams.read_events(spark, folder, schema, pathGlobFilter="events.parquet")
    return spark.sql(VIEWS["behavior"], events=raw)


def _run(spark, stream, schema):
    out = _folder(spark)
    streams.start_append(stream, f"{out}/rows", f"{out}/checkpoint", available_now=True).awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/rows")


@query("select min(id) id, listener, song_id, event_type, epoch_us(ts) us from behavior group by listener, song_id, event_type, ts")
def stream_ingest(spark, folder):
    """Every event sent twice, stored once."""
    events = _events(spark, folder)
    stored = streams.ingest(events.unionByName(events))
    rows = _run(spark, stored, stored.schema)
    return rows.select("id", "listener", "song_id", "event_type", F.unix_micros("ts").alias("us"))


@query("""
    with counted as (
        select listener, session_no, genre, count(*) n, count(energy) k, sum(energy) e, min(ts) s, max(ts) t
        from session_events b left join features f on f.song_id = b.song_id group by listener, session_no, genre)
    select listener, (min({'n': -n, 'g': genre}) filter (where genre is not null)).g dominant_genre,
           cast(sum(n) as bigint) events, round(sum(e) / nullif(sum(k), 0), 6) avg_energy, epoch_us(min(s)) started_us, epoch_us(max(t)) ended_us
    from counted group by listener, session_no
    having max(t) + interval 6 hour <= date_trunc('millisecond', (select max(ts) from behavior)) - interval 10 minute""")
def stream_sessions(spark, folder):
    """Closed sessions only: the watermark is ten minutes behind the last event."""
    energies = view(spark, folder, "features").select("song_id", "genre", "energy")
    closed = streams.sessions(_events(spark, folder).join(energies, "song_id", "left"), "6 hours")
    rows = _run(spark, closed, closed.schema)
    return rows.select(
        "listener", "dominant_genre", "events", F.round("avg_energy", 6).alias("avg_energy"),
        F.unix_micros("started_at").alias("started_us"), F.unix_micros("ended_at").alias("ended_us"),
    )


@query("""
    select listener, id, epoch_us(ts) us from shifts
    where ts <= date_trunc('millisecond', (select max(ts) from behavior)) - interval 10 minute""")
def stream_mood_shifts(spark, folder):
    found = streams.mood_shifts(_events(spark, folder), seconds=86400)
    rows = _run(spark, found, found.schema)
    return rows.select("listener", "id", F.unix_micros("ts").alias("us"))


@query("""
    with latest as (
        select listener, target_energy from (
            select t.listener, target_energy, row_number() over (partition by t.listener order by s.ts desc, s.id desc) back
            from targets t join shifts s on s.id = t.shift_id
            where s.ts <= date_trunc('millisecond', (select max(ts) from behavior)) - interval 10 minute) where back = 1),
    queue as (select listener, song_id, round(preference, 6) score from listener_preference),
    adjusted as (
        select q.listener, q.song_id, q.score,
               round(round(q.score * (1 - coalesce(abs(f.energy - t.target_energy), 0)), 12), 6) adjusted
        from queue q left join features f on f.song_id = q.song_id left join latest t on t.listener = q.listener)
    select listener, song_id, score, adjusted,
           row_number() over (partition by listener order by adjusted desc, md5(song_id), song_id) - 1 as "position"
    from adjusted""")
def stream_reranked(spark, folder):
    """Queues that the stream of events has rewritten at every shift, as they stand at its end."""
    from cadenza.operators.behavior import preference

    out, features = _folder(spark), view(spark, folder, "features")
    queues = durable(preference(view(spark, folder, "labelled")).select("listener", "song_id", F.round("preference", 6).alias("score")))
    events = _events(spark, folder).join(features.select("song_id", "energy"), "song_id", "left")
    reactions = streams.mood_reactions(events, seconds=86400)
    streams.start_reranking(reactions, queues, features, f"{out}/queues", f"{out}/checkpoint", available_now=True).awaitTermination()
    found = streams.current_queues(queues, features, f"{out}/queues")
    return found.select("listener", "song_id", "score", "adjusted", "position")


@query("""
    with training as (
        select label, list_concat(cast(full_vector as double[]), [
                   cast(hour(ts) < 12 as int)::double, cast(hour(ts) between 12 and 16 as int)::double,
                   cast(hour(ts) >= 17 as int)::double, energy, 1.0::double]) x
        from labelled l join features f on f.song_id = l.song_id),
    cells as (select label, unnest(x) x, generate_subscripts(x, 1) - 1 place from training)
    select cast(place as int) "position", round(0.5 * avg((label - 0.5) * x), 6) weight from cells group by place""")
def stream_learning(spark, folder):
    """Weights after the one micro-batch that holds all events."""
    from cadenza.operators.behavior import label_events

    features = view(spark, folder, "features")
    width = features.select(F.size("full_vector")).first()[0] + learner.EXTRA_INPUTS
    labelled = label_events(_events(spark, folder)).join(
        features.select("song_id", F.col("energy").alias("session_energy")), "song_id"
    )
    out = _folder(spark)
    rows = learner.training_rows(labelled, features)
    streams.start_learning(rows, f"{out}/weights", f"{out}/checkpoint", width, available_now=True).awaitTermination()
    weights = spark.read.parquet(f"{out}/weights/batch-0")
    return weights.select("position", F.round("weight", 6).alias("weight"))


def _index_job(spark, folder, on_progress=lambda start, log: None):
    """A job of three batches of requests; the second fails when it is run first, and is started again."""
    out = _folder(spark)
    # Joined and grouped once; every batch of requests is a folder of them.
    view(spark, folder, "index_requests").withColumn("part", F.col("seq") % 3).write.partitionBy("part").parquet(f"{out}/dealt")
    store, requests = JobStore(spark, f"{out}/job"), spark.read.schema(f"{REQUESTS}, part bigint").parquet(f"{out}/dealt")
    listing, songs, features, analysed = (view(spark, folder, n) for n in ("listing", "songs_existing", "indexed", "analysed"))
    features = features.withColumns({c: F.col(c).cast("double") for c in ("tempo", "energy")})
    broken = [False]

    def index(requested, listing, songs, features, as_of):
        if broken[0]:
            raise OSError("the recordings cannot be reached")
        return indexing.index_files(requested, listing, songs, features, analysed, as_of)

    for start, part in enumerate((0, 1, 1, 2)):
        broken[0] = start == 1
        if start != 2:  # the restart finds the batch that failed
            requests.filter(F.col("part") == part).drop("part").write.mode("append").parquet(f"{out}/requests")
        stream = spark.readStream.schema(REQUESTS).parquet(f"{out}/requests")
        job = start_indexing(stream, listing, songs, features, store, f"{out}/checkpoint", index, lambda: NOW, available_now=True)
        try:
            job.awaitTermination()
        except StreamingQueryException:
            if not broken[0]:
                raise
        on_progress(start, store.log())
    return store


@query("""
    with parts as (select seq % 3 part, count(*) files, max(file_path) last_file from index_requests group by seq % 3),
    steps as (
        select start, sum(files) filter (part <= begun) total, coalesce(sum(files) filter (part < ended), 0) completed,
               max(last_file) filter (part = begun and begun >= ended) current_file
        from parts cross join (values (0, 0, 1), (1, 1, 1), (2, 1, 2), (3, 2, 3)) s(start, begun, ended) group by start)
    select start, cast(total as int) total, cast(completed as int) completed, current_file,
           cast((total - completed) * 2 as int) eta_seconds, case when completed < total then 'running' else 'idle' end status,
           round(completed / total, 6) ratio, completed = total is_done
    from steps""")
def index_job_progress(spark, folder):
    """Status and progress read from the job's own log after each of its starts, one of which fails."""
    reports = []

    def report(start, log):
        progress = indexing.index_progress(indexing.index_status(log)).select(
            F.lit(start).alias("start"), "total", "completed", "current_file", "eta_seconds", "status",
            F.round("ratio", 6).alias("ratio"), "is_done")
        reports.append((progress.collect()[0], progress.schema))  # one row

    _index_job(spark, folder, report)
    return spark.createDataFrame([row for row, _ in reports], reports[0][1])


@query("""
    with requested as (
        select *, row_number() over (partition by file_path order by seq % 3, seq) turn from index_requests)
    select seq, r.file_path, case when l.file_path is null then 'error' when i.song_id is not null then 'already indexed'
                     when a.file_path is null or a.error is not null then 'error'
                     when turn > 1 then 'already indexed' else 'extracted' end status,
           case when l.file_path is null then 'File not found' when i.song_id is null then a.error end error
    from requested r left join listing l on l.file_path = r.file_path
    left join songs_existing s on s.file_path = r.file_path left join indexed i on i.song_id = s.id
    left join analysed a on a.file_path = r.file_path""")
def index_job_outcomes(spark, folder):
    """One outcome per request over all batches; a later batch finds what an earlier one has indexed."""
    return _index_job(spark, folder).log().select("seq", "file_path", "status", "error")


@query("""
    with training as (
        select l.listener, l.id % 2 part, label, list_concat(cast(full_vector as double[]), [
                   cast(hour(ts) < 12 as int)::double, cast(hour(ts) between 12 and 16 as int)::double,
                   cast(hour(ts) >= 17 as int)::double, energy, 1.0::double]) x
        from labelled l join features f on f.song_id = l.song_id),
    cells as (select listener, part, label, unnest(x) x, generate_subscripts(x, 1) - 1 place from training),
    one as (select listener, place, 0.5 * avg((label - 0.5) * x) w from cells where part = 0 group by listener, place),
    models as (select listener, list(w order by place) w from one group by listener),
    missed as (
        select t.listener, t.x, label - 1 / (1 + exp(-coalesce(list_inner_product(t.x, m.w), 0))) miss
        from training t left join models m using (listener) where part = 1),
    second as (select listener, miss, unnest(x) x, generate_subscripts(x, 1) - 1 place from missed),
    two as (select listener, place, 0.5 * avg(miss * x) w from second group by listener, place)
    select listener, cast(place as int) "position", round(coalesce(a.w, 0) + coalesce(b.w, 0), 6) + 0.0 weight
    from one a full join two b using (listener, place)""")
def stream_learning_each(spark, folder):
    """One model per listener after two micro-batches: the even and the odd events."""
    from cadenza.operators.behavior import label_events

    features, out = view(spark, folder, "features"), _folder(spark)
    events = view(spark, folder, "behavior")
    for part in (0, 1):
        events.filter(F.col("id") % 2 == part).write.mode("append").parquet(f"{out}/events")
        stream = spark.readStream.schema(events.schema).parquet(f"{out}/events")
        labelled = label_events(stream).join(features.select("song_id", F.col("energy").alias("session_energy")), "song_id")
        streams.start_learning_each(
            learner.listener_rows(labelled, features), f"{out}/models", f"{out}/checkpoint", available_now=True).awaitTermination()
    models = learner.current_models(streams.read_models(spark, f"{out}/models"))
    cells = models.select("listener", F.posexplode("weights").alias("position", "weight"))
    return cells.withColumn("weight", F.round("weight", 6))
