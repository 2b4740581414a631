"""Queries over similarity, ranking, daily picks and weekend playlists."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from cadenza.operators import approximate, behavior, picks, ranking, similarity
from cadenza.plans.registry import query
from cadenza.plans.standins import AS_OF, view
from cadenza.session import durable, shared_folder
from cadenza.sources import tables

NOW = datetime.fromisoformat(AS_OF)
_PAIR = ["query_id", "song_id", "similarity", "rank"]


@query("select query_id, song_id, similarity, rank from similar_40 where rank <= 10")
def similar_songs(spark, folder):
    return similarity.similar_songs(view(spark, folder, "features")).select(*_PAIR)


@query("select query_id, song_id, similarity, rank from similar_40 where rank <= 10")
def similar_songs_pruned(spark, folder):
    """The same with pivots, small walks and blocks, as a large library would be searched."""
    features = view(spark, folder, "features")
    return similarity.similar_songs(features, pivots=12, block_rows=16, walk_rows=64, chunk_rows=64).select(*_PAIR)


@query("""
    select query_id, song_id, similarity, rank from (
        select *, cast(row_number() over (partition by query_id order by similarity desc, song_id) as int) rank
        from cosines where query_genre = genre) where rank <= 10""")
def similar_in_genre(spark, folder):
    return similarity.similar_in_genre(view(spark, folder, "features")).select(*_PAIR)


@query("select query_id, song_id, similarity, rank from similar_40 where rank <= 10")
def similar_refreshed(spark, folder):
    """Lists stored for the songs of nine genres, brought up to date with the tenth."""
    features = view(spark, folder, "features")
    old, new = features.filter("genre <> 'g7'"), features.filter("genre = 'g7'")
    stored = similarity.similar_songs(old)
    return similarity.refresh_similar(stored, old, new).select(*_PAIR)


_AFTER = """
    after as (
        select song_id, case when cast(song_id as bigint) % 3 = 0 then list_transform(u, lambda x: -x) else u end u
        from unit_features where cast(song_id as bigint) % 10 <> 7)"""


@query(f"""
    with {_AFTER}
    select query_id, song_id, similarity, rank from (
        select *, cast(row_number() over (partition by query_id order by similarity desc, song_id) as int) rank
        from (select a.song_id query_id, b.song_id, round(list_inner_product(a.u, b.u), 6) + 0.0 similarity
              from after a join after b on a.song_id <> b.song_id)) where rank <= 10""")
def similar_after_changes(spark, folder):
    """Lists kept by versions: a third of the songs were indexed again, some went, some are new."""
    number, songs = F.col("song_id").cast("bigint"), view(spark, folder, "features").select("song_id", "full_vector")
    before = songs.filter(number % 11 != 5)
    turned = F.when(number % 3 == 0, F.transform("full_vector", lambda x: -x)).otherwise(F.col("full_vector"))
    after = songs.filter(number % 10 != 7).withColumn("full_vector", turned)
    history = similarity.similar_songs(before).select(
        "query_id", F.lit(1).cast("bigint").alias("version"), "song_id", "similarity", F.col("rank").cast("int").alias("rank"))
    history = durable(history)
    changes = similarity.changed_lists(history, before, after, 2)
    return similarity.current_lists(history.unionByName(changes)).select(*_PAIR)


@query("""
    with planes as (
        select tab, bit, list((i * i * 2654435761 % 4294967296) / 4294967296 - 0.5 order by d) w
        from (select tab, bit, d, (tab * 10 + bit) * 64 + d + 1 i
              from (select unnest(range(14)) tab), (select unnest(range(10)) bit), (select unnest(range(64)) d))
        group by tab, bit),
    homes as (
        select song_id, tab, sum(case when list_inner_product(u, w) >= 0 then 1 << bit else 0 end)::bigint bucket
        from unit_features cross join planes group by song_id, tab),
    pairs as (
        select distinct q.song_id query_id, s.song_id from homes q join homes s on q.tab = s.tab and q.song_id <> s.song_id
        where bit_count(xor(q.bucket, s.bucket)) <= 2)
    select query_id, song_id, similarity, rank from (
        select p.*, similarity, cast(row_number() over (partition by query_id order by similarity desc, song_id) as int) rank
        from pairs p join cosines c using (query_id, song_id)) where rank <= 10""")
def similar_approximate(spark, folder):
    """Ten similar songs of every song from the buckets of a stored index."""
    features, path = view(spark, folder, "features"), f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    planes = approximate.Planes(tables=14, bits=10)
    approximate.build_index(features, planes).write(path)
    queries = features.select(F.col("song_id").alias("query_id"), F.col("full_vector").alias("vector"))
    return approximate.similar_approximate(queries, approximate.Index.read(spark, path, planes)).select(*_PAIR)


@query("""
    select request_id, song_id, similarity, score, rank from (
        select *, cast(row_number() over (partition by request_id order by score desc, song_id) as int) rank from (
            select query_id request_id, s.song_id, similarity,
                   round(similarity * (1 + coalesce(weight, 0)), 6) + 0.0 score
            from similar_40 s left join song_preference p on p.song_id = s.song_id where rank <= 15))
    where rank <= 10""")
def final_ranking(spark, folder):
    features = view(spark, folder, "features")
    candidates = similarity.similar_songs(features, similarity.NEIGHBOURS).select(
        F.col("query_id").alias("request_id"), "song_id", "similarity"
    )
    weights = behavior.preference(view(spark, folder, "labelled"), ("song_id",)).withColumnRenamed("preference", "weight")
    return ranking.final_rank(candidates, weights, 10).select("request_id", "song_id", "similarity", "score", "rank")


@query("""
    with near as (
        select *, row_number() over (partition by query_id order by similarity desc, song_id) near_rank from cosines),
    scored as (
        select query_id request_id, song_id, similarity score, genre,
               case when genre = query_genre then 1 else 0 end dominant
        from near where near_rank <= 60),
    ordered as (
        select *, row_number() over (partition by request_id, dominant order by score desc, song_id) place from scored),
    kept as (select * from ordered where (dominant = 1 and place <= 16) or (dominant = 0 and place <= 20))
    select request_id, song_id, score, genre, rank from (
        select *, cast(row_number() over (partition by request_id order by score desc, song_id) as int) rank from kept)
    where rank <= 20""")
def diverse_ranking(spark, folder):
    """Twenty of the sixty songs nearest to each song; its own genre is the dominant one."""
    features = view(spark, folder, "features")
    genres = features.select("song_id", "genre")
    own = genres.select(F.col("song_id").alias("query_id"), F.col("genre").alias("dominant_genre"))
    scored = (
        similarity.similar_songs(features, 60).join(genres, "song_id").join(own, "query_id")
        .select(F.col("query_id").alias("request_id"), "song_id", F.col("similarity").alias("score"), "genre", "dominant_genre")
    )
    return ranking.diversify(scored, 20).select("request_id", "song_id", "score", "genre", "rank")


_REQUESTS = """
    requests as (
        select b.listener request_id, b.listener, b.song_id current_song_id, f.genre genre_context
        from (select *, row_number() over (partition by listener order by ts desc, id desc) back from behavior) b
        join features f on f.song_id = b.song_id where back = 1)"""


def _requests(spark, folder):
    last = view(spark, folder, "behavior").groupBy("listener").agg(
        F.max(F.struct("ts", "id", "song_id")).getField("song_id").alias("current_song_id")
    )
    genres = view(spark, folder, "features").select(
        F.col("song_id").alias("current_song_id"), F.col("genre").alias("genre_context")
    )
    return last.join(genres, "current_song_id").withColumn("request_id", F.col("listener"))


@query(f"""
    with {_REQUESTS},
    pool as (
        select request_id, listener, c.song_id, c.similarity,
               row_number() over (partition by request_id order by c.similarity desc, c.song_id) place
        from requests r join cosines c on c.query_id = r.current_song_id and c.genre = r.genre_context),
    scored as (
        select request_id, p.song_id, similarity, round(similarity * (1 + coalesce(preference, 0)), 6) + 0.0 score
        from pool p left join listener_preference w on w.listener = p.listener and w.song_id = p.song_id
        where place <= 40)
    select request_id, song_id, similarity, score, rank from (
        select *, cast(row_number() over (partition by request_id order by score desc, song_id) as int) rank from scored)
    where rank <= 20""")
def context_queues(spark, folder):
    weights = behavior.preference(view(spark, folder, "labelled")).withColumnRenamed("preference", "weight")
    found = ranking.context_queue(_requests(spark, folder), view(spark, folder, "features"), weights)
    return found.select("request_id", "song_id", "similarity", "score", "rank")


_ASKED = """
    asked as (
        select listener request_id, listener, b.song_id current_song_id,
               case when cast(listener as bigint) % 7 = 0 then null when cast(listener as bigint) % 7 = 1 then 'nobody plays it'
                    else coalesce(f.genre, 'g1') end genre_context,
               case when cast(listener as bigint) % 5 < 2 then concat('g', cast(cast(listener as bigint) % 10 as string)) end dominant_genre
        from (select *, row_number() over (partition by listener order by ts desc, id desc) back from behavior) b
        left join features f on f.song_id = b.song_id where back = 1)"""


def _asked(spark, folder):
    """The last song of every listener, with features or not; some genres are not known, some not given."""
    last = view(spark, folder, "behavior").groupBy("listener").agg(
        F.max(F.struct("ts", "id", "song_id")).getField("song_id").alias("current_song_id"))
    genres = view(spark, folder, "features").select(F.col("song_id").alias("current_song_id"), "genre")
    number = F.col("listener").cast("bigint")
    return last.join(genres, "current_song_id", "left").select(
        F.col("listener").alias("request_id"), "listener", "current_song_id",
        F.when(number % 7 == 0, F.lit(None)).when(number % 7 == 1, "nobody plays it")
        .otherwise(F.coalesce("genre", F.lit("g1"))).alias("genre_context"),
        F.when(number % 5 < 2, F.concat(F.lit("g"), (number % 10).cast("string"))).alias("dominant_genre"))


@query(f"""
    with {_ASKED},
    pool as (
        select request_id, listener, c.song_id, c.similarity,
               row_number() over (partition by request_id order by c.similarity desc, c.song_id) place
        from asked r join cosines c on c.query_id = r.current_song_id and c.genre = r.genre_context),
    near as (
        select request_id, listener, s.song_id, s.similarity
        from asked r join similar_40 s on s.query_id = r.current_song_id join features f on f.song_id = s.song_id
        where f.genre is distinct from r.genre_context),
    scored as (
        select request_id, source, p.song_id, round(similarity * (1 + coalesce(preference, 0)), 6) + 0.0 score
        from (select request_id, listener, song_id, similarity, 'context' source from pool where place <= 40
              union all select request_id, listener, song_id, similarity, 'beside' from near) p
        left join listener_preference w on w.listener = p.listener and w.song_id = p.song_id),
    ranked as (
        select *, row_number() over (partition by request_id, source order by score desc, song_id) place,
               count(*) filter (source = 'context') over (partition by request_id) in_context from scored),
    found as (
        select request_id, song_id, score, source from ranked
        where place <= case when source = 'beside' and in_context > 0 then 4 else 20 end),
    ring as (
        select song_id, row_number() over (order by u, song_id) - 1 place, count(*) over () n
        from (select id song_id, (('0x' || substr(md5('queue|' || id), 1, 8))::bigint + 0.5::double) / 4294967296.0 u from songs_in)),
    drawn as (
        select request_id, song_id, -10.0::double - k.k score, 'random' source
        from (select *, (('0x' || substr(md5('queue|' || request_id), 1, 8))::bigint + 0.5::double) / 4294967296.0 u from asked) a
        cross join (select unnest(range(100)) k) k join ring r on r.place = (cast(floor(a.u * r.n) as bigint) + k.k) % r.n),
    everything as (
        select e.request_id, e.song_id, e.score, e.source, coalesce(f.genre = coalesce(dominant_genre, genre_context), false) dominant
        from (select * from found union all
              select * from drawn d where not exists (
                  select 1 from found x where x.request_id = d.request_id and x.song_id = d.song_id)) e
        join asked a on a.request_id = e.request_id left join features f on f.song_id = e.song_id
        where e.song_id <> a.current_song_id),
    kept as (
        select *, row_number() over (partition by request_id, dominant order by score desc, song_id) place from everything)
    select request_id, song_id, score, source, rank from (
        select *, cast(row_number() over (partition by request_id order by score desc, song_id) as int) rank
        from kept where place <= case when dominant then 16 else 20 end)
    where rank <= 20""")
def answered_queues(spark, folder):
    """Twenty songs for every listener: the wanted genre, a fifth beside the session's, and chance for the rest."""
    weights = behavior.preference(view(spark, folder, "labelled")).withColumnRenamed("preference", "weight")
    return ranking.answered_queue(
        _asked(spark, folder), view(spark, folder, "features"), weights, view(spark, folder, "songs_in"))


@query("""
    with latest as (
        select listener, target_energy from (
            select *, row_number() over (partition by listener order by shift_id desc) back from targets) where back = 1),
    queue as (select listener, song_id, round(preference, 6) score from listener_preference),
    adjusted as (
        select q.listener, q.song_id, q.score,
               round(round(q.score * (1 - coalesce(abs(f.energy - t.target_energy), 0)), 12), 6) adjusted
        from queue q left join features f on f.song_id = q.song_id left join latest t on t.listener = q.listener)
    select listener, song_id, score, adjusted,
           row_number() over (partition by listener order by adjusted desc, md5(song_id), song_id) - 1 as "position"
    from adjusted""")
def mood_reranked(spark, folder):
    events, features = view(spark, folder, "behavior"), view(spark, folder, "features")
    shifts = behavior.mood_shifts(events, seconds=86400)
    targets = behavior.mood_targets(events, shifts, features)
    latest = targets.groupBy("listener").agg(F.max_by("target_energy", "shift_id").alias("target_energy"))
    queue = behavior.preference(view(spark, folder, "labelled")).select(
        "listener", "song_id", F.round("preference", 6).alias("score")
    )
    return ranking.rerank_for_mood(queue, latest, features).select("listener", "song_id", "score", "adjusted", "position")


@query("""
    select listener, s.song_id, round(sum(similarity), 6) boost
    from labelled l join similar_40 s on s.query_id = l.song_id and s.rank <= 10
    where label = 1 group by listener, s.song_id""")
def similar_boosts(spark, folder):
    neighbours = similarity.similar_songs(view(spark, folder, "features"))
    boosted = ranking.boosts(view(spark, folder, "labelled"), neighbours)
    return boosted.withColumn("boost", F.round("boost", 6))


@query("""
    with recommended as (
        select distinct listener, song_id, cast(date_trunc('week', ts) as date) as week from behavior),
    accepted as (
        select distinct listener, song_id, cast(date_trunc('week', ts) as date) as week from behavior
        where event_type <> 'skip' and skip_position_pct > 50)
    select cast(r.week as varchar) as week, count(*) recommended, count(a.listener) accepted,
           round(count(a.listener) / count(*), 6) rate
    from recommended r left join accepted a on a.listener = r.listener and a.song_id = r.song_id and a.week = r.week
    group by r.week""")
def acceptance_rate(spark, folder):
    events = view(spark, folder, "behavior")
    recommended = events.select("listener", "song_id", F.date_trunc("week", "ts").cast("date").alias("week")).distinct()
    rates = ranking.acceptance(recommended, events)
    return rates.select(F.col("week").cast("string").alias("week"), "recommended", "accepted", F.round("rate", 6).alias("rate"))


_DAILY = f"""
    with bounds as (select min(energy) low, max(energy) high from features),
    fit as (select song_id, round(1 - abs((energy - low) / (high - low) - 0.5), 6) fit from features, bounds),
    heard as (select listener, song_id, max(ts) last from behavior where ts < timestamp '{AS_OF}' group by all),
    everyone as (select distinct listener from heard),
    scored as (
        select h.listener, h.song_id, round(coalesce(preference, 0.5) * (1 - exp(
                   -((epoch_us(timestamp '{AS_OF}') - epoch_us(last)) / 86400000000) / 7)) * fit, 6) score
        from heard h join fit f on f.song_id = h.song_id
        left join listener_preference p on p.listener = h.listener and p.song_id = h.song_id
        where last < timestamp '{AS_OF}' - interval 3 day and coalesce(preference, 0.5) > 0.4
        union all
        select e.listener, f.song_id, round(0.5 * fit, 6) from everyone e, fit f
        where not exists (select 1 from heard h where h.listener = e.listener and h.song_id = f.song_id))
    select listener, song_id, score, rank from (
        select *, cast(row_number() over (
            partition by listener order by score desc, md5(song_id), song_id) as int) rank from scored)
    where rank <= 8"""


@query(_DAILY)
def daily_picks(spark, folder):
    preferences = behavior.preference(view(spark, folder, "labelled"))
    found = picks.daily_picks(view(spark, folder, "behavior"), preferences, view(spark, folder, "features"), NOW)
    return found.select("listener", "song_id", "score", "rank")


@query(f"select *, '2024-01-31' pick_date from ({_DAILY})")
def daily_table(spark, folder):
    """Picks stored by day: another day's, then this day's, made once and read from then on."""
    path = f"{shared_folder(spark).rstrip('/')}/daily-{uuid.uuid4().hex}"
    found = durable(daily_picks(spark, folder))
    tables.write_daily_picks(found.filter("rank = 1"), "2024-01-30", path)
    tables.picks_of_day(spark, path, "2024-01-31", lambda: found)
    return tables.picks_of_day(spark, path, "2024-01-31", lambda: found.limit(0))


_WEEK = f"""
    recent as (
        select distinct listener, song_id from behavior
        where ts >= timestamp '{AS_OF}' - interval 7 day and ts < timestamp '{AS_OF}'),
    played as (select * from unit_features where song_id in (select song_id from recent)),
    seeds as (
        select cast(row_number() over (order by song_id) - 1 as int) cluster, u from played qualify cluster < 5),
    step0 as (
        select song_id, any_value(p.u) u, min({{'d': round(list_sum(list_transform(list_zip(p.u, s.u),
                   lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9), 'c': cluster}}).c cluster
        from played p, seeds s group by song_id),
    cells as (select cluster, unnest(u) x, generate_subscripts(u, 1) i from step0),
    moved as (
        select cluster, list(x order by i) u from (select cluster, i, avg(x) x from cells group by cluster, i)
        group by cluster),
    centres as (select s.cluster, coalesce(m.u, s.u) u from seeds s left join moved m on m.cluster = s.cluster),
    clusters as (
        select song_id, min({{'d': round(list_sum(list_transform(list_zip(p.u, s.u),
                   lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9), 'c': cluster}}).c cluster
        from played p, centres s group by song_id),
    drawn as (
        select r.listener, r.song_id, cluster, round(-ln((('0x' || substr(md5('w|' || r.listener || '|' || r.song_id), 1, 8))
                   ::bigint + 0.5::double) / 4294967296.0) / coalesce(preference, 0.5), 9) draw
        from recent r join clusters c on c.song_id = r.song_id
        left join listener_preference p on p.listener = r.listener and p.song_id = r.song_id),
    turns as (
        select *, row_number() over (partition by listener, cluster order by draw, song_id) turn from drawn),
    sampled as (
        select listener, song_id, row_number() over (partition by listener order by turn, draw, song_id) place
        from turns),
    tastes as (
        select listener, list(x order by i) v from (
            select listener, i, avg(x) x from (
                select listener, unnest(u) x, generate_subscripts(u, 1) i
                from recent r join unit_features f on f.song_id = r.song_id)
            group by listener, i)
        group by listener),
    found as (
        select listener, song_id, row_number() over (partition by listener order by round(list_inner_product(v, u)
                   / sqrt(list_inner_product(v, v)), 6) desc, song_id) place
        from tastes, unit_features where song_id not in (select song_id from behavior)),
    sizes as (select listener, least(count(*), 22) n from sampled group by listener)"""


@query(f"""with {_WEEK}
    select listener, cast(place as int) "position", song_id, 'sampled' kind from sampled where place <= 22
    union all
    select f.listener, cast(coalesce(n, 0) + place as int), song_id, 'discovery'
    from found f left join sizes s on s.listener = f.listener where place <= 3""")
def weekend_playlists(spark, folder):
    return picks.weekend_playlist(
        view(spark, folder, "behavior"), behavior.preference(view(spark, folder, "labelled")),
        view(spark, folder, "features"), NOW, "w", steps=1,
    )


@query()
def weekend_playlists_kmeans(spark, folder):
    return picks.weekend_playlist(
        view(spark, folder, "behavior"), behavior.preference(view(spark, folder, "labelled")),
        view(spark, folder, "features"), NOW, "w",
    )


@query("""
    select listener, song_id, epoch_us(played_at) played_us, rank from (
        select *, cast(row_number() over (partition by listener order by played_at desc, song_id) as int) rank from (
            select listener, song_id, max(ts) played_at from behavior where event_type <> 'skip' group by all))
    where rank <= 4""")
def recently_played(spark, folder):
    recent = picks.recently_played(view(spark, folder, "behavior"))
    return recent.select("listener", "song_id", F.unix_micros("played_at").alias("played_us"), "rank")
