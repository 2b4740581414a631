"""Queries over the catalog, playlists, scalar functions and queues."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from cadenza.functions import scalars as S
from cadenza.operators import catalog, picks, playlists, queues
from cadenza.plans.registry import query
from cadenza.plans.standins import AS_OF, table, view
from cadenza.sources.m3u import decode_text, parse_m3u
from cadenza.session import durable, shared_folder
from cadenza.sources import tables
from cadenza.sources.tables import features_from_text, features_to_text

NOW = datetime.fromisoformat(AS_OF)
SONG = "id, title, artist, album, file_path, duration_ms"


@query(f"select {SONG} from songs_in")
def catalog_scan(spark, folder):
    return view(spark, folder, "songs_in")


@query(f"select {SONG} from songs_in order by lower(title), id")
def device_songs(spark, folder):
    return catalog.list_device_songs(view(spark, folder, "songs_in"))


@query("""
    select id, title, coalesce(artist, 'Unknown Artist') artist, coalesce(album, 'Unknown Album') album,
           file_path, coalesce(duration_ms, 0) duration_ms
    from songs_in where file_path is not null""")
def cleaned_songs(spark, folder):
    return catalog.clean_incoming(view(spark, folder, "songs_in"))


@query("""
    select id, title, coalesce(artist, 'Unknown Artist') artist, album, coalesce(file_path, '') file_path,
           coalesce(duration_ms, 0) duration_ms, cast(null as string) genre_tag,
           epoch_us(case when album <> 'SMALL' then timestamp '2024-01-02 03:04:05' end) indexed_us,
           cast(null as bigint) created_us
    from songs_in""")
def songs_with_defaults(spark, folder):
    rows = view(spark, folder, "songs_in").select(
        "*", F.lit(None).cast("string").alias("genre_tag"),
        F.when(F.col("album") == "SMALL", "soon").otherwise("2024-01-02T03:04:05").alias("indexed_at"),
        F.col("title").alias("created_at"),
    )
    filled = catalog.fill_on_read(rows)
    return filled.select(
        *filled.columns[:7], F.unix_micros("indexed_at").alias("indexed_us"),
        F.unix_micros("created_at").alias("created_us"),
    )


@query(f"""
    select id, title, artist, album, file_path, duration_ms, cast(null as string) genre_tag,
           cast(null as bigint) indexed_us, epoch_us(timestamp '{AS_OF}') created_us
    from songs_in where file_path is not null""")
def insert_rows(spark, folder):
    rows = catalog.insert_rows(catalog.drop_pathless(view(spark, folder, "songs_in")), NOW)
    return rows.select(
        *rows.columns[:7], F.unix_micros("indexed_at").alias("indexed_us"),
        F.unix_micros("created_at").alias("created_us"),
    )


@query("""
    select s.id, s.title, coalesce(f.artist, s.artist) artist, s.album, s.file_path,
           coalesce(f.duration_ms, s.duration_ms) duration_ms
    from songs_in s left join (
        select song_id, case when energy > 0.2 then genre end artist, cast(tempo as bigint) duration_ms
        from features) f on f.song_id = s.id""")
def patched_songs(spark, folder):
    changes = view(spark, folder, "features").select(
        F.col("song_id").alias("id"), F.when(F.col("energy") > 0.2, F.col("genre")).alias("artist"),
        F.col("tempo").cast("long").alias("duration_ms"),
    )
    return catalog.patch(view(spark, folder, "songs_in"), changes).select(*SONG.split(", "))


@query(f"""
    select {SONG} from songs_in
    where lower(title) like '%ri_g%' or lower(artist) like '%ri_g%' or lower(album) like '%ri_g%'""")
def song_search(spark, folder):
    return catalog.search(view(spark, folder, "songs_in"), "RI_G")


@query("""
    select e.playlist_id, e.line_no, e.path file_path, s.id song_id
    from m3u_entries e left join (select file_path, min(id) id from songs_in group by file_path) s
    on s.file_path = e.path""")
def path_lookup(spark, folder):
    paths = view(spark, folder, "m3u_entries").select("playlist_id", "line_no", F.col("path").alias("file_path"))
    return catalog.lookup_paths(paths, view(spark, folder, "songs_in")).select(
        "playlist_id", "line_no", "file_path", "song_id"
    )


@query("""
    select b.id, b.song_id, f.genre, round(f.energy, 6) energy
    from behavior b left join features f on f.song_id = b.song_id""")
def feature_lookup(spark, folder):
    found = catalog.lookup_ids(view(spark, folder, "behavior").select("id", "song_id"), view(spark, folder, "features"))
    return found.select("id", "song_id", "genre", F.round("energy", 6).alias("energy"))


@query("""
    with first as (
        select * from songs_incoming where batch_order < 1000000000000 and file_path is not null
        and id not in (select id from songs_existing) and file_path not in (select file_path from songs_existing)),
    second as (
        select * from songs_incoming where batch_order >= 1000000000000 and batch_order < 2000000000000
        and id not in (select id from songs_existing) and id not in (select id from first)),
    third as (
        select * from songs_incoming where batch_order >= 2000000000000 and file_path is not null
        and file_path not in (select file_path from songs_existing)
        and file_path not in (select file_path from first))
    select * from first union all select * from second union all select * from third""")
def inserted_songs(spark, folder):
    incoming = view(spark, folder, "songs_incoming")
    return catalog.insert_ignore(view(spark, folder, "songs_existing"), incoming, "batch_order")


@query("""
    with f as (select id song_id from songs_in where file_path is null union all select song_id from behavior),
    entries as (select playlist_id, cast(l_partkey as string) song_id from m3u_entries)
    select 'songs' "table", 'id' columns, 'primary key' rule, id "key", count(*) "rows"
    from songs_incoming group by id having count(*) > 1
    union all
    select 'songs', 'file_path', 'unique', coalesce(file_path, ''), count(*) from songs_incoming
    group by file_path having count(*) > 1
    union all
    select 'songs', 'file_path', 'not null', null, count(*) from songs_incoming where file_path is null
    having count(*) > 0
    union all
    select 'song_features', 'song_id', 'primary key', song_id, count(*) from f group by song_id having count(*) > 1
    union all
    select 'song_features', 'song_id', 'foreign key', song_id, count(*) from f
    where song_id not in (select id from songs_incoming) group by song_id
    union all
    select 'playlist_songs', 'playlist_id,song_id', 'primary key', playlist_id || ',' || song_id, count(*)
    from entries group by playlist_id, song_id having count(*) > 1
    union all
    select 'playlist_songs', 'song_id', 'foreign key', song_id, count(*) from entries
    where song_id not in (select id from songs_incoming) group by song_id""")
def constraint_violations(spark, folder):
    songs = view(spark, folder, "songs_incoming")
    pathless = view(spark, folder, "songs_in").filter("file_path is null").select(F.col("id").alias("song_id"))
    features = pathless.unionByName(view(spark, folder, "behavior").select("song_id"))
    entries = view(spark, folder, "m3u_entries").select("playlist_id", F.col("l_partkey").cast("string").alias("song_id"))
    return catalog.violations(songs, features, entries)


@query("""
    select sha256(path) id, regexp_extract(path, '[^/]*$') title, path file_path
    from (select distinct path from m3u_entries)
    where path not in (select file_path from songs_existing)""")
def registered_paths(spark, folder):
    paths = view(spark, folder, "m3u_entries").select(F.col("path").alias("file_path"))
    new = catalog.register_paths(paths, view(spark, folder, "songs_existing"), NOW)
    return new.select("id", "title", "file_path")


@query("""
    with given as (select id, cast(p_size as double) tempo, p_retailprice energy
                   from songs_in join part on id = cast(p_partkey as string)
                   where album in ('ECONOMY', 'SMALL')),
    stored as (select song_id, tempo, energy, epoch_us(extracted_at) extracted_us from indexed)
    select coalesce(s.song_id, g.id) song_id, case when g.id is not null then g.tempo else s.tempo end tempo,
           round(case when g.id is not null then g.energy else s.energy end, 6) energy,
           coalesce(extracted_us, epoch_us(timestamp '2024-01-31 00:00:00')) extracted_us
    from stored s full join given g on s.song_id = g.id""")
def feature_upsert(spark, folder):
    part = table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("song_id"), F.col("p_type"),
        F.col("p_size").cast("double").alias("tempo"), F.col("p_retailprice").alias("energy"),
    )
    given = part.filter(F.col("p_type").isin("ECONOMY", "SMALL")).drop("p_type")
    earlier = given.withColumn("tempo", F.col("tempo") - 1).withColumn("version", F.lit(1))
    saved = earlier.unionByName(given.withColumn("version", F.lit(2)))
    rows = catalog.upsert_features(view(spark, folder, "indexed"), saved, "version", NOW)
    return rows.select(
        "song_id", "tempo", F.round("energy", 6).alias("energy"), F.unix_micros("extracted_at").alias("extracted_us")
    )


@query("""
    select song_id, cast(len(full_vector) as int) width, round(list_sum(cast(full_vector as double[])), 6) total
    from features""")
def feature_text_round_trip(spark, folder):
    rows = view(spark, folder, "features").select("song_id", F.col("full_vector").cast("array<double>").alias("full_vector"))
    back = features_from_text(features_to_text(rows))
    total = F.aggregate("full_vector", F.lit(0.0), lambda s, x: s + x)
    return back.select("song_id", F.size("full_vector").alias("width"), F.round(total, 6).alias("total"))


@query("select * from songs_existing where id not in (select song_id from indexed)")
def unindexed_songs(spark, folder):
    songs = view(spark, folder, "songs_existing")
    return catalog.unindexed(songs, view(spark, folder, "indexed")).select(*songs.columns)


@query("select id, title from songs_existing where id in (select song_id from indexed)")
def indexed_songs(spark, folder):
    return catalog.already_indexed(view(spark, folder, "songs_existing"), view(spark, folder, "indexed")).select("id", "title")


@query("select path file_path, playlist_id from m3u_entries where path not in (select file_path from listing)")
def missing_files(spark, folder):
    paths = view(spark, folder, "m3u_entries").select(F.col("path").alias("file_path"), "playlist_id")
    return catalog.missing_files(paths, view(spark, folder, "listing"))


_RESOLVED = """
    resolved as (
        select e.playlist_id, s.song_id, cast(row_number() over (
            partition by e.playlist_id order by e.line_no, e.l_partkey) - 1 as int) "position"
        from m3u_entries e join (
            select file_path, min(id) song_id from songs_in group by file_path) s on s.file_path = e.path),
    bad as (
        select playlist_id, count(*) repeated_songs from (
            select playlist_id, song_id from resolved group by playlist_id, song_id having count(*) > 1)
        group by playlist_id)"""
_LINES = ("line_no", "l_partkey")


@query(f"with {_RESOLVED} select playlist_id, song_id, position from resolved")
def playlist_resolve(spark, folder):
    found = playlists.resolve(view(spark, folder, "m3u_entries"), view(spark, folder, "songs_in"), _LINES)
    return found.select("playlist_id", "song_id", "position")


@query(f"""with {_RESOLVED} select playlist_id, song_id, position from resolved
           where playlist_id not in (select playlist_id from bad)""")
def playlist_import(spark, folder):
    return playlists.import_entries(view(spark, folder, "m3u_entries"), view(spark, folder, "songs_in"), _LINES)


@query(f"with {_RESOLVED} select * from bad")
def playlist_rejected(spark, folder):
    return playlists.rejected(view(spark, folder, "m3u_entries"), view(spark, folder, "songs_in"))


@query(f"""with {_RESOLVED},
    firsts as (select playlist_id, song_id, min(position) place from resolved group by playlist_id, song_id)
    select playlist_id, song_id, cast(row_number() over (partition by playlist_id order by place) - 1 as int) "position"
    from firsts""")
def playlist_import_first(spark, folder):
    return playlists.import_entries(
        view(spark, folder, "m3u_entries"), view(spark, folder, "songs_in"), _LINES, on_duplicate="first"
    )


@query("""
    select sha256(playlist_id) id, 'list ' || playlist_id "name", 'manual' "type", epoch_us(timestamp '2024-01-31 00:00:00') created_us,
           '{}' metadata from (select distinct playlist_id from m3u_entries)""")
def playlist_headers(spark, folder):
    lists = view(spark, folder, "m3u_entries").select("playlist_id").distinct().withColumn(
        "name", F.concat(F.lit("list "), "playlist_id")
    )
    rows = playlists.headers(lists, NOW, F.col("playlist_id"))
    return rows.select("id", "name", "type", F.unix_micros("created_at").alias("created_us"), "metadata")


@query("""
    with songs as (select id, title, cast(id as bigint) % 3 part from songs_in where file_path is not null)
    select 'during' seen, id, title from songs
    union all
    select 'after', id, case when part = 1 then upper(title) else title end from songs where part <> 1 or cast(id as bigint) % 2 = 0""")
def batches_committed(spark, folder):
    """Songs in three batches, one of them written again, as a reader sees them before and after the pointer moves."""
    path = f"{shared_folder(spark).rstrip('/')}/songs-{uuid.uuid4().hex}"
    songs = catalog.insert_rows(catalog.drop_pathless(view(spark, folder, "songs_in")), NOW)
    part, seen = F.col("id").cast("bigint") % 3, []
    for number in range(3):
        tables.append_songs(songs.filter(part == number), path, f"part {number}")
    again = songs.filter((part == 1) & (F.col("id").cast("bigint") % 2 == 0)).withColumn("title", F.upper("title"))
    tables.append_songs(again, path, "part 1", lambda: seen.append(durable(tables.read_songs(spark, path))))
    rows = lambda df, when: df.select(F.lit(when).alias("seen"), "id", "title")
    return rows(seen[0], "during").unionByName(rows(tables.read_songs(spark, path), "after"))


@query("""
    select playlist_id, cast(l_partkey as string) song_id, cast(line_no as int) "position"
    from m3u_entries where playlist_id not like '%3'""")
def playlist_committed(spark, folder):
    """One import that stops before its headers and is run again, and one that never writes them."""
    target = f"{shared_folder(spark).rstrip('/')}/playlists-{uuid.uuid4().hex}"
    entries = view(spark, folder, "m3u_entries").select(
        "playlist_id", F.col("l_partkey").cast("string").alias("song_id"), F.col("line_no").cast("int").alias("position")
    )
    first, second = entries.filter("playlist_id not like '%3'"), entries.filter("playlist_id like '%3'")
    tables.write_playlist_songs(first.filter("position < 3"), target, "first")
    tables.write_playlist_songs(first, target, "first")
    heads = playlists.headers(first.select("playlist_id").distinct().withColumn("name", F.col("playlist_id")), NOW, F.col("name"))
    tables.write_playlists(heads.withColumn("id", F.col("name")), target, "first")
    tables.write_playlist_songs(second, target, "second")
    return tables.read_playlist_songs(spark, target)


@query("""
    select playlist_id, genre, songs, round(songs / sum(songs) over (partition by playlist_id), 6) as share from (
        select e.playlist_id, s.album genre, count(*) songs
        from m3u_entries e join songs_in s on s.id = cast(e.l_partkey as string) group by 1, 2)""")
def playlist_genres(spark, folder):
    entries = view(spark, folder, "m3u_entries").select("playlist_id", F.col("l_partkey").cast("string").alias("song_id"))
    genres = view(spark, folder, "songs_in").select(F.col("id").alias("song_id"), F.col("album").alias("genre"))
    shares = playlists.genre_distribution(entries, genres)
    return shares.withColumn("share", F.round("share", 6))


_SPACE = "\\x09-\\x0D\\x20\\x85\\xA0\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"


@query(f"""
    with pieces as (
        select doc_id, source, regexp_split_to_array(text, '\\r\\n|\\r|\\n') parts from {{documents}}),
    lines as (
        select doc_id, source, unnest(parts) raw, generate_subscripts(parts, 1) - 1 line_no from pieces),
    kept as (
        select *, regexp_replace(raw, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g') line from lines)
    select '/lists/' || source || '/' || cast(doc_id as varchar) || '.m3u' playlist_path, cast(line_no as int) line_no,
           md5(case when regexp_matches(line, '^(/|[a-zA-Z]:\\\\|content://)') then line
                    else '/lists/' || source || '/' || line end) path_md5
    from kept where line <> '' and line not like '#%'""")
def m3u_entries_of_texts(spark, folder):
    path = F.concat(F.lit("/lists/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".m3u"))
    texts = table(spark, folder, "documents").select(path.alias("playlist_path"), "text")
    return parse_m3u(texts).select("playlist_path", "line_no", F.md5("path").alias("path_md5"))


@query("""
    select doc_id, md5(text) utf8_md5,
           md5(regexp_replace(text, '[^\\x{0}-\\x{7F}\\x{A0}-\\x{FF}]', '?', 'g')) western_md5
    from {documents}""")
def decoded_texts(spark, folder):
    western = F.regexp_replace("text", r"[^\x{0}-\x{7F}\x{A0}-\x{FF}]", "?")
    return table(spark, folder, "documents").select(
        "doc_id", F.md5(decode_text(F.col("text").cast("binary"))).alias("utf8_md5"),
        F.md5(decode_text(F.encode(western, "ISO-8859-1"))).alias("western_md5"),
    )


@query("""
    select id, cast(duration_ms // 60000 as varchar) || ':' || lpad(cast(duration_ms // 1000 % 60 as varchar), 2, '0') text
    from songs_in where duration_ms is not null""")
def duration_texts(spark, folder):
    songs = view(spark, folder, "songs_in").filter("duration_ms is not null")
    return songs.select("id", S.duration_text(F.col("duration_ms")).alias("text"))


@query("""
    select id, case when extract(hour from ts) < 12 then 'morning' when extract(hour from ts) < 17 then 'afternoon'
                    else 'evening' end part from behavior""")
def day_parts(spark, folder):
    return view(spark, folder, "behavior").select("id", S.day_part(F.col("ts")).alias("part"))


@query("""
    select id, regexp_extract(replace(file_path, '/', chr(92)), '[^' || chr(92) || chr(92) || ']*$') file_name,
           regexp_extract(file_path, '[^/]*$') base_name, file_path like '%3.mp3' is_third,
           lower(file_path) like '%.wav' is_wav
    from songs_in where file_path is not null""")
def path_parts(spark, folder):
    path = F.col("file_path")
    songs = view(spark, folder, "songs_in").filter("file_path is not null")
    return songs.select(
        "id", S.file_name(F.replace(path, F.lit("/"), F.lit("\\"))).alias("file_name"),
        S.base_name(path).alias("base_name"), path.endswith("3.mp3").alias("is_third"), S.is_wav(path).alias("is_wav"),
    )


@query("select id, sha256(file_path) stable, 36 random_length, true as differ from songs_in where file_path is not null")
def song_ids(spark, folder):
    songs = view(spark, folder, "songs_in").filter("file_path is not null").select(
        "id", "file_path", S.random_id().alias("one"), S.random_id().alias("other")
    )
    return songs.select(
        "id", S.stable_id(F.col("file_path")).alias("stable"), F.length("one").alias("random_length"),
        (F.col("one") != F.col("other")).alias("differ"),
    )


@query("""
    select id, case when epoch_us(ts) % 1000 = 0 then left(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), 23)
                    else strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') end iso, epoch_us(ts) back_us, cast(null as bigint) bad_us
    from behavior""")
def iso_times(spark, folder):
    iso = S.iso_text(F.col("ts"))
    return view(spark, folder, "behavior").select(
        "id", iso.alias("iso"), F.unix_micros(S.parse_time(iso)).alias("back_us"),
        F.unix_micros(S.parse_time(F.col("event_type"))).alias("bad_us"),
    )


@query("select album, count(*) songs, cast(sum(duration_ms) as bigint) duration_ms from songs_in group by album")
def browse_albums(spark, folder):
    return picks.browse(view(spark, folder, "songs_in"), "album")


@query("select artist, count(*) songs, cast(sum(duration_ms) as bigint) duration_ms from songs_in group by artist")
def browse_artists(spark, folder):
    return picks.browse(view(spark, folder, "songs_in"), "artist")


@query("select song_id, genre from features where genre = 'g3'")
def genre_chip(spark, folder):
    return picks.filter_genre(view(spark, folder, "features"), "g3", "genre").select("song_id", "genre")


@query("""
    select s.id, case when lower(title) like '%ring%' or lower(title) like '%rod%' then 'Punjabi'
                      when lower(title) like '%widget%' then 'Hindi'
                      when p_size > 15 and p_retailprice > 910 then 'Energetic' else 'Calm' end genre_tag
    from songs_in s join part on s.id = cast(p_partkey as string)""")
def genre_by_words(spark, folder):
    part = table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("id"), (F.col("p_size") / 100).alias("energy"),
        (F.col("p_retailprice") - 800).alias("tempo"),
    )
    songs = view(spark, folder, "songs_in").join(part, "id")
    words = {"Punjabi": ["Ring", "rod"], "Hindi": ["widget"]}
    return picks.tag_genres(songs, words).select("id", "genre_tag")


_LISTS = """
    lists as (
        select queue_id, cast(row_number() over (partition by queue_id order by seq desc) - 1 as bigint) "position", song_id
        from queue_additions)"""


def _lists(spark, folder):
    return queues.number_rows(
        view(spark, folder, "queue_additions"), ["queue_id"], [F.desc("seq")], [queues.span(-F.col("seq"), 65536)], "position"
    ).select("queue_id", "position", "song_id")


@query(f"""with {_LISTS}
    select queue_id, position, song_id from queues where queue_id not in (select queue_id from lists)
    union all select queue_id, position, song_id from lists""")
def queue_replace(spark, folder):
    return queues.replace(view(spark, folder, "queues"), _lists(spark, folder))


@query(f"""with {_LISTS}
    select queue_id, case when queue_id in (select queue_id from lists) then 0 else current_index end current_index
    from queue_state""")
def queue_started(spark, folder):
    return queues.start_at(view(spark, folder, "queue_state"), _lists(spark, folder))


@query("""
    select queue_id, position, song_id from queues
    union all
    select queue_id, (select max(position) + 1 from queues q where q.queue_id = a.queue_id)
           + row_number() over (partition by queue_id order by seq) - 1, song_id
    from queue_additions a""")
def queue_append(spark, folder):
    return queues.append(view(spark, folder, "queues"), view(spark, folder, "queue_additions"))


@query("""
    with n as (select queue_id, count(*) added from queue_additions group by queue_id),
    cur as (select s.queue_id, current_index, added from queue_state s join n on n.queue_id = s.queue_id
            where current_index <> -1)
    select q.queue_id, case when q.position > cur.current_index then q.position + added else q.position end "position", song_id
    from queues q left join cur on cur.queue_id = q.queue_id
    union all
    select a.queue_id, current_index + row_number() over (partition by a.queue_id order by seq desc), song_id
    from queue_additions a join cur on cur.queue_id = a.queue_id""")
def queue_play_next(spark, folder):
    return queues.play_next(
        view(spark, folder, "queues"), view(spark, folder, "queue_state"), view(spark, folder, "queue_additions")
    )


@query("""
    select s.queue_id, s.current_index, q.song_id
    from queue_state s left join queues q on q.queue_id = s.queue_id and q.position = s.current_index""")
def queue_current(spark, folder):
    return queues.current_songs(view(spark, folder, "queues"), view(spark, folder, "queue_state"))


@query("""
    select queue_id, position, song_id, cast(row_number() over (
        partition by queue_id order by md5('s1|' || queue_id || '|' || cast(position as varchar) || '|' || song_id)) - 1
        as bigint) play_order from queues""")
def queue_shuffle(spark, folder):
    return queues.shuffle(view(spark, folder, "queues"), "s1").select("queue_id", "position", "song_id", "play_order")


def _register_repeat(mode, expression):
    @query(f"""
        select s.queue_id, s.current_index, {expression} next_index
        from queue_state s join (select queue_id, count(*) n from queues group by queue_id) q
        on q.queue_id = s.queue_id""", name=f"queue_repeat_{mode}")
    def run(spark, folder):
        return queues.next_index(view(spark, folder, "queues"), view(spark, folder, "queue_state"), mode)


_register_repeat("one", "current_index")
_register_repeat("all", "(current_index + 1) % n")
_register_repeat("off", "case when current_index + 1 < n then current_index + 1 end")


@query("""
    select q.queue_id, q.position, q.song_id, cast(row_number() over (
        partition by q.queue_id order by md5('s2|' || q.queue_id || '|' || cast(q.position as varchar) || '|' || q.song_id)) - 1
        as bigint) play_order
    from queues q join orders o on q.song_id = cast(o.o_orderkey as string) where o.o_orderpriority = '1-URGENT'""")
def genre_shuffle(spark, folder):
    genres = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("song_id"), F.col("o_orderpriority").alias("genre")
    )
    shuffled = picks.shuffle_genre(view(spark, folder, "queues"), genres, "1-URGENT", "s2")
    return shuffled.select("queue_id", "position", "song_id", "play_order")


@query("""
    with keyed as (
        select id song_id, (('0x' || substr(md5('r|' || id), 1, 8))::bigint + 0.5::double) / 4294967296.0 u from songs_in),
    ring as (select song_id, row_number() over (order by u, song_id) - 1 place, count(*) over () n from keyed),
    asked as (
        select distinct queue_id, (('0x' || substr(md5('r|' || queue_id), 1, 8))::bigint + 0.5::double) / 4294967296.0 u
        from queues)
    select a.queue_id request_id, cast(k.k as int) "position", r.song_id
    from asked a cross join (select unnest(range(10)) k) k
    join ring r on r.place = (cast(floor(a.u * r.n) as bigint) + k.k) % r.n""")
def random_queues(spark, folder):
    requests = view(spark, folder, "queues").select(F.col("queue_id").alias("request_id")).distinct()
    return picks.random_queue(requests, view(spark, folder, "songs_in"), "r", 10)
