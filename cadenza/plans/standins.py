"""Views that give the driver's tables the shape of a music library.

Each text runs unchanged on Spark and in the check SQL. Names in braces are the
driver's tables; other views are referred to by their plain name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from cadenza.operators.pieces import number_rows, span

TABLES = ("part", "events", "embeddings", "lineitem", "orders", "documents")

# The clock of all queries that need one; the events end a day before it.
AS_OF = "2024-01-31 00:00:00"

VIEWS = {
    "songs_in": """
        select cast(p_partkey as string) id, p_name title,
               case when p_size % 10 = 0 then null else p_brand end artist, p_type album,
               case when p_partkey % 97 = 0 then null
                    else concat('/music/', p_brand, '/', cast(p_partkey as string), '.mp3') end file_path,
               case when p_size % 7 = 0 then null else cast(p_size as bigint) * 10000 end duration_ms
        from {part}""",
    # What the catalog already holds: the parts of three of the six types.
    "songs_existing": """
        select id, title, artist, album, file_path, duration_ms,
               cast(null as string) genre_tag, cast(null as timestamp) indexed_at,
               cast('2024-01-01 00:00:00' as timestamp) created_at
        from songs_in where album in ('ECONOMY', 'STANDARD', 'PROMO') and file_path is not null""",
    # Every row twice more: once with its id under another path, once with its path under another id.
    "songs_incoming": """
        select id, title, artist, album, file_path, duration_ms, cast(id as bigint) batch_order from songs_in
        union all
        select id, title, artist, album, concat('/copies/', id, '.mp3'), duration_ms,
               1000000000000 + cast(id as bigint) from songs_in
        union all
        select concat('copy-', id), title, artist, album, file_path, duration_ms,
               2000000000000 + cast(id as bigint) from songs_in""",
    "features": """
        select cast(vec_id as string) song_id, concat('g', cast(label as string)) genre,
               embedding full_vector, cast((vec_id * 37) % 100 as double) / 250 energy,
               cast(60 + (vec_id * 53) % 120 as double) tempo
        from {embeddings}""",
    # One event in 17 is of a song that has no features yet.
    "behavior": """
        select event_id id, cast(user_id as string) listener,
               concat(case when event_id % 17 = 0 then 'new-' else '' end, regexp_extract(props, '[0-9]+', 0)) song_id,
               case when event_type in ('click', 'error') then 'skip'
                    when event_type = 'purchase' then 'replay' else 'play' end event_type,
               value - 100 * floor(value / 100) skip_position_pct, cast(ts as timestamp) ts
        from {events}""",
    "m3u_entries": """
        select cast(l.l_orderkey as string) playlist_id, l.l_linenumber line_no, l.l_partkey,
               concat('/music/', p.p_brand, '/', cast(p.p_partkey as string), '.mp3') path
        from {lineitem} l join {part} p on l.l_partkey = p.p_partkey""",
    "queues": """
        select cast(o_custkey as string) queue_id,
               cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as bigint) as position,
               cast(o_orderkey as string) song_id
        from {orders}""",
    # What plays in each queue: nothing where the customer number ends in 0.
    "queue_state": """
        select queue_id, case when queue_id like '%0' then cast(-1 as bigint)
                              else cast(floor(count(*) / 2) as bigint) end current_index
        from queues group by queue_id""",
    # Songs to be put into queues: those of the customer's unfinished orders.
    "queue_additions": """
        select cast(o_custkey as string) queue_id, o_orderkey seq, concat('n', cast(o_orderkey as string)) song_id
        from {orders} where o_orderstatus = 'O'""",
    "frames": """
        select cast(l_partkey as string) song_id, l_quantity q, l_discount * 100 d, l_tax * 100 t
        from {lineitem}""",
    "index_requests": """
        select l_orderkey * 10000000 + l_partkey seq,
               concat('/music/', p_brand, '/', cast(p_partkey as string), '.mp3') file_path
        from {lineitem} join {part} on l_partkey = p_partkey
        group by l_orderkey, l_partkey, p_brand, p_partkey""",
    # Files that exist: all but those of one type, which were moved away.
    "listing": """
        select file_path from songs_in where file_path is not null and album <> 'PROMO'""",
    # Songs indexed by an earlier run.
    "indexed": """
        select id song_id, cast(100 as double) tempo, 0.1 * duration_ms / 1000 energy,
               cast('2024-01-02 00:00:00' as timestamp) extracted_at
        from songs_existing where duration_ms is not null and album = 'ECONOMY'""",
    # What extraction gives per file; files of three sizes cannot be read.
    "analysed": """
        select file_path, case when p_size in (13, 26, 39) then 'cannot be read' end error,
               60 + p_retailprice - 850 tempo, cast(p_size as double) / 100 energy
        from songs_in join {part} on id = cast(p_partkey as string) where file_path is not null""",
    "index_log": """
        select concat('/files/', cast(o_orderkey as string)) file_path, cast(o_orderdate as timestamp) started_at,
               case when o_orderstatus = 'F' then cast(o_orderdate as timestamp) end finished_at
        from {orders}""",
    "labelled": """
        select id, listener, song_id, ts,
               case when event_type <> 'skip' and skip_position_pct > 80 then 1
                    when event_type = 'skip' and skip_position_pct < 20 then 0 end label
        from behavior
        where (event_type <> 'skip' and skip_position_pct > 80) or (event_type = 'skip' and skip_position_pct < 20)""",
}

# Views only the check SQL needs: the stated meaning of an operator others build on.
CHECK_VIEWS = {
    "unit_features": """
        select song_id, genre, energy, tempo,
               case when n > 0 then list_transform(v, lambda x: x / n) else v end u
        from (select *, sqrt(list_inner_product(v, v)) n
              from (select *, cast(full_vector as double[]) v from features))""",
    "cosines": """
        select a.song_id query_id, a.genre query_genre, b.song_id, b.genre,
               round(list_inner_product(a.u, b.u), 6) + 0.0 similarity
        from unit_features a join unit_features b on a.song_id <> b.song_id""",
    "similar_40": """
        select query_id, song_id, similarity, rank from (
            select *, cast(row_number() over (partition by query_id order by similarity desc, song_id) as int) rank
            from cosines) where rank <= 40""",
    "song_preference": """
        select song_id, (sum(label) + 1) / (count(*) + 2) weight from labelled group by song_id""",
    "listener_preference": """
        select listener, song_id, (sum(label) + 1) / (count(*) + 2) preference
        from labelled group by listener, song_id""",
    "session_events": """
        select *, cast(sum(opens) over (partition by listener order by ts, id) as bigint) session_no from (
            select *, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by listener order by ts, id))
                           <= 6 * 3600 * 1000000::bigint then 0 else 1 end opens
            from behavior)""",
    "runs": """
        select id, listener, song_id, ts,
               row_number() over (partition by listener order by ts, id) ordinal,
               event_type = 'skip' and lag(event_type, 1) over w = 'skip' and lag(event_type, 2) over w = 'skip'
               and epoch_us(ts) - epoch_us(lag(ts, 2) over w) <= 86400 * 1000000::bigint hit
        from behavior window w as (partition by listener order by ts, id)""",
    "run_steps": """
        select a.listener, a.ordinal, min(b.ordinal) next_ordinal
        from runs a left join runs b on a.listener = b.listener and b.hit and b.ordinal >= a.ordinal + 3
        where a.hit group by a.listener, a.ordinal""",
    "fired": """
        select listener, min(ordinal) ordinal from runs where hit group by listener
        union all
        select s.listener, s.next_ordinal from fired f join run_steps s
        on f.listener = s.listener and f.ordinal = s.ordinal where s.next_ordinal is not null""",
    "shifts": """
        select r.id, r.listener, r.song_id, r.ts from runs r join fired f
        on r.listener = f.listener and r.ordinal = f.ordinal""",
    "targets": """
        select listener, shift_id, avg(energy) target_energy, count(*) songs from (
            select s.listener, s.id shift_id, f.energy,
                   row_number() over (partition by s.id order by b.ts desc, b.id desc) back
            from shifts s join behavior b on s.listener = b.listener and b.event_type <> 'skip' and b.ts <= s.ts
            left join features f on f.song_id = b.song_id)
        where back <= 10 group by listener, shift_id""",
}

_ALL = {**VIEWS, **CHECK_VIEWS}


def _views_of(sql: str) -> list[str]:
    """Views a text uses, directly or through others, each after those it uses."""
    found: list[str] = []

    def visit(text: str, inside: str | None) -> None:
        for name in _ALL:
            if name != inside and name not in found and re.search(rf"(?<![\w.{{']){name}(?![\w}}'])", text):
                visit(_ALL[name], name)
                if name not in found:
                    found.append(name)

    visit(sql, None)
    return found


def check_sql(sql: str) -> str:
    """``sql`` with the views it uses in front, for the checking engine."""
    text = sql.strip()
    views = _views_of(text)
    if not views and "{" not in text:
        return text
    chain = ",\n".join(f"{name} as ({_ALL[name].strip()})" for name in views)
    recursive = "recursive " if "fired" in views else ""
    if text.lower().startswith("with "):
        whole = f"with {recursive}{chain},\n{text[5:]}" if views else text
    else:
        whole = f"with {recursive}{chain}\n{text}" if views else text
    for table in TABLES:
        whole = whole.replace("{" + table + "}", table)
    return whole


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of ``VIEWS`` as a DataFrame over the tables of ``folder``."""
    if name == "queues":
        return _queues(table(spark, folder, "orders"))
    inner = [v for v in _views_of(VIEWS[name]) if v != name]
    chain = ", ".join(f"{v} as ({VIEWS[v]})" for v in inner)
    text = (f"with {chain} " if inner else "") + VIEWS[name]
    used = {t: table(spark, folder, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def _queues(orders: DataFrame) -> DataFrame:
    """The queues view with positions counted piece by piece, however long a queue is."""
    rows = orders.select(F.col("o_custkey").cast("string").alias("queue_id"), "o_orderkey")
    numbered = number_rows(rows, ["queue_id"], ["o_orderkey"], [span(F.col("o_orderkey"), 65536)], "position")
    return numbered.select("queue_id", "position", F.col("o_orderkey").cast("string").alias("song_id"))
