"""Library catalog: cleaning, insert-or-ignore, lookups, search, constraints."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cadenza.functions.scalars import (
    UNKNOWN_ALBUM, UNKNOWN_ARTIST, UNKNOWN_TITLE, ascii_fold, ascii_lower, base_name,
    contains_pattern, now, parse_time, stable_id,
)
from cadenza.operators.graph import connected
from cadenza.operators.pieces import lookup
from cadenza.session import durable

ROUNDS = 4  # of an insert, before conflicts are looked for
AT_ONCE = 100_000  # rows of one conflict that a task settles


def list_device_songs(device: DataFrame, permitted: bool = True) -> DataFrame:
    """Every song the device reports, by title with case ignored; none if refused."""
    return device.filter(F.lit(permitted)).orderBy(F.lower("title"), "id")


def drop_pathless(songs: DataFrame) -> DataFrame:
    return songs.filter(F.col("file_path").isNotNull())


def clean_incoming(device: DataFrame) -> DataFrame:
    """Device rows as catalog rows: no path, no row; nulls (not '') get defaults."""
    return drop_pathless(device).select(
        F.col("id").cast("string").alias("id"),
        "title",
        F.coalesce("artist", F.lit(UNKNOWN_ARTIST)).alias("artist"),
        F.coalesce("album", F.lit(UNKNOWN_ALBUM)).alias("album"),
        "file_path",
        F.coalesce(F.col("duration_ms").cast("long"), F.lit(0)).alias("duration_ms"),
        *[c for c in device.columns
          if c not in ("id", "title", "artist", "album", "file_path", "duration_ms")],
    )


def fill_on_read(rows: DataFrame) -> DataFrame:
    """Stored rows as complete songs; time text that cannot be read becomes null."""
    return rows.select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"),
        F.coalesce("title", F.lit(UNKNOWN_TITLE)).alias("title"),
        F.coalesce("artist", F.lit(UNKNOWN_ARTIST)).alias("artist"),
        F.coalesce("album", F.lit(UNKNOWN_ALBUM)).alias("album"),
        F.coalesce("file_path", F.lit("")).alias("file_path"),
        F.coalesce(F.col("duration_ms").cast("long"), F.lit(0)).alias("duration_ms"),
        "genre_tag",
        parse_time(F.col("indexed_at")).alias("indexed_at"),
        parse_time(F.col("created_at")).alias("created_at"),
    )


def insert_rows(songs: DataFrame, as_of=None) -> DataFrame:
    """Songs as table rows: fields never set fall back to the table's defaults."""
    have = set(songs.columns)
    optional = lambda name, kind: (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)
    return songs.select(
        "id", "title", "artist", "album", "file_path", "duration_ms",
        optional("genre_tag", "string"), optional("indexed_at", "timestamp"),
        now(as_of).alias("created_at"),
    )


def patch(songs: DataFrame, changes: DataFrame) -> DataFrame:
    """Overwrite fields by ``changes`` (one row per id); null means keep the old value."""
    fixed = ("id", "created_at")
    touched = [c for c in changes.columns if c in songs.columns and c not in fixed]
    new = changes.select("id", *[F.col(c).alias(f"_new_{c}") for c in touched])
    joined = songs.join(new, "id", "left")
    return joined.select(*[
        F.coalesce(f"_new_{c}", c).alias(c) if c in touched else F.col(c) for c in songs.columns
    ])


def search(songs: DataFrame, query: str) -> DataFrame:
    """Songs whose title, artist or album contains ``query``, ASCII case ignored."""
    pattern = contains_pattern(ascii_lower(query))
    found = [ascii_fold(F.col(c)).like(pattern) for c in ("title", "artist", "album")]
    return songs.filter(reduce(Column.__or__, found))


def unique_paths(songs: DataFrame) -> DataFrame:
    """``file_path, song_id``: the first id of each path, so a join never multiplies."""
    return songs.groupBy("file_path").agg(F.min("id").alias("song_id"))


def lookup_paths(paths: DataFrame, songs: DataFrame) -> DataFrame:
    """Many point lookups by path at once; unknown paths get a null song."""
    return paths.join(lookup(unique_paths(songs)), "file_path", "left")


def lookup_ids(ids: DataFrame, features: DataFrame) -> DataFrame:
    """Many primary-key lookups at once; ids without features get nulls."""
    return ids.join(features, "song_id", "left")


def insert_ignore(
    existing: DataFrame, incoming: DataFrame, order: str, rounds: int = ROUNDS, at_once: int = AT_ONCE, report=None
) -> DataFrame:
    """The rows of ``incoming`` that an insert-or-ignore in ``order`` would add.

    A row is ignored when its id or its path is taken by an existing row or by an
    earlier row that was itself added, or when a required field is null. ``order``
    is unique. Each of the first ``rounds`` adds every row that is first on both keys
    and drops what it blocks, which settles nearly all of an ordinary batch. Rows that
    lost a key to a row not added form chains; what is left of them is put together
    by conflict (rows that share keys, directly or through others), and each conflict
    is settled in its order by one task, ``at_once`` rows of a conflict at a time. So the
    number of rounds does not follow the length of a chain: it is that of finding the
    conflicts, plus one for every ``at_once`` rows of the largest. ``report`` is called with
    the name of each step and the rows or links left after it.
    """
    tell = report or (lambda step, left: None)
    rows = (
        incoming.dropna(subset=["id", "title", "file_path"])
        .join(existing.select("id"), "id", "left_anti")
        .join(existing.select("file_path"), "file_path", "left_anti")
    )
    added = []
    for _ in range(rounds):
        by_id = rows.groupBy("id").agg(F.min(order).alias("_first_of_id"))
        by_path = rows.groupBy("file_path").agg(F.min(order).alias("_first_of_path"))
        marked = rows.join(lookup(by_id), "id").join(lookup(by_path), "file_path").withColumn(
            "_first", (F.col("_first_of_id") == F.col(order)) & (F.col("_first_of_path") == F.col(order))
        )
        marked = durable(marked.select(*incoming.columns, "_first"))
        winners = marked.filter("_first").drop("_first")
        added.append(winners)
        rows = _unblocked(marked.filter(~F.col("_first")).drop("_first"), winners)
        if report:
            tell("round", rows.count())
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, added)
    return reduce(DataFrame.unionByName, [*added, *_settled(durable(rows.select(*incoming.columns)), order, at_once, tell)])


def _unblocked(rows: DataFrame, winners: DataFrame) -> DataFrame:
    return rows.join(winners.select("id"), "id", "left_anti").join(winners.select("file_path"), "file_path", "left_anti")


def _settled(rows: DataFrame, order: str, at_once: int, tell) -> list[DataFrame]:
    """Rows that their conflicts add, slice by slice of each conflict's order."""
    # A key's node is a hash: two keys that fall together only make one conflict of two.
    row_nodes = rows.withColumn("_node", F.xxhash64(F.lit("id"), "id"))
    found = connected(
        row_nodes.select(F.col("_node").alias("a"), F.xxhash64(F.lit("path"), "file_path").alias("b")),
        lambda links: tell("conflicts", links),
    )
    placed = row_nodes.join(lookup(found.withColumnRenamed("node", "_node")), "_node").drop("_node")
    sizes = durable(placed.groupBy("component").agg(F.count(F.lit(1)).alias("_size")))
    placed = durable(placed.join(lookup(sizes), "component"))
    large = placed.filter(F.col("_size") > at_once)
    # Ranges of the order that hold about ``at_once`` rows of all large conflicts hold no more of any.
    total, cuts = large.count(), []
    if total:
        shares = [i * at_once / total for i in range(1, -(-total // at_once))]
        cuts = sorted(set(large.agg(F.percentile_approx(order, shares, 100 * (len(shares) + 1))).first()[0]))
        cuts = [*zip([None, *cuts], [*cuts, None])]
    added = []

    def settle(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        ids, paths, kept = set(), set(), []
        ordered = group.sort_by(order)
        for at, (one, path) in enumerate(zip(ordered["id"].to_pylist(), ordered["file_path"].to_pylist())):
            if one not in ids and path not in paths:
                ids.add(one)
                paths.add(path)
                kept.append(at)
        return ordered.select([order]).take(kept)

    kind = dict(rows.dtypes)[order]

    def winners(part: DataFrame) -> DataFrame:
        kept = part.select("component", "id", "file_path", order).groupBy("component").applyInArrow(settle, f"`{order}` {kind}")
        return durable(part.join(lookup(kept), order, "left_semi").select(*rows.columns))

    for low, high in cuts:
        part = large
        if low is not None:
            part = part.filter(F.col(order) > low)
        if high is not None:
            part = part.filter(F.col(order) <= high)
        added.append(winners(reduce(_unblocked, added, part)))
        tell("slice", len(cuts) - len(added))
    added.append(winners(placed.filter(F.col("_size") <= at_once)))
    tell("rest", 0)
    return added


def duplicate_keys(df: DataFrame, table: str, key: list[str], rule: str) -> DataFrame:
    counted = df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    return _violations(counted, table, key, rule, F.col("rows"))


def missing_values(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """One row per required column that has nulls, with their number."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("rows")) for c in columns
    ]))
    found = counts.select(rows.alias("v")).select("v.*").filter("rows > 0")
    return found.select(
        F.lit(table).alias("table"), F.col("column").alias("columns"),
        F.lit("not null").alias("rule"), F.lit(None).cast("string").alias("key"), "rows",
    )


def orphans(df: DataFrame, table: str, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Foreign keys that point nowhere; null keys are allowed."""
    lost = (
        df.groupBy(column).agg(F.count(F.lit(1)).alias("rows")).filter(F.col(column).isNotNull())
        .join(parent.select(F.col(parent_key).alias(column)), column, "left_anti")
    )
    return _violations(lost, table, [column], "foreign key", F.col("rows"))


def _violations(df, table, key, rule, rows):
    return df.select(
        F.lit(table).alias("table"), F.lit(",".join(key)).alias("columns"), F.lit(rule).alias("rule"),
        F.concat_ws(",", *[F.col(c).cast("string") for c in key]).alias("key"), rows.alias("rows"),
    )


def violations(songs: DataFrame, features: DataFrame, playlist_songs: DataFrame) -> DataFrame:
    """Every broken key, required field and reference of the catalog tables."""
    return reduce(DataFrame.unionByName, [
        duplicate_keys(songs, "songs", ["id"], "primary key"),
        duplicate_keys(songs, "songs", ["file_path"], "unique"),
        missing_values(songs, "songs", ["id", "title", "file_path"]),
        duplicate_keys(features, "song_features", ["song_id"], "primary key"),
        orphans(features, "song_features", "song_id", songs, "id"),
        duplicate_keys(playlist_songs, "playlist_songs", ["playlist_id", "song_id"], "primary key"),
        orphans(playlist_songs, "playlist_songs", "song_id", songs, "id"),
    ])


def unindexed(songs: DataFrame, features: DataFrame) -> DataFrame:
    return songs.join(features.select(F.col("song_id").alias("id")), "id", "left_anti")


def already_indexed(songs: DataFrame, features: DataFrame) -> DataFrame:
    return songs.join(features.select(F.col("song_id").alias("id")), "id", "left_semi")


def missing_files(paths: DataFrame, listing: DataFrame) -> DataFrame:
    return paths.join(listing.select("file_path"), "file_path", "left_anti")


def register_paths(paths: DataFrame, songs: DataFrame, as_of=None) -> DataFrame:
    """New song rows for the paths no song has, titled by their file name."""
    path = F.col("file_path")
    return (
        paths.select("file_path").distinct()
        .join(songs.select("file_path"), "file_path", "left_anti")
        .select(
            stable_id(path).alias("id"), base_name(path).alias("title"),
            F.lit(None).cast("string").alias("artist"), F.lit(None).cast("string").alias("album"),
            "file_path", F.lit(None).cast("long").alias("duration_ms"),
            F.lit(None).cast("string").alias("genre_tag"),
            F.lit(None).cast("timestamp").alias("indexed_at"), now(as_of).alias("created_at"),
        )
    )


def upsert_features(stored: DataFrame, saved: DataFrame, order: str, as_of=None) -> DataFrame:
    """Feature rows after saving ``saved``: the last save of a song wins.

    An update replaces every given column and keeps the first ``extracted_at``;
    an insert is stamped with the job's clock.
    """
    given = [c for c in saved.columns if c not in ("song_id", "extracted_at", order)]
    last = saved.groupBy("song_id").agg(
        F.max_by(F.struct(*[F.col(c).alias(f"_new_{c}") for c in given]), order).alias("_saved")
    ).select("song_id", "_saved.*", F.lit(True).alias("_is_saved"))
    both = stored.join(last, "song_id", "full")
    fields = []
    for c in stored.columns:
        if c == "extracted_at":
            fields.append(F.coalesce(c, now(as_of)).alias(c))
        elif c in given:
            fields.append(F.when(F.col("_is_saved"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        else:
            fields.append(F.col(c))
    return both.select(*fields)
