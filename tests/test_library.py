"""Catalog, M3U, playlist and queue rules on hand-made cases."""

import random
from datetime import datetime
from itertools import accumulate

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cadenza import schemas
from cadenza.functions import scalars as S
from cadenza.operators import catalog, graph, indexing, picks, playlists, queues
from cadenza.operators.pieces import number_rows, running_total, span, with_halo
from cadenza.sources import m3u, tables

NOW = datetime(2024, 1, 31)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("ms, text", [(0, "0:00"), (61_000, "1:01"), (3_600_000, "60:00"), (59_999, "0:59")])
def test_duration_text(spark, ms, text):
    assert one(spark, S.duration_text(F.lit(ms))) == text


def test_day_part_bounds(spark):
    found = [one(spark, S.day_part(F.lit(datetime(2024, 1, 1, h)))) for h in (0, 11, 12, 16, 17, 23)]
    assert found == ["morning"] * 2 + ["afternoon"] * 2 + ["evening"] * 2


@pytest.mark.parametrize("energy, tempo, tag", [(0.15, 111.0, "Calm"), (0.16, 110.0, "Calm"), (0.16, 111.0, "Energetic")])
def test_mood_tag_bounds(spark, energy, tempo, tag):
    assert one(spark, S.mood_tag(F.lit(energy), F.lit(tempo))) == tag


def test_paths_and_times(spark):
    assert one(spark, S.file_name(F.lit("C:\\x/y\\z.mp3"))) == "z.mp3"
    assert one(spark, S.base_name(F.lit("C:\\x/y\\z.mp3"))) == "y\\z.mp3"
    assert one(spark, S.is_wav(F.lit("a.WaV"))) is True
    assert one(spark, S.iso_text(F.lit(datetime(2024, 1, 2, 3, 4, 5)))) == "2024-01-02T03:04:05.000"
    assert one(spark, S.iso_text(F.lit(datetime(2024, 1, 2, 3, 4, 5, 6)))) == "2024-01-02T03:04:05.000006"
    for bad in ("soon", "", "2024", "12:30"):
        assert one(spark, S.parse_time(F.lit(bad))) is None


def test_fill_on_read(rows):
    schema = "id string, title string, artist string, album string, file_path string, duration_ms bigint, " \
             "genre_tag string, indexed_at string, created_at string"
    found = catalog.fill_on_read(rows(schema, (None,) * 9, ("1", "", "", "", "", 5, "g", "x", "2024-01-01"))).collect()
    assert tuple(found[0]) == ("", "Unknown Title", "Unknown Artist", "Unknown Album", "", 0, None, None, None)
    assert tuple(found[1]) == ("1", "", "", "", "", 5, "g", None, datetime(2024, 1, 1))


def test_patch_keeps_what_is_not_given(rows, tuples):
    songs = rows("id string, title string, created_at string", ("1", "a", "c"), ("2", "b", "c"))
    changes = rows("id string, title string, created_at string", ("1", None, "new"), ("2", "z", "new"))
    assert tuples(catalog.patch(songs, changes)) == [("1", "a", "c"), ("2", "z", "c")]


@pytest.mark.parametrize("query, found", [
    ("cafe", ["CAFE"]), ("É", []), ("\\", ["a\\b"]), ("%", ["100%", "CAFE", "a\\b", "café"]), ("0_%", ["100%"]),
])
def test_search(rows, query, found):
    songs = rows("title string, artist string, album string", *[(t, None, None) for t in ("CAFE", "café", "a\\b", "100%")])
    assert sorted(r.title for r in catalog.search(songs, query).collect()) == found


SONG = "id string, title string, file_path string, n int"


def greedy(existing, incoming):
    ids, paths = {r[0] for r in existing}, {r[2] for r in existing}
    kept = []
    for row in sorted(incoming, key=lambda r: r[3]):
        if None in row[:3] or row[0] in ids or row[2] in paths:
            continue
        ids.add(row[0]), paths.add(row[2]), kept.append(row)
    return sorted(kept)


def test_insert_ignore_chain(rows, tuples):
    batch = [("1", "A", "p", 1), ("2", "B", "p", 2), ("2", "C", "q", 3)]
    assert [r[1] for r in tuples(catalog.insert_ignore(rows(SONG), rows(SONG, *batch), "n"))] == ["A", "C"]


def test_insert_ignore_is_the_sequential_insert(rows, tuples):
    rng = random.Random(3)
    pick = lambda: (str(rng.randrange(25)), "t" if rng.random() > 0.1 else None, f"/p{rng.randrange(25)}")
    incoming = [(*pick(), i) for i in range(120)] + [("7", "t", f"/hot{i}", 200 + i) for i in range(60)]
    existing = [(str(i), "t", f"/p{i}", -1) for i in range(4)]
    found = catalog.insert_ignore(rows(SONG, *existing), rows(SONG, *incoming), "n")
    assert tuples(found.select("id", "title", "file_path", "n")) == greedy(existing, incoming)


@pytest.mark.parametrize("rounds, at_once", [(0, 1000), (1, 7), (2, 25)])
def test_conflicts_are_settled_in_order(rows, tuples, rounds, at_once):
    """However few rounds go before, and however small the slices of a conflict are."""
    rng = random.Random(rounds)
    incoming = [(f"i{rng.randrange(60)}", "t", f"/p{rng.randrange(60)}", i) for i in range(150)]
    incoming += [(f"c{i // 2}", "t", f"/c{(i + 1) // 2}", 1000 + (i * 7919) % 60) for i in range(60)]
    steps = []
    found = catalog.insert_ignore(rows(SONG), rows(SONG, *incoming), "n", rounds, at_once, lambda *step: steps.append(step))
    assert tuples(found) == greedy([], incoming)
    assert [s for s, _ in steps].count("round") == rounds and steps[-1] == ("rest", 0)


def test_a_long_chain_needs_few_rounds(spark, rows, tuples):
    """Ten thousand rows of which each blocks the next: taken one by one they would need 5,000 rounds."""
    n, steps = 10_000, []
    chain = spark.range(n).select(
        F.concat(F.lit("id"), F.floor(F.col("id") / 2).cast("string")).alias("id"), F.lit("t").alias("title"),
        F.concat(F.lit("/p"), F.floor((F.col("id") + 1) / 2).cast("string")).alias("file_path"), F.col("id").cast("int").alias("n"))
    found = catalog.insert_ignore(rows(SONG), chain, "n", report=lambda *step: steps.append(step))
    assert [r.n for r in found.orderBy("n").collect()] == list(range(0, n, 2))
    assert len(steps) < 30, steps


def test_components_of_random_links(rows):
    rng = random.Random(8)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(100)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    found = dict(map(tuple, graph.connected(rows("a long, b long", *links)).collect()))
    assert found == {x: root(x) for a, b in links if a != b for x in (a, b)}


def test_feature_upsert_keeps_the_first_time(rows, tuples):
    stored = rows("song_id string, tempo double, energy double, extracted_at timestamp", ("a", 1.0, 1.0, datetime(2023, 1, 1)))
    saved = rows("song_id string, tempo double, v int", ("a", 2.0, 1), ("a", 3.0, 2), ("b", 4.0, 1))
    assert tuples(catalog.upsert_features(stored, saved, "v", NOW)) == [
        ("a", 3.0, 1.0, datetime(2023, 1, 1)), ("b", 4.0, None, NOW)
    ]


def test_device_listing_refused(rows):
    songs = rows("id string, title string", ("1", "b"), ("2", "A"))
    assert [r.title for r in catalog.list_device_songs(songs).collect()] == ["A", "b"]
    assert catalog.list_device_songs(songs, permitted=False).isEmpty()


M3U = "\ufeff#EXTM3U\r\n\r\n/m/a.mp3\r\n \t rel/b.mp3 \u00a0\r\nC:\\x\\c.mp3\r\ncontent://z\r\nC:/x.mp3\rfile:///x.mp3\n\\\\srv\\x.mp3\n# end"


def test_m3u_files(spark, tmp_path):
    folder = tmp_path / "pl"
    folder.mkdir()
    (folder / "one.m3u").write_bytes(M3U.encode())
    (folder / "two.m3u8").write_bytes("/m/café.mp3\n/m/x’.mp3".encode("cp1252"))
    (folder / "other.txt").write_text("/no.mp3")
    found = m3u.read_entries(spark, str(tmp_path)).orderBy("playlist_path", "line_no").collect()
    paths = [(r.playlist_path.rsplit("/", 1)[1], r.path.replace(str(folder), "/pl")) for r in found]
    assert paths == [("one.m3u", p) for p in (
        "/m/a.mp3", "/pl/rel/b.mp3", "C:\\x\\c.mp3", "content://z", "/pl/C:/x.mp3", "/pl/file:///x.mp3", "/pl/\\\\srv\\x.mp3",
    )] + [("two.m3u8", "/m/café.mp3"), ("two.m3u8", "/m/x’.mp3")]
    with pytest.raises(AnalysisException):
        m3u.read_m3u(spark, str(tmp_path / "missing")).collect()


@pytest.mark.parametrize("path, folder", [("/pl/x.m3u", "/pl"), ("/x.m3u", "/"), ("x.m3u", "."), ("a/b/x.m3u", "a/b")])
def test_parent_folder(spark, path, folder):
    assert one(spark, m3u.parent_folder(F.lit(path))) == folder


def entries(rows, *items):
    return rows("playlist_id string, line_no int, path string", *items)


def songs_at(rows, *paths):
    return rows("id string, file_path string", *[(p.upper(), p) for p in paths])


def test_positions_have_no_gaps(rows, tuples):
    found = playlists.resolve(entries(rows, ("p", 0, "a"), ("p", 1, "x"), ("p", 2, "b")), songs_at(rows, "a", "b"))
    assert tuples(found, "song_id", "position") == [("A", 0), ("B", 1)]


def test_duplicate_entry(rows, tuples):
    lists = entries(rows, ("p", 0, "a"), ("p", 1, "a"), ("p", 2, "b"), ("q", 0, "a"))
    songs = songs_at(rows, "a", "b")
    assert tuples(playlists.import_entries(lists, songs)) == [("q", "A", 0)]
    assert tuples(playlists.rejected(lists, songs)) == [("p", 1)]
    assert tuples(playlists.import_entries(lists, songs, on_duplicate="first")) == [
        ("p", "A", 0), ("p", "B", 1), ("q", "A", 0)
    ]


def test_playlists_appear_with_their_header(spark, rows, tmp_path, tuples):
    folder = str(tmp_path)
    heads = playlists.headers(rows("name string", ("one",)), NOW, F.col("name"))
    key = heads.first().id
    songs = rows("playlist_id string, song_id string, position int", (key, "A", 0), ("broken", "B", 0))
    tables.write_playlist_songs(songs, folder, "an import")  # dies here, and is run again
    for _ in range(2):
        tables.write_playlist_songs(songs, folder, "an import")
        tables.write_playlists(heads, folder, "an import")
    tables.write_playlist_songs(songs, folder, "01")
    assert tuples(tables.read_playlist_songs(spark, folder)) == [(key, "A", 0)]


def test_table_writers(spark, rows, tmp_path, tuples):
    path = str(tmp_path / "songs")
    song = catalog.insert_rows(rows(
        "id string, title string, artist string, album string, file_path string, duration_ms bigint", ("1", "t", None, None, "/p", 1)
    ), NOW)
    for batch in ("first", "01", "first"):
        tables.append_songs(song, path, batch)
    assert tables.read_songs(spark, path).count() == 2
    assert [f.name for f in tables.read_songs(spark, path).schema] == schemas.SONGS.names

    seen = []
    other = song.withColumn("title", F.lit("new"))

    def lost():
        seen.append(sorted(r.title for r in tables.read_songs(spark, path).collect()))
        raise OSError("lost")

    with pytest.raises(OSError):  # written, but no pointer to it
        tables.append_songs(other, path, "01", lost)
    before = tables.read_songs(spark, path)
    tables.append_songs(other, path, "01")
    assert seen == [["t", "t"]] and sorted(r.title for r in before.collect()) == ["t", "t"]
    assert sorted(r.title for r in tables.read_songs(spark, path).collect()) == ["new", "t"]
    assert sorted(r.batch for r in tables.superseded(spark, path).collect()) == ["01", "first"]
    assert tables.read_batches(spark, str(tmp_path / "none"), schemas.SONGS).isEmpty()

    picked = rows("listener string, rank int, song_id string, score double", ("l", 1, "s", 0.5))
    daily = str(tmp_path / "daily")
    for day in ("2024-01-01", "2024-01-02", "2024-01-02"):
        tables.write_daily_picks(picked, day, daily)
    assert spark.read.parquet(daily).count() == 2
    assert not tables.stale(tables.read_daily_picks(spark, daily, "2024-01-02"))
    assert tables.stale(tables.read_daily_picks(spark, daily, "2024-01-03"))
    new = str(tmp_path / "new")
    for _ in range(2):
        assert tables.picks_of_day(spark, new, "2024-01-01", lambda: picked).count() == 1
    assert spark.read.parquet(tables.publish(picked, str(tmp_path / "v"), "1")).count() == 1


def test_audio_files_are_listed(spark, tmp_path):
    for name in ("a.mp3", "b/c.FLAC", "b/d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"12")
    found = tables.list_audio_files(spark, str(tmp_path))
    assert sorted(r.file_path.rsplit("/", 1)[1] for r in found.collect()) == ["a.mp3", "c.FLAC"]
    assert "content" not in found.columns


def queue(rows, name, *songs):
    return rows("queue_id string, position bigint, song_id string", *[(name, i, s) for i, s in enumerate(songs)])


def test_queue_edits(rows, tuples):
    state = lambda i: rows("queue_id string, current_index bigint", ("q", i))
    add = rows("queue_id string, seq bigint, song_id string", ("q", 1, "x"), ("q", 2, "y"), ("new", 1, "z"))
    three = queue(rows, "q", "a", "b", "c")
    order = lambda df: [(r[0], r[2]) for r in tuples(df.select("queue_id", "position", "song_id"))]
    assert order(queues.append(three, add)) == [("new", "z")] + [("q", s) for s in "abcxy"]
    assert order(queues.play_next(three, state(1), add)) == [("q", s) for s in "abyxc"]
    assert order(queues.play_next(three, state(-1), add)) == [("q", s) for s in "abc"]
    assert order(queues.replace(three, queue(rows, "q", "z"))) == [("q", "z")]
    assert tuples(queues.start_at(state(2), three)) == [("q", 0)]
    assert [queues.current_songs(three, state(i)).first().song_id for i in (-1, 1, 3)] == [None, "b", None]
    following = lambda mode, i: queues.next_index(three, state(i), mode).first().next_index
    assert [following("one", 2), following("all", 2), following("off", 2), following("off", 0)] == [2, 0, None, 1]


def test_shuffle_is_a_seeded_permutation(rows, tuples):
    songs = queue(rows, "q", *"abcdefghij")
    once, again, other = (tuples(queues.shuffle(songs, seed), "play_order", "song_id") for seed in ("1", "1", "2"))
    assert once == again != other
    assert [o for o, _ in once] == list(range(10)) and sorted(s for _, s in once) == list("abcdefghij")
    assert tuples(queues.shuffle(songs, "1", enabled=False), "play_order", "song_id") == list(enumerate("abcdefghij"))


def test_pieces_count_one_hot_group(spark):
    hot = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    piece = span(F.col("id"), 64)
    numbered = number_rows(hot, ["k"], ["id"], [piece], "n")
    wrong = numbered.filter((F.col("k") == "hot") & (F.col("n") != F.col("id") / 3))
    assert numbered.count() == 5000 and wrong.isEmpty()
    finer = [span(F.col("id"), 512), piece, span(F.col("id"), 7)]
    total = running_total(hot, ["k"], ["id"], finer, F.col("id"), "s").filter("k = 'hot'")
    assert [r.s for r in total.orderBy("id").collect()] == list(accumulate(range(0, 5000, 3)))


def test_halo_reaches_back(spark):
    cut = with_halo(spark.range(100), F.col("id"), 3, 10)
    assert cut.filter("_piece = 4").agg(F.min("id"), F.max("id")).first() == (37, 49)
    assert cut.filter("not _halo").count() == 100


def test_index_outcomes(rows, tuples):
    requested = rows("seq bigint, file_path string", *enumerate(["gone", "new", "old", "bad", "new", "gone"]))
    listing = rows("file_path string", ("new",), ("old",), ("bad",))
    songs = catalog.insert_rows(rows(
        "id string, title string, artist string, album string, file_path string, duration_ms bigint", ("1", "t", None, None, "old", 1)
    ), NOW)
    feats = rows("song_id string, tempo double, energy double, extracted_at timestamp", ("1", 1.0, 1.0, NOW))
    analysed = rows("file_path string, error string, tempo double, energy double",
                    ("new", None, 120.0, 0.2), ("old", None, 2.0, 2.0), ("bad", "broken", None, None))
    run = indexing.index_files(requested, listing, songs, feats, analysed, NOW)
    assert tuples(run.outcomes, "seq", "status", "error", "features_extracted") == [
        (0, "error", "File not found", False), (1, "extracted", None, True), (2, "already indexed", None, False),
        (3, "error", "broken", False), (4, "already indexed", None, False), (5, "error", "File not found", False),
    ]
    assert sorted(r.file_path for r in run.songs.collect()) == ["bad", "new", "old"]
    tagged = {r.file_path: (r.genre_tag, r.indexed_at) for r in run.songs.collect()}
    assert tagged == {"bad": (None, None), "new": ("Energetic", NOW), "old": (None, None)}

    rerun = indexing.index_files(requested, listing, run.songs, run.features, analysed, NOW)
    assert rerun.outcomes.filter("features_extracted").isEmpty()
    assert tuples(rerun.features) == tuples(run.features)
    forced = indexing.index_files(requested, listing, run.songs, run.features, analysed, NOW, force=True)
    assert tuples(forced.outcomes.filter("features_extracted"), "seq") == [(1,), (2,), (4,)]
    assert tuples(indexing.index_counts(run.outcomes)) == [("already indexed", 2), ("error", 3), ("extracted", 1)]


def test_progress(rows):
    log = "file_path string, started_at timestamp, finished_at timestamp"
    empty = indexing.index_progress(indexing.index_status(rows(log))).first()
    assert (empty.ratio, empty.percent, empty.is_done, empty.status) == (0.0, "0.0%", False, "idle")
    half = indexing.index_progress(indexing.index_status(rows(log, ("a", NOW, NOW), ("b", NOW, None)))).first()
    assert (half.completed, half.current_file, half.eta_seconds, half.status, half.percent) == (1, "b", 2, "running", "50.0%")
    done = indexing.index_progress(indexing.index_status(rows(log, ("a", NOW, NOW)))).first()
    assert (done.current_file, done.eta_seconds, done.is_done) == (None, 0, True)


def test_genre_words_and_chips(rows, tuples):
    songs = rows("title string, artist string, album string, file_path string, energy double, tempo double",
                 ("Hindi hit", None, None, "/a", 1.0, 200.0), ("x", None, None, "/PUNJABI/hindi.mp3", 0.0, 0.0), ("y", None, None, "/b", 1.0, 200.0))
    tagged = picks.tag_genres(songs)
    assert tuples(tagged, "title", "genre_tag") == [("Hindi hit", "Hindi"), ("x", "Punjabi"), ("y", "Energetic")]
    assert picks.filter_genre(tagged, "All").count() == 3 and picks.filter_genre(tagged, "Hindi").count() == 1


def test_rows_with_null_keys_and_order_are_numbered(rows, tuples):
    table = rows("k string, at bigint", (None, 3), (None, 200), (None, None), ("a", 1), ("a", None))
    numbered = number_rows(table, ["k"], ["at"], [span(F.col("at"), 100), span(F.col("at"), 10)], "n")
    found = {(r.k, r.at): r.n for r in numbered.collect()}
    assert found == {(None, None): 0, (None, 3): 1, (None, 200): 2, ("a", None): 0, ("a", 1): 1}


def test_hot_paths_are_split(spark, rows):
    limits = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    }
    before = {name: spark.conf.get(name, None) for name in limits}
    for name, value in limits.items():
        spark.conf.set(name, value)
    try:
        at = F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("p"), "id"))
        paths = spark.range(0, 40000, 1, 8).select("id", at.alias("file_path"))
        songs = paths.select(F.col("id").cast("string").alias("id"), "file_path")
        found = catalog.lookup_paths(paths, songs)
        assert len(found.collect()) == 40000
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
