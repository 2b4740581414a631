"""Similarity, ranking and picks against brute force and hand-made cases."""

import hashlib
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import approximate, picks, ranking, similarity
from cadenza.operators.pieces import top_rows

NOW = datetime(2024, 1, 31, 8)


def brute(vectors, n, scopes=None):
    ids = sorted(vectors)
    units = {i: v / np.linalg.norm(v) if np.linalg.norm(v) else v for i, v in vectors.items()}
    found = []
    for q in ids:
        hits = [(-round(float(units[q] @ units[s]), 6), s) for s in ids
                if s != q and (scopes is None or scopes[s] == scopes[q])]
        found += [(q, s, -c + 0.0, rank) for rank, (c, s) in enumerate(sorted(hits)[:n], 1)]
    return sorted(found)


@pytest.fixture(scope="module")
def library():
    """Clusters, one vector that a third of the songs share, a zero vector and opposites."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8)) * 4
    vectors = {f"s{i:03}": centres[i % 6] + rng.normal(size=8) * 0.1 for i in range(150)}
    vectors |= {f"copy{i:03}": centres[0].copy() for i in range(80)}
    vectors |= {"zero1": np.zeros(8), "zero2": np.zeros(8), "opposite": -centres[0]}
    return vectors


def features(spark, vectors, scope=lambda i: "g"):
    data = [(i, scope(i), [float(x) for x in v]) for i, v in vectors.items()]
    return spark.createDataFrame(data, "song_id string, genre string, full_vector array<double>").repartition(5)


SMALL = {"block_rows": 8, "walk_rows": 40, "chunk_rows": 30}


@pytest.mark.parametrize("options", [{}, SMALL, SMALL | {"pivots": 7}, {"pivots": 40, "block_rows": 1000}])
def test_similar_is_exact(spark, library, tuples, options):
    found = similarity.similar_songs(features(spark, library), 6, **options)
    assert tuples(found, "query_id", "song_id", "similarity", "rank") == brute(library, 6)


@pytest.mark.parametrize("options", [{}, SMALL | {"pivots": 5}])
def test_similar_in_genre_is_exact(spark, library, tuples, options):
    scopes = {i: "hot" if i.startswith("copy") or int(i[-1:].replace("e", "0")) % 2 else "rare"
              for i in library if i != "opposite"}
    vectors = {i: library[i] for i in scopes}
    found = similarity.similar_in_genre(features(spark, vectors, scopes.get), 4, **options)
    assert tuples(found, "query_id", "song_id", "similarity", "rank") == brute(vectors, 4, scopes)


def test_a_query_costs_n_rows_per_walk_however_many_blocks(spark, library, monkeypatch):
    counted, best = [], similarity._best
    monkeypatch.setattr(similarity, "_best", lambda hits, n: counted.append((hits.count(), n)) or best(hits, n))
    different = len({tuple(v) for v in library.values()})
    for walk_rows, walks in ((1 << 20, 1), (40, -(-different // 40))):
        similarity.similar_songs(features(spark, library), 6, block_rows=4, walk_rows=walk_rows, chunk_rows=50)
        found, n = counted.pop()
        assert n == 7 and found <= n * different * walks
    assert different * n <= found < different * different / 4


def test_small_walks_and_chunks_are_dealt_out_together(spark, library, monkeypatch):
    """Copies of songs, queries and hits do not grow with the number of walks or chunks."""
    counted, best, dealt, deal = [], similarity._best, [], similarity.deal
    monkeypatch.setattr(similarity, "_best", lambda hits, n: counted.append(hits.count()) or best(hits, n))
    monkeypatch.setattr(similarity, "deal", lambda df, *a: dealt.append(df.count()) or deal(df, *a))
    different = len({tuple(v) for v in library.values()})
    similarity.similar_songs(features(spark, library), 6, block_rows=3, walk_rows=4, chunk_rows=4)
    assert counted[0] <= 7 * different * similarity.MOST_PARTS
    assert dealt[0] <= 2 * different * similarity.MOST_PARTS


def test_a_task_returns_batches_of_bounded_size(monkeypatch):
    monkeypatch.setattr(similarity, "_OUT_ROWS", 12)
    monkeypatch.setattr(similarity, "_EXACT", 5)
    monkeypatch.setattr(similarity, "_PRODUCTS", 90)
    songs = np.random.default_rng(3).normal(size=(60, 8))
    songs /= np.linalg.norm(songs, axis=1, keepdims=True)
    best = similarity._Best(songs[:20], np.zeros(20), 4, 10 ** 6)
    for block in (slice(0, 2), slice(2, 30), slice(20, 60)):  # ten songs twice
        best.take(songs[block], np.arange(60)[block], None, np.arange(20))
    batches = list(best.hits(np.arange(20) + 100))
    assert [b.num_rows for b in batches] == [12] * 6 + [8]
    found = sorted((r["number"] - 100, -r["similarity"], r["place"]) for b in batches for r in b.to_pylist())
    whole = sorted((q, -round(float(songs[q] @ songs[p]), 6), p) for q in range(20) for p in range(60))
    assert [f[::2] for f in found] == [w[::2] for q in range(20) for w in whole[60 * q:60 * q + 4]]


def test_blocks_that_cannot_better_a_query_are_passed_over():
    rng = np.random.default_rng(2)
    pivot = np.eye(16)[0]
    near = pivot + rng.normal(size=(40, 16)) * 0.02
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    angles = np.arccos(np.clip(near @ pivot, -1, 1))
    best = similarity._Best(near[:10], angles[:10], 3, 10 ** 6)
    assert len(best.hopeful(2.0, 3.0)) == 10  # nothing seen yet
    best.take(near, np.arange(40), np.array([f"k{i}" for i in range(40)], object), np.arange(10))
    assert [k for k in best.keys[:, 0]] == [f"k{i}" for i in range(10)]
    assert not len(best.hopeful(2.0, 3.0)) and len(best.hopeful(0.0, 0.1)) == 10
    kept = best.places.copy()
    best.take(near, np.arange(40, 80), np.array([f"later{i}" for i in range(40)], object), np.arange(10))
    assert best.rounded[0, 0] == best.rounded[0, 1] and best.places[0].tolist() == [kept[0, 0], 40 + kept[0, 0], kept[0, 1]]


def test_pivots_spare_work(spark, library):
    """With clustered songs a query needs few of the cells."""
    vectors = features(spark, library).select(F.col("song_id").alias("base_key"), F.lit("").alias("scope"),
                                              similarity.unit(F.col("full_vector")).alias("vector"))
    centres = similarity._pick_pivots(vectors, 12)
    placed = similarity._place(vectors, centres)
    radii = np.zeros(12)
    for row in placed.groupBy("cell").agg(F.max("angle").alias("r")).collect():
        radii[row.cell] = row.r
    asked = placed.withColumnRenamed("base_key", "query_key").withColumn("reached", F.lit(0.99))
    needed = similarity._needed_cells(asked, centres, radii, 6).agg(F.avg(F.size("cells"))).first()[0]
    assert needed < 6


def test_new_songs_refresh_the_lists(spark, library, tuples):
    everything = features(spark, library)
    old, new = everything.filter("song_id not like '%7'"), everything.filter("song_id like '%7'")
    found = similarity.refresh_similar(similarity.similar_songs(old, 5), old, new, 5)
    assert tuples(found, "query_id", "song_id", "similarity", "rank") == brute(library, 5)


def test_lists_follow_changes_by_versions(spark, library, tuples):
    """Songs that go, come and change; a second change on top of the first; lists nobody touched keep their version."""
    lists = lambda df, v: df.select("query_id", F.lit(v).cast("bigint").alias("version"), "song_id", "similarity", F.col("rank").cast("int").alias("rank"))
    states = [{i: v for i, v in library.items() if not i.endswith("3")}]
    rng = np.random.default_rng(9)
    states.append({i: v for i, v in states[0].items() if i not in ("s001", "copy007", "zero1")} | {
        "s002": rng.normal(size=8), "new1": library["s004"] + 1e-3, "copy999": library["copy000"]})
    states.append({i: v for i, v in states[1].items() if i != "new1"} | {"s001": rng.normal(size=8)})
    tables = [features(spark, state) for state in states]
    history = lists(similarity.similar_songs(tables[0], 5), 0).persist()
    for version in (1, 2):
        changes = similarity.changed_lists(history, tables[version - 1], tables[version], version, 5).persist()
        gone = sorted(set(states[version - 1]) - set(states[version]))
        assert tuples(changes.filter("song_id is null"), "query_id") == [(i,) for i in gone]
        old = {r[0]: r[1] for r in similarity.current_lists(history).groupBy("query_id").agg(F.array_sort(F.collect_list("song_id"))).collect()}
        new = {r[0]: r[1] for r in changes.filter("song_id is not null").groupBy("query_id").agg(F.array_sort(F.collect_list("song_id"))).collect()}
        untouched = [q for q in new if q in old and old[q] == new[q] and states[version - 1][q] is states[version][q]
                     and not set(old[q]) & set(gone)]
        assert not [q for q in untouched if not {i for i in old[q] if states[version - 1][i] is not states[version][i]}]
        history = history.unionByName(changes).persist()
        assert tuples(similarity.current_lists(history), "query_id", "song_id", "similarity", "rank") == brute(states[version], 5)
    assert len(new) < len(states[2]) / 2  # the second change touched few


def test_planes_follow_the_rule_and_buckets_their_sides(spark, rows):
    planes = approximate.Planes(3, 4)
    i = np.arange(1, 3 * 4 * 5 + 1)
    assert np.allclose(planes.weights(5).ravel(), [int(x) * int(x) * 2654435761 % 2 ** 32 / 2 ** 32 - 0.5 for x in i])
    vectors = np.random.default_rng(1).normal(size=(20, 5))
    df = rows("id int, v array<double>", *[(k, v.tolist()) for k, v in enumerate(vectors)], (20, None), (21, []))
    out = {r.id: r.b for r in df.select("id", planes.buckets(F.col("v")).alias("b")).collect()}
    sides = (vectors @ planes.weights(5).T >= 0).reshape(20, 3, 4)
    assert [out[k] for k in range(20)] == [[sum(1 << b for b in range(4) if s[t, b]) for t in range(3)] for s in sides]
    assert out[20] is None and out[21] is None
    probes = rows("b int", (5,)).select(planes.probes(F.col("b"), 2)).first()[0]
    assert sorted(probes) == sorted(x for x in range(16) if bin(x ^ 5).count("1") <= 2)


def test_index_finds_copies_and_everything_when_all_buckets_are_probed(spark, library, tuples, tmp_path):
    songs, planes = features(spark, library), approximate.Planes(2, 3)
    approximate.build_index(songs, planes).write(str(tmp_path / "index"))
    index = approximate.Index.read(spark, str(tmp_path / "index"), planes)
    assert index.vectors.count() == len({tuple(v / (np.linalg.norm(v) or 1)) for v in library.values()})
    assert index.entries.count() == 2 * index.vectors.count() and index.copies.count() == len(library)
    queries = songs.select(F.col("song_id").alias("query_id"), F.col("full_vector").alias("vector"))
    found = approximate.similar_approximate(queries, index, 6, radius=3)
    assert tuples(found, "query_id", "song_id", "similarity", "rank") == brute(library, 6)
    few = approximate.similar_approximate(queries.filter("query_id like 's00%'"), index, 6, radius=0)
    assert 0 < few.count() <= 60


def test_a_probed_search_costs_n_rows_per_walk(spark, library, tuples, monkeypatch):
    """Neither probes nor the songs they find become rows; small blocks, walks and chunks find the same."""
    counted, best = [], approximate._best
    monkeypatch.setattr(approximate, "_best", lambda hits, n: counted.append(hits.count()) or best(hits, n))
    songs, planes = features(spark, library), approximate.Planes(3, 3)
    index = approximate.build_index(songs, planes)
    queries = songs.select(F.col("song_id").alias("query_id"), F.col("full_vector").alias("vector"))
    columns = ("query_id", "song_id", "similarity", "rank")
    found = tuples(approximate.similar_approximate(queries, index, 4, radius=1), *columns)
    small = {"block_rows": 10, "walk_rows": 40, "chunk_rows": 30}
    assert tuples(approximate.similar_approximate(queries, index, 4, radius=1, **small), *columns) == found
    different = len({tuple(v) for v in library.values()})
    assert counted[0] <= 5 * different and counted[1] <= 5 * different * similarity.MOST_PARTS
    units = {i: v / (np.linalg.norm(v) or 1) for i, v in library.items()}
    homes = {i: (planes.weights(8) @ v >= 0).reshape(3, 3) for i, v in units.items()}
    probed = lambda a, b: ((homes[a] != homes[b]).sum(axis=1) <= 1).any()
    for query in ("s007", "copy011", "zero1", "opposite"):
        near = sorted((-round(float(units[query] @ units[i]), 6) + 0.0, i) for i in library if i != query and probed(query, i))
        assert [r[1] for r in sorted((r for r in found if r[0] == query), key=lambda r: r[3])] == [i for _, i in near[:4]]


def test_recall_on_the_largest_table(spark):
    rows_ = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows_], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cosines = x @ x.T
    np.fill_diagonal(cosines, -2)
    near = np.argsort(-cosines, axis=1)[:, :10]
    songs = spark.createDataFrame([(str(r.vec_id), [float(v) for v in r.embedding]) for r in rows_], "song_id string, full_vector array<double>")
    index = approximate.build_index(songs, approximate.Planes(14, 10))
    queries = songs.filter("cast(song_id as bigint) % 5 = 0").select(F.col("song_id").alias("query_id"), F.col("full_vector").alias("vector"))
    got = {}
    for r in approximate.similar_approximate(queries, index, 10).collect():
        got.setdefault(r.query_id, set()).add(r.song_id)
    hits = [len(got[str(rows_[q].vec_id)] & {str(rows_[k].vec_id) for k in near[q]}) for q in range(0, len(rows_), 5)]
    print("recall at 10:", sum(hits) / (10 * len(hits)))
    assert sum(hits) / (10 * len(hits)) >= 0.9


def test_top_rows_cuts_before_the_shuffle(spark):
    plan = top_rows(spark.range(10).withColumn("k", F.col("id") % 2), ["k"], ["id"], 3)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_score_formula_and_cold_start(rows, tuples):
    candidates = rows("request_id string, song_id string, similarity double", ("r", "a", 0.5), ("r", "b", 0.6), ("r", "c", 0.4))
    weights = rows("song_id string, weight double", ("a", 0.5))
    assert tuples(ranking.final_rank(candidates, weights, 2), "rank", "song_id", "score") == [(1, "a", 0.75), (2, "b", 0.6)]
    nothing = ranking.final_rank(candidates, weights.filter("false"), 3)
    assert [s for _, s in tuples(nothing, "rank", "song_id")] == ["b", "a", "c"]


def test_diversity(rows, tuples):
    schema = "request_id string, song_id string, score double, genre string, dominant_genre string"
    same = [("r", f"s{i}", 1.0 - i / 100, "g", "g") for i in range(12)]
    other = [("r", f"o{i}", 0.1 - i / 100, "h", "g") for i in range(4)]
    full = ranking.diversify(rows(schema, *same, *other), 10)
    assert full.count() == 10 and full.filter("genre = 'h'").count() == 2
    short = ranking.diversify(rows(schema, *same, *other[:1]), 10)
    assert short.count() == 9 and short.filter("genre = 'g'").count() == 8
    unknown = ranking.diversify(rows(schema, ("r", "x", 1.0, None, "g"), ("r", "y", 0.5, "g", None)), 10)
    assert unknown.count() == 2


def test_context_queue_skips_the_current_song(spark, rows, library):
    songs = features(spark, library)
    requests = rows("request_id string, listener string, current_song_id string, genre_context string",
                    ("r1", "l", "s001", "g"), ("r2", "l", "s001", "g"), ("r3", "l", "s001", "none"))
    weights = rows("listener string, song_id string, weight double", ("l", "s007", 1.0))
    found = ranking.context_queue(requests, songs, weights, n=5)
    assert found.filter("song_id = 's001'").isEmpty()
    assert {(r.request_id, r.song_id) for r in found.filter("rank = 1").collect()} == {("r1", "s007"), ("r2", "s007")}
    assert found.count() == 10


def test_every_request_is_answered(spark, rows, library):
    """Unknown song, unknown genre, no genre: a full queue each, without the current song and without repeats."""
    scopes = {i: "hot" if i.startswith("copy") else "rare" if i.endswith("1") else "g" for i in library}
    songs = features(spark, library, scopes.get)
    catalog = rows("id string", *[(i,) for i in [*library, *(f"plain{k}" for k in range(200))]])
    requests = rows(
        "request_id string, listener string, current_song_id string, genre_context string, dominant_genre string",
        ("known", "l", "s002", "g", "g"), ("genre of few", "l", "s001", "rare", None), ("no such genre", "l", "s002", "none", "g"),
        ("no genre", "l", "s002", None, None), ("no features", "l", "plain7", "g", "g"), ("nothing", None, None, None, None))
    weights = rows("listener string, song_id string, weight double", ("l", "s008", 1.0))
    out = {}
    for r in ranking.answered_queue(requests, songs, weights, catalog, n=10).collect():
        out.setdefault(r.request_id, []).append(r)
    current = {r.request_id: r.current_song_id for r in requests.collect()}
    assert {k: len(v) for k, v in out.items()} == dict.fromkeys(current, 10)
    for name, queue in out.items():
        queue.sort(key=lambda r: r.rank)
        ids = [r.song_id for r in queue]
        assert len(set(ids)) == 10 and current[name] not in ids and [r.rank for r in queue] == list(range(1, 11))
        dominant = {"known": "g", "genre of few": "rare", "no such genre": "g", "no features": "g"}.get(name)
        assert sum(scopes.get(i) == dominant for i in ids) <= 8 or dominant is None
    assert out["known"][0].song_id == "s008" and sum(r.source == "context" for r in out["known"]) == 8  # its near songs are all of one genre
    assert {r.source for r in out["no features"]} == {r.source for r in out["nothing"]} == {"random"}
    assert {r.source for r in out["no genre"]} == {"beside"}
    again = ranking.answered_queue(requests, songs, weights, catalog, n=10).collect()
    assert sorted(map(str, again)) == sorted(str(r) for q in out.values() for r in q)
    short = ranking.answered_queue(requests, songs, weights, catalog.limit(3), n=10)
    assert 0 < short.filter("request_id = 'nothing'").count() <= 3


EVENTS = "id bigint, listener string, song_id string, event_type string, skip_position_pct double, ts timestamp"


def event(i, song, days, kind="play", listener="l", pct=90.0):
    return (i, listener, song, kind, pct, NOW - timedelta(days=days))


def test_daily_picks(rows, tuples):
    energies = [0.0, 0.2, 0.4, 0.5, 0.6, 0.8, 1.0]
    songs = rows("song_id string, energy double", *[(f"s{i}", e) for i, e in enumerate(energies)])
    events = rows(EVENTS, event(1, "s3", 1), event(2, "s2", 7), event(3, "s4", 7), event(4, "gone", 2, listener="m"))
    liked = rows("listener string, song_id string, preference double", ("l", "s2", 0.9), ("l", "s4", 0.4))
    found = picks.daily_picks(events, liked, songs, NOW, 3)
    first = round(0.9 * (1 - np.exp(-1)) * 0.9, 6)
    in_hash_order = lambda *ids: sorted(ids, key=lambda i: hashlib.md5(i.encode()).hexdigest())
    (l2, l3), (m2, m3) = in_hash_order("s1", "s5"), in_hash_order("s2", "s4")
    assert tuples(found, "listener", "rank", "song_id", "score") == [
        ("l", 1, "s2", first), ("l", 2, l2, 0.35), ("l", 3, l3, 0.35),
        ("m", 1, "s3", 0.5), ("m", 2, m2, 0.45), ("m", 3, m3, 0.45),
    ]


def test_weekend_playlist_size_and_discovery(spark, rows, library):
    songs = features(spark, library)
    heard = sorted(i for i in library if i.startswith("s"))[:60]
    events = rows(EVENTS, *[event(i, s, 2) for i, s in enumerate(heard)], event(99, "s100", 20))
    liked = rows("listener string, song_id string, preference double", *[("l", s, 0.8) for s in heard[:9]])
    for steps in (2, None):
        found = picks.weekend_playlist(events, liked, songs, NOW, "w", steps=steps).collect()
        sampled = {r.song_id for r in found if r.kind == "sampled"}
        discovered = {r.song_id for r in found if r.kind == "discovery"}
        assert sampled <= set(heard) and len(discovered) == 3 and not discovered & set(heard) | discovered & {"s100"}
        assert sorted(r.position for r in found) == list(range(1, len(found) + 1))


def test_boosts_and_acceptance(rows, tuples):
    labelled = rows("listener string, song_id string, label int", ("l", "a", 1), ("l", "a", 1), ("l", "b", 0))
    near = rows("query_id string, song_id string, similarity double", ("a", "x", 0.5), ("b", "y", 0.9))
    assert tuples(ranking.boosts(labelled, near)) == [("l", "x", 1.0)]
    monday = datetime(2024, 1, 29).date()
    given = rows("listener string, song_id string, week date", ("l", "a", monday), ("l", "b", monday))
    events = rows(EVENTS, event(1, "a", 1, pct=51.0), event(2, "a", 0, pct=80.0), event(3, "b", 1, pct=50.0))
    assert tuples(ranking.acceptance(given, events), "recommended", "accepted", "rate") == [(2, 1, 0.5)]
