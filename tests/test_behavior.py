"""Behaviour rules in batch and stream, the learner, and signals with known answers."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from cadenza import schemas
from cadenza.functions.vectors import assemble, unit
from cadenza.operators import behavior, dsp, features, learner
from cadenza.streaming import behavior as streams

START = datetime(2024, 1, 1)
EVENTS = "id bigint, listener string, song_id string, event_type string, skip_position_pct double, ts timestamp"


def events(spark, *items):
    """Items are (listener, second, kind)."""
    data = [(i, l, "s", kind, 50.0, START + timedelta(seconds=s)) for i, (l, s, kind) in enumerate(items)]
    return spark.createDataFrame(data, EVENTS)


def shifts_of(items, seconds=60, reset=True):
    found, runs = [], {}
    for i, (listener, second, kind) in sorted(enumerate(items), key=lambda e: (e[1][0], e[1][1], e[0])):
        run = runs.setdefault(listener, [])
        run[:] = run + [second] if kind == "skip" else []
        if len(run) >= 3 and run[-1] - run[-3] <= seconds:
            found.append(i)
            if reset:
                run.clear()
    return sorted(found)


@pytest.mark.parametrize("times, found", [((0, 30, 60), [2]), ((0, 30, 61), []), ((0, 10, 20, 30, 40, 50), [2, 5])])
def test_three_skips_in_a_row(spark, times, found):
    items = [("l", t, "skip") for t in times]
    assert [r.id for r in behavior.mood_shifts(events(spark, *items)).orderBy("id").collect()] == found
    assert shifts_of(items) == found


def test_a_play_breaks_the_run(spark):
    items = [("l", 0, "skip"), ("l", 1, "skip"), ("l", 2, "play"), ("l", 3, "skip")]
    assert behavior.mood_shifts(events(spark, *items)).isEmpty()


def test_documented_logs_reach_every_stream(spark, tmp_path):
    """Files of the log table as documented: session and timestamp, no listener."""
    logs = [(i, "s", kind, 50.0, who, START + timedelta(seconds=s)) for i, (who, s, kind) in enumerate(
        [("a", 0, "skip"), ("a", 10, "skip"), ("a", 20, "skip"), ("b", 0, "play"), ("end", 9000, "play")])]
    spark.createDataFrame(logs, schemas.BEHAVIOR_LOGS).write.parquet(str(tmp_path / "logs"))
    batch = behavior.from_logs(spark.read.parquet(str(tmp_path / "logs")))
    assert [(r.listener, r.id) for r in behavior.mood_shifts(batch).collect()] == [("a", 2)]
    assert behavior.sessionize(batch, 60).count() == 5

    def run(name, make):
        out = str(tmp_path / name)
        stream = make(streams.read_events(spark, str(tmp_path / "logs")))
        streams.start_append(stream, f"{out}/rows", f"{out}/at", available_now=True).awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{out}/rows").collect()

    assert sorted(r.id for r in run("ingest", streams.ingest)) == [0, 1, 2, 3, 4]
    genre = F.when(F.col("id") == 0, "z").when(F.col("id") == 1, "y")  # a tie, and two events without
    found = run("sessions", lambda e: streams.sessions(e.withColumns({"energy": F.lit(None).cast("double"), "genre": genre}), "60 seconds"))
    assert sorted((r.listener, r.dominant_genre or "", r.events, r.avg_energy) for r in found) == [("a", "y", 3, None), ("b", "", 1, None)]
    assert [(r.listener, r.id) for r in run("shifts", streams.mood_shifts)] == [("a", 2)]


def test_models_of_listeners_survive_a_restart(spark, tmp_path, monkeypatch):
    """Three batches, the second failing first: the same models as without a failure, and as numpy has them."""
    rng = np.random.default_rng(4)
    given = [[(f"l{k % 3}" if b < 2 else "late", float(k % 2), rng.normal(size=3).tolist()) for k in range(30)] for b in range(3)]
    kind = "listener string, label double, x array<double>"
    fail, step = [], streams.step_listeners

    def failing(rows, models, version, rate):
        if fail:
            raise OSError("lost")
        return step(rows, models, version, rate)

    monkeypatch.setattr(streams, "step_listeners", failing)

    def run(folder, broken):
        for number, rows in enumerate(given):
            spark.createDataFrame(rows, kind).write.mode("append").parquet(f"{folder}/rows")
            for attempt in range(2 if number == broken else 1):
                fail[:] = [1] if number == broken and attempt == 0 else []
                job = streams.start_learning_each(
                    spark.readStream.schema(kind).parquet(f"{folder}/rows"), f"{folder}/models", f"{folder}/at", available_now=True)
                if fail:
                    with pytest.raises(StreamingQueryException):
                        job.awaitTermination()
                else:
                    job.awaitTermination()
        models = streams.read_models(spark, f"{folder}/models")
        return {r.listener: r.weights for r in learner.current_models(models).collect()}, models.count()

    broken, whole = run(str(tmp_path / "a"), 1), run(str(tmp_path / "b"), None)
    assert broken[1] == whole[1] == 3 + 3 + 1 and set(broken[0]) == set(whole[0])
    assert all(np.allclose(broken[0][k], whole[0][k], rtol=0, atol=1e-14) for k in whole[0])  # up to the order of additions
    want = {}
    for rows in given:
        for who in {r[0] for r in rows}:
            x, y = (np.array([r[i] for r in rows if r[0] == who]) for i in (2, 1))
            w = want.get(who, np.zeros(3))
            want[who] = w + learner.RATE * ((y - 1 / (1 + np.exp(-x @ w)))[:, None] * x).mean(axis=0)
    assert set(broken[0]) == set(want) and all(np.allclose(broken[0][k], want[k]) for k in want)


def sequential(times, skipped, skips, reach):
    """The rule, event by event."""
    run, found = [], []
    for i, (t, s) in enumerate(zip(times, skipped)):
        run = (run + [t])[-skips:] if s else []
        if len(run) == skips and run[-1] - run[0] <= reach:
            found.append(i)
            run = []
    return found, run


@pytest.mark.parametrize("skips", [1, 2, 3, 5])
def test_runs_of_a_batch_follow_on_from_the_state(skips):
    rng = np.random.default_rng(skips)
    for _ in range(300):
        n = int(rng.integers(0, 60))
        times, skipped = np.cumsum(rng.integers(0, 30, n)), rng.random(n) < rng.choice([0.3, 0.8, 1.0])
        want, left = sequential(times.tolist(), skipped.tolist(), skips, 60)
        cuts = sorted(rng.integers(0, n + 1, 3).tolist())
        found, run = [], np.empty(0, np.int64)
        for a, b in zip([0, *cuts], [*cuts, n]):  # as the batches of a stream bring them
            ends, run = streams.run_ends(
                np.concatenate([run, times[a:b]]), np.concatenate([np.ones(len(run), bool), skipped[a:b]]), skips, 60, len(run))
            found += (ends + a).tolist()
        assert found == want and run.tolist() == left[-(skips - 1):] if skips > 1 else found == want


def test_stream_with_a_hundred_thousand_waiting_events(spark, rows, tmp_path):
    """One listener's events all wait for the watermark, then give their shifts and targets; two batches, out of order."""
    n = 100_000
    rng = np.random.default_rng(1)
    kinds = np.where(rng.random(n) < 0.7, "skip", "play")
    seconds = np.cumsum(rng.integers(1, 40, n))
    energy = np.where(rng.random(n) < 0.9, rng.random(n).round(6), np.nan)
    want, _ = sequential(seconds.tolist(), (kinds == "skip").tolist(), 3, 60)
    import pandas as pd

    table = pd.DataFrame({"listener": "l", "id": np.arange(n), "event_type": kinds, "ts": pd.to_datetime(seconds, unit="s"), "energy": energy})
    end = pd.DataFrame({"listener": "end", "id": [n], "event_type": ["play"], "ts": pd.to_datetime([int(seconds[-1]) + 10_000_000], unit="s"), "energy": [0.0]})
    kind = "listener string, id long, event_type string, ts timestamp, energy double"
    order = rng.permutation(n)
    for part in (table.iloc[order[: n // 2]], table.iloc[order[n // 2:]], end):
        given = spark.createDataFrame(part, kind).withColumn("energy", F.nanvl("energy", F.lit(None).cast("double")))
        given.write.mode("append").parquet(str(tmp_path / "events"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "events"))
        # Late by more than all of them span: the first two batches only wait.
        found = streams.mood_reactions(stream, lateness="60 days")
        streams.start_append(found, str(tmp_path / "out"), str(tmp_path / "at"), available_now=True).awaitTermination()
    out = sorted(spark.read.schema(found.schema).parquet(str(tmp_path / "out")).collect(), key=lambda r: r.id)
    assert [r.id for r in out] == want
    heard = [i for i in range(n) if kinds[i] == "play"]
    for r in out[:: len(out) // 50]:
        songs = [i for i in heard if i < r.id][-10:]
        there = [energy[i] for i in songs if not np.isnan(energy[i])]
        assert r.songs == len(songs) and (r.target_energy == pytest.approx(np.mean(there)) if there else r.target_energy is None)


def test_songs_without_features_count(spark, rows):
    """They are events of a session and among the last songs, but say nothing of energy and genre."""
    frame = events(spark, ("l", 0, "play"), ("l", 1, "play"), ("l", 2, "skip"), ("l", 3, "skip"), ("l", 4, "skip"), ("m", 0, "play"))
    frame = frame.withColumn("song_id", F.when(F.col("id") == 0, "known").otherwise("new"))
    songs = rows("song_id string, genre string, energy double", ("known", "g", 0.5))
    one = behavior.session_summary(frame, songs, ("listener",))
    found = {r.listener: (r.events, r.dominant_genre, r.avg_energy) for r in one.collect()}
    assert found == {"l": (5, "g", 0.5), "m": (1, None, None)}
    target = behavior.mood_targets(frame, behavior.mood_shifts(frame), songs, last=2).first()
    assert (target.target_energy, target.target_genre, target.songs) == (0.5, "g", 2)
    assert behavior.mood_targets(frame, behavior.mood_shifts(frame), songs, last=1).first().target_energy is None


def random_items(n=3000, seed=1, share=0.8):
    rng, second, items = random.Random(seed), {}, []
    for _ in range(n):
        who = "hot" if rng.random() < 0.6 else f"l{rng.randrange(5)}"
        second[who] = second.get(who, 0) + rng.choice([1, 20, 25, 40])
        items.append((who, second[who], "skip" if rng.random() < share else "play"))
    return items


@pytest.mark.parametrize("reset", [True, False])
@pytest.mark.parametrize("share", [0.5, 0.95, 1.0])
def test_shifts_are_the_sequential_rule(spark, monkeypatch, reset, share):
    """Small pieces, so that long runs cross many of them."""
    monkeypatch.setattr(behavior, "_ORDINALS_PER_PIECE", 16)
    items = random_items(share=share)
    found = behavior.mood_shifts(events(spark, *items), reset=reset, piece_seconds=300)
    assert sorted(r.id for r in found.collect()) == shifts_of(items, reset=reset)


def test_sessions_split_at_long_gaps(spark):
    rng, items = random.Random(2), []
    for who in ("a", "b"):
        second = 0
        for _ in range(200):
            second += rng.choice([10, 3600, 3601, 9000])
            items.append((who, second, "play"))
    found = behavior.sessionize(events(spark, *items), 3600, piece_seconds=1800)
    expected, last, number = {}, {}, {}
    for i, (who, second, _) in enumerate(items):
        if who not in last or second - last[who] > 3600:
            number[who] = number.get(who, 0) + 1
        last[who], expected[i] = second, number[who]
    assert {r.id: r.session_no for r in found.collect()} == expected


def test_labels(spark, rows, tuples):
    schema = "event_type string, skip_position_pct double"
    cases = rows(schema, ("play", 80.0), ("play", 80.1), ("replay", 99.0), ("skip", 19.9), ("skip", 20.0), ("skip", 90.0), ("play", 10.0), ("play", None))
    assert tuples(behavior.label_events(cases)) == [("play", 80.1, 1), ("replay", 99.0, 1), ("skip", 19.9, 0)]


def test_targets_are_the_last_songs_not_skipped(spark, rows):
    log = [(i, "l", f"s{i}", "play", 1.0, START + timedelta(minutes=i)) for i in range(13)]
    log += [(20 + i, "l", "x", "skip", 1.0, START + timedelta(minutes=20, seconds=i)) for i in range(3)]
    songs = rows("song_id string, genre string, energy double", *[(f"s{i}", "g" if i % 2 else "h", float(i)) for i in range(13)])
    frame = spark.createDataFrame(log, EVENTS)
    target = behavior.mood_targets(frame, behavior.mood_shifts(frame), songs).first()
    assert (target.shift_id, target.songs, target.target_energy, target.target_genre) == (22, 10, 7.5, "g")


def test_merged_stores_have_each_event_once(spark, tuples):
    one = events(spark, ("l", 1, "play"), ("l", 2, "play"))
    other = events(spark, ("l", 2, "play"), ("l", 3, "play")).withColumn("id", F.col("id") + 10)
    assert tuples(behavior.merge_stores(one, other), "id") == [(0,), (1,), (11,)]


def start(stream, folder):
    query = streams.start_append(stream, f"{folder}/rows", f"{folder}/checkpoint", available_now=True)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def write_in_parts(spark, items, folder, parts):
    """Files in order of time, rows out of order inside each."""
    log = events(spark, *items).orderBy("ts", "id").collect()
    size = -(-len(log) // parts)
    for i in range(parts):
        piece = log[i * size:(i + 1) * size]
        random.Random(i).shuffle(piece)
        spark.createDataFrame(piece, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def test_stream_of_shifts_is_the_batch(spark, tmp_path, tuples):
    items = random_items(1200, seed=4)
    folder = str(tmp_path / "events")
    write_in_parts(spark, items, folder, 4)
    arriving = streams.read_events(spark, folder, EVENTS, maxFilesPerTrigger=1)
    found = streams.mood_shifts(arriving, lateness="1 second")
    rows = start(found, str(tmp_path))
    last = max(s for _, s, _ in items) - 1
    expected = [i for i in shifts_of(items) if items[i][1] <= last]
    assert [r[0] for r in tuples(rows, "id")] == expected


def test_stream_learns_in_versions(spark, tmp_path, rows):
    folder = str(tmp_path / "rows")
    schema = "label double, x array<double>"
    batches = [[(1.0, [1.0, 0.0]), (0.0, [0.0, 1.0])], [(1.0, [1.0, 1.0])]]
    for batch in batches:
        rows(schema, *batch).coalesce(1).write.mode("append").parquet(folder)
    arriving = streams.read_events(spark, folder, schema, maxFilesPerTrigger=1)
    path = str(tmp_path / "weights")
    streams.start_learning(arriving, path, str(tmp_path / "checkpoint"), 2, available_now=True).awaitTermination()
    first, second = (streams.read_weights(spark, path, 2, version) for version in (0, 1))
    assert len(first) == 2 and first != second
    assert streams.read_weights(spark, path, 2, -1) == [0.0, 0.0]


def test_learner_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(40, 6)), rng.integers(0, 2, 40)
    frame = spark.createDataFrame([(float(l), [float(v) for v in r]) for l, r in zip(y, x)], "label double, x array<double>")
    weights = np.zeros(6)
    for _ in range(3):
        weights += 0.5 * ((y - 1 / (1 + np.exp(-x @ weights)))[:, None] * x).mean(axis=0)
    assert np.allclose(learner.train(frame, 6, 3), weights)


def test_pooling_and_unit(spark, rows):
    frame = rows("song_id string, v array<double>", ("a", [1.0, 5.0]), ("a", [3.0, 5.0]))
    for width in (None, 2):
        assert tuple(features.pool(frame, "v", width).first()) == ("a", [2.0, 5.0], [1.0, 0.0])
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(unit(F.array_repeat(F.lit(0.0), 82))) == [0.0] * 82
    assert one(unit(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    block = lambda n: F.array_repeat(F.lit(1.0), n)
    vector = one(assemble(block(40), block(24), block(14), F.lit(200.0), F.lit(0.1), F.lit(0.1), F.lit(0.1)))
    assert len(vector) == 82 and abs(np.linalg.norm(vector) - 1) < 1e-12


SR, HOP = dsp.SAMPLE_RATE, dsp.HOP


@pytest.fixture(scope="module")
def analysed(spark):
    """A tone, clicks at 120 per minute and silence, in chunks that fit no frame."""
    t = np.arange(SR * 4)
    clicks = np.zeros(len(t))
    beat = round(21 * HOP)
    for at in range(0, len(t), beat):
        clicks[at:at + 200] = 0.9
    songs = {"tone": 0.5 * np.sin(2 * np.pi * 440 * t / SR), "clicks": clicks, "silence": np.zeros(len(t))}
    chunks = [(name, i, SR, [float(v) for v in y[a:a + 5000]]) for name, y in songs.items()
              for i, a in enumerate(range(0, len(y), 5000))]
    pcm = spark.createDataFrame(chunks, "song_id string, chunk_idx bigint, sr int, samples array<float>")
    frames, tempo = dsp.analyse(pcm)
    frames = frames.persist()
    return songs, frames, features.song_features(frames, tempo, START).toPandas().set_index("song_id")


def test_frames_cover_the_song(analysed):
    songs, frames, _ = analysed
    counts = {r.song_id: r["count"] for r in frames.groupBy("song_id").count().collect()}
    assert counts == {name: 1 + len(y) // HOP for name, y in songs.items()}


def test_frame_values_match_numpy(analysed):
    songs, frames, _ = analysed
    y = np.pad(songs["tone"], dsp.FRAME // 2).astype(np.float32)
    row = frames.filter("song_id = 'tone' and frame_idx = 60").first()
    part = y[60 * HOP:60 * HOP + dsp.FRAME].astype(float)
    assert abs(row.rms - np.sqrt((part ** 2).mean())) < 1e-9
    assert abs(row.zcr - ((part[1:] < 0) != (part[:-1] < 0)).sum() / dsp.FRAME) < 1e-12
    assert row.chroma.index(max(row.chroma)) == 9  # A is nine classes above C
    assert (len(row.mfcc), len(row.chroma), len(row.contrast)) == (20, 12, 7)


def test_song_features_of_known_signals(analysed):
    _, _, rows = analysed
    assert abs(rows.energy["tone"] - 0.5 / np.sqrt(2)) < 0.01
    assert abs(rows.zcr["tone"] - 2 * 440 / SR) < 0.002
    assert abs(rows.tempo["clicks"] - 60 * SR / HOP / 21) < 1e-6
    assert rows.energy["silence"] == 0 and rows.tempo["silence"] == 0
    for vector in rows.full_vector:
        assert len(vector) == 82 and abs(np.linalg.norm(vector) - 1) < 1e-9


def test_mel_triangles_cover_the_range():
    basis = dsp.mel_basis()
    assert basis.shape == (128, 1025) and (basis >= 0).all() and (basis.sum(axis=1) > 0).all()


def test_cosine_basis_is_orthonormal():
    rows = dsp.cosine_basis(16, 16)
    assert np.allclose(rows @ rows.T, np.eye(16))


def test_a_batch_of_reactions_is_followed_once(spark, rows, tmp_path):
    """What a batch costs must not be paid for every use of its targets."""
    seen = spark.sparkContext.accumulator(0)
    schema = "listener string, id bigint, ts timestamp, target_energy double"
    reactions = rows(schema, ("a", 1, START, 0.9), ("a", 2, START + timedelta(seconds=5), 0.1), ("b", 3, START, 0.5))
    reactions.coalesce(1).write.parquet(str(tmp_path / "reactions"))

    def follow(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "reactions")).mapInPandas(follow, schema)
    queues = rows("listener string, song_id string, score double", ("a", "x", 0.5), ("a", "y", 0.45), ("c", "x", 0.1), ("c", "y", 0.2))
    energies = rows("song_id string, energy double", ("x", 0.9), ("y", 0.1))
    out = str(tmp_path / "queues")
    streams.start_reranking(stream, queues, energies, out, str(tmp_path / "checkpoint"), available_now=True).awaitTermination()
    assert seen.value == 3
    found = {(r.listener, r.song_id): (r.adjusted, r.position) for r in streams.current_queues(queues, energies, out).collect()}
    assert found == {("a", "y"): (0.45, 0), ("a", "x"): (0.1, 1), ("c", "y"): (0.2, 0), ("c", "x"): (0.1, 1)}


def test_a_fit_does_not_work_out_its_sessions_again(spark, rows, tmp_path):
    from cadenza.plans import listening

    rows("event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string", *[
        (i, START + timedelta(hours=i), 1, "view" if i % 2 else "click", 90.0 if i % 2 else 10.0, '{"k": %d}' % (i % 3)) for i in range(1, 9)
    ]).write.parquet(str(tmp_path / "events.parquet"))
    rows("vec_id bigint, embedding array<float>, label int", *[(i, [float(i), 1.0], 0) for i in range(3)]).write.parquet(str(tmp_path / "embeddings.parquet"))
    training = listening._training(spark, str(tmp_path))
    assert training.count() == 8 and training.filter("size(x) = 7").count() == 8
    assert "Window" not in training._jdf.queryExecution().toString()
