"""Extraction with one outcome per file, the job's log, and the edges and range of frame values."""

from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from cadenza import schemas
from cadenza.operators import dsp, extraction, indexing
from cadenza.streaming.indexing import REQUESTS, JobStore, start_indexing

NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
PCM = "file_path string, chunk_idx bigint, sr int, samples array<float>"
RATE, FRAME, HOP = 85, 32, 16


def beat(n, step=32):
    y = np.zeros(n)
    y[::step] = 0.8
    return [float(v) for v in y + 0.01 * np.sin(np.arange(n))]


def broken(kind):
    """Chunks of one file, three of them sound."""
    chunks = [[kind, i, RATE, beat(100)] for i in range(3)]
    if kind == "gap":
        del chunks[1]
    elif kind == "late":
        chunks = [[k, i + 1, r, s] for k, i, r, s in chunks]
    elif kind == "twice":
        chunks.append(list(chunks[1]))
    elif kind == "unread":
        chunks[2][3] = None
    elif kind == "rate":
        chunks[0][2] = 44100
    elif kind == "no rate":
        chunks[0][2] = None
    elif kind == "nan":
        chunks[1][3] = [0.0, float("nan")]
    elif kind == "inf":
        chunks[1][3] = [0.0, float("-inf")]
    elif kind == "hole":
        chunks[1][3] = [0.0, None]
    elif kind == "unnumbered":
        chunks[1][1] = None
    elif kind == "empty":
        chunks = [[k, i, r, []] for k, i, r, _ in chunks]
    elif kind == "silent":
        chunks = [[k, i, r, [0.0] * 100] for k, i, r, _ in chunks]
    return [tuple(c) for c in chunks]


REASONS = {
    "sound": None, "silent": None, "gap": "Chunks are missing", "late": "Chunks are missing", "unnumbered": "Chunks are missing",
    "twice": "Chunks are repeated", "unread": "Chunks cannot be decoded", "rate": "Sample rate is not 85",
    "no rate": "Sample rate is not 85", "nan": "Samples are not finite numbers", "inf": "Samples are not finite numbers",
    "hole": "Samples are not finite numbers", "empty": "No audio",
}


def test_every_broken_file_is_one_row_with_its_reason(rows):
    pcm = rows(PCM, *[c for kind in REASONS for c in broken(kind)])
    out = {r.file_path: r for r in extraction.extract(pcm, NOW, RATE, FRAME, HOP).collect()}
    assert {k: r.error for k, r in out.items()} == REASONS
    alone = extraction.extract(rows(PCM, *broken("sound")), NOW, RATE, FRAME, HOP).first()
    assert out["sound"] == alone and len(alone.full_vector) == 82 and alone.tempo > 0
    assert out["silent"].energy == 0 and out["silent"].tempo == 0 and len(out["silent"].full_vector) == 82
    assert all((r.full_vector is None) == (r.error is not None) for r in out.values())


def test_only_files_that_need_it_are_analysed(spark, rows, monkeypatch):
    seen, extract = [], extraction.extract
    monkeypatch.setattr(extraction, "extract", lambda pcm, *a: seen.append({r[0] for r in pcm.select("file_path").distinct().collect()}) or extract(pcm, *a))
    names = ["new", "known", "gone", "unasked"]
    pcm = rows(PCM, *[(n, 0, RATE, beat(200)) for n in names])
    songs = rows("id string, title string, file_path string, genre_tag string, indexed_at timestamp", ("k", "t", "known", None, None))
    songs = songs.select([F.col(f.name) if f.name in songs.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.SONGS])
    vector = [0.5]
    feats = spark.createDataFrame([("k", vector, vector, vector, 1.0, 1.0, 1.0, 1.0, vector, NOW)], schemas.SONG_FEATURES)
    requested = rows(REQUESTS, (0, "new"), (1, "known"), (2, "gone"), (3, "new"))
    listing = rows("file_path string", ("new",), ("known",), ("unasked",))
    for force, analysed in ((False, {"new"}), (True, {"new", "known"})):
        run = extraction.index_audio(requested, listing, songs, feats, pcm, NOW, force, RATE, FRAME, HOP)
        assert seen.pop() == analysed
        status = {r.seq: (r.status, r.error) for r in run.outcomes.collect()}
        assert status[0] == ("extracted", None) and status[2] == ("error", "File not found")
        assert status[1][0] == ("extracted" if force else "already indexed")
        assert run.features.count() == 2


def test_zero_crossings_at_the_edges_and_near_zero(rows):
    y = [-1.0] * 40
    frames = dsp.frames_of(rows("song_id string, chunk_idx bigint, sr int, samples array<float>", ("s", 0, RATE, y)), 16, 8)
    rate = dsp.zero_crossing_rate(F.col("samples"), F.col("before"), F.col("inside"))
    found = {r.frame_idx: (r.before, r.inside, r.z) for r in frames.select("frame_idx", "before", "inside", rate.alias("z")).collect()}
    assert found[0] == (8, 8, 0.0) and found[2] == (0, 16, 0.0) and found[5] == (0, 8, 0.0)  # no change where the song begins or ends
    one = rows("samples array<float>", ([1.0, -1e-12, 1.0, -1.0, 0.0, -1.0],)).select(dsp.zero_crossing_rate(F.col("samples"))).first()[0]
    assert one == pytest.approx(3 / 6)


def test_contrast_and_bands_end_80_db_below_the_songs_highest(rows):
    levels = rows("song_id string, frame_idx int, loud array<double>, quiet array<double>",
                  ("s", 0, [10.0, -100.0], [0.0, -100.0]), ("s", 1, [-100.0, -30.0], [-100.0, -95.0]), ("t", 0, [-100.0], [-100.0]))
    out = {(r.song_id, r.frame_idx): r.contrast for r in dsp.spectral_contrast(levels).collect()}
    assert out == {("s", 0): [10.0, -70.0 + 80.0], ("s", 1): [-70.0 + 80.0, -30.0 + 80.0], ("t", 0): [0.0]}


def test_mfcc_equals_numpy(rows):
    random = np.random.default_rng(5)
    power = random.random((4, 17)) ** 8
    frames = rows("song_id string, frame_idx int, power array<double>", *[("s", i, p.tolist()) for i, p in enumerate(power)])
    mels = frames.withColumn("mel", dsp.mel_bands(F.col("power"), 22050, 32, 8))
    out = dsp.cepstrum(mels.select("song_id", "frame_idx", dsp.decibels(F.col("mel")).alias("bands")), 8, 5).orderBy("frame_idx").collect()
    db = 10 * np.log10(np.maximum(power @ dsp.mel_basis(22050, 32, 8).T, 1e-10))
    db = np.maximum(db, db.max() - 80)
    k, i = np.arange(5)[:, None], np.arange(8)[None, :]
    dct = np.cos(np.pi * k * (2 * i + 1) / 16) * np.sqrt(2 / 8) * np.where(k == 0, np.sqrt(0.5), 1)
    assert np.allclose([r.mfcc for r in out], db @ dct.T)


def test_a_failed_step_is_run_again_and_replaces_its_log(spark, rows, tmp_path):
    requests, store = str(tmp_path / "requests"), JobStore(spark, str(tmp_path / "job"))
    listing = rows("file_path string", *[(f"f{i}",) for i in range(6)])
    songs = spark.createDataFrame([], schemas.SONGS)
    feats = rows("song_id string, tempo double, energy double, extracted_at timestamp").limit(0)
    analysed = rows("file_path string, error string, tempo double, energy double", *[(f"f{i}", None, 100.0 + i, 0.1) for i in range(6)])
    fail, calls = [], []

    def index(requested, listing, songs, features, as_of):
        calls.append((requested.count(), songs.count(), features.count()))
        run = indexing.index_files(requested, listing, songs, features, analysed, as_of)
        if fail:
            raise OSError("lost")
        return run

    def start():
        stream = spark.readStream.schema(REQUESTS).parquet(requests)
        start_indexing(stream, listing, songs, feats, store, str(tmp_path / "checkpoint"), index, lambda: NOW, available_now=True).awaitTermination()

    def ask(*wanted):
        rows(REQUESTS, *wanted).coalesce(1).write.mode("append").parquet(requests)

    def status():
        return tuple(indexing.index_progress(indexing.index_status(store.log())).select("total", "completed", "status", "eta_seconds", "is_done").first())

    assert status() == (0, 0, "idle", 0, False)
    ask((0, "f0"), (1, "f1"))
    start()
    assert status() == (2, 2, "idle", 0, True)
    ask((2, "f1"), (3, "f2"), (4, "gone"))
    fail.append(1)
    with pytest.raises(StreamingQueryException):
        start()
    assert status() == (5, 2, "running", 6, False)
    fail.clear()
    start()
    assert status() == (5, 5, "idle", 0, True)
    ask((5, "f2"), (6, "f3"))
    start()
    log = {r.seq: (r.batch, r.status, r.error) for r in store.log().collect()}
    assert log == {
        0: (0, "extracted", None), 1: (0, "extracted", None), 2: (1, "already indexed", None), 3: (1, "extracted", None),
        4: (1, "error", "File not found"), 5: (2, "already indexed", None), 6: (2, "extracted", None)}
    assert calls == [(2, 0, 0), (3, 2, 2), (3, 2, 2), (2, 3, 3)]  # the restart sees what the failed step saw
    assert store.read("features", feats.schema).count() == 4 and store.read("songs", songs.schema).filter("genre_tag is null").count() == 0


def test_a_step_works_out_its_outcomes_once_a_song_and_once_a_request(spark, rows, tmp_path):
    """And reads its batch once: songs and features are cut to a row per song of the outcomes."""
    read, made = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    requests, store = str(tmp_path / "requests"), JobStore(spark, str(tmp_path / "job"))
    songs, feats = spark.createDataFrame([], schemas.SONGS), rows("song_id string, tempo double, extracted_at timestamp").limit(0)
    found = "seq bigint, file_path string, song_id string, status string, features_extracted boolean, error string, message string"

    def counted(total):
        def count(batches):
            for batch in batches:
                total.add(len(batch))
                yield batch
        return count

    def index(requested, listing, songs, features, as_of):
        outcomes = requested.select("*", F.lit("id").alias("song_id"), F.lit("extracted").alias("status"), F.lit(True).alias("features_extracted"),
                                    F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("message"))
        return indexing.IndexRun(outcomes.mapInPandas(counted(made), found), songs, features)

    rows(REQUESTS, *[(i, "f") for i in range(5)]).coalesce(1).write.parquet(requests)
    stream = spark.readStream.schema(REQUESTS).parquet(requests).mapInPandas(counted(read), REQUESTS)
    start_indexing(stream, rows("file_path string", ("f",)), songs, feats, store, str(tmp_path / "checkpoint"), index, lambda: NOW, available_now=True).awaitTermination()
    assert store.log().filter("status = 'extracted'").count() == 5
    assert read.value == 5 and made.value == 10
