"""Queries over frames, signals, features and the indexing job.

Signals are the embeddings: each is a short song in four chunks, analysed with
frames of 32 samples. Rates and sizes are parameters of the operators.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from cadenza.functions import scalars as S
from cadenza.functions.vectors import assemble, average, unit
from cadenza import schemas
from cadenza.operators import dsp, extraction, features, indexing
from cadenza.plans.registry import query
from cadenza.plans.standins import AS_OF, table, view

NOW = datetime.fromisoformat(AS_OF)
FRAME, HOP = 32, 16


def _pcm(spark, folder):
    quarter = (F.size("embedding") / 4).cast("int")
    parts = table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("song_id"), "embedding", quarter.alias("n"),
        F.explode(F.sequence(F.lit(0), F.lit(3))).alias("chunk_idx"),
    )
    cut = F.slice("embedding", F.col("chunk_idx") * F.col("n") + 1, F.col("n"))
    return parts.select("song_id", F.col("chunk_idx").cast("long"), F.lit(22050).alias("sr"), cut.alias("samples"))


_CUT = """
    padded as (
        select song_id, n, list_concat(list_transform(range(16), lambda i: 0.0::double), v,
                                       list_transform(range(32), lambda i: 0.0::double)) p from songs),
    framed as (
        select song_id, f frame_idx, p[f * 16 + 1 : f * 16 + 32] x
        from padded cross join (select unnest(range(1000)) f) where f <= n // 16)"""

_FRAMES = f"""
    songs as (
        select cast(vec_id as varchar) song_id, cast(embedding as double[]) v, len(embedding) n from {{embeddings}}),{_CUT}"""


@query(f"""with {_FRAMES}
    select song_id, frame_idx, round(sqrt(list_inner_product(x, x) / 32), 6) rms from framed""")
def frame_rms(spark, folder):
    frames = dsp.frames_of(_pcm(spark, folder), FRAME, HOP)
    return frames.select("song_id", "frame_idx", F.round(dsp.rms(F.col("samples")), 6).alias("rms"))


@query("""
    with songs as (
        select cast(vec_id as varchar) song_id, cast(embedding as double[]) v, len(embedding) n from {embeddings}),
    own as (
        select song_id, f frame_idx, v[greatest(0, f * 16 - 16) + 1 : least(n, f * 16 + 16)] x
        from songs cross join (select unnest(range(1000)) f) where f <= n // 16)
    select song_id, frame_idx, round(coalesce(list_sum(list_transform(list_zip(x[1:len(x) - 1], x[2:len(x)]),
               lambda z: cast((z[1] < 0) <> (z[2] < 0) as int))), 0) / 32, 6) zcr from own""")
def frame_zero_crossings(spark, folder):
    """A song goes on with its first and last sample beyond its edges, so no sign changes there."""
    frames = dsp.frames_of(_pcm(spark, folder), FRAME, HOP)
    rate = dsp.zero_crossing_rate(F.col("samples"), F.col("before"), F.col("inside"))
    return frames.select("song_id", "frame_idx", F.round(rate, 6).alias("zcr"))


_BINS = """
    samples as (
        select song_id, frame_idx, unnest(x) x, generate_subscripts(x, 1) - 1 t from framed),
    spectrum as (
        select song_id, frame_idx, k,
               pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * t / 32)) * cos(2 * pi() * k * t / 32)), 2)
               + pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * t / 32)) * sin(2 * pi() * k * t / 32)), 2) power
        from samples cross join (select unnest(range(17)) k) group by song_id, frame_idx, k)"""

_SPECTRUM = f"{_FRAMES},{_BINS}"


def _spectrum(spark, folder):
    frames = dsp.frames_of(_pcm(spark, folder), FRAME, HOP)
    return frames.select("song_id", "frame_idx", dsp.power_spectrum(F.col("samples"), FRAME).alias("power"))


@query(f"""with {_SPECTRUM} select song_id, frame_idx, cast(k as int) bin, round(power, 6) + 0.0 power from spectrum""")
def frame_spectrum(spark, folder):
    cells = _spectrum(spark, folder).select("song_id", "frame_idx", F.posexplode("power").alias("bin", "power"))
    return cells.withColumn("power", F.round("power", 6))


@query(f"""with {_SPECTRUM},
    weights as (
        select k, c, case when k = 0 then 0 else
               exp(-0.5 * pow(2 * (m - 12 * floor(m / 12) - 6), 2)) end w
        from (select k, c, 12 * log2(k * 22050 / 32 / 440.0) + 9 - c + 6 m
              from (select unnest(range(1, 17)) k), (select unnest(range(12)) c))),
    bands as (
        select song_id, frame_idx, c, sum(power * w) v
        from spectrum join weights using (k) group by song_id, frame_idx, c)
    select song_id, frame_idx, cast(c as int) pitch, round(v / max(v) over (partition by song_id, frame_idx), 6) as level
    from bands""")
def frame_chroma(spark, folder):
    basis = dsp.chroma_basis(dsp.SAMPLE_RATE, FRAME)
    bands = _spectrum(spark, folder).withColumn("bands", dsp.basis_project(F.col("power"), basis))
    levels = F.posexplode(dsp.normalise_to_peak(F.col("bands"))).alias("pitch", "level")
    cells = bands.select("song_id", "frame_idx", levels)
    return cells.withColumn("level", F.round("level", 6))


# At this frame size most octaves are narrower than a bin, so wider bands are given.
_EDGES = [(0, 3), (4, 9), (10, 16)]


@query(f"""with {_SPECTRUM},
    banded as (
        select song_id, frame_idx, case when k <= 3 then 0 when k <= 9 then 1 else 2 end band, sqrt(power) a from spectrum),
    placed as (
        select *, row_number() over (partition by song_id, frame_idx, band order by a) up,
               row_number() over (partition by song_id, frame_idx, band order by a desc) down,
               greatest(1, round_even(0.3 * count(*) over (partition by song_id, frame_idx, band), 0)) edge
        from banded),
    levels as (
        select song_id, frame_idx, band, 10 * log10(greatest(avg(a) filter (down <= edge), 1e-10)) loud,
               10 * log10(greatest(avg(a) filter (up <= edge), 1e-10)) quiet
        from placed group by song_id, frame_idx, band)
    select song_id, frame_idx, band, round(
               greatest(loud, max(loud) over (partition by song_id) - 80)
               - greatest(quiet, max(quiet) over (partition by song_id) - 80), 4) contrast
    from levels""")
def frame_contrast(spark, folder):
    levels = _spectrum(spark, folder).withColumn("levels", dsp.contrast_levels(F.col("power"), _EDGES, 0.3))
    contrast = dsp.spectral_contrast(levels.select("song_id", "frame_idx", "levels.loud", "levels.quiet"))
    cells = contrast.select("song_id", "frame_idx", F.posexplode("contrast").alias("band", "contrast"))
    return cells.withColumn("contrast", F.round("contrast", 4))


@query(f"""with {_SPECTRUM},
    edges as (
        select i, case when m < 15 then m * 200.0 / 3 else 1000 * exp((m - 15) * ln(6.4) / 27) end hz
        from (select i, i * top / 9 m from (select unnest(range(10)) i),
              (select 15 + ln(22050 / 2.0 / 1000) / (ln(6.4) / 27) top))),
    weights as (
        select k, l.i band, greatest(0, least((k * 22050 / 32 - l.hz) / (c.hz - l.hz), (r.hz - k * 22050 / 32) / (r.hz - c.hz)))
               * 2 / (r.hz - l.hz) w
        from (select unnest(range(17)) k) cross join edges l join edges c on c.i = l.i + 1 join edges r on r.i = l.i + 2),
    mels as (
        select song_id, frame_idx, band, 10 * log10(greatest(sum(power * w), 1e-10)) db
        from spectrum join weights using (k) group by song_id, frame_idx, band),
    limited as (select song_id, frame_idx, band, greatest(db, max(db) over (partition by song_id) - 80) db from mels)
    select song_id, frame_idx, cast(c as int) coefficient, round(sum(db * cos(pi() * c * (2 * band + 1) / 16) * sqrt(2.0 / 8))
               * case when c = 0 then 1 / sqrt(2.0) else 1 end, 4) + 0.0 as level
    from limited cross join (select unnest(range(5)) c) group by song_id, frame_idx, c""")
def frame_mfcc(spark, folder):
    """Spectrum to mel bands to dB to coefficients; eight bands, as frames are short here."""
    mels = _spectrum(spark, folder).withColumn("mel", dsp.mel_bands(F.col("power"), dsp.SAMPLE_RATE, FRAME, 8))
    bands = mels.select("song_id", "frame_idx", dsp.decibels(F.col("mel")).alias("bands"))
    cells = dsp.cepstrum(bands, 8, 5).select(
        "song_id", "frame_idx", F.posexplode("mfcc").alias("coefficient", "level"))
    return cells.withColumn("level", F.round("level", 4))


@query("""
    with x as (
        select cast(vec_id as varchar) song_id, unnest(cast(embedding as double[])) x,
               generate_subscripts(embedding, 1) - 1 i, len(embedding) n from {embeddings})
    select song_id, cast(k as int) k, round(sum(x * cos(pi() * k * (2 * i + 1) / (2 * n)) * sqrt(2.0 / n))
               * case when k = 0 then 1 / sqrt(2.0) else 1 end, 6) + 0.0 coefficient
    from x cross join (select unnest(range(20)) k) group by song_id, k""")
def cosine_coefficients(spark, folder):
    """The last step of the MFCC: bands to coefficients."""
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("song_id"), "embedding")
    width = vectors.select(F.size("embedding")).first()[0]
    cells = vectors.select("song_id", F.posexplode(
        dsp.basis_project(F.col("embedding"), dsp.cosine_basis(width, dsp.MFCCS))
    ).alias("k", "coefficient"))
    return cells.withColumn("coefficient", F.round("coefficient", 6))


_ONSETS = """
    onsets as (
        select vec_id frame_idx, coalesce(list_sum(list_transform(list_zip(embedding, before),
                   lambda z: greatest(z[1]::double - z[2]::double, 0))) / len(embedding), 0) onset
        from (select *, lag(embedding) over (order by vec_id) before from {embeddings}))"""


def _onsets(spark, folder):
    """All embeddings as the frames of one long recording."""
    frames = table(spark, folder, "embeddings").select(
        F.lit("all").alias("song_id"), F.col("vec_id").alias("frame_idx"),
        F.col("embedding").cast("array<double>").alias("bands"),
    )
    return dsp.onset_strength(frames, frames_per_piece=128)


@query(f"with {_ONSETS} select frame_idx, round(onset, 6) onset from onsets")
def onset_envelope(spark, folder):
    return _onsets(spark, folder).select("frame_idx", F.round("onset", 6).alias("onset"))


@query(f"""with {_ONSETS}
    select cast(lag as int) lag, round(sum(a.onset * b.onset), 6) score
    from onsets a cross join (select unnest(range(9, 87)) lag) join onsets b on b.frame_idx = a.frame_idx + lag
    group by lag""")
def onset_lags(spark, folder):
    scores = dsp.lag_scores(_onsets(spark, folder), 9, 86, frames_per_piece=128)
    return scores.select("lag", F.round("score", 6).alias("score"))


@query(f"""with {_ONSETS},
    scores as (
        select lag, sum(a.onset * b.onset) score
        from onsets a cross join (select unnest(range(9, 87)) lag) join onsets b on b.frame_idx = a.frame_idx + lag
        group by lag)
    select round(60.0 * 22050 / 512 / lag, 6) tempo from scores
    order by round(score * exp(-0.5 * pow(log2(60.0 * 22050 / 512 / lag / 120), 2)), 9) desc, lag limit 1""")
def tempo_estimate(spark, folder):
    return dsp.tempo(_onsets(spark, folder)).select(F.round("tempo", 6).alias("tempo"))


@query()
def analysed_songs(spark, folder):
    """Signal to stored feature row, through every step."""
    frames, tempo = dsp.analyse(_pcm(spark, folder), dsp.SAMPLE_RATE, FRAME, HOP)
    rows = features.song_features(frames, tempo, NOW)
    return rows.select(
        "song_id", F.size("mfcc_vector").alias("mfcc"), F.size("chroma_vector").alias("chroma"),
        F.size("contrast_vector").alias("contrast"), F.size("full_vector").alias("width"),
        *[F.round(c, 3).alias(c) for c in ("tempo", "energy", "zcr", "valence_proxy")],
    )


def _frames(spark, folder):
    return view(spark, folder, "frames")


_POOLED = """
    pooled as (
        select song_id, avg(q) mq, stddev_pop(q) sq, avg(d) md, stddev_pop(d) sd, avg(t) mt, stddev_pop(t) st
        from frames group by song_id)"""


@query(f"""with {_POOLED}
    select song_id, unnest([0, 1, 2]) place, unnest([round(mq, 6), round(md, 6), round(mt, 6)]) mean,
           unnest([round(sq, 6), round(sd, 6), round(st, 6)]) std from pooled""")
def pooled_frames(spark, folder):
    pooled = features.pool(_frames(spark, folder).withColumn("v", F.array("q", "d", "t")), "v")
    cells = pooled.select("song_id", F.posexplode(F.arrays_zip("means", "stds")).alias("place", "c"))
    return cells.select("song_id", "place", F.round("c.means", 6).alias("mean"), F.round("c.stds", 6).alias("std"))


@query(f"""with {_POOLED},
    raw as (
        select song_id, [mq, sq, md, sd, mt, st, mq / 200.0, md * 10, mt * 10, (md + mt) / 2 * mq * 10]::double[] v from pooled),
    cells as (
        select song_id, unnest(v) x, generate_subscripts(v, 1) - 1 place, sqrt(list_inner_product(v, v)) n from raw)
    select song_id, cast(place as int) place, round(x / n, 6) "value" from cells""")
def assembled_vectors(spark, folder):
    """Three one-wide blocks and four scalars, put together and brought to length one."""
    frames = _frames(spark, folder)
    blocks = [
        features.pooled_vector(frames.select("song_id", F.array(c).alias("v")), "v", name)
        for c, name in (("q", "mfcc"), ("d", "chroma"), ("t", "contrast"))
    ]
    scalars = features.scalar_means(frames.select("song_id", F.col("d").alias("rms"), F.col("t").alias("zcr")))
    tempo = frames.groupBy("song_id").agg(F.avg("q").alias("tempo"))
    joined = blocks[0].join(blocks[1], "song_id").join(blocks[2], "song_id").join(scalars, "song_id").join(tempo, "song_id")
    brightness = average(F.array("energy", "zcr"))
    vector = assemble(
        F.col("mfcc"), F.col("chroma"), F.col("contrast"), F.col("tempo"), F.col("energy"), F.col("zcr"),
        brightness * F.col("tempo"),
    )
    cells = joined.select("song_id", F.posexplode(vector).alias("place", "value"))
    return cells.withColumn("value", F.round("value", 6))


@query("""
    with f as (
        select song_id, avg(sqrt(q)) energy, avg(ln(1 + d)) zcr, (avg(q) + avg(d) + avg(t)) / 3 brightness from frames group by song_id)
    select song_id, round(energy, 6) energy, round(zcr, 6) zcr, round(brightness * energy, 6) valence_proxy from f""")
def song_scalars(spark, folder):
    """Whole feature rows from frames whose blocks repeat three values."""
    frames = _frames(spark, folder)
    wide = frames.select(
        "song_id", F.array_repeat("q", features.MFCC).alias("mfcc"),
        F.flatten(F.array_repeat(F.array("q", "d", "t"), 4)).alias("chroma"),
        F.array_repeat("t", features.CONTRAST).alias("contrast"),
        F.sqrt("q").alias("rms"), F.log1p("d").alias("zcr"),
    )
    tempo = frames.groupBy("song_id").agg(F.max("q").alias("tempo"))
    rows = features.song_features(wide, tempo, NOW)
    return rows.select("song_id", *[F.round(c, 6).alias(c) for c in ("energy", "zcr", "valence_proxy")])


@query("""
    select song_id, round(list_sum(u), 6) + 0.0 total, round(list_inner_product(u, u), 6) as square from unit_features""")
def unit_vectors(spark, folder):
    vectors = view(spark, folder, "features").select("song_id", unit(F.col("full_vector")).alias("u"))
    total = F.aggregate("u", F.lit(0.0), lambda s, x: s + x)
    square = F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x)
    return vectors.select("song_id", F.round(total, 6).alias("total"), F.round(square, 6).alias("square"))


@query("""
    select song_id, case when energy > 0.15 and tempo > 110 then 'Energetic' else 'Calm' end genre_tag from features""")
def mood_tags(spark, folder):
    return view(spark, folder, "features").select("song_id", S.mood_tag(F.col("energy"), F.col("tempo")).alias("genre_tag"))


@query(f"""
    select s.id, case when f.song_id is null then s.genre_tag
                      when f.energy > 0.15 and f.tempo > 110 then 'Energetic' else 'Calm' end genre_tag,
           epoch_us(case when f.song_id is not null then timestamp '{AS_OF}' else s.indexed_at end) indexed_us
    from songs_existing s left join features f on f.song_id = s.id""")
def stamped_songs(spark, folder):
    stamped = features.stamp(view(spark, folder, "songs_existing"), view(spark, folder, "features"), NOW)
    return stamped.select("id", "genre_tag", F.unix_micros("indexed_at").alias("indexed_us"))


def _index(spark, folder, force=False):
    names = ("index_requests", "listing", "songs_existing", "indexed", "analysed")
    return indexing.index_files(*[view(spark, folder, n) for n in names], as_of=NOW, force=force)


_OUTCOMES = """
    requested as (
        select r.*, row_number() over (partition by r.file_path order by seq) turn from index_requests r),
    outcomes as (
        select seq, r.file_path, l.file_path is not null present, i.song_id is not null was_indexed, error, turn,
               coalesce(s.id, sha256(r.file_path)) song_id, a.file_path is null or error is not null failed
        from requested r left join listing l on l.file_path = r.file_path
        left join songs_existing s on s.file_path = r.file_path left join indexed i on i.song_id = s.id
        left join analysed a on a.file_path = r.file_path)"""


def _outcome_sql(force):
    indexed = "false" if force else "was_indexed"
    again = "false" if force else "turn > 1"
    return f"""with {_OUTCOMES}
    select seq, file_path, case when present then song_id end song_id,
           case when not present then 'error' when {indexed} then 'already indexed' when failed then 'error'
                when {again} then 'already indexed' else 'extracted' end status,
           present and not {indexed} and not failed and not {again} features_extracted,
           case when not present then 'File not found' when {indexed} then null when failed then error end error
    from outcomes"""


@query(_outcome_sql(False))
def index_outcomes(spark, folder):
    return _index(spark, folder).outcomes.drop("message")


@query(_outcome_sql(True))
def index_outcomes_forced(spark, folder):
    return _index(spark, folder, force=True).outcomes.drop("message")


@query(f"""with whole as ({_outcome_sql(False)}) select status, count(*) files from whole group by status""")
def index_statistics(spark, folder):
    return indexing.index_counts(_index(spark, folder).outcomes)


_SAVED = f"""{_OUTCOMES},
    extracted as (
        select distinct o.song_id, o.file_path, a.tempo, a.energy from outcomes o join analysed a on a.file_path = o.file_path
        where present and not was_indexed and not failed)"""


@query(f"""with {_SAVED}
    select song_id, round(tempo, 6) tempo, round(energy, 6) energy, epoch_us(extracted_at) extracted_us from indexed
    union all
    select song_id, round(tempo, 6), round(energy, 6), epoch_us(timestamp '{AS_OF}') from extracted""")
def index_features(spark, folder):
    rows = _index(spark, folder).features
    return rows.select("song_id", F.round("tempo", 6).alias("tempo"), F.round("energy", 6).alias("energy"),
                       F.unix_micros("extracted_at").alias("extracted_us"))


@query(f"""with {_SAVED},
    registered as (
        select id, file_path from songs_existing union all
        select distinct song_id, file_path from outcomes
        where present and file_path not in (select file_path from songs_existing))
    select r.id, r.file_path, case when e.song_id is not null then
               case when e.energy > 0.15 and e.tempo > 110 then 'Energetic' else 'Calm' end end genre_tag
    from registered r left join extracted e on e.song_id = r.id""")
def index_songs(spark, folder):
    return _index(spark, folder).songs.select("id", "file_path", "genre_tag")


@query("""
    select '/music/Brand#17/1.mp3' file_path,
           case when exists (select 1 from listing where file_path = '/music/Brand#17/1.mp3') then
               case when exists (select 1 from indexed i join songs_existing s on s.id = i.song_id
                                 where s.file_path = '/music/Brand#17/1.mp3') then 'already indexed'
                    when exists (select 1 from analysed where file_path = '/music/Brand#17/1.mp3' and error is null)
                    then 'extracted' else 'error' end
           else 'error' end status""")
def index_single_file(spark, folder):
    names = ("listing", "songs_existing", "indexed", "analysed")
    run = indexing.index_one("/music/Brand#17/1.mp3", *[view(spark, folder, n) for n in names], as_of=NOW)
    return run.outcomes.select("file_path", "status")


_STATUS = """
    status as (
        select cast(count(*) as int) total, cast(count(finished_at) as int) completed,
               max({'s': started_at, 'f': file_path}) filter (finished_at is null) latest
        from index_log)"""


@query(f"""with {_STATUS}
    select total, completed, latest.f current_file,
           case when completed < total then (total - completed) * 2 else 0 end eta_seconds,
           case when completed < total then 'running' else 'idle' end status from status""")
def index_status(spark, folder):
    return indexing.index_status(view(spark, folder, "index_log"))


@query(f"""with {_STATUS}
    select total, completed, round(completed / total, 6) ratio, format('{{:.1f}}%', round(100.0 * completed / total, 1)) percent,
           completed = total and total > 0 is_done from status""")
def index_progress(spark, folder):
    progress = indexing.index_progress(indexing.index_status(view(spark, folder, "index_log")))
    return progress.select("total", "completed", F.round("ratio", 6).alias("ratio"), "percent", "is_done")


# Recordings: eight embeddings each, at a rate so low that frames of 32 samples hold beats. Of each kind of
# broken file there are some, some files are silent, some missing, and every file is asked for twice.
RATE = 85


def _recordings(spark, folder):
    number, chunk = F.floor(F.col("vec_id") / 8), F.col("vec_id") % 8
    samples = (
        F.when(number % 7 == 6, F.lit(None))
        .when(number % 91 == 7, F.array().cast("array<float>"))
        .when(number % 11 == 2, F.transform("embedding", lambda x: x * 0))
        .when((number % 7 == 5) & (chunk == 1), F.transform("embedding", lambda x, i: F.when(i == 9, float("nan")).otherwise(x)))
        .otherwise(F.col("embedding"))
    )
    return table(spark, folder, "embeddings").filter((number % 7 != 2) & ~((number % 7 == 1) & (chunk == 2))).select(
        F.concat(F.lit("/audio/"), number.cast("string"), F.lit(".wav")).alias("file_path"), chunk.alias("chunk_idx"),
        F.when((number % 7 == 3) & (chunk == 5), 44100).otherwise(RATE).alias("sr"), samples.cast("array<float>").alias("samples"),
    )


def _index_audio(spark, folder):
    vectors = table(spark, folder, "embeddings").withColumn("number", F.floor(F.col("vec_id") / 8))
    path = F.concat(F.lit("/audio/"), F.col("number").cast("string"), F.lit(".wav")).alias("file_path")
    files = vectors.filter("vec_id % 8 = 0").select("number", path)
    known = files.filter("number % 5 = 0").select(F.concat(F.lit("s"), F.col("number").cast("string")).alias("id"), "file_path", "number")
    songs = known.select([
        F.col(f.name) if f.name in ("id", "file_path") else F.lit("kept" if f.name == "title" else None).cast(f.dataType).alias(f.name)
        for f in schemas.SONGS])
    indexed = known.filter("number % 10 = 0").select([
        F.col("id").alias("song_id") if f.name == "song_id" else F.lit(NOW).alias(f.name) if f.name == "extracted_at"
        else (F.array(F.lit(0.5)) if f.dataType == schemas.VECTOR else F.lit(0.5)).alias(f.name)
        for f in schemas.SONG_FEATURES])
    requested = vectors.filter("vec_id % 8 in (0, 3)").select(F.col("vec_id").alias("seq"), path)
    listing = files.filter("number % 9 <> 4").select("file_path")
    return extraction.index_audio(
        requested, listing, songs, indexed, _recordings(spark, folder), NOW, sr=RATE, frame=FRAME, hop=HOP)


_FILES = """
    files as (
        select vec_id // 8 f, count(*) chunks, concat('/audio/', cast(vec_id // 8 as varchar), '.wav') file_path,
               flatten(list(cast(embedding as double[]) order by vec_id)) v
        from {embeddings} group by vec_id // 8),
    checked as (
        select *, case when f % 5 = 0 then concat('s', cast(f as varchar)) else sha256(file_path) end song_id,
               f % 9 <> 4 present, f % 10 = 0 was_indexed,
               case when f % 7 = 2 then 'No audio could be read' when f % 7 = 1 and chunks > 3 then 'Chunks are missing'
                    when f % 7 = 6 then 'Chunks cannot be decoded' when f % 7 = 3 and chunks > 5 then 'Sample rate is not 85'
                    when f % 7 = 5 and chunks > 1 and f % 11 <> 2 then 'Samples are not finite numbers'
                    when f % 91 = 7 then 'No audio' end reason
        from files)"""


@query(f"""with {_FILES},
    requested as (select vec_id seq, vec_id // 8 f, vec_id % 8 > 0 again from {{embeddings}} where vec_id % 8 in (0, 3))
    select seq, file_path, case when present then song_id end song_id,
           case when not present then 'error' when was_indexed then 'already indexed' when reason is not null then 'error'
                when again then 'already indexed' else 'extracted' end status,
           present and not was_indexed and reason is null and not again features_extracted,
           case when not present then 'File not found' when not was_indexed then reason end error
    from requested join checked using (f)""")
def index_audio(spark, folder):
    """From recordings to outcomes: broken, missing, silent, repeated and indexed files."""
    return _index_audio(spark, folder).outcomes.drop("message")


@query(f"""with {_FILES},
    songs as (
        select song_id, len(v) n, case when f % 11 = 2 then list_transform(v, lambda x: 0.0::double) else v end v
        from checked where present and not was_indexed and reason is null),{_CUT},{_BINS},
    scalars as (
        select s.song_id, frame_idx, sqrt(list_inner_product(x, x) / 32) rms,
               v[greatest(0, frame_idx * 16 - 16) + 1 : least(n, frame_idx * 16 + 16)] own
        from framed join songs s using (song_id)),
    mel_weights as (
        select k, b, greatest(0, least((hz - b * w) / w, ((b + 2) * w - hz) / w)) / w weight
        from (select k, b, k * 85 / 32.0 hz, 42.5 / 129 w from (select unnest(range(17)) k), (select unnest(range(128)) b))),
    mels as (
        select song_id, frame_idx, b, 10 * log10(greatest(sum(power * weight), 1e-10)) db
        from spectrum join mel_weights using (k) group by song_id, frame_idx, b),
    bands as (select song_id, frame_idx, b, greatest(db, max(db) over (partition by song_id) - 80) db from mels),
    chroma_weights as (
        select k, c, exp(-0.5 * pow(2 * (m - 12 * floor(m / 12) - 6), 2)) w
        from (select k, c, 12 * log2(k * 85 / 32.0 / 440) + 9 - c + 6 m
              from (select unnest(range(1, 17)) k), (select unnest(range(12)) c))),
    chromas as (
        select song_id, frame_idx, c, sum(power * w) v from spectrum join chroma_weights using (k) group by song_id, frame_idx, c),
    levels as (
        select song_id, frame_idx, 0 band, 10 * log10(greatest(sqrt(max(power)), 1e-10)) loud,
               10 * log10(greatest(sqrt(min(power)), 1e-10)) quiet from spectrum where k < 16 group by song_id, frame_idx
        union all
        select song_id, frame_idx, band, 10 * log10(greatest(sqrt(power), 1e-10)), 10 * log10(greatest(sqrt(power), 1e-10))
        from spectrum cross join (select unnest(range(1, 7)) band) where k = 16),
    onsets as (
        select song_id, frame_idx, coalesce(avg(greatest(db - before, 0)), 0) onset
        from (select *, lag(db) over (partition by song_id, b order by frame_idx) before from bands) group by song_id, frame_idx),
    lags as (
        select a.song_id, lag, sum(a.onset * b.onset) score from onsets a cross join (select unnest(range(1, 11)) lag)
        join onsets b on b.song_id = a.song_id and b.frame_idx = a.frame_idx + lag group by a.song_id, lag),
    beats as (
        select song_id, max({{'w': w, 'l': -lag}}) best
        from (select *, round(score * exp(-0.5 * pow(log2(60.0 * 85 / 16 / lag / 120), 2)), 9) w from lags) group by song_id),
    tempos as (select song_id, case when best.w > 0 then 60.0 * 85 / 16 / -best.l else 0 end tempo from beats),
    cells as (
        select song_id, frame_idx, c place, sum(db * cos(pi() * c * (2 * b + 1) / 256) * sqrt(2.0 / 128))
               * case when c = 0 then 1 / sqrt(2.0) else 1 end x
        from bands cross join (select unnest(range(20)) c) group by song_id, frame_idx, c
        union all
        select song_id, frame_idx, 20 + c, case when max(v) over w > 0 then v / max(v) over w else v end
        from chromas window w as (partition by song_id, frame_idx)
        union all
        select song_id, frame_idx, 32 + band, greatest(loud, max(loud) over w - 80) - greatest(quiet, max(quiet) over w - 80)
        from levels window w as (partition by song_id)
        union all
        select song_id, frame_idx, 39, rms from scalars
        union all
        select song_id, frame_idx, 40, coalesce(list_sum(list_transform(list_zip(own[1:len(own) - 1], own[2:len(own)]),
               lambda z: cast((z[1] < 0) <> (z[2] < 0) as int))), 0) / 32 from scalars),
    pooled as (select song_id, place, avg(x) mean, stddev_pop(x) std from cells group by song_id, place),
    rows as (
        select song_id, max(mean) filter (place = 39) energy, max(mean) filter (place = 40) zcr,
               avg(mean) filter (place between 20 and 31) brightness from pooled group by song_id),
    vectors as (
        select song_id, case when place < 20 then place when place < 32 then place + 20 else place + 32 end place, mean x
        from pooled where place < 39
        union all
        select song_id, case when place < 20 then place + 20 when place < 32 then place + 32 else place + 39 end, std
        from pooled where place < 39
        union all select song_id, 78, coalesce(tempo, 0) / 200 from rows left join tempos using (song_id)
        union all select song_id, 79, energy * 10 from rows
        union all select song_id, 80, zcr * 10 from rows
        union all select song_id, 81, brightness * energy * 10 from rows)
    select song_id, cast(place as int) place, round(x / sqrt(sum(x * x) over (partition by song_id)), 5) + 0.0 as "value" from vectors""")
def index_audio_vectors(spark, folder):
    """Feature vectors that the job saves for recordings it had not indexed before, entry by entry."""
    run = _index_audio(spark, folder)
    saved = run.features.join(run.outcomes.filter("features_extracted").select("song_id"), "song_id", "left_semi")
    cells = saved.select("song_id", F.posexplode("full_vector").alias("place", "value"))
    return cells.withColumn("value", F.round("value", 5))
