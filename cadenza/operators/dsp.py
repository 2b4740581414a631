"""Signal to frames: spectra, mel and chroma bands, contrast, onsets, tempo.

Input is decoded PCM in chunks (``song_id, chunk_idx, sr, samples``). A song is
re-cut into overlapping stretches that are handled on their own, so its length
does not matter; the Fourier transform and the fixed linear maps run on Arrow
batches, everything else is column expressions. The bands follow the usual
textbook definitions; equality with a given audio library is not claimed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cadenza.functions.vectors import average, bind
from cadenza.operators.pieces import PIECE, lookup, running_total, span, with_halo
from cadenza.session import durable

# Fixed values of the analysis.
SAMPLE_RATE = 22050
FRAME = 2048
HOP = 512
MELS = 128
MFCCS = 20
CHROMAS = 12
CONTRAST_BANDS = 6
CONTRAST_LOWEST = 200.0
CONTRAST_SHARE = 0.02
RANGE_DB = 80.0
QUIET = 1e-10
SLOWEST_BPM, LIKELY_BPM, FASTEST_BPM = 30.0, 120.0, 320.0

HOPS_PER_STRETCH = 256


def stretches(pcm: DataFrame, step: int, width: int, lead: int) -> DataFrame:
    """Re-cut signals: stretch i of a song covers ``width`` samples from i*step - lead.

    Samples before the start and after the end of a song are zero. Returns
    ``song_id, idx, total, samples``; only parts of chunks are shuffled.
    """
    sized = pcm.select("song_id", "chunk_idx", "samples", F.size("samples").cast("long").alias("_n"))
    placed = running_total(
        sized, ["song_id"], ["chunk_idx"], [span(F.col("chunk_idx"), 4096)], F.col("_n"), "_end"
    ).withColumn("_start", F.col("_end") - F.col("_n"))
    totals = pcm.groupBy("song_id").agg(F.sum(F.size("samples")).cast("long").alias("total"))
    placed = placed.filter("_n > 0").join(lookup(totals), "song_id")

    first = F.greatest(F.floor((F.col("_start") + lead - width) / F.lit(step)) + 1, F.lit(0))
    last = F.least(
        F.floor((F.col("_end") + lead - 1) / F.lit(step)), F.floor(F.col("total") / F.lit(step))
    )
    begins = F.col("idx") * step - lead
    head = F.greatest(begins - F.col("_start"), F.lit(0))
    length = F.least(begins + width, F.col("_end")) - F.col("_start") - head
    parts = (
        placed.filter(first <= last).withColumn("idx", F.explode(F.sequence(first, last)))
        .select(
            "song_id", "idx", "total", (F.col("_start") + head - begins).alias("at"),
            F.slice("samples", (head + 1).cast("int"), length.cast("int")).alias("part"),
        )
    )
    whole = parts.groupBy("song_id", "idx", "total").agg(
        F.array_sort(F.collect_list(F.struct("at", "part"))).alias("_parts")
    )
    silence = lambda count: F.array_repeat(F.lit(0.0).cast("float"), count.cast("int"))
    joined = F.flatten("_parts.part")
    before = F.element_at("_parts", 1)["at"]
    return whole.select(
        "song_id", "idx", "total",
        F.concat(silence(before), joined, silence(F.lit(width) - before - F.size(joined))).alias("samples"),
    )


def frames_of(pcm: DataFrame, frame: int = FRAME, hop: int = HOP) -> DataFrame:
    """Frames centred on every ``hop``-th sample: ``song_id, frame_idx, samples, before, inside``.

    ``before`` zeros precede the song's own samples in the frame, of which it has ``inside``.
    """
    long = hop * HOPS_PER_STRETCH
    cut = stretches(pcm, long, long + frame, frame // 2)
    hops = F.sequence(F.lit(0), F.lit(HOPS_PER_STRETCH - 1))
    number = F.col("idx") * HOPS_PER_STRETCH + F.col("_hop")
    begins = number * hop - frame // 2
    before = F.greatest(-begins, F.lit(0))
    return (
        cut.withColumn("_hop", F.explode(hops)).filter(number <= F.floor(F.col("total") / F.lit(hop)))
        .select("song_id", number.alias("frame_idx"),
                F.slice("samples", F.col("_hop") * hop + 1, frame).alias("samples"),
                before.cast("int").alias("before"),
                (F.least(F.col("total") - begins, F.lit(frame)) - before).cast("int").alias("inside"))
    )


def rms(samples: Column) -> Column:
    squares = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return F.sqrt(squares / F.size(samples))


def zero_crossing_rate(samples: Column, before: Column | None = None, inside: Column | None = None) -> Column:
    """Share of samples whose sign differs from the one before them.

    With ``before`` and ``inside`` only the song's own samples can differ: a song counts as going on with
    its first and last sample beyond its edges. Samples within ``QUIET`` of zero are not negative.
    """
    own = samples if before is None else F.slice(samples, before + 1, inside)
    n = F.size(own)
    flips = F.zip_with(
        F.slice(own, 1, n - 1), F.slice(own, 2, n - 1),
        lambda a, b: ((a < -QUIET) != (b < -QUIET)).cast("int"),
    )
    return F.when(n > 1, F.aggregate(flips, F.lit(0), lambda s, x: s + x) / F.size(samples)).otherwise(F.lit(0.0))


def power_spectrum(samples: Column, frame: int = FRAME) -> Column:
    """Power per frequency bin of Hann-windowed frames, one transform per batch."""
    window = np.hanning(frame + 1)[:-1]

    @F.pandas_udf("array<double>")
    def transform(batch: pd.Series) -> pd.Series:
        spectra = []
        for start in range(0, len(batch), 256):
            block = np.stack(batch.iloc[start:start + 256].to_numpy()) * window
            spectra.extend(np.abs(np.fft.rfft(block, axis=1)) ** 2)
        return pd.Series(spectra, index=batch.index)

    return transform(samples)


def basis_project(values: Column, basis: np.ndarray) -> Column:
    """Product of each array with a fixed matrix (one row per output)."""
    weights = np.ascontiguousarray(basis.T, dtype=float)

    @F.pandas_udf("array<double>")
    def project(batch: pd.Series) -> pd.Series:
        if not len(batch):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.stack(batch.to_numpy()).astype(float) @ weights), index=batch.index)

    return project(values)


def bin_frequencies(sr: int = SAMPLE_RATE, frame: int = FRAME) -> np.ndarray:
    return np.arange(frame // 2 + 1) * sr / frame


def mel_basis(sr: int = SAMPLE_RATE, frame: int = FRAME, bands: int = MELS) -> np.ndarray:
    """Triangles evenly spaced in mel (linear to 1 kHz, logarithmic above), equal area."""
    knee, per_mel, ratio = 1000.0, 200.0 / 3, math.log(6.4) / 27.0
    knee_mel = knee / per_mel

    def to_mel(hz):
        return hz / per_mel if hz < knee else knee_mel + math.log(hz / knee) / ratio

    mels = np.linspace(0.0, to_mel(sr / 2), bands + 2)
    above = knee * np.exp(ratio * (np.maximum(mels, knee_mel) - knee_mel))
    edges = np.where(mels < knee_mel, mels * per_mel, above)
    left, peak, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    hz = bin_frequencies(sr, frame)[None, :]
    rise, fall = (hz - left) / (peak - left), (right - hz) / (right - peak)
    return np.maximum(0.0, np.minimum(rise, fall)) * 2.0 / (right - left)


def cosine_basis(size: int, outputs: int) -> np.ndarray:
    """Orthonormal discrete cosine transform, second kind, first ``outputs`` rows."""
    k, i = np.arange(outputs)[:, None], np.arange(size)[None, :]
    rows = np.cos(np.pi * k * (2 * i + 1) / (2 * size)) * math.sqrt(2.0 / size)
    rows[0] /= math.sqrt(2.0)
    return rows


def chroma_basis(sr: int = SAMPLE_RATE, frame: int = FRAME, classes: int = CHROMAS) -> np.ndarray:
    """Weight of each bin in each pitch class (C first): a bell one class wide."""
    hz = bin_frequencies(sr, frame)
    pitch = np.zeros_like(hz)
    pitch[1:] = classes * np.log2(hz[1:] / 440.0) + 9 * classes / 12
    away = (pitch[None, :] - np.arange(classes)[:, None] + classes / 2) % classes - classes / 2
    weights = np.exp(-0.5 * (2.0 * away) ** 2)
    weights[:, 0] = 0.0
    return weights


def decibels(values: Column) -> Column:
    return F.transform(values, lambda x: 10 * F.log10(F.greatest(x, F.lit(1e-10))))


def normalise_to_peak(values: Column) -> Column:
    """Each array divided by its largest entry; silence stays silence."""
    return bind(
        F.array_max(values), lambda peak: F.transform(values, lambda x: F.when(peak > 0, x / peak).otherwise(x))
    )


def contrast_edges(
    sr: int = SAMPLE_RATE, frame: int = FRAME, bands: int = CONTRAST_BANDS, lowest: float = CONTRAST_LOWEST
) -> list[tuple[int, int]]:
    """First and last bin (from 0, inclusive) of the lowest band and each octave above."""
    top = frame // 2
    hz = [0.0] + [lowest * 2 ** i for i in range(bands + 1)]
    bins = [min(top, round(f * frame / sr)) for f in hz]
    bins[-1] = top
    return [(low, max(low, high if i == bands else high - 1)) for i, (low, high) in enumerate(zip(bins, bins[1:]))]


def contrast_levels(power: Column, edges: list[tuple[int, int]], share: float = CONTRAST_SHARE) -> Column:
    """Struct of two arrays: per band the level in dB of its strongest and of its weakest ``share`` of bins."""
    loud, quiet = [], []
    for low, high in edges:
        width = high - low + 1
        edge = max(1, round(share * width))
        ordered = F.array_sort(F.transform(F.slice(power, low + 1, width), F.sqrt))
        loud.append(average(F.slice(ordered, width - edge + 1, edge)))
        quiet.append(average(F.slice(ordered, 1, edge)))
    return F.struct(decibels(F.array(*loud)).alias("loud"), decibels(F.array(*quiet)).alias("quiet"))


def within_range(levels: Column, peak: Column) -> Column:
    """Levels in dB, none more than ``RANGE_DB`` below the song's ``peak``."""
    return F.transform(levels, lambda x: F.greatest(x, peak - RANGE_DB))


def song_peaks(frames: DataFrame, *columns: str) -> DataFrame:
    """``frames`` with the largest entry that each array column has in the whole song, as ``<column>_peak``."""
    peaks = frames.groupBy("song_id").agg(*[F.max(F.array_max(c)).alias(f"{c}_peak") for c in columns])
    return frames.join(lookup(peaks), "song_id")


def spectral_contrast(levels: DataFrame) -> DataFrame:
    """``levels`` (frames with ``loud`` and ``quiet``) with ``contrast``, their distance per band in dB.

    Either level ends ``RANGE_DB`` below its highest in the song.
    """
    return song_peaks(levels, "loud", "quiet").withColumn("contrast", F.zip_with(
        within_range(F.col("loud"), F.col("loud_peak")), within_range(F.col("quiet"), F.col("quiet_peak")),
        lambda a, b: a - b,
    )).drop("loud", "quiet", "loud_peak", "quiet_peak")


def mel_bands(power: Column, sr: int = SAMPLE_RATE, frame: int = FRAME, bands: int = MELS) -> Column:
    """Power spectra as power in mel bands."""
    return basis_project(power, mel_basis(sr, frame, bands))


def cepstrum(frames: DataFrame, bands: int = MELS, outputs: int = MFCCS) -> DataFrame:
    """``frames`` with ``mfcc``, made of their ``bands``, which are cut to the song's range first."""
    limited = song_peaks(frames, "bands").withColumn("bands", within_range(F.col("bands"), F.col("bands_peak")))
    return limited.drop("bands_peak").withColumn("mfcc", basis_project(F.col("bands"), cosine_basis(bands, outputs)))


def onset_strength(bands: DataFrame, frames_per_piece: int = 4096) -> DataFrame:
    """``song_id, frame_idx, onset``: mean rise of the ``bands`` since the frame before."""
    cut = with_halo(bands.select("song_id", "frame_idx", "bands"), F.col("frame_idx"), 1, frames_per_piece)
    inside = Window.partitionBy("song_id", PIECE).orderBy("frame_idx")
    before = F.lag("bands").over(inside)
    rises = F.zip_with("bands", before, lambda now, then: F.greatest(now - then, F.lit(0.0)))
    return (
        cut.withColumn("onset", F.coalesce(average(rises), F.lit(0.0))).filter(~F.col("_halo"))
        .select("song_id", "frame_idx", "onset")
    )


def lag_scores(envelope: DataFrame, shortest: int, longest: int, frames_per_piece: int = 4096) -> DataFrame:
    """Autocorrelation of each song's onset ``envelope`` at every lag in the range.

    Every piece holds its frames and, as context, the ``longest`` before them.
    """
    cut = with_halo(envelope, F.col("frame_idx"), longest, max(frames_per_piece, longest))
    pieces = cut.groupBy("song_id", PIECE).agg(
        F.array_sort(F.collect_list(F.struct("frame_idx", "onset", "_halo"))).alias("_cells")
    )
    values = F.col("_cells.onset")
    shifts = F.sequence(F.lit(shortest), F.lit(longest))
    context = F.size(F.filter("_cells", lambda c: c["_halo"]))
    counted = pieces.select("song_id", values.alias("_x"), context.alias("_context"), F.explode(shifts).alias("lag"))
    # Pairs belong to the piece of their later frame.
    start = F.greatest(F.col("_context"), F.col("lag"))
    length = F.size("_x") - start
    products = F.zip_with(
        F.slice("_x", start + 1, F.greatest(length, F.lit(0))),
        F.slice("_x", start - F.col("lag") + 1, F.greatest(length, F.lit(0))), lambda a, b: a * b,
    )
    return (
        counted.filter(length > 0)
        .withColumn("_part", F.aggregate(products, F.lit(0.0), lambda s, x: s + x))
        .groupBy("song_id", "lag").agg(F.sum("_part").alias("score"))
    )


def tempo(envelope: DataFrame, sr: int = SAMPLE_RATE, hop: int = HOP) -> DataFrame:
    """``song_id, tempo``: the beat rate whose lag repeats best, near 120 preferred.

    An estimate from autocorrelation; silence gives 0.
    """
    rate = 60.0 * sr / hop
    shortest, longest = math.ceil(rate / FASTEST_BPM), math.floor(rate / SLOWEST_BPM)
    bpm = F.lit(rate) / F.col("lag")
    octaves = F.log2(bpm / F.lit(LIKELY_BPM))
    weighted = F.round(F.col("score") * F.exp(-0.5 * octaves * octaves), 9)
    found = (
        lag_scores(envelope, shortest, longest).withColumn("_weighted", weighted).groupBy("song_id")
        .agg(F.max(F.struct("_weighted", (-F.col("lag")).alias("_back"))).alias("_best"))
        .select("song_id", F.when(F.col("_best._weighted") > 0, F.lit(rate) / -F.col("_best._back"))
                .otherwise(F.lit(0.0)).alias("tempo"))
    )
    # Songs shorter than the shortest lag have no pair of frames at all.
    return envelope.select("song_id").distinct().join(found, "song_id", "left").withColumn(
        "tempo", F.coalesce("tempo", F.lit(0.0))
    )


def analyse(pcm: DataFrame, sr: int = SAMPLE_RATE, frame: int = FRAME, hop: int = HOP) -> tuple[DataFrame, DataFrame]:
    """The frame table of decoded songs and their tempo, inputs of ``song_features``."""
    raw = frames_of(pcm, frame, hop).withColumn("_power", power_spectrum(F.col("samples"), frame))
    raw = raw.withColumn("_mel", mel_bands(F.col("_power"), sr, frame)).withColumn(
        "_pitch", basis_project(F.col("_power"), chroma_basis(sr, frame)))
    levels = contrast_levels(F.col("_power"), contrast_edges(sr, frame))
    bands = durable(raw.withColumn("_levels", levels).select(
        "song_id", "frame_idx",
        rms(F.col("samples")).alias("rms"),
        zero_crossing_rate(F.col("samples"), F.col("before"), F.col("inside")).alias("zcr"),
        decibels(F.col("_mel")).alias("bands"),
        normalise_to_peak(F.col("_pitch")).alias("chroma"),
        "_levels.loud", "_levels.quiet",
    ))
    limited = durable(cepstrum(spectral_contrast(bands)))
    onsets = durable(onset_strength(limited))
    frames = limited.drop("bands").join(onsets, ["song_id", "frame_idx"])
    return frames, tempo(onsets, sr, hop)
