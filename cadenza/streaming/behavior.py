"""Behaviour events as streams: ingest, sessions, mood shifts, learning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cadenza import schemas
from cadenza.operators.behavior import SHIFT_SECONDS, SHIFT_SKIPS, TARGET_SONGS, from_logs
from cadenza.operators.learner import MODELS, RATE, step_listeners, update
from cadenza.operators.pieces import lookup
from cadenza.operators.ranking import rerank_for_mood
from cadenza.session import durable

SYNC_INTERVAL = "30 seconds"  # fixed value: how often clients send their events
LATENESS = "10 minutes"


def read_events(spark: SparkSession, folder: str, schema=schemas.BEHAVIOR_LOGS, **options) -> DataFrame:
    """Event files as they arrive, with ``listener`` and ``ts``; ``options`` go to the file source."""
    reader = spark.readStream.schema(schema).format("parquet")
    for name, value in options.items():
        reader = reader.option(name, value)
    return from_logs(reader.load(folder))


def ingest(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Events on the watermark, each key once however often it was sent."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.dropDuplicatesWithinWatermark(["listener", "song_id", "event_type", "ts"])


def start_append(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False):
    """Append a stream to a table, every sync interval or once over what is there."""
    trigger = {"availableNow": True} if available_now else {"processingTime": SYNC_INTERVAL}
    return (
        stream.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()
    )


def sessions(events: DataFrame, gap: str, lateness: str = LATENESS) -> DataFrame:
    """Closed listening sessions split at gaps longer than ``gap``.

    ``events`` carry ``genre`` and ``energy``, null for songs without features; a session is
    emitted once the watermark is past its end. Its state is a count per genre besides sums and
    bounds, and merges with that of another session when an event falls between the two.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return (
        timed.groupBy("listener", F.session_window("ts", gap).alias("_session"))
        .agg(F.mode("genre", deterministic=True).alias("dominant_genre"),
             F.count(F.lit(1)).alias("events"), F.avg("energy").alias("avg_energy"),
             F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))
        .drop("_session")
    )


def mood_shifts(
    events: DataFrame, skips: int = SHIFT_SKIPS, seconds: float = SHIFT_SECONDS, lateness: str = LATENESS
) -> DataFrame:
    """Mood shifts as they happen: ``listener, id, ts`` of the skip that completes a run.

    State per listener: the events younger than the watermark, still to be put in
    order, and the times of the open run of skips. A shift uses up its run.
    """
    return mood_reactions(events.withColumn("energy", F.lit(None).cast("double")), skips, seconds, 0, lateness).select("listener", "id", "ts")


def mood_reactions(
    events: DataFrame, skips: int = SHIFT_SKIPS, seconds: float = SHIFT_SECONDS, last: int = TARGET_SONGS, lateness: str = LATENESS
) -> DataFrame:
    """Mood shifts with what to do about them: ``listener, id, ts, target_energy, songs``.

    ``events`` carry ``energy``, null for songs without features. The target is the mean energy of the
    ``last`` songs that were not skipped before the shift, of which there are ``songs``; null if none of
    them has features. Besides what ``mood_shifts`` keeps, the state holds the energies of these songs.
    Whatever its size, a listener's part of a batch is handled as arrays.
    """
    timed = (
        events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
        .select("listener", "id", "ts", (F.col("event_type") == "skip").alias("is_skip"), F.col("energy").cast("double").alias("energy"))
    )
    reach, kinds = int(seconds * 1_000_000), (np.int64, np.int64, np.bool_, np.float64, np.int64, np.float64)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else [b""] * len(kinds)
        *waiting, run, ring = (np.frombuffer(part, kind) for part, kind in zip(held, kinds))
        parts = [waiting]
        for pdf in batches:
            micros = pdf.ts.astype("datetime64[us]").astype("int64")
            parts.append([micros.to_numpy(), pdf.id.to_numpy(np.int64), pdf.is_skip.to_numpy(bool), pdf.energy.to_numpy(float)])
        times, ids, skipped, energies = (np.concatenate(column) for column in zip(*parts))
        order = np.lexsort((ids, times))
        times, ids, skipped, energies = times[order], ids[order], skipped[order], energies[order]
        ready = int(np.searchsorted(times, state.getCurrentWatermarkMs() * 1000, "right"))
        found, run = run_ends(np.concatenate([run, times[:ready]]), np.concatenate([np.ones(len(run), bool), skipped[:ready]]), skips, reach, len(run))
        heard = np.flatnonzero(~skipped[:ready])
        known = np.concatenate([ring, energies[heard]])
        ring = known[max(0, len(known) - last):]
        rows = []
        for at in found.tolist():  # one step for each shift
            upto = len(known) - len(heard) + int(np.searchsorted(heard, at))
            songs = known[max(0, upto - last):upto]
            there = songs[~np.isnan(songs)]
            rows.append((key[0], ids[at], pd.Timestamp(times[at], unit="us"), there.mean() if len(there) else None, len(songs)))
        left = [column[ready:] for column in (times, ids, skipped, energies)]
        if len(left[0]):
            state.setTimeoutTimestamp(max(int(left[0][0]) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if len(left[0]) or len(run) or len(ring):
            state.update(tuple(np.ascontiguousarray(part, kind).tobytes() for part, kind in zip([*left, run, ring], kinds)))
        elif state.exists:
            state.remove()
        if rows:
            yield pd.DataFrame(rows, columns=["listener", "id", "ts", "target_energy", "songs"])

    return timed.groupBy("listener").applyInPandasWithState(
        follow, "listener string, id bigint, ts timestamp, target_energy double, songs bigint",
        "times binary, ids binary, skips binary, energies binary, run binary, ring binary",
        "append", GroupStateTimeout.EventTimeTimeout,
    )


def run_ends(times: np.ndarray, skipped: np.ndarray, skips: int, reach: int, before: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places at which ``skips`` skips in a row took at most ``reach``, each using up its skips, and the open run's times.

    The first ``before`` events are those of a run that was open already; places are counted from behind them.
    """
    at = np.arange(len(times))
    length = at - np.maximum.accumulate(np.where(skipped, -1, at)) if len(at) else at
    length[:] = np.where(skipped, length, 0)
    full = np.flatnonzero(length >= skips)
    hits = full[times[full] - times[full - skips + 1] <= reach]
    # Neighbouring hits are one stretch, in which every ``skips``-th counts; stretches follow each other.
    cuts = np.flatnonzero(np.diff(hits) != 1) + 1
    found, free = [np.empty(0, np.int64)], 0
    for first, last in zip(hits[np.r_[0, cuts]].tolist() if len(hits) else [], hits[np.r_[cuts, len(hits)] - 1].tolist() if len(hits) else []):
        taken = np.arange(max(first, free), last + 1, skips)
        if len(taken):
            found.append(taken)
            free = int(taken[-1]) + skips
    ends = np.concatenate(found)
    open_ = min(int(length[-1]) if len(at) else 0, len(at) - 1 - int(ends[-1]) if len(ends) else len(at), skips - 1)
    return ends - before, times[len(times) - open_:]


def start_reranking(reactions: DataFrame, queues: DataFrame, energies: DataFrame, path: str, checkpoint: str, available_now: bool = False):
    """Rewrite the queue of every listener whose mood shifts, once per micro-batch.

    ``queues`` are ``listener, song_id, score``. A batch writes whole queues of the listeners it concerns,
    by their last target, under its own number; run again, it replaces them.
    """

    def react(batch: DataFrame, batch_id: int) -> None:
        # Every use of a batch would follow all its events again; what is kept of it is a row per listener.
        targets = durable(batch.groupBy("listener").agg(F.max_by("target_energy", F.struct("ts", "id")).alias("target_energy")))
        mine = queues.join(lookup(targets.select("listener")), "listener", "left_semi")
        rerank_for_mood(mine, targets, energies).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    trigger = {"availableNow": True} if available_now else {"processingTime": SYNC_INTERVAL}
    return reactions.writeStream.foreachBatch(react).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def current_queues(queues: DataFrame, energies: DataFrame, path: str) -> DataFrame:
    """Queues as they stand: by the last batch that rewrote them, else in their own order."""
    nobody = queues.select("listener", F.lit(None).cast("double").alias("target_energy")).limit(0)
    plain = rerank_for_mood(queues, nobody, energies)
    try:
        written = queues.sparkSession.read.schema(f"{_ddl(plain)}, batch bigint").parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return plain
    last = written.groupBy("listener").agg(F.max("batch").alias("batch"))
    newest = written.join(lookup(last), ["listener", "batch"], "left_semi").select(*plain.columns)
    untouched = queues.join(lookup(last), "listener", "left_anti")
    return rerank_for_mood(untouched, nobody, energies).select(*plain.columns).unionByName(newest)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def start_learning(rows: DataFrame, path: str, checkpoint: str, width: int, rate: float = RATE, available_now: bool = False):
    """Update the preference model once per micro-batch of training rows.

    Every batch writes its own version of the weights, named by the batch, so a
    batch that is run again after a failure replaces its own result and starts
    from the version before it.
    """

    def learn(batch: DataFrame, batch_id: int) -> None:
        stepped = update(batch, read_weights(batch.sparkSession, path, width, batch_id - 1), rate)
        cells = [(batch_id, i, w) for i, w in enumerate(stepped)]
        frame = batch.sparkSession.createDataFrame(cells, schemas.PREFERENCE_WEIGHTS)
        frame.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch-{batch_id}")

    trigger = {"availableNow": True} if available_now else {"processingTime": SYNC_INTERVAL}
    return (
        rows.writeStream.foreachBatch(learn).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def read_weights(spark: SparkSession, path: str, width: int, version: int) -> list[float]:
    """Weights of one version; zeros before the first."""
    weights = [0.0] * width
    if version >= 0:
        for row in spark.read.schema(schemas.PREFERENCE_WEIGHTS).parquet(f"{path}/batch-{version}").collect():
            weights[row.position] = row.weight
    return weights


def start_learning_each(rows: DataFrame, path: str, checkpoint: str, rate: float = RATE, available_now: bool = False, **trigger):
    """Update one preference model per listener, once per micro-batch of ``listener, label, x``.

    A batch appends the models it has changed under its own number and starts from those of the batches
    before, so one that is run again after a failure replaces its own result and comes out the same.
    """

    def learn(batch: DataFrame, batch_id: int) -> None:
        before = read_models(batch.sparkSession, path).filter(F.col("version") < batch_id)
        step_listeners(batch, before, batch_id, rate).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    trigger = trigger or ({"availableNow": True} if available_now else {"processingTime": SYNC_INTERVAL})
    return rows.writeStream.foreachBatch(learn).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """All versions of all models; none before the first batch."""
    try:
        return spark.read.schema(f"{MODELS}, batch bigint").parquet(path).drop("batch")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MODELS)
