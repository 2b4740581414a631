"""The indexing job as a stream of requests that keeps its own log.

Requested paths arrive as files; every micro-batch is one step of the job. The step writes what it has
started, works, and writes its songs, features and outcomes, all in folders named by the batch. A step
that fails is run again under its number by the next start and replaces whatever it had written, so a
restart neither loses nor repeats an attempt. Status and progress read the same log at any moment.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from cadenza.operators.indexing import IndexRun
from cadenza.operators.pieces import lookup
from cadenza.session import durable
from cadenza.streaming.behavior import SYNC_INTERVAL

REQUESTS = "seq bigint, file_path string"
STARTED = "batch bigint, seq bigint, file_path string, started_at timestamp"
FINISHED = "batch bigint, seq bigint, status string, error string, finished_at timestamp"


class JobStore:
    """Folders of one job: its log, and the songs and features its steps have made."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, name: str, batch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/step={batch}")

    def read(self, name: str, schema) -> DataFrame:
        """What all steps have written so far, with the ``step`` of each row."""
        ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        try:
            return self.spark.read.schema(f"{ddl}, step bigint").parquet(f"{self.path}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{ddl}, step bigint")

    def log(self) -> DataFrame:
        """One row per attempt: ``batch, seq, file_path, started_at, finished_at, status, error``."""
        ended = self.read("finished", FINISHED).drop("step")
        return self.read("started", STARTED).drop("step").join(ended, ["batch", "seq"], "left")


def start_indexing(
    requests: DataFrame, listing: DataFrame, songs: DataFrame, features: DataFrame, store: JobStore, checkpoint: str,
    index: Callable[..., IndexRun], clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
    available_now: bool = False,
):
    """Run ``index`` (``index_files`` or ``index_audio`` with their sources bound) on every batch of requests.

    ``index`` is called with (requested, listing, songs, features, as_of); songs and features are those
    given here and all that earlier steps have added. Later steps see the newest row of an id.
    """
    def newest(name: str, given: DataFrame, key: str, step: int) -> DataFrame:
        """The given rows and those of the steps before ``step``; of one key, those of the last step."""
        written = store.read(name, given.schema).filter(F.col("step") < step)
        last = written.groupBy(key).agg(F.max_by(F.struct(*given.columns), "step").alias("_row")).select("_row.*")
        stale = given.join(lookup(last.select(key)), key, "left_anti")
        return stale.select(*given.columns).unionByName(last)

    def step(batch: DataFrame, number: int) -> None:
        begun = F.lit(clock()).cast("timestamp")
        store.write("started", number, batch.select(F.lit(number).cast("bigint").alias("batch"), "seq", "file_path", begun.alias("started_at")))
        requested = store.read("started", STARTED).filter(F.col("step") == number).select("seq", "file_path")
        run = index(
            requested, listing, newest("songs", songs, "id", number),
            newest("features", features, "song_id", number), clock(),
        )
        # Outcomes are a row per request; what songs and features need of them is a row per song.
        touched = durable(run.outcomes.filter(F.col("song_id").isNotNull()).groupBy("song_id").agg(F.max("features_extracted").alias("_extracted")))
        store.write("songs", number, run.songs.join(touched.select(F.col("song_id").alias("id")), "id", "left_semi").select(*_as(songs)))
        extracted = touched.filter("_extracted").select("song_id")
        store.write("features", number, run.features.join(extracted, "song_id", "left_semi").select(*_as(features)))
        store.write("finished", number, run.outcomes.select(
            F.lit(number).cast("bigint").alias("batch"), "seq", "status", "error", F.lit(clock()).cast("timestamp").alias("finished_at")))

    trigger = {"availableNow": True} if available_now else {"processingTime": SYNC_INTERVAL}
    return requests.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _as(given: DataFrame) -> list:
    """All columns in the types of ``given``, as later steps read them."""
    return [F.col(f.name).cast(f.dataType) for f in given.schema]
