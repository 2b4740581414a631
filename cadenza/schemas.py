"""Table schemas, written out once; nothing in the package infers a schema."""

from pyspark.sql.types import (
    ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType,
    StructField, StructType, TimestampType,
)


def _table(*fields):
    return StructType([StructField(name, kind, nullable) for name, kind, nullable in fields])


VECTOR = ArrayType(DoubleType())

SONGS = _table(
    ("id", StringType(), False),
    ("title", StringType(), False),
    ("artist", StringType(), True),
    ("album", StringType(), True),
    ("file_path", StringType(), False),
    ("duration_ms", LongType(), True),
    ("genre_tag", StringType(), True),
    ("indexed_at", TimestampType(), True),
    ("created_at", TimestampType(), True),
)

BEHAVIOR_LOGS = _table(
    ("id", LongType(), False),
    ("song_id", StringType(), True),
    ("event_type", StringType(), False),
    ("skip_position_pct", DoubleType(), True),
    ("session_id", StringType(), False),
    ("timestamp", TimestampType(), False),
)

PLAYLISTS = _table(
    ("id", StringType(), False),
    ("name", StringType(), False),
    ("type", StringType(), False),
    ("created_at", TimestampType(), True),
    ("metadata", StringType(), True),
)

PLAYLIST_SONGS = _table(
    ("playlist_id", StringType(), False),
    ("song_id", StringType(), False),
    ("position", IntegerType(), True),
)

SONG_FEATURES = _table(
    ("song_id", StringType(), False),
    ("mfcc_vector", VECTOR, False),
    ("chroma_vector", VECTOR, False),
    ("contrast_vector", VECTOR, False),
    ("tempo", DoubleType(), False),
    ("energy", DoubleType(), False),
    ("zcr", DoubleType(), False),
    ("valence_proxy", DoubleType(), False),
    ("full_vector", VECTOR, False),
    ("extracted_at", TimestampType(), True),
)

# The same table as other tools exchange it: vectors as JSON array text.
SONG_FEATURES_TEXT = StructType([
    StructField(f.name, StringType() if f.dataType == VECTOR else f.dataType, f.nullable)
    for f in SONG_FEATURES.fields
])

FRAMES = _table(
    ("song_id", StringType(), False),
    ("frame_idx", LongType(), False),
    ("mfcc", VECTOR, False),
    ("chroma", VECTOR, False),
    ("contrast", VECTOR, False),
    ("rms", DoubleType(), False),
    ("zcr", DoubleType(), False),
    ("onset", DoubleType(), False),
)

PCM_CHUNKS = _table(
    ("song_id", StringType(), False),
    ("chunk_idx", LongType(), False),
    ("sr", IntegerType(), False),
    ("samples", ArrayType(FloatType()), False),
)

QUEUES = _table(
    ("queue_id", StringType(), False),
    ("position", LongType(), False),
    ("song_id", StringType(), False),
)

DAILY_PICKS = _table(
    ("listener", StringType(), False),
    ("rank", IntegerType(), False),
    ("song_id", StringType(), False),
    ("score", DoubleType(), False),
    ("pick_date", StringType(), False),
)

PREFERENCE_WEIGHTS = _table(
    ("version", LongType(), False),
    ("position", IntegerType(), False),
    ("weight", DoubleType(), False),
)
