"""Text, path and clock functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The defaults a song row takes where the source has nothing.
UNKNOWN_TITLE = "Unknown Title"
UNKNOWN_ARTIST = "Unknown Artist"
UNKNOWN_ALBUM = "Unknown Album"

# Bounds of the rule-based mood tag, both exclusive.
ENERGETIC_ENERGY = 0.15
ENERGETIC_TEMPO = 110

# The first hour that is no longer morning, no longer afternoon.
NOON = 12
EVENING = 17

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def duration_text(ms: Column) -> Column:
    """``m:ss``; minutes run past 59 rather than becoming hours."""
    minutes = ((ms - ms % 60000) / 60000).cast("long")
    seconds = F.pmod(((ms - ms % 1000) / 1000).cast("long"), F.lit(60))
    return F.concat(minutes.cast("string"), F.lit(":"), F.lpad(seconds.cast("string"), 2, "0"))


def day_part(ts: Column) -> Column:
    hour = F.hour(ts)
    return F.when(hour < NOON, "morning").when(hour < EVENING, "afternoon").otherwise("evening")


def file_name(path: Column) -> Column:
    """Last segment of a path written with either kind of slash."""
    return F.element_at(F.split(path, r"[/\\]"), -1)


def base_name(path: Column) -> Column:
    """Last segment of a path written with forward slashes only."""
    return F.element_at(F.split(path, "/"), -1)


def is_wav(path: Column) -> Column:
    return F.lower(path).endswith(".wav")


def random_id() -> Column:
    return F.expr("uuid()")


def stable_id(*parts: Column) -> Column:
    """An id that a rerun of the job (or a retried task) gives again."""
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def now(as_of=None) -> Column:
    """The job's clock: ``as_of`` where given, else the start of the query."""
    return F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")


def iso_text(ts: Column) -> Column:
    """ISO-8601 local time: three fraction digits, six where they are needed."""
    return F.when(
        F.pmod(F.unix_micros(ts), F.lit(1000)) == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    ).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def parse_time(text: Column) -> Column:
    """Timestamp of ISO-like text, null for anything else; never fails."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([ T].*)?$"), F.try_to_timestamp(text))


def mood_tag(energy: Column, tempo: Column) -> Column:
    lively = (energy > ENERGETIC_ENERGY) & (tempo > ENERGETIC_TEMPO)
    return F.when(lively, "Energetic").otherwise("Calm")


def ascii_fold(text: Column) -> Column:
    """Lower-case A–Z and nothing else, so É and é stay different."""
    return F.translate(text, _UPPER, _UPPER.lower())


def ascii_lower(text: str) -> str:
    """``ascii_fold`` for a query that is known when the job is built."""
    return text.translate(str.maketrans(_UPPER, _UPPER.lower()))


def contains_pattern(query: str) -> str:
    """LIKE pattern for a substring; ``%`` and ``_`` in it act as wildcards."""
    return "%" + query.replace("\\", "\\\\") + "%"


def uniform(seed: str, *parts: Column) -> Column:
    """A number in (0, 1) fixed by the seed and the row's own key."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(seed), *parts)), 1, 8)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
