"""M3U playlists: a folder of files to ordered path entries, in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# What counts as white space around a line, the byte order mark included.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
_ABSOLUTE = r"^(/|[a-zA-Z]:\\|content://)"

_C1 = "".join(chr(code) for code in range(0x80, 0xA0))
_WESTERN = "".join(bytes([ord(c)]).decode("cp1252", errors="ignore") or c for c in _C1)


def read_m3u(spark: SparkSession, folder: str) -> DataFrame:
    """``playlist_path, content`` of every playlist file; a missing folder fails."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{m3u,m3u8,M3U,M3U8}").load(folder)
    )
    return files.select(F.regexp_replace("path", r"^file:/+", "/").alias("playlist_path"), "content")


def decode_text(content: Column) -> Column:
    """Bytes as UTF-8 where they are valid, else as Windows-1252."""
    text = content.cast("string")
    western = F.translate(F.decode(content, "ISO-8859-1"), _C1, _WESTERN)
    return F.when(F.is_valid_utf8(text), text).otherwise(western)


def trim_line(line: Column) -> Column:
    return F.trim(line, F.lit(WHITE_SPACE))


def parent_folder(path: Column) -> Column:
    """Folder of a path: ``/`` for files in the root, ``.`` for bare names."""
    return (
        F.when(~path.contains("/"), ".").when(path.rlike("^/[^/]*$"), "/")
        .otherwise(F.regexp_replace(path, "/+[^/]*$", ""))
    )


def parse_m3u(texts: DataFrame, separator: str = "/") -> DataFrame:
    """``playlist_path, line_no, path`` from ``playlist_path, text``.

    Blank and ``#`` lines are skipped, absolute paths kept, all others put behind
    the playlist's folder as they are. ``line_no`` counts all lines, from 0.
    """
    lines = texts.select("playlist_path", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line_no", "_raw"))
    line = F.col("_line")
    kept = lines.select("playlist_path", "line_no", trim_line(F.col("_raw")).alias("_line")).filter(
        (line != "") & ~line.startswith("#")
    )
    resolved = F.concat(parent_folder(F.col("playlist_path")), F.lit(separator), line)
    return kept.select(
        "playlist_path", "line_no", F.when(line.rlike(_ABSOLUTE), line).otherwise(resolved).alias("path")
    )


def read_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of all playlist files of a folder."""
    return parse_m3u(read_m3u(spark, folder).select("playlist_path", decode_text(F.col("content")).alias("text")))
