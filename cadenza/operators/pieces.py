"""Ordered work over groups of any size.

A window over ``partitionBy(key)`` puts each key in one task. A listener, queue
or playlist that holds a third of the table would then hold one task for hours.
The functions here cut every group into pieces along its own order (a span of
positions, of time, of hash values), do the ordered work piece by piece, and
carry what crosses a border: a total per piece, or copies of the rows near it.
Rows with null keys or a null order form groups and pieces of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PIECE = "_piece"
_BY = "_by"


def lookup(df: DataFrame) -> DataFrame:
    """A join side that is an aggregate or window on the join key, dealt anew.

    AQE splits a hot key only where a shuffle lies right below either side of the join.
    """
    return df.hint("rebalance")


def span(position: Column, width: int) -> Column:
    """Piece of a whole-number position: ``width`` positions each."""
    return F.floor(position / F.lit(width))


def time_span(ts: Column, seconds: float) -> Column:
    """Piece of a timestamp: ``seconds`` each."""
    return F.floor(F.unix_micros(ts) / F.lit(int(seconds * 1_000_000)))


def hash_span(value: Column, digits: int = 2) -> Column:
    """Piece of a value ordered by its md5: one per leading hex digits."""
    return F.substring(F.md5(value), 1, digits)


def running_total(
    df: DataFrame, keys: list[str], order: list, pieces: list[Column], value: Column, name: str
) -> DataFrame:
    """Sum of ``value`` from the start of each group up to and with each row.

    ``pieces`` cut the groups from coarse to fine and follow ``order``: sorting by
    ``order`` also sorts by them. Sums of pieces are totalled the same way, one
    level up, so what one task sorts is one finest piece or the pieces of a coarser.
    """
    names = [f"{PIECE}{level}" for level in range(len(pieces))]
    return _total(df, keys, order, dict(zip(names, pieces)), value, name).drop(*names)


def _total(df, keys, order, pieces, value, name):
    cut = df.withColumns(pieces) if pieces else df
    by = [*keys, *pieces]
    # Structs are equal where their nulls are in the same places, so one shuffle serves window and join.
    group = F.struct(*by) if by else F.lit(0)
    cut = cut.withColumn(_BY, group)
    inside = (
        Window.partitionBy(_BY).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    if not pieces:
        return cut.withColumn(name, F.sum(value).over(inside)).drop(_BY)
    *coarser, finest = pieces
    sums = cut.groupBy(*by).agg(F.sum(value).alias("_sum"))
    upto = _total(sums, keys, [finest], {p: F.col(p) for p in coarser}, F.col("_sum"), "_upto")
    starts = upto.select(group.alias(_BY), (F.col("_upto") - F.col("_sum")).alias("_start"))
    return (
        cut.withColumn("_inside", F.sum(value).over(inside)).join(starts, _BY)
        .withColumn(name, F.col("_start") + F.col("_inside")).drop("_start", "_inside", _BY)
    )


def number_rows(df: DataFrame, keys: list[str], order: list, pieces: list[Column], name: str) -> DataFrame:
    """Positions 0, 1, 2, … of each group's rows, without gaps."""
    counted = running_total(df, keys, order, pieces, F.lit(1), name)
    return counted.withColumn(name, F.col(name) - 1)


def with_halo(df: DataFrame, at: Column, reach: float, width: float) -> DataFrame:
    """Cut along ``at`` into pieces of ``width`` and copy the rows at each end.

    A row within ``reach`` of the end of its piece is copied into the next piece
    with ``_halo`` true, so a look back of at most ``reach`` never leaves the
    piece. ``at`` is whole numbers (micros, frame numbers); ``reach <= width``.
    """
    if reach > width:
        raise ValueError("pieces must be at least as wide as the look back")
    home = F.floor(at / F.lit(width))
    spills = at >= (home + 1) * F.lit(width) - F.lit(reach)
    places = F.when(spills, F.array(home, home + 1)).otherwise(F.array(home))
    return (
        df.withColumn("_home", home).withColumn(PIECE, F.explode(places))
        .withColumn("_halo", F.col(PIECE) != F.col("_home")).drop("_home")
    )


def top_rows(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group, ranked from 1.

    The bare ``row_number() <= n`` lets Spark cut every input partition to ``n``
    rows per group before the shuffle, so the size of a group does not matter.
    """
    place = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(place)).filter(F.col(rank) <= n)


def score_pieces(score: Column, key: Column, lowest: float, highest: float) -> list[Column]:
    """Pieces for ``score_order``: score ranges, single scores, hashes of the key."""
    share = (F.lit(highest) - score) / F.lit(highest - lowest)
    return [F.floor(share * 4096), -score, hash_span(key)]


def score_order(score: Column, key: Column) -> list[Column]:
    """Best first; equal scores in hash order, so a score many rows share can be cut."""
    return [-score, F.md5(key), key]
