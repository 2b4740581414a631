"""What the training-data operators share: table access, stored results, lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cadenza.session import shared_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the one all executors share."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str = "stored") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and go on from the files.

    Cuts lineage where a result feeds several jobs: a lost executor costs a read.
    The folder stays as long as the shared folder does.
    """
    path = fresh_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup(df: DataFrame) -> DataFrame:
    """The small side of a join, dealt anew so that AQE may split a hot key of the other side.

    A side that is an aggregate or a window on the join key has no shuffle of its own
    right below the join, and the skew join then leaves both sides whole.
    """
    return df.hint("rebalance")


def content(name: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` does not have, whatever its columns are called."""
    taken = {name.lower() for name in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def numbered(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once, with ``row``: 0, 1, 2, ... without gaps in the order of its partitions.

    The numbers are the same in every later read. Rows are counted inside their partition; only one
    total per partition is ordered.
    """
    placed = stored(df.withColumn("_at", F.monotonically_increasing_id()), purpose)
    part = F.shiftright("_at", 33)
    totals = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return (
        placed.withColumn("_part", part).join(starts, "_part")
        .withColumn("row", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_at", "_start")
    )
