"""Approximate nearest songs: a stored index of random hyperplanes, probed several buckets wide, reranked exactly.

Each of ``tables`` hash tables cuts the space with ``bits`` planes; a song's bucket is the side it lies on
of each. A query looks into every bucket that differs from its own in at most ``radius`` planes, in every
table, and the songs found there are ranked by their exact similarity. There is one way of searching,
whatever the size; ``bits`` is a setting of the index that should grow with the logarithm of the library.

Equal vectors are indexed once, so a bucket never holds copies. The planes follow from a rule, so an index
can be extended by rows that are hashed later and elsewhere.

A search deals queries into chunks and songs into walks. A task takes a block of a walk at a time, sorts it
into the buckets of each table, lets every bucket meet the queries of its chunk that probe it, and carries
the best n of each query along. So neither the probes of a query nor the songs it finds become rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cadenza.functions.vectors import unit, vector_key
from cadenza.operators import similarity
from cadenza.operators.similarity import SIMILAR, _HITS, _best, _Best, deal, expand, floats, parts
from cadenza.session import durable

BLOCK_ROWS = 1 << 16  # songs that a task sorts into buckets at once


class Planes(NamedTuple):
    tables: int = 14
    bits: int = 10

    def weights(self, width: int) -> np.ndarray:
        """One row per plane: entry i of all is the fraction of i * i times the golden ratio, less a half."""
        i = np.arange(1, self.tables * self.bits * width + 1, dtype=np.uint64)
        part = (i * i * np.uint64(2654435761)) % np.uint64(1 << 32)
        return (part / float(1 << 32) - 0.5).reshape(self.tables * self.bits, width)

    def buckets(self, vector: Column) -> Column:
        """Bucket of a unit vector in every table, as an array of whole numbers; null for null or ragged ones."""
        planes = self

        @F.arrow_udf("array<int>")
        def place(batch: pa.Array) -> pa.Array:
            widths = batch.value_lengths()
            out = [None] * len(batch)
            for width in set(widths.drop_null().to_pylist()) - {0}:
                rows = np.flatnonzero(widths.fill_null(0).to_numpy() == width)
                values = batch.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                sides = (values @ planes.weights(width).T >= 0).reshape(len(rows), planes.tables, planes.bits)
                for row, found in zip(rows.tolist(), (sides @ (1 << np.arange(planes.bits))).tolist()):
                    out[row] = found
            return pa.array(out, pa.list_(pa.int32()))

        return place(vector)

    def probes(self, bucket: Column, radius: int) -> Column:
        """The buckets at most ``radius`` planes away."""
        masks = [sum(1 << b for b in some) for r in range(radius + 1) for some in combinations(range(self.bits), r)]
        return F.transform(F.array(*map(F.lit, masks)), lambda mask: bucket.bitwiseXOR(mask))


class Index(NamedTuple):
    """``entries`` (tab, bucket, base_key), ``vectors`` (base_key, vector), ``copies`` (base_key, song_id)."""

    planes: Planes
    entries: DataFrame
    vectors: DataFrame
    copies: DataFrame

    def write(self, path: str) -> None:
        self.entries.repartition("tab").sortWithinPartitions("bucket").write.partitionBy("tab").parquet(f"{path}/entries")
        self.vectors.write.parquet(f"{path}/vectors")
        self.copies.write.parquet(f"{path}/copies")

    @staticmethod
    def read(spark, path: str, planes: Planes) -> Index:
        return Index(planes, *(spark.read.parquet(f"{path}/{name}") for name in ("entries", "vectors", "copies")))


def build_index(songs: DataFrame, planes: Planes = Planes()) -> Index:
    """Index of ``songs`` (``song_id, full_vector``)."""
    keyed = songs.select("song_id", unit(F.col("full_vector")).alias("vector"))
    keyed = durable(keyed.withColumn("base_key", vector_key(F.col("vector"))))
    vectors = keyed.groupBy("base_key").agg(F.first("vector").alias("vector"))
    entries = vectors.withColumn("_buckets", planes.buckets(F.col("vector"))).select(
        "base_key", F.posexplode("_buckets").alias("tab", "bucket"))
    return Index(planes, entries.select("tab", "bucket", "base_key"), vectors, keyed.select("base_key", "song_id"))


def similar_approximate(
    queries: DataFrame, index: Index, n: int = SIMILAR, radius: int = 2, digits: int = 6, *,
    block_rows: int = BLOCK_ROWS, walk_rows: int = similarity.WALK_ROWS, chunk_rows: int = similarity.CHUNK_ROWS,
) -> DataFrame:
    """For every query (``query_id, vector``) up to ``n`` of its nearest songs: ``query_id, song_id, similarity, rank``.

    The songs of all probed buckets are compared; a query itself is left out. Similarities are rounded
    before they are ranked, ties go to the smaller song id.
    """
    planes, scope = index.planes, F.lit("").alias("scope")
    asked = queries.select("query_id", scope, unit(F.col("vector")).alias("vector"))
    asked = durable(asked.withColumn("query_key", vector_key(F.col("vector"))))
    different = asked.groupBy("scope", "query_key").agg(F.first("vector").alias("vector"))
    numbered = durable(different.withColumn("buckets", planes.buckets(F.col("vector"))).filter("buckets is not null")
                       .withColumn("number", F.monotonically_increasing_id()))

    buckets = index.entries.groupBy("base_key").agg(F.array_sort(F.collect_list(F.struct("tab", "bucket"))).alias("_entries"))
    first = index.copies.groupBy("base_key").agg(F.min("song_id").alias("first_id"))
    # Places follow the first ids, so that a task can break ties without comparing text.
    placed = durable(
        index.vectors.join(buckets, "base_key").join(first, "base_key").orderBy("first_id")
        .select(scope, "base_key", "vector", F.col("_entries.bucket").alias("buckets"), F.monotonically_increasing_id().alias("place")))

    hits = _best(_probed(numbered, placed, planes, n + 1, radius, digits, (block_rows, walk_rows, chunk_rows)), n + 1)
    return expand(hits, index.copies.withColumn("scope", F.lit("")), asked, placed.select("scope", "base_key", "place"),
                  numbered.select("scope", "query_key", "number"), n)


def _probed(asked, base, planes, n, radius, digits, sizes):
    """At most ``n`` hits per query and walk."""
    block_rows, walk_rows, chunk_rows = sizes
    dealt = [parts(df, ["scope"], name, rows, most).first() for df, name, rows, most in (
        (asked, "chunks", chunk_rows, similarity.CHUNK_ROWS), (base, "walks", walk_rows, similarity.WALK_ROWS))]
    if None in dealt:
        return asked.sparkSession.createDataFrame([], _HITS)
    chunks, walks = dealt[0].chunks, dealt[1].walks
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    at = lambda number, count: F.pmod(F.xxhash64(number), F.lit(count).cast("long"))
    group = ["chunk", "walk", "width"]  # vectors of different widths have no cosine
    columns = ["chunk", "walk", F.size("vector").alias("width"), "side", "id", "vector", "buckets"]
    left = asked.withColumns({"chunk": at("number", chunks), "walk": every(walks), "side": F.lit(0), "id": F.col("number")})
    right = base.withColumns({"walk": at("place", walks), "chunk": every(chunks), "side": F.lit(1), "id": F.col("place")})

    def meet(best: _Best, homes: np.ndarray, vectors: np.ndarray, places: np.ndarray, buckets: np.ndarray) -> None:
        for tab in range(planes.tables):
            order = np.argsort(buckets[:, tab], kind="stable")
            edges = np.flatnonzero(np.diff(buckets[order, tab])) + 1
            for songs in np.split(order, edges):
                probing = np.flatnonzero(np.bitwise_count(homes[tab] ^ buckets[songs[0], tab]) <= radius)
                if len(probing):
                    best.take(vectors[songs], places[songs], None, probing)

    def walk(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, songs, waiting, best, homes = [], [], 0, None, None
        for batch in batches:
            side, width = batch.column("side").to_numpy(), key[2].as_py()
            if (np.diff(side) < 0).any() or best is not None and not side.all():
                raise RuntimeError("songs came before the queries that look for them")
            first = int(np.searchsorted(side, 1))
            rows = [batch.column("id").to_numpy(), floats(batch.column("vector"), width), floats(batch.column("buckets"), planes.tables)]
            if first:
                queries.append([x[:first].copy() for x in rows])
            if first == len(side) or not queries:
                continue
            if best is None:
                numbers, vectors, homes = (np.concatenate(x) for x in zip(*queries))
                queries, homes = [()], np.ascontiguousarray(homes.T)
                best = _Best(vectors, np.zeros(len(vectors)), n, 10 ** digits)
            songs.append([x[first:].copy() for x in rows])
            waiting += len(side) - first
            if waiting >= block_rows:
                places, vectors, buckets = (np.concatenate(x) for x in zip(*songs))
                meet(best, homes, vectors, places, buckets)
                songs, waiting = [], 0
        if songs:
            places, vectors, buckets = (np.concatenate(x) for x in zip(*songs))
            meet(best, homes, vectors, places, buckets)
        if best is not None:
            yield from best.hits(numbers)

    rows = left.select(*columns).unionByName(right.select(*columns))
    rows = deal(rows, chunks * walks, group).sortWithinPartitions(*group, "side")
    return rows.groupBy(*group).applyInArrow(walk, _HITS)
