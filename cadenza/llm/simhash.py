"""SimHash near-duplicates: fingerprints, block join, Hamming check, components.

Fingerprints within ``distance`` bits agree on at least two of ``distance + 2`` blocks, so they
meet in a bucket named by two blocks and their values. Buckets of up to ``BUCKET`` different
fingerprints compare their members. The members of larger buckets are joined on their one-bit
neighbours instead: two fingerprints at most two bits apart share one, and no neighbour has
more than 65 of them, so a hot block costs no more than its members and loses no link.

Null and empty texts, and texts of white space only, have fingerprint zero and link like any
other. Texts with fewer words than a shingle hash their whole sequence. Equal texts are one
fingerprint and are never paired. Repeated rows give repeated results.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from cadenza.llm.common import content, lookup, stored
from cadenza.llm.components import components

SEED = 42
#: Different fingerprints of a bucket that are compared with each other.
BUCKET = 64
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16


def fingerprint_of(text: str, words: int) -> int:
    """SimHash of one text as an unsigned integer."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and white space only
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words))))
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), CHUNK):
        part = hashes[start:start + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, words: int) -> Column:
    """SimHash of a text column as a signed 64-bit integer."""

    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint_of(t.as_py() or "", words) for t in texts), np.uint64, len(texts))
        return pa.array(found.view(np.int64))

    return run(text)


def close_pairs(prints: DataFrame, distance: int) -> DataFrame:
    """(a, b) links between the different fingerprints ``fp`` of ``prints``, at most ``distance`` bits apart.

    Not all pairs of a dense cluster need be there, but enough to reach each from each.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distances of 0, 1 and 2 bits are supported")
    blocks = distance + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << high) - (1 << low)) for low, high in zip(edges, edges[1:])]
    signed = lambda n: n - (1 << 64) if n >= 1 << 63 else n
    keys = F.array(*(
        F.struct(F.lit(i).alias("blocks"), F.col("fp").bitwiseAND(F.lit(signed(one | other))).alias("bits"))
        for i, (one, other) in enumerate(combinations(masks, 2))
    ))
    dealt = prints.select("fp", F.explode(keys).alias("key"))
    sizes = stored(dealt.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "block-sizes")
    small = (
        dealt.join(lookup(sizes.filter(F.col("n") <= BUCKET)), "key").groupBy("key").agg(F.collect_list("fp").alias("fps"))
        .select(F.explode(F.flatten(F.transform("fps", lambda x: F.transform(
            F.filter("fps", lambda y: (y > x) & (F.bit_count(x.bitwiseXOR(y)) <= distance)),
            lambda y: F.struct(x.alias("a"), y.alias("b")),
        )))).alias("pair")).select("pair.*")
    )
    hot = dealt.join(lookup(sizes.filter(F.col("n") > BUCKET)), "key").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(signed(1 << bit)) for bit in range(64)))
    large = (
        hot.select("fp", F.explode(F.transform(flips, lambda bit: F.col("fp").bitwiseXOR(bit))).alias("near"))
        .groupBy("near").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
        .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
        .filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    )
    return small.unionByName(large)


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) of every row: 16 hex digits, and the least key it can reach."""
    prints = stored(docs.select(F.col(key).alias("key"), fingerprint(content(text), words).alias("fp")), "prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("key").alias("first")), "prints")
    linked = components(close_pairs(distinct, distance)).withColumnsRenamed({"node": "fp"})
    placed = distinct.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    heads = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = stored(placed.join(lookup(heads), "component").select("fp", "component_id"), "prints")
    return prints.join(classes, "fp").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
