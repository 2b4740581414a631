"""Exact repeats of long byte strings, found by sorting suffixes one bucket at a time.

A suffix matters only for its first ``LENGTH`` bytes. It is dealt to a bucket by content: the least hashed
gram of ``GRAM`` bytes within those bytes is its anchor, so equal strings have equal anchors at equal places,
and a bucket (all suffixes of one anchor gram) is the only place where a suffix can find its like. Anchors
that occur once end there. Occurrences whose whole context is equal repeat in full and are settled by
digests; only different contexts of one anchor bring their bytes to a task, which sorts a bounded chunk of
buckets: the suffixes of each bucket in the order of their bytes. For that, the positions of a difference
cover are ranked first, by doubling the length they are ranked by until it is ``LENGTH``; ranks are kept for
them alone. Suffixes are then sorted by their first ``COVER`` bytes. Two that agree there have a distance
below ``COVER`` at which both meet the cover, and the ranks there decide. Strings repeat if neighbours in that
order agree in ``LENGTH`` bytes, which is read from the bytes. Buckets of more than ``MOST_CONTEXTS`` different
contexts, too many for a task, are resolved by a distributed count of 64-bit hashes instead.

Null and empty texts have no bytes; texts shorter than ``LENGTH`` have no string of that length and stay
whole. Rows with equal texts repeat each other. An empty table gives no rows. Only key and text are read.
Anchors, contexts and the counted buckets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cadenza.llm.common import content, lookup, stored

LENGTH, GRAM = 400, 160
#: Bytes of a text that are scanned at once, and bytes of contexts that a task sorts at once.
SEGMENT, CHUNK = 1 << 20, 1 << 20
#: Different contexts of one anchor that a task may hold.
MOST_CONTEXTS = 4096
#: Modulus of the difference cover, 8 to 16: it has four residues.
COVER = 13
BASE = 0x9E3779B97F4A7C15
ANCHORS = "d binary, k bigint, c bigint, at int, lo int, hi int"


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random words of bytes, and powers of the base and of its inverse."""
    letters = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
    powers = np.full(SEGMENT + 2 * CHUNK + 2 * LENGTH + 1, BASE, np.uint64)
    inverse = np.full(len(powers), pow(BASE, -1, 1 << 64), np.uint64)
    powers[0] = inverse[0] = 1
    return letters, np.cumprod(powers, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Prefixes:
    """Hashes of any string of a buffer."""

    def __init__(self, data: np.ndarray):
        letters, powers, self.inverse = _tables()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(letters[data] * powers[:len(data)], out=self.sums[1:])

    def hash(self, start: np.ndarray, length) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.inverse[start])


def difference_cover(v: int) -> np.ndarray:
    """Residues such that every difference modulo ``v`` is one between two of them; taken greedily."""
    cover, missing = [0], set(range(1, v))
    while missing:
        gain = lambda d: len(missing & {x for c in cover for x in ((d - c) % v, (c - d) % v)})
        cover.append(max(range(v), key=gain))
        missing -= {(a - b) % v for a in cover for b in cover}
    return np.array(sorted(cover))


def anchors_of(data: np.ndarray):
    """Anchor of every suffix of LENGTH bytes: (anchor, first, last suffix, gram hash, context hash) of each."""
    found = []
    for begin in range(0, max(0, len(data) - LENGTH + 1), SEGMENT):
        part = data[begin:begin + SEGMENT + LENGTH - 1]
        prefixes, n = Prefixes(part), len(part) - GRAM + 1
        grams = prefixes.hash(np.arange(n), GRAM)
        # The least gram, leftmost among equals: hash above, place below.
        least = (grams & ~np.uint64((1 << 23) - 1)) | np.arange(n, dtype=np.uint64)
        width, span = LENGTH - GRAM + 1, 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if width > span:
            least = np.minimum(least[:len(least) - (width - span)], least[width - span:])
        anchor = (least & np.uint64((1 << 23) - 1)).astype(np.int64)
        first = np.nonzero(np.diff(anchor, prepend=-1))[0]
        last = np.append(first[1:], len(anchor)) - 1
        at = anchor[first]
        context = mix(prefixes.hash(first, last + LENGTH - first) + (at - first).astype(np.uint64))
        found.append((at + begin, first + begin, last + begin, grams[at], context))
    return [np.concatenate(x) for x in zip(*found)] if found else None


def scan(texts: DataFrame) -> DataFrame:
    """Anchors of all texts: (d, content) to rows (d, k, c, at, lo, hi)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, parts = [], []
            for i, text in enumerate(batch["content"]):
                if (found := anchors_of(np.frombuffer(text.as_py(), np.uint8))) is not None:
                    owners.append(np.full(len(found[0]), i))
                    parts.append(found)
            if parts:
                at, lo, hi, k, c = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays([
                    batch["d"].take(pa.array(np.concatenate(owners))), pa.array(k.view(np.int64)), pa.array(c.view(np.int64)),
                    pa.array(at.astype(np.int32)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)),
                ], ["d", "k", "c", "at", "lo", "hi"])

    long = texts.filter(F.octet_length("content") >= LENGTH).select("d", F.col("content").cast("binary"))
    return long.mapInArrow(run, ANCHORS)


def words_of(buffer: bytes) -> np.ndarray:
    """The eight bytes at each position as one number, so that numbers are ordered as the bytes are; zeros follow the end."""
    n = len(buffer)
    data = np.zeros(n + LENGTH + 2 * COVER + 8, np.uint8)
    data[:n] = np.frombuffer(buffer, np.uint8)
    words = np.zeros(len(data) - 8, np.uint64)
    for i in range(8):
        words = (words << np.uint64(8)) | data[i:i + len(words)]
    return words


def _dense(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Ranks of pairs of numbers; equal pairs share one."""
    order = np.lexsort((second, first))
    new = (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0)
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.append(0, np.cumsum(new))
    return ranks


def cover_ranks(words: np.ndarray, cover: np.ndarray) -> np.ndarray:
    """Rank of the first ``LENGTH`` bytes or more at each cover position, in the order of positions.

    Positions a multiple of the modulus apart are both in the cover, so ranks by twice the length are
    those of pairs of ranks, a fixed number of cover positions apart.
    """
    sample = (np.arange(-(-(len(words) - COVER) // COVER))[:, None] * COVER + cover).ravel()
    ranks, span = _dense(words[np.minimum(sample, len(words) - 1)], words[np.minimum(sample + COVER - 8, len(words) - 1)]), 1
    while span * COVER < LENGTH:
        step = span * len(cover)
        later = np.append(ranks[step:] + 1, np.zeros(min(step, len(ranks)), np.int64))
        ranks = _dense(ranks, later)
        span *= 2
    return ranks


def suffix_order(words: np.ndarray, bucket: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes that start ``at``, by bucket and bytes, and which agree with the one before in ``LENGTH`` bytes."""
    cover = difference_cover(COVER)
    ranks, slot = cover_ranks(words, cover), np.full(COVER, -1)
    slot[cover] = np.arange(len(cover))
    rank_at = lambda p: ranks[p // COVER * len(cover) + slot[p % COVER]]
    head, tail = words[at], words[at + COVER - 8]
    order = np.lexsort((tail, head, bucket))
    new = (np.diff(bucket[order]) != 0) | (np.diff(head[order]) != 0) | (np.diff(tail[order]) != 0)
    tie = np.empty(len(at), np.int64)
    tie[order] = np.append(0, np.cumsum(new)) if len(at) else []
    shared = np.flatnonzero(np.bincount(tie, minlength=1)[tie] > 1) if len(at) else np.empty(0, np.int64)
    # The place of a suffix among those it is tied with: how many of each residue come before it.
    place, size = np.zeros(len(at), np.int64), len(ranks) + 2
    classes = [shared[at[shared] % COVER == r] for r in range(COVER)]
    meets = [[d for d in range(COVER) if slot[(r + d) % COVER] >= 0] for r in range(COVER)]
    for r, others in enumerate(classes):
        if not len(others):
            continue
        others = others[np.lexsort((rank_at(at[others] + meets[r][-1]), tie[others]))]
        ties = tie[others]
        for q, mine in enumerate(classes):
            if len(mine):
                ahead = min(d for d in meets[q] if d in meets[r])
                keys = ties * size + rank_at(at[others] + ahead)
                place[mine] += np.searchsorted(keys, tie[mine] * size + rank_at(at[mine] + ahead)) - np.searchsorted(ties, tie[mine])
    order = np.lexsort((place, tie))
    same = np.append(False, np.diff(tie[order]) == 0) if len(at) else np.empty(0, bool)
    left, open_ = np.flatnonzero(same), np.ones(0, bool)
    for i in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        open_ = words[at[order[left]] + i] == words[at[order[left - 1]] + i]
        same[left[~open_]] = False
        left = left[open_]
    return order, same


def suffixes_of(k: np.ndarray, off: np.ndarray, length: np.ndarray):
    """For contexts one after another: context, place (from the anchor) and position of each suffix."""
    begin, n = np.cumsum(length) - length, length - LENGTH + 1
    owner = np.repeat(np.arange(len(length)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return owner, inside - off[owner], begin[owner] + inside


def _runs(owner: np.ndarray, place: np.ndarray):
    """(owner, from, to) of the runs of consecutive places."""
    if not len(owner):
        return owner, place, place
    new = np.append(True, (np.diff(owner) != 0) | (np.diff(place) != 1))
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(owner)) - 1
    return owner[first], place[first], place[last]


def _arrays(rows: list[dict]):
    data = [r["bytes"] for r in rows]
    return (b"".join(data), np.array([r["k"] for r in rows], np.int64), np.array([r["off"] for r in rows], np.int64),
            np.array([len(b) for b in data], np.int64))


def sort_buckets(contexts: DataFrame) -> DataFrame:
    """Repeats among different contexts of one anchor: (k, c, off, bytes) to (k, c, first, last) from the anchor."""

    def resolve(rows: list[dict]) -> pa.RecordBatch:
        buffer, k, off, length = _arrays(rows)
        owner, place, at = suffixes_of(k, off, length)
        order, same = suffix_order(words_of(buffer), k[owner], at)
        again = np.zeros(len(at), bool)
        again[order[same]] = again[order[np.append(same[1:], False)]] = True
        owner, first, last = _runs(owner[again], place[again])
        return pa.RecordBatch.from_arrays([
            pa.array([rows[o]["k"] for o in owner], pa.int64()), pa.array([rows[o]["c"] for o in owner], pa.int64()),
            pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["k", "c", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket, size = [], [], 0  # whole buckets that await sorting, and the bucket being read
        for batch in batches:
            for row in batch.to_pylist():
                if bucket and bucket[-1]["k"] != row["k"]:
                    held, bucket = held + bucket, []
                    if size > CHUNK:
                        yield resolve(held)
                        held, size = [], 0
                bucket.append(row)
                size += len(row["bytes"])
        if held or bucket:
            yield resolve(held + bucket)

    dealt = contexts.select("k", "c", "off", "bytes").repartition(F.col("k")).sortWithinPartitions("k", "c")
    return dealt.mapInArrow(run, "k bigint, c bigint, first int, last int")


def count_suffixes(contexts: DataFrame) -> DataFrame:
    """The same for buckets of any size: one row for each suffix, counted and joined by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, place, _ = suffixes_of(*_arrays([row])[1:])
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["k"]] * len(place), pa.int64()), pa.array([row["c"]] * len(place), pa.int64()),
                    pa.array(place.astype(np.int32)), pa.array(_plain_keys(row).view(np.int64))], ["k", "c", "place", "h"])

    each = contexts.select("k", "c", "off", "bytes").mapInArrow(run, "k bigint, c bigint, place int, h bigint")
    again = lookup(each.groupBy("k", "place", "h").agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    return each.join(again, ["k", "place", "h"]).select("k", "c", F.col("place").alias("first"), F.col("place").alias("last"))


def _plain_keys(row: dict) -> np.ndarray:
    """Hashes of the suffixes of one context, comparable between tasks (ranks are not)."""
    n = len(row["bytes"]) - LENGTH + 1
    return Prefixes(np.frombuffer(row["bytes"], np.uint8)).hash(np.arange(n), LENGTH)


def _cut_contexts(texts: DataFrame) -> DataFrame:
    """(content, wanted) to the contexts (k, c, off, bytes) that ``wanted`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch["content"], batch["wanted"]):
                whole, rows = text.as_py(), wanted.as_py()
                yield pa.RecordBatch.from_pylist([
                    {"k": w["k"], "c": w["c"], "off": w["at"] - w["lo"], "bytes": whole[w["lo"]:w["hi"] + LENGTH]} for w in rows
                ], pa.schema([("k", pa.int64()), ("c", pa.int64()), ("off", pa.int32()), ("bytes", pa.binary())]))

    return texts.select("content", "wanted").mapInArrow(run, "k bigint, c bigint, off int, bytes binary")


def _strip(texts: DataFrame) -> DataFrame:
    """(d, content, first, until arrays) to (d, n_removed, n_spans, kept): what is left without the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                spans: list[list[int]] = []
                for first, until in sorted((s["first"], s["until"]) for s in row["spans"]):
                    if spans and first <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], until)
                    else:
                        spans.append([first, until])
                whole, kept, at = row["content"], hashlib.sha256(), 0
                for first, until in spans:
                    kept.update(whole[at:first])
                    at = until
                kept.update(whole[at:])
                out.append({"d": row["d"], "n_removed": sum(b - a for a, b in spans), "n_spans": len(spans), "kept": kept.hexdigest()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([
                ("d", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.string())]))

    return texts.select("d", "content", "spans").mapInArrow(run, "d binary, n_removed bigint, n_spans bigint, kept string")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    texts = docs.select(F.col(key).alias("key"), content(text).alias("content")).withColumn(
        "sha", F.sha2(F.col("content").cast("binary"), 256)).withColumn("d", F.substring(F.unhex("sha"), 1, 16))
    facts = stored(texts.select("key", "d", "sha", F.octet_length("content").cast("long").alias("n_bytes")), "facts")
    classes = stored(facts.filter(F.col("n_bytes") >= LENGTH).groupBy("d").agg(
        F.count("*").alias("copies"), F.min("key").alias("_first")), "classes")
    found = stored(scan(texts), "anchors")
    often = stored(found.groupBy("k").agg(
        F.count("*").alias("n"), (F.min("c") != F.max("c")).alias("mixed")).filter("n > 1"), "often")
    repeats = stored(found.join(lookup(often), "k").drop("n"), "repeats")
    contexts = repeats.groupBy("k", "c").agg(
        F.count("*").alias("n"), F.bool_or("mixed").alias("mixed"), F.min(F.struct("d", "at", "lo", "hi")).alias("one"))
    contexts = stored(contexts, "contexts")
    # Texts that hold a repeated anchor, once each, with the contexts they are to bring.
    wanted = contexts.filter("mixed").select("one.d", F.struct("k", "c", "one.at", "one.lo", "one.hi").alias("w"))
    wanted = wanted.groupBy("d").agg(F.collect_list("w").alias("wanted"))
    holders = repeats.select("d").distinct().join(classes, "d").join(wanted, "d", "left").filter(
        "wanted is not null or copies = 1").withColumnRenamed("d", "_d")
    holders = stored(holders, "holders")
    cut = stored(texts.join(lookup(holders), (F.col("d") == F.col("_d")) & F.col("key").eqNullSafe(F.col("_first"))).select(
        "d", F.col("content").cast("binary").alias("content"), "wanted", "copies").dropDuplicates(["d"]), "holding")
    bytes_ = stored(_cut_contexts(cut.filter("wanted is not null")), "bytes")
    sizes = bytes_.groupBy("k").agg(F.count("*").alias("m"))
    large = stored(sizes.filter(F.col("m") > MOST_CONTEXTS).drop("m"), "large")
    small = sort_buckets(bytes_.join(lookup(large), "k", "left_anti"))
    pieces = stored(small.unionByName(count_suffixes(bytes_.join(lookup(large), "k"))), "pieces")
    # Spans of single texts: all suffixes of a context that occurs again, or the runs found in its bucket.
    lone = repeats.join(lookup(classes.filter("copies = 1").select("d")), "d", "left_semi")
    whole = lone.join(lookup(contexts.filter("n > 1").select("k", "c")), ["k", "c"], "left_semi").select(
        "d", F.struct(F.col("lo").alias("first"), (F.col("hi") + LENGTH).alias("until")).alias("span"))
    partly = lone.join(lookup(pieces), ["k", "c"]).select("d", F.struct(
        (F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last") + LENGTH).alias("until")).alias("span"))
    spans = whole.unionByName(partly).groupBy("d").agg(F.collect_list("span").alias("spans"))
    stripped = stored(_strip(cut.filter("copies = 1").select("d", "content").join(spans, "d")), "stripped")
    many = classes.filter("copies > 1").select("d", F.lit(True).alias("_many"))
    out = facts.join(lookup(many), "d", "left").join(lookup(stripped), "d", "left")
    return out.select(
        F.col("key").alias(key), "n_bytes",
        F.when(F.col("_many"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("_many"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("_many"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
