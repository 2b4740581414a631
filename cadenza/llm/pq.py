"""Near-duplicate embeddings by product quantisation.

Vectors are scaled to length one. A bounded sample trains coarse centres (inverted lists) and, on the
residuals, a small codebook for each subspace. Every vector is put in the list of its nearest centre with
its residual codes and the exact length of what the codes leave out. A query probes each list whose border, the
bisector between the list's centre and the query's nearest one, is no farther than ``DEVIATIONS`` standard
deviations of the component that a step of the link distance has in a random direction. (Probing up to
the whole distance, ``deviations=None``, loses nothing, but in many dimensions that is most lists.) In a list,
distances come from one table per query and subspace; a candidate is kept if its table distance less what
its codes leave out is within the link distance, so none is lost there; the cosine of those is then computed
from the stored vectors in double precision.

Null and zero vectors and those with null or non-finite components link with nothing and are classes of
their own. Vectors of different widths never link; each width has an index of its own. Equal vectors are searched once and count each other.
Repeated ids are separate rows; an empty table gives no rows. Only id and vector are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cadenza.llm.common import lookup, stored
from cadenza.llm.components import components

#: Vectors that train centres and codebooks, drawn by hash; bounds what comes to the driver.
SAMPLE = 20_000
#: Centres of inverted lists, subspaces, codes of each.
LISTS, PARTS, CODES = 256, 8, 64
#: Breadth of the probes. Against brute force, this found all links of both kinds of test tables.
DEVIATIONS = 3.0
#: Vectors of a list, and queries, that one task compares.
BLOCK = 4096
SEED = 5
#: Slack of single-precision distances.
SLACK = 1e-4


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - (centres ** 2).sum(axis=1) / 2, axis=1)


def _kmeans(x: np.ndarray, k: int, draw, rounds: int = 8) -> np.ndarray:
    centres = x[draw.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


class Index:
    """Centres and codebooks."""

    def __init__(self, sample: np.ndarray):
        draw = np.random.default_rng(SEED)
        x = sample.astype(np.float32)
        self.width = x.shape[1]
        self.centres = _kmeans(x, LISTS, draw)
        residuals = x - self.centres[_nearest(x, self.centres)]
        self.parts = np.array_split(np.arange(self.width), min(PARTS, self.width))
        self.books = [_kmeans(np.ascontiguousarray(residuals[:, p]), CODES, draw) for p in self.parts]
        gaps = np.sqrt(np.maximum(0, ((self.centres[:, None] - self.centres[None]) ** 2).sum(axis=2)))
        self.gaps = np.maximum(gaps, 1e-9)

    def code(self, x: np.ndarray):
        """List, codes and left-out length of each vector."""
        lists = _nearest(x, self.centres)
        rest = x - self.centres[lists]
        codes, left = np.empty((len(x), len(self.parts)), np.uint8), np.zeros(len(x), np.float32)
        for i, (part, book) in enumerate(zip(self.parts, self.books)):
            codes[:, i] = _nearest(np.ascontiguousarray(rest[:, part]), book)
            left += ((rest[:, part] - book[codes[:, i]]) ** 2).sum(axis=1)
        return lists, codes, np.sqrt(left)

    def probes(self, x: np.ndarray, lists: np.ndarray, reach: float, deviations: float | None) -> np.ndarray:
        """For each vector, which lists are searched for others within ``reach`` of it; none is missing with no ``deviations``."""
        squares = (self.centres ** 2).sum(axis=1) - 2 * x @ self.centres.T
        own = squares[np.arange(len(x)), lists]
        bisector = (squares - own[:, None]) / (2 * self.gaps[lists])
        share = 1.0 if deviations is None else min(1.0, deviations / self.width ** 0.5)
        return (bisector <= share * reach + SLACK) | (np.arange(len(self.centres)) == lists[:, None])

    def distances(self, queries: np.ndarray, centre: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of each query to each coded vector of one list, from tables."""
        rest = queries - self.centres[centre]
        total = np.zeros((len(queries), len(codes)), np.float32)
        for i, (part, book) in enumerate(zip(self.parts, self.books)):
            own = rest[:, part]
            table = (own ** 2).sum(axis=1)[:, None] - 2 * own @ book.T + (book ** 2).sum(axis=1)
            total += table[:, codes[:, i]]
        return np.sqrt(np.maximum(total, 0))


def _unit(raw: pd.Series, kind: str) -> np.ndarray:
    """Vectors of unit length in double precision."""
    x = np.stack([np.frombuffer(b, kind) for b in raw]).astype(np.float64) if len(raw) else np.empty((0, 0))
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _roots(pairs: np.ndarray, n: int) -> np.ndarray:
    """Least node that each of ``n`` nodes reaches over ``pairs``."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, pairs[:, 0], root[pairs[:, 1]])
        np.minimum.at(least, pairs[:, 1], root[pairs[:, 0]])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _vectors(rows: DataFrame, key: str, vector: str, kind: str) -> DataFrame:
    """(key, raw): components as bytes in their own precision; null where the vector links with nothing."""
    kept = F.filter(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = (F.size(kept) == F.size(vector)) & F.exists(F.col(vector), lambda v: v != 0)
    usable_rows = rows.select(F.col(key).alias("key"), F.when(usable, F.col(vector)).alias("vector"))

    @F.pandas_udf("binary")
    def packed(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else (np.asarray(v, kind) + np.dtype(kind).type(0)).tobytes())

    return usable_rows.withColumn("raw", packed("vector")).drop("vector")


def link(
    rows: DataFrame, cosine: float = 0.95, key: str = "vec_id", vector: str = "embedding", deviations: float | None = DEVIATIONS
) -> DataFrame:
    """(key, n_links, component_id, kept) of every row: links are pairs with at least this cosine.

    ``deviations`` is the breadth of the probes; with None no list that could hold a link is left out.
    """
    kind = "<f4" if rows.schema[vector].dataType.elementType.typeName() == "float" else "<f8"
    every = stored(_vectors(rows, key, vector, kind), "vectors")
    classes = stored(
        every.filter("raw is not null").groupBy("raw").agg(F.min("key").alias("first"), F.count("*").alias("copies"))
        .withColumn("node", F.xxhash64("raw")), "classes")
    widths = [r[0] for r in classes.select(F.octet_length("raw")).distinct().collect()]
    result = None
    for width in sorted(widths):
        found = _linked(classes.filter(F.octet_length("raw") == width), kind, cosine, deviations)
        result = found if result is None else result.unionByName(found)
    if result is None:
        result = classes.select("raw", F.col("first").alias("head"), F.lit(0).cast("long").alias("linked"))
    return every.join(result, "raw", "left").select(
        F.col("key").alias(key), F.coalesce("linked", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("head", "key").alias("component_id"),
    ).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def _linked(classes: DataFrame, kind: str, cosine: float, deviations: float | None) -> DataFrame:
    """(raw, head, linked) of the different vectors of one width: least key of their component, number of links."""
    spark = classes.sparkSession
    drawn = classes.orderBy(F.xxhash64(F.col("node")), "node").limit(SAMPLE).select("raw").toPandas()["raw"]
    index = spark.sparkContext.broadcast(Index(_unit(drawn, kind)))
    reach = float(np.sqrt(2 - 2 * cosine))

    def coded(batches):
        model = index.value
        for pdf in batches:
            x = _unit(pdf["raw"], kind).astype(np.float32)
            lists, codes, left = model.code(x)
            probed = model.probes(x, lists, reach, deviations)
            yield pdf.assign(list=lists, codes=[c.tobytes() for c in codes], left=left.astype(np.float64),
                             probes=[np.nonzero(p)[0].astype(np.int32) for p in probed])

    coded_rows = stored(classes.mapInPandas(
        coded, "raw binary, first long, copies long, node long, list int, codes binary, left double, probes array<int>"
    ), "codes")
    # Lists, and the queries of lists, are cut into blocks: one row per centre says into how many.
    cuts = lambda df, name: df.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    same = [F.col(c).alias(c) for c in ("node", "raw", "copies")]  # new columns, so that both sides of the cogroup differ
    asked = coded_rows.select(*same, F.explode("probes").alias("list"))
    sizes = stored(cuts(coded_rows, "bases").join(cuts(asked.select("list"), "askers"), "list"), "blocks")
    small = F.broadcast(sizes)  # one row for each of at most LISTS centres
    base = coded_rows.join(small, "list").select(
        "list", F.pmod(F.col("node"), F.col("bases")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("askers") - 1)).alias("chunk"),
        "node", "raw", "copies", "codes", "left")
    query = asked.join(small, "list").select(
        "list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bases").cast("long") - 1)).alias("block"),
        F.pmod(F.xxhash64("node"), F.col("askers")).cast("int").alias("chunk"), "node", "raw", "copies")

    def compare(where, bases: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"node": pd.Series(dtype="int64"), "linked": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})
        if not len(bases) or not len(queries):
            return empty
        model = index.value
        x, q = _unit(bases["raw"], kind), _unit(queries["raw"], kind)
        codes = np.stack([np.frombuffer(c, np.uint8) for c in bases["codes"]])
        left, weight = bases["left"].to_numpy(np.float32), bases["copies"].to_numpy()
        nodes, at = np.unique(np.concatenate([bases["node"], queries["node"]]), return_inverse=True)
        base_at, query_at = at[:len(bases)], at[len(bases):]
        linked, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        for start in range(0, len(q), 256):
            part = q[start:start + 256]
            near = model.distances(part.astype(np.float32), int(where[0]), codes) - left <= reach + SLACK
            i, j = np.nonzero(near)
            i, j = i[(other := query_at[start + i] != base_at[j])], j[other]
            close = np.einsum("ij,ij->i", part[i], x[j]) >= cosine
            i, j = query_at[start + i[close]], j[close]
            np.add.at(linked, i, weight[j])
            root = _roots(np.stack([np.concatenate([i, np.arange(len(nodes))]), np.concatenate([base_at[j], root])], axis=1), len(nodes))
        met = (linked > 0) | (root != np.arange(len(nodes)))
        return pd.DataFrame({"node": nodes[met], "linked": linked[met], "root": nodes[root[met]]})

    groups = ["list", "block", "chunk"]
    found = stored(base.groupBy(*groups).cogroup(query.groupBy(*groups)).applyInPandas(
        compare, "node long, linked long, root long"), "found")
    places = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    placed = coded_rows.select("node", "raw", "first", "copies").join(lookup(places), "node", "left").join(counts, "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    heads = placed.groupBy("component").agg(F.min("first").alias("head"))
    return stored(placed.join(lookup(heads), "component").select(
        "raw", "head", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("linked")), "placed")
