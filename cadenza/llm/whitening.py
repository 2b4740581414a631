"""Whitening of embeddings with MLlib's BlockMatrix.

Vectors are put on a grid of whole numbers, so their sums and means are exact and do not depend on
the order of additions. Rows are numbered without gaps, centred, and dealt into blocks of a
BlockMatrix. Its transpose times itself is the scatter matrix; the middle dimension of that product is
split, so no task meets more than a few row blocks. The scatter matrix is as wide as a vector and is
decomposed on the driver; a second BlockMatrix product projects the rows on the components.

Vectors that are null or hold a null or non-finite entry are left out of fit and result. Of vectors
of different widths, the shorter ones are taken to go on with zeros. Grid values end at 2**40 either
way. Components without variance (below 1e-12 of all) are left out, so vectors that are all equal, a
single vector, and an empty table give no rows. Rows with equal or null keys are rows of their own.
Deviations that do not fit a long are null. Columns but key and vector are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, functions as F

from cadenza.llm.common import numbered, stored

#: Rows and columns of a block; row blocks that one task of the scatter product multiplies.
BLOCK_ROWS, BLOCK_COLUMNS, BLOCKS_A_TASK = 1024, 1024, 16
LARGEST = float(1 << 40)
#: Share of the variance below which a component counts as empty.
EMPTY = 1e-12
WHITENED = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def usable(vector: str) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    finite = lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")), F.lit(False))
    return F.col(vector).isNotNull() & F.forall(vector, finite)


def on_grid(vector: str, scale: int, offset: int) -> Column:
    def place(c):
        scaled = F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c.cast("double") * float(scale)))
        return F.floor(scaled).cast("bigint") + F.lit(offset).cast("bigint")

    return F.transform(vector, place)


def row_matrix(rows: DataFrame, row: Column, entries: Column, n: int, width: int) -> IndexedRowMatrix:
    vectors = rows.select(row.alias("row"), array_to_vector(entries).alias("entries"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "entries"), n, width)


def rows_of(matrix: IndexedRowMatrix) -> DataFrame:
    """``row, entries`` (array of double), without a detour through Python objects."""
    found = callMLlibFunc("getIndexedRows", matrix._java_matrix_wrapper._java_model).toDF("row", "entries")
    return found.select("row", vector_to_array("entries").alias("entries"))


def components_of(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; the largest entry of each is positive."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    full = values > EMPTY * max(np.trace(covariance), 0.0)
    values, vectors = values[full], vectors[:, full]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return values, vectors * np.where(largest < 0, -1.0, 1.0)


def whiten(
    vectors: DataFrame, components: int = 8, scale: int = 1024, offset: int = 100_000,
    key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """Rows of ``WHITENED``: each usable vector along each of the first ``components`` components.

    ``explained`` is the component's share of the variance, ``identity_error`` the largest entry by
    which the covariance of all whitened values differs from the identity matrix.
    """
    spark = vectors.sparkSession
    grid = vectors.filter(usable(vector)).select(F.col(key).cast("bigint").alias("vec_id"), on_grid(vector, scale, offset).alias("x"))
    rows = numbered(grid, "grid")
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n or not width:
        return spark.createDataFrame([], WHITENED)
    zero = F.lit(offset).cast("bigint")
    x = F.concat("x", F.array_repeat(zero, F.lit(width) - F.size("x")))
    totals = dict(rows.select(F.posexplode(x)).groupBy("pos").agg(F.sum("col")).collect())  # one row per dimension
    # The mean as whole part and rest over n: what is left after the whole part is exact.
    whole, rest = zip(*(divmod(totals[i], n) for i in range(width)))
    wholes, rests = (F.lit(list(part)).cast("array<bigint>") for part in (whole, rest))
    centred = F.zip_with(F.zip_with(x, wholes, lambda a, b: a - b), rests, lambda a, b: a.cast("double") - b.cast("double") / float(n))
    blocks = row_matrix(rows, F.col("row"), centred, n, width).toBlockMatrix(BLOCK_ROWS, BLOCK_COLUMNS)
    scatter = _product(blocks.transpose(), blocks, -(-n // (BLOCK_ROWS * BLOCKS_A_TASK))).toLocalMatrix().toArray()
    values, axes = components_of(scatter / n, components)
    if not len(values):
        return spark.createDataFrame([], WHITENED)
    shares = values / (np.trace(scatter) / n)
    projected = stored(rows_of(blocks.multiply(_block_matrix(spark, axes / np.sqrt(values))).toIndexedRowMatrix()), "whitened")
    gram = row_matrix(projected, F.col("row"), F.col("entries"), n, len(values)).computeGramianMatrix().toArray()
    error = float(np.abs(gram / n - np.eye(len(values))).max())
    off = F.zip_with(F.zip_with(x, wholes, lambda a, b: a - b), rests, lambda a, b: F.try_subtract(F.try_multiply(F.lit(n), a), b))
    deviation = F.aggregate(off, F.lit(0).cast("bigint"), lambda total, d: F.try_add(total, F.try_multiply(d, d)))
    return (
        rows.select("row", "vec_id", deviation.alias("deviation")).join(projected, "row")
        .select("vec_id", "deviation", F.posexplode("entries").alias("at", "whitened"))
        .select(
            "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
            F.element_at(F.lit(shares.tolist()), F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
        )
    )


def _product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """Product whose middle dimension is dealt to ``splits`` tasks; Python's ``multiply`` has no such argument."""
    found = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(found, left.rowsPerBlock, right.colsPerBlock)


def _block_matrix(spark, local: np.ndarray) -> BlockMatrix:
    """A small local matrix as blocks that fit on the right of ``BLOCK_COLUMNS`` wide ones."""
    height, width = local.shape
    parts = [
        ((i, 0), Matrices.dense(len(part), width, part.ravel(order="F").tolist()))
        for i, start in enumerate(range(0, height, BLOCK_COLUMNS)) if len(part := local[start:start + BLOCK_COLUMNS])
    ]
    return BlockMatrix(spark.sparkContext.parallelize(parts, 1), BLOCK_COLUMNS, width, height, width)
