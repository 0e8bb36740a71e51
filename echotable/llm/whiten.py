"""Embedding whitening by distributed block matrices of Spark's MLlib.

1. Entries become whole numbers, whose sums by dimension are exact. A table of the rows is written once, each
   with a dense index.
2. The centred rows, indexed, form a ``BlockMatrix``; its transpose times itself is the scatter matrix, in
   parts of ``SPLIT`` blocks each, which are added up.
3. ``eigh`` of the covariance on the driver (one matrix of the vectors' width) gives the whitening matrix, and a
   second block product projects all rows.
4. The whitened rows' own covariance is taken in the same way, as a check of the result.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotable.llm.storage import Scratch

#: Blocks whose products one task adds up.
SPLIT = 32


def whole_numbers(vector: Column, scale: int = 64, shift: int = 1_000_000) -> Column:
    """``floor(scale * c) + shift`` of each entry c as a double; null where the vector is null, or holds a null, a NaN, an infinity or an entry that no long holds."""
    scaled = F.transform(vector, lambda c: c.cast("double") * scale)
    bad = F.exists(scaled, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= float(1 << 62)))
    return F.when(vector.isNotNull() & ~bad, F.transform(scaled, lambda c: F.floor(c) + F.lit(shift).cast("long")))


def dense_index(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows``, written once, with ``index``: 0, 1, ... without gaps; one count of each task comes to the driver."""
    marked = scratch.save(rows.withColumn("at", F.monotonically_increasing_id()))
    counts = sorted(map(tuple, marked.groupBy(F.shiftright("at", 33).alias("part")).count().collect()))
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    begin = rows.sparkSession.createDataFrame(starts, "part long, begin long")
    local = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.join(F.broadcast(begin), F.shiftright("at", 33) == F.col("part")).withColumn("index", F.col("begin") + local).drop("at", "part", "begin")


def blocks(rows: DataFrame, values: Column, n: int, width: int, height: int) -> BlockMatrix:
    """Rows ``(index, values)`` as blocks of ``height`` rows over the whole width."""
    indexed = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(values).alias("vector")), "vector")
    return IndexedRowMatrix(indexed, n, width).toBlockMatrix(height, width)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """The matrix transposed times itself; no task holds more than ``SPLIT`` blocks."""
    parts = -(-matrix.numRowBlocks // SPLIT)
    out = matrix.transpose()._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(out, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def whitened_rows(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = 32, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``(id, deviation, whitened array, explained array, n, identity_error)`` of each usable row.

    Left out are rows whose vector is null, empty, or holds null, non-finite or unrepresentably large entries, and rows
    of another width than the commonest (of equals, the smallest). Repeated rows and ids count each; a null id stays.
    Components are numbered by falling eigenvalue, at most ``most``. One whose eigenvalue is zero within
    rounding has null whitened values, and is left out of ``identity_error``; with no spread at all ``explained`` and
    ``identity_error`` are null. ``deviation`` raises where it exceeds a long. No usable row: no rows. The
    eigenvectors take one dense matrix of the vectors' width on the driver.
    """
    scratch = Scratch(vectors.sparkSession, "whiten")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), whole_numbers(F.col(f"`{vec_col}`"), scale, shift).alias("x")).where(F.size("x") > 0)
    empty = "deviation long, whitened array<double>, explained array<double>, n long, identity_error double"
    widths = rows.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if widths is None:
        kind = vectors.schema[id_col].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"id {kind}, {empty}")
    d = widths.w
    rows = dense_index(rows.where(F.size("x") == d), scratch)
    got = rows.agg(F.count("*"), *[f(F.col("x")[i]) for f in (F.sum, F.min, F.max) for i in range(d)]).first()
    n, sums, low, high = got[0], got[1 : d + 1], got[d + 1 : 2 * d + 1], got[2 * d + 1 :]
    # n times the distance from the mean, a whole number
    apart = F.zip_with("x", F.array(*[F.lit(int(s)) for s in sums]), lambda x, s: x * F.lit(n) - s)
    far = sum(max(n * b - s, s - n * a) ** 2 for s, a, b in zip(sums, low, high))
    kind = "long" if far < 1 << 63 else "decimal(38,0)"
    square = F.aggregate(F.transform(apart, lambda v: v.cast(kind)), F.lit(0).cast(kind), lambda a, v: (a + v * v).cast(kind))
    height = min(65_536, max(1024, n // 65_536))
    matrix = blocks(rows, F.transform(apart, lambda v: v.cast("double") / n), n, d, height)
    cov = scatter(matrix) / n
    e, vectors_of = np.linalg.eigh((cov + cov.T) / 2)
    k = min(most, d)
    e, basis = e[::-1][:k], vectors_of[:, ::-1][:, :k]
    live = e > max(float(e[0]), 0.0) * d * 1e-15
    project = basis[:, live] / np.sqrt(e[live])
    explained = [float(v) for v in e / np.trace(cov)] if np.trace(cov) > 0 else [None] * k
    deviation = rows.select("index", "id", square.cast("long").alias("deviation"))
    if not live.any():
        return deviation.select(
            "id", "deviation", F.array_repeat(F.lit(None).cast("double"), k).alias("whitened"), F.array(*[F.lit(v).cast("double") for v in explained]).alias("explained"),
            F.lit(n).cast("long").alias("n"), F.lit(None).cast("double").alias("identity_error"),
        )
    m = project.shape[1]
    by = BlockMatrix(vectors.sparkSession.sparkContext.parallelize([((0, 0), Matrices.dense(d, m, project.flatten("F").tolist()))], 1), d, m)
    out = matrix.multiply(by).toIndexedRowMatrix()
    out = MLUtils.convertVectorColumnsToML(callMLlibFunc("getIndexedRows", out._java_matrix_wrapper._java_model), "vector")
    out = scratch.save(out.select("index", vector_to_array("vector").alias("z")))
    mean = out.agg(*[F.avg(F.col("z")[i]) for i in range(m)]).first()
    centred = F.zip_with("z", F.array(*[F.lit(v) for v in mean]), lambda z, v: z - v)
    error = float(np.abs(scatter(blocks(out, centred, n, m, height)) / n - np.eye(m)).max())
    place = np.cumsum(live).tolist()
    padded = F.array(*[F.col("z")[p - 1] if on else F.lit(None).cast("double") for p, on in zip(place, live.tolist())])
    return deviation.join(out, "index").select(
        "id", "deviation", padded.alias("whitened"), F.array(*[F.lit(v).cast("double") for v in explained]).alias("explained"),
        F.lit(n).cast("long").alias("n"), F.lit(error).alias("identity_error"),
    )


def whitened_components(vectors: DataFrame, **options) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``: one row for each row and component of ``whitened_rows``."""
    rows = whitened_rows(vectors, **options)
    long = rows.select("*", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "v"))
    return long.select("id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("v.whitened").alias("whitened"), F.col("v.explained").alias("explained"), "identity_error")
