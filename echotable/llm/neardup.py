"""Embedding near-duplicates by spherical k-means cells.

1. Equal vectors of one label form a class, and one of them stands for it.
2. Spherical k-means is fitted on a bounded sample (``sample_rows``). A pair meets in the cell of its midpoint, the
   one whose centre is nearest: two unit vectors of cosine c are ``sqrt(2 - 2c)`` apart, so the midpoint is within half of
   that of both, and a vector goes to each cell whose bisector is within that half. No pair is lost at a border.
3. A cell of one label is cut into blocks of bounded size. Each pair of blocks is one task's matrix
   product; it returns the number of partners of each vector, and links only as stars. Vectors are dealt to the pairs of blocks
   in rounds, each of which deals about ``DEALT`` rows a vector and leaves nothing but what it found, so that disk stays in
   proportion to the table where cells overlap or the work is quadratic.
4. Of each connected group the smallest id is kept.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from echotable.llm.components import connected_components
from echotable.llm.storage import Scratch
from echotable.llm.vectors import matrix, unit, usable

#: Vectors of one block, and of a slice of it that is multiplied at once; rows that a round deals for each vector.
BLOCK, SLICE, DEALT = 8192, 512, 4


def _as_floats(v: str) -> Column:
    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: np.frombuffer(x, np.float64).astype(np.float32).tobytes())

    return run(v)


def spherical_kmeans(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centres, from unit rows; started from evenly spaced rows."""
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(rounds):
        cell = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres)
    return centres


def _rows(blobs, narrow: bool) -> np.ndarray:
    """Unit rows of packed vectors."""
    return unit(np.frombuffer(b"".join(blobs), np.float32).reshape(len(blobs), -1).astype(np.float64) if narrow else matrix(blobs))


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Number of the centre nearest to each row, the same for a row in whatever company."""
    return np.einsum("ij,kj->ik", x, c).argmax(1)


def _deal(shared, reach: float, narrow: bool, only: tuple[str, ...]):
    """A row of each vector for each cell in which a pair's midpoint may lie; cells of one width are numbered together."""

    def run(pdfs):
        centres = shared.value
        for pdf in pdfs:
            if not len(pdf):
                continue
            out = []
            for size, part in pdf.groupby(pdf.v.str.len()):
                dim = size // (4 if narrow else 8)
                c = centres.get(dim)
                if c is None:  # no sample row of this width: one cell
                    out.append(part.assign(cell=dim * 4096))
                    continue
                near = _rows(part.v, narrow) @ c.T
                own = near.argmax(1)
                apart = np.sqrt(np.maximum(0.0, 2 - 2 * np.clip(c @ c.T, -1, 1)))
                visit = near[np.arange(len(near)), own][:, None] - near <= reach * apart[own] + 1e-9
                visit[np.arange(len(near)), own] = True
                row, cell = np.nonzero(visit)
                out.append(part.iloc[row].assign(cell=cell + dim * 4096))
            yield pd.concat(out)[[*only, "cell"]]

    return run


def _block_pair(threshold: float, shared, narrow: bool):
    """Partner counts and stars of one pair of blocks; a pair counts in the cell of its midpoint."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids, block = _rows(pdf.v, narrow), pdf.id.to_numpy(), pdf.block.to_numpy()
        found = []
        for lo in range(0, len(x), SLICE):
            i, j = np.nonzero(x[lo : lo + SLICE] @ x[lo:].T >= threshold - 1e-12)
            found.append(np.stack([i, j])[:, j > i] + lo)
        i, j = np.concatenate(found, axis=1)
        exact = np.concatenate([np.zeros(0, bool), *((x[i[k : k + 65536]] * x[j[k : k + 65536]]).sum(1) >= threshold for k in range(0, len(i), 65536))])
        i, j = i[exact], j[exact]
        if pdf.bi.iloc[0] != pdf.bj.iloc[0]:
            i, j = i[block[i] != block[j]], j[block[i] != block[j]]
        c, cell = shared.value.get(x.shape[1]), int(pdf.cell.iloc[0]) % 4096
        if c is not None and len(c) > 1:
            mine = np.concatenate([np.zeros(0, bool), *(_nearest(x[i[k : k + 65536]] + x[j[k : k + 65536]], c) == cell for k in range(0, len(i), 65536))])
            i, j = i[mine], j[mine]
        m = pdf.m.to_numpy()
        count = np.bincount(i, m[j], len(ids)) + np.bincount(j, m[i], len(ids))
        label = ids.copy()
        while True:
            before = label.copy()
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            if (label == before).all():
                break
        some = count > 0
        return pd.DataFrame({"id": ids[some], "links": count[some].astype(np.int64), "star": label[some]})

    return run


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    sample_rows: int = 16_384,
    cell_rows: int = 4096,
    max_cells: int = 256,
) -> DataFrame:
    """``(id, n_links, component_id, kept)`` of each vector; partners have its label.

    Unusable vectors and those without a label link with nothing and are kept. Rows with a null id are
    left out; equal rows count once; rows of one id with different vectors add up
    their links. Vectors of different
    width link with none of another width. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neardup")
    # floats are packed as floats: nothing is lost, and they are half as long
    element = vectors.schema[vec_col].dataType.elementType
    narrow = isinstance(element, FloatType)
    rows = usable(vectors, id_col, vec_col, F.col(label_col).alias("label")).where("label is not null")
    rows = scratch.save(rows.withColumn("v", _as_floats("v")) if narrow else rows)
    classes = scratch.save(rows.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("m")))
    n = classes.count()
    sample = classes.select("v", F.xxhash64("v").alias("k")).where(F.pmod("k", F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_rows / max(1, n))))
    by_width: dict[int, list] = {}
    for r in sample.collect():  # about sample_rows vectors
        by_width.setdefault(len(r.v) // (4 if narrow else 8), []).append(bytes(r.v))
    cells = max(1, min(max_cells, n // cell_rows))
    centres = {w: spherical_kmeans(_rows(sorted(v), narrow), min(cells, len(v))) for w, v in by_width.items()}
    shared = spark.sparkContext.broadcast(centres)
    reach = math.sqrt(2 - 2 * threshold) / 2

    kind = vectors.schema[label_col].dataType.simpleString()
    placed = classes.select(F.col("rep").alias("id"), "label", "v", "m")
    size = placed.mapInPandas(_deal(shared, reach, narrow, ("label",)), f"label {kind}, cell long").groupBy("label", "cell").count()
    size = scratch.save(size.select("label", "cell", "count", F.ceil(F.col("count") / BLOCK).alias("blocks")))
    dealt = size.agg(F.sum(F.col("count") * F.col("blocks"))).first()[0] or 0
    rounds = max(1, -(-int(dealt) // max(1, DEALT * n)))
    # cells of one block aren't looked up: the others are few, one at most for every BLOCK rows dealt
    large = F.broadcast(size.where("blocks > 1").select("label", "cell", "blocks"))
    found = None
    for turn in range(rounds):
        met = placed.mapInPandas(_deal(shared, reach, narrow, ("id", "label", "v", "m")), f"id long, label {kind}, v binary, m long, cell long")
        met = met.join(large, ["label", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        met = met.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        # block b meets every block: as the pair (min, max)
        met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        met = met.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
        met = met.where(F.pmod(F.xxhash64("label", "cell", "bi", "bj"), F.lit(rounds)) == turn)
        met = met.select("id", "label", "v", "m", "cell", "block", "bi", "bj").groupBy("label", "cell", "bi", "bj")
        part = scratch.save(met.applyInPandas(_block_pair(threshold, shared, narrow), "id long, links long, star long"))
        found = part if found is None else found.union(part)
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select("id", "star"), scratch, "id", "star")
    classes = classes.join(counts, F.col("rep") == F.col("id"), "left").join(groups, F.col("rep") == F.col("node"), "left")
    classes = classes.select("label", "v", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    linked = rows.select("id", "label", "v").distinct().join(classes, ["label", "v"]).groupBy("id").agg(F.sum("links").alias("n_links"), F.min("component").alias("component"))
    every = vectors.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct().join(linked, "id", "left")
    component = F.coalesce("component", "id")
    return every.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))
