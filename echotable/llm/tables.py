"""Small tables of fixed size, filled by each task and added up in a tree."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Arrays that one group adds up.
FAN_IN = 64


def add_arrays(parts: DataFrame, dtype: str, most: int | None = None) -> dict[int, np.ndarray]:
    """Sum of the arrays in ``(part int, task long, counts binary)`` by part, kept at or below ``most``.

    Arrays of one part have one length. They are added ``FAN_IN`` at a time, so no group grows with
    the number of tasks; what comes to the driver is one array for each part.
    """

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(pdf.counts.iloc[0]) // np.dtype(dtype).itemsize, np.int64)
        for c in pdf.counts:
            total += np.frombuffer(c, dtype)
        if most is not None:
            total = np.minimum(total, most)
        return pd.DataFrame({"part": pdf.part.iloc[:1], "task": pdf.task.iloc[:1] // FAN_IN, "counts": [total.astype(dtype).tobytes()]})

    tasks = (parts.agg(F.max("task")).first()[0] or 0) + 1
    for _ in range(max(1, math.ceil(math.log(tasks, FAN_IN)))):
        parts = parts.groupBy("part", F.expr(f"task div {FAN_IN}")).applyInPandas(add, "part int, task long, counts binary")
    return {r.part: np.frombuffer(r.counts, dtype) for r in parts.collect()}


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names for own use that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def map_in_arrow(rows: DataFrame, run, more: list[tuple[str, str]]) -> DataFrame:
    """``rows`` with the columns ``more`` (name, type), made by ``run`` from batches of arrays: it yields the arrays of both.

    Columns go by plain names on the way, as Spark takes a dot in a name for a field.
    """
    names = [f"c{i}" for i in range(len(rows.columns) + len(more))]
    kinds = [f.dataType.simpleString() for f in rows.schema] + [kind for _, kind in more]

    def plain(batches):
        for batch in batches:
            for arrays in run(batch):
                yield pa.RecordBatch.from_arrays(arrays, names)

    out = rows.toDF(*names[: len(rows.columns)]).mapInArrow(plain, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    return out.toDF(*rows.columns, *[name for name, _ in more])


def hits(rows: DataFrame, id_col: str, ids: DataFrame, flag: str = "hit", bits: int = 24) -> DataFrame:
    """``rows`` with the column ``flag``, which ``rows`` must not have: false only where the id isn't in the one column of ``ids``.

    The ids are set in a bitmap of ``2 ** bits`` bits, whatever their number, which is broadcast; it
    spares rows a shuffle and decides nothing.
    """
    slot, part, held = free_names(rows, "slot", "part", "held")
    place = F.pmod(F.col(ids.columns[0]), F.lit(1 << bits))
    bitmap = ids.select(place.alias("x")).groupBy(F.expr("x div 32768").alias(part)).agg(F.expr("bitmap_construct_agg(x % 32768)").alias(held))
    at = F.pmod(F.col(id_col).cast("long"), F.lit(1 << bits))
    joined = rows.withColumn(slot, at).join(F.broadcast(bitmap), F.expr(f"`{slot}` div 32768") == F.col(part), "left")
    byte = F.conv(F.hex(F.substring(F.col(held), F.expr(f"cast(`{slot}` % 32768 div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("long")
    hit = F.getbit(byte, F.expr(f"cast(`{slot}` % 8 as int)")) == 1
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(hit, F.lit(False)).alias(flag))
