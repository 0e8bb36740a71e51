"""Stratified group folds: whole groups, each class spread evenly over the folds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echotable.functions import scores as S
from echotable.sources.scratch import Tables

#: Different class counts that one task deals; more are dealt in slices, each balanced in itself.
SIGNATURES = 10_000


def deal_signatures(counts: np.ndarray, groups: np.ndarray, k: int) -> list[list[int]]:
    """For each row of class counts, which ``groups[i]`` groups share, the folds of the groups that an even share leaves over.

    Rows of most uneven counts go first. A group goes to the fold after which the classes' shares of the folds vary
    least; of equals to the one of fewest clips, then the first.
    """
    total = np.maximum((counts * groups[:, None]).sum(0), 1)
    share = counts / total
    order = np.lexsort((np.arange(len(counts)), -counts.sum(1), -counts.std(1)))
    held, out = np.zeros((k, counts.shape[1])), [[] for _ in counts]
    for i in order:
        held += share[i] * (groups[i] // k)
        for _ in range(groups[i] % k):
            tried = held[None] + np.eye(k)[:, :, None] * share[i]
            spread = np.round(tried.std(1).mean(1), 12)
            fold = int(np.lexsort((np.arange(k), np.round(held.sum(1), 12), spread))[0])
            held[fold] += share[i]
            out[i].append(fold)
    return out


def stratified_folds(rows: DataFrame, group: str, class_col: str, k: int, seed: int = 42, signatures: int = SIGNATURES) -> DataFrame:
    """``rows`` with ``fold`` (0 to k - 1); all rows of a group have one.

    Groups with the same class counts are alike, so only the number of groups of each count vector is dealt: an even
    share to every fold, the rest one by one. A group's place among its like, in hash order, gives its fold; places are
    counted in 256 slices of the hash range. A null group or class is a group or class of its own.
    """
    tables = Tables(rows.sparkSession, "folds")
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    by = rows.groupBy(name(group).alias("_g"), name(class_col).alias("_c")).count()
    each = by.groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("_c", "count"))).alias("_like"))
    order = S.order_key(str(seed), F.col("_g"))
    each = tables.save(each.withColumn("_order", order).withColumn("_slice", F.substring("_order", 1, 2)))
    slices = tables.save(each.groupBy("_like", "_slice").agg(F.count("*").alias("n")))
    like = slices.groupBy("_like").agg(F.sum("n").alias("n"))
    parts = max(1, -(-like.count() // signatures))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[sorted(range(len(pdf)), key=lambda i: [(x["_c"], x["count"]) for x in pdf["_like"].iloc[i]])]
        classes = sorted({x["_c"] for v in pdf["_like"] for x in v})
        counts = np.zeros((len(pdf), len(classes)))
        for i, v in enumerate(pdf["_like"]):
            for x in v:
                counts[i, classes.index(x["_c"])] = x["count"]
        return pd.DataFrame({"_like": pdf["_like"], "even": pdf["n"] // k * k, "rest": deal_signatures(counts, pdf["n"].to_numpy(), k)})

    kind = "array<struct<_c:string,count:bigint>>"
    dealt = like.groupBy(F.pmod(F.xxhash64("_like"), F.lit(parts)).alias("part")).applyInPandas(lambda pdf: deal(pdf), f"_like {kind}, even long, rest array<int>")
    before = Window.partitionBy("_like").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    start = slices.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    nth = F.row_number().over(Window.partitionBy("_like", "_slice").orderBy("_order", "_g")) - 1
    placed = each.withColumn("nth", nth).join(start, ["_like", "_slice"]).join(dealt, "_like")
    at = F.col("start") + F.col("nth")
    fold = F.when(at < F.col("even"), at % k).otherwise(F.get("rest", (at - F.col("even")).cast("int"))).cast("int")
    return rows.withColumn("_g", name(group)).join(placed.select("_g", fold.alias("fold")), "_g").drop("_g")
