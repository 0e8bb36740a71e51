"""Exact order statistics and as-of lookups over groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echotable.sources.scratch import Tables

#: Bins that one round cuts a range into, and values that a last bin may hold to be sorted.
BINS, SORTED = 1024, 10_000


def _same(a: DataFrame, b: DataFrame, by: list[str]) -> Column:
    return reduce(lambda p, q: p & q, [a[c].eqNullSafe(b[c]) for c in by], F.lit(True))


def at_ranks(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Column], bins: int = BINS, most: int = SORTED) -> DataFrame:
    """``(*by, name, n, value)``: for each name the value at a rank (from 1) of its group's values in ascending order.

    A rank is an expression of ``n``, the group's number of values. Distributed selection: counts of range
    bins, summed before the shuffle, tell the bin that holds the rank; that bin is cut again until it holds one value or
    at most ``most``, which are then sorted. No task sees a whole group. Null and NaN values are left out,
    groups without others have no row; nulls in ``by`` are a group.
    """
    tables = Tables(rows.sparkSession, "ranks")
    v = F.col(value).cast("double")
    base = tables.save(rows.where(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("_v")))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), at.cast("long").alias("rank")) for name, at in ranks.items()])).alias("x")
    state = base.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    state = state.select(*by, "n", "lo", "hi", F.col("n").alias("inside"), each).select(*by, "n", "lo", "hi", "inside", "x.*").where("rank between 1 and n")
    state = tables.save(state)
    wide = (F.col("inside") > most) & (F.col("lo") < F.col("hi"))
    while not state.where(wide).isEmpty():
        open_ = state.where(wide)
        inside = base.join(open_, _same(base, open_, by)).where("_v between lo and hi").drop(*[base[c] for c in by])
        # the first bin holds lo and the last one hi, so every round cuts something off; halves keep a vast width finite
        share = lambda by: (F.col("_v") / by - F.col("lo") / by) / (F.col("hi") / by - F.col("lo") / by)
        part = F.when(F.col("hi") - F.col("lo") == float("inf"), share(2)).otherwise(share(1))
        counts = inside.groupBy(*by, "name", "n", "rank", F.least(F.floor(part * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("inside"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = F.sum("inside").over(Window.partitionBy(*by, "name").orderBy("bin"))
        found = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("inside") < F.col("rank")))
        found = found.withColumn("rank", F.col("rank") - F.col("upto") + F.col("inside"))
        state = tables.save(state.where(~wide).unionByName(found.select(*state.columns)))
    done = state.where("lo = hi").select(*by, "name", "n", F.col("lo").alias("value"))
    few = state.where("lo < hi")
    inside = base.join(few, _same(base, few, by)).where("_v between lo and hi").drop(*[base[c] for c in by])
    nth = F.row_number().over(Window.partitionBy(*by, "name").orderBy("_v"))
    return done.unionByName(inside.withColumn("nth", nth).where("nth = rank").select(*by, "name", "n", F.col("_v").alias("value")))


def summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """``(by, n, median, p95, max)``: the 95th percentile is the nearest rank, rounded half up."""
    n = F.col("n")
    ranks = {"low": F.ceil(n / 2), "high": F.floor(n / 2) + 1, "p95": F.greatest(F.lit(1), F.floor(n * 0.95 + 0.5)), "max": n}
    at = at_ranks(rows, [by], value, ranks)
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    return at.groupBy(by).agg(F.max("n").alias("n"), ((of("low") + of("high")) / 2).alias("median"), of("p95").alias("p95"), of("max").alias("max"))


def as_of(asked: DataFrame, known: DataFrame, by: list[str], asked_at: str, known_at: str, columns: list[str], tie: str, bucket_rows: int = 50_000) -> DataFrame:
    """``asked`` with ``columns`` of the latest row of ``known`` of the same key at or before its time; nulls where there is none.

    Both sides are put in time buckets, so that a busy key is many tasks' work: within a bucket the last known row
    is carried forward, and what a bucket begins with is the last known row of earlier buckets, of which each key has one.
    Buckets are even in time, about one for each ``bucket_rows`` rows. Of equal times the largest ``tie`` holds. Rows
    with a null key or time find nothing.
    """
    tables = Tables(asked.sparkSession, "asof")
    time = lambda c: F.col(c).cast("timestamp")
    names = asked.columns
    a = asked.withColumn("_row", F.struct(*names)).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], time(asked_at).alias("_t"), "_row")
    k = known.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], time(known_at).alias("_t"), F.struct(F.col(tie).alias("_tie"), *columns).alias("_known"))
    keys = [f"_k{i}" for i in range(len(by))]
    usable = reduce(lambda p, q: p & q, [F.col(c).isNotNull() for c in [*keys, "_t"]])
    both = tables.save(a.unionByName(k.where(usable), allowMissingColumns=True))
    n, low, high = both.where(usable).agg(F.count("*"), F.min(F.unix_micros("_t")), F.max(F.unix_micros("_t"))).first()
    width = max(1, ((high or 0) - (low or 0)) // max(1, n // bucket_rows) + 1)
    both = both.withColumn("_b", F.floor((F.unix_micros("_t") - (low or 0)) / width))
    order = Window.partitionBy(*keys, "_b").orderBy("_t", F.col("_row").isNotNull(), "_known._tie")
    within = both.withColumn("_here", F.last("_known", True).over(order))
    ends = both.where("_known is not null").groupBy(*keys, "_b").agg(F.max_by("_known", F.struct("_t", "_known._tie")).alias("_end"))
    wanted = both.where(F.col("_row").isNotNull() & usable).select(*keys, "_b").distinct().join(ends, [*keys, "_b"], "full")
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = wanted.withColumn("_before", F.last("_end", True).over(before)).select(*keys, "_b", "_before")
    out = within.where("_row is not null").join(carried, [*keys, "_b"], "left").withColumn("_found", F.when(usable, F.coalesce("_here", "_before")))
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in names], *[F.col(f"_found.`{c}`").alias(c) for c in columns])
