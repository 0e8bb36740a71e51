"""Substring search by an inverted index of trigrams, with a filter that verifies what it finds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids of one posting row, and the rarest trigrams of a text that are looked up.
BLOCK, RAREST = 1 << 16, 6


def _folded(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))


def _grams(text: Column) -> Column:
    """Distinct runs of three characters; none of a shorter text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def build(rows: DataFrame, key: str, columns: list[str], path: str) -> None:
    """Write the index of ``columns`` below ``path``: for each trigram its rows' keys, in blocks of ``BLOCK`` keys, and their number.

    ``key`` holds whole numbers, unique or not. Postings are range-partitioned and sorted by trigram, so a look-up reads
    the row groups of a few. A null text has no trigrams; a row with a null key isn't found.
    """
    grams = F.array_distinct(F.flatten(F.array(*[_grams(_folded(c)) for c in columns])))
    each = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.explode(grams).alias("gram"))
    blocks = each.groupBy("gram", F.floor(F.col("key") / BLOCK).alias("block")).agg(F.sort_array(F.collect_set("key")).alias("keys"))
    blocks.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.mode("overwrite").parquet(f"{path}/postings")
    postings = rows.sparkSession.read.parquet(f"{path}/postings")
    postings.groupBy("gram").agg(F.sum(F.size("keys")).alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/counts")


def candidates(spark: SparkSession, path: str, text: str) -> DataFrame | None:
    """``(key)`` of rows that hold the rarest trigrams of ``text``; None where it is shorter than one."""
    folded = text.lower()
    grams = sorted({folded[i : i + 3] for i in range(len(folded) - 2)})
    if not grams:
        return None
    counts = {r.gram: r.n for r in spark.read.parquet(f"{path}/counts").where(F.col("gram").isin(grams)).collect()}
    postings = spark.read.parquet(f"{path}/postings")
    if len(counts) < len(grams):
        return postings.where("false").select(F.explode("keys").alias("key"))
    rarest = sorted(grams, key=lambda g: (counts[g], g))[:RAREST]
    found = postings.where(F.col("gram").isin(rarest)).groupBy("block").agg(F.collect_list("keys").alias("lists")).where(F.size("lists") == len(rarest))
    met = F.aggregate(F.slice("lists", 2, len(rarest)), F.element_at("lists", 1), lambda a, b: F.array_intersect(a, b))
    return found.select(F.explode(met).alias("key"))


def containing(rows: DataFrame, key: str, columns: list[str], text: str, path: str) -> DataFrame:
    """``rows`` of which one of ``columns`` contains ``text``, whatever the case, by the index of those columns at ``path``.

    Texts of fewer than three characters have no trigram and are sought by a scan. An empty text is in every row that
    has a column that isn't null.
    """
    hit = reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())) for c in columns])
    some = candidates(rows.sparkSession, path, text)
    if some is not None:
        rows = rows.join(some.select(F.col("key").alias("_key")).distinct(), F.col(key).cast("long") == F.col("_key"), "left_semi")
    return rows.where(F.coalesce(hit, F.lit(False)))
