"""Exact and near duplicates of clips by content hash and bit fingerprint."""

from __future__ import annotations

from itertools import combinations, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echotable.functions.config import THRESHOLDS
from echotable.functions.scores import let
from echotable.operators.audio import confirm_pairs, images
from echotable.sources.scratch import Tables


def fingerprint(vector: Column) -> Column:
    """64-bit print of a vector: bit i is set where element i is over the median."""
    half = (F.size(vector) / 2).cast("int")
    middle = lambda s: (F.element_at(s, half) + F.element_at(s, half + 1)) / 2
    one = F.lit(1).cast("long")
    bit = lambda m: F.transform(vector, lambda x, i: F.when(x > m, F.call_function("shiftleft", one, i)).otherwise(F.lit(0).cast("long")))
    bits = let(F.array_sort(vector), lambda s: let(middle(s), bit))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def similarity(a: Column, b: Column) -> Column:
    """Share of equal bits of two 64-bit prints."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def exact_matches(batch: DataFrame, store: DataFrame, content: str, key: str) -> DataFrame:
    """``batch`` with ``duplicate_of``: the stored id of the same content, else the batch's first."""
    known = store.groupBy(content).agg(F.min(key).alias("_stored"))
    first = F.min(key).over(Window.partitionBy(content))
    j = batch.join(known, content, "left").withColumn("_first", first)
    return j.withColumn("duplicate_of", F.coalesce("_stored", F.when(F.col("_first") != F.col(key), F.col("_first")))).drop("_stored", "_first")


def near_matches(prints: DataFrame, key: str, print_col: str, least: float, shortlist: int) -> DataFrame:
    """``(key, near_key, similarity, place)``: up to ``shortlist`` earlier clips at least that similar, the nearest first.

    No pair is missed: prints of similarity ``least`` differ in ``d`` bits at most, so of ``d + 2`` bands
    two at least are equal, and each pair of bands is a join key. Equal prints are one class; only a
    class's ``shortlist`` smallest clips can be near matches of others, ties going to the smaller clip.
    ``least`` must leave bands of four bits or more (0.79). Rows with a null key or print are left out.
    """
    apart = int((1 - least) * 64 + 1e-9)
    bands = apart + 2
    if bands > 16:
        raise ValueError(f"a similarity of {least} is too low for bands of 64 bits")
    rows = prints.where(F.col(key).isNotNull() & F.col(print_col).isNotNull()).select(F.col(key).alias("clip"), F.col(print_col).alias("print")).distinct()
    cuts = [64 * i // bands for i in range(bands + 1)]
    word = [F.shiftrightunsigned("print", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in pairwise(cuts)]
    keys = F.array(*[F.struct(F.lit(i * bands + j).alias("at"), word[i].alias("x"), word[j].alias("y")) for i, j in combinations(range(bands), 2)])
    dealt = rows.select("print").distinct().select("print", F.explode(keys).alias("k"))
    score = similarity(F.col("print"), F.col("other"))
    near = dealt.join(dealt.select(F.col("print").alias("other"), "k"), "k").where((F.col("print") != F.col("other")) & (score >= least)).select("print", "other").distinct()
    near = near.unionByName(rows.select("print", F.col("print").alias("other")).distinct())
    first = Window.partitionBy("print").orderBy("clip")
    heads = rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= shortlist).select(F.col("print").alias("other"), F.col("clip").alias("near_key"))
    pairs = rows.join(near, "print").join(heads, "other").where("near_key < clip").select(F.col("clip").alias(key), "near_key", score.alias("similarity"))
    order = Window.partitionBy(key).orderBy(F.desc("similarity"), "near_key")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= shortlist)


def _bands(least: float):
    """Bands of a binary print as 64-bit values: two more than the bits in which prints of similarity ``least`` may differ."""

    @F.pandas_udf("array<long>")
    def run(prints: pd.Series) -> pd.Series:
        out = np.empty(len(prints), object)
        for size, rows in prints.groupby(prints.str.len()):
            bits, count = 8 * size, allowed_bits(8 * size, least) + 2
            rng = np.random.default_rng(bits)  # neighbouring bits are alike, so they are spread over the bands
            spread, weight = rng.permutation(bits), rng.integers(1, 2**63, bits, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            held = np.unpackbits(np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), size), axis=1)[:, spread]
            values = np.add.reduceat(held * weight, [bits * i // count for i in range(count)], axis=1)
            out[prints.index.get_indexer(rows.index)] = pd.Series(list(values.view(np.int64))).to_numpy()
        return pd.Series(out, prints.index)

    return run


def allowed_bits(bits: int, least: float) -> int:
    """Bits in which two prints of similarity ``least`` may differ at most; bands of fewer than six bits are refused."""
    apart = int((1 - least) * bits + 1e-9)
    if bits < 6 * (apart + 2):
        raise ValueError(f"a similarity of {least} is too low for bands of {bits} bits")
    return apart


def _keep_nearest(found: pd.DataFrame, shortlist: int) -> pd.DataFrame:
    found = found.drop_duplicates(["clip", "near_key"]).sort_values(["clip", "bits", "near_key"], kind="stable")
    return found[found.groupby("clip").cumcount() < shortlist]


def _nearest_of(least: float, shortlist: int, together: int = 1 << 19):
    """Nearest earlier clips of each clip among the prints of its lists; a group holds many short lists, or parts of long ones."""

    def pairs(length: np.ndarray):
        """Row numbers of all pairs within lists that follow each other, in pieces of about ``together``."""
        begin = np.repeat(np.cumsum(length) - length, length)
        later = np.repeat(length, length) - 1 - (np.arange(len(begin)) - begin)
        cut = np.searchsorted(np.cumsum(later), np.arange(together, later.sum() + together, together)) + 1
        low = 0
        for high in np.minimum(cut, len(later)).tolist():
            i = np.repeat(np.arange(low, high), later[low:high])
            yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later[low:high]) - later[low:high], later[low:high])
            low = high

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = pd.DataFrame({"clip": [], "near_key": [], "bits": [], "size": []}, dtype="int64")
        for size, part in pdf.groupby(pdf.print.str.len()):
            part = part.sort_values(["key", "a", "b"], kind="stable")
            length = part.groupby(["key", "a", "b"], sort=False).size().to_numpy()
            words = np.frombuffer(b"".join(x.ljust(-(-size // 8) * 8, b"\0") for x in part.print), np.uint64).reshape(len(part), -1)
            heads, most = part["heads"].to_numpy(), allowed_bits(8 * size, least)
            many = np.array([len(h) for h in heads])
            flat, start = np.concatenate(heads), np.cumsum(many) - many
            for i, j in pairs(length):
                bits = np.bitwise_count(words[i] ^ words[j]).sum(1, dtype=np.int64)
                near = np.flatnonzero(bits <= most)
                i, j, bits = np.append(i[near], j[near]), np.append(j[near], i[near]), np.tile(bits[near], 2)
                # every clip of i with every clip of j
                n = many[i] * many[j]
                nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                clip, other = flat[np.repeat(start[i], n) + nth // np.repeat(many[j], n)], flat[np.repeat(start[j], n) + nth % np.repeat(many[j], n)]
                early = other < clip
                found = pd.DataFrame({"clip": clip[early], "near_key": other[early], "bits": np.repeat(bits, n)[early], "size": size})
                kept = _keep_nearest(pd.concat([kept, found]), shortlist)
        return pd.DataFrame({"clip": kept["clip"], "near_key": kept["near_key"], "similarity": 1 - kept["bits"] / (8 * kept["size"])})

    return run


def near_prints(prints: DataFrame, key: str, print_col: str, least: float = THRESHOLDS["duplicate_detection"]["near_duplicate_similarity"], shortlist: int = THRESHOLDS["duplicate_detection"]["shortlist"], crowded: int = 256, block: int = 512) -> DataFrame:
    """``(key, near_key, similarity, place)``: up to ``shortlist`` earlier clips of most equal bits, by binary prints of any width.

    Multi-index hashing by which no pair is lost: prints that may differ in d bits are cut into d + 2 bands, so two
    bands at least are equal. A band's value is a key; where more than ``crowded`` prints share it, the key grows to
    two bands, both crowded. What is still longer is compared in pairs of blocks of ``block`` prints, each of
    which keeps only the nearest. Equal prints are one class, of which the ``shortlist`` smallest
    clips take part; its other clips are nearest to those. Ties go to the smaller clip; prints of different
    widths aren't compared; null keys and prints are left out, equal rows count once. Keys are whole numbers.
    """
    tables = Tables(prints.sparkSession, "prints")
    rows = tables.save(prints.where(F.col(key).isNotNull() & F.col(print_col).isNotNull() & (F.length(print_col) > 0)).select(F.col(key).cast("long").alias("clip"), F.col(print_col).alias("print")).distinct())
    nth = F.row_number().over(Window.partitionBy("print").orderBy("clip"))
    heads = rows.withColumn("nth", nth).where(F.col("nth") <= shortlist).groupBy("print").agg(F.array_sort(F.collect_list("clip")).alias("heads"))
    classes = tables.save(heads.withColumn("bands", _bands(least)("print")))

    def sized(keyed: DataFrame) -> DataFrame:
        """Members of keys that two prints share at least, with the number that share it."""
        return keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")

    one = classes.select("print", "heads", F.posexplode("bands").alias("band", "value")).withColumn("key", F.xxhash64(F.length("print"), "band", "value"))
    one = tables.save(sized(one))
    full = one.where(F.col("n") > crowded).groupBy("print").agg(F.first("heads").alias("heads"), F.array_sort(F.collect_list("key")).alias("keys"))
    pairs = F.flatten(F.transform("keys", lambda a: F.transform(F.filter("keys", lambda b: b > a), lambda b: F.xxhash64(a, b))))
    two = sized(full.select("print", "heads", F.explode(pairs).alias("key")))
    members = one.where(F.col("n") <= crowded).select("key", "print", "heads", "n").unionByName(two.select("key", "print", "heads", "n"))
    members = members.withColumn("blocks", F.ceil(F.col("n") / block)).withColumn("own", F.pmod(F.xxhash64("print", "key"), F.col("blocks")))
    met = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("key", "print", "heads", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    groups = max(1, one.count() // 8192)
    found = met.groupBy(F.pmod(F.xxhash64("key", "a", "b"), F.lit(groups)).alias("group")).applyInPandas(_nearest_of(least, shortlist), "clip long, near_key long, similarity double").distinct()
    own = classes.select(F.explode("heads").alias("clip"), "heads").select("clip", F.explode(F.filter("heads", lambda h: h < F.col("clip"))).alias("near_key"))
    later = rows.join(classes.select("print", "heads"), "print").where(~F.array_contains("heads", F.col("clip"))).select("clip", F.explode("heads").alias("near_key"))
    found = found.unionByName(own.unionByName(later).withColumn("similarity", F.lit(1.0)))
    place = F.row_number().over(Window.partitionBy("clip").orderBy(F.desc("similarity"), "near_key"))
    return found.withColumn("place", place).where(F.col("place") <= shortlist).withColumnRenamed("clip", key)


def confirmed_duplicates(clips: DataFrame, shortlisted: DataFrame, key: str, samples: str = "samples", rate: str = "rate", least: float = THRESHOLDS["duplicate_detection"]["spectral_match_min"], load=None) -> DataFrame:
    """``shortlisted`` with ``match``, ``confirmed`` and ``best``: the aligned correlation of each pair's log-mel images.

    Only clips on the shortlist are fetched from ``clips``, and only their images are stored. Where ``clips`` hold what
    samples are made or read from, ``load`` (rows to rows with ``samples`` and ``rate``) gives them: then pairs are
    loaded where they are compared, and neither samples nor images are stored or shuffled. ``best`` marks a clip's
    confirmed pair of highest match, the first placed of equals. A clip that ``clips`` lacks leaves its pairs out.
    """
    spark = clips.sparkSession
    named = shortlisted.select(F.col(key).alias("_clip"), "near_key", "similarity", "place")
    sides = (("_clip", "_a"), ("near_key", "_b"))
    if load is None:
        needed = named.select(F.col("_clip").alias(key)).union(named.select("near_key")).distinct()
        shown = images(clips.select(key, samples, rate), samples, rate).select(key, "image").join(needed, key, "left_semi")
        shown = Tables(spark, "shortlist").save(shown.where("image is not null"), long_rows=True)
        for name, side in sides:
            named = named.join(shown.select(F.col(key).alias(name), F.col("image").alias(side)), name)
    else:
        for name, side in sides:
            named = named.join(clips.select(F.col(key).alias(name), F.struct(*[F.col(f"`{c}`") for c in clips.columns]).alias(side)), name)
        # a few bytes make a whole recording: every core gets its share of the pairs
        named = named.repartition(4 * spark.sparkContext.defaultParallelism, "_clip", "near_key")
        for _, side in sides:
            others = [c for c in named.columns if c != side]
            named = images(load(named.select(*others, f"{side}.*")), samples, rate).select(*others, F.col("image").alias(side))
    out = Tables(spark, "matches").save(confirm_pairs(named, "_a", "_b", least).drop("_a", "_b"))
    first = F.row_number().over(Window.partitionBy("_clip").orderBy(F.desc("confirmed"), F.desc("match"), "place"))
    return out.withColumn("best", F.col("confirmed") & (first == 1)).withColumnRenamed("_clip", key)


def hard_negatives(queries: DataFrame, prints: DataFrame, key: str, print_col: str, group: str, top: int = 3) -> DataFrame:
    """``(key, other, similarity, place)``: the ``top`` prints of another group nearest to each query's.

    ``queries`` is a stated evaluation set, compared with all rows; each task keeps its own nearest
    before anything is shuffled.
    """
    q = queries.where(F.col(print_col).isNotNull()).select(F.col(key), F.col(print_col).alias("qp"), F.col(group).alias("qg"))
    rows = prints.where(F.col(print_col).isNotNull()).select(F.col(key).alias("other"), F.col(print_col).alias("op"), F.col(group).alias("og"))
    met = q.join(rows, F.col("qg") != F.col("og")).select(key, "other", similarity(F.col("qp"), F.col("op")).alias("similarity"))
    order = Window.partitionBy(key).orderBy(F.desc("similarity"), "other")
    return met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def evaluate_near(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """Recall of planted copies and false flags of hard negatives at each threshold.

    ``pairs``: similarity, is_copy, one row for every copy, found or not, and every negative.
    """
    grid = pairs.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    j = pairs.crossJoin(F.broadcast(grid))  # a fixed list of thresholds
    flagged = F.col("similarity") >= F.col("threshold")
    return j.groupBy("threshold").agg(
        (F.count_if(F.col("is_copy") & flagged) / F.greatest(F.lit(1), F.count_if("is_copy"))).alias("recall"), F.count_if(~F.col("is_copy") & flagged).alias("false_flags")
    )
