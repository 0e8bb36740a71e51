"""Approximate nearest neighbours by NN-descent and greedy graph search.

1. Equal vectors form a class. Classes are dealt by hash into shards of a bounded number of nodes;
   each shard holds a graph of its own, so no group grows with the table.
2. Every node starts with ``k`` random neighbours. In each round a Spark join brings every node the
   neighbours of its neighbours, in both directions; a node keeps the ``k`` nearest it has seen.
3. Each query runs a greedy search with a beam in each shard's graph, by blocks of queries. The best
   of all shards are ranked by cosine in doubles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echotable.llm.storage import Scratch
from echotable.llm.vectors import cosines, matrix, unit, usable

#: Nodes of a shard, on average, and queries of a block.
SHARD, QUERIES = 4096, 512
_GRAPH = "shard long, node int, rep long, v binary, near array<int>"


def _start(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", kind="stable").reset_index(drop=True)
        n, rng = len(pdf), np.random.default_rng(11)
        near = [np.setdiff1d(rng.integers(0, n, k), [i]).astype(np.int32) for i in range(n)]
        return pd.DataFrame({"shard": pdf.shard, "node": np.arange(n, dtype=np.int32), "rep": pdf.rep, "v": pdf.v, "near": near})

    return run


def _vectors(pdf: pd.DataFrame) -> np.ndarray:
    """Unit rows in single precision; vectors of other widths than the commonest get zeros beside it."""
    width = pdf.v.str.len().max() // 8
    out = np.zeros((len(pdf), width), np.float32)
    for dim, rows in pdf.groupby(pdf.v.str.len()).indices.items():
        out[rows, : dim // 8] = unit(matrix(pdf.v.iloc[rows]))
    return out


def _improve(k: int):
    """Keep of each node's candidates the nearest k."""

    def run(seen: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        graph = graph.sort_values("node", kind="stable").reset_index(drop=True)
        x, near = _vectors(graph), list(graph.near)
        for u, candidates in zip(seen.u, seen.candidates):
            c = np.unique(np.concatenate([candidates, near[u]]))
            c = c[c != u]
            if len(c):
                s = x[c] @ x[u]
                near[u] = c[np.argsort(-s, kind="stable")[:k]].astype(np.int32)
        return graph.assign(near=near)

    return run


def _apart(df: DataFrame) -> DataFrame:
    """The same rows under columns of their own, to meet a frame that was made from ``df``."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def descend(graph: DataFrame, scratch: Scratch, k: int, rounds: int) -> DataFrame:
    """The graph after ``rounds`` joins of neighbours of neighbours."""
    for _ in range(rounds):
        out = graph.select("shard", F.col("node").alias("u"), F.explode("near").alias("v"))
        both = out.union(out.select("shard", "v", "u").toDF("shard", "u", "v"))
        hops = both.join(graph.select("shard", F.col("node").alias("v"), F.concat("near", F.array("node")).alias("next")), ["shard", "v"])
        seen = hops.groupBy("shard", "u").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("candidates"))
        after = scratch.save(seen.groupBy("shard").cogroup(_apart(graph).groupBy("shard")).applyInPandas(_improve(k), _GRAPH))
        scratch.drop(graph)
        graph = after
    return graph


def greedy(x: np.ndarray, links: list[np.ndarray], query: np.ndarray, beam: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes seen by a greedy search, nearest first, and their scores to six places, equal ones by node.

    The ``width`` best unexpanded nodes of the beam are expanded until the whole beam is expanded.
    """
    n = len(x)
    score = np.full(n, -np.inf, np.float32)
    near = lambda nodes: np.round(x[nodes] @ query, 6)
    found = np.arange(0, n, max(1, n // 32))
    score[found] = near(found)
    expanded = np.zeros(n, bool)
    while True:
        found = found[np.lexsort((found, -score[found]))]
        top = found[:beam]
        top = top[~expanded[top]][:width]
        if not len(top):
            return found, score[found]
        expanded[top] = True
        fresh = np.unique(np.concatenate([links[t] for t in top]))
        fresh = fresh[np.isneginf(score[fresh])]
        score[fresh] = near(fresh)
        found = np.concatenate([found, fresh])


def _search(top: int, beam: int, width: int):
    def run(queries: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "rep": pd.Series(dtype="int64"), "v": pd.Series(dtype=object), "score": pd.Series(dtype=float)})
        if not len(queries) or not len(graph):
            return empty
        graph = graph.sort_values("node", kind="stable").reset_index(drop=True)
        x = _vectors(graph)
        src = np.repeat(np.arange(len(graph)), [len(a) for a in graph.near])
        dst = np.concatenate([*graph.near, np.zeros(0, np.int32)]).astype(np.int64)
        order = np.argsort(np.concatenate([src, dst]), kind="stable")
        ends, starts = np.concatenate([dst, src])[order], np.searchsorted(np.concatenate([src, dst])[order], np.arange(len(graph) + 1))
        links = [ends[starts[i] : starts[i + 1]] for i in range(len(graph))]
        out = [empty]
        for qid, v in zip(queries.query_id, queries.qv):
            q = unit(matrix([v]))[0].astype(np.float32)
            seen, score = greedy(x[:, : len(q)] if len(q) <= x.shape[1] else np.pad(x, ((0, 0), (0, len(q) - x.shape[1]))), links, q, beam, width)
            fits = graph.v.str.len().to_numpy()[seen] == len(v)
            seen, score = seen[fits], score[fits]
            if not len(seen):
                continue
            # all that could be among the nearest once scores are exact
            best = graph.iloc[seen[score >= score[min(top, len(seen)) - 1] - 5e-6]]
            exact = cosines(matrix(best.v), matrix([v]))
            pick = np.lexsort((best.rep.to_numpy(), -exact))[:top]
            out.append(pd.DataFrame({"query_id": qid, "rep": best.rep.to_numpy()[pick], "v": best.v.to_numpy()[pick], "score": exact[pick]}))
        return pd.concat(out)

    return run


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    top: int = 5,
    k: int = 16,
    rounds: int = 5,
    beam: int = 192,
    width: int = 16,
) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``top`` nearest found of each query, itself excepted.

    Unusable vectors take no part, as rows or as queries; rows and queries with a null id neither.
    Equal scores are ranked by id. Repeated rows of one id count once. Vectors meet only those of
    their width. An empty table gives an empty result.
    """
    scratch = Scratch(vectors.sparkSession, "ann")
    rows = scratch.save(usable(vectors, id_col, vec_col).distinct())
    asked = usable(queries, id_col, vec_col).distinct().select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    first = Window.partitionBy("v").orderBy("id")
    members = scratch.save(rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= top + 1))
    classes = members.where("nth = 1").select(F.col("id").alias("rep"), "v")
    n = classes.count()
    shards = max(1, -(-n // SHARD))
    graph = classes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards))).groupBy("shard").applyInPandas(_start(k), _GRAPH)
    graph = descend(scratch.save(graph), scratch, k, rounds)

    blocks = max(1, -(-asked.count() // QUERIES))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks))).withColumn("shard", upto(shards))
    copies = _apart(graph).withColumn("block", upto(blocks))
    found = dealt.groupBy("shard", "block").cogroup(copies.groupBy("shard", "block")).applyInPandas(_search(top + 1, beam, width), "query_id long, rep long, v binary, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    found = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= top + 1).drop("nth")
    named = found.join(members.select("v", "id"), "v").where("id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "id", "score")
