"""Approximate nearest neighbours with a permutation index, by largest inner product.

A vector is represented by the order of its nearest pivots, cut after `PREFIX` of them. Each block of the table holds
inverted files: for each pivot the vectors that have it in their order, with its place. A query's order meets only the
files of its own pivots, and the footrule distance between two orders (a missing pivot stands at the place after the
last) is its value for disjoint orders less what each common pivot saves. Candidates are ranked by footrule; the best
`RERANK` of each block are ranked anew by their exact inner products in double precision.

Every usable row is indexed; only the pivots are a bounded sample. Blocks of rows and of queries are bounded, so a task's memory does not
grow with the table. Vectors that are null, zero or hold null or non-finite components take no part, nor do those of
unusual length (of the lengths that occur, the one that most vectors have counts). Ties go to the smaller id. Rows that share the query's id are its own and no candidates. With too few
candidates there are fewer neighbours; an empty table gives no rows. Null ids take no part.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from envatlas.llm.vectors import usable, usual_length

PIVOTS = 512
PREFIX = 64
#: Of each block's rows the share that is ranked anew, at every size of input.
RERANK = 0.2
BLOCK = 1 << 16
LEAST_BLOCKS = 12


def orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """For each vector the indices of its `prefix` pivots of largest inner product, nearest first."""
    near = vectors @ pivots.T
    top = np.argpartition(-near, prefix - 1, axis=1)[:, :prefix] if prefix < near.shape[1] else np.broadcast_to(np.arange(near.shape[1]), near.shape)
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable"), axis=1)


class InvertedFiles:
    """Of each pivot, the rows that have it in their order and at which place."""

    def __init__(self, order: np.ndarray, pivots: int):
        self.n, self.prefix = order.shape
        by = np.argsort(order.ravel(), kind="stable")
        self.rows, self.places = by // self.prefix, by % self.prefix
        self.at = np.searchsorted(order.ravel()[by], np.arange(pivots + 1))

    def saved(self, order: np.ndarray) -> np.ndarray:
        """For each row by how much its footrule distance to `order` is less than that of disjoint orders."""
        k = self.prefix
        spans = [slice(self.at[p], self.at[p + 1]) for p in order]
        place = np.repeat(np.arange(len(order)), [s.stop - s.start for s in spans])
        theirs = np.concatenate([self.places[s] for s in spans])
        gain = (k - place) + (k - theirs) - np.abs(place - theirs)
        return np.bincount(np.concatenate([self.rows[s] for s in spans]), weights=gain, minlength=self.n)


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, k: int, prefix: int, rerank: float) -> pd.DataFrame:
    """The k best rows of one block for each query, with exact scores."""
    prefix = min(prefix, len(pivots))
    files = InvertedFiles(orders(vectors, pivots, prefix), len(pivots))
    order = orders(queries, pivots, prefix)
    many = min(len(ids), max(1, int(np.ceil(rerank * len(ids)))))
    out = []
    for i, q in enumerate(queries):
        saved = files.saved(order[i])
        some = np.argpartition(-saved, many - 1)[:many] if many < len(ids) else np.arange(len(ids))
        some = some[ids[some] != query_ids[i]]
        rough = vectors[some] @ q
        if len(some) > k:
            some = some[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9]
        score = (vectors[some] * q).sum(axis=1)  # equal rows get equal sums
        best = np.lexsort((ids[some], -score))[:k]
        out.append((np.full(len(best), query_ids[i]), ids[some][best], score[best]))
    if not out:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def nearest(df: DataFrame, is_query: Callable[[Column], Column], k: int = 20, ident: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, rerank: float = RERANK, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows found."""
    rows = df.select(F.col(ident).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    rows = rows.where(F.size("v") == usual_length(rows, "v"))
    n, asked = rows.agg(F.count("*"), F.count_if(is_query(F.col("id")))).first()
    # PIVOTS vectors, drawn by a hash of what they hold
    sample = np.array([r.v for r in rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(pivots).collect()])
    blocks, parts = max(LEAST_BLOCKS, -(-n // block)), max(1, -(-asked // block))
    data = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    queries = rows.where(is_query(F.col("id"))).dropDuplicates(["id"]).withColumn("p", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search_block(left["id"].to_numpy(), np.stack(left["v"].to_numpy()), right["id"].to_numpy(), np.stack(right["v"].to_numpy()), sample, k, prefix, rerank)

    found = data.groupBy("b", "p").cogroup(queries.groupBy("b", "p")).applyInPandas(run, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
