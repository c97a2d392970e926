"""Token counts: an exact histogram of encoded lengths, and suffix sums that answer for every context limit.

Only (length, documents) pairs leave the map side. A limit L between two lengths of the histogram behaves as its lower
neighbour plus (L - lower) for each longer document, so one row a length answers every limit.
Null and empty texts have length 0; repeated rows count each time; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from envatlas.llm.bpe import encoded_lengths


def length_histogram(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(context_limit, n_docs): documents by encoded length, exact."""
    return encoded_lengths(df, path, text).groupBy(F.col("n_tokens").alias("context_limit")).agg(F.count("*").alias("n_docs"))


def limits(histogram: DataFrame) -> DataFrame:
    """For each length L that occurs: what a context of L tokens keeps and loses.

    n_docs of exactly L; docs_longer than L and tokens_longer they hold (suffix sums); total_tokens of all; truncated_tokens
    kept if every document is cut at L; lost_tokens by that cut; rank_low and rank_high, the range of quantiles q for which
    L is the (lower) q-quantile of lengths. The histogram has a row a length, so that its one ordered window is bounded by the longest
    document, not by the number of documents.
    """
    up = Window.orderBy("context_limit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_ = Window.orderBy("context_limit").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = F.col("context_limit") * F.col("n_docs")
    return (
        histogram.withColumn("docs_to", F.sum("n_docs").over(up))
        .withColumn("tokens_to", F.sum(held).over(up))
        .withColumn("docs", F.sum("n_docs").over(all_))
        .withColumn("total_tokens", F.sum(held).over(all_))
        .select(
            "context_limit", "n_docs",
            (F.col("docs") - F.col("docs_to")).alias("docs_longer"),
            (F.col("total_tokens") - F.col("tokens_to")).alias("tokens_longer"),
            "total_tokens",
            (F.col("tokens_to") + F.col("context_limit") * (F.col("docs") - F.col("docs_to"))).alias("truncated_tokens"),
            (F.col("total_tokens") - F.col("tokens_to") - F.col("context_limit") * (F.col("docs") - F.col("docs_to"))).alias("lost_tokens"),
            ((F.col("docs_to") - F.col("n_docs")) / F.col("docs")).alias("rank_low"),
            (F.col("docs_to") / F.col("docs")).alias("rank_high"),
        )
    )


def answer(table: DataFrame, limit: int) -> dict:
    """Totals for one context limit of any size, from the rows of limits(): documents cut, and tokens kept and lost."""
    below = table.where(F.col("context_limit") <= limit).orderBy(F.desc("context_limit")).first()
    if below is None:
        any_ = table.orderBy("context_limit").first()
        if any_ is None:
            return {"docs_cut": 0, "kept": 0, "lost": 0}
        docs = any_.n_docs + any_.docs_longer
        return {"docs_cut": docs, "kept": limit * docs, "lost": any_.total_tokens - limit * docs}
    kept = below.truncated_tokens + (limit - below.context_limit) * below.docs_longer
    return {"docs_cut": below.docs_longer, "kept": kept, "lost": below.total_tokens - kept}


def quantile(table: DataFrame, q: float) -> int | None:
    """The smallest length with at least a share q of the documents at or below it; null on an empty table."""
    row = table.where(F.col("rank_high") >= q).orderBy("context_limit").first()
    return row and row.context_limit
