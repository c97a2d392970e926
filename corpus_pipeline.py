"""A corpus pipeline of five stages, each an operator of envatlas.llm applied to all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next one's
`docs`; all but the last return the columns of `documents`.

Every stage takes null ids, texts, languages and sources, repeated rows, empty tables, texts of any length and further columns of any name, which pass
through all stages but the last. Ties: of languages as near the first by code point, of near copies the least id stays, of documents that would
close a source's gap as well the first in the seeded order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envatlas.llm import bpe, jaccard_join, language_id, source_mixing, surrogates
from envatlas.llm.queries import vocabulary
from envatlas.llm.shared import column_named, save


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay: null texts and texts without a letter go. What is learned comes from `docs` alone."""
    model = language_id.learn(docs.where(~language_id.held_out()))
    named = language_id.predict(docs, model)
    return named.where(F.col(named.columns[len(docs.columns)]) != language_id.UNKNOWN).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a five-word Jaccard similarity of 0.8 or more, the one of least doc_id stays; texts without words stay."""
    return jaccard_join.one_of_each(docs, size=5, percent=80).select(*docs.columns)


def without_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by surrogates; n_chars follows the text."""
    out = surrogates.replace(docs)
    return out.withColumn("n_chars", F.when(F.col(out.columns[-1]) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixed_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice, so that sources meet their targets."""
    rows, _, _ = source_mixing.mix(docs, F.array("source"), keep_text=True)
    copies = F.col(rows.columns[-1])
    return rows.where(copies > 0).select(*[rows[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), copies)).alias(column_named(rows, "again"))).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the count and digests of its encoded and decoded text, a row for each time the mix takes it."""
    return bpe.encode_decode(docs.select("doc_id", "text"), vocabulary()).drop("text")


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_near_copies),
    ("surrogates", without_private_data),
    ("source_mixing", mixed_to_targets),
    ("bpe", encoded),
]

#: No SQL: prototypes, keyed surrogates and BPE have none. The tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order on the whole of `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs, f"stage-{name}")
    return docs
