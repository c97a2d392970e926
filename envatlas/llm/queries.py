"""The registered queries of the thirteen operators: each applies one, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envatlas.llm import alignment, bpe, jaccard_join, language_id, lattice_dedup, maxent_lm, permutation_index, resharding, source_mixing, substring_dedup, surrogates, token_counts, whitening


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumn("held_out", language_id.held_out())
    model = language_id.learn(docs.where(~F.col("held_out")))
    return language_id.predict(docs.drop("lang"), model).drop("text")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(read(spark, sf_dir, "documents", "doc_id", "text"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.limits(token_counts.length_histogram(read(spark, sf_dir, "documents", "text"), vocabulary()))


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), lambda i: i % 20 == 0)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    rows, sizes, targets = source_mixing.mix(docs, F.array("source"))
    known = spark.createDataFrame([(s, n, targets[s]) for s, n in sizes.items()], "name string, source_size bigint, target double")
    out = rows.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("name")))  # one row a source, at most MOST_PATTERNS
    return out.select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jaccard_join.link(read(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op7_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.dedup(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(read(spark, sf_dir, "documents", "doc_id", "text"))


def op9_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), resharding.order_key(text, F.col("doc_id").cast("string")).alias("k"))
    old = F.shiftright("k", 62 - 4)  # the old layout: shards by a hash of the text
    placed, _ = resharding.reshard(docs, F.col("size"), old, F.col("k"))
    out = resharding.with_slots(placed, "new_shard", "shard_key", "doc_id")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("new_shard").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read(spark, sf_dir, "documents", "doc_id", "text"), vocabulary()).drop("text")


def op11_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return maxent_lm.score(read(spark, sf_dir, "documents", "doc_id", "text"), held_out)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_substring_dedup, op3_token_counts, op4_permutation_index, op5_source_mixing, op6_jaccard_join, op7_lattice_dedup, op8_surrogates, op9_resharding, op10_bpe, op11_maxent_lm, op12_whitening, op13_alignment)}
ORACLES: dict[str, str] = {}
