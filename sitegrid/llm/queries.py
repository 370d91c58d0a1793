"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrid.llm import ann, bpe, ego, line_dedup, lm, minhash, mixing, pii, quality, token_counts
from sitegrid.llm.common import table

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def round_trip(docs: DataFrame) -> DataFrame:
    """Digests of the ids and of the text that they spell."""
    spelled = bpe.round_trip(docs, public_tokenizers.path(BYTE_BPE))
    return spelled.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("decoded_sha256"))


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pii(_documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("base", lambda x: x.kind == k)).cast("long").alias(f"n_{k}")
    place = lambda x: F.struct(x.start, F.array_position(F.array(*map(F.lit, pii.KINDS)), x.kind).alias("k"), x.end, x.kind)
    every = F.array_sort(F.transform(F.concat("base", "added"), place))
    return found.select("doc_id", *map(count, pii.KINDS[:4]), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"), F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_documents(spark, sf_dir), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_documents(spark, sf_dir))


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego.near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(_documents(spark, sf_dir), public_tokenizers.path(WORD_BPE))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir), k=2)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    of = (op1_bpe_round_trip, op2_line_dedup, op3_pii, op4_quality, op5_lm, op6_near_vectors, op7_mix, op8_token_counts, op9_nearest, op10_near_duplicates, pipeline)
    return {f.__name__: f for f in of}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": line_dedup.SQL, "op7_mix": mixing.SQL}
