"""From raw documents to token ids: quality, boilerplate lines, near-duplicates, mixture, encoding.

Every stage takes any rows with the columns of documents; other columns than these are dropped. Null texts, rows without an id
and an empty table pass through each. Rows that share an id are treated each by its own text; repeated rows with text are
copies, and one of them stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrid.llm import line_dedup, minhash, mixing, quality
from sitegrid.llm.common import materialize, table
from sitegrid.llm.queries import round_trip

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No SQL: the first stage learns a model.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the documents at hand and their labels."""
    model = quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.accepted(docs.select(*COLUMNS), model)


def cut_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sites share; n_chars follows the text where lines went."""
    cut = line_dedup.line_dedup(docs, keep=("lang", "source", "n_chars"))
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest id, by texts and never by ids."""
    return minhash.first_of_each(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: repeated rows have the same doc_id."""
    return mixing.mixed_rows(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each row's token ids and of the text that they decode to."""
    return round_trip(docs)


STAGES = [("quality", keep_good), ("line_dedup", cut_boilerplate), ("near_duplicates", keep_first), ("mixing", mix_sources), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
