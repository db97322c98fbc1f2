"""A corpus pipeline: five stages over the documents table, each a numbered operator of quarry.llm.

Each stage gets (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents, and other columns that docs has.

Nulls, empty texts and repeated rows come through as follows. A null or empty text is not toxic, no near copy,
holds no benchmark passage and no secret, so it stays and is mixed. Rows without doc_id stay too, as nothing is
their copy. Repeated rows of one doc_id are one document: they stay or go together and get the same text. An
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontamination, jaccard_join, mixing, secrets, toxicity
from quarry.llm._shared import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the chain, trained on the labels of these documents, finds toxic go."""
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, chain).where("not is_toxic").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each group of documents of similarity 0.8 or more, the one with the smallest doc_id stays."""
    return jaccard_join.keep_first(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the words in windows of 10 words that the benchmark also has are cut out."""
    return decontamination.remove_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: secrets become [secret]."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: block, slot and place of each document in the mix of the sources."""
    return mixing.mix_sources(docs)


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("benchmark", cut_benchmark), ("secrets", mask_secrets), ("mixing", mix)]
#: A learned classifier and learned formats decide in it, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
