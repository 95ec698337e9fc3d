"""A training corpus from raw documents: five stages, each applying one operator to all that the stage before kept.

Rows: null and empty texts pass every filter (their score is that of no word, they match no benchmark item; of the rows
without words one stays) and have nothing for the mix to take, so they end there; rows with a null id are kept by
``near_duplicates`` and named by null in the files; of rows that repeat an id one stays; a null language or source is
one of its own; an empty table gives empty stages; a document without labels is scored like any other, and without
labels of both kinds none is rejected.  Columns beside those of documents stay until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrilens.llm.common import fresh_path, table
from petrilens.llm.decontaminate import drop_contaminated
from petrilens.llm.mixing import mix
from petrilens.llm.queries import tokenizer_path
from petrilens.llm.simhash import drop_near_duplicates
from petrilens.llm.token_files import token_files
from petrilens.llm.toxicity import fit_toxicity, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold of their language; the classifier learns from ``labels``."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).filter(F.col("score") < F.col("threshold")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: fingerprints of five-word shingles at 2 or fewer bits, and
    texts whose shingles are similar at 0.8 or more."""
    return drop_near_duplicates(docs, words_in=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights: a document has a row for each time the mix takes it."""
    return mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and per row of it, from the files: doc_id, start, n_tokens, ids_crc32."""
    return token_files(docs, tokenizer=tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: The first stage learns a classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
