"""The corpus pipeline: language ID, near-duplicate removal, decontamination, mixing and sharding of ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the folder that driver and
executors share and reads it back as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderloom.llm import decontamination, language_id, mixing, ngram_join, sharding
from orderloom.llm.common import table, through_table

STAGES = [
    ("language ID", language_id.known_language),
    ("n-gram Jaccard join", ngram_join.distinct_documents),
    ("benchmark decontamination", decontamination.clean_documents),
    ("mixing sources to target weights", mixing.mixed_documents),
    ("sharding", sharding.sharded_documents),
]

#: No SQL: trained models, exact near-duplicates of whole tables and pseudorandom draws; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = through_table(docs, f"pipeline-{k}")
    return docs
