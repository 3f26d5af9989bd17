"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradebook.llm import decontamination, jaccard_join, language_id, mixing, quality_rules
from tradebook.session import scratch_tables, settle

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of ``docs``.
STAGES = [
    ("quality_rules", quality_rules.stage),
    ("language_id", language_id.stage),
    ("near_duplicates", jaccard_join.stage),
    ("decontamination", decontamination.stage),
    ("mixing", mixing.stage),
]

#: Learned rules and classifiers decide two stages: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table; only the last stage's rows stay in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch_tables(spark) as last:
        for _, stage in STAGES:
            with scratch_tables(spark) as keep:
                docs = keep(settle(stage(spark, docs, sf_dir)))
        return last(docs)
