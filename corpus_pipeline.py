"""The corpus pipeline: classify, deduplicate, redact, mix and pack documents. Part of the corpus operators.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the columns of
documents. Between stages rows are written as Parquet in the shared folder and read again, which cuts lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import Scratch
from lodestone.llm.mixing import mix_documents
from lodestone.llm.packing import pack_sequences
from lodestone.llm.partenum import keep_one_of_each_group
from lodestone.llm.quality import keep_good_documents
from lodestone.llm.secret_scan import redact_secrets

STAGES = [
    ("quality classifier", keep_good_documents),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_documents),
    ("best-fit packing", pack_sequences),
]

#: A trained classifier can't be written as SQL; the tests compare every stage with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.table(docs, name.replace(" ", "-"))
            scratch.release()
    return docs
