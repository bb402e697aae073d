"""The corpus pipeline: five operators one after another over ``documents``.

Each stage takes all that its predecessor kept. All but the last return the columns of documents; the last one the packed
pieces. ``run`` writes each stage to the shared checkpoint folder and reads it again, as a scheduler of single jobs would.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fareflow.llm.minhash import minhash_stage
from fareflow.llm.mixing import mix_stage
from fareflow.llm.packing import pack_stage
from fareflow.llm.quality import quality_stage
from fareflow.llm.substring import substring_stage
from fareflow.scale import ensure_checkpoint_dir

STAGES = [
    ("quality_rules", quality_stage),
    ("minhash_near_dedup", minhash_stage),
    ("substring_dedup", substring_stage),
    ("mixing", mix_stage),
    ("best_fit_packing", pack_stage),
]

#: Learned rules, signatures and token ids aren't SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the documents of ``sf_dir``."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
