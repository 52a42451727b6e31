"""Corpus pipeline: five stages from raw documents to compacted shards.

Each stage works on all rows that the stage before has kept, and is written and read again in
between, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packetloom.llm import decontaminate, mixing, quality_rules, sharding, simhash
from packetloom.llm._shared import table, written

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("simhash_dedup", simhash.stage),
    ("decontamination", decontaminate.stage),
    ("source_mixing", mixing.stage),
    ("sharding", sharding.stage),
]

#: Fingerprint links and the mix's draws have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
