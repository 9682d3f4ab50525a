"""A corpus pipeline: each stage gets what its predecessor kept, written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftstone.llm.common import table
from siftstone.llm.mixing import mix_stage
from siftstone.llm.packing import pack_stage
from siftstone.llm.pii import pii_stage
from siftstone.llm.quality_rules import rules_stage
from siftstone.llm.simhash import dedup_stage
from siftstone.sources.scratch import cut

STAGES = [
    ("quality rules", rules_stage),
    ("simhash near-dedup", dedup_stage),
    ("pii surrogates", pii_stage),
    ("source mixing", mix_stage),
    ("best-fit packing", pack_stage),
]

#: Tokenization, keyed digests and connected components are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
