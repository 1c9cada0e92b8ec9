"""The training-corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` applies them in
turn. Between stages the rows are written as Parquet to the shared checkpoint folder and
read again, so a lost executor costs a stage's task, not the pipeline. All stages but the
last return the columns of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import decontam, kdshard, mixing, quality, simhash
from quillgraph.llm._spark import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHARDS = 40
#: Source, language and topic shares go to tokens ** 0.9: a gentle flattening of the mixture.
ALPHA = 0.9
#: The expected share of tokens that the mixing stage keeps.
BUDGET = 0.95


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rules vote; documents that fail the base rules or whose posterior is below a half go."""
    return quality.filter_docs(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of SimHash near copies stays, that of the smallest id."""
    return simhash.drop_copies(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more lies in benchmark passages go."""
    return decontam.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by probabilities raked to the target shares and scaled to the token budget:
    cells that are rare against their target are kept whole and thin no others."""
    return mixing.mix_docs(docs.select(*COLUMNS), alpha=ALPHA, budget=BUDGET)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``shard``: a leaf of the k-d tree, 0 to 39, of near-equal bytes."""
    return kdshard.shard_docs(docs.select(*COLUMNS), SHARDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_weights),
    ("sharding", sharding),
]

#: Near-copy classes and the EM posteriors are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's rows lie in a folder of this run below the shared checkpoint
    folder; a stage's input is deleted once its output is written, the last output stays."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = out
    return docs
