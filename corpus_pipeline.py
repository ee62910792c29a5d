"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept:

1. quality: documents that the fixed rules or a certified threshold reject go;
2. near duplicates: one document of each group stays, that of least id;
3. decontamination: documents that hold a benchmark item, verbatim or with other
   parameters, go;
4. secrets: every span found is replaced by a mark in the text, documents stay;
5. packing: the texts become pieces of sequences of 2048 ids, with their ids.

All but the last return the columns of documents. Null texts have no words, so the first
stage lets them go; how each stage treats ties, repeated rows and further columns is told in
the module of its operator. An empty table goes through and gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retenta.llm import decontam, neardup, packing, quality, secrets
from retenta.llm import text as T
from retenta.session import stage

TOKENIZER = "word_bpe_49k.json"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, labels.select("doc_id", (F.col("quality") == 1).alias("good")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.train(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, T.tokenizer_path(TOKENIZER), end_id=1)


STAGES = [
    ("quality rules", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("secret scans", mask_secrets),
    ("packing", packed),
]
#: Tokenization is beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each reads what the one before it wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
