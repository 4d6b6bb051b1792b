"""The corpus pipeline. Each stage reads what the one before kept and its decisions take effect:

1. toxicity: texts that the classifier chain rejects go;
2. quality rules: texts that fail the base test or have a low posterior go;
3. n-gram Jaccard join: the smallest doc_id of each group of near duplicates stays (5 words, 80 %);
4. secret scan: every span found is replaced by a mask and n_chars follows;
5. best-fit packing: what is left, in sequences of 4096 tokens.

Rows without doc_id go in the third stage; rows that share a doc_id are one document there, which stays or goes as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import secret_scan
from tidemark.llm.common import cut, fresh_dir, table
from tidemark.llm.ngram_join import NgramJoin
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality_rules import score
from tidemark.llm.toxicity import judge, train

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return judge(docs.select(*COLUMNS), train(docs, table(spark, sf_dir, "labels"))).where("NOT toxic").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return score(docs.select(*COLUMNS), COLUMNS[1:]).where("kept").select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = NgramJoin(docs, n=5, percent=80).result()
    gone = cut(found.where("component_id <> doc_id").select("doc_id").distinct())
    return docs.select(*COLUMNS).where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti").select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted(docs.select(*COLUMNS), secret_scan.train(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: None: neither a trained model nor a tokenizer can be written in SQL; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
