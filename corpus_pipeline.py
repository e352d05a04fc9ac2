"""The corpus pipeline: drop toxic documents, keep one of each group of near-duplicates, drop contaminated documents,
redact secrets, encode to pieces. Each stage takes what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.llm import decontaminate, pieces, secret_scan, simhash, toxicity
from wavelake.llm.common import save, scratch

#: A document is contaminated if it holds a whole window of ten consecutive words of a benchmark item.
WINDOW = 10


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.5. Labels of the training folds teach it."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingle similarity of 0.8 or more: that of the smallest id."""
    return simhash.one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark window in their own text; neither null nor repeated ids matter."""
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), WINDOW)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets that aren't widely copied examples are replaced in their texts."""
    return secret_scan.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (the tokens of the whole text), decoded (what they decode to), and the other columns but text.
    Input columns with these three names are kept as input_n_tokens, input_ids and input_decoded."""
    held = docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("kept"), "text")
    coded = pieces.decode(pieces.encode(held, keep=("kept",)))
    others = (F.col("kept").getField(c).alias(f"input_{c}" if c in ("n_tokens", "ids", "decoded") else c) for c in docs.columns if c != "text")
    return coded.select(*others, F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("pieces", encode_pieces),
]

#: No stage but the third and fourth could be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark):
            docs = save(stage(spark, docs, sf_dir), f"stage-{name}", outlive=True)
    return docs
