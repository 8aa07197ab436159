"""From raw documents to token ids: each stage works on what its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents, and no others.

Null texts count as empty. The first two stages judge rows: rows that repeat an id with other texts are
judged apart, and rows without an id are ordinary rows. To the near-duplicate and the benchmark stage an id is
one document, whose rows share a verdict; rows without an id meet nothing there and stay. Empty tables
pass through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabprobe.llm.decontaminate import contaminated
from tabprobe.llm.exact_dedup import exact_dedup
from tabprobe.llm.minhash import near_duplicates
from tabprobe.llm.piece_codec import encode_decode
from tabprobe.llm.quality import score_quality, train_quality
from tabprobe.llm.queries import piece_model
from tabprobe.llm.text import lower_ascii, whole
from tabprobe.session import free_shuffles, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Stands for a null id: it loses to any other.
LEAST = -2**63


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score under 0.3) go."""
    weights = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs, weights, carry=("lang", "source", "n_chars"))
    return scored.where("score >= 0.3").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) one row stays: that of the largest doc_id, a null id after all others.

    Of rows that share this id too, the one stays whose columns come first in order.
    """
    least = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LEAST)).alias("id")
    digest = F.sha2(lower_ascii(whole(F.col("text"))), 256).alias("digest")
    copies = materialize(exact_dedup(docs).where("group_size > 1")
                         .select(least, F.col("text_sha256").alias("digest"), "kept").distinct(), "copies")
    free_shuffles(copies)
    # One join and a window on its key: texts cross the network once.
    judged = docs.select(*COLUMNS, least, digest).join(copies, ["id", "digest"], "left").where("kept is null or kept")
    at = F.row_number().over(Window.partitionBy("id", "digest").orderBy(*COLUMNS))
    return judged.withColumn("at", at).where("kept is null or at = 1").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five-word shingles, similarity 0.8 or more) the smallest doc_id stays."""
    # Stored, so that Spark knows how few they are before it plans how texts meet them.
    gone = free_shuffles(materialize(near_duplicates(docs, k=5, percent=80).where("not kept").select("doc_id"), "near_copies"))
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    gone = free_shuffles(materialize(found, "contaminated"))
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of whole texts, and whether decoding gives the text back."""
    coded = encode_decode(docs, piece_model())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", decontaminate), ("encode", encode)]

# No stage but exact dedup can be said in SQL: tests/llm/test_llm_pipeline.py holds the kept rows of each stage, and of run(),
# against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each kept is stored under the shared checkpoint folder until the driver ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{i}-{name}")
    return docs
