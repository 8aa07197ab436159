"""Line dedup across documents, with DataFrame operations only.

Each line's normalised key is hashed to 128 bits; documents are counted per hash after partial
aggregation on the map side, so a line that a third of all documents hold leaves each map task
once. The join that marks the lines to drop carries ids and hashes, never text; its hot keys
are split by AQE's skew join. Text moves once, when the dropped positions meet their document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.text import key128, lower_ascii, strip_blanks, whole
from tabprobe.session import materialize


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
                min_docs: int = 2) -> DataFrame:
    """Drop lines whose key is found in ``min_docs`` documents or more, but for the smallest id.

    A key is the line without blanks at both ends, A-Z lower-cased; keys under ``min_chars`` code
    points never drop. The smallest document holding a key keeps all its lines with that key.

    Returns id_col, ``n_lines`` (before dropping), ``n_dropped``, ``kept_text``: one row per input
    row. Null or empty text is one empty line. Rows without an id keep all their lines and do not
    count as documents. Rows that repeat an id are one document when lines are counted; each row
    keeps its own text. An empty table gives an empty table.
    """
    base = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    lines = base.where("id is not null").select(
        "id", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = (lines.select("id", "row", "pos", lower_ascii(strip_blanks(F.col("line"))).alias("key"))
             .where(F.char_length("key") >= min_chars)
             .select("id", "row", "pos", *key128(F.col("key"))))
    repeated = (keyed.groupBy("k1", "k2").agg(F.count_distinct("id").alias("n"), F.min("id").alias("first"))
                .where(F.col("n") >= min_docs).select("k1", "k2", "first"))
    # A table of its own, so that AQE can split a hot line in the join below.
    repeated = materialize(repeated, "repeated_lines")
    dropped = (keyed.join(repeated, ["k1", "k2"]).where("id <> first")
               .groupBy("id", "row").agg(F.collect_set("pos").alias("dropped")))
    marked = base.withColumn("row", F.xxhash64("text")).join(dropped, ["id", "row"], "left")
    split = F.split("text", "\n", -1)
    # array_except hashes its right side, so a document costs its lines, not lines x drops.
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.array_join(F.transform(stay, lambda i: F.element_at("lines", i + 1)), "\n")
    return (marked.withColumn("lines", split)
            .select(F.col("id").alias(id_col), F.size("lines").cast("long").alias("n_lines"),
                    F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
                    F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept).alias("kept_text")))
