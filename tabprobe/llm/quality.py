"""Quality classifier: hashed token n-grams, FTRL logistic regression, sparse dot products."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprobe.llm import linear, words
from tabprobe.llm.text import whole

# The fit's bound: so many labelled rows, taken in hash order of their ids, read so often.
SAMPLE_ROWS = 5_000
PASSES = 3
SIZE = (1 << linear.BITS) + 1


def held_out(id_col: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_cols: list[str], rows: int, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, text, label columns) of at most ``rows`` labelled documents that are not held out.

    Ids are taken in hash order, so the sample does not depend on the tables' order. Rows with a
    null id or label are left out; of repeated labels the larger one counts, of repeated ids the
    greatest text. The ids are at most ``rows``, hence broadcast; texts do not shuffle for it.
    """
    given = labels.select(F.col(id_col).alias("id"), *label_cols).dropna()
    given = given.where(~held_out(F.col("id"))).groupBy("id").agg(*[F.max(c).alias(c) for c in label_cols])
    chosen = given.orderBy(F.xxhash64("id"), "id").limit(rows)
    base = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    return base.join(F.broadcast(chosen), "id").groupBy("id", *label_cols).agg(F.max("text").alias("text"))


def train_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = SAMPLE_ROWS, passes: int = PASSES,
                  id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights (the last is the bias) learned from at most ``rows`` labelled documents.

    Features are made in all tasks; the bounded sample is fitted in one. Without labels all
    weights are 0, and every score is 0.5.
    """
    sample = labelled_sample(docs, labels, [label_col], rows, id_col, text_col)
    sample = sample.select("id", F.col(label_col).cast("double").alias("y"), "text")

    def featurise(batches):
        import pyarrow as pa

        for batch in batches:
            for row, data, offsets in words.chunks(batch.column("text")):
                bucket, weight, at = linear.features(data, offsets)
                n = len(offsets) - 1
                bucket, weight = bucket.astype(np.int32), weight.astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(row, n), batch.column("y").slice(row, n),
                     pa.array([bucket[at[i]:at[i + 1]].tobytes() for i in range(n)], pa.binary()),
                     pa.array([weight[at[i]:at[i + 1]].tobytes() for i in range(n)], pa.binary())], names=["id", "y", "bucket", "weight"])

    def fit(batches):
        import pyarrow as pa

        rows_, y = [], []
        for batch in batches:
            for b, w, label in zip(*(batch.column(c).to_pylist() for c in ("bucket", "weight", "y")), strict=True):
                rows_.append(linear.with_bias(np.frombuffer(b, np.int32), np.frombuffer(w, np.float32).astype(float), SIZE))
                y.append(label)
        weights = linear.Ftrl(SIZE).fit(rows_, np.array(y), passes)
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()], pa.binary())], names=["weights"])

    kind = sample.schema["id"].dataType.simpleString()
    made = sample.mapInArrow(featurise, f"id {kind}, y double, bucket binary, weight binary")
    fitted = made.repartition(1).sortWithinPartitions("id").mapInArrow(fit, "weights binary").collect()
    return np.frombuffer(bytes(fitted[0][0]), np.float32).astype(float) if fitted else np.zeros(SIZE)


def score_quality(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
                  carry: tuple[str, ...] = ()) -> DataFrame:
    """id_col, ``score`` (0 to 1, higher: label 1 likelier) and the ``carry`` columns: one row per
    input row. Null and empty texts score by the bias alone."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(weights)  # 2^BITS numbers, whatever the data
    base = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])

    def run(batches):
        import pyarrow as pa

        w = shared.value
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for row, data, offsets in words.chunks(batch.column("text")):
                bucket, weight, at = linear.features(data, offsets)
                sums = np.concatenate([[0.0], np.cumsum(w[bucket] * weight)])
                scores[row:row + len(offsets) - 1] = linear.sigmoid(sums[at[1:]] - sums[at[:-1]] + w[-1])
            kept = [batch.column("id"), pa.array(scores)]
            kept += [batch.column("text"), *(batch.column(f"c{i}") for i in range(len(carry)))] if carry else []
            yield pa.RecordBatch.from_arrays(kept, names=names)

    names = ["id", "score"] + (["text", *(f"c{i}" for i in range(len(carry)))] if carry else [])
    types = {f.name: f.dataType.simpleString() for f in base.schema} | {"score": "double"}
    out = base.mapInArrow(run, ", ".join(f"{n} {types[n]}" for n in names))
    back = {"id": id_col, "text": text_col} | {f"c{i}": c for i, c in enumerate(carry)}
    return out.withColumnsRenamed({k: v for k, v in back.items() if k in names})


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ``held_out``, ``score``, ``predicted`` (1 from a score of 0.3): trained on ``labels``, all of ``docs`` scored.

    One row per input row; rows without an id are scored and not held out."""
    scored = score_quality(docs, train_quality(docs, labels, id_col=id_col, text_col=text_col), id_col, text_col)
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
