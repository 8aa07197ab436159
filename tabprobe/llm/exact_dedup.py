"""Exact dedup through a sharded cuckoo-filter index of live digests.

Rows are first summed by (digest, salt) with map-side aggregation, so a text that a third of all
documents repeat reaches its shard as at most ``SALTS`` rows. Each shard streams its rows into a
``LiveIndex``. The index comes out as a table (digest, keep_id, size), which later batches can
extend and withdraw from with ``update_index``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.cuckoo import LiveIndex
from tabprobe.llm.text import lower_ascii, whole
from tabprobe.session import materialize

SALTS = 16
# Entries a shard may hold: some 100 MB of Python objects.
SHARD_ROWS = 250_000
INDEX_SCHEMA = "digest binary, keep_id bigint, size bigint"
OLD, REMOVE, ADD = 0, 1, 2


def digest_of(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased; null counts as empty."""
    return F.unhex(F.sha2(lower_ascii(whole(text)), 256))


def _stream(batches):
    """One shard: stored entries, then withdrawals, then additions (the order of the sort)."""
    import pyarrow as pa

    index = LiveIndex()
    for batch in batches:
        for digest, kind, keep, size in zip(*(batch.column(c).to_pylist() for c in ("digest", "kind", "keep_id", "size")),
                                            strict=True):
            if kind == REMOVE:
                index.remove(digest)
            else:
                index.add(digest, keep, size)
    rows = list(index.entries())
    for i in range(0, len(rows), 20_000):
        part = rows[i:i + 20_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in part], pa.binary()), pa.array([r[1] for r in part], pa.int64()),
             pa.array([r[2] for r in part], pa.int64())], names=["digest", "keep_id", "size"])


def update_index(index: DataFrame | None, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """The index (digest, keep_id, size) after withdrawing ``removed.digest`` and adding
    ``added`` (id bigint, digest). Null ids lose to any id. ``added`` must be a stored table: it
    is counted to size the shards."""
    parts, n = [], 0
    if index is not None:
        parts.append(index.select("digest", F.lit(OLD).alias("kind"), "keep_id", "size"))
        n += index.count()
    if removed is not None:
        parts.append(removed.select("digest").distinct().select(
            "digest", F.lit(REMOVE).alias("kind"), F.lit(None).cast("bigint").alias("keep_id"), F.lit(0).cast("bigint").alias("size")))
    if added is not None:
        n += added.count()
        salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")
        parts.append(added.groupBy("digest", salt).agg(F.max("id").alias("keep_id"), F.count("*").alias("size"))
                     .select("digest", F.lit(ADD).alias("kind"), "keep_id", "size"))
    ops = parts[0]
    for p in parts[1:]:
        ops = ops.unionByName(p)
    shuffle = int(ops.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(shuffle, math.ceil(n / SHARD_ROWS))
    return (ops.repartition(shards, "digest").sortWithinPartitions("kind")
            .mapInArrow(_stream, INDEX_SCHEMA))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of equal texts (A-Z lower-cased); the row with the largest id stays.

    Returns id_col, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``: one row per input row,
    dropped ones too. Null text counts as empty. Null ids lose to any id; among null ids alone the
    rows are kept. Rows that repeat an id count in ``group_size`` and share one verdict. An empty
    table gives an empty table.
    """
    digests = materialize(docs.select(F.col(id_col).cast("bigint").alias("id"), digest_of(F.col(text_col)).alias("digest")),
                          "digests")
    index = update_index(None, added=digests)
    groups = index.where("size > 1")
    joined = digests.join(groups, "digest", "left")
    keep = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(F.col("id").alias(id_col), keep.alias("keep_id"),
                         F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
                         F.col("id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
