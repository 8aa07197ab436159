"""Fingerprints for change detection."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe.functions.exprs import as_text, col


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row (rows, fingerprint): SHA-256 of the schema's text, the row count and the sum of 60 bits of each
    row's MD5. A row's text marks nulls and states each value's length, so a value that moves to
    another column shows, as do renamed columns. Independent of row order, sensitive to repeated
    rows; one pass with map-side sums."""
    parts = []
    for f in df.schema.fields:
        text = F.hex(col(f.name)) if isinstance(f.dataType, T.BinaryType) else as_text(col(f.name), f.dataType)
        parts.append(F.when(col(f.name).isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    h = F.conv(F.substring(F.md5(F.concat(*parts) if parts else F.lit("")), 1, 15), 16, 10).cast("decimal(38,0)")
    total = F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("rows"), total.alias("s")).select(
        "rows", F.sha2(F.concat_ws("|", F.lit(df.schema.simpleString()), F.col("rows").cast("string"), F.col("s").cast("string")), 256)
        .alias("fingerprint"))


# Content sums: a polynomial in POINT modulo the prime 2^61 - 1 (POINT is any fixed number below it).
PRIME = (1 << 61) - 1
POINT = 0x1A9F2C7D5E3B8461


def _split_sums(batches):
    """(file, size, block, length, total) of each split: with its lines at offsets o from its first line,
    the sum of hash(line) * POINT^o. One split is held as two numbers."""
    import pyarrow as pa

    out, now, length, total, power, powers = [], None, 0, 0, 1, {}
    for batch in batches:
        for file, size, block, line in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (file, size, block) != now:
                if now is not None:
                    out.append((*now, length, str(total)))
                now, length, total, power = (file, size, block), 0, 0, 1
            n = len(line) + 1
            total = (total + int.from_bytes(hashlib.blake2b(line, digest_size=8).digest(), "big") * power) % PRIME
            if n not in powers:
                if len(powers) >= 100_000:
                    powers.clear()
                powers[n] = pow(POINT, n, PRIME)
            power = power * powers[n] % PRIME
            length += n
    if now is not None:
        out.append((*now, length, str(total)))
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)],
                                     names=["file", "size", "block", "length", "total"])


def _file_sums(batches):
    """One file's splits in order of their place, each shifted by the lengths before it."""
    import pandas as pd

    now, size, length, total = None, 0, 0, 0
    out = []
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            if r.file != now:
                if now is not None:
                    out.append((now, f"{size}:{length}:{total}"))
                now, size, length, total = r.file, r.size, 0, 0
            total = (total + int(r.total) * pow(POINT, length, PRIME)) % PRIME
            length += r.length
    if now is not None:
        out.append((now, f"{size}:{length}:{total}"))
    yield pd.DataFrame(out, columns=["path", "h"])


def content_sums(spark: SparkSession, path: str) -> DataFrame:
    """(path, h): a checksum of each file's bytes in order, for files of any size.

    Files are read as lines that end at ``\\n``, in as many splits as Spark likes; a split's lines
    sum up to one number, and the splits of a file are put together by their offsets, so the result
    does not depend on the splits. Nothing but one line is held at a time (a line under 2 GiB). Of
    compressed files the text inside counts. Empty files count as absent: Spark's readers leave them out.
    """
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")]
    lines = spark.read.text(path, lineSep="\n").select(*meta, F.col("_metadata.file_block_start").alias("block"),
                                                      F.col("value").cast("binary").alias("line"))
    splits = lines.mapInArrow(_split_sums, "file string, size bigint, block bigint, length bigint, total string")
    return splits.repartition("file").sortWithinPartitions("file", "block").mapInPandas(_file_sums, "path string, h string")


def file_fingerprint(spark: SparkSession, path: str, content: bool = False) -> str:
    """Fingerprint of the files under ``path``, combined order-independently as the count and the sum of a
    64-bit hash per file. By default from the listing (path, length, modification time; no
    file data is read); with ``content=True`` from a checksum of each file's bytes (``content_sums``), for
    files of any size. Empty files count as absent."""
    files = spark.read.format("binaryFile").load(path)
    if content:
        per_file = content_sums(spark, path)
    else:
        per_file = files.select("path", F.md5(F.concat_ws("|", "path", F.col("length").cast("string"),
                                                          F.unix_micros("modificationTime").cast("string"))).alias("h"))
    row = per_file.agg(F.count(F.lit(1)).alias("n"),
                       F.sum(F.xxhash64("path", "h").cast("decimal(38,0)")).alias("s")).first()
    return hashlib.md5(f"{row['n']}:{row['s']}".encode()).hexdigest()
