"""Removal of passages that repeat across documents, by suffix arrays over shards.

Every 50-byte string has an anchor: the smallest hash among its 24-grams. Equal strings have equal
anchors, so only strings whose anchor occurs in two documents can repeat.

1. One pass packs each document's anchors into blobs by anchor bucket (a batch names an anchor
   twice at most; those that a batch holds in two documents are marked at once). A bucket's task finds the
   anchors of two documents and returns them to their documents, packed by parts of these.
2. A second pass cuts, around marked anchors, the segments whose strings share one anchor.
   Equal segments become one by map-side aggregation: a passage that a third of all documents
   hold is one row a task. Of documents that are equal as a whole only the smallest id is cut.
3. Distinct segments of an anchor meet in one shard. Its suffix array is built by induced sorting;
   permuted common prefixes group equal strings; each takes the smallest id that holds it.
   Anchors with very many distinct segments take another exact way: their strings are grouped
   by Spark one by one.
4. Segments return to their documents, whose covered bytes are removed.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm import words
from tabprobe.llm.suffix import equal_windows
from tabprobe.llm.text import whole
from tabprobe.session import forget, free_shuffles, materialize, table_path

GRAM = 24
# Anchors a bucket may hold: some 100 MB while it is sorted.
BUCKET_ANCHORS = 4_000_000
# Text that one blob batch and one suffix array take.
BATCH_BYTES = 16 << 20
SHARD_BYTES = 2 << 20
# Marks that a task holds at a time (24 bytes each), and text whose marks make one part.
HELD_MARKS = 2_000_000
PART_BYTES = 1 << 30
# Text hashed at a time: its 64-bit columns stay in a core's cache.
HASHED_BYTES = 1 << 18
# Distinct segments of one anchor beyond which its strings are grouped one by one.
CROWDED = 10_000
SEPARATOR = 0xFF  # in no UTF-8 text


def _anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int):
    """(text number, first window, last window + 1, anchor) of maximal runs of windows (strings of
    ``length`` bytes) of a text that have one anchor; positions count from the text's start."""
    n, width = len(data), length - GRAM + 1
    if n < length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64)
    h = data.astype(np.uint64) + np.uint64(1)
    power, size, grams = words.BASE, 1, []
    while size <= 16:
        grams.append((h, power))
        h = h[:-size] * np.uint64(power) + h[size:]
        power, size = power * power % (1 << 64), size * 2
    # 24 = 16 + 8
    (eight, by_eight), (sixteen, _) = grams[3], grams[4]
    h = words.mix(sixteen[:n - GRAM + 1] * np.uint64(by_eight) + eight[16:])
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    if size < width:
        h = np.minimum(h[:len(h) - (width - size)], h[width - size:])
    sizes = np.diff(offsets)
    inside = np.zeros(len(h) + 1, np.int32)
    full = sizes >= length
    np.add.at(inside, offsets[:-1][full], 1)
    np.add.at(inside, (offsets[1:] - length + 1)[full], -1)
    inside = np.cumsum(inside[:-1]) > 0
    edge = np.ones(len(h) + 1, bool)
    edge[1:-1] = (h[1:] != h[:-1]) | (inside[1:] != inside[:-1])
    edge[offsets[:-1][full]] = True
    cuts = np.flatnonzero(edge)
    start, stop = cuts[:-1], cuts[1:]
    good = inside[start]
    start, stop = start[good], stop[good]
    text = np.searchsorted(offsets, start, "right") - 1
    return text, start - offsets[text], stop - offsets[text], h[start]


def _anchor_blobs(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """Rows (bucket, blob of anchors and their documents) and rows (id, row, marks) of anchors that one batch has
    in two documents. A mark is bucket * 2^32 + 32 bits of the anchor: a clash only adds work."""

    def run(batches):
        import pyarrow as pa

        def emit(ids, rows, owner, mark):
            order = np.lexsort((owner, mark))
            mark, owner = mark[order], owner[order]
            new = np.ones(len(mark), bool)
            new[1:] = (mark[1:] != mark[:-1]) | (owner[1:] != owner[:-1])
            mark, owner = mark[new], owner[new]
            first = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]])) if len(mark) else np.zeros(0, np.int64)
            count = np.diff(np.append(first, len(mark)))
            # Two rows of one id are one document.
            low, high = (f.reduceat(ids[owner], first) if len(first) else ids[:0] for f in (np.minimum, np.maximum))
            many = np.repeat(low < high, count)
            back = np.argsort(owner[many], kind="stable")
            yield from _marks(ids, rows, owner[many][back], mark[many][back])
            # The rest, and for the other batches the smallest and largest id of each repeated anchor.
            ends = (ids[owner] == np.repeat(low, count)) | (ids[owner] == np.repeat(high, count))
            mark, owner = mark[ends | ~many], owner[ends | ~many]
            bucket = (mark >> np.uint64(32)).astype(np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(mark)]]) if len(mark) else [0]
            out_b, out_p, size = [], [], 0
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                near, local = np.unique(owner[a:b], return_inverse=True)
                out_b.append(int(bucket[a]))
                out_p.append(np.array([b - a, len(near)], np.int64).tobytes() + ids[near].tobytes() + rows[near].tobytes()
                             + (mark[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + local.astype(np.uint32 if len(near) > 65_535 else np.uint16).tobytes())
                size += len(out_p[-1])
                if size > 8 << 20 or b == len(mark):
                    yield _blob_batch(out_b, out_p)
                    out_b, out_p, size = [], [], 0

        def _marks(ids, rows, owner, mark):
            cuts = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1, [len(owner)]]) if len(owner) else [0]
            for at in range(0, len(cuts) - 1, 2_000):
                part = cuts[at:at + 2_001]
                who = owner[part[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.random.default_rng(int(at)).integers(0, buckets, len(who)).astype(np.int32)), pa.nulls(len(who), pa.binary()),
                     pa.array(ids[who]), pa.array(rows[who]),
                     pa.array([mark[a:b].tobytes() for a, b in zip(part[:-1], part[1:], strict=True)], pa.binary())], names=names)

        def _blob_batch(b, p):
            return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(p, pa.binary()), pa.nulls(len(b), pa.int64()),
                                               pa.nulls(len(b), pa.int64()), pa.nulls(len(b), pa.binary())], names=names)

        names = ["bucket", "blob", "id", "row", "marks"]
        held, size, base = [], 0, 0
        all_ids, all_rows = [], []
        for batch in batches:
            ids, rows = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "row"))
            for row, data, offsets in words.chunks(batch.column("text"), HASHED_BYTES):
                text, _, _, anchor = _anchor_runs(data, offsets, length)
                bucket = anchor % np.uint64(buckets)
                mark = (bucket << np.uint64(32)) | (anchor // np.uint64(buckets) & np.uint64(0xFFFFFFFF))
                all_ids.append(ids[row:row + len(offsets) - 1])
                all_rows.append(rows[row:row + len(offsets) - 1])
                held.append((text + base, mark))
                base += len(offsets) - 1
                size += len(data)
                if size >= BATCH_BYTES:
                    yield from emit(np.concatenate(all_ids), np.concatenate(all_rows), *(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, size, base, all_ids, all_rows = [], 0, 0, [], []
        if held:
            yield from emit(np.concatenate(all_ids), np.concatenate(all_rows), *(np.concatenate(x) for x in zip(*held, strict=True)))

    return docs.mapInArrow(run, "bucket int, blob binary, id bigint, row bigint, marks binary")


def _repeated_marks(blobs: DataFrame, buckets: int, parts: int) -> DataFrame:
    """(id, row, marks) of the anchors that two documents hold: a task per bucket finds them.

    Marks return packed by part (a hash of the document), so that rows follow buckets and parts, not the
    documents of each bucket; a part's task puts together those of one document.
    """

    def run(batches):
        import pyarrow as pa

        held, size = [], 0

        def settle(bucket, blobs_):
            ids, rows, marks, owners = [], [], [], []
            total = 0
            for blob in blobs_:
                n, docs = np.frombuffer(blob, np.int64, 2)
                at = 16
                ids.append(np.frombuffer(blob, np.int64, docs, at))
                rows.append(np.frombuffer(blob, np.int64, docs, at + 8 * docs))
                at += 16 * docs
                marks.append(np.frombuffer(blob, np.uint32, n, at))
                owners.append(np.frombuffer(blob, np.uint32 if docs > 65_535 else np.uint16, n, at + 4 * n).astype(np.int64) + total)
                total += docs
            ids, rows, mark, owner = (np.concatenate(x) for x in (ids, rows, marks, owners))
            order = np.argsort(mark, kind="stable")
            mark, owner = mark[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
            low, high = np.minimum.reduceat(ids[owner], first), np.maximum.reduceat(ids[owner], first)
            many = np.repeat(low < high, np.diff(np.append(first, len(mark))))
            mark, owner = mark[many], owner[many]
            return ids[owner], rows[owner], mark.astype(np.uint64) | np.uint64(bucket << 32)

        def packed():
            """What is held, a row a part: ids, rows and marks, one after another."""
            ids, rows, mark = (np.concatenate(x) for x in zip(*held, strict=True))
            part = (words.mix(ids.astype(np.uint64) * np.uint64(words.BASE) + rows.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            ids, rows, mark, part = ids[order], rows[order], mark[order], part[order]
            cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]]) if len(part) else [0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(part[a]) for a in cuts[:-1]], pa.int32()),
                 pa.array([ids[a:b].tobytes() + rows[a:b].tobytes() + mark[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())],
                names=["part", "blob"])

        def found():
            now, blobs_ = None, []
            for batch in batches:
                through = batch.filter(batch.column("marks").is_valid())
                if through.num_rows:
                    marks = [np.frombuffer(m, np.uint64) for m in through.column("marks").to_pylist()]
                    sizes = [len(m) for m in marks]
                    yield (*(np.repeat(through.column(c).to_numpy(zero_copy_only=False), sizes) for c in ("id", "row")), np.concatenate(marks))
                for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                    if blob is None:
                        continue
                    if bucket != now:
                        if blobs_:
                            yield settle(now, blobs_)
                        now, blobs_ = bucket, []
                    blobs_.append(blob)
            if blobs_:
                yield settle(now, blobs_)

        for x in found():
            held.append(x)
            size += len(x[0])
            if size >= HELD_MARKS:
                yield from packed()
                held, size = [], 0
        if held:
            yield from packed()

    def gather(batches):
        import pyarrow as pa

        def rows_of(blobs_):
            each = [np.frombuffer(b, np.uint64).reshape(3, -1) for b in blobs_]
            ids, rows, mark = np.concatenate(each, axis=1)
            order = np.lexsort((mark, rows, ids))
            ids, rows, mark = ids[order], rows[order], mark[order]
            cuts = np.concatenate([[0], np.flatnonzero((ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1])) + 1, [len(ids)]])
            for at in range(0, len(cuts) - 1, 2_000):
                some = cuts[at:at + 2_001]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[some[:-1]].view(np.int64)), pa.array(rows[some[:-1]].view(np.int64)),
                     pa.array([mark[a:b].tobytes() for a, b in zip(some[:-1], some[1:], strict=True)], pa.binary())], names=["id", "row", "marks"])

        blobs_, size = [], 0
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                blobs_.append(blob)
                size += len(blob) // 24
                if size >= HELD_MARKS:
                    yield from rows_of(blobs_)
                    blobs_, size = [], 0
        if blobs_:
            yield from rows_of(blobs_)

    found = blobs.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "part int, blob binary")
    return found.repartition(parts, "part").mapInArrow(gather, "id bigint, row bigint, marks binary")


# Within an anchor 64 bits name a segment.
SEGMENTS = "anchor bigint, name bigint, id bigint, row bigint, start int, n int, segment binary"


def _segments(marked: DataFrame, length: int, buckets: int) -> DataFrame:
    """The runs of windows with marked anchors: anchor, hash and bytes of the segment, where it starts, windows in it."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            ids, rows = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "row"))
            marks = batch.column("marks").to_pylist()
            for row, data, offsets in words.chunks(batch.column("text"), HASHED_BYTES):
                text, start, stop, anchor = _anchor_runs(data, offsets, length)
                bucket = anchor % np.uint64(buckets)
                mark = (bucket << np.uint64(32)) | (anchor // np.uint64(buckets) & np.uint64(0xFFFFFFFF))
                bounds = np.searchsorted(text, np.arange(len(offsets)))
                keep = np.zeros(len(text), bool)
                for i in range(len(offsets) - 1):
                    mine = slice(bounds[i], bounds[i + 1])
                    wanted = np.frombuffer(b"".join(marks[row + i]), np.uint64)
                    keep[mine] = np.isin(mark[mine], wanted)
                text, start, stop, anchor = text[keep], start[keep], stop[keep], anchor[keep]
                raw = data.tobytes()
                a = (offsets[text] + start).tolist()
                b = (offsets[text] + stop + length - 1).tolist()
                pieces = [raw[x:y] for x, y in zip(a, b, strict=True)]
                names = np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=8).digest() for p in pieces), np.int64)
                for at in range(0, len(pieces), 50_000):
                    part = slice(at, at + 50_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor[part].view(np.int64)), pa.array(names[part]),
                         pa.array(ids[row + text[part]]), pa.array(rows[row + text[part]]), pa.array(start[part].astype(np.int32)),
                         pa.array((stop - start)[part].astype(np.int32)), pa.array(pieces[part], pa.binary())],
                        names=["anchor", "name", "id", "row", "start", "n", "segment"])

    return marked.mapInArrow(run, SEGMENTS)


RUNS = "anchor bigint, name bigint, froms array<int>, tos array<int>, lows array<bigint>"


def _shard_runs(distinct: DataFrame, length: int, shards: int) -> DataFrame:
    """For each distinct segment, runs of windows and the smallest id that holds each window.

    Anchors come together. One of a single document has nothing to remove, one of a single
    segment needs no sorting; the others share a suffix array with their neighbours.
    """

    def run(batches):
        import pyarrow as pa

        def settle(rows):
            pieces = [r[3] for r in rows]
            data = np.frombuffer(bytes([SEPARATOR]).join(pieces), np.uint8)
            sizes = np.array([len(p) for p in pieces])
            begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
            order, bounds = equal_windows(data, length)
            owner = np.repeat(np.arange(len(rows)), sizes + 1)[:len(data)]
            ids, high = np.array([r[2] for r in rows], np.int64), np.array([r[4] for r in rows], np.int64)
            low = np.minimum.reduceat(ids[owner[order]], bounds)
            least = np.empty(len(data), np.int64)
            least[order] = np.repeat(low, np.diff(np.append(bounds, len(order))))
            # Windows of all segments, one after another; a segment's follow from its first one on.
            n = sizes - length + 1
            first = np.cumsum(n) - n
            of = np.repeat(np.arange(len(rows)), n)
            at = np.arange(len(of)) - first[of]
            least = least[begin[of] + at]
            # Where no document with the segment comes after another's string, nothing goes.
            wanted = np.minimum.reduceat(least, first) < high
            cut = np.ones(len(of), bool)
            cut[1:] = (least[1:] != least[:-1]) | (at[1:] == 0)
            cut = np.flatnonzero(cut & wanted[of])
            if not len(cut):
                return
            froms = at[cut]
            last = np.append(of[cut][1:] != of[cut][:-1], True)
            tos = np.where(last, n[of[cut]], np.append(froms[1:], 0))
            counts = np.bincount(of[cut], minlength=len(rows))[wanted]
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            chosen = np.flatnonzero(wanted)
            named = [pa.array([rows[i][c] for i in chosen], pa.int64()) for c in (0, 1)]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v, k)) for v, k in ((froms, pa.int32()), (tos, pa.int32()), (least[cut], pa.int64()))]
            yield pa.RecordBatch.from_arrays(named + lists, names=["anchor", "name", "froms", "tos", "lows"])

        def results():
            held, size, group, single = [], 0, [], []

            def close():
                nonlocal held, size
                if min(g[2] for g in group) >= max(g[4] for g in group):
                    return
                if len(group) == 1:
                    a, name, low, segment, _ = group[0]
                    single.append((a, name, [0], [len(segment) - length + 1], [low]))
                else:
                    held += group
                    size += sum(len(g[3]) + 1 for g in group)

            for batch in batches:
                for r in zip(*(batch.column(c).to_pylist() for c in ("anchor", "name", "low", "segment", "high")), strict=True):
                    if group and r[0] != group[0][0]:
                        close()
                        group = []
                        if size >= SHARD_BYTES:
                            yield from settle(held)
                            held, size = [], 0
                        if len(single) == 20_000:
                            yield pack(single)
                            single.clear()
                    group.append(r)
            if group:
                close()
            if held:
                yield from settle(held)
            if single:
                yield pack(single)

        yield from results()

    def pack(rows):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                          names=["anchor", "name", "froms", "tos", "lows"])

    return distinct.repartition(shards, "anchor").sortWithinPartitions("anchor", "name").mapInArrow(run, RUNS)


def _grouped_runs(crowded: DataFrame, length: int) -> DataFrame:
    """The same result, string by string, for anchors with very many distinct segments."""
    at = F.explode(F.sequence(F.lit(0), F.octet_length("segment") - length)).alias("at")
    windows = crowded.select("anchor", "name", "low", "high", "segment", at).select(
        "anchor", "name", "low", "high", "at", F.expr(f"substring(segment, at + 1, {length})").alias("string"))
    least = windows.groupBy("string").agg(F.min("low").alias("least"))
    each = windows.join(least, "string").groupBy("anchor", "name", "high").agg(
        F.array_sort(F.collect_list(F.struct("at", "least"))).alias("x"))
    return (each.select("anchor", "name", "high", F.col("x.at").alias("froms"), F.transform("x.at", lambda a: a + 1).alias("tos"), F.col("x.least").alias("lows"))
            .where(F.array_min("lows") < F.col("high")).select("anchor", "name", "froms", "tos", "lows"))


def _store(df: DataFrame, name: str) -> DataFrame:
    """As materialize, with the compression that overlapping segments repay."""
    path = table_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def _cut(joined: DataFrame, length: int) -> DataFrame:
    """Remove the marked windows' bytes."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            held = []
            for key, text, copy, froms, tos in zip(*(batch.column(c) for c in ("id", "text", "copy", "froms", "tos")), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if copy.as_py() and len(raw) >= length:
                    spans = [(0, len(raw))]
                elif froms.is_valid and len(froms.values):
                    # A span of windows covers length - 1 bytes more; spans that overlap or touch are one.
                    f, t = froms.values.to_numpy(zero_copy_only=False), tos.values.to_numpy(zero_copy_only=False) + (length - 1)
                    order = np.argsort(f, kind="stable")
                    f, t = f[order], np.maximum.accumulate(t[order])
                    new = np.concatenate([[True], f[1:] > t[:-1]])
                    spans = list(zip(f[new].tolist(), t[np.append(new[1:], True)].tolist(), strict=True))
                else:
                    spans = []
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                held.append((key.as_py(), len(raw), [{"start": a, "stop": b} for a, b in spans], b"".join(kept)))
                if len(held) == 500:
                    yield pack(held)
                    held = []
            if held:
                yield pack(held)

    def pack(held):
        import pyarrow as pa

        keys, sizes, spans, kept = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
             pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, "id bigint, n_bytes bigint, spans array<struct<start:int,stop:int>>, kept binary")


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts in a document with a smaller id.

    Texts are UTF-8 bytes; strings do not cross documents and are judged on the input.
    Returns id_col, ``n_bytes``, ``spans`` (maximal removed runs, start to stop) and ``kept`` (the remaining bytes): one row per
    input row. Null and empty texts, and texts under ``length`` bytes, lose nothing. Rows without an id
    are left as they are and match nothing. Rows that repeat an id are one document (nothing repeats
    within it); each keeps its own text. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), whole(F.col(text_col)).alias("text"))
    base = base.withColumn("row", F.xxhash64("text"))
    sums = materialize(base.select("id", "row", F.octet_length("text").alias("bytes"), F.unhex(F.sha2("text", 256)).alias("digest")), "digests")
    groups = (sums.where("id is not null").groupBy("digest").agg(F.min("id").alias("low"), F.count("*").alias("n")).where("n > 1"))
    groups = materialize(groups.select("digest", "low"), "copies")  # a table of its own, so that AQE can split a hot digest
    copies = materialize(sums.join(groups, "digest").where("id > low").select("id", "row").distinct(), "copied")
    total = sums.agg(F.sum("bytes")).first()[0] or 0
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parallel, math.ceil(total * 0.06 / BUCKET_ANCHORS))

    named = base.where("id is not null")
    parts = max(parallel, math.ceil(total / PART_BYTES))
    marks = _repeated_marks(_anchor_blobs(named.select("id", "row", "text"), length, buckets), buckets, parts)
    # Stored, or else the optimizer takes the anti join below the aggregate, where a document has a row for each bucket.
    marks = _store(marks.groupBy("id", "row").agg(F.collect_list("marks").alias("marks")), "marks")
    free_shuffles(marks)
    marks = marks.join(copies, ["id", "row"], "left_anti")
    segments = _store(_segments(named.join(marks, ["id", "row"]).select("id", "row", "text", "marks"), length, buckets), "segments")
    free_shuffles(segments)

    distinct = segments.groupBy("anchor", "name").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.first("segment").alias("segment"))
    distinct = _store(distinct, "distinct_segments")
    free_shuffles(distinct)
    crowds = materialize(distinct.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("anchor"), "crowded")
    alone = distinct.join(crowds, "anchor", "left_anti")
    runs = _shard_runs(alone, length, parallel).unionByName(_grouped_runs(distinct.join(crowds, "anchor"), length))
    runs = _store(runs, "runs")
    forget(distinct)
    free_shuffles(runs)

    hits = (segments.select("anchor", "name", "id", "row", "start").join(runs, ["anchor", "name"])
            .select("id", "row", "start", F.filter(F.arrays_zip("froms", "tos", "lows"), lambda x: x["lows"] < F.col("id")).alias("x"))
            .where(F.size("x") > 0))
    hits = hits.select("id", "row", F.transform("x.froms", lambda a: a + F.col("start")).alias("froms"),
                       F.transform("x.tos", lambda a: a + F.col("start")).alias("tos"))
    hits = hits.groupBy("id", "row").agg(F.collect_list(F.struct("froms", "tos")).alias("h"))
    hits = hits.select("id", "row", F.flatten("h.froms").alias("froms"), F.flatten("h.tos").alias("tos"))
    gone = hits.unionByName(copies, allowMissingColumns=True).select("id", "row", F.col("froms").isNull().alias("copy"), "froms", "tos")
    gone = _store(gone, "gone")
    forget(segments, runs)
    free_shuffles(gone)
    joined = base.join(gone, ["id", "row"], "left").select("id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "froms", "tos")
    return _cut(joined, length).withColumnRenamed("id", id_col)
