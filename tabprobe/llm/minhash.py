"""Near-duplicate groups: MinHash bands, signature check, full-set confirmation, components.

1. One pass over the texts takes each document's distinct word shingles (64-bit hashes), a digest
   of that set, ``BANDS * ROWS`` universal-hash minima, their band keys and one byte of each minimum.
2. Equal sets become one node (its smallest id) by map-side aggregation.
3. Each bucket (band key) links its nodes to two hubs, never to each other. Links whose signatures
   agree enough are confirmed on full sets, the best per node first; large-star/small-star joins them.
4. Buckets that still hold several components pair nodes across components only. A crowd of copies
   is one cluster of agreeing signatures; in it, only nodes pair that share an uncommon shingle or
   whose common parts suffice. Buckets with more than ``CROWD`` clusters are first split by their
   nodes' other bands. The join itself compares two bits of each minimum, so that it emits only pairs that
   are likely links; they pass the same checks, and components are taken again.

With p = s^ROWS, a link of similarity s shares no band with probability (1 - p)^BANDS: 5e-7 at 0.8.
Two nodes of different clusters meet in a crowded bucket only if they share a second band, so the
miss that counts is that of fewer than two bands, BANDS * p * (1 - p)^(BANDS - 1) more: 8e-6 at 0.8.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.llm import words
from tabprobe.llm.components import connected_components
from tabprobe.llm.text import whole
from tabprobe.session import forget, free_shuffles, materialize

BANDS, ROWS = 48, 6
# Signature agreement may fall this many standard deviations short of the threshold.
SLACK = 4.5
# A bucket of more clusters is split; a cluster of more nodes pairs by uncommon shingles.
CROWD, LARGE = 64, 8
SEED = 20_231


def _family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def _sets(column, k: int):
    """(first row, hashes, offsets): sorted distinct shingles of consecutive texts."""
    for row, data, offsets in words.chunks(column):
        data, n = words.FOLD[data], len(offsets) - 1
        start, end, text = words.spans(data, offsets)
        h, t = words.shingles(words.hashes(data, start, end), text, n, k)
        yield (row, *words.distinct(h, t, n))


def _signatures(values: np.ndarray, offsets: np.ndarray):
    """(band keys, minimum bytes) of each set that is not empty."""
    a, b = _family()
    starts = offsets[:-1][offsets[1:] > offsets[:-1]]
    minima = np.empty((len(starts), BANDS * ROWS), np.uint64)
    buffer = np.empty_like(values)
    for j in range(BANDS * ROWS):
        np.multiply(values, a[j], out=buffer)
        np.add(buffer, b[j], out=buffer)
        minima[:, j] = np.minimum.reduceat(buffer, starts)
    keys = np.empty((len(starts), BANDS), np.uint64)
    for band in range(BANDS):
        acc = np.full(len(starts), band + 1, np.uint64)
        for j in range(ROWS):
            acc = words.mix(acc * np.uint64(0xD6E8FEB86659FD93) + minima[:, band * ROWS + j])
        keys[:, band] = acc
    low = (minima >> np.uint64(24)).astype(np.uint8)
    return keys, low, np.packbits(np.unpackbits(low & 3, axis=1).reshape(len(low), -1, 8)[:, :, 6:].reshape(len(low), -1), axis=1)


#: Two bits of each minimum, thirty-two minima in a column: plain columns, which a join can compare cheaply.
SMALL_SIG = [f"m{i}" for i in range(BANDS * ROWS // 32)]
FEATURES = "id bigint, n_shingles bigint, digest binary, bands array<bigint>, sig binary, " + ", ".join(f"{m} bigint" for m in SMALL_SIG)


def _features(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            ids = batch.column("id")
            for row, values, offsets in _sets(batch.column("text"), k):
                n = len(offsets) - 1
                sizes = np.diff(offsets)
                digests = [hashlib.blake2b(values[offsets[i]:offsets[i + 1]].tobytes(), digest_size=16).digest() if sizes[i] else None
                           for i in range(n)]
                full = np.flatnonzero(sizes)
                bands, sigs, small = [None] * n, [None] * n, np.zeros((n, len(SMALL_SIG)), np.int64)
                if len(full):
                    keys, low, two_bits = _signatures(values, offsets)
                    small[full] = two_bits.view(np.int64)
                    for at, i in enumerate(full):
                        bands[i], sigs[i] = keys[at].view(np.int64), low[at].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, n), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                     pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary()), *map(pa.array, small.T)],
                    names=["id", "n_shingles", "digest", "bands", "sig", *SMALL_SIG])

    return docs.mapInArrow(run, FEATURES)


def _full_sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column("id")
            for row, values, offsets in _sets(batch.column("text"), k):
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, n), pa.array([values[offsets[i]:offsets[i + 1]].tobytes() for i in range(n)], pa.binary())],
                    names=["id", "shingles"])

    return docs.mapInArrow(run, "id bigint, shingles binary")


def _least_agreeing(threshold: float, kept_bits: int) -> float:
    """How many minima of similar sets agree at least, compared by so many bits of each."""
    rows, same = BANDS * ROWS, threshold + (1 - threshold) / 2 ** kept_bits
    return rows * same - SLACK * (rows * same * (1 - same)) ** 0.5


def _alike(percent: int):
    """Join condition: enough of the sides' minima agree, by two bits of each."""
    apart = F.lit(0)
    for m in SMALL_SIG:
        x = F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b"))
        apart = apart + F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return apart <= BANDS * ROWS - _least_agreeing(percent / 100, 2)


def _agreeing(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (u, v) whose signatures agree as those of similar sets would, with ``agree`` counted."""
    rows = BANDS * ROWS
    least = _least_agreeing(threshold, 8)
    ships = (pairs.join(sigs.select(F.col("id").alias("u"), F.col("sig").alias("su")), "u")
             .join(sigs.select(F.col("id").alias("v"), F.col("sig").alias("sv")), "v").select("u", "v", "su", "sv"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, rows) for c in ("su", "sv"))
            agree = (left == right).sum(axis=1)
            good = np.flatnonzero(agree >= least)
            yield pa.RecordBatch.from_arrays(
                [batch.column("u").take(pa.array(good)), batch.column("v").take(pa.array(good)), pa.array(agree[good], pa.int32())],
                names=["u", "v", "agree"])

    return ships.mapInArrow(run, "u bigint, v bigint, agree int")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) with 100 * intersection >= percent * union of their full sets."""
    ships = (pairs.select("u", "v").join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("su")), "u")
             .join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("sv")), "v"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            us, vs = [], []
            for u, v, su, sv in zip(*(batch.column(c) for c in ("u", "v", "su", "sv")), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (su, sv))
                both = np.sort(np.concatenate([a, b]), kind="stable")  # two sorted runs: one merge
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(a) + len(b) - common):
                    us.append(u.as_py())
                    vs.append(v.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return ships.mapInArrow(run, "u bigint, v bigint")


def _hub_links(rows: DataFrame) -> DataFrame:
    """Each bucket's nodes with its smallest and a random node: (u, v)."""
    hubs = (rows.groupBy("key").agg(F.min("id").alias("low"), F.min(F.struct(F.xxhash64("id", "key"), "id"))["id"].alias("any"),
                                    F.count("*").alias("n")).where("n > 1"))
    hubs = materialize(hubs, "hubs")  # a table of its own, so that AQE can split a crowded bucket in the join
    near = rows.join(hubs, "key")
    return near.select(F.col("id").alias("u"), F.explode(F.array("low", "any")).alias("v")).where("u <> v").distinct()


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of buckets with two components or more, and how many."""
    n_comps = materialize(rows.groupBy("key").agg(F.count_distinct("comp").alias("n_comps")).where("n_comps > 1"), "mixed")
    return rows.join(n_comps, "key")


def _fits(percent: int, most) :
    """Whether sizes n_a and n_b allow the similarity when the intersection is ``most`` at the most."""
    return most * 100 >= (F.col("n_a") + F.col("n_b") - most) * percent


def _sides(rows: DataFrame, on: list[str], *more: str) -> tuple[DataFrame, DataFrame]:
    return tuple(rows.select(*on, *[F.col(c).alias(f"{c}_{s}") for c in ("id", "comp", "n", *SMALL_SIG, *more)]) for s in "ab")


def _across_clusters(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of one bucket in different clusters (so in different components)."""
    counts = materialize(rows.groupBy("key").agg(F.count_distinct("cluster").alias("n_clusters")).where("n_clusters > 1"), "cluster_counts")
    mixed = rows.join(counts, "key")
    columns = ["key", "id", "comp", "n", "cluster"]
    # Two nodes that share a bucket of few clusters meet there; so a crowded one needs another crowded one only.
    twice = (mixed.where(F.col("n_clusters") > CROWD).groupBy(*columns[1:]).agg(F.array_sort(F.collect_set("key")).alias("keys"))
             .select(*columns[1:], F.posexplode("keys").alias("at", "key"), "keys")
             .select(*columns[1:], "key", F.explode(F.slice("keys", F.col("at") + 2, F.size("keys"))).alias("other"))
             .select(F.xxhash64("key", "other").alias("key"), *columns[1:]))
    met = mixed.where(F.col("n_clusters") <= CROWD).select(*columns).unionByName(twice).join(nodes.select("id", *SMALL_SIG), "id")
    a, b = _sides(met, ["key"], "cluster")
    return (a.join(b, "key").where(F.expr("id_a < id_b and comp_a <> comp_b and cluster_a <> cluster_b")
                                   & _fits(percent, F.least("n_a", "n_b")) & _alike(percent)).select("id_a", "id_b"))


def _within_clusters(rows: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of one cluster in different components.

    Small clusters pair all. In a large one (a crowd of copies, each edited a little), shingles that
    most of its nodes have are its common text, and ``lacks`` is what a node has not of it. Two nodes have
    ``all`` shingles less what either lacks in common, and the uncommon ones they share. If ``all`` less what
    each lacks is enough, they are similar, and the more so is each to the node that is least ``off``: both
    link to that one instead. Of other nodes only those pair that are similar by the common text alone,
    or can be, sharing an uncommon shingle. So pairs grow with the links, not with the square of the cluster.
    """
    members = rows.select("cluster", "id", "comp", "n").distinct()
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"), F.count_distinct("comp").alias("comps")).where("comps > 1")
    members = materialize(members.join(materialize(sizes, "cluster_sizes"), "cluster").join(nodes.select("id", *SMALL_SIG), "id"), "cluster_members")
    across = F.expr("id_a < id_b and comp_a <> comp_b")
    a, b = _sides(members.where(F.col("size") <= LARGE), ["cluster"])
    small = a.join(b, "cluster").where(across & _fits(percent, F.least("n_a", "n_b")) & _alike(percent)).select("id_a", "id_b")

    large = members.where(F.col("size") > LARGE)
    each = sets.join(large.select("id"), "id", "left_semi").mapInArrow(_explode_set, "h bigint, id bigint")
    each = materialize(each.join(large.select("id", "cluster", "size"), "id"), "cluster_shingles")
    counts = materialize(each.groupBy("cluster", "h").agg(F.count("*").alias("c"), F.first("size").alias("size")).where("c > 1"), "shared_shingles")
    common = counts.where("2 * c > size").select("cluster", "h", F.row_number().over(Window.partitionBy("cluster").orderBy("h")).alias("at"))
    part = each.join(common, ["cluster", "h"]).groupBy("id").agg(F.count("*").alias("common"), F.collect_list("at").alias("has"))
    whole_part = common.groupBy("cluster").agg(F.count("*").alias("all"))
    large = (large.join(part, "id", "left").join(whole_part, "cluster", "left")
             .withColumn("common", F.coalesce("common", F.lit(0))).withColumn("all", F.coalesce("all", F.lit(0)))
             .withColumn("lacks", F.when(F.col("all") > F.col("common"), F.array_except(F.sequence(F.lit(1), F.col("all").cast("int")), F.coalesce("has", F.array().cast("array<int>"))))
                         .otherwise(F.array().cast("array<int>")))
             .withColumn("off", (F.col("all") - F.col("common")) * (100 + percent) + F.col("n") * percent))
    large = materialize(large.select("cluster", "id", "comp", "n", *SMALL_SIG, "common", "all", "lacks", "off"), "common_parts")
    middle = large.groupBy("cluster").agg(F.min(F.struct("off", "id", "comp")).alias("mid"))
    # A table of its own, so that AQE can split a large cluster in the joins.
    middle = materialize(middle.select("cluster", F.col("mid.off").alias("mid_off"), F.col("mid.id").alias("mid"), F.col("mid.comp").alias("mid_comp")), "middles")
    large = large.join(middle, "cluster").withColumn("meets", F.col("off") + F.col("mid_off") <= F.col("all") * (100 + percent))
    large = materialize(large.withColumn("near", F.expr("meets or comp = mid_comp")), "off_common")
    star = (large.where("meets and comp <> mid_comp").select(F.least("id", "mid").alias("id_a"), F.greatest("id", "mid").alias("id_b")))
    # What two nodes have of the common text: its size, less what either lacks.
    both = F.col("common_a") + F.col("common_b") - F.col("all_a") + F.size(F.array_intersect("lacks_a", "lacks_b"))
    apart = F.expr("comp_a <> comp_b and not near_a and (near_b or id_a < id_b)")
    a, b = _sides(large.where(F.col("common") * 100 >= F.col("n") * percent), ["cluster"], "common", "all", "lacks", "near")
    bound = (a.where("not near_a").join(b, "cluster")
             .where(apart & _fits(percent, F.least("common_a", "common_b")) & _alike(percent) & _fits(percent, both))
             .select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")))
    uncommon = counts.where("2 * c <= size").select("cluster", "h")
    edits = each.select("cluster", "h", "id").join(uncommon, ["cluster", "h"]).join(large.drop("cluster", "size"), "id")
    a, b = _sides(materialize(edits, "edits"), ["cluster", "h"], "common", "all", "lacks", "near")
    most = both + F.least(F.col("n_a") - F.col("common_a"), F.col("n_b") - F.col("common_b"))
    shared = (a.where("not near_a").join(b, ["cluster", "h"])
              .where(apart & _fits(percent, F.least("n_a", "n_b")) & _alike(percent) & _fits(percent, most))
              .select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")))
    return small.unionByName(star).unionByName(bound).unionByName(shared)


def _across(rows: DataFrame, links: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of one bucket in different components that can still be similar.

    Clusters are the components of the nodes' best hub links whose signatures agree: a crowd of copies is one
    cluster, though the copies edited most may be components of their own.
    """
    clusters = connected_components(links).select(F.col("u").alias("id"), F.col("root").alias("cluster"))
    rows = _mixed(rows).select("key", "id", "comp", "n").join(clusters, "id", "left")
    rows = materialize(rows.withColumn("cluster", F.coalesce("cluster", "id")), "open_buckets")
    pairs = _across_clusters(rows, nodes, percent).unionByName(_within_clusters(rows, nodes, sets, percent))
    return pairs.select(F.col("id_a").alias("u"), F.col("id_b").alias("v")).distinct()


def _explode_set(batches):
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            sets = part.column("shingles").to_pylist()
            sizes = [len(x) // 8 for x in sets]
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(sets), np.int64)),
                                              pa.array(np.repeat(part.column("id").to_numpy(zero_copy_only=False), sizes))], names=["h", "id"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents linked by Jaccard similarity of their distinct k-word shingles.

    Words are runs without ``[\\x20\\x09-\\x0D]``, A-Z lower-cased; a text with fewer than ``k`` words is
    one shingle; a text without words, or null, is an empty set and linked with nothing.

    Returns id_col, ``n_shingles``, ``component_id`` (smallest id reachable), ``kept``: one row per
    input row. Rows without an id are linked with nothing and kept. Rows that repeat an id count
    as one document. An empty table gives an empty table.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), whole(F.col(text_col)).alias("text"))
    features = materialize(_features(base, k), "features")
    members = features.select("id", "n_shingles", "digest")
    classes = (members.where("id is not null and digest is not null").groupBy("digest")
               .agg(F.min("id").alias("class_id"), F.count("*").alias("copies")).where("copies > 1").select("digest", "class_id"))
    classes = materialize(classes, "classes")  # a table of its own, so that AQE can split a hot digest in the join
    members = materialize(members.join(classes, "digest", "left")
                          .select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("node"), F.col("digest").isNull().alias("empty")), "members")
    chosen = members.where("node = id and not empty").select("id").distinct()
    nodes = features.where("digest is not null").join(chosen, "id", "left_semi").dropDuplicates(["id"])
    nodes = materialize(nodes.select("id", F.col("n_shingles").alias("n"), "bands", "sig", *SMALL_SIG), "nodes")
    forget(features)
    free_shuffles(nodes)
    rows = nodes.select("id", "n", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    rows = materialize(rows.join(shared, "key", "left_semi"), "buckets")
    paired = rows.select("id").distinct()
    sets = materialize(_full_sets(base.join(paired, "id", "left_semi"), k).dropDuplicates(["id"]), "sets")
    free_shuffles(sets)

    threshold = percent / 100
    close = _agreeing(_hub_links(rows), nodes, threshold)
    close = materialize(close, "close")
    # A node's two closest hubs, of 2 * BANDS at the most.
    best = Window.partitionBy("u").orderBy(F.desc("agree"), F.desc("v"))
    closest = close.withColumn("at", F.row_number().over(best)).where("at <= 2")
    tries = materialize(closest.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "tries")
    free_shuffles(tries)
    links = materialize(_confirmed(tries, sets, percent), "confirmed")
    first = connected_components(links)
    stars = first.select("u", F.col("root").alias("v"))  # the same components as links, settled in fewer rounds

    labelled = (rows.join(first.select(F.col("u").alias("id"), "root"), "id", "left")
                .select("key", "id", "n", F.coalesce("root", "id").alias("comp")))
    labelled = materialize(labelled, "labelled")
    across = materialize(_across(labelled, tries.unionByName(stars), nodes, sets, percent), "across")
    free_shuffles(across)
    more = _confirmed(_agreeing(across, nodes, threshold), sets, percent)
    roots = connected_components(stars.unionByName(more))
    forget(nodes, rows, sets, close, labelled)
    free_shuffles(roots)

    out = members.join(roots.select(F.col("u").alias("node"), "root"), "node", "left")
    comp = F.coalesce("root", "node")
    return out.select(F.col("id").alias(id_col), "n_shingles", comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"))
