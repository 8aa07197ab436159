"""Merkle manifest of a dataset, with nested-interval labels.

Every node carries the half-open interval ``[lo, hi)`` of the leaf ranks below it, so ancestry is
containment: no pointer or path is stored with a node, and a node's level is a matter of its width.

* Leaf ranks come from a range partition on (tree, id): running counts inside each partition and
  the partitions' offsets. A tree that holds a third of all rows is spread like any other.
* Nodes are made ``LEVELS`` levels at a time: a *strip* gathers the at most ``fanout ** LEVELS``
  nodes whose intervals fall into one bucket of that width, and hashes them up to one node. So a
  hundred billion leaves need six grouping steps, each on 1/81 of the one before.
* Proofs go from the top down. A strip meets its parent strip by a join on the bucket that its
  interval falls into, with containment as the condition; the siblings of a node on each level are
  the interval difference: the nodes inside the parent's interval but for the node's own. What lies
  above a strip is found once for the strip, not once for each leaf.

The subroots, ordered by tree, are the leaves of one more such tree, whose top is the root.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe.session import materialize

FANOUT = 3
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH_TYPE = "array<struct<left:string,right:string>>"


@dataclass
class Manifest:
    """``layers`` and ``top``: strips from the leaves up, of the trees and of the tree over subroots."""

    layers: list[DataFrame]
    top: list[DataFrame]
    fanout: int


def encoded(value: Column) -> Column:
    """UTF-8 byte count, ``:``, value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(fields: Sequence[Column]) -> Column:
    return digest(*[encoded(c) for c in fields])


def tree_key(source: Column) -> Column:
    """A key without nulls in the order of the trees: null first, then UTF-8 bytewise."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def _number_rows(batches):
    """Rows arrive sorted by tree within a range partition; adds the partition and the row's place
    among the partition's rows of its tree."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    pid, last, carry = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        tree = batch.column("tree")
        new = np.ones(n, bool)
        if n > 1:
            new[1:] = pc.not_equal(tree[1:], tree[:-1]).to_numpy(zero_copy_only=False)
        at = np.arange(n)
        place = at - np.maximum.accumulate(np.where(new, at, 0))
        if last is not None and tree[0].as_py() == last:
            runs = np.flatnonzero(new)
            place[:runs[1] if len(runs) > 1 else n] += carry
        last, carry = tree[n - 1].as_py(), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, pid, np.int32)), pa.array(place.astype(np.int64))],
                                         names=[*batch.schema.names, "pid", "place"])


def ranked(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Adds ``lo`` (rank from 0 within the tree) and ``n`` (the tree's rows) to a stored table.

    No window holds a tree's rows: they are range-partitioned on (tree, *order) and numbered inside
    their partition; the offsets come from one row per (tree, partition).
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("pid", T.IntegerType()), T.StructField("place", T.LongType())])
    keys = ["tree", *order]
    blocks = materialize(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_number_rows, schema), name)
    held = blocks.groupBy("tree", "pid").agg(F.count("*").alias("held"))
    before = Window.partitionBy("tree").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("tree", "pid", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"),
                          F.sum("held").over(Window.partitionBy("tree")).alias("n"))
    joined = blocks.join(offsets, ["tree", "pid"])
    return joined.withColumn("lo", F.col("offset") + F.col("place")).drop("pid", "place", "offset")


def _parents(nodes: Column, fanout: int) -> Column:
    """The next level: every ``fanout`` consecutive nodes (the last run may be shorter) become one."""
    def parent(i):
        run = F.slice(nodes, i * fanout + 1, fanout)
        return F.struct(run[0]["lo"].alias("lo"), F.element_at(run, -1)["hi"].alias("hi"),
                        F.sha2(F.array_join(F.transform(run, lambda x: x["digest"]), ""), 256).alias("digest"))

    return F.transform(F.sequence(F.lit(0), ((F.size(nodes) - 1) / fanout).cast("int")), parent)


def _strips(nodes: DataFrame, width: int, fanout: int, name: str, extra: Sequence[str] = ()) -> DataFrame:
    """Strips (tree, n, bucket, lo, hi, ended, l0 ... lLEVELS, digest) from nodes (tree, n, lo, hi, digest).

    ``width``: leaf ranks that a strip covers. A tree of at most so many leaves ends here: its one
    strip stops at the first level with a single node. ``extra`` columns go along with l0's nodes.
    """
    node = F.struct("lo", "hi", "digest", *extra)
    out = (nodes.groupBy("tree", "n", F.expr(f"lo div {width}L").alias("bucket"))
           .agg(F.array_sort(F.collect_list(node)).alias("l0"))
           .withColumn("ended", F.col("n") <= width))
    empty = F.array().cast("array<struct<lo:bigint,hi:bigint,digest:string>>")
    for j in range(LEVELS):
        at = F.col(f"l{j}")
        over = (F.size(at) == 0) | (F.col("ended") & (F.size(at) == 1))
        out = out.withColumn(f"l{j + 1}", F.when(over, empty).otherwise(_parents(at, fanout)))
    top = F.lit(None).cast("string")
    for j in range(LEVELS + 1):
        top = F.when(F.size(f"l{j}") == 1, F.col(f"l{j}")[0]["digest"]).otherwise(top) if j else \
            F.when(F.size("l0") == 1, F.col("l0")[0]["digest"])
    return materialize(out.withColumn("lo", F.col("l0")[0]["lo"]).withColumn("hi", F.element_at("l0", -1)["hi"])
                       .withColumn("digest", top), name)


def _layers(leaves: DataFrame, fanout: int, name: str, extra: Sequence[str] = ()) -> list[DataFrame]:
    step = fanout ** LEVELS
    width, out = step, [_strips(leaves, step, fanout, f"{name}0", extra)]
    while not out[-1].where("not ended").isEmpty():
        width *= step
        nodes = out[-1].where("not ended").select("tree", "n", "lo", "hi", "digest")
        out.append(_strips(nodes, width, fanout, f"{name}{len(out)}"))
    return out


def build_manifest(docs: DataFrame, id_col: str = "doc_id", tree_col: str = "source", fields: Sequence[str] = FIELDS,
                   tampered: Column | None = None, fanout: int = FANOUT) -> Manifest:
    """One tree per value of ``tree_col`` over the rows in the order of their ids, and a tree over the trees.

    A leaf is the digest of the row's ``fields``, each as byte count, colon and value, or ``-`` for
    null. Null ids come first; rows that repeat an id follow each other in the order of their digests.
    ``tampered``: the leaf digest that a later reading of the row would give (an expression over
    ``docs``), kept beside the leaf for ``proofs``. An empty table gives a manifest without nodes.
    """
    leaf = leaf_digest([F.col(c) for c in fields])
    other = F.when(tampered != leaf, tampered) if tampered is not None else F.lit(None).cast("string")
    # The tie number spreads a row that is repeated very often over several ranges.
    rows = materialize(docs.select(tree_key(F.col(tree_col)).alias("tree"), F.col(id_col).cast("bigint").alias("id"),
                                   leaf.alias("digest"), other.alias("other"))
                       .withColumn("tie", F.monotonically_increasing_id()), "manifest_leaves")
    leaves = ranked(rows, ["id", "digest", "tie"], "manifest_ranks").withColumn("hi", F.col("lo") + 1)
    layers = _layers(leaves, fanout, "manifest_strips", ["id", "other"])
    subroots = None
    for strips in layers:
        own = strips.where("ended").select("tree", "digest")
        subroots = own if subroots is None else subroots.unionByName(own)
    stored = materialize(subroots.select(F.lit("all").alias("tree"), F.col("tree").alias("name"), "digest"), "manifest_subroots")
    tops = ranked(stored, ["name"], "manifest_subroot_ranks").withColumn("hi", F.col("lo") + 1)
    return Manifest(layers, _layers(tops, fanout, "manifest_top", ["name"]), fanout)


def nodes(manifest: Manifest) -> DataFrame:
    """Every node of every tree: tree, level (0: leaves), lo, hi, digest; tree ``all`` is over the subroots."""
    out = None
    for strips_of in (manifest.layers, manifest.top):
        for k, strips in enumerate(strips_of):
            for j in range(0 if k == 0 else 1, LEVELS + 1):
                part = strips.select("tree", F.lit(k * LEVELS + j).alias("level"), F.explode(
                    F.transform(f"l{j}", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), x["digest"].alias("digest")))).alias("x")
                ).select("tree", "level", "x.*")
                out = part if out is None else out.unionByName(part)
    return out


def _path_in(lo: Column, hi: Column, levels: Sequence[Column]) -> Column:
    """The siblings of the node ``[lo, hi)`` and of its ancestors inside a strip, level by level:
    digests left of it and right of it, concatenated."""
    def step(below):
        def siblings(parent):
            inside = F.filter(below, lambda x: (x["lo"] >= parent["lo"]) & (x["hi"] <= parent["hi"]))
            side = lambda keep: F.array_join(F.transform(F.filter(inside, keep), lambda x: x["digest"]), "")
            return F.struct(side(lambda x: x["hi"] <= lo).alias("left"), side(lambda x: x["lo"] >= hi).alias("right"))

        return siblings

    steps = [F.transform(F.filter(above, lambda x: (x["lo"] <= lo) & (x["hi"] >= hi)), step(below))
             for below, above in zip(levels, levels[1:])]
    return F.concat(*steps)


def _with_above(layers: list[DataFrame], over: DataFrame, fanout: int) -> DataFrame:
    """Strips of the lowest layer with ``above``, the path of the strip's top node to the root, and
    the columns of ``over`` (tree, above, ...), which holds the path from each tree's own top."""
    step = fanout ** LEVELS
    carried = [c for c in over.columns if c not in ("tree", "above")]
    known = None
    for k in range(len(layers) - 1, -1, -1):
        ended = layers[k].where("ended").join(over, "tree")
        if known is None:
            known = ended
            continue
        width = step ** (k + 2)
        up = known.select("tree", F.col("bucket").alias("up"), F.col("lo").alias("up_lo"), F.col("hi").alias("up_hi"),
                          *[F.transform(f"l{j}", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), x["digest"].alias("digest")))
                            .alias(f"u{j}") for j in range(LEVELS + 1)], "above", *carried)
        inner = layers[k].where("not ended").withColumn("up", F.expr(f"lo div {width}L"))
        met = inner.join(up, ["tree", "up"]).where("up_lo <= lo and hi <= up_hi")
        path = F.concat(_path_in(F.col("lo"), F.col("hi"), [F.col(f"u{j}") for j in range(LEVELS + 1)]), F.col("above"))
        met = met.withColumn("above", path).select(*ended.columns)
        known = ended.unionByName(met)
    return known


def _leaf_paths(strips: DataFrame, keep: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """One row per leaf: ``keep`` fields of the leaf, digest, path, and ``carried`` columns of the strip."""
    levels = [F.col(f"l{j}") for j in range(LEVELS + 1)]
    found = F.transform("l0", lambda x: F.struct(
        *[x[c].alias(c) for c in keep], x["digest"].alias("digest"),
        F.concat(_path_in(x["lo"], x["hi"], levels), F.col("above")).alias("path")))
    return strips.select(F.explode(found).alias("x"), *carried).select("x.*", *carried)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))


def proofs(manifest: Manifest) -> DataFrame:
    """One row per leaf: tree, id, leaf, other (the later digest where it differs, else null), path (array of the
    siblings' digests left and right of the way up, from the leaf's level to the root), subroot, root."""
    root_path = manifest.top[-1].select("tree", "digest").select("tree", F.col("digest").alias("root"),
                                                                F.array().cast(PATH_TYPE).alias("above"))
    over = _leaf_paths(_with_above(manifest.top, root_path, manifest.fanout), ["name"], ["root"])
    over = over.select(F.col("name").alias("tree"), F.col("path").alias("above"), F.col("digest").alias("subroot"), "root")
    strips = _with_above(manifest.layers, over, manifest.fanout)
    return (_leaf_paths(strips, ["id", "other"], ["tree", "subroot", "root"])
            .select("tree", "id", F.col("digest").alias("leaf"), "other", "path", "subroot", "root"))


def verify(proof: DataFrame) -> DataFrame:
    """Adds ``folded_root``, recomputed from the later digest (else the original leaf) and the original
    siblings, and ``verified``: whether it is the root."""
    out = proof.withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("path")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)
