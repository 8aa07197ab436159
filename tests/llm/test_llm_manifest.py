"""Merkle manifest: against brute force with nulls, repeated rows, lone leaves and trees of several strips."""

import hashlib

from pyspark.sql import functions as F

from tabprobe.llm.manifest import FIELDS, LEVELS, build_manifest, leaf_digest, nodes, proof_digest, proofs, verify

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, tree int, lo string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(doc, text):
    doc_id, _, lang, source, n = doc[:5]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))


def climb(digests):
    """All levels, and the path of each leaf as (left, right) pairs."""
    levels = [digests]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i:i + 3])) for i in range(0, len(below), 3)])
    paths = []
    for r in range(len(digests)):
        path = []
        for below in levels[:-1]:
            start = r // 3 * 3
            path.append(("".join(below[start:r]), "".join(below[r + 1:start + 3])))
            r //= 3
        paths.append(path)
    return levels, paths


def brute(docs, later):
    trees = {}
    for d in docs:
        trees.setdefault(d[3], []).append((d[0] is not None, d[0] or 0, leaf_of(d, d[1]), d))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    parts = []
    for s in order:
        leaves = sorted(trees[s], key=lambda x: x[:3])
        parts.append((leaves, *climb([x[2] for x in leaves])))
    top, top_paths = climb([p[1][-1][0] for p in parts])
    out = []
    for (leaves, levels, paths), above in zip(parts, top_paths):
        for (_, _, leaf, d), path in zip(leaves, paths):
            way = path + above
            acc = leaf_of(d, later(d))
            for left, right in way:
                acc = sha(left + acc + right)
            out.append((d[0], leaf, levels[-1][0], top[-1][0], sha("".join(x + y for x, y in way)), acc, acc == top[-1][0]))
    return out, [len(p[1]) for p in parts]


def made(spark, docs):
    return spark.createDataFrame([(*d, "x", 3, None) for d in docs], SCHEMA)


def sample():
    docs = [(i, None if i % 50 == 9 else f"text {i}\nline" * (i % 3), "en" if i % 4 else None, "big", i) for i in range(3, 400)]
    docs += [(i, "a\nb", "de", None, None) for i in (7, 2, 9, 11)]
    docs += [(5, "", None, "lone", 0), (1, "é\n" * 40_000, "fr", "É", 1), (None, "no id\n", None, "big", 1), (None, "no id either", None, "big", 1)]
    docs += [(8, "same\n", "en", "copies", 5)] * 30 + [(8, "other", "en", "copies", 5), (4, "-", "en", "", 1)]
    return docs


def test_manifest_against_brute_force(spark):
    docs = sample()
    later = lambda d: d[1].replace("\n", "") if d[1] is not None and (d[0] or 1) % 2 == 0 else d[1]
    odd = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    text = F.when(odd, F.translate("text", "\n", "")).otherwise(F.col("text"))
    df = made(spark, docs).repartition(5)
    manifest = build_manifest(df, tampered=leaf_digest([text if c == "text" else F.col(c) for c in FIELDS]))
    assert len(manifest.layers) == 2  # a tree of more leaves than one strip holds
    got = verify(proofs(manifest)).select("id", "leaf", "subroot", "root", proof_digest(F.col("path")), "folded_root", "verified").collect()
    want, _ = brute(docs, later)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {r["verified"] for r in got} == {True, False}


def test_nodes_carry_nested_intervals(spark):
    manifest = build_manifest(made(spark, sample()))
    held = {}
    for r in nodes(manifest).where("tree = 'sbig'").collect():
        held.setdefault(r["level"], []).append((r["lo"], r["hi"]))
    n = len(held[0])
    assert n == 399 and max(held) > LEVELS and held[max(held)] == [(0, n)]
    for level, spans in held.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert all(lo % 3 ** level == 0 and hi == min(lo + 3 ** level, n) for lo, hi in spans)


def test_untouched_rows_verify_and_empty_table(spark):
    docs = [(i, "t", "en", "s", 1) for i in range(10)]
    assert {r["verified"] for r in verify(proofs(build_manifest(made(spark, docs)))).collect()} == {True}
    empty = verify(proofs(build_manifest(made(spark, []))))
    assert empty.count() == 0
