"""MinHash near-duplicates, components, suffix arrays and passage removal against brute force."""

import os
import random
import re

import numpy as np

import tabprobe.llm.suffix_dedup as S
from tabprobe.llm import minhash
from tabprobe.llm.components import connected_components
from tabprobe.llm.minhash import near_duplicates
from tabprobe.llm.suffix import common_prefixes, suffix_array
from tabprobe.llm.words import BLANK, chunks, hashes, spans
from tabprobe.session import forget, materialize


def table(spark, rows):
    return spark.createDataFrame([(i, t, 7, "c") for i, t in rows], "doc_id bigint, text string, n_shingles int, digest string")


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def brute_components(rows, k, percent=80):
    sets = {i: shingle_set(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(80)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 90)))) for i in range(60)]
    for i in range(60, 160):  # a crowd of near copies, some edited too much
        words = list(base)
        for _ in range(rng.randint(0, 12)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "One"), (204, "one"), (205, "one two"), (206, "é É"), (207, " ".join(base).upper()), (208, "a " * 20_000)]
    for k in (2, 5):
        want = brute_components(rows, k)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(table(spark, rows), k=k).collect()}
        assert got == want


def test_crowd_of_edited_copies_makes_few_pairs(spark, monkeypatch):
    """Copies edited too much to be similar stay apart without pairing each with each."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    made, within = [], minhash._within_clusters
    monkeypatch.setattr(minhash, "_within_clusters", lambda *a: made.append(within(*a)) or made[0])
    monkeypatch.setattr(minhash, "forget", lambda *t: None)
    found = near_duplicates(table(spark, rows), k=5)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == brute_components(rows, 5)
    assert made[0].count() < len(rows)


def test_forget_deletes_stored_tables(spark):
    kept, gone = materialize(spark.range(5), "kept"), materialize(spark.range(7), "gone")
    path = gone.inputFiles()[0].removeprefix("file:")
    assert os.path.exists(path)
    forget(gone)
    assert not os.path.exists(path) and kept.count() == 5
    assert near_duplicates(table(spark, [])).count() == 0
    lone = near_duplicates(table(spark, [(None, "a b"), (None, "a b"), (3, "a b"), (3, "a b")]), k=2).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in lone) == [(0, 0, True), (0, 0, True), (3, 3, True), (3, 3, True)]


def test_links_seldom_share_fewer_than_two_bands():
    # crowded buckets ask for a second band
    band = 0.8 ** minhash.ROWS
    none = (1 - band) ** minhash.BANDS
    one = minhash.BANDS * band * (1 - band) ** (minhash.BANDS - 1)
    assert none + one <= 1e-5


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, j) for j in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    edges = spark.createDataFrame(pairs + [(5, 5), (None, 3)], "u bigint, v bigint")
    got = {r["u"]: r["root"] for r in connected_components(edges).collect()}
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root if find(x) != x}
    assert connected_components(edges.limit(0)).count() == 0


def test_word_spans_and_hashes():
    import pyarrow as pa

    texts = ["ab  cd\tab", None, "", "ab", "é\nab"]
    for _, data, offsets in chunks(pa.array(texts)):
        start, end, text = spans(data, offsets)
        raw = data.tobytes()
        assert [raw[a:b].decode() for a, b in zip(start, end)] == ["ab", "cd", "ab", "ab", "é", "ab"] and text.tolist() == [0, 0, 0, 3, 4, 4]
        h = hashes(data, start, end)
        assert h[0] == h[2] == h[3] == h[5] and len(set(h.tolist())) == 3
    assert BLANK.sum() == 6


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(0)
    for _ in range(150):
        s = rng.integers(0, int(rng.integers(1, 6)), int(rng.integers(1, 70))).astype(np.uint8)
        assert suffix_array(s, 256).tolist() == sorted(range(len(s)), key=lambda i: bytes(s[i:]))
    data = np.frombuffer(b"abcabcabdxabcabcabd" * 3 + b"zz" * 40, np.uint8)
    order, raw = suffix_array(data, 256, 10), data.tobytes()
    shared = common_prefixes(data, order, 10)
    assert all(raw[a:a + 10] <= raw[b:b + 10] for a, b in zip(order[:-1], order[1:]))
    assert [bool(shared[b]) for a, b in zip(order[:-1], order[1:])] == [
        raw[a:a + 10] == raw[b:b + 10] and max(a, b) + 10 <= len(raw) for a, b in zip(order[:-1], order[1:])]


def brute_passages(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - length + 1):
            if i is not None:
                first[b[j:j + length]] = min(first.get(b[j:j + length], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if i is not None and first[b[j:j + length]] < i:
                gone[j:j + length] = b"\1" * length
        spans_ = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((i or 0, len(b), spans_, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out)


def passages(spark, rows):
    return sorted((r["doc_id"] or 0, r["n_bytes"], [(s["start"], s["stop"]) for s in r["spans"]], bytes(r["kept"]))
                  for r in S.dedup_passages(table(spark, rows)).collect())


def passage_rows():
    rng = random.Random(3)
    words = ["the", "of", "één", "naïve", "longer", "x", "passage", "und", "日本"]

    def text(n):
        return " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(n))

    shared, other = text(14), text(20)
    rows = [(i, text(rng.randint(1, 40)) + (shared[rng.randrange(20):] if i % 3 else "") + text(5) + (other if i % 4 == 0 else "")) for i in range(30)]
    copy = text(30)
    return rows + [(40, copy), (41, copy), (42, copy + " "), (43, copy[1:]), (44, "short"), (45, "short"), (46, None), (47, ""), (None, copy),
                   (50, "a" * 300), (51, "b" + "a" * 120 + "c"), (52, "a" * 49), (53, "a" * 50), (54, "ab" * 100), (55, "ba" * 60), (41, copy), (56, shared[:50]), (57, shared[:49])]


def test_passages_against_brute_force(spark, monkeypatch):
    rows = passage_rows()
    want = brute_passages(rows)
    assert passages(spark, rows) == want
    assert passages(spark, []) == []
    monkeypatch.setattr(S, "CROWDED", 1)  # the way for anchors with very many distinct segments
    assert passages(spark, rows) == want
