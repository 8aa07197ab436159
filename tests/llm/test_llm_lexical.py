"""Ranked search: best positions against scoring everything, with ties, nulls, repeated rows and several chunks and blocks."""

import math
import random
import re
from collections import Counter

import numpy as np

from tabprobe.llm.lexical import ImpactLists, best_positions, ranked_search, terms_of

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(TERM, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    held = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(1 for _, t in held if t), sum(len(t) for _, t in held)
    df = Counter(t for _, ts in held for t in set(ts))
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in set(items):
        scores = []
        for i, ts in held:
            tf, m = Counter(ts), 100 - 90 + 90 * len(ts) * n_docs // max(n_terms, 1)
            score = sum(w[t] * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in set(terms(text)) if tf[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def test_terms():
    for text in ("Größe ÄB 12x_y-z\x7fK", "", " .", "漢字 1,000 a\x00b"):
        assert [t.decode() for t in terms_of(text.encode())] == terms(text)


def test_search_against_scoring_everything(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(40)] + ["É", "Ab"]
    text = lambda n: " ".join(rng.choice(vocab[:rng.randrange(1, len(vocab) + 1)]) for _ in range(n))
    docs = [(i, text(rng.randrange(25))) for i in range(300)]
    docs += [(3, docs[5][1]), (3, docs[5][1]), (None, docs[7][1]), (None, "w1 w2"), (400, None), (401, ""), (402, "w1 " * 20_000), (403, "..."),
             *[(500 + i, "w3 w4 ab") for i in range(25)]]
    items = [(i, text(6)) for i in range(20)] + [(1, "w3 w4 AB w3"), (1, "w3 w4 AB w3"), (2, None), (4, ""), (None, "w9 É"), (6, "unknown"), (7, " ".join(vocab))]
    df = spark.createDataFrame([(*d, 0, "x", None) for d in docs], "doc_id bigint, text string, q int, item_id string, score bigint").repartition(3)
    asked = spark.createDataFrame([(*i, 1, "x") for i in items], "item_id bigint, text string, rank int, id string")
    want = brute(docs, [i for i in items if i[1] is not None], 10)
    for kw in ({}, {"chunk_postings": 50, "block_items": 4}):
        assert sorted(map(tuple, ranked_search(df, asked, **kw).collect()), key=str) == want
    for empty in ((df.where("false"), asked), (df, asked.where("false"))):
        assert ranked_search(*empty).count() == 0


def test_stops_before_the_lists_end():
    rng = np.random.default_rng(3)
    n_docs, n_lists = 20_000, 6
    postings = [(t, d, int(1e6 / (1 + rng.exponential() * 50)) + 1) for t in range(n_lists) for d in np.flatnonzero(rng.random(n_docs) < 0.5)]
    postings.sort(key=lambda p: p[1])
    t, d, i = (np.array(x, np.int64) for x in zip(*postings))
    lists, met = ImpactLists(t, d, i), np.zeros(n_docs, bool)
    ids = rng.permutation(n_docs)
    wanted = np.array([0, 2, 5, 99])
    (scores, found), looked_up = best_positions(lists, wanted, met, 10, (np.zeros(0, np.int64), np.zeros(0, np.int64)), ids)
    total = np.zeros(n_docs, np.int64)
    np.add.at(total, d[np.isin(t, wanted)], i[np.isin(t, wanted)])
    order = np.lexsort((ids, -total))[:10]
    assert list(scores) == list(total[order]) and list(found) == list(ids[order])
    assert not met.any() and looked_up < n_docs / 4
