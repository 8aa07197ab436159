"""Each stage of the corpus pipeline, and the whole run, against brute force over small tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tabprobe.llm import chat, linear
from tabprobe.llm.quality import PASSES, SIZE, held_out, quality_scores, score_quality, train_quality
from tabprobe.llm.queries import piece_model
from tests.llm.test_llm_near_and_passages import brute_components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, digest int, score int, kept string"


def documents(spark, rows):
    """A documents table with extra columns whose names the stages use themselves."""
    return spark.createDataFrame([(i, t, "en", "web", len(t or ""), "x", 1, 2, "y") for i, t in rows], SCHEMA)


def pairs(df):
    assert df.columns == list(cp.COLUMNS)
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_exact(rows):
    best = {}
    for i, t in rows:
        key = (i is not None, i or 0)
        old = best.get(fold(t))
        # Of one id the first in column order; null text comes first.
        if old is None or key > old[0] or key == old[0] and (t is not None, t or "") < (old[1][1] is not None, old[1][1] or ""):
            best[fold(t)] = (key, (i, t))
    return Counter(v for _, v in best.values())


ODD = [(1, "one text"), (2, "One Text"), (2, "one text"), (2, "another"), (2, "another"), (3, None), (4, ""), (None, "alone"), (None, "ALONE"),
       (None, "one text"), (None, "by itself"), (5, "é É"), (6, "É É"), (7, "w " * 30_000), (8, "W " * 30_000), (-9, "below"), (None, "Below")]


def test_exact_stage(spark):
    rng = random.Random(4)
    rows = ODD + [(rng.choice([None, rng.randrange(60)]), rng.choice(["a", "A", "b", "c d", "C D", ""]) * rng.randint(1, 2)) for _ in range(300)]
    assert pairs(cp.exact(spark, documents(spark, rows), SF)) == brute_exact(rows)
    assert pairs(cp.exact(spark, documents(spark, []), SF)) == Counter()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stages_move_texts_once_at_most(spark):
    docs = documents(spark, ODD)
    near = plan(cp.near(spark, docs, SF))
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert plan(cp.exact(spark, docs, SF)).count("SortMergeJoin") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert "BroadcastHashJoin" in near and "SortMergeJoin" not in near


def brute_near(rows):
    kept = brute_components([(i, t) for i, t in rows if i is not None], 5)
    return Counter((i, t) for i, t in rows if i is None or kept[i][1] == i)


def test_near_stage(spark):
    rng = random.Random(5)
    base = [rng.choice("abcdefghijklmnop") * 3 for _ in range(60)]
    rows = [(i, t) for i, (_, t) in enumerate(ODD)] + [(None, " ".join(base)), (None, " ".join(base))]
    for i in range(100, 160):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(60)] = rng.choice("qrstuv")
        rows.append((i, " ".join(words)))
    rows += [(100, rows[-60][1])]  # a repeated row shares its id's verdict
    assert pairs(cp.near(spark, documents(spark, rows), SF)) == brute_near(rows)
    assert pairs(cp.near(spark, documents(spark, []), SF)) == Counter()


def test_decontaminate_stage(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    clean = [(i, t) for i, (_, t) in enumerate(ODD)] + [(None, item), (90, "z " * 40_000)]
    rows = clean + [(50, f"before {item} after"), (51, "z " * 40_000 + item), (52, item), (52, "shares its id's verdict")]
    assert pairs(cp.decontaminate(spark, documents(spark, rows), SF)) == Counter(clean)
    assert pairs(cp.decontaminate(spark, documents(spark, []), SF)) == Counter()


def plain_features(text):
    """The classifier's row of one text, from its own feature function: hashing is not what is tested here."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    bucket, weight, _ = linear.features(data, np.array([0, len(data)]))
    return list(zip(bucket.astype(int).tolist(), weight.astype(np.float32).astype(float).tolist())) + [(SIZE - 1, 1.0)]


def plain_ftrl(rows, labels, order, alpha=0.3, beta=1.0, l1=0.05, l2=0.02):
    """FTRL-Proximal one number at a time."""
    z, n = Counter(), Counter()

    def weight(k):
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    for i in order:
        w = {k: weight(k) for k, _ in rows[i]}
        p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w[k] * x for k, x in rows[i])))))
        for k, x in rows[i]:
            g = (p - labels[i]) * x
            z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * w[k]
            n[k] += g * g
    return {k: weight(k) for k in z}


def test_quality_against_plain_ftrl(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    train = (docs.join(labels, "doc_id").where(~held_out(F.col("doc_id"))).orderBy("doc_id").select("doc_id", "text", "quality").collect())
    rows, y = [plain_features(r["text"]) for r in train], [float(r["quality"]) for r in train]
    rng = np.random.default_rng(0)
    want = plain_ftrl(rows, y, [int(i) for _ in range(PASSES) for i in rng.permutation(len(rows))])
    got = train_quality(docs, labels)
    assert len(got) == SIZE and {k for k in np.flatnonzero(got)} <= set(want)
    assert max(abs(got[k] - w) for k, w in want.items()) < 1e-5
    scores = {r["doc_id"]: r["score"] for r in quality_scores(docs, labels).collect()}
    for r in docs.collect():
        s = sum(want.get(k, 0.0) * x for k, x in plain_features(r["text"]))
        assert scores[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-s)), abs=1e-4)


def test_quality_stage_keeps_rows_of_their_own(spark):
    rows = [(i, t) for i, t in ODD]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    df = documents(spark, rows)
    scored = score_quality(df, train_quality(df, labels)).collect()
    got = pairs(cp.quality(spark, df, SF))
    assert sum(got.values()) == sum(r["score"] >= 0.3 for r in scored) and not got - Counter((i, t or "") for i, t in rows)
    assert pairs(cp.quality(spark, documents(spark, []), SF)) == Counter()


def test_run_against_brute_force(spark):
    import sentencepiece

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r["doc_id"]: r["score"] for r in quality_scores(docs, labels).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if scores[r["doc_id"]] >= 0.3]
    rows = list(brute_near(list(brute_exact(rows))))
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[i:i + 8]) for t in bench for w in [re.findall(r"\w+", t.lower())] for i in range(len(w) - 7)}

    def overlaps(text):
        w = re.findall(r"\w+", text.lower())
        return any(tuple(w[i:i + 8]) in grams for i in range(len(w) - 7))

    out = {r["doc_id"]: r for r in cp.run(spark, SF).collect()}
    left = {i for i, t in rows if not any(b.lower() in t.lower() for b in bench)}
    assert set(out) <= left and {i for i, t in rows if not overlaps(t)} <= set(out)
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    text = dict(rows)
    assert all(list(r["ids"]) == sp.encode(text[i]) and r["n_tokens"] == len(r["ids"]) for i, r in out.items())


def brute_windows(turns, budget, history):
    """(new turns, repeated turns, tokens) of each window, from prefix sums over the turns' tokens."""
    cost = [len(re.findall(r"\w+|[^\w\s]", t, re.ASCII)) + chat.TURN_TOKENS for _, t in turns]
    at = [0]
    for c in cost:
        at.append(at[-1] + c)
    system = 1 if turns[0][0] == "system" else 0
    out, start = [], 0
    while start < len(turns):
        head = cost[0] if system and start else 0
        first = start
        while first > system and at[start] - at[first - 1] <= history:
            first -= 1
        if head + at[start + 1] - at[first] > budget:
            first = start
        end = start + 1
        while end < len(turns) and head + at[end + 1] - at[first] <= budget:
            end += 1
        out.append((end - start, start - first + (head > 0), head + at[end] - at[first]))
        start = end
    return out


def test_chat_windows_against_prefix_sums(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for conv in range(60):
        n = rng.randint(1, 25)
        turns = [("system" if k == 0 and conv % 2 else rng.choice(["user", "assistant"]), " ".join(["w,"] * rng.choice([0, 1, 5, 12, 40]))) for k in range(n)]
        rows += [(conv, k, *t) for k, t in enumerate(turns)]
        want[conv] = brute_windows(turns, 60, 30)
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {}
    for w in chat.format_chats(table, budget=60, history=30).orderBy("conv_id", "window").collect():
        assert len(chat.parse(w["formatted"])) == w["n_turns"] + w["n_repeated"]
        got.setdefault(w["conv_id"], []).append((w["n_turns"], w["n_repeated"], w["n_tokens"]))
    assert got == want
