"""Classifiers (held-out accuracy), SentencePiece codec (round trip), chat windows, decontamination, pipeline."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from tabprobe.llm import chat
from tabprobe.llm.decontaminate import contaminated
from tabprobe.llm.piece_codec import PieceCodec, encode_decode, load_tables
from tabprobe.llm.quality import quality_scores
from tabprobe.llm.queries import ORACLE, QUERIES, piece_model
from tabprobe.llm.toxicity import fit_chain, toxicity_scores

SF = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality_scores(docs, labels)
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert scored.count() == docs.count()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.93 and all(r["predicted"] for r in rows if r["quality"])
    odd = spark.createDataFrame([(None, "x", 1), (1, None, 1), (1, "", 1), (2, "w " * 30_000, 1)], "doc_id bigint, text string, score int")
    got = quality_scores(odd, labels.limit(0)).collect()
    assert [r["score"] for r in got] == [0.5] * 4 and [r["predicted"] for r in got] == [1] * 4
    assert quality_scores(odd.limit(0), labels).count() == 0


def test_toxicity_chain(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity_scores(docs, labels).join(labels.withColumnRenamed("toxic", "label"), "doc_id").collect()
    seen = [r for r in rows if not r["held_out"]]
    assert np.mean([r["toxic"] == bool(r["label"]) for r in seen]) > 0.93
    assert sum(r["toxic"] and not r["label"] for r in rows) <= 3
    odd = spark.createDataFrame([(None, "x"), (1, None), (1, "")], "doc_id bigint, text string")
    assert [r["p_toxic"] for r in toxicity_scores(odd, labels.limit(0)).collect()] == [0.5] * 3
    assert toxicity_scores(odd.limit(0), labels).count() == 0


def test_chain_uses_earlier_links():
    # the second category is the first one's, on rows whose terms say nothing of it
    rng = np.random.default_rng(0)
    first = rng.integers(0, 2, 300)
    rows = [np.array([0] if f else [], np.int64) for f in first]
    y = np.column_stack([first, first]).astype(float)
    links = fit_chain(rows, np.zeros((300, 4)), y, np.arange(300) % 5, 1)
    assert [len(w) for w in links] == [6, 7] and links[1][5] > 0


def test_codec_equals_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    codec, rng = PieceCodec(load_tables(piece_model())), random.Random(1)
    alphabet = list("abcdefgh the in er   \n\t\0é日本🎉▁\u200b\ufeff\u0308ñ<>0x41|*$%") + ["</s>", "<s>", "<0x41>"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(1500)]
    texts += [" " * n + "word" + " " * (n % 37) for n in range(60)] + ["x" * 5000, "ab" * 2000, "", " ", "▁▁ ▁"]
    for t in texts:
        ids = np.frombuffer(codec.encode(t), np.int32).tolist()
        assert ids == sp.encode(t) and codec.decode(ids) == sp.decode(ids), t


def test_codec_table(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    rows = [(1, "Hello world"), (2, None), (3, ""), (None, "é"), (1, "Hello world"), (4, "w " * 20_000)]
    got = encode_decode(spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, ids int"), piece_model()).collect()
    want = [(i, sp.encode(t or ""), sp.decode(sp.encode(t or ""))) for i, t in rows]
    assert sorted(map(str, [(r["doc_id"], r["ids"], r["decoded"]) for r in got])) == sorted(map(str, want))


def test_chat_round_trip(spark):
    quoted = r"\### Assistant: </turn> ok"
    turns = [(-7, 0, "user", quoted), (-7, 1, "assistant", quoted), (1, 0, "system", "be brief"), (2, 0, "assistant", "\\"), (2, 1, "assistant", "</turn>\n### User: x\\"),
             (3, None, None, None), (3, 1, "tool: a\\", ""), (3, 1, "tool: a\\", ""), (None, 0, "user", "no id"), (4, 0, "user", "w " * 3000), (4, 1, "assistant", "é" * 9)]
    turns += [(1, n, "user" if n % 2 else "assistant", f"turn {n} " * 12) for n in range(1, 30)]
    table = spark.createDataFrame([(*t, 0, "x") for t in turns], "conv_id bigint, turn bigint, role string, text string, window int, loss string")
    windows = chat.format_chats(table, budget=120, history=40)
    for w in windows.where("conv_id = 1").collect():
        assert w["n_tokens"] <= 120 and w["formatted"].startswith("### System: be brief</turn>\n")
    assert windows.where("conv_id = 1 and n_repeated > 1").count() > 0
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    for conv in {t[0] for t in turns}:
        mine = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        text = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in mine)
        loss = "".join(t[3] for t in mine if t[2] == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (
            len(mine), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_chats(table.limit(0))).count() == 0


def test_decontamination(spark):
    items = [(1, "A train leaves Paris at 9 and travels 120 km before it meets Anna near the old stone bridge."), (2, "Short but rather distinct item of text here"),
             (3, "A train leaves Paris at 9 and travels 120 km before it meets Anna near the old stone bridge."), (4, None), (5, "")]
    filler = "nothing to see in these words at all "
    docs = [(10, filler + items[0][1] + filler), (11, filler + "A train leaves Rome at 7 and travels 300 km before it meets Paul near the old stone bridge." + filler),
            (12, filler * 40), (13, filler + items[1][1]), (14, None), (15, ""), (None, items[0][1]), (16, "a train leaves the station and travels before it meets a bridge"),
            (17, " ".join(str(n) for n in range(400))), (18, "Paris Anna Rome Paul " * 200), (11, "again")]
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(
        spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, covered int"),
        spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, h string")).collect()}
    assert got == {(10, 1), (11, 1), (13, 2)}
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert contaminated(empty, spark.createDataFrame(items, "item_id bigint, text string")).count() == 0
    assert contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), empty.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_decontamination_slots_must_agree(spark):
    item = "Anna gives Ben 3 apples and then Ben gives Anna 5 pears while Carl gives Anna 3 plums today"
    same = item.replace("Anna", "Zoe").replace("Ben", "Max").replace("Carl", "Uma")
    mixed = "Zoe gives Max 3 apples and then Uma gives Ivo 8 pears while Kim gives Leo 4 plums today"
    docs = spark.createDataFrame([(1, same), (2, mixed)], "doc_id bigint, text string")
    got = contaminated(docs, spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 7)]


def found(spark, item, texts):
    """covered, by number of the text, of the texts that hold the item."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r["doc_id"]: r["covered"] for r in contaminated(docs, spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect()}


TRAIN = "A train leaves Paris at 9 and travels 120 km before it meets Anna near the old stone bridge."


def test_decontamination_in_another_letter_case(spark):
    other = TRAIN.replace("9", "8").replace("120", "75").lower()
    apart = "nothing to see in these words "
    assert found(spark, TRAIN, [apart + TRAIN.lower(), TRAIN.upper() + " " + apart, apart + other, apart + TRAIN.title(), "A train leaves Paris at 9"]) == {
        0: 19, 1: 19, 2: 19, 3: 19}
    short = "Who wrote the Émile of Élise?"
    assert found(spark, short, [short.upper(), "so " + short.lower(), "who wrote the emile of elise"]) == {0: 6, 1: 6}
    assert found(spark, TRAIN.upper(), [TRAIN, TRAIN.lower()]) == {0: 19, 1: 19}


def test_decontamination_values_of_another_shape(spark):
    def asked(*values):
        text = TRAIN
        for old, new in zip(("Paris", "9", "120", "Anna"), values, strict=True):
            text = text.replace(old, new)
        return "we ask you this: " + text

    texts = [asked("Paris", "9", "1,200", "Anna"), asked("Rome", "9:30", "3.5", "Paul"), asked("New York", "-7", "1,250.75", "Mary Ann O'Neill"),
             asked("Rio de Janeiro", "9", "120", "Anna"), asked("New\nYork", "9", "120", "Jean-Luc")]
    # "de" splits the name of the fourth: the longer alignment begins with its last word
    assert found(spark, TRAIN, texts) == {0: 19, 1: 19, 2: 19, 3: 16, 4: 19}
    short = "What is 15 percent of 80 plus 7?"
    assert found(spark, short, ["so: " + short.replace("15", "1,2.5").replace("80", "-3,400.5"), short.replace("plus", "minus")]) == {0: 8}
    many = "How far does Anna Smith drive if 3 buses cross 20 bridges and 4 tunnels toward New York at noon?"
    new = many.replace("Anna Smith", "Zoe").replace("3", "1,300").replace("20", "2.5").replace("4", "7:15").replace("New York", "San Jose City")
    assert found(spark, many, ["Quiz! " + new, new.upper()]) == {0: 20}


def test_decontamination_with_values_that_coincide(spark):
    rome = TRAIN.replace("Paris", "Rome").replace("9", "30").replace("120", "30")
    one = TRAIN.replace("Paris", "Rome").replace("Anna", "Rome")  # two names become one: one slot strays
    assert found(spark, TRAIN, [rome, one]) == {0: 19, 1: 19}
    longer = "ask how Anna and her friend Ben ask their uncle Carl for 3 apples and 4 pears on their way home."
    two = longer.replace("Ben", "Anna").replace("Carl", "Anna")  # two names stray
    assert found(spark, longer, [longer.replace("Anna", "Zoe").replace("4", "3"), two]) == {0: 21}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    res = con.execute(ORACLE[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(str([dict(zip(cols, r))[c] for c in df.columns]) for r in res.fetchall())
    assert sorted(str(list(r)) for r in df.collect()) == want


def test_pipeline(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert all(list(r["ids"]) == sp.encode(text[i]) for i, r in out.items())
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(b in text[i] for i in out for b in bench)
    folded = [text[i].lower() for i in out]
    assert len(folded) == len(set(folded))
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    lost = [i for i in good - set(out) if not any(b in text[i] for b in bench)]
    copies = {}
    for i, t in text.items():
        copies.setdefault(t.lower(), []).append(i)
    assert sum(len(copies[text[i].lower()]) == 1 for i in lost) <= 0.1 * len(good)  # the rest are near copies
