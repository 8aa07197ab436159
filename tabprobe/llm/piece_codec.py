"""SentencePiece (merge type) encoding and decoding.

Of every prefix of a segment, the encoding's last token is unique. An automaton yields the
pieces that end at a position; the one whose predecessor (the last token of the prefix before it)
stays apart from it under the merge rules is stored, and the ids are recovered backwards. One
pass over the text, no merge queue.

The driver reads the model once; plain tables of its fixed vocabulary (some MB) are broadcast.
"""

from __future__ import annotations

import re
from array import array

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprobe.llm.text import whole

SPACE = "▁"  # the mark for a space in pieces
# What a worker remembers: some 100 MB each at most.
MEMO_WORDS = 500_000
MEMO_PAIRS = 500_000
# Text bytes that one output batch answers.
BATCH_BYTES = 1 << 20


def _merge(text: str, ranks: dict[str, float]) -> list[tuple[str, str]] | None:
    """Merge a piece's own characters, best rank first, then leftmost: the last merge's two
    parts if the piece comes out whole, else None."""
    parts, last = list(text), None
    while len(parts) > 1:
        best = min(((ranks.get(parts[i] + parts[i + 1], 9e99), i) for i in range(len(parts) - 1)))
        if best[0] == 9e99:
            return None
        i = best[1]
        last = (parts[i], parts[i + 1])
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return last


def load_tables(model_path: str) -> dict:
    """Plain tables of a model: ranks, the two parts of each piece that merging can make, ids, bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    if sp.normalize("ﬁ Ａ  x ") != f"{SPACE}ﬁ{SPACE}Ａ{SPACE}{SPACE}x{SPACE}":
        raise NotImplementedError("only models that keep the text as it is, with a leading space, are supported")
    ids, ranks, raw, byte_ids = {}, {}, [], [0] * 256
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            raw.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            raw.append(b"")
        else:
            ids[piece], ranks[piece] = i, -sp.get_score(i)
            raw.append(piece.replace(SPACE, " ").encode())
    if 0 in byte_ids:
        raise NotImplementedError("the model has no byte fallback")
    parts = {}
    for piece in ids:
        if len(piece) > 1 and (made := _merge(piece, ranks)):
            parts[piece] = made
    # Where no piece holds a space after another character, a space always begins a new segment.
    apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in ids)
    return {"ids": ids, "ranks": ranks, "parts": parts, "raw": raw, "bytes": byte_ids, "apart": apart, "memo": {}, "pairs": {}}


class PieceCodec:
    """Encodes and decodes texts with tables from ``load_tables``."""

    def __init__(self, tables: dict):
        import ahocorasick

        self.t = tables
        self.parts, self.ranks = tables["parts"], tables["ranks"]
        self.memo, self.pairs = tables["memo"], tables["pairs"]  # they outlive a task in their worker
        self.automaton = ahocorasick.Automaton()
        for piece in self.parts:
            self.automaton.add_word(piece, (len(piece), piece))
        self.automaton.add_word("\n", (1, "\n"))
        self.automaton.make_automaton()
        self.segments = re.compile(f"{SPACE}+[^{SPACE}]*" if tables["apart"] else "(?s).+")

    def stay_apart(self, left: str, right: str) -> bool:
        """Whether merging left + right ends as these two: no merge across their border would
        have come first. Merges are undone, the latest first; of equal rank, the left one comes
        first, so the right one is undone first."""
        a, b, limit, tie = left, right, 9e99, True
        while True:
            across = self.ranks.get(a + b)
            if across is not None and (across < limit or tie and across == limit):
                return False
            ra = self.ranks[a] if len(a) > 1 else -9e99
            rb = self.ranks[b] if len(b) > 1 else -9e99
            if ra == rb == -9e99:
                return True
            if ra > rb:
                a, limit, tie = self.parts[a][1], ra, False
            else:
                b, limit, tie = self.parts[b][0], rb, True

    def pieces(self, segment: str) -> list[str]:
        last: list[str | None] = [None] * len(segment)
        known = self.pairs
        for end, (size, piece) in self.automaton.iter(segment):  # of one end, the longest first
            if last[end] is not None:
                continue
            before = end - size
            if before < 0:
                last[end] = piece
                continue
            # Where no longer piece fits, the character stands alone.
            pair = (last[before] or segment[before], piece)
            ok = known.get(pair)
            if ok is None:
                if len(known) > MEMO_PAIRS:
                    known.clear()
                ok = known[pair] = self.stay_apart(*pair)
            if ok:
                last[end] = piece
        out, i = [], len(segment) - 1
        while i >= 0:
            out.append(last[i] or segment[i])
            i -= len(out[-1])
        return out[::-1]

    def _segment(self, segment: str) -> bytes:
        got = array("i")
        for piece in self.pieces(segment):
            i = self.t["ids"].get(piece)
            if i is None:
                got.extend(self.t["bytes"][x] for x in piece.encode())
            else:
                got.append(i)
        return got.tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as int32 in native order."""
        if not text:
            return b""
        memo, out = self.memo, []
        for word in self.segments.findall(SPACE + text.replace(" ", SPACE)):
            got = memo.get(word)
            if got is None:
                got = self._segment(word)
                if len(word) <= 48:
                    if len(memo) >= MEMO_WORDS:
                        memo.clear()
                    memo[word] = got
            out.append(got)
        return b"".join(out)

    def decode(self, ids) -> str:
        text = b"".join(map(self.t["raw"].__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and decode the ids again.

    Returns id_col, ``ids`` (array of int, no begin or end ids) and ``decoded``: one row per input
    row, in no order. Null text is empty and has no ids. Repeated rows each get their own result;
    an empty table gives an empty table.
    """
    spark: SparkSession = docs.sparkSession
    tables = spark.sparkContext.broadcast(load_tables(model_path))
    base = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        codec = PieceCodec(tables.value)

        def pack(keys, ids, texts):
            sizes = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), np.int32))
            return pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.ListArray.from_arrays(pa.array(sizes), values),
                                               pa.array(texts, pa.string())], names=["id", "ids", "decoded"])

        for batch in batches:
            key_type = batch.schema.field("id").type
            keys, ids, texts, size = [], [], [], 0
            for key, text in zip(batch.column("id"), batch.column("text"), strict=True):
                text = text.as_py()
                got = codec.encode(text)
                keys.append(key.as_py())
                ids.append(got)
                texts.append(codec.decode(np.frombuffer(got, np.int32).tolist()))
                size += len(text)
                if size >= BATCH_BYTES:
                    yield pack(keys, ids, texts)
                    keys, ids, texts, size = [], [], [], 0
            if keys:
                yield pack(keys, ids, texts)

    kind = base.schema["id"].dataType.simpleString()
    out = base.mapInArrow(run, f"id {kind}, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)
