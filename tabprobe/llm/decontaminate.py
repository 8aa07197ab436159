"""Benchmark decontamination on templates.

Texts become token runs in which numbers, names and units are typed placeholders. A whole number
(``1,200``, ``-3.5``, ``9:30``) is one token, and a run of capitalised words (``New York``) one name slot,
so values of another shape move nothing. Windows of ``WINDOW`` slots hash their template, and windows
of tokens their case-folded values, since a copy in another letter case has other names; document
windows meet benchmark windows by a hash join. Windows of one alignment (same document, item and
offset, in tokens or in slots) must cover enough tokens of the item, and their slots must be
consistent: each item value stands for one document value, as in a question asked again with other
numbers or names. Different numbers or units may come to be equal, different names may not.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm import words
from tabprobe.llm.text import whole
from tabprobe.session import materialize

WINDOW = 8
# A window with fewer words outside slots hashes its values alone.
LEAST_WORDS = 4
# Tokens of an item that one alignment must cover; shorter items must be covered whole.
LEAST_COVER = 13
CONSISTENT = 0.9
# Slots that may be inconsistent in an item covered whole, however few it has.
LEAST_STRAY = 1
# Hashes of benchmark windows that may be broadcast to filter document windows (8 bytes each); more meet them by shuffle alone.
BROADCAST_WINDOWS = 2_000_000
UNITS = ("km m cm mm kg g mg lb lbs oz ft inch inches mile miles mph kmh l ml h hr hrs hour hours min mins minute minutes s sec "
         "second seconds day days week weeks month months year years percent dollar dollars euro euros usd eur pound pounds "
         "cent cents degree degrees watt watts kw kwh volt volts hz khz mhz ghz mb gb tb").split()

NUMBER, NAME, UNIT = 1, 2, 3
_MARKS = np.array([0, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x3C6EF372FE94F82B], np.uint64)


def _folded(data: np.ndarray, offsets: np.ndarray):
    """(bytes, offsets) of the case-folded texts. Folding keeps every run of ``words.CLASSES``, at most its length changes."""
    if not len(data) or data.max() < 128:
        return words.FOLD[data], offsets
    raw = data.tobytes()
    texts = [raw[a:b].decode("utf-8", "surrogateescape").casefold().encode("utf-8", "surrogateescape") for a, b in zip(offsets[:-1], offsets[1:])]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def _tokens(data: np.ndarray, offsets: np.ndarray):
    """(text number, kind, value hash, slot number) of each token: a whole number, or a run of letters and digits.

    Whole numbers are runs that begin with a digit, joined by one ``,`` ``.`` or ``:`` between digits, and a
    sign that nothing but a blank or bracket precedes. Names begin with A-Z or a Latin-1 capital; units
    follow a number. A slot is a token, or names with only blanks, one hyphen or apostrophe between them.
    """
    start, end, text = words.spans(data, offsets, words.CLASSES)
    if not len(start):
        return text, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keep = words.CLASSES[data[start]] == 1
    start, end, text = start[keep], end[keep], text[keep]
    folded, ends = _folded(data, offsets)
    low, high, _ = words.spans(folded, ends, words.CLASSES)
    low, high = low[keep], high[keep]

    def byte(at):
        return data[np.clip(at, 0, len(data) - 1)]

    def digit(at):
        return (byte(at) >= 48) & (byte(at) <= 57)

    minus = (byte(start) == 0xE2) & (byte(start + 1) == 0x88) & (byte(start + 2) == 0x92) & (end - start > 3)  # U+2212
    number = digit(start) | minus & digit(start + 3)
    inner = (number[:-1] & digit(end[:-1] - 1) & digit(start[1:]) & (text[1:] == text[:-1]) & (start[1:] - end[:-1] == 1)
             & np.isin(byte(end[:-1]), list(b",.:")))
    first = np.flatnonzero(np.concatenate([[True], ~inner]))
    last = np.concatenate([first[1:], [len(start)]]) - 1
    start, end, text, low, high, number = start[first], end[last], text[first], low[first], high[last], number[first]
    begin = offsets[text]
    sign = number & (start > begin) & np.isin(byte(start - 1), list(b"+-"))
    sign &= (start - 1 == begin) | words.BLANK[byte(start - 2)] | np.isin(byte(start - 2), list(b"([{"))
    h = words.hashes(folded, low - sign, high)
    kind = np.zeros(len(start), np.int64)
    lead, second = byte(start), byte(start + 1)
    kind[(lead >= 65) & (lead <= 90) | (lead == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)] = NAME
    kind[number] = NUMBER
    unit = np.isin(h[1:], _UNIT_HASHES) & (kind[:-1] == NUMBER) & (text[1:] == text[:-1]) & (kind[1:] != NUMBER)
    kind[1:][unit] = UNIT
    marks = np.concatenate([[0], np.cumsum(words.CLASSES[data] == 2)])
    near = (marks[start[1:]] == marks[end[:-1]]) | (start[1:] - end[:-1] == 1) & np.isin(byte(end[:-1]), list(b"-'"))
    run = near & (kind[1:] == NAME) & (kind[:-1] == NAME) & (text[1:] == text[:-1])
    return text, kind, h, np.cumsum(np.concatenate([[True], ~run])) - 1


def _slots(text: np.ndarray, kind: np.ndarray, h: np.ndarray, slot: np.ndarray):
    """(first token, tokens, text number, kind, value hash) of each slot; a run of names hashes its words."""
    first = np.flatnonzero(np.diff(slot, prepend=-1))
    size = np.diff(np.append(first, len(slot)))
    place = (np.arange(len(slot)) - first[slot]).astype(np.uint64)
    value = np.add.reduceat(words.mix(h + place * np.uint64(0x9E3779B97F4A7C15)), first) if len(first) else h
    return first, size, text[first], kind[first], np.where(size > 1, value, h[first])


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    start, end, _ = words.spans(data, np.array([0, len(data)]))
    return np.sort(words.hashes(data, start, end))


_UNIT_HASHES = _unit_hashes()


_FACTOR = np.uint64(0xD6E8FEB86659FD93)


def _windows(kind: np.ndarray, h: np.ndarray, text: np.ndarray, size: int, of_slots: bool):
    """(first, hash) of windows of ``size`` tokens, or slots, within a text.

    Each window of tokens hashes its values; one with a number or unit also hashes them as slots.
    Windows of slots with a name hash names, numbers and units as slots.
    """
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = text[:n] == text[size - 1:]
    number, name = (kind == NUMBER) | (kind == UNIT), kind == NAME
    out = []
    for seed, open_, needed in ((2000, number | name, name),) if of_slots else ((0, np.zeros(len(h), bool), None), (1000, number, number)):
        use = inside
        if needed is not None:
            some, literals = (np.concatenate([[0], np.cumsum(x)]) for x in (needed, ~open_))
            use = inside & (some[size:] > some[:-size]) & (literals[size:] - literals[:-size] >= min(LEAST_WORDS, size))
        at = np.flatnonzero(use)
        token, acc = np.where(open_, _MARKS[kind], h), np.full(len(at), size + seed, np.uint64)
        for j in range(size):
            acc = words.mix(acc * _FACTOR + token[at + j])
        out.append((at, acc))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


ROWS = "id bigint, of_slots boolean, pos int, slot int, size int, n_tokens int, h bigint, kinds binary, hashes binary, parts binary"


def _window_rows(base: DataFrame, sizes: tuple[tuple[bool, int], ...], whole_short: bool, wanted) -> DataFrame:
    """A row per window of tokens or slots: of ``WINDOW``, and of each shorter size that items have.

    ``pos`` and ``slot``: its first token and the slot of that. ``hashes``: 64-bit values of its tokens or
    slots. ``parts``: for each, its slot's first token, number of tokens and value.
    ``whole_short``: shorter windows only where they are the whole text (the benchmark's side).
    ``wanted``: broadcast sorted hashes to keep, or None for all.
    """

    def run(batches):
        import pyarrow as pa

        keep = wanted.value if wanted is not None else None
        if keep is not None:  # one bit test answers most windows
            seen = np.zeros(1 << 22, bool)
            seen[keep >> np.uint64(42)] = True
        for batch in batches:
            ids = batch.column("id")
            for row, data, offsets in words.chunks(batch.column("text")):
                text, kind, h, slot = _tokens(data, offsets)
                first, length, s_text, s_kind, s_hash = _slots(text, kind, h, slot)
                counts, s_counts = (np.bincount(t, minlength=len(offsets) - 1) for t in (text, s_text))
                begin, s_begin = np.cumsum(counts) - counts, np.cumsum(s_counts) - s_counts
                s_parts = np.column_stack([first - begin[s_text], length, s_hash.view(np.int64)])
                for of_slots, size in sizes:
                    mine = (s_kind, s_hash, s_text, s_counts) if of_slots else (kind, h, text, counts)
                    at, wh = _windows(*mine[:3], size, of_slots)
                    if whole_short and size < WINDOW:
                        short = mine[3][mine[2][at]] == size
                        at, wh = at[short], wh[short]
                    if keep is not None:
                        maybe = np.flatnonzero(seen[wh >> np.uint64(42)])
                        hit = maybe[np.isin(wh[maybe], keep)]
                        at, wh = at[hit], wh[hit]
                    if not len(at):
                        continue
                    doc = mine[2][at]
                    kinds, parts = mine[0].astype(np.uint8), s_parts if of_slots else s_parts[slot]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(row + doc)), pa.array(np.full(len(at), of_slots)),
                         pa.array(((first[at] if of_slots else at) - begin[doc]).astype(np.int32)),
                         pa.array(((at if of_slots else slot[at]) - s_begin[doc]).astype(np.int32)),
                         pa.array(np.full(len(at), size, np.int32)), pa.array(counts[doc].astype(np.int32)), pa.array(wh.view(np.int64)),
                         *(pa.array([x[a:a + size].tobytes() for a in at], pa.binary()) for x in (kinds, mine[1], parts))],
                        names=["id", "of_slots", "pos", "slot", "size", "n_tokens", "h", "kinds", "hashes", "parts"])

    return base.mapInArrow(run, ROWS)


def _aligned(hits: list[dict]) -> tuple[int, int, int, int]:
    """(tokens covered, tokens counted, slots, consistent slots) of the windows of one alignment.

    A run of names whose words differ counts as one token.
    """
    lengths, same, values = {}, {}, {}
    for hit in hits:
        theirs = np.frombuffer(hit["doc_hashes"], np.int64).tolist()
        for i, (first, length, mine) in enumerate(np.frombuffer(hit["parts"], np.int64).reshape(-1, 3).tolist()):
            kind = hit["kinds"][i]
            lengths[first] = length
            if hit["of_slots"]:
                same.setdefault(first, set())
                values.setdefault(first, (kind, mine, theirs[i]))
            else:  # these words are equal, whatever their case makes of them in the document
                same.setdefault(first, set()).add(hit["item_pos"] + i)
                if len(same[first]) == length:
                    values[first] = (kind, mine, mine if kind == NAME else theirs[i])
    pairs = Counter(v for v in values.values() if v[0])
    to, of = {}, {}
    for (kind, mine, theirs), n in pairs.items():
        to[kind, mine] = max(to.get((kind, mine), (0, 0)), (n, theirs))
        of[kind, theirs] = max(of.get((kind, theirs), (0, 0)), (n, mine))
    good = sum(n for (kind, mine, theirs), n in pairs.items()
               if to[kind, mine][1] == theirs and (kind != NAME or of[kind, theirs][1] == mine))
    covered = sum(lengths[first] if first in values else len(tokens) for first, tokens in same.items())
    return covered, sum(max(len(tokens), 1) for tokens in same.values()), sum(pairs.values()), good


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text") -> DataFrame:
    """Documents that hold a passage of a benchmark item, numbers, names and units free to differ.

    Letter case is free too. Names are told by their capital, so where a document writes them in another
    case than the item they must be the same; numbers and units may still differ.

    Returns id_col, item_col, ``covered`` (item tokens that the best alignment covers), ``item_tokens``,
    ``slots``, ``consistent`` (slots whose item value stands for one document value, and of names also
    the reverse): a row per document and item with covered >= 13 (a run of names whose words differ
    counts once) or covered = item_tokens, and consistent >= 0.9 * slots, or all slots but one if
    covered = item_tokens. Items with equal text count as the one with the smallest id. Rows without
    an id, null, and tokenless texts match nothing; documents that repeat an id count together. Empty
    tables give an empty table.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("bigint").alias("id"), whole(F.col(item_text_col)).alias("text")).where("id is not null")
    items = items.groupBy("text").agg(F.min("id").alias("id")).select("id", "text")
    sizes = tuple((of_slots, n) for of_slots in (False, True) for n in range(WINDOW, 0, -1))
    bench = materialize(_window_rows(items, sizes, True, None), "benchmark_windows")
    found = bench.groupBy("of_slots", "size").agg(F.count("*").alias("n")).collect()  # at most 2 * WINDOW rows
    used = tuple(sorted(((r["of_slots"], r["size"]) for r in found), reverse=True)) or ((False, WINDOW),)
    wanted = None
    if sum(r["n"] for r in found) <= BROADCAST_WINDOWS:
        hashes = bench.select("h").distinct().toArrow().column("h").to_numpy()
        wanted = spark.sparkContext.broadcast(np.sort(hashes.view(np.uint64)))
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), whole(F.col(text_col)).alias("text")).where("id is not null")
    mine = _window_rows(base, used, False, wanted)
    theirs = bench.select("h", "of_slots", "size", F.col("id").alias("item"), F.col("pos").alias("item_pos"), F.col("slot").alias("item_slot"),
                          F.col("n_tokens").alias("n"), "kinds", "parts")
    met = mine.select("h", "of_slots", "size", "id", "pos", "slot", F.col("hashes").alias("doc_hashes")).join(theirs, ["h", "of_slots", "size"])
    # A window of tokens also counts in the alignment of slots that it lies in.
    by_slot = F.struct(F.lit(True).alias("slots"), (F.col("slot") - F.col("item_slot")).alias("shift"))
    by_token = F.struct(F.lit(False).alias("slots"), (F.col("pos") - F.col("item_pos")).alias("shift"))
    hits = (met.withColumn("by", F.explode(F.when(F.col("of_slots"), F.array(by_slot)).otherwise(F.array(by_token, by_slot))))
            .groupBy("id", "item", "n", "by")
            .agg(F.collect_list(F.struct("of_slots", "item_pos", "kinds", "parts", "doc_hashes")).alias("hits")))

    def judge(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for doc, item, n, found_ in zip(*(batch.column(c).to_pylist() for c in ("id", "item", "n", "hits")), strict=True):
                covered, counted, slots, good = _aligned(found_)
                agree = good >= CONSISTENT * slots or covered == n and slots - good <= LEAST_STRAY
                if (counted >= LEAST_COVER or covered == n) and agree:
                    rows.append((doc, item, covered, n, slots, good))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                             names=["id", "item", "covered", "item_tokens", "slots", "consistent"])

    judged = hits.mapInArrow(judge, "id bigint, item bigint, covered bigint, item_tokens bigint, slots bigint, consistent bigint")
    best = judged.groupBy("id", "item").agg(F.max(F.struct("covered", "consistent", "slots", "item_tokens")).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "b.covered", "b.item_tokens", "b.slots", "b.consistent")
