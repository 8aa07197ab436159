"""Ranked lexical search by the Best Position Algorithm over impact lists.

Each posting of a term holds its impact, the integer that it adds to a document's score; a term's
impact list is sorted by impact, highest first. A query reads its terms' lists from the top; each
document met is looked up in the query's other lists (a direct access), which gives its whole score
and also marks the places found there as seen. A list's best position is the end of its seen places
without a gap, often far below the place last read, so the sum of the impacts that follow the best
positions bounds every document not yet met, and tightens faster than the last-read bound. A query
stops when this bound is strictly below its k-th score: at an equal one a smaller id might still enter.

The index is partitioned by document. A task holds impact lists for at most some ``CHUNK_POSTINGS``
postings at a time and carries each query's best k from one chunk to the next, so later chunks stop
sooner; it returns k rows a query, and the k best over all tasks are the result. Queries come in blocks of
bounded size, each against all documents; only a block's terms and their weights are sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.llm.text import LOWER, UPPER
from tabprobe.session import forget, materialize

BLOCK_ITEMS = 1_000
BLOCK_BYTES = 16 << 20
CHUNK_POSTINGS = 1_500_000
#: Places that a query reads from each list in its first step; each step reads twice as many.
FIRST_STEP = 16
#: In UTF-8 every byte of a character beyond ASCII is 0x80 or more, so terms can be cut from bytes.
_TERM_BYTES = b"0123456789" + LOWER.encode() + bytes(range(0x80, 0x100))
_CUT = bytes(b if b in _TERM_BYTES else 0x20 for b in bytes(range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode())))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, A-Z lower-cased, of a UTF-8 text."""
    return text.translate(_CUT).split()


def _index(vocabulary):
    """Per document with a term: id, n (all terms), and the query terms in it with their counts."""
    def run(batches):
        from collections import Counter

        import pyarrow as pa

        number = vocabulary.value
        for batch in batches:
            out = []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                terms = terms_of(text or b"")
                if terms:
                    held = Counter(filter(number.__contains__, terms))
                    out.append((i, len(terms), [number[t] for t in held], list(held.values())))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(
                (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())))], names=["id", "n", "terms", "counts"])

    return run


class ImpactLists:
    """The impact lists of a chunk of documents, with direct access by document."""

    def __init__(self, terms, docs, impacts):
        """Postings in ascending order of the document's number."""
        import numpy as np

        by_doc = np.argsort(terms, kind="stable")
        self.terms, self.starts = np.unique(terms[by_doc], return_index=True)
        self.ends = np.append(self.starts[1:], len(by_doc))
        self.docs, self.impacts = docs[by_doc], impacts[by_doc]
        # Within each term: places by falling impact, and each posting's place.
        by_impact = np.lexsort((-self.impacts, terms[by_doc]))
        self.list_docs, self.list_impacts = self.docs[by_impact], self.impacts[by_impact]
        place = np.empty(len(by_doc), np.int64)
        place[by_impact] = np.arange(len(by_doc))
        self.places = place - np.repeat(self.starts, self.ends - self.starts)

    def slices(self, wanted) -> list[tuple[int, int]]:
        import numpy as np

        at = np.searchsorted(self.terms, wanted)
        return [(int(self.starts[i]), int(self.ends[i])) for i, t in zip(at, wanted) if i < len(self.terms) and self.terms[i] == t]


def best_positions(lists: ImpactLists, wanted, met, k: int, best, ids, step: int = FIRST_STEP):
    """One query against a chunk. ``best``: (scores, ids) of the k best so far, in order. ``met``: an
    array of false for each document, left as it was. Returns the new best and how many documents were looked up.
    """
    import numpy as np

    spans = lists.slices(wanted)
    seen = [np.zeros(e - s, bool) for s, e in spans]
    place = [0] * len(spans)
    looked_up = []
    while True:
        bound = sum(int(lists.list_impacts[s + p]) for (s, e), p in zip(spans, place) if s + p < e)
        # A document with no more than the bound 0 adds nothing; one that ties with the k-th may still have a smaller id.
        if bound == 0 or len(best[0]) >= k and bound < best[0][-1]:
            break
        read = np.unique(np.concatenate([lists.list_docs[s + p:min(s + p + step, e)] for (s, e), p in zip(spans, place)]))
        new = read[~met[read]]
        met[new] = True
        looked_up.append(new)
        scores = np.zeros(len(new), np.int64)
        for i, (s, e) in enumerate(spans):
            at = np.searchsorted(lists.docs[s:e], new)
            at[at == e - s] = 0
            hit = lists.docs[s + at] == new
            scores += np.where(hit, lists.impacts[s + at], 0)
            seen[i][lists.places[s + at[hit]]] = True
            rest = seen[i][place[i]:]
            place[i] += len(rest) if rest.all() else int(np.argmin(rest))
        some = scores > 0
        if len(best[0]) >= k:
            some &= scores >= best[0][-1]
        if some.any():
            all_scores, all_ids = np.concatenate([best[0], scores[some]]), np.concatenate([best[1], ids[new[some]]])
            keep = np.lexsort((all_ids, -all_scores))[:k]
            best = (all_scores[keep], all_ids[keep])
        step *= 2
    n = 0
    for docs in looked_up:
        met[docs] = False
        n += len(docs)
    return best, n


#: Stands for a null id inside a task: after all others in a tie.
_NO_ID = (1 << 63) - 1


def _search(queries, weights, n_docs: int, n_terms: int, k: int, chunk_postings: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        weight = weights.value
        wanted = [np.unique(np.asarray(q, np.int64)) for q in queries.value]
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in wanted]

        def search(ids, terms, docs, impacts):
            lists, met = ImpactLists(terms, docs, impacts), np.zeros(len(ids), bool)
            for q, terms_ in enumerate(wanted):
                best[q], _ = best_positions(lists, terms_, met, k, best[q], ids)

        parts, held, base = [], 0, 0
        for batch in batches:
            n_rows = batch.num_rows
            if not n_rows:
                continue
            ids = batch.column("id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            # Python's integers: 90 * n * N may leave 64 bits, the quotient doesn't.
            m = np.array([10 + 90 * n * n_docs // n_terms for n in batch.column("n").to_pylist()], np.int64)
            lengths = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False)
            docs = np.repeat(np.arange(n_rows), lengths)
            terms = batch.column("terms").flatten().to_numpy().astype(np.int64)
            tf = batch.column("counts").flatten().to_numpy()
            impacts = weight[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m[docs]))
            parts.append((ids, terms, docs + base, impacts))
            held, base = held + len(terms), base + n_rows
            if held >= chunk_postings:
                search(*map(np.concatenate, zip(*parts)))
                parts, held, base = [], 0, 0
        if parts:
            search(*map(np.concatenate, zip(*parts)))
        q = np.repeat(np.arange(len(best), dtype=np.int32), [len(b[0]) for b in best])
        ids = np.concatenate([b[1] for b in best]) if best else np.zeros(0, np.int64)
        scores = np.concatenate([b[0] for b in best]) if best else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)], names=["q", "doc_id", "score"])

    return run


def _blocks(items: Iterator, size: int) -> Iterator[list]:
    """Blocks of at most ``size`` items and, but for a single longer one, ``BLOCK_BYTES`` of text."""
    block, held = [], 0
    for item in items:
        if block and (len(block) >= size or held + len(item["text"]) > BLOCK_BYTES):
            yield block
            block, held = [], 0
        block.append(item)
        held += len(item["text"])
    if block:
        yield block


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", block_items: int = BLOCK_ITEMS, chunk_postings: int = CHUNK_POSTINGS) -> DataFrame:
    """The ``k`` documents of highest score above 0 for each item: item_col, rank (from 1), doc_id, score.

    A term in ``df`` of N documents weighs floor(1000 ln((2N+2)/(2df+1))); with tf occurrences among a
    document's n terms, and L terms in all, it adds weight * (10^9 tf div (1000 tf + 8 m)), where
    m = 10 + 90nN div L. An item's terms count once. N counts the documents with a term.

    Equal scores go by ascending id, null ids last. Null and empty texts have no terms: such documents
    are never found, such items have no rows. Every row of documents is a document of its own, also if
    ids or texts repeat; rows of items that are wholly equal are one query, and items that share
    an id but not the text are ranked each for itself. Empty tables give no rows.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").cast("binary").alias("text")).where(
        "text is not null").distinct()
    import numpy as np

    out = None
    for block in _blocks(asked.toLocalIterator(), block_items):
        number: dict[bytes, int] = {}
        queries = [[number.setdefault(t, len(number)) for t in dict.fromkeys(terms_of(bytes(r["text"])))] for r in block]
        vocabulary, query_terms = sc.broadcast(number), sc.broadcast(queries)
        index = materialize(texts.mapInArrow(_index(vocabulary), "id bigint, n bigint, terms array<int>, counts array<bigint>"), "term_index")
        total = index.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
        if not total["n"]:
            forget(index)
            break
        held = index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
        weight = F.floor(1000.0 * F.ln((F.lit(2.0) * total["n"] + 2.0) / (F.lit(2.0) * F.col("df") + 1.0)))
        weights = np.zeros(max(len(number), 1), np.int64)
        for r in held.select("t", weight.alias("w")).toLocalIterator():  # at most one row for each term of the block
            weights[r["t"]] = r["w"]
        sent = sc.broadcast(weights)
        names = spark.createDataFrame([(q, r["item"]) for q, r in enumerate(block)], f"q int, item {asked.schema['item'].dataType.simpleString()}")
        found = index.mapInArrow(_search(query_terms, sent, total["n"], total["l"], k, chunk_postings), "q int, doc_id bigint, score bigint")
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        part = materialize(best.join(names, "q").select(F.col("item").alias(item_col), "rank", "doc_id", "score"), "ranked")
        forget(index)
        for b in (vocabulary, query_terms, sent):
            b.unpersist()
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"{item_col} {asked.schema['item'].dataType.simpleString()}, rank int, doc_id bigint, score bigint")
    return out
