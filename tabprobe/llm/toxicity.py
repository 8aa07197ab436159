"""Toxicity by a classifier chain.

Terms (words and word beginnings) that mark a category are picked by a two-proportion score over
the labelled sample. Link j of the chain is a linear model of the terms found in a text, a few
shares of its shape, and the probabilities of links 1 to j-1. In training those probabilities
are out-of-fold predictions, so a link learns from what earlier links say of unseen rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm import linear, words
from tabprobe.llm.quality import held_out, labelled_sample
from tabprobe.llm.text import whole

# The fit's bound: so many labelled rows, in hash order of their ids.
SAMPLE_ROWS = 10_000
TERMS = 2_048
LEAST_Z = 6.0
FOLDS = 5
PASSES = 4
SHAPES = 4
PREFIXES = (4, 5)


def _terms(data: np.ndarray, offsets: np.ndarray):
    """(term, text number) of every word and word beginning (in bytes), A-Z lower-cased, and shape shares per text."""
    n = len(offsets) - 1
    folded = words.FOLD[data]
    start, end, text = words.spans(folded, offsets, words.CLASSES)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((n, SHAPES))
    h = words.hashes(folded, start, end)
    letters = words.CLASSES[folded[start]] == 1
    upper = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data >= 65) & (data <= 90), out=upper[1:])
    caps = (upper[end] - upper[start]) * 2 > end - start
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    total = np.maximum(np.bincount(text, minlength=n), 1)
    shares = [np.bincount(text, weights=x, minlength=n) / total for x in (~letters, caps & letters, again, end - start > 12)]
    parts, owners = [h[letters]], [text[letters]]
    for size in PREFIXES:
        long = letters & (end - start > size)
        parts.append(words.mix(words.hashes(folded, start[long], start[long] + size) + np.uint64(size)))
        owners.append(text[long])
    return np.concatenate(parts), np.concatenate(owners), np.stack(shares, axis=1)


def _pick_terms(sample: DataFrame, categories: Sequence[str]) -> np.ndarray:
    """The terms that best mark each category: at most TERMS in all, by documents that hold them."""
    k = len(categories)

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            y = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in categories], axis=1).astype(np.int64)
            for row, data, offsets in words.chunks(batch.column("text"), 16 << 20):
                term, text, _ = _terms(data, offsets)
                order = np.lexsort((text, term))
                term, text = term[order], text[order]
                new = np.ones(len(term), bool)
                new[1:] = (term[1:] != term[:-1]) | (text[1:] != text[:-1])
                term, text = term[new], text[new]
                if not len(term):
                    continue
                first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
                sums = np.add.reduceat(np.column_stack([np.ones(len(term), np.int64), y[row + text]]), first, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(term[first].view(np.int64)), *(pa.array(sums[:, j]) for j in range(k + 1))],
                                                 names=["term", "n", *(f"y{j}" for j in range(k))])

    rates = sample.agg(F.count("*"), *[F.avg(F.col(c).cast("double")) for c in categories]).first()
    columns = "term bigint, n bigint, " + ", ".join(f"y{j} bigint" for j in range(k))
    counts = sample.mapInArrow(count, columns).groupBy("term").agg(F.sum("n").alias("n"), *[F.sum(f"y{j}").alias(f"y{j}") for j in range(k)])
    scores = [(F.col(f"y{j}") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p) + 1e-9)
              for j, p in enumerate(rates[1:]) if p and p < 1]
    if not scores:
        return np.zeros(0, np.uint64)
    z = F.greatest(*scores) if len(scores) > 1 else scores[0]
    top = counts.where("n >= 5").select("term", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "term").limit(TERMS)
    return np.sort(np.array([r.term for r in top.select("term").collect()], np.int64).view(np.uint64))


def _rows(data: np.ndarray, offsets: np.ndarray, terms: np.ndarray):
    """Per text: numbers of the picked terms it holds; shape shares."""
    n = len(offsets) - 1
    term, text, shares = _terms(data, offsets)
    if len(terms) and len(term):
        at = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
        hit = terms[at] == term
        key = np.unique(text[hit] * len(terms) + at[hit])
        text, at = key // len(terms), key % len(terms)
    else:
        text = at = np.zeros(0, np.int64)
    bounds = np.searchsorted(text, np.arange(n + 1))
    return [at[bounds[i]:bounds[i + 1]] for i in range(n)], shares


def _row(at: np.ndarray, shares: np.ndarray, before: Sequence[float], n_terms: int):
    """Sparse coordinates: terms, shares, earlier probabilities, bias."""
    base = n_terms
    extra = np.concatenate([shares * 5, before])
    return (np.concatenate([at, np.arange(base, base + len(extra) + 1)]),
            np.concatenate([np.ones(len(at)), extra, [1.0]]))


def fit_chain(rows: list, shares: np.ndarray, y: np.ndarray, folds: np.ndarray, n_terms: int, passes: int = PASSES) -> list[np.ndarray]:
    """Weights of each link; y has a column per category, in chain order."""
    n, k = y.shape
    before = np.zeros((n, 0))
    links = []
    for j in range(k):
        x = [_row(rows[i], shares[i], before[i], n_terms) for i in range(n)]
        size = n_terms + SHAPES + j + 1

        def fit(chosen, x=x, size=size, j=j):
            return linear.Ftrl(size, alpha=0.5, l1=0.5).fit([x[i] for i in chosen], y[chosen, j], passes)

        unseen = np.zeros(n)
        for f in range(FOLDS):
            inside = np.flatnonzero(folds == f)
            if len(inside):
                w = fit(np.flatnonzero(folds != f))
                unseen[inside] = [linear.sigmoid(w[x[i][0]] @ x[i][1]) for i in inside]
        links.append(fit(np.arange(n)))
        before = np.column_stack([before, unseen])
    return links


def train_toxicity(docs: DataFrame, labels: DataFrame, categories: Sequence[str], rows: int = SAMPLE_ROWS,
                   id_col: str = "doc_id", text_col: str = "text") -> dict:
    """A chain over 0/1 label columns of ``labels``, in the order given.

    Terms are counted over the sample by all tasks; the sample's short rows (numbers of picked
    terms) are fitted in one. Without labels every probability is 0.5.
    """
    categories = list(categories)
    sample = labelled_sample(docs, labels, categories, rows, id_col, text_col)
    terms = _pick_terms(sample, categories)
    n_terms, k = len(terms), len(categories)

    def featurise(batches):
        import pyarrow as pa

        for batch in batches:
            for row, data, offsets in words.chunks(batch.column("text")):
                found, shares = _rows(data, offsets, terms)
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(row, n), pa.array([x.astype(np.int32).tobytes() for x in found], pa.binary()),
                     pa.array(list(shares), pa.list_(pa.float64())), *(batch.column(c).slice(row, n).cast(pa.int64()) for c in categories)],
                    names=["id", "at", "shares", *(f"y{j}" for j in range(k))])

    def fit(batches):
        import pyarrow as pa

        found, shares, y = [], [], []
        for batch in batches:
            found += [np.frombuffer(x, np.int32).astype(np.int64) for x in batch.column("at").to_pylist()]
            shares += batch.column("shares").to_pylist()
            y += list(zip(*(batch.column(f"y{j}").to_pylist() for j in range(k)), strict=True))
        if not y:
            return
        folds = np.arange(len(y)) % FOLDS  # rows come in hash order of their ids
        links = fit_chain(found, np.array(shares), np.array(y, float), folds, n_terms)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes() for w in links], pa.binary())], names=["weights"])

    kind = sample.schema["id"].dataType.simpleString()
    made = sample.mapInArrow(featurise, f"id {kind}, at binary, shares array<double>, " + ", ".join(f"y{j} bigint" for j in range(k)))
    fitted = (made.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id").mapInArrow(fit, "weights binary").collect())
    links = [np.frombuffer(bytes(r[0]), float) for r in fitted] or [np.zeros(n_terms + SHAPES + j + 1) for j in range(k)]
    return {"terms": terms, "links": links, "categories": categories}


def score_toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ``p_<category>`` for each link of the chain: one row per input row. Null and empty
    texts score by the bias and the chain alone."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most TERMS terms
    base = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    names = [f"p_{c}" for c in model["categories"]]

    def run(batches):
        import pyarrow as pa

        terms, links = shared.value["terms"], shared.value["links"]
        for batch in batches:
            out = np.empty((batch.num_rows, len(links)))
            for row, data, offsets in words.chunks(batch.column("text")):
                found, shares = _rows(data, offsets, terms)
                for i, at in enumerate(found):
                    before: list[float] = []
                    for w in links:
                        where, x = _row(at, shares[i], before, len(terms))
                        before.append(float(linear.sigmoid(w[where] @ x)))
                    out[row + i] = before
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(out[:, j]) for j in range(len(links)))], names=["id", *names])

    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} double" for n in names)).withColumnRenamed("id", id_col)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The chain low_quality, toxic, toxic_junk (both) over labels ``quality`` and ``toxic``.

    Returns id_col, ``held_out`` (as in the quality classifier), ``p_low_quality``, ``p_toxic``, ``p_toxic_junk``,
    ``score`` (p_toxic) and ``toxic`` (score of 0.5 or more): one row per input row.
    """
    low, toxic = (F.col("quality") == 0).cast("int"), F.col("toxic").cast("int")
    given = labels.select(id_col, low.alias("low_quality"), toxic.alias("toxic"), (low * toxic).alias("toxic_junk"))
    model = train_toxicity(docs, given, ["low_quality", "toxic", "toxic_junk"], id_col=id_col, text_col=text_col)
    scored = score_toxicity(docs, model, id_col, text_col)
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "p_low_quality", "p_toxic", "p_toxic_junk",
                         F.col("p_toxic").alias("score"), (F.col("p_toxic") >= 0.5).alias("toxic"))
