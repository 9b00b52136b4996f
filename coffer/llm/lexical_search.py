"""Ranked lexical search, reversed: the items are indexed and the documents are streamed.

The terms of all items make an inverted index, which is broadcast. A task streams its documents
through it: a document's term counts are looked up, their contributions added along the postings,
and each item keeps a bounded heap of its best documents. The heaps of the tasks are merged, first
within shares of the tasks and then per item. Neither documents nor scores are shuffled otherwise.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coffer.llm.common import cut, share, shared, texts
from coffer.llm.decontaminate import words

#: (term, item) pairs of an index that is broadcast at once, about 150 bytes each with their
#: terms; more items are searched for in turn
POSTINGS_PER_BLOCK = 200_000
#: scores (documents times items) that a task holds at once
_SCORES = 1 << 20
#: postings that a task adds up at once
_STEPS = 1 << 20


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``item`` (a number), ``item_id`` and the distinct ``terms`` of every distinct row with a term."""
    found = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).distinct()

    def run(batches):
        for batch in batches:
            terms = [sorted({w.decode() for w in words(raw)}) for raw in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.string()))], ["item_id", "terms"])

    schema = T.StructType([found.schema["item_id"], T.StructField("terms", T.ArrayType(T.StringType()))])
    return found.mapInArrow(run, schema).where(F.size("terms") > 0).withColumn("item", F.monotonically_increasing_id())


def _statistics(docs: DataFrame, numbers) -> DataFrame:
    """(term, n): documents that hold each term of the broadcast vocabulary; under -1 the
    documents with a term at all, under -2 their terms with repeats. Summed in the tasks first."""

    def run(batches):
        number = shared(numbers)
        df, total, terms = np.zeros(len(number), np.int64), 0, 0
        for batch in batches:
            for raw in texts(batch.column(0)):
                ws = words(raw)
                if ws:
                    total, terms = total + 1, terms + len(ws)
                    df[[number[w] for w in number.keys() & set(ws)]] += 1
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*seen.tolist(), -1, -2], pa.int64()), pa.array([*df[seen].tolist(), total, terms], pa.int64())], ["term", "n"]
        )

    return docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


class Index:
    """Inverted index of a block of items with the weights of its terms."""

    def __init__(self, items: list[tuple[int, list[str]]], numbers: dict[bytes, int], df: dict[int, int], documents: int, length: int):
        self.items = np.array([item for item, _ in items], np.int64)
        self.numbers, self.documents, self.length = numbers, documents, length
        pairs = np.array([(numbers[t.encode()], i) for i, (_, terms) in enumerate(items) for t in terms], np.int64).reshape(-1, 2)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        self.ends = np.searchsorted(pairs[:, 0], np.arange(len(numbers) + 1))
        self.postings = pairs[:, 1]
        self.weights = np.array(
            [math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(numbers))], np.int64
        )

    def terms_of(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """A document's terms that occur in the index, and what each adds to an item's score."""
        ws = words(raw)
        own = [t for t in map(self.numbers.get, ws) if t is not None]
        terms, tf = np.unique(np.array(own, np.int64), return_counts=True)
        if not len(own):
            return terms, terms
        m = 100 - 90 + (90 * len(ws) * self.documents) // self.length
        return terms, self.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))

    def scores(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Scores of every document of ``found`` for every item, exact in 64-bit integers."""
        out = np.zeros(len(found) * len(self.items), np.int64)
        row = np.repeat(np.arange(len(found)), [len(t) for t, _ in found])
        terms, adds = (np.concatenate(x) for x in zip(*found))
        n = self.ends[terms + 1] - self.ends[terms]
        edges = np.concatenate([[0], np.cumsum(n)])
        at = 0
        while at < len(terms):  # whole runs of postings, about _STEPS at a time
            end = max(at + 1, int(np.searchsorted(edges, edges[at] + _STEPS, "right")) - 1)
            own = n[at:end]
            place = np.arange(edges[end] - edges[at]) + np.repeat(self.ends[terms[at:end]] - (edges[at:end] - edges[at]), own)
            np.add.at(out, np.repeat(row[at:end], own) * len(self.items) + self.postings[place], np.repeat(adds[at:end], own))
            at = end
        return out.reshape(len(found), len(self.items))


def _order(entry: tuple):
    """Best first: the higher score, then the lesser id, a null id last."""
    score, doc = entry
    return -score, doc is None, doc if doc is not None else 0


class Heaps:
    """The ``limit`` best documents of every item; ``floor`` is the score one must reach."""

    def __init__(self, items: int, limit: int):
        self.limit, self.best, self.floor = limit, [[] for _ in range(items)], np.ones(items, np.int64)

    def update(self, scores: np.ndarray, docs: list) -> None:
        touched = set()
        for row, item in zip(*(a.tolist() for a in np.nonzero(scores >= self.floor))):
            heap = self.best[item]
            heap.append((int(scores[row, item]), docs[row]))
            touched.add(item)
            if len(heap) >= 8 * self.limit:
                self._trim(item)
        for item in touched:
            self._trim(item)

    def _trim(self, item: int) -> None:
        heap = self.best[item]
        heap.sort(key=_order)
        del heap[self.limit :]
        if len(heap) == self.limit:
            self.floor[item] = heap[-1][0]


def _stream(docs: DataFrame, index, limit: int) -> DataFrame:
    """(item, doc_id, score) of the heaps of every task."""
    schema = T.StructType([T.StructField("item", T.LongType()), docs.schema["doc_id"], T.StructField("score", T.LongType())])

    def run(batches):
        own, heaps, ids = shared(index), None, None
        heaps = Heaps(len(own.items), limit)
        for batch in batches:
            ids = batch.schema.field(0).type
            waiting, names, postings = [], [], 0
            for doc, raw in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                found = own.terms_of(raw)
                if len(found[0]):
                    waiting.append(found)
                    names.append(doc)
                if len(waiting) * len(own.items) >= _SCORES:
                    heaps.update(own.scores(waiting), names)
                    waiting, names = [], []
            if waiting:
                heaps.update(own.scores(waiting), names)
        if ids is not None:
            rows = [(int(own.items[i]), doc, score) for i, heap in enumerate(heaps.best) for score, doc in heap]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), ids, pa.int64()))], ["item", "doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def rank_documents(
    docs: DataFrame, items: DataFrame, limit: int = 10, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", shares: int = 32,
) -> DataFrame:
    """The ``limit`` best documents of every item: ``item_id``, ``rank`` (int, from 1), ``doc_id``,
    ``score`` (bigint, above 0).

    Terms are runs of ASCII letters (A-Z count as a-z), digits and non-ASCII characters. With N
    documents that have a term, L their terms with repeats, n the terms of one document, df the
    documents with a term and tf its occurrences in one, a term weighs
    floor(1000 ln((2N + 2) / (2 df + 1))), and adds weight * (10^9 tf div (1000 tf + 8 m)) with
    m = 10 + (90 n N) div L, once for each distinct term of the item.

    Null and empty texts have no terms: such documents are found by no item and do not count, and
    such items have no rows. Equal scores rank by ascending id, a null id last; repeated rows of a
    document rank one after another. Repeated rows of an item (same id and text) are one item;
    several texts under one id, or under a null one, are ranked each for itself. Other columns are
    ignored. The index is broadcast in blocks of about ``POSTINGS_PER_BLOCK`` postings, taken in
    turn, each with two passes over the documents; a task keeps ``limit`` documents per item of
    the block. ``shares``: parts in which the heaps of an item are merged before the last merge.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    indexed = cut(item_terms(items, item_id, item_text), "item-terms")
    n_blocks = max(1, -(-(indexed.agg(F.sum(F.size("terms"))).first()[0] or 0) // POSTINGS_PER_BLOCK))
    found = []
    for block in range(n_blocks):
        own = indexed.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block).select("item", "terms").collect()
        numbers = {t.encode(): i for i, t in enumerate(sorted({t for _, terms in own for t in terms}))}
        counts = dict(_statistics(docs, share(spark, numbers)).collect())
        n, length = counts.pop(-1, 0), counts.pop(-2, 0)
        index = Index([tuple(r) for r in own], numbers, counts, n, length)
        found.append(_stream(docs, share(spark, index), limit))
    best = found[0]
    for part in found[1:]:
        best = best.unionByName(part)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    best = best.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(shares)))
    for key in (["item", "share"], ["item"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= limit)
    return best.join(indexed.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
