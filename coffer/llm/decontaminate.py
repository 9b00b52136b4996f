"""Benchmark decontamination as a prefix-filtered set join.

A window is a run of ``window`` words of a benchmark item (all of its words if it has fewer). A
document contains a window only if it contains the window's rarest word, so that word alone is the
necessary prefix of the window's word set: windows are indexed by it, documents look up their
words, and a match fixes where the window would have to start. Length and position bounds drop
starts outside the document; the rest is verified word by word. Rarity is counted over all
documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coffer.llm.common import cut, utf8

#: (window, item) pairs that are broadcast at once, about 300 bytes each; more are taken in turn
WINDOWS_PER_BLOCK = 100_000

#: A-Z lower-cased; 0-9, a-z and all bytes above 0x7F kept; everything else separates words
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_WORD_BYTES).split()


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    data, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    data = data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield data[a:b]


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(window, item) pairs without repeats; the window's words are joined by a space."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = {
                (b" ".join(w[i : i + window]).decode(), x)
                for x, w in zip(ids, map(words, _texts(batch, "text")))
                for i in range(max(1, len(w) - window + 1) if w else 0)
            }
            rows = list(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())],
                ["window", "item"],
            )

    narrow = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "window string, item string").distinct()


def _word_counts(docs: DataFrame, text: str, wanted) -> DataFrame:
    """Documents per word, of the words in the broadcast set, summed in the tasks first."""

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for raw in _texts(batch, "text"):
                seen.update(wanted.value.intersection(words(raw)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())],
            ["word", "n"],
        )

    part = docs.select(F.col(text).alias("text")).mapInArrow(run, "word string, n bigint")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


def _index(pairs: list, counts: dict[bytes, int]) -> dict:
    """rarest word -> [(its offset, the window's words, its items)]."""
    items: dict[tuple, set] = {}
    for window, item in pairs:
        items.setdefault(tuple(window.encode().split()), set()).add(item)
    index: dict[bytes, list] = {}
    for ws, own in items.items():
        _, rare = min((counts.get(w, 0), w) for w in set(ws))
        index.setdefault(rare, []).append((ws.index(rare), list(ws), own - {None}))
    return index


def _join_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _hits(ws: list[bytes], index: dict) -> tuple[list[tuple[int, int]], set]:
    spans: list[tuple[int, int]] = []
    items: set = set()
    present = index.keys() & set(ws)
    if present:
        for at, w in enumerate(ws):
            if w in present:
                for offset, window, own in index[w]:
                    start = at - offset
                    if start >= 0 and start + len(window) <= len(ws) and ws[start : start + len(window)] == window:
                        spans.append((start, start + len(window)))
                        items |= own
    return spans, items


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_NEW = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", _SPANS),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
]
_ARROW = [
    pa.field("n_words", pa.int64()),
    pa.field("hit_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    pa.field("hit_items", pa.list_(pa.string())),
]


def _look_up(docs: DataFrame, text: str, index, last: bool, keep: list[str]) -> DataFrame:
    """One block of windows looked up in every document, added to what earlier blocks found."""
    before = {"hit_spans", "n_words", "hit_items"} <= set(docs.columns)
    carried = [c for c in docs.columns if c not in {f.name for f in _NEW} and (not last or c in keep)]

    def run(batches):
        for batch in batches:
            n, spans, items = [], [], []
            old = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("hit_spans", "hit_items")))) if before else None
            for i, raw in enumerate(_texts(batch, text)):
                ws = words(raw)
                found, own = _hits(ws, index.value)
                if old:
                    found += [(s["start"], s["end"]) for s in old[i][0]]
                    own |= set(old[i][1])
                n.append(len(ws))
                spans.append([{"start": a, "end": b} for a, b in _join_spans(found)])
                items.append(sorted(own))
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in carried]
            arrays += [pa.array(x, f.type) for x, f in zip((n, spans, items), _ARROW)]
            yield pa.RecordBatch.from_arrays(arrays, [*carried, *(f.name for f in _ARROW)])

    schema = T.StructType([*(docs.schema[c] for c in carried), *_NEW])
    return docs.mapInArrow(run, schema)


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` (columns ``keep``, default all) with what of the benchmark they contain.

    New columns: ``n_words``; ``hit_spans``, the runs of words covered by windows, without
    overlap, as [start, end); ``hit_items``, the distinct ids (as text, sorted) of items with a
    window in the document; ``n_hit``, the words in the spans. Columns of ``docs`` with these
    names are replaced. Null and empty texts have no words; items without words have no window;
    items without an id count for spans only; repeated rows are judged alike; an empty benchmark
    hits nothing. Windows are broadcast in blocks of at most ``WINDOWS_PER_BLOCK`` pairs, so
    memory does not grow with the benchmark; blocks follow each other over the documents.
    """
    spark = docs.sparkSession
    keep = [c for c in (keep or docs.columns) if c not in {"n_words", "hit_spans", "hit_items", "n_hit"}]
    docs = docs.drop("n_words", "hit_spans", "hit_items", "n_hit")
    pairs = cut(item_windows(items, item_id, item_text, window), "windows")
    n_blocks = max(1, -(-pairs.count() // WINDOWS_PER_BLOCK))
    out = docs
    for block in range(n_blocks):
        own = pairs.where(F.pmod(F.xxhash64("window", "item"), F.lit(n_blocks)) == block).collect()
        vocabulary = {w for window_text, _ in own for w in window_text.encode().split()}
        counted = _word_counts(docs, text, spark.sparkContext.broadcast(vocabulary)).collect()
        counts = {r["word"].encode(): r["n"] for r in counted}
        index = spark.sparkContext.broadcast(_index(own, counts))
        last = block == n_blocks - 1
        out = _look_up(out, text, index, last, keep)
        if not last:
            out = cut(out, "hits")
    length = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda n, s: n + (s["end"] - s["start"]))
    return out.withColumn("n_hit", length)


def remove_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that contain no window of the benchmark, with their own columns."""
    marked = find_contamination(docs.withColumn("__text", F.col(text)), items, "__text", **options)
    return marked.where("n_hit = 0").select(*docs.columns)
