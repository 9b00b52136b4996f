"""Byte-level BPE encoding and decoding with a given rank file.

Encoding splits a text by the tokenizer's pattern and folds ranked merges over the byte arrays of
the distinct words of a task, many words at a time, remembered while the task lasts; texts are
then sequences of remembered words. Decoding is built in: ids become the hex digits of their pieces, which are
concatenated. README gives the figures that rule out folding with Spark's higher-order functions.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coffer.llm.common import slices, texts

#: bytes of words and ids that a task remembers, and for each word about this much more; beyond
#: that it starts afresh
REMEMBERED, _OVERHEAD = 40 << 20, 190
_LONG_WORD = 64
#: new words that are merged at once
_TOGETHER = 20_000


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 piece and its rank per line. Read by the driver, 1 MB or so."""
    with open(path, "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in file if line.strip())}


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ids that merge (left * 2^32 + right, sorted) and the ids they merge into."""
    pairs = {
        (ranks[piece[:i]] << 32) + ranks[piece[i:]]: rank
        for piece, rank in ranks.items()
        for i in range(1, len(piece))
        if piece[:i] in ranks and piece[i:] in ranks
    }
    codes = np.fromiter(pairs, np.int64, len(pairs))
    order = np.argsort(codes)
    return codes[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]


def merge_words(words: list[bytes], ranks: dict[bytes, int], table: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Token ids of each word: in each round every word merges its leftmost pair of least rank,
    until none of its pairs has a rank."""
    codes, merged = table
    none = np.int64(1) << 40
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    ids = single[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), [len(w) for w in words])
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(ids):
        pair = (ids[:-1] << 32) + ids[1:]
        at = np.minimum(np.searchsorted(codes, pair), len(codes) - 1) if len(codes) else np.zeros(len(pair), np.int64)
        known = (codes[at] == pair) & (word[1:] == word[:-1]) if len(codes) else np.zeros(len(pair), bool)
        rank = np.append(np.where(known, merged[at] if len(codes) else 0, none), none)  # one for each id, as the left of its pair
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        least = np.minimum.reduceat(rank, starts)
        best = np.repeat(least, np.diff(np.append(starts, len(ids))))
        go = best < none
        done.append((word[~go], ids[~go]))
        left = np.flatnonzero((rank == best) & go)
        left = left[np.append(True, word[left][1:] != word[left][:-1])] if len(left) else left
        ids[left] = rank[left]
        go[left + 1] = False
        ids, word = ids[go], word[go]
    words_of, all_ids = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64),) * 2
    order = np.argsort(words_of, kind="stable")
    ends = np.searchsorted(words_of[order], np.arange(1, len(words) + 1))
    return np.split(all_ids[order].astype(np.int32), ends[:-1]) if len(words) else []


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The same merges with a heap, for words whose pairs are too many to scan each time."""
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if end[i] else n
        if not end[i] or j >= n or end[j] != stop:
            continue  # one of the two parts has merged otherwise
        end[i], end[j], after[i] = stop, 0, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    return [word[i : end[i]] for i in range(n) if end[i]]


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one word: the leftmost pair of least rank merges until no pair has a rank."""
    return [ranks[word]] if word in ranks else [ranks[p] for p in _merge_long(word, ranks)]


def _remember(known: dict[str, bytes], fresh: list[str], ranks: dict[bytes, int], table) -> int:
    """Adds the token ids of new words, as bytes; returns what that takes of memory."""
    several, held = [], 0
    for word in fresh:
        raw = word.encode()
        if raw in ranks or len(raw) > _LONG_WORD:
            known[word] = array("i", merge(raw, ranks)).tobytes()
        else:
            several.append((word, raw))
    for at in range(0, len(several), _TOGETHER):
        part = several[at : at + _TOGETHER]
        for (word, _), ids in zip(part, merge_words([raw for _, raw in part], ranks, table)):
            known[word] = ids.tobytes()
    for word in fresh:
        held += len(word) + len(known[word]) + _OVERHEAD
    return held


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", name: str = "tokens", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns of ``docs``) and the text's token ids (array<int>).

    Whole texts, without special tokens. A null text counts as empty and has no tokens; a column
    called ``name`` is replaced; repeated rows are encoded alike. ``ranks`` must hold all single
    bytes.
    """
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the ranks lack single bytes")
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pair_table(ranks)))
    kept = [c for c in (keep or docs.columns) if c != name]

    def run(batches):
        (ranks, table), known, held, find = shared.value, {}, 0, regex.compile(pattern).findall
        for batch in slices(batches, len(kept), 2 << 20):
            found = [find(raw.decode()) for raw in texts(batch.column(len(kept)))]
            if held >= REMEMBERED:
                known, held = {}, 0
            held += _remember(known, list({w for ws in found for w in ws if w not in known}), ranks, table)
            ids, ends = bytearray(), [0]
            for ws in found:
                ids += b"".join([known[w] for w in ws])
                ends.append(len(ids) // 4)
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(bytes(ids), np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], tokens], [*kept, name])

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(name, T.ArrayType(T.IntegerType()))])
    return docs.select(*kept, F.col(text).alias("__text")).mapInArrow(run, schema)


def decode(tokens: Column | str, ranks: dict[bytes, int]) -> Column:
    """The bytes the ids stand for. Null gives null; an id outside the ranks gives null too."""
    size = max(ranks.values()) + 1
    digits = [""] * size
    for piece, rank in ranks.items():
        digits[rank] = piece.hex()
    literal = F.split(F.lit(" ".join(digits)), " ")  # folded into one constant array
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    known = F.forall(tokens, lambda i: F.coalesce((i >= 0) & (i < size), F.lit(False)))
    return F.when(known, F.unhex(F.array_join(F.transform(tokens, lambda i: F.get(literal, i)), "")))


def ids_text(tokens: Column | str) -> Column:
    """Decimal ids joined by one space."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.array_join(tokens.cast("array<string>"), " ")


def fold_words(words: DataFrame, ranks: dict[bytes, int], word: str = "word", name: str = "tokens", buckets: int = 8192) -> DataFrame:
    """``words`` with the token ids of each word by Spark's higher-order functions alone.

    The literal rank map is an array of small maps, found by the crc32 of a piece; an aggregate
    over as many steps as the word has bytes merges the leftmost pair of least rank. For tables
    of distinct, short words: each step looks at every pair of the word again.
    """
    table: list[dict[str, int]] = [{} for _ in range(buckets)]
    for piece, rank_ in ranks.items():
        table[zlib.crc32(piece) % buckets][piece.hex()] = rank_
    # a constant of the plan: folded once, then looked up by position and a few comparisons
    maps = F.from_json(F.lit(json.dumps(table)), "array<map<string,int>>")

    def rank(piece):
        return F.get(maps, (F.crc32(F.unhex(piece)) % buckets).cast("int"))[piece]

    def step(parts, _):
        pair = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p, i: rank(F.concat(p, F.get(parts, i + 1))))
        best = F.array_min(pair)
        at = F.array_position(pair, best).cast("int")
        merged = F.concat(
            F.slice(parts, 1, at - 1),
            F.array(F.concat(F.get(parts, at - 1), F.get(parts, at))),
            F.slice(parts, at + 2, F.size(parts)),
        )
        return F.when((F.size(parts) > 1) & best.isNotNull(), merged).otherwise(parts)

    hexed = F.hex(F.encode(F.col(word), "utf-8"))
    start = F.transform(F.sequence(F.lit(1), F.octet_length(word)), lambda i: F.lower(F.substring(hexed, i * 2 - 1, F.lit(2))))
    parts = F.aggregate(F.sequence(F.lit(2), F.greatest(F.lit(2), F.octet_length(word))), start, step)
    ids = F.transform(F.when(F.octet_length(word) > 0, parts).otherwise(F.array().cast("array<string>")), rank)
    return words.withColumn(name, ids)
