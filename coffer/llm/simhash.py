"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a variant within r bits of each in common.
So every distinct fingerprint emits all variants within half the radius, variants are the shuffle
key, and those that meet are verified. Only fingerprints within r bits of a variant meet at it (65
of 64 bits for r = 1), so no group is larger than that however many copies there are.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coffer.llm.common import cut, free_name, slices, texts
from coffer.llm.components import components

BITS = 64


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """SimHash of the text's word shingles, repeats included, as a signed 64-bit number.

    Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased. A text of fewer
    words is one shingle; one without words has fingerprint 0.
    """
    ws = raw.lower().split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    ends = np.cumsum([len(w) + 1 for w in ws]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(ws) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[len(ws) - n :].tolist())
    digests = b"".join([xxhash.xxh64_digest(joined[a:b], 42) for a, b in spans])
    ones = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, name: str = "fingerprint") -> DataFrame:
    """``docs`` without the text and with its fingerprint (bigint). A null text counts as empty."""
    kept = [c for c in docs.columns if c not in (text, name)]

    def run(batches):
        for batch in slices(batches, len(kept)):
            out = [fingerprint(raw, shingle) for raw in texts(batch.column(len(kept)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.int64())], [*kept, name])

    fields = docs.select(*kept, F.lit(0).cast("bigint").alias(name)).schema
    return docs.select(*kept, F.col(text)).mapInArrow(run, fields)


def ball(radius: int) -> list[int]:
    """Masks of at most ``radius`` bits, as signed 64-bit numbers."""
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(BITS), k)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def links(prints: DataFrame, name: str = "fingerprint", radius: int = 2) -> DataFrame:
    """(left, right) between different fingerprints at most ``radius`` bits apart.

    At each variant the least fingerprint is linked to the others that meet there; all of them
    are within the radius of each other, so what is connected stays connected without emitting
    the pairs of a group. ``radius`` must be even, so that the halves meet.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    masks = F.array(*[F.lit(m).cast("bigint") for m in ball(radius // 2)])
    met = prints.select(F.col(name).alias("right")).distinct().select(
        "right", F.explode(F.transform(masks, lambda m: F.col("right").bitwiseXOR(m))).alias("variant")
    )
    least = met.select("right", F.min("right").over(W.partitionBy("variant")).alias("left"))
    close = F.bit_count(F.col("left").bitwiseXOR(F.col("right"))) <= radius
    return least.where((F.col("left") != F.col("right")) & close).distinct()


def groups(prints: DataFrame, doc_id: str = "doc_id", name: str = "fingerprint", radius: int = 2, component: str = "component_id") -> DataFrame:
    """``prints`` with ``component``: the least id that can be reached over links.

    Equal fingerprints are linked. Rows with a null id belong to the group of their fingerprint;
    a group without any id has a null component. Repeated rows stay.
    """
    least = prints.groupBy(name).agg(F.min(doc_id).alias("least"))
    found = components(links(prints, name, radius), "left", "right")
    linked = least.join(found, F.col(name) == F.col("node"), "left")
    named = linked.select(name, "least", F.coalesce("component", name).alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias(component))
    by_print = named.select(name, "root").join(roots, "root").select(F.col(name).alias("__print"), component)
    return prints.drop(component).join(by_print, F.col(name) == F.col("__print"), "left").drop("__print")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One document of each group of near duplicates: the one of least id (null ids last).

    Of rows with that id in a group the one of least row hash stays, of rows alike in every
    column one. Texts without words are alike. ``docs`` is read twice, for the fingerprints and
    for the rows kept, which are shuffled once; any columns may be there.
    """
    whole = F.xxhash64(*[F.col(c) for c in docs.columns])
    key = F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), whole.alias("row"))
    prints = cut(fingerprints(docs.select(key.alias("key"), F.col(text).alias("text")), shingle=shingle), "fingerprints")
    least = prints.groupBy("fingerprint").agg(F.min("key").alias("key"))  # copies collapse here
    found = components(links(prints, radius=radius), "left", "right")
    rooted = least.join(found, F.col("fingerprint") == F.col("node"), "left")
    winners = rooted.groupBy(F.coalesce("component", "fingerprint").alias("root")).agg(F.min("key").alias("key"))
    winners = cut(winners.select("key.*"), "kept")
    own, n = free_name(docs, "__key"), free_name(docs, "__n")
    marked = docs.withColumn(own, key)
    same = (F.col(f"{own}.row") == winners["row"]) & F.col(f"{own}.id").eqNullSafe(winners["id"])
    kept = marked.join(winners, same, "left_semi")
    first = W.partitionBy(f"{own}.row", f"{own}.id").orderBy(f"{own}.row")
    return kept.withColumn(n, F.row_number().over(first)).where(F.col(n) == 1).select(*docs.columns)
