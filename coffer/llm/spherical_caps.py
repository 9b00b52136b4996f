"""Near-duplicate embeddings by spherical-cap filters.

Filters are the directions of a structured random product code: the rotated space is cut into
blocks, each with a small random codebook, and a direction takes one word of each. A vector is in
the filters whose direction it exceeds a threshold with; they are list-decoded block by block
without looking at the others. Vectors meet in filters and are verified in double precision.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.llm.common import cut, share, shared
from coffer.llm.components import components

#: vectors of a filter that are compared in one task; larger filters are cut into tiles
TILE = 512


@dataclass
class Code:
    """One product code: a rotation and a codebook for each block."""

    rotation: np.ndarray
    books: list[np.ndarray]

    def decode(self, x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, direction) for all directions that the unit rows of ``x`` exceed."""
        x = x @ self.rotation
        rows, codes, sums = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        at, scores = 0, []
        for book in self.books:
            scores.append(x[:, at : at + book.shape[1]] @ book.T / math.sqrt(len(self.books)))
            at += book.shape[1]
        rest = [*np.cumsum([s.max(axis=1) for s in reversed(scores[1:])], axis=0)[::-1], np.zeros(len(x))]
        for s, best in zip(scores, rest):  # keep what the best of the remaining blocks could lift over
            total = sums[:, None] + s[rows]
            i, word = np.nonzero(total >= threshold - best[rows][:, None])
            rows, codes, sums = rows[i], codes[i] * s.shape[1] + word, total[i, word]
        return rows, codes


@dataclass
class Filters:
    threshold: float
    codes: list[Code]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter), ordered, over all codes; a filter is a direction of one code."""
        found, first = [], 0
        for code in self.codes:
            rows, own = code.decode(x, self.threshold)
            found.append((rows, own + first))
            first += math.prod(len(b) for b in code.books)
        rows, filters = (np.concatenate(a) for a in zip(*found))
        order = np.lexsort((filters, rows))
        return rows[order], filters[order]


def design(dims: int, vectors: int, cosine: float, recall: float = 0.97, candidates: int = 400, seed: int = 11) -> Filters:
    """Filters for ``vectors`` vectors of ``dims`` components.

    The threshold rises with the number of vectors, so that a vector meets about ``candidates``
    unrelated ones; codes are added until ``recall`` of 1000 random pairs at exactly ``cosine``
    share a filter.
    """
    rng = np.random.default_rng(seed)
    tail = NormalDist().cdf
    rho = math.sqrt(max(1e-12, 1 - cosine * cosine))
    ceiling = 0.5 * math.sqrt(dims)  # few directions are nearer than that in low dimensions
    t = 0.5
    while True:  # both: how often a pair at the cosine passes a filter together, if it were Gaussian
        xs = np.linspace(t, t + 6, 200)
        density = np.exp(-xs * xs / 2) / math.sqrt(2 * math.pi)
        both = float(sum(d * tail((cosine * x - t) / rho) for d, x in zip(density, xs)) * (xs[1] - xs[0]))
        needed = 1 - math.log(1 - recall) / both
        if vectors * needed * tail(-t) ** 2 <= candidates or t + 0.1 > ceiling:
            break
        t += 0.1
    parts = min(dims, 3)
    widths = [len(b) for b in np.array_split(np.arange(dims), parts)]
    size = max(2, math.ceil((needed / 16) ** (1 / parts)))
    x, y = (rng.normal(size=(1000, dims)) for _ in range(2))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y = cosine * x + rho * y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    threshold, codes, met = t / math.sqrt(dims), [], np.zeros(len(x), bool)
    while met.mean() < recall:
        rotation = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        books = [rng.normal(size=(size, w)) for w in widths]
        codes.append(Code(rotation, [b / np.linalg.norm(b, axis=1, keepdims=True) for b in books]))
        of_x, of_y = (set(zip(*(a.tolist() for a in codes[-1].decode(v, threshold)))) for v in (x, y))
        met[[r for r, _ in of_x & of_y]] = True
    return Filters(threshold, codes)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _tile(f: int, ids: np.ndarray, unit: np.ndarray, copies: np.ndarray, filters: list, side: np.ndarray, cosine: float):
    """Links in one tile: per vector the copies it is linked to and the least id it is connected
    with here. A pair counts only in the first filter both are in. ``side``: 0 and 1 for the two
    blocks of a tile off the diagonal, between which pairs are compared."""
    close = unit @ unit.T >= cosine
    np.fill_diagonal(close, False)
    if side.any() and not side.all():
        close &= side[:, None] != side[None, :]
    near = np.flatnonzero(close.any(axis=1))
    if not len(near):
        return near, near, near  # all empty
    close = close[np.ix_(near, near)]
    label = ids[near].copy()
    while True:  # least id over links, until it settles
        least = np.minimum(label, np.where(close, label[None, :], label.max()).min(axis=1))
        if (least == label).all():
            break
        label = least
    row = np.repeat(np.arange(len(near)), [len(filters[i]) for i in near])
    own = np.concatenate([filters[i] for i in near])
    row, own = row[own < f], own[own < f]
    if len(own):
        names, at, n = np.unique(own, return_inverse=True, return_counts=True)
        shared = n > 1
        place = np.cumsum(shared) - 1
        keep = shared[at]
        held = np.zeros((len(near), int(shared.sum())), np.float32)
        held[row[keep], place[at[keep]]] = 1
        close &= held @ held.T == 0
    return ids[near], close @ copies[near], label


def _compare(rows: pa.Table, edges: list[int], cosine: float):
    """Links of the tiles between ``edges``, as one batch."""
    rows = rows.combine_chunks()
    ids, copies, block, low, high, f = (rows.column(c).to_numpy() for c in ("class", "copies", "block", "low", "high", "filter"))
    filters = rows.column("filters").combine_chunks()
    ends, flat = filters.offsets.to_numpy(), filters.values.to_numpy()
    vectors = rows.column("v").combine_chunks()
    out: list[list] = [[], [], []]
    for a, b in zip(edges[:-1], edges[1:]):
        unit = _unit(_matrix(vectors.slice(a, b - a)))
        side = (block[a:b] == high[a]).astype(int) if low[a] != high[a] else np.zeros(b - a, int)
        own = [flat[ends[i] : ends[i + 1]] for i in range(a, b)]
        for part, found in zip(out, _tile(f[a], ids[a:b], unit, copies[a:b], own, side, cosine)):
            part.append(found)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], ["class", "n", "root"])


def link_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, recall: float = 0.97
) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id`` (least id that can be
    reached), ``kept`` (whether that is its own).

    Equal vectors are linked and compared once. Null, empty and zero vectors and those with null
    or non-finite components link with nothing; vectors of different lengths are not linked with
    each other. Pairs below ``cosine`` are never linked; pairs at it are found with probability
    ``recall``, nearer ones more surely. Repeated rows are vectors of their own. Rows with a null
    id take part; a component without any id is null.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    usable = F.coalesce((F.size("v") > 0) & F.forall("v", finite) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(usable, F.col("v")))
    # equal vectors become one class; its number is fixed by writing it
    classes = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = cut(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    sizes = classes.groupBy(F.size("v").alias("dims")).count().collect()
    designs = {r["dims"]: design(r["dims"], r["count"], cosine, recall) for r in sizes}
    filters = share(spark, designs)

    def decode(batches):
        for batch in batches:
            lengths = np.array([len(v) for v in batch.column(1)], int)
            for dims in sorted(set(lengths.tolist())):
                own = batch.filter(pa.array(lengths == dims))
                for at in range(0, own.num_rows, 256):
                    part = own.slice(at, 256)
                    who, code = shared(filters)[dims].decode(_unit(_matrix(part.column(1))))
                    ends = np.searchsorted(who, np.arange(part.num_rows + 1)).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(code, pa.int64()))
                    yield pa.RecordBatch.from_arrays([part.column(0), lists], ["class", "filters"])

    inside = cut(classes.select("class", "v").mapInArrow(decode, "class bigint, filters array<bigint>"), "filters")
    known = classes.select("class", "v", "copies").join(inside, "class")
    met = known.select("*", F.size("v").alias("dims"), F.explode("filters").alias("filter"))
    counts = inside.join(classes.select("class", F.size("v").alias("dims")), "class")
    counts = counts.select("dims", F.explode("filters").alias("filter")).groupBy("dims", "filter").count().where("count > 1")
    counts = cut(counts.withColumn("n_blocks", F.ceil(F.col("count") / TILE).cast("int")).drop("count"), "meetings")
    met = met.join(counts, ["dims", "filter"])
    # a filter of n blocks is compared in n (n + 1) / 2 tiles; each vector goes to n of them
    block = F.pmod(F.xxhash64("class"), F.col("n_blocks")).cast("int")
    tiles = met.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    tiles = tiles.select(
        "dims", "filter", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "block", "class", "copies", "v", "filters",
    )

    key = ["dims", "filter", "low", "high"]

    def compare(batches):
        waiting = None  # rows of the last tile seen, which may go on in the next batch
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if waiting is None else pa.concat_tables([waiting, rows])
            keys = [rows.column(c).to_numpy() for c in key]
            fresh = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1
            edges = [0, *fresh.tolist()]
            waiting = rows.slice(edges[-1])
            if len(edges) > 1:
                yield from _compare(rows.slice(0, edges[-1]), edges, cosine)
        if waiting is not None and waiting.num_rows:
            yield from _compare(waiting, [0, waiting.num_rows], cosine)

    sorted_tiles = tiles.repartition(*key).sortWithinPartitions(*key)
    found = sorted_tiles.mapInArrow(compare, "class bigint, n bigint, root bigint")
    found = cut(found, "found")
    linked = found.groupBy("class").agg(F.sum("n").alias("n"))
    roots = components(found.select("class", "root"), "class", "root").select(F.col("node").alias("class"), "component")
    named = classes.join(linked, "class", "left").join(roots, "class", "left")
    named = named.select("v", "least", "copies", "n", F.coalesce("component", "class").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select(
        F.col("v").alias("w"), "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    out = rows.join(named, F.col("v") == F.col("w"), "left")
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
