"""Sharding by histogram sort.

Rows get a 62-bit sort key: 31 bits of the hash of their group (equal texts lie side by side) and
31 bits that tell rows of a group apart, so that a group larger than a shard is split. Splitters
are found by counting the exact bytes below candidate boundaries in every partition, narrowing
down the interval around each target until the boundary is within tolerance or exact to the row.
Then rows are exchanged once. Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coffer.llm.common import cut

KEY_BITS = 62
_FIRST, _STEP = 12, 6


def text_size(text: str) -> Column:
    """UTF-8 bytes of the text plus 16; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("bigint")


def sort_key(group: Column, *tie: Column) -> Column:
    """62-bit key: hash of the group (high half), hash of what tells its rows apart (low half)."""
    high = F.shiftrightunsigned(F.xxhash64(group), 33)
    low = F.shiftrightunsigned(F.xxhash64(*tie), 33)
    return F.shiftleft(high, 31).bitwiseOR(low)


@dataclass(frozen=True)
class Interval:
    """Keys ``low`` .. ``low + 2**bits - 1``; ``below`` bytes have smaller keys."""

    low: int
    bits: int
    below: int


def _count(keyed: DataFrame, key: str, size: str, wanted: list[Interval], step: int) -> dict:
    """Bytes and rows of each of the 2**step parts of each interval: one pass, summed in the
    scan's tasks."""
    which = part = None
    for i, x in enumerate(wanted):
        inside = F.col(key).between(x.low, x.low + (1 << x.bits) - 1)
        at = F.shiftright(F.col(key) - x.low, x.bits - step)
        which = F.when(inside, i) if which is None else which.when(inside, i)
        part = F.when(inside, at) if part is None else part.when(inside, at)
    counted = (
        keyed.select(which.alias("which"), part.alias("part"), F.col(size).alias("n_bytes"))
        .where(F.col("which").isNotNull())
        .groupBy("which", "part")
        .agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_rows"))
    )
    found: dict[int, list] = {}
    for r in counted.collect():  # at most intervals x 2**step rows
        found.setdefault(r["which"], []).append((r["part"], r["n_bytes"], r["n_rows"]))
    return {i: sorted(parts) for i, parts in found.items()}


def splitters(keyed: DataFrame, key: str, size: str, shards: int, tolerance: float = 0.001) -> list[int]:
    """``shards - 1`` keys at which a new shard begins.

    A boundary is taken once the bytes below it are within ``tolerance`` of a shard's bytes of
    its target, or once a single row or key straddles the target; then the nearer side is taken.
    """
    total = keyed.agg(F.sum(size)).first()[0] or 0
    targets = [total * i // shards for i in range(1, shards)]
    slack = tolerance * total / shards
    open_: dict[int, Interval] = {i: Interval(0, KEY_BITS, 0) for i in range(len(targets))} if total else {}
    done: dict[int, int] = {}
    step = _FIRST
    while open_:
        wanted = sorted({x for x in open_.values()}, key=lambda x: x.low)
        # intervals of one round have one width: they are parts of the same grid
        step = min(step, wanted[0].bits)
        counts = _count(keyed, key, size, wanted, step)
        number = {x: i for i, x in enumerate(wanted)}
        for i, x in list(open_.items()):
            below, width = x.below, x.bits - step
            for part, n_bytes, n_rows in counts[number[x]]:
                low = x.low + (part << width)
                if below + n_bytes >= targets[i]:
                    before, after = targets[i] - below, below + n_bytes - targets[i]
                    if min(before, after) <= slack or n_rows == 1 or width == 0:
                        done[i] = low if before <= after else low + (1 << width)
                        del open_[i]
                    else:
                        open_[i] = Interval(low, width, below)
                    break
                below += n_bytes
        step = _STEP
    return [done.get(i, 0) for i in range(len(targets))]


def shard(
    df: DataFrame,
    shards: int,
    size: Column,
    group: Column,
    *tie: Column,
    tolerance: float = 0.001,
    names: tuple[str, str] = ("shard", "slot"),
) -> DataFrame:
    """``df`` with its shard (0 to shards - 1) and its place in the shard (from 0, no gaps).

    Shards hold near equal sums of ``size``: each boundary is at most one row, or ``tolerance``
    of a shard, off its target. Rows of a group are adjacent: they share a shard unless a
    boundary falls into the group. Rows alike in ``group`` and ``tie`` are told apart by their
    place in the input. Nulls form a group of their own. No row is lost or repeated; an empty
    table stays empty. Columns of ``df`` called like one of ``names`` are replaced.
    """
    key = sort_key(group, *tie, F.monotonically_increasing_id())
    # only (key, size) is written and counted again and again, never the rows themselves
    keyed = cut(df.select(key.alias("key"), size.alias("n_bytes")), "keys")
    at = splitters(keyed, "key", "n_bytes", shards, tolerance)
    place = F.when(F.lit(False), 0)
    for i, low in reversed([*enumerate(at, 1)]):  # the last boundary not above the key decides
        place = place.when(F.col("__key") >= low, i)
    place = place.otherwise(0)
    out = df.withColumn("__key", key).withColumn(names[0], place.cast("int"))
    order = W.partitionBy(names[0]).orderBy("__key")
    return out.withColumn(names[1], (F.row_number().over(order) - 1).cast("bigint")).drop("__key")
