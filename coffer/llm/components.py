"""Connected components of a link table by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.llm.common import cut


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star round over links (u, v) with u > v."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    # large star: every larger neighbour of u goes to the least of u and its neighbours
    large = (
        both.join(least, "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        .distinct()
    )
    large = cut(large, "large-star")
    # small star: u and its smaller neighbours go to the least of them
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has a link; the component is its least node.

    ``links`` may repeat and may point both ways; links of a node to itself and links with a
    null end are ignored. Nothing but a checksum of each round comes to the driver. Joins are of
    rows with one aggregate row per node, so that adaptive execution can split a hub.
    """
    now = cut(
        links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .where(F.col("u") != F.col("v"))
        .where(F.col(left).isNotNull() & F.col(right).isNotNull())
        .distinct(),
        "links",
    )
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        now = cut(_stars(now), "small-star")
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
