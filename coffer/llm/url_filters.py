"""URL filters: explicit rules, and path templates learned per host.

The paths of a host form a tree. Digits and hex runs of a segment are wildcards from the start; a
node with many different children has them replaced by one wildcard; children whose labelled
rates do not differ significantly are merged. What is left are the host's templates. A template is
blocked if the smoothed share of blocked pages among its labelled ones is high.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coffer.llm.common import LOWER, cut

WILDCARD = "{*}"


@dataclass(frozen=True)
class Rule:
    """``site`` is a host, a slash and the start of a path, like ``example.com/en/``."""

    verdict: str
    site: str

    @property
    def host(self) -> str:
        return self.site.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.site.partition("/")[2]


def host_of(url: str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, *LOWER)


def path_of(url: str) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(site, verdict) of the longest rule that fits, or null. A rule fits its host and all
    subdomains if the path starts with the rule's; of equal length the first by text wins."""
    found = F.when(F.lit(False), F.struct(F.lit("").alias("site"), F.lit("").alias("verdict")))
    for rule in sorted(rules, key=lambda r: (-len(r.site), r.site)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        found = found.when(fits, F.struct(F.lit(rule.site).alias("site"), F.lit(rule.verdict).alias("verdict")))
    return found


def shape_of(path: Column) -> Column:
    """The path with digit runs, and hex runs of 8 and more that hold a digit, as wildcards."""
    hexes = F.regexp_replace(path, r"(?=[0-9a-f]*[0-9])[0-9a-f]{8,}", "{x}")
    return F.regexp_replace(hexes, r"[0-9]+", "{n}")


def templates(
    units: DataFrame,
    max_depth: int = 6,
    max_children: int = 20,
    z: float = 1.96,
    strength: float = 2.0,
    prior: float = 0.5,
    block_at: float = 0.8,
) -> DataFrame:
    """Trees over ``units`` (host, shape, labelled, blocked; one row per host and shape).

    Returns host, shape, ``template``, ``purity`` and ``verdict``. Each level is one aggregation
    of the hosts' nodes; segments below ``max_depth`` form one. Purity is (blocked + strength *
    prior) / (labelled + strength): a template without labels is never blocked.
    """
    now = units.withColumn("segments", F.split("shape", "/")).withColumn("prefix", F.lit(""))
    for depth in range(max_depth):
        last = depth == max_depth - 1
        rest = F.array_join(F.slice("segments", depth + 1, F.greatest(F.size("segments"), F.lit(1))), "/")
        segment = rest if last else F.get("segments", F.lit(depth))
        now = cut(now.withColumn("segment", F.when(F.size("segments") > depth, segment)), "tree")
        children = now.groupBy("host", "prefix", "segment").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b"))
        children = cut(children, "nodes")
        wide = children.groupBy("host", "prefix").agg((F.count("segment") > max_children).alias("wide"))
        kept = children.where("segment is not null").join(wide, ["host", "prefix"])
        # in order of their rates, a child starts a new branch if it differs from the one before
        rate = F.try_divide("b", F.col("n").cast("double"))
        order = W.partitionBy("host", "prefix").orderBy("rate", "segment")
        narrow = kept.where("not wide and n > 0").withColumn("rate", rate)
        pn, pb = F.lag("n").over(order), F.lag("b").over(order)
        pooled = F.try_divide(F.col("b") + pb, (F.col("n") + pn).cast("double"))
        error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), "n") + F.try_divide(F.lit(1.0), pn)))
        gap = F.col("rate") - F.try_divide(pb, pn.cast("double"))
        differs = pn.isNull() | (F.coalesce(gap, F.lit(0.0)) > z * F.coalesce(error, F.lit(0.0)))
        narrow = narrow.withColumn("starts", differs.cast("int"))
        branch = F.sum("starts").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
        narrow = narrow.withColumn("branch", branch)
        same = W.partitionBy("host", "prefix", "branch")
        # the branch is named by its members, so that equal trees have equal templates
        names = F.array_join(F.array_sort(F.collect_set("segment").over(same)), "|")
        name = F.when(F.count("*").over(same) > 1, F.concat(F.lit("{"), names, F.lit("}"))).otherwise(F.col("segment"))
        narrow = narrow.select("host", "prefix", "segment", name.alias("name"))
        others = kept.where("wide or n = 0").select(
            "host", "prefix", "segment", F.when(F.col("wide"), WILDCARD).otherwise(F.col("segment")).alias("name")
        )
        named = narrow.unionByName(others)
        now = now.join(named, ["host", "prefix", "segment"], "left")
        now = now.withColumn("prefix", F.concat("prefix", F.coalesce(F.concat(F.lit("" if depth == 0 else "/"), "name"), F.lit("")))).drop("name", "segment")
    now = cut(now.select("host", "shape", F.col("prefix").alias("template"), "labelled", "blocked"), "tree")
    pure = now.groupBy("host", "template").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b"))
    purity = (F.col("b") + strength * prior) / (F.col("n") + strength)
    pure = pure.select("host", "template", F.round(purity, 6).alias("purity"))
    out = now.join(pure, ["host", "template"]).select("host", "shape", "template", "purity")
    return out.withColumn("verdict", F.when(F.col("purity") > block_at, "block").otherwise("allow"))


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", blocked: Column | None = None, **tree) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict``, ``template`` and ``purity``.

    The verdict is that of the longest rule that fits, else that of the page's template. Templates
    learn from ``blocked`` (boolean per page, null: not labelled), by default from the pages that
    a rule decides. Null urls and urls without ``://`` have an empty host and path. Columns of
    ``pages`` with these names are replaced; repeated rows are judged alike.
    """
    made = pages.withColumns({"__host": host_of(url), "__path": path_of(url)})
    made = made.withColumn("__rule", rule_of(F.col("__host"), F.col("__path"), rules)).withColumn("__shape", shape_of(F.col("__path")))
    label = F.col("__rule.verdict") == "block" if blocked is None else blocked
    units = made.groupBy(F.col("__host").alias("host"), F.col("__shape").alias("shape")).agg(
        F.count(label).alias("labelled"), F.count_if(F.coalesce(label, F.lit(False))).alias("blocked")
    )
    tree = templates(units, **tree).select(
        F.col("host").alias("__h"), F.col("shape").alias("__s"), F.col("template").alias("__template"),
        F.col("purity").alias("__purity"), F.col("verdict").alias("__verdict"),
    )
    out = made.join(tree, (F.col("__host") == F.col("__h")) & (F.col("__shape") == F.col("__s")), "left")
    new = {
        "host": F.col("__host"), "path": F.col("__path"), "rule": F.col("__rule.site"),
        "verdict": F.coalesce(F.col("__rule.verdict"), F.col("__verdict")),
        "template": F.col("__template"), "purity": F.col("__purity"),
    }
    own = [c for c in pages.columns if c not in new]
    return out.select(*own, *[x.alias(n) for n, x in new.items()])
