"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of up to ``order`` bytes with the counts of what follows
them. A byte costs the bits of its probability in the longest context of the tree: seen bytes get
c/(n+d), the escape mass d/(n+d) is spread over the unseen ones as the next shorter context would
(n occurrences of d distinct bytes). Statistics are frozen, so every probability is computed once
and a text's exact code length under a language is a sum of table entries.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coffer.llm.common import blocks, context_codes, row_sums, share, shared, utf8

UNKNOWN = "und"
MAX_LANGUAGES = 1000


@dataclass
class Trees:
    """Contexts of all languages as one table: bits[context, byte, language]."""

    languages: list[str]
    order: int
    codes: list[np.ndarray]  # by context length; each sorted
    bits: np.ndarray

    def index(self) -> np.ndarray:
        """Row of the longest known context for every ``order`` preceding bytes."""
        rows = np.zeros(1, np.int32)
        first = 1
        for k in range(1, self.order + 1):
            rows = np.tile(rows, 256)
            rows[self.codes[k]] = np.arange(first, first + len(self.codes[k]))
            first += len(self.codes[k])
        return rows


def _sample(docs: DataFrame, key: str, text: str, lang: str, rows: int) -> DataFrame:
    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    sizes = known.groupBy(F.col(lang).alias("lang")).agg(F.approx_count_distinct(F.xxhash64(key)).alias("n"))
    sizes = sizes.limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    bound = F.lit(-1)
    h = F.pmod(F.xxhash64(key), F.lit(1_000_003))
    if sizes:
        shares = F.from_json(F.lit(json.dumps({r["lang"]: int(1_000_003 * min(1.0, rows / max(1, r["n"]))) for r in sizes})), "map<string,int>")
        bound = F.element_at(shares, F.col(lang))
    picked = known.where(h < bound).select(F.col(lang).alias("lang"), F.col(key).alias("key"), F.col(text).alias("text"))
    return picked.groupBy("lang", "key").agg(F.min("text").alias("text"))


def _counts(sample: DataFrame, order: int) -> DataFrame:
    """(lang, k, code, n): how often each byte follows each context of k bytes."""

    def run(batches):
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                own = batch.column(1).filter(pa.array(langs == lang))
                data, offsets = utf8(own)
                for _, _, lo, hi in blocks(offsets, 1 << 22):
                    codes = context_codes(data, offsets, lo, hi, order) << 8 | data[lo:hi]
                    code, n = np.unique(codes, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n.astype(np.int64))],
                        ["lang", "code", "n"],
                    )

    full = sample.select("lang", "text").mapInArrow(run, "lang string, code bigint, n bigint")
    full = full.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    ks = F.explode(F.sequence(F.lit(0), F.lit(order))).alias("k")
    masks = F.array(*[F.lit((1 << 8 * (k + 1)) - 1).cast("bigint") for k in range(order + 1)])
    part = F.col("code").bitwiseAND(F.get(masks, F.col("k")))
    return full.select("lang", "n", "code", ks).groupBy("lang", "k", part.alias("code")).agg(F.sum("n").alias("n"))


def fit(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    order: int = 3,
    rows_per_language: int = 1000,
    max_entries: int = 500_000,
    table_mb: int = 48,
) -> Trees:
    """Trees from about ``rows_per_language`` rows of each language, chosen by the hash of their
    key; of rows with one key and language the least text counts. ``max_entries`` and ``table_mb``
    bound the trees: beyond them the rarest long contexts are pruned and their texts scored in
    shorter ones.
    """
    counts = _counts(_sample(docs, key, text, lang, rows_per_language), order).persist()
    try:
        # bytes in contexts of at most one byte always stay: 65,792 for each language at most
        sizes = counts.where("k > 1").groupBy("n").count().collect()
        kept, least = 0, 1
        for r in sorted(sizes, key=lambda r: -r["n"]):
            kept += r["count"]
            if kept > max_entries:
                least = r["n"] + 1
                break
        found = counts.where((F.col("k") <= 1) | (F.col("n") >= least)).toPandas()
    finally:
        counts.unpersist()
    return _trees(found, order, table_mb)


def _trees(found, order: int, table_mb: int) -> Trees:
    languages = sorted(found["lang"].unique()) if len(found) else []
    n_lang = max(1, len(languages))
    room = max(300, (table_mb << 20) // (1024 * n_lang))
    found = found.assign(context=found["code"] // 256, symbol=found["code"] % 256)
    totals = found[found["k"] > 0].groupby(["k", "context"], as_index=False)["n"].sum()
    # a context is never more frequent than its suffix, so suffixes come first
    totals = totals.sort_values(["n", "k", "context"], ascending=[False, True, True]).head(room - 1)
    codes = [np.zeros(1, np.int64)]
    codes += [np.sort(totals.loc[totals["k"] == k, "context"].to_numpy(np.int64)) for k in range(1, order + 1)]
    first = np.cumsum([0, *map(len, codes)])
    p = np.zeros((first[-1], 256, n_lang), np.float32)
    p[0] = 1 / 256
    lower = np.zeros(1, np.int64)  # rows of the suffix contexts
    for k in range(order + 1):
        if k:
            lower = np.zeros(len(codes[k]), np.int64)
            for j in range(k):  # the longest suffix in the tree, which may be shorter than k - 1
                suffix = codes[k] & ((1 << 8 * j) - 1)
                at = np.searchsorted(codes[j], suffix)
                at = np.minimum(at, max(0, len(codes[j]) - 1))
                hit = (codes[j][at] == suffix) if len(codes[j]) else np.zeros(len(suffix), bool)
                lower[hit] = first[j] + at[hit]
        own = found[found["k"] == k]
        for i in range(n_lang):
            base = (p[lower, :, i] if k else np.full((1, 256), 1 / 256)).astype(np.float64)
            c = np.zeros_like(base)
            mine = own[own["lang"] == languages[i]] if languages else own
            at = np.searchsorted(codes[k], mine["context"].to_numpy(np.int64))
            at = np.minimum(at, max(0, len(codes[k]) - 1))
            hit = codes[k][at] == mine["context"].to_numpy(np.int64) if len(codes[k]) else np.zeros(len(mine), bool)
            c[at[hit], mine["symbol"].to_numpy()[hit]] = mine["n"].to_numpy()[hit]
            n, d = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
            unseen = np.where(c > 0, 0, base)
            rest = unseen.sum(axis=1, keepdims=True)
            escape = np.where(rest > 0, d / np.maximum(n + d, 1), 0)
            seen = np.where(rest > 0, c / np.maximum(n + d, 1), c / np.maximum(n, 1))
            mixed = seen + escape * unseen / np.where(rest > 0, rest, 1)
            p[first[k] : first[k + 1], :, i] = np.where(n > 0, mixed, base)
    return Trees(list(languages), order, codes, -np.log2(np.maximum(p, 1e-30)))


def code_lengths(trees: Trees, index: np.ndarray, column: pa.Array) -> np.ndarray:
    """Bits of each text under each language."""
    data, offsets = utf8(column)
    table = trees.bits.reshape(-1, trees.bits.shape[2])
    out = np.zeros((len(offsets) - 1, table.shape[1]))
    for a, b, lo, hi in blocks(offsets, 1 << 19):
        rows = index[context_codes(data, offsets, lo, hi, trees.order)].astype(np.int64)
        cost = np.take(table, rows << 8 | data[lo:hi], axis=0)
        full, sums = row_sums(cost, offsets, slice(a, b), lo)
        out[full] += sums
    return out


def predict(docs: DataFrame, trees: Trees, text: str = "text", names: tuple[str, str] = ("lang_pred", "score"), keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) with the language of the shortest code and its share of
    the languages' likelihoods (0 to 1, six decimals).

    Texts that are null or hold no letter, and all texts if nothing was learned, are ``und`` with
    score 0. Equal lengths go to the first language by name. Columns called like ``names`` are
    replaced. Whole texts count, in pieces of bounded size.
    """
    frozen = share(docs.sparkSession, trees)
    kept = [c for c in (keep or docs.columns) if c not in names]

    def run(batches):
        trees = shared(frozen)
        index = trees.index() if trees.languages else None
        for batch in batches:
            column = batch.column(len(kept))
            n = len(column)
            lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
            if trees.languages and n:
                bits = code_lengths(trees, index, column)
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)
                known = np.array([v.is_valid for v in column], bool) if column.null_count else np.ones(n, bool)
                lang[known] = np.array(trees.languages, object)[best][known]
                score[known] = np.round(share[known], 6)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], [*kept, *names]
            )

    lettered = F.when(F.col(text).rlike(r"\p{L}"), F.col(text))
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.select(*kept, lettered.alias("__text")).mapInArrow(run, schema)
