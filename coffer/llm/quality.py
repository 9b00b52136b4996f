"""Quality classifier: interpolated modified Kneser-Ney n-gram model over bytes.

N-grams of all trusted texts are counted in the tasks and summed by n-gram. Lower orders count
distinct predecessors. Discounts come from the counts of counts of each language and order. Counts,
context totals and shorter n-grams are joined by n-gram or context, so the model is built sharded.
Documents are scored shard by shard of that model, in bounded pieces, and judged by their bits per
byte, and by how much these exceed those of a second model of texts labelled bad or toxic, against
quantiles of trusted texts the models have not seen.

N-grams are over bytes because their number follows the writing systems and not the vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coffer.llm.common import blocks, bucket_of, context_codes, cut, free_name, row_sums, share, shared, utf8

ORDER = 5
#: n-grams and contexts broadcast at once, 12 bytes each; a larger model takes several passes
ENTRIES_PER_SHARD = 4_000_000
#: trusted ids up to which the text table is filtered by a broadcast instead of a shuffled join
BROADCAST_IDS = 1_000_000
#: n-grams a counting task holds before it passes them on
_HELD = 4_000_000


def _mask(k: int) -> int:
    return (1 << 8 * k) - 1


def count_ngrams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, code, n) over (lang, text); a code holds ``order`` bytes, the last one lowest."""

    def run(batches):
        held: dict[str, list] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                codes, n = _merge(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "code", "n"]
                )
            held.clear()

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                data, offsets = utf8(batch.column(1).filter(pa.array(langs == lang)))
                for _, _, lo, hi in blocks(offsets, 1 << 22):
                    codes = context_codes(data, offsets, lo, hi, order - 1) << 8 | data[lo:hi]
                    held.setdefault(lang, []).append(np.unique(codes, return_counts=True))
                    size += len(held[lang][-1][0])
                    if len(held[lang]) > 8:
                        size -= sum(len(p[0]) for p in held[lang])
                        held[lang] = [_merge(held[lang])]
                        size += len(held[lang][0][0])
                    if size > _HELD:
                        yield from flush()
                        size = 0
        yield from flush()

    return texts.mapInArrow(run, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
    codes = np.concatenate([p[0] for p in parts])
    n = np.concatenate([p[1] for p in parts])
    codes, at = np.unique(codes, return_inverse=True)
    return codes, np.bincount(at, n, len(codes)).astype(np.int64)


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, k, code, bits) from the counts of the highest order.

    For k from 1 to ``order`` the bits of the last byte after the k - 1 before it, if that n-gram
    was seen; for k from -1 to -(order - 1) the bits of backing off from a context of -k bytes
    (code: the context) to a shorter one.
    """
    spark = counts.sparkSession
    level = cut(counts, "ngrams")
    levels = {order: level}
    for k in range(order - 1, 0, -1):
        level = level.groupBy("lang", F.col("code").bitwiseAND(_mask(k)).alias("code")).agg(F.count("*").alias("n"))
        levels[k] = level = cut(level, "ngrams")
    # discounts from the counts of counts: a few rows for each language and order
    frequent = None
    for k, level in levels.items():
        own = level.where("n <= 4").groupBy("lang", F.lit(k).alias("k")).pivot("n", [1, 2, 3, 4]).count()
        frequent = own if frequent is None else frequent.unionByName(own)
    n1, n2, n3, n4 = (F.coalesce(F.col(str(i)), F.lit(0)).cast("double") for i in (1, 2, 3, 4))
    y = F.try_divide(n1, n1 + 2 * n2)

    def discount(i, here, above):
        return F.greatest(F.lit(0.1 * i), F.least(F.lit(0.95 * i), F.coalesce(i - F.try_divide((i + 1) * y * above, here), F.lit(0.5 * i))))

    frequent = cut(
        frequent.select("lang", "k", discount(1, n1, n2).alias("d1"), discount(2, n2, n3).alias("d2"), discount(3, n3, n4).alias("d3")),
        "discounts",
    )
    out, lower = None, None
    for k in range(1, order + 1):
        own = frequent.where(F.col("k") == k).drop("k")
        level = levels[k].withColumn("context", F.shiftright("code", 8))
        totals = level.groupBy("lang", "context").agg(
            F.sum("n").alias("total"),
            F.count_if(F.col("n") == 1).alias("c1"),
            F.count_if(F.col("n") == 2).alias("c2"),
            F.count_if(F.col("n") >= 3).alias("c3"),
        )
        d = [F.coalesce(F.col(c), F.lit(x)) for c, x in (("d1", 0.5), ("d2", 1.0), ("d3", 1.5))]
        totals = totals.join(own, "lang", "left").select(
            "lang", "context", "total", *[x.alias(f"d{i}") for i, x in enumerate(d, 1)],
            ((d[0] * F.col("c1") + d[1] * F.col("c2") + d[2] * F.col("c3")) / F.col("total")).alias("gamma"),
        )
        totals = cut(totals, "contexts")
        cost = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        mine = level.join(totals, ["lang", "context"]).select(
            "lang", "code", ((F.col("n") - cost) / F.col("total")).alias("seen"), "gamma"
        )
        if lower is None:
            mine = mine.select("lang", "code", (F.col("seen") + F.col("gamma") / 256).alias("p"))
        else:
            mine = mine.withColumn("suffix", F.col("code").bitwiseAND(_mask(k - 1)))
            below = lower.select("lang", F.col("code").alias("suffix"), F.col("p").alias("below"))
            mine = mine.join(below, ["lang", "suffix"]).select(
                "lang", "code", (F.col("seen") + F.col("gamma") * F.col("below")).alias("p")
            )
        lower = cut(mine, "probabilities")
        parts = [lower.select("lang", F.lit(k).alias("k"), "code", (-F.log2("p")).cast("float").alias("bits"))]
        if k > 1:
            parts.append(totals.select("lang", F.lit(1 - k).alias("k"), F.col("context").alias("code"), (-F.log2("gamma")).cast("float").alias("bits")))
        else:
            # backing off from no context at all reaches the uniform distribution
            parts.append(totals.select("lang", F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("code"), (8 - F.log2("gamma")).cast("float").alias("bits")))
        for part in parts:
            out = part if out is None else out.unionByName(part)
    return cut(out, "model")


@dataclass
class Shard:
    """Part of the model: for each language the arrays of each k, and the bytes before the last
    one (by value) whose n-grams are in it."""

    order: int
    tables: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]]
    bytes_in: dict[str, np.ndarray]

    def bits(self, lang: str, codes: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each code; 0 where its n-grams are in another shard."""
        tables = self.tables[lang]
        cost = np.zeros(len(codes))
        todo = np.flatnonzero(self.bytes_in[lang][codes >> 8 & 255])
        for k in range(self.order, 0, -1):
            at, hit = _find(tables.get(k), codes[todo] & _mask(k))
            cost[todo[hit]] += at[hit]
            todo = todo[~hit]
            if not len(todo):
                break
            at, hit = _find(tables.get(1 - k), codes[todo] >> 8 & _mask(k - 1))
            cost[todo[hit]] += at[hit]
        return cost


def _find(table, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if table is None:
        return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    codes, bits = table
    at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    return bits[at], codes[at] == wanted


@dataclass
class Model:
    table: DataFrame
    order: int
    parts: list[list[tuple[str, int]]]  # (language, byte before the last one) in each shard

    def shards(self):
        """The shards, one after another; each is bounded by ``ENTRIES_PER_SHARD``."""
        by = _shard_byte()
        for part in self.parts:
            langs = sorted({lang for lang, _ in part})
            inside = F.lit(False)
            for lang in langs:
                own = [b for x, b in part if x == lang]
                inside = inside | ((F.col("lang") == lang) & (by.isin(own) | (F.col("k").between(0, 1))))
            rows = self.table.where(inside).toArrow()
            tables: dict = {}
            for lang in langs:
                mine, tables[lang] = rows.filter(pc.equal(rows["lang"], lang)), {}
                for k in pc.unique(mine["k"]).to_pylist():
                    own = mine.filter(pc.equal(mine["k"], k))
                    codes = own["code"].to_numpy()
                    at = np.argsort(codes)
                    tables[lang][k] = (codes[at], own["bits"].to_numpy()[at])
            flags = {lang: np.zeros(256, bool) for lang in langs}
            for lang, b in part:
                flags[lang][b] = True
            yield Shard(self.order, tables, flags)


def _shard_byte():
    """The byte before the last one of an n-gram, the last one of a context: an n-gram, what it
    backs off to and the contexts on that way share it."""
    return F.when(F.col("k") >= 1, F.shiftright("code", 8)).otherwise(F.col("code")).bitwiseAND(255)


def build(texts: DataFrame, order: int = ORDER) -> Model:
    """Model of (lang, text) rows; null texts and languages are left out."""
    known = texts.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    table = kneser_ney(count_ngrams(known, order), order)
    sizes = table.where("k not in (0, 1)").groupBy("lang", _shard_byte().alias("byte")).count().collect()
    sizes = {(r["lang"], r["byte"]): r["count"] for r in sizes}
    parts: list[list] = []
    room = 0
    for lang in sorted({x for x, _ in sizes}):
        for byte in range(256):  # bytes never seen before the last one back off to the unigrams
            n = sizes.get((lang, byte), 0)
            if not parts or (n > room):
                parts.append([])
                room = ENTRIES_PER_SHARD
            parts[-1].append((lang, byte))
            room -= n
    return Model(table, order, parts)


def score(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang", names: tuple[str, str] = ("n_bytes", "bits"), keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) with the bytes of each text and its code length in bits.

    Null and empty texts have 0 bytes; languages without a model (null too) have null bits.
    Shards of the model follow each other over the documents. Columns called like ``names`` are
    replaced.
    """
    spark = docs.sparkSession
    keep = [c for c in (keep or docs.columns) if c not in names]
    out = docs.drop(*names)
    parts = model.parts or [[]]
    for i, shard in enumerate(model.shards() if model.parts else [Shard(model.order, {}, {})]):
        last = i == len(parts) - 1
        carried = [c for c in out.columns if c not in names and (not last or c in keep)]
        out = _score(out, share(spark, shard), text, lang, names, carried)
        if not last:
            out = cut(out, "scores")
    return out


def _scorer(had: bool, part, text: str, lang: str, names: tuple[str, str], carried: list[str]):
    """Record batches to those of ``carried`` and ``names``; ``had``: bits are added to."""

    def run(batches):
        shard = shared(part)
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            langs = np.array(column(lang).to_pylist(), object)
            whole, offsets = utf8(column(text))
            bits = np.full(len(langs), np.nan)
            if had:
                bits = column(names[1]).to_numpy(zero_copy_only=False).copy()
            for own in set(langs) & set(shard.tables):
                rows = np.flatnonzero(langs == own)
                data, mine = utf8(column(text).take(pa.array(rows)))
                sums = np.zeros(len(rows))
                for a, b, lo, hi in blocks(mine, 1 << 20):
                    codes = context_codes(data, mine, lo, hi, shard.order - 1) << 8 | data[lo:hi]
                    codes, at = np.unique(codes, return_inverse=True)
                    full, cost = row_sums(shard.bits(own, codes)[at], mine, slice(a, b), lo)
                    sums[full] += cost
                bits[rows] = np.nan_to_num(bits[rows]) + sums
            sizes = np.diff(offsets)
            yield pa.RecordBatch.from_arrays(
                [*(column(c) for c in carried), pa.array(sizes), pa.array(bits, pa.float64(), mask=np.isnan(bits))],
                [*carried, *names],
            )

    return run


def _score(docs: DataFrame, part, text: str, lang: str, names: tuple[str, str], carried: list[str]) -> DataFrame:
    run = _scorer(names[1] in docs.columns, part, text, lang, names, carried)
    schema = T.StructType(
        [*(docs.schema[c] for c in carried), T.StructField(names[0], T.LongType()), T.StructField(names[1], T.DoubleType())]
    )
    return docs.mapInArrow(run, schema)


def trusted_ids(labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """Ids all of whose labels say good quality and not toxic (null: not said)."""
    return (
        labels.where(F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("id"))
        .agg(F.min(quality).alias("q"), F.max(F.coalesce(F.col(toxic), F.lit(0))).alias("t"))
        .where("q = 1 and t = 0")
        .select("id")
    )


def bad_ids(labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """Ids any of whose labels says bad quality or toxic."""
    bad = (F.col(quality) == 0) | (F.col(toxic) == 1)
    return labels.where(F.col(doc_id).isNotNull() & bad).select(F.col(doc_id).alias("id")).distinct()


def trusted_texts(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(id, lang, text) of documents with one of the ids."""
    ids = cut(ids, "trusted")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    small = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if small else ids, "id", "left_semi")


_MADE = ("n_bytes", "bits", "bits_per_byte", "perplexity", "most", "bad_bytes", "bad_bits", "excess", "most_excess", "accepted")

#: bytes at which length classes end; the shorter a text, the more its rates vary
LENGTHS = (64, 256, 1024)
#: held-out texts of a length class below which a quantile of 0.99 cannot be told
FEW = 100
#: bad texts of a language from which the second model learns it; of fewer it mostly knows those
BAD_TEXTS = 20


def _length_class():
    out = F.lit(len(LENGTHS))
    for i in reversed(range(len(LENGTHS))):
        out = F.when(F.col("n_bytes") < LENGTHS[i], F.lit(i)).otherwise(out)
    return out


def _limit(held: DataFrame, lang: str, value, quantile: float):
    """The limit of ``value`` for a row by its language and length class, from ``held`` (lang,
    n_bytes and what ``value`` needs): the language's median plus the class's quantile of the
    distances from the medians. Classes of few texts get twice that; no class less than a longer
    one. Null for a language that is not held."""
    rows = held.select("lang", _length_class().alias("class"), value.alias("value")).where("value is not null")
    medians = {r["lang"]: r["m"] for r in rows.groupBy("lang").agg(F.percentile_approx("value", 0.5, 10_000).alias("m")).collect()}

    def middle(column):
        out = F.lit(None).cast("double")
        for own, m in medians.items():  # one for each language
            out = F.when(F.col(column) == own, m).otherwise(out)
        return out

    apart = F.percentile_approx(F.col("value") - middle("lang"), quantile, 10_000)
    found = {r["class"]: r for r in rows.groupBy("class").agg(apart.alias("q"), F.count("*").alias("n")).collect()}
    own = {c: r["q"] * (2 if r["n"] < FEW and r["q"] > 0 else 1) for c, r in found.items()}
    limit = F.lit(None).cast("double")
    for c in range(len(LENGTHS) + 1):
        longer = [q for k, q in own.items() if k >= c] or list(own.values())
        if longer:
            limit = F.when(_length_class() == c, max(longer)).otherwise(limit)
    return middle(lang) + limit


def judge(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    order: int = ORDER,
    quantile: float = 0.99,
    keep: list[str] | None = None,
) -> DataFrame:
    """``keep`` (default: all columns) with ``n_bytes``, ``bits_per_byte``, ``perplexity``,
    ``most``, ``excess``, ``most_excess`` and ``accepted``.

    One model is trained on four fifths of the trusted texts (by id), a second on four fifths of
    those labelled bad or toxic, in languages with at least ``BAD_TEXTS`` of them. ``excess`` is the bits per byte under the first less those under
    the second. A text is rejected if its bits per byte are above ``most`` or its excess above
    ``most_excess``: the ``quantile`` of trusted texts neither model has seen, by language and
    length class (see ``_limit``). Texts without bytes, languages without a model or limit and
    null languages are accepted, as nothing speaks against them; without a second model (of
    the language) only the first limit counts. Repeated rows are judged alike; with an empty label
    table all is accepted. Cheap texts are not rejected for being cheap: trusted texts of the
    model's own training are cheap as well.
    """
    keep = [c for c in (keep or docs.columns) if c not in _MADE]
    held_out = F.coalesce(bucket_of(F.col("id"), 5) == 0, F.lit(False))
    texts = trusted_texts(docs, trusted_ids(labels), doc_id, text, lang)
    bad_texts = trusted_texts(docs, bad_ids(labels), doc_id, text, lang)
    enough = bad_texts.where(~held_out).groupBy("lang").count().where(F.col("count") >= BAD_TEXTS)
    bad_texts = bad_texts.where(F.col("lang").isin([r["lang"] for r in enough.collect()]))
    models = [build(t.where(~held_out).select("lang", "text"), order) for t in (texts, bad_texts)]

    def both(rows, text, lang, keep):
        need = [*keep, *(c for c in (text, lang) if c not in keep)]
        if all(len(m.parts) <= 1 for m in models):  # one pass of one Python worker for both
            parts = [share(rows.sparkSession, next(m.shards(), Shard(order, {}, {}))) for m in models]
            first = _scorer(False, parts[0], text, lang, ("n_bytes", "bits"), need)
            carried = [*keep, *(c for c in [lang] if c not in keep), "n_bytes", "bits"]
            second = _scorer(False, parts[1], text, lang, ("bad_bytes", "bad_bits"), carried)
            made = {"n_bytes": T.LongType(), "bits": T.DoubleType(), "bad_bytes": T.LongType(), "bad_bits": T.DoubleType()}
            schema = T.StructType([*(rows.schema[c] for c in carried if c not in made), *(T.StructField(*x) for x in made.items())])
            return rows.select(*need).mapInArrow(lambda batches: second(first(batches)), schema)
        rows = score(rows, models[0], text, lang, keep=need)
        return score(rows, models[1], text, lang, ("bad_bytes", "bad_bits"), keep=[*keep, *(c for c in [lang] if c not in keep), "n_bytes", "bits"])

    rate = F.round(F.try_divide(F.col("bits"), F.col("n_bytes").cast("double")), 6)
    excess = F.round(F.try_divide(F.col("bits") - F.col("bad_bits"), F.col("n_bytes").cast("double")), 6)
    held = cut(both(texts.where(held_out), "text", "lang", ["lang"]).where("n_bytes > 0 and bits is not null"), "held")
    most, most_excess = (_limit(held, lang, x, quantile) for x in (rate, excess))
    scored = both(docs, text, lang, keep).withColumn("bits_per_byte", rate).withColumn("excess", excess)
    scored = scored.withColumn("most", F.round(most, 6)).withColumn("most_excess", F.round(most_excess, 6))
    within = [F.coalesce(F.col(x) <= F.col(y), F.lit(True)) for x, y in (("bits_per_byte", "most"), ("excess", "most_excess"))]
    out = scored.withColumn("accepted", within[0] & within[1])
    out = out.withColumn("perplexity", F.round(F.pow(F.lit(2.0), F.col("bits_per_byte")), 6))
    return out.select(*keep, "n_bytes", "bits_per_byte", "perplexity", "most", "excess", "most_excess", "accepted")


def accepted_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that ``judge`` accepts, with their own columns."""
    aside = {c: free_name(docs, f"_{c}") for c in docs.columns if c in _MADE}
    own = docs.withColumnsRenamed(aside)
    judged = judge(own, labels, keep=own.columns, **options).where("accepted")
    return judged.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])
