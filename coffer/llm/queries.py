"""The operators over the test tables with production parameters, and SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.llm import (
    bpe,
    chat,
    decontaminate,
    histogram_shards,
    language_id,
    lexical_search,
    quality,
    quality_rules,
    secret_scan,
    simhash,
    spherical_caps,
    url_filters,
    whitening,
)
from coffer.llm.common import bucket_of, cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

SHARDS = 40
RULES = [
    url_filters.Rule("allow", "com/"),
    url_filters.Rule("block", "example.com/en/"),
    url_filters.Rule("allow", "www.example.com/en/"),
    url_filters.Rule("block", "net/es/"),
    url_filters.Rule("block", "net/fr/"),
]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_language_id(spark, sf):
    """Language of every document, learned from the two thirds that are not held out."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(bucket_of(F.col("doc_id"), 3) == 1, F.lit(False))
    trees = language_id.fit(docs.where(~held_out & F.col("doc_id").isNotNull()))
    docs = docs.select("doc_id", held_out.alias("held_out"), "text")
    return language_id.predict(docs, trees, keep=["doc_id", "held_out"])


@query
def op2_url_filters(spark, sf):
    """Every page's url judged by the rules, else by its host's path templates."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    judged = url_filters.judge_urls(pages, RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


@query
def op3_byte_bpe(spark, sf):
    """Every document encoded by the public ranks and decoded again."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id"])
    return encoded.select(
        "doc_id",
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.sha2(bpe.ids_text("tokens"), 256).alias("ids_sha256"),
        F.sha2(bpe.decode("tokens", ranks), 256).alias("decoded_sha256"),
    )


@query
def op4_chat_format(spark, sf):
    """All conversations and one that holds control strings, formatted and read back."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(tricky).alias("text"),
    )
    back = chat.read_back(chat.format_chats(turns.unionByName(extra)))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned = F.array_join("learned", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.char_length(learned).cast("bigint").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.col("n_chars").alias("formatted_chars"),
    )


ORACLE["op4_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), shown AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]|ROLE[ \]]))', '\1\2\\\3', 'g') AS safe FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(safe) + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 ELSE 19 + length(role) END) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""


@query
def op5_decontaminate(spark, sf):
    """Words of every document that lie in a window of ten words of a benchmark item."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    items = table(spark, sf, "benchmark").select("item_id", "text")
    found = decontaminate.find_contamination(docs, items, keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLE["op5_decontaminate"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(ws), 10) AS size, array_to_string(ws[i:i + 9], ' ') AS win
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), starts AS (
  SELECT r, size, i, array_to_string(ws[i:i + size - 1], ' ') AS win
  FROM (SELECT r, ws, size, unnest(range(1, len(ws) - size + 2)) AS i
        FROM d, (SELECT DISTINCT size FROM windows))
), hits AS (SELECT r, i, windows.size, item FROM starts JOIN windows USING (win)),
words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


@query
def op6_kneser_ney(spark, sf):
    """Bits per byte and perplexity of every document under the trusted texts' model."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return quality.judge(docs, table(spark, sf, "labels"), keep=["doc_id", "lang"])


@query
def op7_simhash(spark, sf):
    """Fingerprint of every document and the group it reaches over two bits."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    prints = cut(simhash.fingerprints(docs), "fingerprints")
    grouped = simhash.groups(prints)
    return grouped.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@query
def op8_histogram_shards(spark, sf):
    """Every document's shard of 40 near equal ones and its place there."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    size = histogram_shards.text_size("text")
    spread = histogram_shards.shard(docs, SHARDS, size, F.col("text"), F.col("doc_id"))
    return spread.select(
        "doc_id",
        size.alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op9_secret_scan(spark, sf):
    """Secrets in every document: the base kinds and what the network adds."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    net = secret_scan.fit(docs)
    found = secret_scan.find_secrets(docs, net, keep=["doc_id"])
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"] != "model")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(secret_scan.span_text(base), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("secrets")).alias("spans"),
    )


@query
def op10_spherical_caps(spark, sf):
    """Links of every vector at cosine 0.9 and the group it reaches."""
    return spherical_caps.link_vectors(table(spark, sf, "embeddings").select("vec_id", "embedding"))


@query
def op11_lexical_search(spark, sf):
    """The ten best documents for every benchmark item."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return lexical_search.rank_documents(docs, table(spark, sf, "benchmark").select("item_id", "text"))


ORACLE["op11_lexical_search"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT row_number() OVER () AS item, * FROM (SELECT DISTINCT item_id, text FROM benchmark)),
t AS (SELECT DISTINCT item, unnest({_WORDS}) AS term FROM i),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) GROUP BY r, term),
counts AS (SELECT count(*) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM d WHERE len(ws) > 0),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM df, counts),
lengths AS (SELECT r, doc_id, 100 - 90 + ((90 * len(ws) * n_docs) // n_terms) AS m FROM d, counts WHERE len(ws) > 0),
scores AS (
  SELECT item, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM t JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (r) GROUP BY item, r, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN i USING (item) WHERE rank <= 10
"""


@query
def op12_whitening(spark, sf):
    """Every vector on the four first components of all distinct vectors, whitened."""
    found = whitening.whiten(table(spark, sf, "embeddings").select("vec_id", "embedding"))
    return found.withColumn("deviation", F.col("deviation").try_cast("bigint"))


@query
def op13_quality_rules(spark, sf):
    """The rules' ledger of every document, and what the present policy makes of it."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    entries = cut(quality_rules.ledger(docs, keep=["doc_id"]), "rule-ledger")
    judged = quality_rules.apply_policy(entries)
    return judged.select("doc_id", *quality_rules.MEASURES, "failed", "policy", quality_rules.fails(quality_rules.BASE).alias("base_failed"), "kept")


_RULE_BITS = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in quality_rules.RULES)
_BASE_BITS = quality_rules.mask_of(quality_rules.BASE)
ORACLE["op13_quality_rules"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
    count(*) FILTER (regexp_matches(line, '^[\x20\x09-\x0D]*[-*\x{{2022}}]')) AS n_bullet_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), windows AS (SELECT r, i, array_to_string(ws[i:i + 2], ' ') AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM again) GROUP BY r),
m AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    len(regexp_extract_all(array_to_string(ws, ' '), '[^ ]*[A-Za-z\x{{80}}-\x{{10FFFF}}][^ ]*')) AS n_alpha_words,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_bullet_lines, 0) AS n_bullet_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM d LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)
), failed AS (SELECT *, CAST({_RULE_BITS} AS BIGINT) AS failed FROM m)
SELECT *, {quality_rules.POLICY.version} AS policy, failed & {_BASE_BITS} <> 0 AS base_failed, failed = 0 AS kept FROM failed
"""
