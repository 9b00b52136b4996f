"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document: the ledger keeps the measurements and one bit for each
failed rule. Policies are versioned sets of rules; they only read the bits, so a new version needs
no second pass over the texts, and ablations are counts over the few distinct masks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coffer.llm.common import slices, texts

#: counted in a text, all of them bigint
MEASURES = (
    "n_words",  # runs of characters other than space and \t to \r
    "word_chars",  # code points in words
    "n_alpha_words",  # words with an ASCII letter or any non-ASCII character
    "n_symbols",  # characters of #*$%&|<>
    "n_lines",  # lines with a word
    "n_dup_lines",  # of them, those equal to an earlier one
    "n_bullet_lines",  # of them, those that begin with -, * or a bullet
    "n_repeat_words",  # words in 3-word windows that occur twice or more
)


@dataclass(frozen=True)
class Rule:
    """``fails`` is an SQL condition over the measures. The bit is the rule's for good: a ledger
    outlives the policies, so a rule that changes gets a new name and a new bit."""

    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """Keeps the documents that fail at most ``allowed`` of the named rules."""

    version: int
    rules: tuple[str, ...]
    allowed: int = 0


RULES = (
    Rule(0, "few words", "n_words < 50"),
    Rule(1, "repeated words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "short words", "word_chars < 3 * n_words"),
    Rule(3, "long words", "word_chars > 10 * n_words"),
    Rule(4, "symbols", "10 * n_symbols > n_words"),
    Rule(5, "repeated lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(6, "few letters", "100 * n_alpha_words < 80 * n_words"),
    Rule(7, "bullet list", "100 * n_bullet_lines > 90 * n_lines"),
)
BASE = Policy(1, ("few words", "repeated words"))
POLICY = Policy(2, tuple(r.name for r in RULES))

_SPACE = b" \t\n\x0b\x0c\r"
_NOT_COUNTED = _SPACE + bytes(range(0x80, 0xC0))  # space, and bytes that begin no character
_SYMBOLS = b"#*$%&|<>"
_BULLETS = (b"-", b"*", "•".encode())
_NOT_ALPHA = bytes(b for b in range(128) if not chr(b).isalpha())


def _repeated(ws: list[bytes]) -> int:
    """Words covered by 3-word windows that occur more than once."""
    if len(ws) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in ws), np.int64, len(ws))
    pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]  # small again, so that no product overflows
    _, at, n = np.unique(pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    again = n[at] > 1
    covered = np.zeros(len(ws), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def measure(raw: bytes) -> tuple[int, ...]:
    """The MEASURES of one UTF-8 text."""
    ws = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        len(ws),
        len(raw.translate(None, _NOT_COUNTED)),
        sum(1 for w in ws if w.translate(None, _NOT_ALPHA)),
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        sum(1 for line in lines if line.lstrip().startswith(_BULLETS)),
        _repeated(ws),
    )


def ledger(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns of ``docs``), the MEASURES and ``failed``, a bigint with the
    bits of the rules that the text fails.

    Columns of ``docs`` with these names are replaced. A null text is measured as an empty one:
    all counts are zero. A rule whose condition is null does not fail. Repeated rows are entries
    of their own; an empty table gives an empty ledger.
    """
    if len({r.bit for r in rules}) < len(rules) or len({r.name for r in rules}) < len(rules) or not all(0 <= r.bit < 63 for r in rules):
        raise ValueError("rules need different names and different bits from 0 to 62")
    new = {*MEASURES, "failed"}
    kept = [c for c in (keep or docs.columns) if c.lower() not in new]
    at = len(kept)

    def run(batches):
        for batch in slices(batches, at):
            rows = [measure(raw) for raw in texts(batch.column(at))]
            counts = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *counts], [*kept, *MEASURES])

    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(m, T.LongType()) for m in MEASURES)])
    measured = docs.select(*kept, F.col(text).alias("__text")).mapInArrow(run, schema)
    bits = F.lit(0).cast("bigint")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("bigint"))
    return measured.withColumn("failed", bits)


def mask_of(policy: Policy, rules: Sequence[Rule] = RULES) -> int:
    known = {r.name: r.bit for r in rules}
    if missing := set(policy.rules) - set(known):
        raise ValueError(f"policy {policy.version} names unknown rules: {sorted(missing)}")
    return sum(1 << known[name] for name in set(policy.rules))


def _counted(mask: int) -> Column:
    """Number of failed rules among those of a mask."""
    return F.bit_count(F.col("failed").bitwiseAND(F.lit(mask).cast("bigint")))


def fails(policy: Policy, rules: Sequence[Rule] = RULES) -> Column:
    """Whether a ledger entry fails a policy. An entry without bits (null) fails."""
    return F.coalesce(_counted(mask_of(policy, rules)) > policy.allowed, F.lit(True))


def apply_policy(entries: DataFrame, policy: Policy = POLICY, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger with ``policy`` (the version) and ``kept``; columns of these names are replaced."""
    return entries.withColumns({"policy": F.lit(policy.version), "kept": ~fails(policy, rules)})


def _masks(entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Entries per distinct mask (a null one counts as all rules failed): as many rows as rules
    occur together, combined in the tasks before the exchange."""
    failed = F.coalesce("failed", F.lit((1 << 63) - 1).cast("bigint"))
    return entries.groupBy(*by, failed.alias("failed")).agg(F.count("*").alias("n"))


def ablations(entries: DataFrame, policy: Policy = POLICY, rules: Sequence[Rule] = RULES, by: Sequence[str] = ()) -> DataFrame:
    """What each rule of a policy does: one row per rule (and group ``by``, nulls a group).

    ``n``: entries; ``n_kept``: kept by the policy; ``n_failed``: that fail the rule; ``n_only``:
    that fail no other rule of the policy; ``n_kept_without``: kept by the policy without the
    rule. Made of the distinct masks alone; no documents, no rows without ``by``.
    """
    mask, own = mask_of(policy, rules), [r for r in rules if r.name in policy.rules]
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")
    each = F.array(*[
        F.struct(
            F.lit(r.name).alias("rule"),
            total(F.col("failed").bitwiseAND(F.lit(1 << r.bit).cast("bigint")) != 0).alias("n_failed"),
            total(F.col("failed").bitwiseAND(F.lit(mask).cast("bigint")) == (1 << r.bit)).alias("n_only"),
            total(_counted(mask & ~(1 << r.bit)) <= policy.allowed).alias("n_kept_without"),
        )
        for r in own
    ])
    counts = _masks(entries, by).groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"), total(_counted(mask) <= policy.allowed).alias("n_kept"), each.alias("_each")
    )
    return counts.select("*", F.inline("_each")).drop("_each").select(*by, "rule", "n", "n_kept", "n_failed", "n_only", "n_kept_without")


def compare_policies(entries: DataFrame, before: Policy, after: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Entries by what two versions of a policy make of them: kept_before, kept_after, n."""
    kept = [(~fails(p, rules)).alias(name) for p, name in ((before, "kept_before"), (after, "kept_after"))]
    return _masks(entries).select(*kept, "n").groupBy("kept_before", "kept_after").agg(F.sum("n").alias("n"))


def profile(entries: DataFrame, by: Sequence[str], rules: Sequence[Rule] = RULES) -> DataFrame:
    """For each group the rules that any of its entries fails, and those that all of them fail, as
    names in the order of their bits. The masks are folded by bitwise aggregates."""
    names = lambda bits: F.filter(
        F.array(*[F.when(bits.bitwiseAND(F.lit(1 << r.bit).cast("bigint")) != 0, F.lit(r.name)) for r in sorted(rules, key=lambda r: r.bit)]),
        lambda name: name.isNotNull(),
    )
    folded = _masks(entries, by).groupBy(*by).agg(F.sum("n").alias("n"), F.bit_or("failed").alias("_any"), F.bit_and("failed").alias("_all"))
    return folded.select(*by, "n", names(F.col("_any")).alias("failed_by_any"), names(F.col("_all")).alias("failed_by_all"))
