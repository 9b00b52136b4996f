"""Chat formatting with loss masks, by incremental black-box rendering.

A template is any function from messages to a string. Turn by turn the conversation's prefixes are
rendered; what a prefix adds to the one before is the turn's span. A template that changes what it
has already rendered is found by the same comparison and reported instead of masked wrongly.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Message = tuple[str, str]  # role, text
Template = Callable[[list[Message]], str]

# fixed values: control strings of the template
BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
_CONTROL = r"/?(?:s>|INST\]|ROLE[ \]])"
_RAW = re.compile(rf"([<\[])(\\*)({_CONTROL})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_CONTROL})")
_TURN = re.compile(
    r"<s>\[INST\] (?P<user>.*?) \[/INST\]|<s>\[ROLE (?P<role>[^\]]*)\] (?P<other>.*?) \[/ROLE\]| (?P<assistant>.*?) </s>",
    re.DOTALL,
)


def escape(text: str) -> str:
    """One backslash more after the first character of every control string, escaped or not."""
    return _RAW.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def instruct_template(messages: list[Message]) -> str:
    """``<s>[INST] user [/INST] assistant </s>``; other roles as ``<s>[ROLE name] text [/ROLE]``."""
    out = []
    for role, text in messages:
        if role == "user":
            out.append(f"{BEGIN}{OPEN} {escape(text)} {CLOSE}")
        elif role == "assistant":
            out.append(f" {escape(text)} {END}")
        else:
            out.append(f"{BEGIN}[ROLE {quote(role, safe='')}] {escape(text)} [/ROLE]")
    return "".join(out)


def parse_turns(formatted: str) -> list[Message]:
    """Roles and texts read back from what ``instruct_template`` wrote."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        kind = m.lastgroup
        role = unquote(m["role"]) if m["role"] is not None else kind
        text = next(m[k] for k in ("user", "other", "assistant") if m[k] is not None)
        turns.append((role, unescape(text)))
        at = m.end()
    return turns


@dataclass
class Rendered:
    text: str
    spans: list[tuple[int, int]]  # of each turn
    loss: list[tuple[int, int]]  # of the texts under the mask
    rewrites: int | None  # first turn that changed what was rendered before it


_PROBE = "\ue000"


def render(messages: list[Message], template: Template, learn: frozenset[str] = frozenset({"assistant"})) -> Rendered:
    """Render prefix by prefix. After a rewrite the spans and mask of earlier turns are void and
    left out; ``rewrites`` says so."""
    text, spans, loss, rewrites = template([]), [], [], None
    for k, (role, own) in enumerate(messages):
        now = template(messages[: k + 1])
        if not now.startswith(text):
            rewrites = k if rewrites is None else rewrites
            spans, loss = [], []
            text = now
            continue
        spans.append((len(text), len(now)))
        if role in learn:
            # the same turn with a one-character text shows what stands before and after the text
            probe = template([*messages[:k], (role, _PROBE)])
            before = probe.find(_PROBE, len(text))
            if before >= 0:
                loss.append((before, len(now) - (len(probe) - before - 1)))
        text = now
    return Rendered(text, spans, loss, rewrites)


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def format_chats(
    turns: DataFrame,
    template: Template = instruct_template,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``turn_spans``, ``loss_spans`` (code
    points, [start, end)) and ``rewrites_at`` (the first turn, from 0, that changed earlier
    output, else null).

    Turns are ordered by number (null first), then role and text, so ties have one order; repeated
    rows are turns of their own. Null roles and texts count as empty; rows with a null
    conversation form one conversation. Other columns are ignored. A conversation is one string
    in the end, so it is put together in one task; rows of different conversations are spread.
    """
    id_type = turns.schema[conv_id].dataType
    schema = T.StructType(
        [
            T.StructField("conv_id", id_type),
            T.StructField("formatted", T.StringType()),
            T.StructField("turn_spans", _SPAN),
            T.StructField("loss_spans", _SPAN),
            T.StructField("rewrites_at", T.LongType()),
        ]
    )
    rows = turns.groupBy(F.col(conv_id).alias("conv_id")).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col(turn).alias("turn"),
                    F.coalesce(F.col(role), F.lit("")).alias("role"),
                    F.coalesce(F.col(text), F.lit("")).alias("text"),
                )
            )
        ).alias("messages")
    )

    def run(batches):
        for batch in batches:
            made = [render([(m["role"], m["text"]) for m in x], template) for x in batch.column(1).to_pylist()]
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([r.text for r in made], pa.string()),
                    pa.array([_pairs(r.spans) for r in made], span),
                    pa.array([_pairs(r.loss) for r in made], span),
                    pa.array([r.rewrites for r in made], pa.int64()),
                ],
                schema.names,
            )

    return rows.mapInArrow(run, schema)


def _pairs(spans: list[tuple[int, int]]) -> list[dict]:
    return [{"start": a, "end": b} for a, b in spans]


def read_back(formatted: DataFrame, parse: Callable[[str], list[Message]] = parse_turns) -> DataFrame:
    """``conv_id``, ``n_chars``, ``turns`` (role, text) and ``learned`` (the unescaped text of each
    loss span), all taken from the output of ``format_chats`` alone."""
    schema = T.StructType(
        [
            formatted.schema["conv_id"],
            T.StructField("n_chars", T.LongType()),
            T.StructField("turns", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))),
            T.StructField("learned", T.ArrayType(T.StringType())),
        ]
    )

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            turns = [[{"role": r, "text": x} for r, x in parse(t)] for t in texts]
            learned = [[unescape(t[s["start"] : s["end"]]) for s in spans] for t, spans in zip(texts, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
                    pa.array(learned, pa.list_(pa.string())),
                ],
                schema.names,
            )

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, schema)
