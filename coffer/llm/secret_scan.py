"""Secret scans: base patterns plus a character convolutional network over every candidate.

Candidates are all runs of 16 and more key characters. The network sees a candidate with the
characters around it, is trained on findings of the base patterns (positive) against other
candidates (negative), calibrated on held-out findings and thresholded so that the wanted share of
held-out findings passes. What passes is added to the base spans; base spans always stay.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coffer.llm.common import cut, share, shared

# fixed values: kinds in their order, and the patterns of the base kinds
KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

#: shape of the network's input: characters before, of (in steps of that many) and after a candidate
BEFORE, INSIDE, AFTER = 24, 40, 8
WIDTH, FILTERS, CLASSES = 5, 24, 98
#: points of a logit's grid in one unit, and where it ends
GRID, FAR = 256, 128
#: views of a shard in training, and the most shards; beyond, shards grow
SHARD, SHARDS = 4096, 64


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each base kind that are long enough."""
    lowered = text.lower()  # only to skip texts without a keyword
    found = []
    if any(k in lowered for k in _KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CANDIDATE.finditer(text)]


def _meets(spans: list[tuple[int, int]], others: list[tuple[str, int, int]]) -> list[bool]:
    """Whether each span overlaps one of the others; linear after sorting."""
    edges = sorted((a, b) for _, a, b in others)
    reach, out, i, far = 0, [], 0, -1
    for a, b in spans:  # in order and without overlap
        while i < len(edges) and edges[i][0] < b:
            far = max(far, edges[i][1])
            i += 1
        out.append(far > a)
    return out


def windows(text: str, span: tuple[int, int]) -> list[str]:
    """The network's views of a candidate: one for every INSIDE characters, NUL beyond the text.
    The candidate's part begins at BEFORE and is padded with 0x01."""
    views = []
    for at in range(span[0], span[1], INSIDE):
        own = text[at : min(at + INSIDE, span[1])]
        before = text[max(0, at - BEFORE) : at].rjust(BEFORE, "\0")
        after = text[span[1] : span[1] + AFTER].ljust(AFTER, "\0")
        views.append(before + own.ljust(INSIDE, "\1") + after)
    return views


def encode_views(views: list[str]) -> np.ndarray:
    """Character classes: 0 beyond the text, 1 padding or other white space, 2-96 ASCII, 97 rest."""
    codes = np.array(views, dtype=f"<U{BEFORE + INSIDE + AFTER}").view(np.uint32).reshape(len(views), -1)
    out = np.where((codes >= 32) & (codes < 127), codes - 30, 97)
    out[(codes > 0) & (codes < 32)] = 1
    out[codes == 0] = 0
    return out.astype(np.int64)


@dataclass
class Network:
    """Convolution over one-hot characters and position in the window's three parts, maximum over
    positions, logistic output, and Platt scaling."""

    kernel: np.ndarray  # WIDTH x CLASSES x 3 x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = np.inf  # of the logit

    @staticmethod
    def parts() -> np.ndarray:
        return np.repeat([0, 1, 2], [BEFORE, INSIDE, AFTER])

    def _pool(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = x * 3 + self.parts()
        kernel = self.kernel.reshape(WIDTH, CLASSES * 3, FILTERS)
        n = x.shape[1] - WIDTH + 1
        hidden = sum(np.take(kernel[k], rows[:, k : k + n], axis=0) for k in range(WIDTH)) + self.bias
        at = hidden.argmax(axis=1)
        return np.maximum(np.take_along_axis(hidden, at[:, None, :], axis=1)[:, 0, :], 0), at

    def logit(self, x: np.ndarray) -> np.ndarray:
        """On a grid, so that equal logits can be counted."""
        z = np.concatenate(
            [self._pool(x[i : i + 1024])[0] @ self.out + self.out_bias for i in range(0, len(x), 1024)] or [np.zeros(0)]
        )
        return np.round(np.clip(z, -FAR, FAR).astype(np.float64) * GRID) / GRID

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) * self.scale + self.shift, -30, 30)))


@dataclass
class Fitting:
    """A network in training: its parameters, Adam's moments of them, and the steps taken."""

    params: list  # kernel, bias, out, out_bias
    first: list
    second: list
    steps: int = 0

    @staticmethod
    def start(seed: int = 7) -> Fitting:
        rng = np.random.default_rng(seed)
        params = [
            rng.normal(0, 0.1, (WIDTH, CLASSES, 3, FILTERS)).astype(np.float32),
            np.zeros(FILTERS, np.float32),
            rng.normal(0, 0.3, FILTERS).astype(np.float32),
            np.zeros(1, np.float32),
        ]
        return Fitting(params, [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params])

    def copy(self) -> Fitting:
        """Steps replace arrays and never change them."""
        return Fitting([*self.params], [*self.first], [*self.second], self.steps)

    def network(self) -> Network:
        return Network(*self.params[:3], float(self.params[3][0]))

    def step(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """One step of Adam on the weighted logistic loss; gradients pass through the pooled maxima."""
        net = self.network()
        pooled, at = net._pool(x)
        p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.out_bias, -30, 30)))
        error = ((p - y) * weight / len(y)).astype(np.float32)
        back = error[:, None] * net.out[None, :] * (pooled > 0)
        grad = np.zeros_like(net.kernel)
        f = np.broadcast_to(np.arange(FILTERS), at.shape)
        for k in range(WIDTH):
            chars = np.take_along_axis(x, at + k, axis=1)
            np.add.at(grad[k], (chars, net.parts()[at + k], f), back)
        self.steps += 1
        for j, g in enumerate([grad, back.sum(axis=0), pooled.T @ error, error.sum(keepdims=True)]):
            self.first[j] = 0.9 * self.first[j] + 0.1 * g
            self.second[j] = 0.999 * self.second[j] + 0.001 * g * g
            rate = np.sqrt(self.second[j] / (1 - 0.999**self.steps)) + 1e-8
            self.params[j] = (self.params[j] - 0.01 * (self.first[j] / (1 - 0.9**self.steps)) / rate).astype(np.float32)

    @staticmethod
    def mean(parts: list[tuple[Fitting, int]]) -> Fitting:
        """Parameters and moments averaged by the rows that each part has seen."""
        total = sum(n for _, n in parts)
        over = lambda of: [sum(v * (n / total) for v, n in zip(vs, [n for _, n in parts])).astype(np.float32) for vs in zip(*map(of, [f for f, _ in parts]))]
        return Fitting(over(lambda f: f.params), over(lambda f: f.first), over(lambda f: f.second), max(f.steps for f, _ in parts))


def train(views: DataFrame, counts: dict[int, int], epochs: int = 12) -> Network:
    """Logistic loss with balanced classes, Adam, over all ``views`` (h, view, label) in every epoch.

    The views lie in shards by hash, of about ``SHARD`` rows each while there are fewer than
    ``SHARDS``. In an epoch each shard is streamed through steps of its own from the common
    network, and the outcomes are averaged: a task holds a few rows and one network, the driver
    one network for each shard. Shards and their order depend on the views alone.
    """
    total = sum(counts.values())
    shards = min(SHARDS, -(-total // SHARD))
    balance = np.array([0.5 * total / counts[0], 0.5 * total / counts[1]])
    shard = F.pmod(F.shiftright("h", 2), F.lit(shards)).cast("int")
    placed = views.withColumn("shard", shard).repartitionById(shards, F.col("shard"))
    placed = placed.sortWithinPartitions("h", "view", "label").select("shard", "view", "label").persist()

    def run(batches, epoch, current):
        fitting, seen, own, rng = shared(current).copy(), 0, None, None
        views, labels = [], []

        def take(n):
            nonlocal seen
            x, y = encode_views(views[:n]), np.array(labels[:n], np.float64)
            order = rng.permutation(n)
            for i in range(0, n, 64):
                at = order[i : i + 64]
                fitting.step(x[at], y[at], balance[y[at].astype(int)])
            seen += n
            del views[:n], labels[:n]

        for batch in batches:
            if batch.num_rows:
                own = batch.column(0)[0].as_py()
                rng = rng or np.random.default_rng([epoch, own])
                views += batch.column(1).to_pylist()
                labels += batch.column(2).to_pylist()
            while len(views) >= SHARD:
                take(SHARD)
        if views:
            take(len(views))
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([own], pa.int32()), pa.array([seen], pa.int64()), pa.array([pickle.dumps(vars(fitting))], pa.binary())],
                ["shard", "seen", "fitting"],
            )

    fitting = Fitting.start()
    for epoch in range(epochs):
        current = share(views.sparkSession, fitting)
        job = placed.mapInArrow(lambda batches, e=epoch, c=current: run(batches, e, c), "shard int, seen long, fitting binary")
        rows = sorted(job.collect(), key=lambda r: r["shard"])  # one network each
        fitting = Fitting.mean([(Fitting(**pickle.loads(r["fitting"])), r["seen"]) for r in rows])
        current.unpersist()
    placed.unpersist()
    return fitting.network()


def calibrate(net: Network, views: DataFrame, recall: float) -> Network:
    """Platt scaling on all held-out ``views`` (view, label), then the threshold that ``recall`` of
    all held-out findings pass: of those with the same outcome on the held-out views, the middle
    one, halfway from the last finding that has to pass to the next view below.

    Logits lie on a grid, so the rows are counted by Spark per point of it and nothing is lost:
    the driver holds the counts, however many rows there are.
    """

    def run(batches):
        for batch in batches:
            cells = np.round(net.logit(encode_views(batch.column(0).to_pylist())) * GRID).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cells), batch.column(1)], ["cell", "label"])

    cells = views.select("view", "label").mapInArrow(run, "cell int, label int")
    rows = cells.groupBy("cell", "label").agg(F.count("*").alias("n")).orderBy("cell", "label").collect()
    z, y, n = (np.array([r[c] for r in rows], np.float64) for c in ("cell", "label", "n"))
    z /= GRID
    found, others = n[y == 1].sum(), n[y == 0].sum()
    target = np.where(y == 1, (found + 1) / (found + 2), 1 / (others + 2))
    loss = lambda a, b: (n * (np.logaddexp(0, a * z + b) - target * (a * z + b))).sum()
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a two-parameter logistic fit, halved until they gain
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = n * (p * (1 - p) + 1e-6)
        g = np.array([(n * (p - target) * z).sum(), (n * (p - target)).sum()])
        h = np.array([[(w * z * z).sum(), (w * z).sum()], [(w * z).sum(), w.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        while np.abs(step).max() >= 1e-6 and loss(a - step[0], b - step[1]) > loss(a, b):
            step /= 2
        if np.abs(step).max() < 1e-6:
            break
        a, b = a - step[0], b - step[1]
    net.scale, net.shift = float(max(a, 1e-3)), float(b)
    passed = np.cumsum(n[y == 1])
    if len(passed):
        last = z[y == 1][np.searchsorted(passed, int((1 - recall) * found), "right")]
        below = z[z < last]
        net.threshold = float((last + below.max()) / 2 if len(below) else last)
    return net


def fit(
    docs: DataFrame,
    text: str = "text",
    recall: float = 0.99,
) -> Network | None:
    """Train on the findings and other candidates of all texts: every distinct view, but for the
    quarter held out by its hash. None with fewer than five findings or other candidates to train
    on, or without a held-out finding; then only base patterns count.
    """
    def run(batches):
        for batch in batches:
            views, labels = [], []
            for value in batch.column(0).to_pylist():
                spans = candidates(value or "")
                for span, found in zip(spans, _meets(spans, base_spans(value or ""))):
                    own = windows(value, span)
                    views += own
                    labels += [int(found)] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(views, pa.string()), pa.array(labels, pa.int32())], ["view", "label"])

    seen = docs.select(F.col(text).alias("text")).mapInArrow(run, "view string, label int").distinct()
    seen = cut(seen.withColumn("h", F.xxhash64("view")), "views")
    held = F.pmod("h", F.lit(4)) == 0
    found = {(r["held"], r["label"]): r["count"] for r in seen.groupBy(held.alias("held"), "label").count().collect()}
    counts = {k: found.get((False, k), 0) for k in (0, 1)}
    if min(counts.values()) < 5 or not found.get((True, 1)):
        return None
    net = train(seen.where(~held), counts)
    return calibrate(net, seen.where(held), recall)


_FOUND = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
        ]
    )
)
_FOUND_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(texts: list[str | None], net: Network | None) -> list[list[tuple[str, int, int]]]:
    """Spans of each text, in order. Views of candidates go through the network in groups."""
    found, views, whose = [], [], []

    def add():
        if views:
            for i in np.flatnonzero(net.logit(encode_views(views)) >= net.threshold):
                row, (a, b) = whose[i]
                found[row].append(("model", a, b))
        views.clear()
        whose.clear()

    for row, value in enumerate(texts):
        value = value or ""
        base = base_spans(value)
        found.append(base)
        spans = candidates(value) if net is not None else []
        for span, meets in zip(spans, _meets(spans, base)):
            if not meets:
                own = windows(value, span)
                views += own
                whose += [(row, span)] * len(own)
        if len(views) >= 4096:
            add()
    add()
    return [sorted(set(f), key=lambda s: (s[1], KINDS.index(s[0]), s[2])) for f in found]


def masked(text: str, spans: list[tuple[str, int, int]], mask: str) -> str:
    """The text with each span, or run of overlapping spans, replaced."""
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, net: Network | None, text: str = "text", name: str = "secrets", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) and ``name``: spans as (kind, start, end) in code points,
    end exclusive, ordered by start, then kind as in ``KINDS``.

    Candidates that overlap a base span add nothing. Null and empty texts have none; a column
    called ``name`` is replaced; repeated rows are scanned alike.
    """
    network = share(docs.sparkSession, net)
    kept = [c for c in (keep or docs.columns) if c != name]

    def run(batches):
        for batch in batches:
            found = scan(batch.column(len(kept)).to_pylist(), shared(network))
            spans = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in f] for f in found], _FOUND_ARROW)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], spans], [*kept, name])

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(name, _FOUND)])
    return docs.select(*kept, F.col(text).alias("__text")).mapInArrow(run, schema)


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def mask_secrets(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", **fitting) -> DataFrame:
    """``docs`` with every found span replaced by ``mask``; no row goes. Overlapping spans are
    masked as one. Null texts stay null."""
    network = share(docs.sparkSession, fit(docs, text, **fitting))
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            values = batch.column(at).to_pylist()
            found = scan(values, shared(network))
            clean = [masked(v, f, mask) if f else v for v, f in zip(values, found)]
            columns = [*batch.columns[:at], pa.array(clean, pa.string()), *batch.columns[at + 1 :]]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
