"""Secret scan: exact rules, and a character convolutional network for what they miss.

One pass over the texts finds the base matches and further candidates, long tokens with a digit that no
base match touches, each with a window of its surroundings. The network is trained on all labelled
findings, base matches against tokens of prose and plain numbers, in shards whose networks are averaged
after every epoch. Its scores are calibrated on held-out findings, where the threshold is the highest that
still finds the wanted share. Then every candidate is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import staged

#: The base rules.
KINDS = ["assign", "access", "hex", "cnn"]
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LONG = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGIT = re.compile(r"[0-9]")
LETTER = re.compile(r"[A-Za-z]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
BEFORE, WINDOW = 24, 88
EPOCHS, SIZE = 8, 64
SHARD, SHARDS = 4096, 64  # findings that are worth a shard of their own, and shards at most
GRID = 1000
NAMES = ("w", "b", "v", "c")
FILTERS, WIDTH, SYMBOLS = 24, 5, 64
RECALL = 0.98
_SYMBOL = np.full(128, 63, dtype=np.uint8)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789 +/_.=-:\"'#@,;!?()[]{}"):
    _SYMBOL[ord(_c)] = _i
_UPPER = 60
_SYMBOL[65:91] = _UPPER


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches of *text* in order, by code points."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _window(text: str, start: int) -> str:
    """The surroundings of a finding, which begins at a fixed place of it."""
    return " " * max(0, BEFORE - start) + text[max(0, start - BEFORE) : start - BEFORE + WINDOW]


def findings(text: str) -> list[tuple[int, int, int, int, str]]:
    """(start, kind, end, label, window): base matches (label 1), other candidates (kind 3; label 0 where
    they are plain numbers, else unknown, -1), and one token of prose (kind 4, label 0)."""
    base = base_spans(text)
    out = [(s, k, e, 1, _window(text, s)) for s, k, e in base]
    edges = iter(base)
    held, reach = next(edges, None), 0
    for m in LONG.finditer(text):
        if not DIGIT.search(text, m.start(), m.end()):
            continue
        while held and held[0] < m.end():
            reach, held = max(reach, held[2]), next(edges, None)
        if reach <= m.start():
            label = -1 if LETTER.search(text, m.start(), m.end()) else 0
            out.append((m.start(), 3, m.end(), label, _window(text, m.start())))
    if text:
        m = TOKEN.search(text, len(text) // 2)
        if m and not any(s < m.end() and m.start() < e for s, _, e in base) and not DIGIT.search(m.group()):
            out.append((m.start(), 4, m.end(), 0, _window(text, m.start())))
    return out


FOUND = "array<struct<start:bigint,kind:int,end:bigint,label:int,window:string>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 200):
            part = batch.slice(start, 200)
            rows = [
                [dict(zip(("start", "kind", "end", "label", "window"), f)) for f in findings(t.as_py() or "")] for t in part["text"]
            ]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("label", pa.int32()), ("window", pa.string())]))
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(rows, kind)], ["doc_id", "found"])


def symbols(windows: list[str]) -> np.ndarray:
    """Windows as rows of symbol numbers."""
    codes = np.zeros((len(windows), WINDOW), dtype=np.int64)
    for i, w in enumerate(windows):
        points = np.frombuffer(w.ljust(WINDOW)[:WINDOW].encode("utf-32-le", "replace"), np.uint32)
        codes[i] = np.where(points < 128, _SYMBOL[np.minimum(points, 127)], 62)
    return codes


class Network:
    """Embedding-free convolution over symbols, ReLU, the largest value inside and around the finding,
    and a logistic layer; ``slope`` and ``shift`` calibrate the score."""

    def __init__(self, seed: int = 7):
        random = np.random.Generator(np.random.PCG64(seed))
        self.w = random.normal(0, 0.2, (WIDTH * SYMBOLS, FILTERS)).astype(np.float32)
        self.b = np.zeros(FILTERS, np.float32)
        self.v = random.normal(0, 0.2, 2 * FILTERS).astype(np.float32)
        self.c = np.zeros(1, np.float32)
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5
        self.first, self.second = ({n: np.zeros_like(getattr(self, n)) for n in NAMES} for _ in range(2))
        self.steps = 0

    def _forward(self, codes: np.ndarray):
        places = WINDOW - WIDTH + 1
        hidden = np.zeros((len(codes), places, FILTERS), dtype=np.float32)
        for k in range(WIDTH):
            hidden += self.w[k * SYMBOLS : (k + 1) * SYMBOLS][codes[:, k : k + places]]
        hidden = np.maximum(hidden + self.b, 0)
        top_in = hidden[:, BEFORE:].argmax(axis=1)
        top_out = hidden[:, :BEFORE].argmax(axis=1)
        pooled = np.concatenate([hidden[:, BEFORE:].max(axis=1), hidden[:, :BEFORE].max(axis=1)], axis=1)
        return pooled, top_in + BEFORE, top_out, pooled @ self.v + self.c

    def learn(self, codes: np.ndarray, labels: np.ndarray, weights: np.ndarray, rate: float = 0.01) -> None:
        """One step of Adam."""
        pooled, top_in, top_out, score = self._forward(codes)
        error = (weights * ((1 / (1 + np.exp(-np.clip(score, -30, 30)))) - labels)).astype(np.float32) / len(codes)
        back = error[:, None] * self.v[None, :] * (pooled > 0)
        # only the places that gave the largest values pass anything back
        top, filters = np.concatenate([top_in, top_out], axis=1), np.tile(np.arange(FILTERS), 2)
        rows, slope = np.arange(len(codes))[:, None], np.zeros(self.w.size)
        for k in range(WIDTH):
            cells = (k * SYMBOLS + codes[rows, top + k]) * FILTERS + filters
            slope += np.bincount(cells.ravel(), weights=back.ravel(), minlength=self.w.size)
        slopes = {
            "w": slope.reshape(self.w.shape) + 1e-4 * self.w, "b": back.reshape(-1, 2, FILTERS).sum(axis=(0, 1)),
            "v": pooled.T @ error + 1e-4 * self.v, "c": error.sum(keepdims=True),
        }
        self.steps += 1
        for n in NAMES:
            self.first[n] = (0.9 * self.first[n] + 0.1 * slopes[n]).astype(np.float32)
            self.second[n] = (0.999 * self.second[n] + 0.001 * slopes[n] ** 2).astype(np.float32)
            change = rate * (self.first[n] / (1 - 0.9**self.steps)) / (np.sqrt(self.second[n] / (1 - 0.999**self.steps)) + 1e-8)
            setattr(self, n, (getattr(self, n) - change).astype(np.float32))

    def fit(self, codes: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, size: int = SIZE) -> None:
        random = np.random.Generator(np.random.PCG64(11))
        for _ in range(epochs):
            order = random.permutation(len(codes))
            for at in range(0, len(order), size):
                rows = order[at : at + size]
                self.learn(codes[rows], labels[rows], np.ones(len(rows)), rate)

    def state(self) -> np.ndarray:
        """What learning changes, as one row of numbers."""
        parts = [part[n].ravel() for part in (vars(self), self.first, self.second) for n in NAMES]
        return np.concatenate([*parts, [self.steps]]).astype(np.float32)

    def restore(self, state: np.ndarray) -> None:
        at = 0
        for part in (vars(self), self.first, self.second):
            for n in NAMES:
                part[n] = state[at : at + part[n].size].reshape(part[n].shape).astype(np.float32)
                at += part[n].size
        self.steps = int(state[at])

    def calibrate(self, codes: np.ndarray, labels: np.ndarray, recall: float) -> None:
        self.settle(self.raw(codes), labels, np.ones(len(labels)), recall)

    def settle(self, score: np.ndarray, labels: np.ndarray, counts: np.ndarray, recall: float) -> None:
        """Platt's slope and shift by Newton steps, both labels weighing alike, and the highest threshold with the
        wanted recall; *counts* says how often each score stands."""
        of = np.array([counts[labels == 0].sum(), counts[labels > 0].sum()])
        times = counts * (of.sum() / (2 * np.maximum(of, 1)))[(labels > 0).astype(int)]
        positives, negatives = times[labels > 0].sum(), times[labels == 0].sum()
        aim = np.where(labels > 0, (positives + 1) / (positives + 2), 1 / (negatives + 2))
        a, b = 1.0, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
            weight = times * (p * (1 - p) + 1e-6)
            g = np.array([(times * (p - aim) * score).sum() + 1e-3 * (a - 1), (times * (p - aim)).sum()])
            h = np.array([[(weight * score * score).sum() + 1e-3, (weight * score).sum()], [(weight * score).sum(), weight.sum()]])
            change = np.linalg.solve(h, g)
            a, b = a - change[0], b - change[1]
        self.slope, self.shift = float(a), float(b)
        hits, times = self._scaled(score[labels > 0]), counts[labels > 0]
        order = np.argsort(hits)
        passed = np.cumsum(times[order]) > int((1 - recall) * times.sum())
        self.threshold = max(0.5, float(hits[order][passed.argmax()])) if len(hits) else 2.0

    def raw(self, codes: np.ndarray) -> np.ndarray:
        parts = [self._forward(codes[i : i + 256])[3] for i in range(0, len(codes), 256)]
        return np.concatenate(parts).astype(np.float64) if parts else np.empty(0)

    def _scaled(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -30, 30)))

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return self._scaled(self.raw(codes))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows as the bytes of their symbol numbers."""
    for batch in batches:
        codes = symbols(batch["window"].to_pylist()).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch["key"], batch["label"], pa.array([c.tobytes() for c in codes], pa.binary())], ["key", "label", "codes"])


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WINDOW).astype(np.int64)


def _lesson(state: np.ndarray, weights: np.ndarray):
    """A function from rows sorted by shard to what a network that starts from *state* has learned at the end of each."""
    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, network, rest, seen = None, Network(), None, 0

        def take(codes: np.ndarray, labels: np.ndarray) -> None:
            network.learn(codes, labels, weights[labels])

        def ended() -> pa.RecordBatch:
            if len(rest[1]):
                take(*rest)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([seen], pa.int64()), pa.array([network.state().tobytes()], pa.binary())], ["shard", "seen", "state"]
            )

        for batch in batches:
            shards, labels, codes = batch["shard"].to_numpy(), batch["label"].to_numpy(), _codes(batch["codes"])
            cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1), len(shards)]
            for first, last in zip(cuts, cuts[1:]):
                if first == last:
                    continue
                if shards[first] != shard:
                    if shard is not None:
                        yield ended()
                    shard, seen, rest = int(shards[first]), 0, (codes[:0], labels[:0])
                    network.restore(state)
                seen += last - first
                both = np.concatenate([rest[0], codes[first:last]]), np.concatenate([rest[1], labels[first:last]])
                whole = len(both[1]) // SIZE * SIZE
                for at in range(0, whole, SIZE):
                    take(both[0][at : at + SIZE], both[1][at : at + SIZE])
                rest = both[0][whole:], both[1][whole:]
        if shard is not None:
            yield ended()

    return learned


def train(scanned: DataFrame, recall: float = RECALL) -> Network | None:
    """A network from all labelled findings. In an epoch every shard of them, dealt by hash, goes on from the same
    network, and the mean of what the shards have learned is the next one; there are at most SHARDS of them, so the
    driver sees as many networks at once. About a fifth, by hash, is held out for calibration, as counts of scores cut to
    1 / GRID. Both labels weigh alike. None if a label has fewer than five findings."""
    known = scanned.select("doc_id", F.explode("found").alias("f")).filter("f.label >= 0").select(
        F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("f.start").cast("string"), F.col("f.window"))).alias("key"),
        F.col("f.label").alias("label"), F.col("f.window").alias("window"),
    )
    examples = staged(known.mapInArrow(_examples, "key string, label int, codes binary"), "secrets-examples")
    found = {r["label"]: r["count"] for r in examples.groupBy("label").count().collect()}  # two rows
    if min(found.get(0, 0), found.get(1, 0)) < 5:
        return None
    total = sum(found.values())
    weights = np.array([total / (2 * found[label]) for label in (0, 1)])
    shards = min(SHARDS, -(-total // SHARD))
    held = F.pmod(F.xxhash64("key"), F.lit(5)) == 0
    network = Network()
    for epoch in range(EPOCHS):
        at = F.xxhash64("key", F.lit(epoch))
        dealt = examples.filter(~held).select("key", "label", "codes", at.alias("at"), F.pmod(at, F.lit(shards)).alias("shard"))
        parts = (
            dealt.repartition(shards, "shard").sortWithinPartitions("shard", "at", "key")
            .mapInArrow(_lesson(network.state(), weights), "shard bigint, seen bigint, state binary").collect()
        )
        parts.sort(key=lambda p: p["shard"])
        if parts:
            network.restore(np.average([np.frombuffer(p["state"], np.float32) for p in parts], axis=0, weights=[p["seen"] for p in parts]))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.floor(np.clip(network.raw(_codes(batch["codes"])), -30, 30) * GRID).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array(score)], ["label", "score"])

    counted = examples.filter(held).select("label", "codes").mapInArrow(scores, "label int, score bigint").groupBy("score", "label").count().collect()
    score, labels, counts = (np.array([float(r[c]) for r in counted]) for c in ("score", "label", "count"))
    if len(counted):
        network.settle(score / GRID, labels, counts, recall)
    else:
        network.threshold = 2.0
    return network


def scan(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """(doc_id, found) for every row of *docs*: an array of (kind, start, end) of all spans, by start and
    kind; ends are exclusive, places are code points.

    NULL text counts as empty, repeated rows are scanned each, an empty table gives an empty result and no
    network, other columns are ignored. Where there are fewer than five findings of a label there is no
    network, and the base spans stand alone.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    scanned = staged(docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {key}, found {FOUND}"), "secrets-found")
    network = train(scanned, recall)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch["found"].to_pylist()
            windows = [f["window"] for r in rows for f in r if f["kind"] == 3]
            passed = iter(network.probability(symbols(windows)) >= network.threshold if network and windows else [False] * len(windows))
            out = [[f for f in r if f["kind"] < 3 or f["kind"] == 3 and next(passed)] for r in rows]
            spans = [[{"kind": KINDS[f["kind"]], "start": f["start"], "end": f["end"]} for f in sorted(r, key=lambda f: (f["start"], f["kind"]))] for r in out]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(spans, kind)], ["doc_id", "found"])

    return scanned.mapInArrow(score, f"doc_id {key}, found array<struct<kind:string,start:bigint,end:bigint>>")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) from the spans of :func:`scan`."""
    def listed(column):
        return F.array_join(F.transform(column, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")

    count = lambda kind: F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("found", lambda f: f["kind"] != "cnn")
    return scan(docs).select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans")
    )
