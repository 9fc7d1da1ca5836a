"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters as the vector of the word itself, if it is in the vocabulary, next to the mean of the vectors of its
character n-grams. One network reads a window of words forwards, another backwards; attention weighs their states into one
vector, from which a logistic unit gives the window's score. A text is cut into overlapping windows that cover all its
words, and its score is that of its worst window. Training sees labels of texts, not of windows: after a first pass over
all windows of a bounded sample, toxic texts are taught by the windows that score highest, the others by their worst ones.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import pieces, slabs
from .shingles import mix
from .text import fold, ship, whole

_MARKS = b".,;:!?\"'()[]{}<>*|#-_"
_F = np.float32


@dataclass(frozen=True)
class NetPlan:
    """``rows`` bounds the labelled texts of each class and ``sample_windows`` the windows of each that training sees."""

    window: int = 48
    stride: int = 24
    rows: int = 1500
    sample_windows: int = 24
    vocabulary: int = 20_000
    least: int = 4  # texts of the sample with a word of the vocabulary
    gram_rows: int = 1 << 14
    width: int = 8  # of word vectors and of n-gram vectors
    hidden: int = 8
    worst: int = 4  # windows of a clean text that a later pass sees
    epochs: int = 4
    batch: int = 128
    rate: float = 0.01
    seed: int = 1


def plain(token: bytes) -> bytes:
    """The token without marks around it, A-Z in lower case; one of marks only is left as it is."""
    return token.lower().strip(_MARKS) or token


def gram_ids(words: Sequence[bytes], rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of 3-grams, ids of 4-grams, how many of each a word has), word after word.

    They start at each byte of a word between two borders but the last two; the last 4-gram is filled up with a zero.
    """
    line = np.frombuffer(b"".join([b"^" + w + b"$" for w in words]) + b"\0\0\0", np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(lengths.sum())
    at = np.flatnonzero(left >= 3)
    code = line[at] | line[at + 1] << np.uint64(8) | line[at + 2] << np.uint64(16)
    longer = code | np.where(left[at] > 3, line[at + 3], np.uint64(0)) << np.uint64(24) | np.uint64(1 << 40)
    with np.errstate(over="ignore"):
        three, four = ((mix(c) % np.uint64(rows)).astype(np.int64) for c in (code, longer))
    return three, four, lengths - 2


def window_starts(n: int, plan: NetPlan) -> np.ndarray:
    """Starts of windows that cover ``n`` words; none for no words."""
    if n <= 0:
        return np.empty(0, np.int64)
    last = max(n - plan.window, 0)
    starts = np.arange(0, last + 1, plan.stride)
    return starts if starts[-1] == last else np.append(starts, last)


@dataclass
class Network:
    plan: NetPlan
    words: dict[bytes, int]
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, plan: NetPlan, words: dict[bytes, int]) -> Network:
        draw = np.random.default_rng(plan.seed)
        d, h = 2 * plan.width, plan.hidden
        some = lambda *shape: (draw.normal(size=shape) / np.sqrt(shape[0])).astype(_F)
        p = {"words": np.zeros((len(words), plan.width), _F), "grams": (draw.normal(size=(plan.gram_rows, plan.width)) * 0.3).astype(_F)}
        for side in "fb":
            p |= {f"{side}_in": some(d, 3 * h), f"{side}_bias": np.zeros(3 * h, _F), f"{side}_gates": some(h, 2 * h), f"{side}_new": some(h, h)}
        p |= {"attend": some(2 * h, 2 * h), "focus": some(2 * h), "out": some(2 * h), "bias": np.zeros(1, _F)}
        return cls(plan, words, p)

    def inputs(self, words: Sequence[bytes]) -> np.ndarray:
        """Input vectors of words (plain tokens)."""
        known = np.array([self.words.get(w, -1) for w in words], np.int64)
        return self.vectors(known, *gram_ids(words, self.plan.gram_rows))

    def vectors(self, known: np.ndarray, three: np.ndarray, four: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        width, grams = self.plan.width, self.p["grams"]
        x = np.zeros((len(known), 2 * width), grams.dtype)
        if len(known):
            hit = known >= 0
            x[hit, :width] = self.p["words"][known[hit]]
            first = np.cumsum(sizes) - sizes
            x[:, width:] = np.add.reduceat(grams[three] + grams[four], first, axis=0) / (2 * sizes[:, None])
        return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _read(p: dict, side: str, a: np.ndarray, mask: np.ndarray, memory: list | None = None) -> np.ndarray:
    """States (time, row, hidden) of one direction for inputs a (time, row, 3 * hidden); ``memory`` keeps what the gradient needs."""
    steps, rows, _ = a.shape
    gates, new = p[f"{side}_gates"], p[f"{side}_new"]
    size = new.shape[0]
    h, states = np.zeros((rows, size), a.dtype), np.empty((steps, rows, size), a.dtype)
    for t in range(steps) if side == "f" else reversed(range(steps)):
        zr = _sigmoid(a[t, :, :2 * size] + h @ gates)
        z, r = zr[:, :size], zr[:, size:]
        n = np.tanh(a[t, :, 2 * size:] + (r * h) @ new)
        m = mask[t][:, None]
        if memory is not None:
            memory.append((t, h, z, r, n, m))
        h = h + m * (1 - z) * (n - h)
        states[t] = h
    return states


def _pool(p: dict, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
    """(logits, pooled states, attention, its inner layer) of states (time, row, 2 * hidden)."""
    inner = np.tanh(states @ p["attend"])
    energy = np.where(mask, inner @ p["focus"], _F(-1e9))
    weight = np.exp(energy - energy.max(0))
    weight /= weight.sum(0)
    pooled = (weight[:, :, None] * states).sum(0)
    return pooled @ p["out"] + p["bias"][0], pooled, weight, inner


def projected(net: Network, x: np.ndarray) -> np.ndarray:
    """What input vectors add to both directions' gates; computed once per word."""
    p = net.p
    return np.concatenate([x @ p["f_in"] + p["f_bias"], x @ p["b_in"] + p["b_bias"]], 1)


def window_logits(net: Network, table: np.ndarray, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Logit of each window; ``ids`` and ``mask`` (time, row) say which rows of ``table`` it reads."""
    a, size = table[ids], 3 * net.plan.hidden
    states = np.concatenate([_read(net.p, "f", a[:, :, :size], mask), _read(net.p, "b", a[:, :, size:], mask)], 2)
    return _pool(net.p, states, mask)[0]


def gradients(net: Network, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict, np.ndarray]:
    """(loss, gradients of the network, gradient of the input vectors ``x``) for windows labelled ``y``."""
    p, size = net.p, net.plan.hidden
    table = projected(net, x)
    a = table[ids]
    memory: dict[str, list] = {"f": [], "b": []}
    sides = {"f": a[:, :, :3 * size], "b": a[:, :, 3 * size:]}
    states = np.concatenate([_read(p, side, sides[side], mask, memory[side]) for side in "fb"], 2)
    logits, pooled, weight, inner = _pool(p, states, mask)
    chance = _sigmoid(logits)
    loss = float(np.mean(np.logaddexp(0, logits) - y * logits))

    slope = ((chance - y) / len(y)).astype(x.dtype)
    g = {"out": pooled.T @ slope, "bias": np.array([slope.sum()], x.dtype)}
    d_pooled = slope[:, None] * p["out"]
    d_states = weight[:, :, None] * d_pooled
    d_weight = (states * d_pooled).sum(2)
    d_energy = weight * (d_weight - (weight * d_weight).sum(0))
    g["focus"] = np.einsum("trk,tr->k", inner, d_energy)
    d_inner = d_energy[:, :, None] * p["focus"] * (1 - inner**2)
    g["attend"] = np.einsum("trk,trl->kl", states, d_inner)
    d_states = d_states + d_inner @ p["attend"].T

    d_x = np.zeros_like(x)
    flat = ids.ravel()
    order = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(flat[order]) > 0))
    for side, at in (("f", slice(0, size)), ("b", slice(size, 2 * size))):
        gates, new = p[f"{side}_gates"], p[f"{side}_new"]
        d_a = np.empty(a.shape[:2] + (3 * size,), x.dtype)
        g_gates, g_new = np.zeros_like(gates), np.zeros_like(new)
        d_h = np.zeros((a.shape[1], size), x.dtype)
        for t, h, z, r, n, m in reversed(memory[side]):
            d_h = d_h + d_states[t][:, at]
            moved = m * d_h
            d_n = moved * (1 - z) * (1 - n**2)
            d_rh = d_n @ new.T
            d_zr = np.concatenate([moved * (h - n) * z * (1 - z), d_rh * h * r * (1 - r)], 1)
            g_new += (r * h).T @ d_n
            g_gates += h.T @ d_zr
            d_a[t] = np.concatenate([d_zr, d_n], 1)
            d_h = d_h - moved * (1 - z) + d_rh * r + d_zr @ gates.T
        g[f"{side}_gates"], g[f"{side}_new"] = g_gates, g_new
        g[f"{side}_bias"] = d_a.sum((0, 1))
        # Sums by input row, so that each word's vector is handled once.
        by_row = np.zeros((len(x), 3 * size), x.dtype)
        by_row[flat[order][first]] = np.add.reduceat(d_a.reshape(-1, 3 * size)[order], first, axis=0)
        g[f"{side}_in"] = x.T @ by_row
        d_x += by_row @ p[f"{side}_in"].T
    return loss, g, d_x


def _as_matrix(windows: Sequence[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask), both (time, row), of windows of different length."""
    ids, mask = np.zeros((most, len(windows)), np.int64), np.zeros((most, len(windows)), bool)
    for k, w in enumerate(windows):
        ids[:len(w), k] = w
        mask[:len(w), k] = True
    return ids, mask


def _calibrate(net: Network, logits: np.ndarray, labels: np.ndarray) -> None:
    """Scale and shift the output so that the worst window of a text gives the chance that the text is toxic."""
    x = np.stack([logits, np.ones(len(logits))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (chance - labels) + 1e-3 * (w - [1, 0])
        bend = (x * (chance * (1 - chance))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(bend, slope), -1, 1)
    net.p["out"] *= _F(max(w[0], 0.05))
    net.p["bias"] = (net.p["bias"] * max(w[0], 0.05) + w[1]).astype(_F)


def fit(samples: Sequence[tuple[int, Sequence[Sequence[bytes]]]], plan: NetPlan = NetPlan()) -> Network:
    """Train on (label, windows of plain tokens) of labelled texts, in the given order; the same order gives the same network."""
    seen = Counter(w for _, windows in samples for w in {w for x in windows for w in x})
    best = sorted((w for w, c in seen.items() if c >= plan.least), key=lambda w: (-seen[w], w))[:plan.vocabulary]
    net = Network.fresh(plan, {w: k for k, w in enumerate(best)})
    listed = sorted(seen)
    number = {w: k for k, w in enumerate(listed)}
    windows = [np.array([number[w] for w in x], np.int64) for _, xs in samples for x in xs if len(x)]
    owner = np.array([k for k, (_, xs) in enumerate(samples) for x in xs if len(x)], np.int64)
    labels = np.array([y for y, _ in samples], float)
    if not len(windows) or labels[owner].min() == labels[owner].max():
        # One class only: no window says more than that.
        net.p["out"][:] = 0
        net.p["bias"][0] = 4.0 if len(windows) and labels[owner].min() > 0.5 else -4.0
        return net
    three, four, sizes = gram_ids(listed, plan.gram_rows)
    begin = np.cumsum(sizes) - sizes
    known = np.array([net.words.get(w, -1) for w in listed], np.int64)
    p, width = net.p, plan.width
    first, second, steps = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    draw = np.random.default_rng(plan.seed)

    def grams_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = sizes[words]
        at = np.repeat(begin[words] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return three[at], four[at], size

    def learn(chosen: np.ndarray, rate: float) -> None:
        nonlocal steps
        steps += 1
        ids, mask = _as_matrix([windows[k] for k in chosen], plan.window)
        words, places = np.unique(ids, return_inverse=True)
        a, b, size = grams_of(words)
        x = net.vectors(known[words], a, b, size)
        _, g, d_x = gradients(net, x, places.reshape(ids.shape), mask, labels[owner[chosen]].astype(_F))
        for name, slope in g.items():
            first[name] = 0.9 * first[name] + 0.1 * slope
            second[name] = 0.99 * second[name] + 0.01 * slope**2
            p[name] -= (rate * first[name] / (1 - 0.9**steps) / (np.sqrt(second[name] / (1 - 0.99**steps)) + 1e-7)).astype(_F)
        # Vectors are moved by their own gradient history, and only those of the batch.
        hit = known[words] >= 0
        for name, rows, slope in (
            ("words", known[words][hit], d_x[hit, :width]),
            ("grams", np.concatenate([a, b]), np.tile(np.repeat(d_x[:, width:] / (2 * size[:, None]), size, axis=0), (2, 1)))):
            rows, where = np.unique(rows, return_inverse=True)
            total = np.zeros((len(rows), width), _F)
            np.add.at(total, where, slope)
            second[name][rows] += total**2
            p[name][rows] -= 5 * _F(rate) * total / (np.sqrt(second[name][rows]) + _F(1e-7))

    def scores() -> np.ndarray:
        table = projected(net, net.vectors(known, three, four, sizes))
        parts = [window_logits(net, table, *_as_matrix(windows[k:k + 2048], plan.window)) for k in range(0, len(windows), 2048)]
        return np.concatenate(parts)

    toxic_of = labels[owner] > 0.5
    for epoch in range(plan.epochs):
        # At first every window of a toxic text and some of the others, then the windows that score highest.
        now = scores() if epoch else np.where(toxic_of, 1.0, draw.random(len(windows)))
        order = np.lexsort((-now, owner))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        chosen = np.flatnonzero(np.where(toxic_of, (place == 0) | (now > 0), place < plan.worst))
        few, many = sorted((chosen[toxic_of[chosen]], chosen[~toxic_of[chosen]]), key=len)
        few = np.resize(draw.permutation(few), len(few) * max(1, min(4, len(many) // (2 * len(few)))))
        mixed = draw.permutation(np.concatenate([few, many]))
        for at in range(0, len(mixed), plan.batch):
            learn(mixed[at:at + plan.batch], plan.rate / (1 + epoch))
    worst = np.full(len(samples), -np.inf)
    np.maximum.at(worst, owner, scores())
    told = np.isfinite(worst)
    _calibrate(net, worst[told], labels[told])
    return net


class _Seen(dict):
    """Row of each token met so far; new tokens wait until their vectors are computed."""

    def __init__(self):
        self.waiting: list[bytes] = []

    def __missing__(self, token: bytes) -> int:
        row = self[token] = len(self) + 1
        self.waiting.append(token)
        return row


class Scorer:
    """Scores whole texts; vectors of words are kept between texts and dropped when there are many."""

    def __init__(self, net: Network, most: int = 150_000, rows: int = 4096):
        self.net, self.most, self.rows = net, most, rows
        self._clear()

    def _clear(self) -> None:
        self.seen = _Seen()
        # Row 0 fills windows up and is masked.
        self.table = np.zeros((1, 6 * self.net.plan.hidden), _F)

    def _ids(self, text: bytes) -> np.ndarray:
        parts = [np.fromiter(map(self.seen.__getitem__, slab.split()), np.int32) for slab in slabs(text)]
        return np.concatenate(parts) if parts else np.empty(0, np.int32)

    def __call__(self, texts: Sequence[bytes]) -> np.ndarray:
        """Score of each text, between 0 and 1; 0 for a text without words."""
        plan = self.net.plan
        if len(self.seen) > self.most:
            self._clear()
        ids = [self._ids(t) for t in texts]
        if self.seen.waiting:
            new = []
            for at in range(0, len(self.seen.waiting), 20_000):
                tokens = self.seen.waiting[at:at + 20_000]
                new.append(projected(self.net, self.net.inputs([plain(t) for t in tokens])))
            self.table = np.concatenate([self.table, *new])
            self.seen.waiting = []
        starts = [window_starts(len(x), plan) for x in ids]
        owner = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
        line = np.concatenate([*ids, np.zeros(plan.window, np.int32)]) if ids else np.empty(0, np.int32)
        ends = np.cumsum([len(x) for x in ids])
        begin = np.concatenate([s + e - len(x) for s, e, x in zip(starts, ends, ids)]) if ids else np.empty(0, np.int64)
        worst = np.full(len(texts), -np.inf)
        for at in range(0, len(begin), self.rows):
            whose = owner[at:at + self.rows]
            places = begin[at:at + self.rows] + np.arange(plan.window)[:, None]
            logits = window_logits(self.net, self.table, line[places], places < ends[whose])
            np.maximum.at(worst, whose, logits)
        return np.where(np.isinf(worst), 0.0, 1 / (1 + np.exp(-np.clip(worst, -60, 60))))


def sample(docs: DataFrame, labels: DataFrame, plan: NetPlan = NetPlan()) -> list[tuple[int, list[list[bytes]]]]:
    """(label, windows of plain tokens) of at most ``rows`` labelled texts of each class, the first by hash of the id.

    ``labels`` has doc_id and label; an id labelled twice counts as toxic if any label says so, and of texts with one id the
    least is taken. Of each text at most ``sample_windows`` windows are taken, evenly spread over all of it, with words cut
    to 64 bytes, so that what reaches the driver is bounded.
    """
    known = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    few = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(plan.rows)
        few = part if few is None else few.unionByName(part)
    # Broadcast is bounded by ``rows``.
    found = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(
        F.max("label").alias("label"), F.min(whole(F.col("text"))).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = row["text"].split()
                starts = window_starts(len(tokens), plan)
                starts = starts[np.unique(np.linspace(0, len(starts) - 1, min(len(starts), plan.sample_windows)).astype(int))] if len(starts) else starts
                lines = [b" ".join(plain(t)[:64] for t in tokens[s:s + plan.window]) for s in starts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([str(row["doc_id"])]), pa.array([row["label"]], pa.int32()), pa.array([lines], pa.list_(pa.binary()))],
                    ["doc_id", "label", "windows"])

    rows = found.mapInArrow(run, "doc_id string, label int, windows array<binary>").collect()
    rows.sort(key=lambda r: (zlib.crc32(r.doc_id.encode()), r.doc_id))
    return [(r.label, [bytes(w).split(b" ") for w in r.windows]) for r in rows]


def score_toxicity(docs: DataFrame, net: Network, threshold: float = 0.5) -> DataFrame:
    """doc_id, score and predicted of every whole text of ``docs``.

    Null and blank texts have no window and score 0. Rows are scored on their own: repeated rows and null ids are kept,
    further columns ignored, an empty table gives no rows. A very long text is read by the megabyte; its words are held as
    one number each.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(net)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for piece in pieces(batch):
                scores = scorer([t.as_py() for t in piece.column(1)])
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", whole(F.col("text")).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity_by_fold(docs: DataFrame, labels: DataFrame, folds: int = 5, plan: NetPlan = NetPlan()) -> DataFrame:
    """Learn from labels outside fold 0 and score every document: doc_id, held_out, score, predicted."""
    ship(docs.sparkSession)
    net = fit(sample(docs, labels.where(fold(F.col("doc_id"), folds) != 0), plan), plan)
    scored = score_toxicity(docs, net)
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score", "predicted")
