"""Operator 4: quality by attention-based multiple-instance learning over passages.

Every passage of a document is encoded; gated attention weights are learned from document labels only;
the weighted passage representation is scored.  A document is a bag, its passages are the instances:
junk that fills only a part of a long text still gets the attention.

Defined results: a null or empty text is one empty passage; a null ``doc_id`` is scored and not held out;
repeated rows get equal results; without usable labels of both classes every score is 0; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.arrow import slices
from orrery.llm.labelled import training_rows
from orrery.llm.text import held_out
from orrery.session import intermediate, written

#: Labelled documents that are used for fitting at most.
MAX_TRAIN = 6_000
#: Bytes of their encoded passages that the driver keeps (about 60 KB for a long document); a larger sample
#: stays in its table and is read again for every epoch, a batch at a time, in the same order.
KEPT_BYTES = 128 << 20
#: Documents and passages of a batch, whichever comes first.
BATCH_BAGS, BATCH_PASSAGES = 64, 20_000
#: Words of a passage; passages of a text are consecutive and cover all of it.
PASSAGE = 48
HASHED, HIDDEN, GATE = 12, 32, 16
STOP = frozenset(
    "the of and to in is that it was for on are as with be at this by from or an a der die das und in zu den von mit ist des für auf im dem nicht ein eine als auch es an werden aus er hat dass sie nach"
    " la le les de des et en un une du que qui dans pour est pas sur plus par se el los las y del que en un una por con no su para es al lo como más".split()
)
_EDGE = re.compile(r"^\W+|\W+$")
#: Columns of a word's own features, before the hashed ones.
WORD_FEATURES = 14
#: Features of a passage: sums over words, then repetition and size.
N_FEATURES = WORD_FEATURES + HASHED + 7


def _word(w: str) -> list[float]:
    core = _EDGE.sub("", w)
    n = len(w)
    letters = sum(map(str.isalpha, w))
    low = core.lower()
    own = [
        min(n, 40) / 10,
        letters / n,
        float(w.isupper() and letters > 1),
        float(core[:1].isupper()),
        sum(map(str.isdigit, w)) / n,
        sum(c in "#*$%&|<>@~^_=" for c in w) / n,
        float(not core),
        float(w[-1] in ".,;:"),
        float(w[-1] in "!?"),
        float(low in STOP),
        float(w == "|"),
        sum(ord(c) > 127 for c in w) / n,
        float(letters == 0),
        float(n > 20),
    ]
    hashed = [0.0] * HASHED
    for k in range(max(1, len(low) - 2)):
        x = zlib.crc32(low[k : k + 3].encode())
        hashed[x % HASHED] += 1 if x & 0x10000 else -1
    scale = 1 / max(1, len(low) - 2) ** 0.5
    return own + [v * scale for v in hashed]


class Words:
    """Word -> row of a growing table of features; starts anew beyond a bound.  Long words are known by a hash."""

    def __init__(self, most: int = 300_000):
        self.most, self.at, self.table = most, {}, np.zeros((1024, WORD_FEATURES + HASHED), np.float32)

    def ids(self, words: list[str]) -> np.ndarray:
        if len(self.at) + len(words) > self.most and len(self.at) > 1024:
            self.at = {}
        at = self.at
        out = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            k = at.get(w)
            if k is None:
                key = w if len(w) <= 64 else hashlib.blake2b(w.encode()).digest()
                k = at.get(key)
                if k is None:
                    k = at[key] = len(at)
                    if k >= len(self.table):
                        self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                    self.table[k] = _word(w)
            out[i] = k
        return out


def passages(text: str, words: Words) -> np.ndarray:
    """[passages, N_FEATURES] of the whole text."""
    w = text.split()
    if not w:
        return np.zeros((1, N_FEATURES), np.float32)
    ids = words.ids(w)
    start = np.arange(0, len(w), PASSAGE)
    if len(start) > 1 and len(w) - start[-1] < PASSAGE // 2:  # a short end belongs to the passage before it
        start = start[:-1]
    size = np.diff(np.r_[start, len(w)]).astype(np.float32)[:, None]
    # long texts are summed a stretch of passages at a time
    parts = []
    for a in range(0, len(start), 512):
        s = start[a : a + 512]
        e = start[a + 512] if a + 512 < len(start) else len(w)
        parts.append(np.add.reduceat(words.table[ids[s[0] : e]], s - s[0], axis=0))
    mean = np.concatenate(parts) / size
    seen = np.ones(len(w), np.float32)
    seen[np.unique(ids, return_index=True)[1]] = 0
    same = np.r_[0, (ids[1:] == ids[:-1])].astype(np.float32)
    tri = np.zeros(len(w), np.float32)
    if len(w) > 2:
        key = (ids[:-2] * 1_000_003 + ids[1:-1]) * 1_000_003 + ids[2:]
        tri[: len(key)] = 1
        tri[np.unique(key, return_index=True)[1]] = 0
    again = np.add.reduceat(np.stack([seen, same, tri], axis=1), start, axis=0) / size
    lines = (text.count("\n") + 1) / len(w)
    chars = len(text) / len(w) / 10
    whole = np.broadcast_to(np.array([lines, min(chars, 5), np.log1p(len(w)) / 8], np.float32), (len(start), 3))
    return np.concatenate([mean, again, whole, np.log1p(size) / 5], axis=1, dtype=np.float32)


@dataclass
class Net:
    """Encoder, gated attention and head."""

    p: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray

    def forward(self, x: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
        """``x``: passages of all bags; ``start``: first passage of each bag."""
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"] + p["v"]), 1 / (1 + np.exp(-(h @ p["U"] + p["u"])))
        e = (t * s) @ p["a"]
        bag = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(x)]))
        e = np.exp(e - np.maximum.reduceat(e, start)[bag])
        a = e / np.add.reduceat(e, start)[bag]
        z = np.add.reduceat(a[:, None] * h, start, axis=0)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "bag": bag, "logit": z @ p["c"] + p["d"]}

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.zeros(0)
        start = np.cumsum([0, *(len(b) for b in bags[:-1])])
        return 1 / (1 + np.exp(-np.clip(self.forward(np.concatenate(bags), start)["logit"].astype(np.float64), -40, 40)))

    def gradient(self, f: dict[str, np.ndarray], y: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
        p, a, h, bag = self.p, f["a"], f["h"], f["bag"]
        g = (1 / (1 + np.exp(-f["logit"])) - y) / len(y)
        gz = g[:, None] * p["c"]
        gh = a[:, None] * gz[bag]
        ga = (h * gz[bag]).sum(axis=1)
        ge = a * (ga - np.add.reduceat(a * ga, start)[bag])  # softmax inside each bag
        gt, gs = ge[:, None] * p["a"] * f["s"] * (1 - f["t"] ** 2), ge[:, None] * p["a"] * f["t"] * f["s"] * (1 - f["s"])
        gh += gt @ p["V"].T + gs @ p["U"].T
        gx = gh * (1 - h**2)
        return {"W": f["x"].T @ gx, "b": gx.sum(0), "V": h.T @ gt, "v": gt.sum(0), "U": h.T @ gs, "u": gs.sum(0), "a": (f["t"] * f["s"]).T @ ge, "c": f["z"].T @ g, "d": g.sum(keepdims=True)}


Bags = Iterator[tuple[np.ndarray, float]]


def place(epoch: int, doc_id: int) -> int:
    """The order of an epoch, which Spark can compute too."""
    return zlib.crc32(f"{epoch}:{doc_id}".encode())


def _batches(bags: Bags) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(passages, labels, first passage of each bag)."""
    xs, y, n = [], [], 0
    for x, label in bags:
        xs.append(x)
        y.append(label)
        n += len(x)
        if len(xs) >= BATCH_BAGS or n >= BATCH_PASSAGES:
            yield np.concatenate(xs), np.array(y, np.float32), np.cumsum([0, *(len(x) for x in xs[:-1])])
            xs, y, n = [], [], 0
    if xs:
        yield np.concatenate(xs), np.array(y, np.float32), np.cumsum([0, *(len(x) for x in xs[:-1])])


def fit_net(read: Callable[[int], Bags], size: int, epochs: int = 30, rate: float = 4e-3, decay: float = 1e-4, seed: int = 3) -> Net:
    """``read(epoch)`` gives all ``size`` bags and labels in that epoch's order; only a batch is held."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / shape[0] ** 0.5).astype(np.float32)
    zero = lambda n: np.zeros(n, np.float32)
    p = {"W": draw(N_FEATURES, HIDDEN), "b": zero(HIDDEN), "V": draw(HIDDEN, GATE), "v": zero(GATE), "U": draw(HIDDEN, GATE), "u": zero(GATE), "a": draw(GATE), "c": draw(HIDDEN), "d": zero(1)}
    count, total, squares = 0, np.zeros(N_FEATURES), np.zeros(N_FEATURES)
    for x, _, _ in _batches(read(0)):
        x = x.astype(np.float64)
        count, total, squares = count + len(x), total + x.sum(0), squares + (x**2).sum(0)
    mean = total / count
    net = Net(p, mean.astype(np.float32), (np.sqrt(np.maximum(squares / count - mean**2, 0)) + 1e-3).astype(np.float32))
    m, v, steps = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for epoch in range(epochs):
        seen = 0
        for x, y, start in _batches(read(epoch)):
            g = net.gradient(net.forward(x, start), y, start)
            steps, seen = steps + 1, seen + len(y)
            lr = rate * (1 - (epoch + seen / (size + 1)) / epochs)
            for name, w in p.items():
                grad = g[name].astype(np.float32) + decay * w
                m[name] = 0.9 * m[name] + 0.1 * grad
                v[name] = 0.999 * v[name] + 0.001 * grad**2
                w -= lr * (m[name] / (1 - 0.9**steps)) / (np.sqrt(v[name] / (1 - 0.999**steps)) + 1e-8)
    return net


_worker: list[Words] = []


def _worker_words() -> Words:
    if not _worker:
        _worker.append(Words())
    return _worker[0]


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, seed: int = 7, kept_bytes: int = KEPT_BYTES) -> Net | None:
    """The net, or None if the sample lacks a class."""
    rows = training_rows(docs, labels, "quality", most, seed)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            x = [passages(t, _worker_words()).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.binary())], ["doc_id", "y", "x"])

    bags = written(rows.mapInArrow(encode, "doc_id long, y int, x binary"), "passages")
    size, size_bytes, kinds = bags.agg(F.count(F.lit(1)), F.sum(F.octet_length("x")), F.count_distinct("y")).first()
    if kinds < 2:
        return None
    bag = lambda r: (np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES), r["y"])
    if size_bytes <= kept_bytes:
        kept = {r["doc_id"]: bag(r) for r in bags.collect()}

        def read(epoch: int) -> Bags:
            return (kept[i] for i in sorted(kept, key=lambda i: (place(epoch, i), i)))
    else:

        def read(epoch: int) -> Bags:
            order = F.crc32(F.concat(F.lit(f"{epoch}:"), F.col("doc_id").cast("string")))
            return map(bag, bags.orderBy(order, "doc_id").toLocalIterator())

    # small samples take more passes, so that the number of steps does not depend on the table's size
    return fit_net(read, size, epochs=int(np.clip(180_000 / size, 30, 200)))


def score_quality(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, threshold: float = 0.3, seed: int = 7) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text)."""
    with intermediate():
        sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most, seed))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, words = sent.value, _worker_words()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                # bag by bag, so that equal texts get equal scores whatever stands beside them
                s = [float(net.score([passages(t, words)])[0]) for t in texts] if net else [0.0] * len(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
