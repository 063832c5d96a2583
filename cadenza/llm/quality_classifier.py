"""A quality classifier by attention-based multiple-instance learning (Ilse, Tomczak and Welling, 2018).

A document is a bag of passages of ``WORDS`` words, and only the bag has a label: bad passages need not fill a document.

    passage   x: byte classes, hashed pairs of them, hashed words, and some measures, all of the passage alone
    encoding  h = tanh(x W + b)
    attention a = softmax over the bag's passages of w . (tanh(h V) * sigmoid(h U))
    score     sigmoid(c . sum(a h) + d)

W, V, U, w, c and their biases are learnt together from the labels of documents, by Adam on the cross-entropy. The score
reads the text and nothing else.

**Learning** takes the labelled documents that ``learnable`` allows, at most ``MAX_DOCUMENTS`` of them, those of the least hash of the
id, and of each at most ``MAX_PASSAGES`` evenly spaced passages. Both bounds are parameters, and hold in learning alone: so
the model is a function of the table's rows, whatever their order and partitions, and what the driver gets is at most 8000 bags of 32
passages of 320 bytes, 82 MB. Their ids are broadcast, their texts encoded by the tasks.

**Scoring** encodes and weighs every passage of every text in Arrow batches, where the text is; nothing is shuffled. A task holds
a text's bytes and some 130 bytes for each of its passages; features are made for ``PIECE_BYTES`` of text at a time.

Defined cases: a null or empty text, and one of white space only, is a bag of one empty passage and is scored like any other; a null
doc_id isn't held out and has no label; a document is labelled 0 if any of its labels is, null labels are none; of rows that repeat a
doc_id one is learnt from, that of the least text hash, and all are scored; with labels of one kind only the score
is their smoothed share, without any label 0.5, for all rows; extra columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a passage; bytes of text whose features are made at a time.
WORDS, PIECE_BYTES = 64, 1 << 20
#: Bounds of learning: documents, and passages of each.
MAX_DOCUMENTS, MAX_PASSAGES = 8000, 32
#: Buckets of pairs of byte classes and of words; widths of the encoding and of the attention.
PAIRS, TERMS, HIDDEN, GATES = 64, 64, 32, 16
EPOCHS, BATCH, RATE, DECAY, SEED = 16, 64, 3e-3, 1e-4, 13


def byte_classes() -> tuple[np.ndarray, int]:
    """The class of each byte, and how many there are: every ASCII sign is one of its own, letters are two and digits one."""
    classes = np.zeros(256, np.uint8)
    n = 0
    for chars in (" \t\x0b\x0c\r", "\n", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", *(chr(c) for c in range(33, 127) if not chr(c).isalnum())):
        n += 1
        classes[[ord(c) for c in chars]] = n
    classes[128:] = n + 1
    return classes, n + 2


CLASS, CLASSES = byte_classes()
MEASURES = 6
WIDTH = MEASURES + CLASSES + PAIRS + TERMS
#: How many bytes of a word its feature tells apart, beside its length; and odd factors that mix hashes.
LETTERS = 12
ODD, PRIME = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)
PAIR = ((np.arange(CLASSES**2, dtype=np.uint64) * ODD >> np.uint64(32)) % np.uint64(PAIRS)).astype(np.int64)


class Passages(NamedTuple):
    """Features of passages, a row each, and where each text's passages begin, with the end."""

    features: np.ndarray
    starts: np.ndarray


def encode(texts: pa.Array, end: bytes = b"\n") -> Passages:
    """The passages of texts; a text with fewer words than ``WORDS`` is one passage."""
    # A line end after each text: so every text has a byte, and no word runs on into the next one.
    binary = pa.large_binary()
    lines = pc.binary_join_element_wise(texts.cast(binary).fill_null(b""), pa.scalar(end, binary), pa.scalar(b"", binary))
    ends = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
    if not len(lines):
        return Passages(np.zeros((0, WIDTH), np.float32), np.zeros(1, np.int64))
    raw = np.frombuffer(lines.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    first, ends = ends[:-1] - ends[0], ends[1:] - ends[0]
    kind = CLASS[raw]
    inside = kind > 2
    inside[kind == 0] = True  # control characters
    begins = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    # Each word's number in its text; every WORDS-th but the first begins a passage.
    before = np.searchsorted(begins, first)
    number = np.arange(len(begins)) - np.repeat(before, np.diff(np.append(before, len(begins))))
    opens = np.zeros(len(raw), bool)
    opens[first] = True
    opens[begins[(number % WORDS == 0) & (number > 0)]] = True
    edges = np.append(np.flatnonzero(opens), len(raw))
    n = len(edges) - 1
    sizes = np.diff(edges)
    passage = np.repeat(np.arange(n), sizes)
    by_class = np.bincount(passage * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES)
    # A passage's last byte, a blank or a line end, and the first one of the next make a pair of the former.
    pairs = PAIR[kind[:-1].astype(np.int32) * CLASSES + kind[1:]]
    by_pair = np.bincount(passage[:-1] * PAIRS + pairs, minlength=n * PAIRS).reshape(n, PAIRS)
    by_pair[passage[edges[1:-1] - 1], pairs[edges[1:-1] - 1]] -= 1
    # A word's hash is that of its length and first bytes.
    outs = np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1
    letters = (outs - begins).astype(np.float64)
    hashes = np.zeros(len(begins), np.uint64)
    for place in range(LETTERS):
        long = begins + place < outs
        hashes[long] = (hashes[long] ^ raw[(begins + place)[long]]) * PRIME
        if not long.any():
            break
    hashes = (hashes ^ letters.astype(np.uint64)) * ODD
    hashes ^= hashes >> np.uint64(32)
    owner = passage[begins]
    words = np.bincount(owner, minlength=n).astype(np.float32)
    by_term = np.bincount(owner * TERMS + (hashes % np.uint64(TERMS)).astype(np.int64), minlength=n * TERMS).reshape(n, TERMS)
    # How often words repeat in the passage: distinct ones, and the most frequent one.
    key = np.sort((owner.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    groups = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    repeats, own = np.diff(np.append(groups, len(key))), (key[groups] >> np.uint64(40)).astype(np.int64)
    distinct = np.bincount(own, minlength=n).astype(np.float32)
    most = np.zeros(n, np.float32)
    if len(own):
        most[own[np.flatnonzero(np.diff(own, prepend=-1))]] = np.maximum.reduceat(repeats, np.flatnonzero(np.diff(own, prepend=-1)))
    some = np.maximum(words, 1)
    mean = np.bincount(owner, letters, n) / some
    spread = np.sqrt(np.maximum(np.bincount(owner, letters**2, n) / some - mean**2, 0))
    measures = np.stack([np.log1p(words), np.log1p(sizes), mean / 10, spread / 10, distinct / some, most / some], axis=1)
    # Square roots of shares: rare signs count, and no text is too long.
    shares = [np.sqrt(by / np.maximum(total, 1)[:, None]) for by, total in ((by_class, sizes), (by_pair, sizes), (by_term, words))]
    starts = np.append(passage[first], n)
    return Passages(np.concatenate([measures, *shares], axis=1).astype(np.float32), starts)


class Model(NamedTuple):
    """The parameters, and the mean and spread of the features; or a constant score, where there is nothing to learn."""

    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def hidden(self, features: np.ndarray) -> np.ndarray:
        x = np.clip((features - self.mean) / self.spread, -6, 6)
        return np.tanh(x @ self.weights["W"] + self.weights["b"])

    def attention(self, h: np.ndarray) -> np.ndarray:
        """The passages' weights before the softmax."""
        p = self.weights
        return (np.tanh(h @ p["V"] + p["v"]) * sigmoid(h @ p["U"] + p["u"])) @ p["w"]

    def scores(self, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        z, _ = pooled(h, self.attention(h), starts)
        return sigmoid(z @ self.weights["c"] + self.weights["d"][0])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def pooled(h: np.ndarray, e: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bags' representations, and the attention that made them."""
    sizes = np.diff(starts)
    a = np.exp(e - np.repeat(np.maximum.reduceat(e, starts[:-1]), sizes))
    a /= np.repeat(np.add.reduceat(a, starts[:-1]), sizes)
    return np.add.reduceat(a[:, None] * h, starts[:-1], axis=0), a


def gradients(p: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The mean cross-entropy of a batch of bags, and its derivatives by the parameters."""
    sizes = np.diff(starts)
    h = np.tanh(x @ p["W"] + p["b"])
    t, s = np.tanh(h @ p["V"] + p["v"]), sigmoid(h @ p["U"] + p["u"])
    z, a = pooled(h, (t * s) @ p["w"], starts)
    out = sigmoid(z @ p["c"] + p["d"][0])
    loss = float(-np.mean(y * np.log(np.maximum(out, 1e-12)) + (1 - y) * np.log(np.maximum(1 - out, 1e-12))))
    dl = (out - y) / len(y)
    dz = np.repeat(dl[:, None] * p["c"], sizes, axis=0)
    da = (dz * h).sum(axis=1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, starts[:-1]), sizes))
    dt, ds = de[:, None] * p["w"] * s * (1 - t**2), de[:, None] * p["w"] * t * s * (1 - s)
    dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h**2)
    return loss, {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "v": dt.sum(axis=0), "U": h.T @ ds, "u": ds.sum(axis=0), "w": (t * s).T @ de, "c": z.T @ dl, "d": np.array([dl.sum()])}


def start(rng: np.random.Generator, width: int = WIDTH) -> dict[str, np.ndarray]:
    def drawn(*shape: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

    return {"W": drawn(width, HIDDEN), "b": np.zeros(HIDDEN), "V": drawn(HIDDEN, GATES), "v": np.zeros(GATES), "U": drawn(HIDDEN, GATES), "u": np.zeros(GATES), "w": drawn(GATES), "c": drawn(HIDDEN), "d": np.zeros(1)}


def fit(features: np.ndarray, sizes: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS) -> Model:
    """The model of bags: ``sizes`` passages each, one bag after the other."""
    none = np.zeros(WIDTH), np.ones(WIDTH)
    if len(set(labels.tolist())) < 2:
        return Model(*none, {}, float((labels.sum() + 1) / (len(labels) + 2)))
    rng = np.random.default_rng(SEED)
    mean, spread = features.mean(axis=0, dtype=np.float64), features.std(axis=0, dtype=np.float64) + 1e-3
    first = np.append(0, np.cumsum(sizes))
    p = start(rng)
    slow, fast = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            bags = order[at : at + BATCH]
            starts = np.append(0, np.cumsum(sizes[bags]))
            rows = np.repeat(first[bags] - starts[:-1], sizes[bags]) + np.arange(starts[-1])
            x = np.clip((features[rows] - mean) / spread, -6, 6)
            _, g = gradients(p, x, starts, labels[bags].astype(float))
            step += 1
            for k, v in p.items():
                slow[k] += 0.1 * (g[k] - slow[k])
                fast[k] += 0.001 * (g[k] ** 2 - fast[k])
                v -= RATE * (slow[k] / (1 - 0.9**step) / (np.sqrt(fast[k] / (1 - 0.999**step)) + 1e-8) + DECAY * v)
    return Model(mean, spread, p)


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, max_documents: int = MAX_DOCUMENTS, max_passages: int = MAX_PASSAGES, doc_id: str = "doc_id", text: str = "text") -> Model:
    """The model from ``labels`` (doc_id, label 0 or 1) of documents for which ``learnable``, an expression over ``doc_id``, holds."""
    known = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & learnable).groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(SEED)), "doc_id").limit(max_documents)
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min("label").alias("label"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                x = np.concatenate([p.features for p, _ in parts(row.column("text"))])
                x = x[np.unique(np.linspace(0, len(x) - 1, min(len(x), max_passages)).round().astype(int))]
                yield pa.RecordBatch.from_pydict({"label": row.column("label"), "id": row.column("id"), "x": pa.array([x.astype("<f2").tobytes()], pa.binary())})

    made = one.select("label", F.col("doc_id").cast("string").alias("id"), "text").mapInArrow(bags, "label int, id string, x binary").toArrow().sort_by("id")
    x = [np.frombuffer(b, "<f2").reshape(-1, WIDTH) for b in made.column("x").to_pylist()]
    return fit(np.concatenate(x) if x else np.zeros((0, WIDTH), np.float16), np.array([len(b) for b in x], np.int64), made.column("label").to_numpy())


def parts(texts: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[Passages, int]]:
    """Passages of some ``size`` bytes of text at a time, and how many texts they are of. A longer text is cut where a passage
    ends, and comes in several parts, all but the last of 0 texts."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = int(np.searchsorted(ends, base + size, "right"))
        if to > at:
            yield encode(texts.slice(at, to - at)), to - at
            at = to
            continue
        cuts = [texts[at].as_buffer().to_pybytes()]
        while len(raw := cuts.pop()) > size and (head := whole_passages(raw, size)) < len(raw):
            yield encode(pa.array([raw[:head]], pa.binary()), b""), 0
            cuts.append(raw[head:])
        yield encode(pa.array([raw], pa.binary())), 1
        at += 1


def whole_passages(raw: bytes, size: int) -> int:
    """How many bytes the whole passages are that the first ``size`` bytes hold; more, if not even one ends there."""
    spaces = np.isin(CLASS[np.frombuffer(raw, np.uint8)], (1, 2))
    begins = np.flatnonzero(~spaces & np.concatenate([[True], spaces[:-1]]))[WORDS::WORDS]
    if not len(begins):
        return len(raw)
    k = int(np.searchsorted(begins, size, "right"))
    return int(begins[max(0, k - 1)])


def score(docs: DataFrame, model: Model, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for each row: the score of label 1, and 1 if it is at least ``threshold``."""
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    out = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("score", T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, open_h = [], []
            if model.constant is not None:
                made = [np.full(batch.num_rows, model.constant)]
            else:
                for p, texts in parts(batch.column("text")):
                    h = model.hidden(p.features)
                    if not texts or open_h:
                        open_h.append(h)
                        if texts:
                            h = np.concatenate(open_h)
                            made.append(model.scores(h, np.array([0, len(h)])))
                            open_h = []
                    else:
                        made.append(model.scores(h, p.starts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(made) if made else np.zeros(0), pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(scored, out).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
