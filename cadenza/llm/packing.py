"""Mixture-controlled packing: deficit round-robin over source queues, in closed form.

Every source is a queue of tokens. In each round every queue earns its quantum (its target share of one
window, in 1/65536 tokens) and gives out the whole tokens it has earned; what is left of the quantum is
its deficit, carried into the next round. The rounds follow each other without a gap and are cut into
windows of ``window`` tokens, so each window holds the target proportions to within one token per queue,
and every window but the last is full. A queue that has run dry drops out and the others keep their
proportions among themselves.

Because a queue's deficit after r rounds depends on r alone, the round in which a token leaves follows
from its position in its queue: no task needs another's state, and deficits carry across windows and
partitions by arithmetic. So the texts are tokenised once, where they are read; the ids are stored with
each document's position in its task's part of the queue; and one row per (task, queue) is summed up into
the parts' offsets. The place of a piece is the number of tokens before it by (round, queue, position):

* with up to ``MAX_QUEUES`` sources every task knows all queues and takes it from the closed form, so a
  second pass over the stored ids, without a shuffle, emits the pieces;
* with more, the pieces are range-partitioned in that order and their places are running sums.

Both give the same pieces in the same places, for any number of sources.

Defined cases: a null text counts as empty and gives the end id only; a null source is a queue of its
own; every row is a document, rows with equal doc_id too; texts are packed whole, however long; sources of
equal shares take turns by their names, null first; extra columns are ignored, whatever their names; an
empty table gives an empty table.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Queues that are sent to every task; with more, places come from a sort. 16 bytes each.
MAX_QUEUES = 256
#: Rounds whose queues are summed up at a time.
SOME_ROUNDS = 4096
#: Rows of part offsets that are broadcast; beyond, they are joined by shuffle. 64 bytes each at most.
MAX_BROADCAST_ROWS = 100_000
#: Quanta are whole multiples of 2**-SHIFT tokens.
SHIFT = 16
#: Words that a worker's cache may hold, and the longest word that it keeps.
CACHE_WORDS, CACHE_CHARS = 400_000, 64
#: Bytes of text that are split at a time, and documents that are cut at a time.
SLICE_BYTES, SLICE_ROWS = 8 << 20, 1024
#: What a tokenizer must do for words to be evened out before they are looked up: it lowers all letters
#: and tells runs of letters from what follows them.
LOWERED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
#: The last letter with a path of its own; beyond, the tokenizer's own normaliser is asked.
LATIN_END = "\u0250"


class WordEncoder(dict):
    """Token ids (little-endian uint32 bytes) of a text, by its words.

    The tokenizer drops white space and no pre-token crosses a blank, so a text's ids are those of its
    blank-separated parts one after the other. Arrow splits the texts and finds the distinct words of a
    slice; words seen before come from this cache, which a worker keeps from task to task. When half of it is
    full its words become the older half, of which those that are met again stay: frequent words aren't lost.

    Where the tokenizer lowers letters and ends a pre-token where letters end, the mark after a word is
    split off and words of ASCII are lowered first, so that a word has one entry; a new word of Latin
    letters then needs no normaliser and goes to the merges at once.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.older: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        letters = "[\\p{L}]+" in str(steps[0].get("pattern", {}).get("Regex", "")).split("|") and steps[-1].get("type") == "ByteLevel"
        self.even = letters and (spec.get("normalizer") or {}).get("normalizers") == LOWERED and not spec["model"].get("dropout")
        # The byte-level alphabet: printable bytes stand for themselves, the others for what comes after 255.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = iter(range(256, 512))
        self.alphabet = {b: b if b in shown else next(hidden) for b in range(256)}

    def __missing__(self, word: str) -> bytes:
        if word in self.older:
            return self.kept(word, self.older.pop(word))
        if self.even and word.isalpha() and max(word) < LATIN_END and word == word.lower():
            mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
            ids = [t.id for t in self.tokenizer.model.tokenize(mapped)]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids if word else []
        return self.kept(word, np.array(ids, "<u4").tobytes())

    def kept(self, word: str, found: bytes) -> bytes:
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS // 2:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found

    def encode(self, texts: pa.Array, end: bytes) -> pa.Array:
        """The ids of each text, with ``end`` after them, as binary values."""
        texts = texts.fill_null("")
        if self.even:
            texts = pc.replace_substring_regex(texts, r"(\pL)([.,;:!?])(\s)", r"\1 \2\3")
        parts = pc.ascii_split_whitespace(texts)
        words, starts = parts.flatten(), parts.offsets.to_numpy()
        starts = starts - starts[0]
        if self.even:
            plain = pc.and_(pc.string_is_ascii(words), pc.invert(pc.match_substring(words, "<")))
            words = pc.if_else(plain, pc.ascii_lower(words), words)
        coded = words.dictionary_encode()
        ids = pa.array([*(self[w] for w in coded.dictionary.to_pylist()), end], pa.binary())
        order = np.insert(coded.indices.to_numpy(), starts[1:], len(ids) - 1)
        laid = ids.take(pa.array(order, pa.int32()))
        at = np.frombuffer(laid.buffers()[1], "<i4")[starts + np.arange(len(starts))]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(at.tobytes()), laid.buffers()[2]])


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """The encoder that this worker process keeps."""
    return WordEncoder(path)


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about SLICE_BYTES of text each, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def round_of(token: np.ndarray, quantum: np.ndarray) -> np.ndarray:
    """The round in which a queue's token leaves; ``quantum`` is in 2**-SHIFT tokens."""
    return -((-(token + 1) << SHIFT) // quantum) - 1


def turns(quantum: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tokens start .. start + n of each row by the rounds that they leave in: (row, round, offset into the n, length).

    There is one piece for each round; a queue that earns less than a token a round gives every token a round of its own."""
    whole = quantum >= 1 << SHIFT
    first = round_of(start, quantum)
    count = np.where(whole, round_of(start + n - 1, quantum) - first + 1, n)
    row = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    rounds = np.where(whole[row], first[row] + nth, round_of(start[row] + nth, quantum[row]))
    # What the queue has given out before the round.
    offset = np.where(whole[row], np.maximum((rounds * quantum[row] >> SHIFT) - start[row], 0), nth)
    length = np.append(offset[1:], 0)
    length[np.cumsum(count) - 1] = n
    return row, rounds, offset, length - offset


class Queues(NamedTuple):
    """quantum and total tokens of each queue, by its number."""

    quantum: np.ndarray
    total: np.ndarray

    def given(self, q, rounds: np.ndarray) -> np.ndarray:
        """Tokens that queue(s) ``q`` have given out after so many rounds."""
        quantum, total = self.quantum[q], self.total[q]
        last = -((-total << SHIFT) // quantum)  # the round that empties the queue; also keeps the product small
        return np.where(rounds >= last, total, np.minimum(rounds, last) * quantum >> SHIFT)

    def before(self, q: np.ndarray, rounds: np.ndarray) -> np.ndarray:
        """Tokens of all queues that leave before queue ``q`` has its turn in a round."""
        every = np.arange(len(self.quantum))[:, None]
        distinct, of = np.unique(rounds, return_inverse=True)
        order = np.argsort(of, kind="stable")
        made = np.empty(len(q), np.int64)
        for at in range(0, len(distinct), SOME_ROUNDS):
            some = order[slice(*np.searchsorted(of[order], [at, at + SOME_ROUNDS]))]
            now = distinct[at : at + SOME_ROUNDS]
            held, then = self.given(every, now), self.given(every, now + 1)
            # The queues up to the turn have given out this round's tokens, those from it on only the earlier ones'.
            ahead = np.cumsum(then, axis=0) - then + held[::-1].cumsum(axis=0)[::-1]
            made[some] = ahead[q[some], of[some] - at]
        return made

    def pieces(self, q: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where tokens start .. start + n of each row's queue ``q`` go: (row, offset into the n, length, output position)."""
        row, rounds, offset, length = turns(self.quantum[q], start, n)
        return row, offset, length, self.before(q[row], rounds) + start[row] + offset - self.given(q[row], rounds)


def windowed(columns: list[pa.Array], ids: pa.Array, row: np.ndarray, begin: np.ndarray, length: np.ndarray, place: np.ndarray, start: np.ndarray, total: np.ndarray, window: int) -> pa.RecordBatch:
    """The pieces of documents' tokens cut at the ends of windows, with the ``columns`` of their documents.

    A piece has ``length`` of the tokens that row ``row`` of ``ids`` holds, from ``begin`` on, and goes to ``place``;
    the pieces cover the rows in order. A row's ids begin at ``start`` in a document of ``total`` tokens."""
    # A round's tokens may cross the end of a window, and be longer than one.
    spans = (place + length - 1) // window - place // window + 1
    nth = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
    row, first, begin, size = (np.repeat(x, spans) for x in (row, place, begin, length))
    lo = np.where(nth == 0, first, (first // window + nth) * window)
    hi = np.minimum(first + size, (first // window + nth + 1) * window)
    begin = begin + lo - first
    # Pieces of a document that follow each other in one window are one piece.
    joins = (lo[1:] == hi[:-1]) & (lo[1:] // window == lo[:-1] // window) & (row[1:] == row[:-1])
    keep = np.flatnonzero(np.concatenate([[True], ~joins]))
    hi = hi[np.append(keep[1:], len(hi)) - 1]
    row, lo, begin = row[keep], lo[keep], begin[keep]
    # The pieces cover the rows in order, so they share their bytes.
    ids = ids.cast(pa.binary())
    byte = np.frombuffer(ids.buffers()[1], "<i4")[ids.offset : ids.offset + len(ids) + 1]
    ends = np.append(byte[row] + 4 * begin, byte[-1]).astype("<i4")
    raw = memoryview(ids.buffers()[2])
    places = ends.tolist()
    crcs = [zlib.crc32(raw[a:b]) for a, b in zip(places, places[1:], strict=False)]
    cuts = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends.tobytes()), ids.buffers()[2]])
    numbers = [pa.array(x, pa.int64()) for x in (start[row] + begin, hi - lo, crcs, total[row], lo // window, lo % window)]
    which = pa.array(row, pa.int32())
    return pa.RecordBatch.from_arrays([*(c.take(which) for c in columns), *numbers, cuts], ["doc_id", "source", *NAMES])


def parts_of(batch: pa.RecordBatch, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, rows) for at in range(0, len(batch), rows))


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    window: int = 4096,
    targets: dict[str, float] | float | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per piece: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ``targets`` maps sources to relative weights. Without it, and for sources that it leaves out, the weights are
    the shares of the tokens there are, with which all queues run dry together. A number is the exponent of these
    shares: 1 leaves them, 0 gives all sources the same, what lies between raises the small ones. ``ids`` are the
    piece's token ids.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[source].cast("string").alias("source"), docs[text].alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder, end = TaskContext.get().partitionId(), word_encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        given: dict[str | None, int] = {}
        for batch in batches:
            for some in slices(batch, 2):
                ids = encoder.encode(some.column(2).cast(pa.string()), end)
                sizes, starts = pc.binary_length(ids).to_numpy() // 4, []
                for src, n in zip(some.column(1).to_pylist(), sizes.tolist(), strict=True):
                    starts.append(given.get(src, 0))
                    given[src] = starts[-1] + n
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array([part] * len(some), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), ids],
                    ["doc_id", "source", "part", "local_start", "n", "ids"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    tokens = stored(rows.mapInArrow(encode, f"doc_id {kind}, source string, part int, local_start bigint, n bigint, ids binary"), "packing-tokens")

    parts = stored(tokens.groupBy("source", "part").agg(F.sum("n").alias("n")), "packing-parts")
    sources = parts.groupBy("source").agg(F.sum("n").alias("n"))
    weight, weights = mixture(sources, targets)
    # Quanta sum up to about a window.
    quantum = F.greatest(F.lit(1), F.rint(weight / F.lit(weights) * F.lit(float(window << SHIFT))).cast("long"))
    queues = sources.select("source", "n", quantum.alias("quantum"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    shape = f"doc_id {kind}, source string, " + ", ".join(f"`{c}` {'binary' if c == 'ids' else 'bigint'}" for c in NAMES)
    held = queues.orderBy(F.asc_nulls_first("source")).limit(MAX_QUEUES + 1).collect()
    if len(held) > MAX_QUEUES:
        return by_sort(tokens, offsets, queues, window, shape)

    every = Queues(np.array([r["quantum"] for r in held], np.int64), np.array([r["n"] for r in held], np.int64))
    numbers = spark.createDataFrame([(r["source"], i) for i, r in enumerate(held)], "source string, queue int")
    placed = located(tokens, matched(offsets, F.broadcast(numbers), "source").select("source", "part", "base", "queue"), "queue")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in parts_of(batch):
                q, start, n = (some.column(i).to_numpy() for i in (2, 3, 4))
                row, begin, length, place = every.pieces(q, start, n)
                yield windowed(some.columns[:2], some.column(5), row, begin, length, place, np.zeros(len(n), np.int64), n, window)

    return placed.mapInArrow(cut, shape)


def mixture(sources: DataFrame, targets: dict[str, float] | float | None) -> tuple[Column, float]:
    """The weight of a source in terms of ``source`` and its tokens ``n``, and the sum of all weights."""
    if targets is None or isinstance(targets, float | int):
        weight = F.pow(F.col("n").cast("double"), F.lit(float(1 if targets is None else targets)))
    else:
        named = F.coalesce(F.col("source").isin(list(targets)), F.lit(False))
        free = sources.agg(F.coalesce(F.sum(F.when(~named, F.col("n"))), F.lit(0))).first()[0] or 1
        own = F.lit(0.0)
        for name, share in targets.items():
            own = F.when(F.col("source") == name, F.lit(float(share))).otherwise(own)
        weight = F.when(named, own).otherwise(F.lit(max(0.0, 1.0 - sum(targets.values()))) * F.col("n") / F.lit(free))
    return weight, sources.agg(F.coalesce(F.sum(weight), F.lit(0.0))).first()[0] or 1.0


def matched(rows: DataFrame, made: DataFrame, *keys: str) -> DataFrame:
    """``rows`` joined with ``made`` on ``keys``, of which null equals null."""
    renamed = made.select(*(F.col(c).alias(f"{c}_" if c in keys else c) for c in made.columns))
    fits = F.lit(True)
    for k in keys:
        fits = fits & rows[k].eqNullSafe(F.col(f"{k}_"))
    return rows.join(renamed, fits).drop(*(f"{k}_" for k in keys))


def located(tokens: DataFrame, offsets: DataFrame, *more: str) -> DataFrame:
    """(doc_id, source, *more, start, n, ids): each document's start in its queue. Offsets are broadcast if they are few."""
    if offsets.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    start = (F.col("base") + F.col("local_start")).alias("start")
    return matched(tokens, offsets, "source", "part").select("doc_id", "source", *more, start, "n", "ids")


def by_sort(tokens: DataFrame, offsets: DataFrame, queues: DataFrame, window: int, shape: str) -> DataFrame:
    """The pieces for any number of queues: sorted by (round, queue, position), their places are running sums."""
    placed = located(tokens, matched(offsets, queues, "source").select("source", "part", "base", "quantum"), "quantum")
    kind = placed.schema["doc_id"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in parts_of(batch):
                quantum, start, n = (some.column(i).to_numpy() for i in (2, 3, 4))
                row, rounds, offset, length = turns(quantum, start, n)
                ids, which = some.column(5).cast(pa.binary()), pa.array(row, pa.int32())
                byte = np.frombuffer(ids.buffers()[1], "<i4")[ids.offset : ids.offset + len(ids) + 1]
                ends = np.append(byte[row] + 4 * offset, byte[-1]).astype("<i4")
                cuts = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends.tobytes()), ids.buffers()[2]])
                numbers = [pa.array(x, pa.int64()) for x in (rounds, start[row] + offset, offset, length, n[row])]
                yield pa.RecordBatch.from_arrays([some.column(0).take(which), some.column(1).take(which), *numbers, cuts], ["doc_id", "source", "round", "at", "start", "length", "n", "ids"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, given = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = given + np.cumsum(batch.column("length").to_numpy())
            places = pa.array(ends - batch.column("length").to_numpy())
            given = int(ends[-1]) if len(ends) else given
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(batch), pa.int32()), places], [*batch.schema.names, "part", "place"])

    columns = f"doc_id {kind}, source string, round bigint, at bigint, start bigint, length bigint, n bigint, ids binary"
    order = [F.asc("round"), F.asc_nulls_first("source"), F.asc("at")]
    ranged = placed.mapInArrow(deal, columns).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = stored(ranged.mapInArrow(number, f"{columns}, part int, place bigint"), "packing-pieces")
    # One row for each partition of the sort.
    bases = pieces.groupBy("part").agg(F.sum("length").alias("n")).select(F.col("part").alias("part_"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    whole = pieces.join(F.broadcast(bases), F.col("part") == F.col("part_")).select("doc_id", "source", "start", "length", "n", (F.col("base") + F.col("place")).alias("place"), "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in parts_of(batch):
                start, length, n, place = (some.column(i).to_numpy() for i in (2, 3, 4, 5))
                yield windowed(some.columns[:2], some.column(6), np.arange(len(n)), np.zeros(len(n), np.int64), length, place, start, n, window)

    return whole.mapInArrow(cut, shape)


NAMES = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")
