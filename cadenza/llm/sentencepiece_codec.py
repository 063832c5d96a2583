"""SentencePiece encoding and decoding with source alignment.

A text is normalised by longest prefix through the model's compiled character map (a double-array trie
of byte strings and the strings they become), while the source offset of every normalised character is
recorded. Byte-pair merges then give the pieces, and each piece is projected to the bytes of the text
that it stands for: piece k covers ``[end of piece k-1, end of piece k)``, the first from ``start``. A
character that falls back to bytes is covered by its last byte piece, the others being empty.

No piece of a model of words has a blank after another character, so no merge crosses from a word to
the next blank, and a normalised text is encoded unit by unit (blanks and the word after them). Where the
map has no entries a text can be split before it is normalised, and the ids and ends of units seen before
come from a bounded cache, which is what makes the scan fast. A model with such pieces is encoded as one unit.

Defined cases: a null text counts as empty and has no pieces; rows are encoded one by one, so repeated
rows and ids don't matter; a lone surrogate can't occur in Spark strings; extra columns are ignored; an
empty table gives an empty table. Texts are encoded whole, however long.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHE_UNITS, CACHE_CHARS = 1_000_000, 64
#: Characters of a unit in which the best pair is looked for by a scan.
SHORT = 64
#: The score of a pair that isn't a piece.
NONE = float("-inf")


def _fields(raw: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = raw[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ((8 if kind == 1 else 4), at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


class CharsMap:
    """The compiled character map: longest-prefix replacement of byte strings."""

    def __init__(self, compiled: bytes) -> None:
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.strings = compiled[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest known prefix of ``text[at:]`` and the prefix's length."""
        if not self.units:
            return None
        units, found = self.units, None
        node = _offset(units[0])
        for k in range(at, len(text)):
            node ^= text[k]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != text[k]:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:
                found = (units[node] & 0x7FFFFFFF, k + 1 - at)
        if not found:
            return None
        value, length = found
        return self.strings[value : self.strings.index(0, value)], length


def _offset(unit: int) -> int:
    return unit >> 10 << ((unit & 0x200) >> 6)


class Codec:
    """Encoder of one model."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            raw = f.read()
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids, self.unknown, n = {}, 0, 0
        reserved: dict[str, int] = {}
        self.user: list[str] = []
        normaliser: dict = {}
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                name, kind = piece[1].decode(), piece.get(3, NORMAL)
                if kind in (NORMAL, USER):
                    self.ids[name], self.scores[name] = n, struct.unpack("<f", piece[2])[0]
                    if kind == USER:
                        self.user.append(name)
                elif kind == UNUSED:
                    raise ValueError("models with unused pieces aren't supported")
                elif kind == BYTE:
                    self.byte_ids[int(name[3:5], 16)] = n
                else:
                    reserved[name] = n
                    self.unknown = n if kind == UNKNOWN else self.unknown
                n += 1
            elif number == 2:
                kind = dict(_fields(value)).get(3, 1)
                if kind != 2:
                    raise ValueError("only byte-pair models are supported")
            elif number == 3:
                normaliser = dict(_fields(value))
        if self.user:
            raise ValueError("models with user-defined pieces aren't supported")
        self.final = self.ids | reserved
        self.map = CharsMap(normaliser.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(normaliser.get(k, 1)) for k in (3, 4, 5))
        self.by_units = not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.ids)
        self.plain = not self.map.units and not self.squeeze and self.escape and self.prefix and self.by_units
        self.cache = Units(self)

    def normalise(self, text: str) -> tuple[str, list[int]]:
        """The normalised text, and the source byte offset of each of its characters and of its end."""
        blank = BLANK if self.escape else " "
        if text and not self.map.units and not self.squeeze:  # every prefix is one character, which stays
            starts = range(len(text) + 1) if text.isascii() else itertools.accumulate((len(c.encode()) for c in text), initial=0)
            return blank * self.prefix + text.replace(" ", blank), [0] * self.prefix + list(starts)
        raw, at, out, source = text.encode(), 0, [], []

        def prefix(at: int) -> tuple[str, int]:
            found = self.map.longest(raw, at)
            if found:
                return found[0].decode(errors="replace"), found[1]
            head = raw[at]
            size = 1 if head < 0x80 else 2 if head < 0xE0 else 3 if head < 0xF0 else 4
            return raw[at : at + size].decode(errors="replace"), size

        if self.squeeze:  # blanks at the start go
            while at < len(raw):
                shown, size = prefix(at)
                if shown != " ":
                    break
                at += size
        if at == len(raw):
            return "", [at]
        if self.prefix:
            out.append(blank)
            source.append(at)
        after_blank = self.squeeze
        while at < len(raw):
            shown, size = prefix(at)
            if after_blank:
                shown = shown.lstrip(" ")
            for c in shown:
                out.append(blank if c == " " else c)
                source.append(at)
            if shown:
                after_blank = self.squeeze and shown[-1] == " "
            at += size
        if self.squeeze:
            while out and out[-1] == blank:
                out.pop()
                at = source.pop()
        return "".join(out), [*source, at]

    def merged(self, text: str) -> list[str]:
        """Byte-pair pieces: the best-scored pair is merged first, the leftmost of equals."""
        pieces = list(text)
        if len(pieces) > SHORT:
            return self.merged_long(pieces)
        score = self.scores.get
        best = [score(a + b, NONE) for a, b in itertools.pairwise(pieces)]
        while best and (top := max(best)) != NONE:
            i = best.index(top)
            whole = pieces[i] + pieces.pop(i + 1)
            pieces[i] = whole
            del best[i]
            if i:
                best[i - 1] = score(pieces[i - 1] + whole, NONE)
            if i < len(best):
                best[i] = score(whole + pieces[i + 1], NONE)
        return pieces

    def merged_long(self, pieces: list[str | None]) -> list[str]:
        """The same with a heap of pairs, for units in which a scan for the best one takes too long."""
        n = len(pieces)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0:
                whole = pieces[i] + pieces[j]
                score = self.scores.get(whole)
                if score is not None:
                    heapq.heappush(heap, (-score, i, j, whole))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, whole = heapq.heappop(heap)
            if pieces[i] is None or pieces[j] is None or after[i] != j or pieces[i] + pieces[j] != whole:
                continue
            pieces[i], pieces[j] = whole, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in pieces if p is not None]

    def unit(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a normalised unit, and the number of its characters up to the end of each piece."""
        ids, ends, at, lost = [], [], 0, False
        final = self.final
        for piece in self.merged(text):
            known = final.get(piece)
            if known is not None and known != self.unknown:
                ids.append(known)
                ends.append(at + len(piece))
            elif self.byte_ids:
                raw = piece.encode()
                ids += [self.byte_ids[b] for b in raw]
                ends += [at] * (len(raw) - 1) + [at + len(piece)]
            elif lost:
                ends[-1] = at + len(piece)
            else:
                ids.append(self.unknown)
                ends.append(at + len(piece))
            lost = known is None and not self.byte_ids
            at += len(piece)
        return ids, ends

    def encode(self, text: str) -> tuple[np.ndarray, int, np.ndarray]:
        """(ids, start, ends): the pieces, the source byte before the first, and that after each."""
        if not text:
            return np.zeros(0, np.int32), 0, np.zeros(0, np.int32)
        if self.plain and BLANK not in text:
            names = text.split(" ")
            if "" in names:
                names = [u[1:] for u in re.findall(" +[^ ]*", " " + text)]
            units = [self.cache[u] for u in names]
            pieces = np.fromiter(map(len, units), np.int64, len(units)) // 8
            both = np.frombuffer(b"".join(units), "<i4")
            first = np.repeat(np.tile([True, False], len(units)), np.repeat(pieces, 2))
            ids, ends = both[first], both[~first]
            # A unit's word begins after its blank, but that of the first one isn't in the text; its last piece ends it.
            sizes = ends[np.cumsum(pieces) - 1].astype(np.int64) + 1
            return ids, 0, ends + np.repeat(np.cumsum(sizes) - sizes, pieces).astype(np.int32)
        shown, source = self.normalise(text)
        units = re.findall(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+", shown) if self.by_units and self.escape else [shown]
        ids, ends, at = [], [], 0
        for u in units:
            some, places = self.unit(u)
            ids += some
            ends += [source[at + p] for p in places]
            at += len(u)
        return np.array(ids, np.int32), source[0], np.array(ends, np.int32)


class Units(dict):
    """A unit's ids and then the source bytes up to each one's end, as little-endian int32.

    A unit is named by its text without the blank before it; the ends count from after that blank."""

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec = codec

    def __missing__(self, unit: str) -> bytes:
        shown, source = self.codec.normalise(unit) if unit else (BLANK, [0, 0])
        ids, places = self.codec.unit(shown)
        made = struct.pack(f"<{2 * len(ids)}i", *ids, *[source[p] for p in places])
        if len(unit) <= CACHE_CHARS and len(self) < CACHE_UNITS:
            self[unit] = made
        return made


@functools.lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    """The codec that this worker process keeps, with its cache."""
    return Codec(path)


def _arrays(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int32), pa.int32()))


def encode(docs: DataFrame, model: str, decoded: bool = False, doc_id: str = "doc_id", text: str = "text", rows: int = 64) -> DataFrame:
    """(doc_id, ids, start, ends[, decoded]) for each row; ``decoded`` is the library's decode of the ids."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, back = codec_of(model), _decoder(model) if decoded else None
        for batch in batches:
            for at in range(0, len(batch), rows):
                some = batch.slice(at, rows)
                ids, starts, ends = zip(*(codec.encode(t or "") for t in some.column(1).to_pylist()), strict=True)
                columns = [some.column(0), _arrays(list(ids)), pa.array(starts, pa.int64()), _arrays(list(ends))]
                if back:
                    columns.append(pa.array([back(i.tolist()) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "start", "ends", "decoded"][: len(columns)])

    kind = docs.schema[doc_id].dataType.simpleString()
    shape = f"doc_id {kind}, ids array<int>, start bigint, ends array<int>" + ", decoded string" * decoded
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(each, shape)


def _decoder(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model).decode


def decode(encoded: DataFrame, model: str, ids: str = "ids", rows: int = 64) -> DataFrame:
    """``encoded`` with the text that its ``ids`` decode to as ``decoded``; null ids give null."""
    names = [c for c in encoded.columns if c.lower() != "decoded"]
    shape = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = _decoder(model)
        for batch in batches:
            for at in range(0, len(batch), rows):
                some = batch.slice(at, rows)
                texts = [back(i) if i is not None else None for i in some.column(names.index(ids)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    return encoded.select(*names).mapInArrow(each, f"{shape}, decoded string")
