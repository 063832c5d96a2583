"""SimHash near-dedup with multi-index hashing.

A text's fingerprint is the bitwise majority over the XXH64 hashes (seed 42) of its word shingles.
Documents whose fingerprints differ in at most ``DISTANCE`` bits are linked, and the groups are the
connected components.

Equal fingerprints are collapsed first (one row per distinct fingerprint, with map-side combine), so
that a group of exact copies costs one row whatever its size. The distinct fingerprints are matched by
multi-index hashing: the 64 bits are cut into ``SEGMENTS``, each with a radius; since the radii plus one
add up to more than DISTANCE, two fingerprints within DISTANCE differ by no more than the radius in
some segment. Each fingerprint is stored under its segment values and looks up the small Hamming ball
around each of them; a match counts only if the whole fingerprints are within DISTANCE.

A segment value that more than ``HOT`` fingerprints share (near copies come in thousands) would make
pairs by the square: its fingerprints are cut into blocks instead, pairs of blocks are compared in
memory, and only a spanning forest of the links leaves the task. Nothing is capped. The documents of one
fingerprint, and the links of one document, are dealt over many tasks.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; a text of fewer
words than a shingle is one shingle; rows of equal doc_id are one document, linked with all that any of
its texts is linked with; a null doc_id gets the component of its fingerprint and lends it no id (null
if all have none); extra columns are ignored by the functions here; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, met, min_labels

DISTANCE = 4
#: (first bit, bits, radius) of each segment; the radii plus one add up to DISTANCE + 1. The wide segments ask
#: for twelve times as many values, and are taken where the others' values would be shared by too many.
SEGMENTS = ((0, 22, 1), (22, 22, 1), (44, 20, 0))
WIDE_SEGMENTS = ((0, 32, 2), (32, 32, 1))
#: Fingerprints for which SEGMENTS serve: about as many as a segment has values, times HOT / 4.
MANY = 1 << 26
#: Fingerprints under one segment value that are joined row by row, and the size of the blocks beyond.
HOT, BLOCK = 64, 1024
#: Shingles hashed at a time; bounds the memory that a long text takes.
CHUNK = 1 << 16
SEED = 42


def fingerprint(text: bytes, words_per_shingle: int) -> int:
    words = text.lower().split()  # for bytes: A-Z, and the six white-space characters
    if not words:
        return 0
    counts, n, last = np.zeros(64, np.int64), 0, max(1, len(words) - words_per_shingle + 1)
    for at in range(0, last, CHUNK):
        part = words[at : min(at + CHUNK, last) + words_per_shingle - 1]
        if len(part) < words_per_shingle:
            shingles = [b" ".join(part)]
        else:
            shingles = map(b" ".join, zip(*(part[i:] for i in range(words_per_shingle)), strict=False))
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint as a signed 64-bit number."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            found = pa.array([fingerprint(t or b"", words_per_shingle) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["doc_id", "fp"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(each, "doc_id bigint, fp bigint")


def _far(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(reps: DataFrame, distance: int = DISTANCE, segments=SEGMENTS, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that join all ids whose fingerprints are within ``distance``; ``reps`` has fp (distinct) and id."""
    if sum(r + 1 for *_, r in segments) <= distance or sum(w for _, w, _ in segments) != 64:
        raise ValueError("the segments must cover 64 bits, with radii plus one adding up to more than the distance")

    def keys(masks):
        """An array of (segment, value) for each flip in ``masks`` of each segment."""
        values = [
            F.struct(F.lit(i).alias("seg"), F.shiftrightunsigned("fp", at).bitwiseAND((1 << width) - 1).bitwiseXOR(flip).alias("value"))
            for i, (at, width, radius) in enumerate(segments)
            for flip in masks(width, radius)
        ]
        return F.explode(F.array(*values)).alias("k")

    def ball(width: int, radius: int) -> list[int]:
        flips = {0}
        for _ in range(radius):
            flips |= {f ^ (1 << i) for f in flips for i in range(width)}
        return sorted(flips)

    stored = reps.select("fp", "id", keys(lambda *_: [0])).select("k.seg", "k.value", "fp", "id")
    probes = reps.select("fp", "id", keys(ball)).select("k.seg", "k.value", F.col("fp").alias("fp2"), F.col("id").alias("id2"))
    crowded = stored.groupBy("seg", "value").count().where(F.col("count") > hot).select("seg", "value", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    crowded = checkpoint(crowded)
    near = (
        stored.join(crowded, ["seg", "value"], "left_anti")
        .join(probes, ["seg", "value"])
        .where((F.col("fp") < F.col("fp2")) & (_far("fp", "fp2") <= distance))
        .select(F.col("id").alias("a"), F.col("id2").alias("b"))
        .distinct()
    )

    def of(fp: str):
        return F.pmod(F.xxhash64(fp), F.col("blocks")).cast("int")

    held = stored.join(crowded, ["seg", "value"])
    asked = probes.join(crowded, ["seg", "value"])
    sides = held.select("seg", "value", of("fp").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(0).alias("side"), "fp", "id")
    sides = sides.union(
        asked.select("seg", "value", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), of("fp2").alias("j"), F.lit(1).alias("side"), "fp2", "id2")
    )

    def compare(group: pa.Table) -> pa.Table:
        side, fp, ids = (group.column(c).to_numpy() for c in ("side", "fp", "id"))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(right), 2 * block):
            part = right[at : at + 2 * block]
            close = np.bitwise_count((fp[left][:, None] ^ fp[part][None, :]).view(np.uint64)) <= distance
            edges.append(min_labels(close, ids[left], ids[part]))
        a, b = (np.concatenate([e[i] for e in edges]) if edges else np.zeros(0, np.int64) for i in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return near.union(sides.groupBy("seg", "value", "i", "j").applyInArrow(compare, "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, words_per_shingle: int = 4, distance: int = DISTANCE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``; component_id is the smallest doc_id reachable."""
    prints = checkpoint(fingerprints(docs, words_per_shingle, doc_id, text))
    reps = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("id")))
    split = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("doc_id")
    own = prints.join(split, "doc_id", "left_semi").join(reps, "fp").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    segments = SEGMENTS if reps.count() <= MANY else WIDE_SEGMENTS
    found = components(links(reps.where("id is not null"), distance, segments).union(own))
    by_print = reps.join(found, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return met(prints, "fp", "doc_id", by_print).select("doc_id", "fp", "component_id")
