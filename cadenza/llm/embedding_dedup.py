"""Embedding near-dedup: int8 tile products with rigorous bounds, exact recomputation at the threshold.

Each unit vector u is quantised once to ``u = s * q + e`` with int8 codes q; its error ``|e|`` is computed, not
assumed. From

    |u.v - s*t*(q.r)| <= |e|(1 + |f|) + |f|(1 + |e|) + |e||f|

a pair is linked if the least cosine that this allows reaches the threshold, and dropped if the greatest
doesn't. Only codes, scales and errors are sent to the tasks that multiply tiles. A task asks for the full vectors of
its rows in pairs between the bounds, and a second pass over these alone decides the pairs in double precision from the vectors as
given: a task asks once for a row, however many such pairs it has. The integer products are exact (codes are multiplied
as float32, sums stay below 2**24 for up to 1040 components; longer vectors are multiplied in parts).

Any two tiles of a label are one task. With few tiles that is all; a vector is sent once for each of them. The vectors of a label of
``CELLS_FROM`` tiles or more are dealt to cells first, each to that of its nearest pivot; the pivots are ``PIVOTS`` different
vectors at most of a length, taken over all labels by hash, whatever the table's size. A vector x of cell a can be near one of cell b only if it lies within the threshold's angle of the great sphere between the two pivots:

    x.(p - q) <= |p - q| sin(arccos(threshold))

so it visits these cells only, and of two cells the one with the greater number. This leaves out no pair. Homes and visitors of a
cell are cut into tiles; home tiles meet each other and those of the visitors, so a label or a cell may hold a third of all rows.
Tiles grow with the label, from ``TILE`` vectors up to ``CELLS`` components. A task returns the number of links of each of its
vectors and a spanning forest of its links, never the pairs, so that a group of thousands of copies stays linear in what is shuffled.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and vectors
with a null label, link with nothing and are kept; vectors of different lengths never link; rows of one
vec_id are vectors of their own that share one result row (links between them are not counted, those to
another row are counted for each); a null vec_id is dropped, as it names no vector; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, met, min_labels, stored

#: Vectors in a tile at least, unless their label has fewer; components in a tile at most; cells of a product
#: computed at a time; pivots at most; and tiles of a label from which cells send fewer copies than all pairs of tiles.
TILE, CELLS, STRIP, PIVOTS, CELLS_FROM = 4096, 1 << 22, 1 << 21, 128, 64


def unit_rows(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and error norms of unit rows."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - scale[:, None] * codes) ** 2).sum(axis=1))
    return codes, scale, error


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 codes, by rows."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], 1024):
        out += a[:, k : k + 1024].astype(np.float32, copy=False) @ b[:, k : k + 1024].astype(np.float32, copy=False).T
    return out


def bounded(qa: tuple, qb: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows' cosines surely reach the threshold, and which may; from (codes, scales, errors) of either side."""
    (ca, sa, ea), (cb, sb, eb) = qa, qb
    near = product(ca, cb)
    near *= sa[:, None]
    near *= sb[None, :]
    slack = ea[:, None] * (1 + eb[None, :]) + eb[None, :] * (1 + ea[:, None]) + ea[:, None] * eb[None, :] + 1e-9
    near -= threshold
    return near >= slack, np.abs(near) < slack


def visits(unit: np.ndarray, pivots: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each unit vector, and the cells of greater number in which it may have a partner."""
    dots = unit @ pivots.T
    home = dots.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0.0))
    ahead = dots[np.arange(len(unit)), home][:, None] - dots
    reach = math.sqrt(1 - threshold * threshold) if threshold > 0 else 1e9
    far = ahead > apart[home] * reach + 1e-9
    return home, ~far & (np.arange(len(pivots))[None, :] > home[:, None])


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _codes(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes as float32, scales, errors) of a group's rows."""
    held = np.frombuffer(b"".join(group.column("code").to_pylist()), np.int8).reshape(group.num_rows, -1)
    return held.astype(np.float32), group.column("scale").to_numpy(), group.column("err").to_numpy()


def coded(usable: DataFrame, threshold: float, cells_from: int = CELLS_FROM) -> DataFrame:
    """The usable vectors with their codes, scales, errors, cells and cells to visit, as a stored table."""
    seen: dict[int, list] = {}
    for (v,) in usable.select("v").orderBy(F.xxhash64("id", "v")).limit(4 * PIVOTS).collect():  # a bounded sample
        of = seen.setdefault(len(v), [])
        if len(of) < PIVOTS and v not in of:
            of.append(v)
    pivots = {dim: unit_rows(np.array(of, float)) for dim, of in seen.items()}

    def code(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            dims = table.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = table.take(np.flatnonzero(dims == dim))
                for at in range(0, part.num_rows, max(1, STRIP // dim)):
                    some = part.slice(at, max(1, STRIP // dim))
                    unit = unit_rows(_matrix(some.column("v"), dim))
                    codes, scale, err = quantised(unit)
                    home, also = np.zeros(len(unit), int), np.zeros((len(unit), 1), bool)
                    if dim in pivots:
                        home, also = visits(unit, pivots[dim], threshold)
                        few = some.column("tiles").to_numpy() < cells_from
                        home[few], also[few] = 0, False
                    binary = pa.BinaryArray.from_buffers(pa.binary(), len(unit), [None, pa.py_buffer(np.arange(0, codes.size + 1, dim, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(codes))])
                    ends = np.concatenate([[0], also.sum(axis=1).cumsum()]).astype(np.int32)
                    others = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(also)[1].astype(np.int32)))
                    made = some.append_column("cell", pa.array(home.astype(np.int32))).append_column("others", others)
                    made = made.append_column("code", binary).append_column("scale", pa.array(scale)).append_column("err", pa.array(err))
                    yield from made.to_batches()

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in usable.schema)
    made = usable.mapInArrow(code, f"{shape}, cell int, others array<int>, code binary, scale double, err double")
    return stored(made.withColumn("row", F.monotonically_increasing_id()), "embedding-codes")


#: What names one task's work: two tiles of the homes of a cell, or one of them and one of its visitors.
ITEM = ["label", "dim", "cell", "own", "i", "j"]


def items(rows: DataFrame) -> DataFrame:
    """Each coded vector with each task in which it is compared, and the side on which it stands there."""
    stay = F.struct(F.col("cell"), F.lit(True).alias("home"))
    there = F.concat(F.array(stay), F.transform("others", lambda c: F.struct(c.alias("cell"), F.lit(False).alias("home"))))
    dealt = rows.withColumn("_at", F.explode(there)).withColumn("cell", F.col("_at.cell")).withColumn("home", F.col("_at.home")).drop("_at", "others")
    place = ["label", "dim", "cell"]
    tiles = lambda home: F.ceil(F.count_if(F.col("home") == home) / F.first("per")).cast("int")
    counts = dealt.groupBy(*place).agg(tiles(True).alias("homes"), tiles(False).alias("guests")).where("homes > 0")
    held = met(dealt, place, "row", counts)
    tile = F.pmod(F.xxhash64("row"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests"))).cast("int")

    def item(own: bool, i, j, side):
        return F.struct(F.lit(own).alias("own"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))

    def upto(n):
        return F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: k < n)

    t = F.col("tile")
    inside = F.transform(upto(F.col("homes")), lambda o: item(True, F.least(t, o), F.greatest(t, o), t > o))
    guests = F.transform(upto(F.col("guests")), lambda k: item(False, t, k, F.lit(0)))
    visit = F.transform(upto(F.col("homes")), lambda o: item(False, o, t, F.lit(1)))
    work = held.withColumn("tile", tile).withColumn("_item", F.explode(F.when(F.col("home"), F.concat(inside, guests)).otherwise(visit)))
    return work.select("label", "dim", "cell", "_item.*", "id", "row", "code", "scale", "err")


def _links(ids: np.ndarray, counts: np.ndarray, edges: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (a, b, n): n links of the vector a, or an edge from a to b with n = 0."""
    seen = np.flatnonzero(counts)
    a, b = (np.concatenate([e[k] for e in edges]) for k in (0, 1))
    return np.concatenate([ids[seen], a]), np.concatenate([ids[seen], b]), np.concatenate([counts[seen], np.zeros(len(a), np.int64)])


def _compared(key: tuple, group: pa.Table, threshold: float, decide) -> tuple:
    """The links that ``decide(left rows, right rows, sure, unsure)`` finds in an item, and the rows in unsure pairs."""
    own, i, j = (k.as_py() for k in key[3:6])
    side, ids = group.column("side").to_numpy(), group.column("id").to_numpy()
    left, same = np.flatnonzero(side == 0), own and i == j
    right = left if same else np.flatnonzero(side == 1)
    counts, open_ = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    edges = [(ids[:0], ids[:0])]
    if len(left) and len(right):
        codes = _codes(group)
        of = lambda at: tuple(x[at] for x in codes)
        step, of_right = max(1, STRIP // len(right)), of(right)
        for at in range(0, len(left), step):
            some = left[at : at + step]
            differ = ids[some][:, None] != ids[right][None, :]
            sure, unsure = (x & differ for x in bounded(of(some), of_right, threshold))
            hit = decide(some, right, sure, unsure)
            counts[some] += hit.sum(axis=1)
            if not same:
                counts[right] += hit.sum(axis=0)
            open_[some] |= unsure.any(axis=1)
            open_[right] |= unsure.any(axis=0)
            edges.append(min_labels(hit, ids[some], ids[right]))
    return _links(ids, counts, edges), open_


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, tile: int = TILE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cells_from: int = CELLS_FROM) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each vector; see the module docstring."""
    kind = vectors.schema[embedding].dataType.simpleString()
    v = vectors[embedding] if kind in ("array<float>", "array<double>") else vectors[embedding].cast("array<double>")
    rows = vectors.select(vectors[vec_id].cast("long").alias("id"), v.alias("v"), vectors[label].alias("label")).where("id is not null")
    ids = rows.select("id").distinct()
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = rows.where(F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))).withColumn("dim", F.size("v"))
    per = F.greatest(F.lit(tile), F.least(F.floor(F.count("*") / 8), F.floor(F.lit(CELLS) / F.col("dim")))).cast("long")
    sizes = usable.groupBy("label", "dim").agg(per.alias("per"), F.ceil(F.count("*") / per).cast("int").alias("tiles"))
    held = coded(usable.join(sizes, ["label", "dim"]), threshold, cells_from)
    key_shape = f"label {held.schema['label'].dataType.simpleString()}, dim int, cell int, own boolean, i int, j int, side int"

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        (a, b, n), unsure = _compared(key, group, threshold, lambda left, right, sure, open_: sure)
        asked = group.filter(unsure).select([*ITEM, "side", "row"])
        links = pa.table({"a": a, "b": b, "n": n})
        return pa.concat_tables([links, asked], promote_options="default").select([*ITEM, "side", "row", "a", "b", "n"])

    def recompute(key: tuple, group: pa.Table) -> pa.Table:
        unit = unit_rows(_matrix(group.column("v"), key[1].as_py()))

        def exact(left: np.ndarray, right: np.ndarray, sure: np.ndarray, unsure: np.ndarray) -> np.ndarray:
            found, (x, y) = np.zeros(unsure.shape, bool), np.nonzero(unsure)
            for at in range(0, len(x), 1 << 16):
                p, q = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
                found[p, q] = np.einsum("ij,ij->i", unit[left[p]], unit[right[q]]) >= threshold
            return found

        (a, b, n), _ = _compared(key, group, threshold, exact)
        return pa.table({"a": a, "b": b, "n": n})

    first = checkpoint(items(held.drop("v", "tiles")).groupBy(*ITEM).applyInArrow(compare, f"{key_shape}, row bigint, a bigint, b bigint, n bigint"))
    asked = first.where("row is not null").select(*ITEM, "side", "row").join(held.select("row", "id", "v", "code", "scale", "err"), "row")
    second = checkpoint(asked.groupBy(*ITEM).applyInArrow(recompute, "a bigint, b bigint, n bigint"))
    found = first.where("a is not null").select("a", "b", "n").union(second)
    counts = found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    groups = components(found.where("a <> b").select("a", "b"))
    return (
        ids.join(counts, "id", "left")
        .join(groups, "id", "left")
        .select(
            F.col("id").alias("vec_id"),
            F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
            (F.coalesce("component", "id") == F.col("id")).alias("kept"),
        )
    )
