"""Operators that SQL can't express, against brute force."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cadenza.llm import common, embedding_dedup, packing, queries, simhash

SMALL = "doc_id long, text string, source string, extra int"


def groups(ids, pairs):
    """Smallest id reachable, by id."""
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {i: top(i) for i in ids}


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(300, 400)] + [(7, int(x)) for x in rng.integers(8, 250, 200)] + [(int(a), int(b)) for a, b in rng.integers(500, 700, (90, 2))]
    edges = [(int(b), int(a)) if rng.random() < 0.5 else (a, b) for a, b in edges]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges + [(5, None), (None, 6), (9, 9)], "a long, b long")).collect()}
    true = [(a, b) for a, b in edges if a != b]
    assert got == groups({x for e in true for x in e}, true)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_hub_is_dealt_over_parts_and_ends(spark):
    """A root of very many neighbours, and a late smaller root that takes them all."""
    edges = [(5, i) for i in range(10, 3000)] + [(2999, 1)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {1} and len(got) == 2992
    rows = spark.createDataFrame([(1, i) for i in range(2000)] + [(2, 0), (3, 0)], "u long, v long")
    found = common.met(rows, "u", "v", common.least(rows).where("u < 3"))
    assert found.groupBy("u").agg(F.count("*"), F.sum("v"), F.max("m")).sort("u").collect() == [(1, 2000, 1999000, 0), (2, 1, 0, 0)]


def test_shared_folder_is_required_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


# embeddings


def brute_cosines(rows, threshold=0.98):
    pairs, rows = [], [r for r in rows if r["label"] is not None]
    for i, a in enumerate(rows):
        for b in rows[:i]:
            if a["label"] == b["label"] and len(a["embedding"] or []) == len(b["embedding"] or []) and a["vec_id"] != b["vec_id"]:
                x, y = (np.array(r["embedding"], float) if r["embedding"] and None not in r["embedding"] else np.zeros(1) for r in (a, b))
                if np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any() and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    pairs.append((a["vec_id"], b["vec_id"]))
    return pairs


def same_links(found, ids, pairs):
    root = groups(ids, pairs)
    links = dict.fromkeys(ids, 0)
    for pair in pairs:
        for i in pair:
            links[i] += 1
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found.collect()}
    assert got == {i: (links[i], root[i], root[i] == i) for i in ids}


def test_embedding_query_is_brute_force(spark, sf):
    rows = [r.asDict() for r in queries.table(spark, sf, "embeddings").collect()]
    same_links(queries.op3_embedding_dedup(spark, sf), [r["vec_id"] for r in rows], brute_cosines(rows))


@pytest.mark.parametrize("tile", [7, 4096])
def test_embedding_tiles_and_odd_vectors(spark, tile):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(5, 16))
    rows = [(i, [float(x) for x in base[i % 5] + rng.normal(size=16) * (0.05 if i % 3 else 0.3)], 1 if i < 40 else i % 2) for i in range(80)]
    rows += [(100, None, 1), (101, [], 1), (102, [0.0] * 16, 1), (103, [float("nan")] * 16, 1), (104, [None] + [1.0] * 15, 1), (105, [float("inf")] + [1.0] * 15, 1)]
    rows += [(106, rows[0][1], None), (107, rows[0][1][:8], 1), (108, [x * 1e200 for x in rows[0][1]], 1), (109, [x * 1e-200 for x in rows[0][1]], 1)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, tile int")
    as_rows = [{"vec_id": i, "embedding": e, "label": x} for i, e, x in rows]
    as_rows[-2]["embedding"] = as_rows[-1]["embedding"] = rows[0][1]
    same_links(embedding_dedup.near_duplicates(df, tile=tile), [r[0] for r in rows], brute_cosines(as_rows))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_repeated_ids_and_large_group(spark):
    """Rows of one vec_id share a result row, a null vec_id has none, and thousands of equal vectors all link."""
    one, other = [1.0, 2.0, 3.0], [1.0, 2.0, 3.1]
    rows = [(i, one, 1) for i in range(3000)] + [(None, one, 1), (5000, [3.0, 1.0, 0.0], 1), (5000, other, 1), (5000, other, 1)]
    for kind in ("float", "double"):
        got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, f"vec_id int, embedding array<{kind}>, label int"), tile=700).collect()}
        assert len(got) == 3001 and all(r.component_id == 0 and r.kept == (i == 0) for i, r in got.items())
        assert all(r.n_links == 2999 + 2 for i, r in got.items() if i < 3000) and got[5000].n_links == 2 * 3000


def test_quantisation_bound_holds():
    rng = np.random.default_rng(3)
    u = rng.normal(size=(200, 64)) * np.exp(rng.normal(size=(200, 1)))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    codes, scale, e = embedding_dedup.quantised(u)
    near = embedding_dedup.product(codes, codes) * scale[:, None] * scale
    bound = e[:, None] * (1 + e) + e * (1 + e[:, None]) + e[:, None] * e
    assert (np.abs(u @ u.T - near) <= bound + 1e-12).all() and bound.max() < 0.05


# SimHash


def brute_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_query_is_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    prints = {i: brute_fingerprint(t) for i, t in docs.items()}
    ids = sorted(prints)
    root = groups(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op7_simhash_dedup(spark, sf).collect()}
    assert got == {i: (f"{prints[i]:016x}", root[i]) for i in ids}


@pytest.mark.parametrize(("hot", "block", "segments"), [(2, 3, simhash.SEGMENTS), (64, 1024, simhash.SEGMENTS), (64, 1024, simhash.WIDE_SEGMENTS), (2, 3, simhash.WIDE_SEGMENTS)])
def test_all_links_are_found_in_hot_and_cold_segments(spark, hot, block, segments):
    rng = np.random.default_rng(4)
    prints = {int(x) for x in rng.integers(-(2**63), 2**63 - 1, 40)}
    for base in list(prints)[:12]:
        for _ in range(25):
            x = base & (2**64 - 1)
            for bit in rng.integers(0, 64, int(rng.integers(1, 6))):
                x ^= 1 << int(bit)
            prints.add(x - 2**64 if x >= 2**63 else x)
    prints = sorted(prints)
    reps = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fp long, id long")
    pairs = [(i, j) for j, q in enumerate(prints) for i in range(j) if ((prints[i] ^ q) & (2**64 - 1)).bit_count() <= 4]
    got = [(r.a, r.b) for r in simhash.links(reps, segments=segments, hot=hot, block=block).collect()]
    assert groups(range(len(prints)), got) == groups(range(len(prints)), pairs)
    with pytest.raises(ValueError, match="segments"):
        simhash.links(reps, distance=5)


def test_simhash_odd_rows(spark):
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(simhash.CHUNK + 50))
    rows = [(1, None, "a", 0), (2, "", "a", 0), (3, "One two", "a", 0), (4, "one\ttwo ", "a", 0), (5, long, "a", 0), (6, long, "a", 0), (5, "one two", "a", 0), (None, "alone here it is", "a", 0), (9, " \n", "a", 0), (9, " \n", "a", 0)]
    df = spark.createDataFrame(rows, SMALL)
    got = sorted((r.doc_id or -1, r.fp, r.component_id) for r in simhash.near_duplicates(df).collect())
    one, big, zero = (brute_fingerprint(t) for t in ("one two", long, ""))
    sign = lambda x: x - 2**64 if x >= 2**63 else x
    want = [(1, 0, 1), (2, 0, 1), (3, sign(one), 3), (4, sign(one), 3), (5, sign(big), 3), (6, sign(big), 3), (5, sign(one), 3), (-1, sign(brute_fingerprint("alone here it is")), None), (9, zero, 1), (9, zero, 1)]
    assert got == sorted(want, key=lambda x: x[:2])
    assert simhash.near_duplicates(df.limit(0)).count() == 0


# packing


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


def check_packed(rows, docs, window):
    """Every token once, with its checksum; sequences gapless and full but for the last."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == docs.keys()
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(docs[i]))
            at += r.length
            assert r.length > 0 and zlib.crc32(np.array(docs[i][r.start : at], "<u4").tobytes()) == r.ids_crc32
        assert at == len(docs[i])
    filled = {}
    for s, parts in by_sequence.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        filled[s] = at
    assert sorted(filled) == list(range(len(filled)))
    assert all(n == window for s, n in filled.items() if s < len(filled) - 1) and max(filled.values()) <= window


def test_packing_query_is_brute_force(spark, sf):
    """Every token once, and each window but the last ones, in which queues run dry, in the proportions of the exponent."""
    docs = queries.table(spark, sf, "documents").collect()
    ids = dict(zip([r.doc_id for r in docs], ids_of([r.text for r in docs]), strict=True))
    rows = queries.op4_packing(spark, sf).collect()
    check_packed(rows, ids, 4096)
    tokens, share = {}, {}
    for r in docs:
        tokens[r.source] = tokens.get(r.source, 0) + len(ids[r.doc_id])
    for r in rows:
        share.setdefault(r.sequence_id, {}).setdefault(r.source, 0)
        share[r.sequence_id][r.source] += r.length
    weights = {k: n**0.7 for k, n in tokens.items()}
    rounds = min(n / (4096 * weights[k] / sum(weights.values())) for k, n in tokens.items())
    assert rounds > 2
    for s in range(int(rounds) - 1):
        assert all(abs(share[s][k] - 4096 * w / sum(weights.values())) <= len(tokens) for k, w in weights.items()), share[s]


def test_windows_hold_the_target_mixture(spark, sf):
    docs = queries.table(spark, sf, "documents").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 3 == 1, "b").otherwise(F.lit(None)))
    packed = packing.pack(docs.repartition(5), queries.tokenizer_path("word_bpe_49k.json"), window=512, targets={"a": 0.5, "b": 0.2})
    rows = packed.collect()
    texts = docs.collect()
    check_packed(rows, dict(zip([r.doc_id for r in texts], ids_of([r.text for r in texts]), strict=True)), 512)
    share = {}
    for r in rows:
        share.setdefault(r.sequence_id, {}).setdefault(r.source, 0)
        share[r.sequence_id][r.source] += r.length
    left = dict(share[0])
    full = 0
    for s in sorted(share):
        if set(share.get(s + 1, {})) != set(left):  # a queue runs dry in this window
            break
        full += 1
        if full > 1:
            assert all(abs(share[s][k] - 512 * w) <= 3 for k, w in {"a": 0.5, "b": 0.2, None: 0.3}.items()), share[s]
    assert full > 10


def brute_rounds(sizes, targets, window):
    """Deficit round-robin, token by token: where each document's tokens go; ``sizes`` has (source, tokens) in queue order."""
    tokens = {}
    for source, n in sizes:
        tokens[source] = tokens.get(source, 0) + n
    free = sum(n for q, n in tokens.items() if q not in targets)
    weights = {q: targets.get(q) or (1 - sum(targets.values())) * n / free for q, n in tokens.items()}
    quanta = {q: max(1, round(w / sum(weights.values()) * window * 65536)) for q, w in weights.items()}
    queues = {q: [(i, k) for i, (s, n) in enumerate(sizes) if s == q for k in range(n)] for q in tokens}
    out, earned, sent = [], dict.fromkeys(tokens, 0), dict.fromkeys(tokens, 0)
    while len(out) < sum(tokens.values()):
        for q in sorted(tokens, key=lambda q: (q is not None, q or "")):
            earned[q] += quanta[q]
            upto = min(earned[q] // 65536, tokens[q])
            out += queues[q][sent[q] : upto]
            sent[q] = upto
    return {token: at for at, token in enumerate(out)}


@pytest.mark.parametrize("most", [256, 2])
def test_packing_is_deficit_round_robin_for_any_number_of_sources(spark, monkeypatch, most):
    """The same places with the queues in every task and by the sort; equal doc_ids, odd rows and clashing columns too."""
    monkeypatch.setattr(packing, "MAX_QUEUES", most)
    monkeypatch.setattr(packing, "MAX_BROADCAST_ROWS", 100_000 if most == 256 else 1)
    monkeypatch.setattr(packing, "SOME_ROUNDS", 3)
    rows = [(1, None, "a", 0), (2, "", None, 0), (3, "x " * 3000, "b", 0), (4, "<|endoftext|> a b é \x1c z" * 3, "b", 0), (None, "no id", "?", 0), (6, "y" * 5000, "", 0), (7, "again " * 40, "a", 0), (7, "again " * 40, "a", 0), (8, None, "a", 0)]
    rows += [(10 + i, f"w{i} " * (7 * i % 90), f"s{i % 5}", 0) for i in range(60)]
    tokens = ids_of([r[1] for r in rows])
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, start int").coalesce(1)
    path = queries.tokenizer_path("word_bpe_49k.json")
    for targets in ({}, {"b": 0.5, "a": 0.1, "absent": 0.05}):
        places = brute_rounds([(r[2], len(t)) for r, t in zip(rows, tokens, strict=True)], targets, 64)
        got = packing.pack(df, path, window=64, targets=targets or None).collect()
        want = {}
        for i, t in enumerate(tokens):
            for k in range(len(t)):
                want.setdefault((rows[i][0], len(t)), []).append((places[i, k], k))
        have = {}
        for r in got:
            assert 0 < r.length and r.offset + r.length <= 64
            have.setdefault((r.doc_id, r.doc_tokens), []).extend((64 * r.sequence_id + r.offset + x, r.start + x) for x in range(r.length))
        assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
        by_id = {r[0]: t for r, t in zip(rows, tokens, strict=True)}
        assert all(zlib.crc32(np.array(by_id[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in got)
    assert packing.pack(df.limit(0), path).count() == 0


def test_a_full_word_cache_keeps_frequent_words_and_ids(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 8)
    encoder = packing.WordEncoder(queries.tokenizer_path("word_bpe_49k.json"))
    end = np.array([2], "<u4").tobytes()
    asked = 0
    for i in range(40):
        text = f"the word{i} The, other{i * 7} x{i}"
        found = np.frombuffer(encoder.encode(pa.array([text]), end)[0].as_py(), "<u4").tolist()
        assert found == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert len(encoder) <= 4 and len(encoder.older) <= 4
        asked += "the" in encoder or "the" in encoder.older
    assert asked == 40
