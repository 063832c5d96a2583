import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza.llm import queries, quality_classifier as q

WORDS = "river stone quiet morning under light walked slowly toward garden where people spoke about weather".split()


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n)).capitalize() + "."


def junk(rng, n):
    return " ".join(rng.choice(WORDS).upper() + rng.choice(["!!", "$$$", "&&&"]) for _ in range(n))


def corpus(seed, n=600):
    """Good texts are prose throughout; bad ones have one bad passage in some, wherever it is."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        parts = [prose(rng, 64) for _ in range(rng.randrange(1, 6))]
        good = rng.random() < 0.6
        if not good:
            parts[rng.randrange(len(parts))] = junk(rng, 64)
        rows.append((i, "\n".join(parts), int(good)))
    return rows


def sizes_and_features(rows):
    made = q.encode(pa.array([r[1] for r in rows]))
    return np.diff(made.starts), made


def test_gradients_are_the_derivatives_of_the_loss():
    rng = np.random.default_rng(0)
    x, starts, y = rng.normal(size=(9, q.WIDTH)) / 5, np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    p = q.start(rng)
    p["b"], p["v"], p["u"] = (rng.normal(size=p[k].shape) for k in "bvu")
    _, g = q.gradients(p, x, starts, y)
    for k, v in p.items():
        for at in [tuple(rng.integers(0, s) for s in v.shape) for _ in range(8)]:
            ends = []
            for step in (1e-5, -2e-5):
                v[at] += step
                ends.append(q.gradients(p, x, starts, y)[0])
            v[at] += 1e-5
            assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(g[k][at], rel=1e-3, abs=1e-8), k


def test_passages_are_encoded_alike_however_they_are_cut():
    rng = random.Random(2)
    texts = [None, "", "  \n", "one", prose(rng, 64), prose(rng, 65), "\t" + prose(rng, 1000) + "\n\n", "é " * 700, "x" * 5000, prose(rng, 64 * 5) + " ", "\x00 \x1c a"]
    whole = q.encode(pa.array(texts))
    assert np.diff(whole.starts).tolist() == [1, 1, 1, 1, 1, 2, 16, 11, 1, 5, 1]
    for size in (1, 700, 5000, 1 << 20):
        some = list(q.parts(pa.array(texts), size))
        assert sum(n for _, n in some) == len(texts)
        assert np.array_equal(np.concatenate([p.features for p, _ in some]), whole.features)
    alone = [q.encode(pa.array([t])).features for t in texts]
    assert np.array_equal(np.concatenate(alone), whole.features)
    assert q.encode(pa.array([], pa.string())).features.shape == (0, q.WIDTH)


def test_measures_of_a_passage():
    m = q.encode(pa.array(["aa bb aa cc aa"])).features[0]
    assert m[:6] == pytest.approx([np.log(6), np.log(16), 0.2, 0, 3 / 5, 3 / 5], abs=1e-6)


def test_attention_finds_the_bad_passage_of_held_out_documents():
    train, held = corpus(1), corpus(2)
    sizes, made = sizes_and_features(train)
    model = q.fit(made.features, sizes, np.array([r[2] for r in train]))
    sizes, made = sizes_and_features(held)
    h = model.hidden(made.features)
    right = (model.scores(h, made.starts) >= 0.5) == np.array([r[2] for r in held])
    assert right.mean() > 0.97
    # The gate weighs the bad passage above the good ones of its document.
    e, found = model.attention(h), []
    for k, (_, text, good) in enumerate(held):
        if not good and sizes[k] > 1:
            found.append(int(np.argmax(e[made.starts[k] : made.starts[k + 1]])) == next(i for i, part in enumerate(text.split("\n")) if part.isupper()))
    assert len(found) > 100 and np.mean(found) > 0.9


def test_rows_have_the_scores_of_the_model_and_odd_rows_too(spark):
    rows = corpus(3, 200)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 4] + [(1, None), (None, 0), (999, 1)], "doc_id long, label int")
    odd = [(None, "no id"), (1000, None), (1001, ""), (1002, " \n"), (5, "repeated id"), (5, "repeated id"), (1003, "word " * 50_000), (1004, "x" * 100_000)]
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t in [r[:2] for r in rows] + odd], "doc_id long, text string, score double, label int").repartition(7)
    model = q.learn(docs, labels, F.col("doc_id") % 4 != 0)
    again = q.learn(docs.repartition(2), labels, F.col("doc_id") % 4 != 0)
    assert all(np.array_equal(model.weights[k], again.weights[k]) for k in model.weights)
    got = q.score(docs, model).collect()
    assert len(got) == len(rows) + len(odd) and {r.predicted for r in got} == {0, 1}
    by = {(r.doc_id, round(r.score, 9)) for r in got}
    for i, t in [r[:2] for r in rows] + odd:
        p = q.encode(pa.array([t], pa.string()))
        assert (i, round(float(model.scores(model.hidden(p.features), p.starts)[0]), 9)) in by
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert q.score(docs.limit(0), model).count() == 0


def test_bounds_of_learning_and_labels_of_one_kind(spark):
    rows = corpus(4, 120)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, label int")
    assert q.learn(docs, labels, F.lit(True), max_documents=50, max_passages=2).constant is None
    one = q.learn(docs, labels.where("label = 1"), F.lit(True))
    assert one.constant > 0.95 and {r.predicted for r in q.score(docs, one).collect()} == {1}
    none = q.learn(docs, labels, F.lit(False))
    assert {(r.score, r.predicted) for r in q.score(docs, none).collect()} == {(0.5, 0)}


def test_held_out_documents_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op13_quality_classifier(spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    labels = [(r.doc_id, r.quality) for r in queries.table(spark, sf, "labels").collect() if got[r.doc_id].held_out]
    assert np.mean([got[i].predicted == y for i, y in labels]) > 0.95
