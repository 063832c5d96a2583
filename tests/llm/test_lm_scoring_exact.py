import collections
import math

import numpy as np
import pytest

from cadenza.llm import lm_scoring, queries


def exact_scores(rows, targets):
    """Per row: tokens and both losses, by plain counting of the words and bigrams of the other rows."""
    texts = [(i, (t or "").encode().lower().split()) for i, t in rows]
    size = len({w for _, ws in texts for w in ws}) + 2

    def counts(ws):
        pairs = list(zip([b"", *ws[:-1]], ws, strict=True)) if ws else []
        return collections.Counter(ws), collections.Counter(a for a, _ in pairs), collections.Counter(pairs)

    own = [counts(ws) for _, ws in texts]
    models = []
    for mine in (True, False):
        uni, ctx, bi = collections.Counter(), collections.Counter(), collections.Counter()
        for (i, _), some in zip(texts, own, strict=True):
            if not mine or i in targets:
                for whole, part in zip((uni, ctx, bi), some, strict=True):
                    whole.update(part)
        models.append((uni, ctx, bi, sum(uni.values())))

    def loss(ws, some, learnt, uni, ctx, bi, total):
        total -= learnt * len(ws)
        if not total:
            return math.log(size)
        made = 0.0
        for a, b in zip([b"", *ws[:-1]], ws, strict=True):
            one, seen, both = uni[b] - learnt * some[0][b], ctx[a] - learnt * some[1][a], bi[a, b] - learnt * some[2][a, b]
            made -= math.log(0.6 * (both / seen if seen else one / total) + 0.3 * one / total + 0.1 / size)
        return made / len(ws)

    return [(i, len(ws), *(loss(ws, some, learnt, *m) if ws else None for m, learnt in zip(models, (i in targets, True), strict=True))) for (i, ws), some in zip(texts, own, strict=True)]


def check(spark, rows, targets, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i,) for i in targets], "doc_id int")
    got = lm_scoring.score(docs, marks, **how).select("doc_id", "n_tokens", "target_loss", "background_loss").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3] or 0)
    want = exact_scores(rows, {i for i in targets if i is not None})
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:2] == w[:2] and g[2:] == (w[2:] if w[2] is None else pytest.approx(w[2:], rel=1e-9))


def test_every_word_and_bigram_counts(spark):
    """More words than any fixed vocabulary of 50,000 holds: none may fall together."""
    rows = [(i, " ".join(f"w{(i * 131 + j * j) % 70_000}" for j in range(400))) for i in range(900)]
    assert len({w for _, t in rows for w in t.split()}) > 50_000
    check(spark, rows, range(0, 900, 3), group_bytes=300_000)


def test_defined_cases(spark):
    rows = [(1, "a b a b c"), (1, "A b\tc"), (1, "a b a b c"), (None, "a b"), (2, None), (3, " "), (4, "b"), (5, "x y z x y")]
    for size in (1, 10, 1000):
        check(spark, rows, [1, 1, None, 77], group_bytes=size)
        check(spark, rows, [], group_bytes=size)
    check(spark, [], [1], group_bytes=10)


def test_documents_are_scored_exactly(spark, sf):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    check(spark, rows, range(0, len(rows), 2), group_bytes=60_000)


def test_long_texts_extra_columns_and_repeats(spark):
    """A text of many groups' size stays whole; columns with the operator's own names don't matter; repeated rows are rows."""
    long = " ".join(f"w{(j * j) % 971}" for j in range(60_000))
    rows = [(1, long, 5, "x", True), (2, "w1 w4 w9 w16", 6, "y", False), (2, "w1 w4 w9 w16", 6, "y", False), (3, "\x1c w1\x0bw4", 7, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _group int, n_tokens string, _mark boolean")
    got = lm_scoring.score(docs, spark.createDataFrame([(2,)], "doc_id long"), group_bytes=1000)
    assert got.columns == ["doc_id", "n_tokens", "target_loss", "background_loss", "score"]
    want = exact_scores([r[:2] for r in rows], {2})
    for g, w in zip(sorted(map(tuple, got.collect())), sorted(want), strict=True):
        assert g[:2] == w[:2] and g[2:4] == pytest.approx(w[2:], rel=1e-9) and g[4] == pytest.approx(w[2] - w[3], abs=1e-9)


def test_a_text_is_not_its_own_model(spark):
    """A text that no other row repeats has the losses of unseen words, target or not; one that occurs twice hasn't."""
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f"), (3, "d e f"), (4, "g h i")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scoring.score(docs, spark.createDataFrame([(1,)], "doc_id long")).collect()}
    assert got[1].background_loss == pytest.approx(math.log(11 / 0.1)) and got[4].target_loss == pytest.approx(math.log(11 / 0.1))
    assert got[2].background_loss < got[1].background_loss - 3


def test_packed_counts_and_keys():
    rng = np.random.default_rng(0)
    for top in (1, 200, 70_000, 2**40):
        counts = rng.integers(0, top, 999)
        assert (lm_scoring.unpacked(lm_scoring.packed(counts)) == counts).all()
    keys = np.unique(rng.integers(0, 2**64 - 1, 5000, np.uint64))
    at = lm_scoring.bounds(keys, 7)
    assert at[0] == 0 and at[-1] == len(keys) and (np.diff(at) > 500).all()
    for a, b in zip(at, at[1:]):
        assert (lm_scoring.unpacked_keys(lm_scoring.packed_keys(keys[a:b])) == keys[a:b]).all()
    assert len(lm_scoring.unpacked_keys(lm_scoring.packed_keys(keys[:0]))) == 0 and len(lm_scoring.unpacked(lm_scoring.packed(np.zeros(0, int)))) == 0
