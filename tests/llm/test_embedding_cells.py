"""Cells and codes of op3: no link is lost between cells, near the threshold or in a crowd, and few copies are sent."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import embedding_dedup as E


def brute(x, labels, threshold=0.98):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = (u @ u.T >= threshold) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(hit, False)
    return hit


def frame(spark, x, labels):
    return spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, labels, strict=True))], "vec_id long, embedding array<double>, label int")


def rows(found):
    return {r.vec_id: (r.n_links, r.component_id) for r in found.collect()}


def expected(hit):
    root = np.arange(len(hit))
    while True:
        least = np.minimum(root, np.where(hit, root[None, :], len(hit)).min(axis=1))
        if (least == root).all():
            return {i: (int(hit[i].sum()), int(root[i])) for i in range(len(hit))}
        root = least


def test_visits_leave_no_near_pair_out():
    rng = np.random.default_rng(5)
    x = E.unit_rows(rng.normal(size=(3000, 6)))
    for threshold in (0.98, 0.9, 0.3, -0.2):
        home, also = E.visits(x, x[:40], threshold)
        a, b = np.nonzero(x @ x.T >= threshold)
        low = home[a] < home[b]
        assert also[a[low], home[b[low]]].all() and low.any()
        assert not also[np.arange(len(x)), home].any()


@pytest.mark.parametrize("tile, cells_from", [(20, 2), (150, 2), (100, 64)])
def test_links_across_cells_and_tiles(spark, tile, cells_from):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1200, 5))
    labels = np.where(np.arange(1200) < 1000, 1, 2)
    hit = brute(x, labels)
    home, _ = E.visits(E.unit_rows(x), E.unit_rows(x[:64]), 0.98)
    assert (home[np.nonzero(hit)[0]] != home[np.nonzero(hit)[1]]).sum() > 50
    assert rows(E.near_duplicates(frame(spark, x, labels), tile=tile, cells_from=cells_from)) == expected(hit)


def test_a_crowd_around_the_threshold(spark):
    """A third of the rows are copies with noise whose cosines lie on both sides of 0.98, most within the codes' error."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 64))
    x[:500] = x[0] + rng.normal(size=(500, 64)) * 0.142
    hit = brute(x, labels := np.ones(1500))
    assert 0.1 < hit[:500, :500].mean() < 0.9
    assert rows(E.near_duplicates(frame(spark, x, labels), tile=100, cells_from=2)) == expected(hit)


@pytest.mark.parametrize("spread, most", [(None, 60), (0.5, 20)])
def test_copies_of_a_label_of_a_hundred_tiles(spark, spread, most):
    """Without cells each vector is sent 100 times; vectors without any grouping are the worst case of pivots."""
    rng = np.random.default_rng(8)
    x, tile = rng.normal(size=(5000, 64)), 50
    if spread:
        x = rng.normal(size=(100, 64))[np.arange(5000) % 100] + spread * x
    held = frame(spark, x, np.ones(5000)).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label", F.lit(64).alias("dim"), F.lit(tile).alias("per"), F.lit(100).alias("tiles"))
    work = E.items(E.coded(held, 0.98).drop("v", "tiles"))
    sides = work.groupBy(*E.ITEM, "side").count()
    copies = work.count() / 5000
    print("copies", copies)
    assert copies < most and sides.agg(F.max("count")).first()[0] < 3 * tile
