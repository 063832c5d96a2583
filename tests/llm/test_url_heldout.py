"""Verdicts of the path-template tree on pages whose labels it hasn't seen."""

import random

from cadenza.llm import url_filter


def site(seed, pages=1500):
    """Pages of two hosts: galleries are bad nine times of ten, articles and shops once in twenty, whatever their names."""
    rng, rows = random.Random(seed), []
    for i in range(pages):
        host, name, slug = f"h{rng.randrange(2)}.com", "n" + "".join(rng.choices("abcdefghij", k=6)), "".join(rng.choices("abcdefghij", k=8))
        gallery = rng.random() < 0.3
        path = f"/gallery/{name}/{slug}" if gallery else rng.choice([f"/articles/{slug}.html", f"/shop/{rng.randrange(10**6)}/{slug}"])
        rows.append((i, f"https://{host}{path}", gallery, int(rng.random() < (0.9 if gallery else 0.05))))
    return rows


def test_held_out_pages_of_bad_templates_are_blocked_and_others_are_not(spark):
    rows = site(7)
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id bigint, url string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows if r[0] % 3], "page_id bigint, bad int")
    verdicts = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, {}, labels).collect()}
    held_out = [r for r in rows if r[0] % 3 == 0]
    assert all((verdicts[i] == "block") == gallery for i, _, gallery, _ in held_out)
    right = sum((verdicts[i] == "block") == bool(bad) for i, _, _, bad in held_out) / len(held_out)
    assert right > 0.9


def test_labels_that_tell_nothing_of_the_path_block_nothing(spark):
    rng = random.Random(3)
    rows = site(3)
    labels = spark.createDataFrame([(r[0], int(rng.random() < 0.15)) for r in rows], "page_id bigint, bad int")
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id bigint, url string")
    assert {r["verdict"] for r in url_filter.judge(pages, {}, labels).select("verdict").distinct().collect()} == {"allow"}
