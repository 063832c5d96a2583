"""The path-template tree over paths of mixed and great depth, against a tree of plain Python."""

import collections
import math
import random
import re

import pytest

from cadenza.llm import url_filter


def brute(paths, children=20, z=1.96, weight=10.0):
    """(template, purity) of one host's (path, bad) pages; paths are templates already."""
    counts = collections.defaultdict(lambda: [0, 0])
    for p, bad in paths:
        counts[p][0] += bad is not None
        counts[p][1] += bad or 0
    merged = {p: "" for p in counts}
    for i in range(1, max(p.count("/") for p in counts) + 1):
        below = collections.defaultdict(set)
        for p in counts:
            if p.count("/") >= i:
                below[merged[p]].add(p.split("/")[i])
        step = {}
        for p in counts:
            if p.count("/") >= i:
                seg = p.split("/")[i]
                wide = len(below[merged[p]]) > children and seg
                step[p] = f"{merged[p]}/" + ("*" + re.search(r"(\.[A-Za-z]+)?$", seg)[0] if wide else seg)
        merged |= step
    sums = collections.defaultdict(lambda: [0, 0])
    for p, (n, bad) in counts.items():
        segs = merged[p].split("/")
        for k in range(1, len(segs) + 1):
            sums["/".join(segs[:k]), k][0] += n
            sums["/".join(segs[:k]), k][1] += bad

    def alone(segs, k):
        (n, bad), (pn, pbad) = sums["/".join(segs[:k]), k], sums["/".join(segs[: k - 1]), k - 1]
        if not n or pn == n or not 0 < pbad < pn:
            return False
        return abs(bad / n - (pbad - bad) / (pn - n)) / math.sqrt(pbad / pn * (1 - pbad / pn) * (1 / n + 1 / (pn - n))) > z

    prior = sum(b for _, b in counts.values()) / max(1, sum(n for n, _ in counts.values()))
    made = {}
    for p in counts:
        segs = merged[p].split("/")
        k = next((k for k in range(len(segs), 1, -1) if alone(segs, k)), 1)
        n, bad = sums["/".join(segs[:k]), k]
        made[p] = merged[p], (bad + weight * prior) / (n + weight)
    return made


def check(spark, paths):
    pages = spark.createDataFrame([(i, f"http://h.io{p}") for i, (p, _) in enumerate(paths)], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(paths)], "page_id long, bad int")
    want = brute(paths)
    got = url_filter.judge(pages, {}, labels).collect()
    assert len(got) == len(paths)
    for r in got:
        template, purity = want[r.path]
        assert r.template == template and r.purity == pytest.approx(purity, abs=1e-12), r.path
        assert r.verdict == ("block" if purity > 0.5 else "allow")
    return {r.path: r.verdict for r in got}


@pytest.mark.parametrize("seed", range(3))
def test_random_paths_of_mixed_depth(spark, seed):
    rng = random.Random(seed)
    names = ["".join(rng.choices("abcdefgh", k=3)) + rng.choice(["", "", ".html", ".p"]) for _ in range(40)]
    rows = []
    for _ in range(1500):
        depth = rng.choice([0, 1, 1, 2, 3, 5, 9])
        path = "".join("/" + rng.choice(names[: rng.choice([2, 6, 40])]) for _ in range(depth)) + rng.choice(["", "", "/"])
        bad = rng.random() < (0.8 if "/" + names[0] in path else 0.1)
        rows.append((path, rng.choice([None, int(bad)])))
    check(spark, rows)


def test_a_page_beside_a_deeper_folder_is_judged_with_it(spark):
    rows = [(f"/a/b/{c}", 1) for c in "abcdefghij" for _ in range(10)] + [("/docs/" + c, 0) for c in "abcdefghij" for _ in range(100)] + [("/a/x", None), ("/a/b/z", None)]
    got = check(spark, rows)
    assert got["/a/x"] == got["/a/b/z"] == "block" and got["/docs/a"] == "allow"


def test_forty_levels_and_branches_below_them(spark):
    deep = "/d" * 40
    words = [x + y for x in "abcdefg" for y in "abcdefg"]
    rows = [(f"{deep}/{w}/{v}", 1) for w in words for v in words[:3]] + [("/good/" + w, 0) for w in words for _ in range(9)] + [(deep + "/q/q/q", None), ("/z" * 45, None)]
    got = check(spark, rows)
    assert got[deep + "/q/q/q"] == "block" and got["/good/aa"] == "allow"


def test_a_host_that_is_bad_throughout_judges_its_deep_pages(spark):
    check(spark, [(f"/p/{w}", 1) for w in "abcdefghijklmnopqrstuvwxyz"] + [("/x" * 300, None), ("", None), ("/", None), ("//", None)])
