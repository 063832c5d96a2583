import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from cadenza.llm import importance_resampling


def brute(docs, targets, seed=7, percent=25, min_words=20, buckets=10_000, longest=2):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def grams(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))
        return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = collections.Counter(), collections.Counter()
    for _, text in docs:
        s.update(grams(text)[1])
    for text in targets:
        t.update(grams(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(((t[b] + 1.0) * (all_s + buckets)) / ((s[b] + 1.0) * (all_t + buckets)))) for b in s}
    rows = []
    for k, (i, text) in enumerate(docs):
        words, some = grams(text)
        weight = sum(gain[b] for b in some) // len(some) if some else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(some), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= min_words, k])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1], r[5]))
    rank = {r[5]: n + 1 for n, r in enumerate(able[: len(able) * percent // 100])}
    return collections.Counter((*r[:4], rank.get(r[5])) for r in rows)


def texts(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choices("Alpha béta gamma-ray 2x ÉTÉ the of ÀB x日本 z".split(), k=rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("how", [{}, {"seed": 3, "percent": 60, "min_words": 5, "buckets": 97, "longest": 3}, {"longest": 1, "percent": 100}])
def test_rows_are_those_of_plain_code(spark, how):
    docs = [*enumerate(texts(1, 300)), (None, None), (500, ""), (501, "--- \n"), (502, "one"), (None, texts(2, 1)[0]), (503, "long word " * 30_000)]
    docs += [(7, docs[7][1])] * 5 + [(8, t) for t in texts(9, 3)] + [(None, docs[9][1])] * 2
    targets = [*texts(3, 40), None, "", "long word"]
    frame = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id long, text string, rank int, word string, _row int").repartition(5)
    near = spark.createDataFrame([(t, 5) for t in targets], "text string, gram int")
    got = importance_resampling.resample(frame, near, **how)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert collections.Counter(map(tuple, got.collect())) == brute(docs, targets, **how)


def test_empty_tables(spark):
    docs = [*enumerate(texts(5, 60))]
    frame, none = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert collections.Counter(map(tuple, importance_resampling.resample(frame, none).collect())) == brute(docs, [])
    assert importance_resampling.resample(frame.limit(0), none).count() == 0


def test_ranks_of_many_ties_over_many_partitions(spark):
    """A third of the rows share one text: their scores differ by noise alone, and ranks have no gap."""
    docs = [(i, "same words " * 15 if i % 3 else t) for i, t in enumerate(texts(6, 3000))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(40)
    got = importance_resampling.resample(frame, spark.createDataFrame([("same words",)], "text string"), percent=50)
    rows = got.collect()
    assert collections.Counter(map(tuple, rows)) == brute(docs, ["same words"], percent=50)
    ranks = sorted(r["rank"] for r in rows if r["rank"])
    assert ranks == list(range(1, len(ranks) + 1))


def test_the_plan_has_generated_code_and_no_python(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = importance_resampling.grams(docs.select("doc_id", importance_resampling.words(docs["text"]).alias("words")))._jdf.queryExecution().executedPlan().toString()
    assert "*(1) Generate" in plan and "Python" not in plan and "Arrow" not in plan
