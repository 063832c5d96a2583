import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from cadenza.llm import fill_in_middle


def brute(doc_id, text, seed=1, plain=10, spm=20, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.ASCII)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in marks) or h3 % 100 >= 100 - plain:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    psm = h4 % 100 >= spm
    made = marks[0] + p + marks[1] + s + marks[2] + m if psm else marks[1] + s + marks[0] + p + marks[2] + m
    return len(units), "psm" if psm else "spm", len(p), len(m), made


TEXTS = [None, "", " ", "a", "é🙂ab  c\n\n\tD9", "x <P> y", "x<S", "<<M>>", "<P", "P><S><M", "a\x00b\x00", "it's 'quoted' @SEED@ @P@", "🤦🏼‍♂️ é", "word " * 40_000, "7" * 30_000]


@pytest.mark.parametrize(("piece", "how"), [(4 << 20, {}), (1, {}), (64, {"seed": 5, "plain_percent": 50, "spm_percent": 50, "marks": ("[a']", "[b]", "[c]")})])
def test_rows_are_those_of_plain_code(spark, piece, how):
    rng = random.Random(4)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, t) for t in TEXTS] + [(3, "repeated id"), (3, "repeated id")]
    rows += [(100 + i, "".join(rng.choices("abZ é<PSM>\n", k=rng.randrange(30)))) for i in range(400)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, form string, units int")
    made = fill_in_middle.transform(docs, piece_bytes=piece, **how)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    names = dict(zip(("seed", "plain", "spm", "marks"), (how.get(k) for k in ("seed", "plain_percent", "spm_percent", "marks"))))
    want = collections.Counter((i, *brute(i, t, **{k: v for k, v in names.items() if v is not None})) for i, t in rows)
    assert collections.Counter(map(tuple, made.collect())) == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    back = made.select("doc_id", fill_in_middle.restored(F.col("output"), F.col("form"), how.get("marks", fill_in_middle.MARKS)).alias("text")).collect()
    assert collections.Counter(map(tuple, back)) == collections.Counter((i, t or "") for i, t in rows)


def test_empty_tables_other_ids_and_bytes_that_are_no_text(spark):
    docs = spark.createDataFrame([("k1", "some text of words")], "doc_id string, text string")
    assert tuple(fill_in_middle.transform(docs).first()) == ("k1", *brute("k1", "some text of words"))
    assert fill_in_middle.transform(docs.limit(0)).count() == 0
    broken = docs.select("doc_id", F.expr("cast(unhex('61FF62') as string)").alias("text"))
    got = fill_in_middle.transform(broken).first()
    assert tuple(got) == ("k1", *brute("k1", "a�b"))
