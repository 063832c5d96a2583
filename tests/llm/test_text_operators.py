"""Text operators: against their SQL, the libraries, and brute force; and on odd rows."""

import collections
import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cadenza.llm import chat_format, license_scan, line_dedup, lm_scoring, quality_rules, queries, sentencepiece_codec, simhash, url_filter
from test_pairs_and_packing import brute_fingerprint, check_packed, groups, ids_of

LONG = "word " * 5000 + "\n" + "x" * 20000


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_is_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in queries.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted(want, key=repr)


def test_chat_round_trip(spark):
    odd = ["", None, "\\", "\\\\[INST]", "[\\INST]", "</s><s>[TURN]", "[ROLE]x[/ROLE]", "<", "[", "é🙂\n", "[/INST", LONG, "<\\/s>"]
    rows = [(1, i, ("user", "user", "assistant", None, "tool]\n[/ROLE]")[i % 5], odd[i % len(odd)]) for i in range(200)]
    rows += [(2, 5, "assistant", "b"), (2, 5, "assistant", "b"), (2, 5, "assistant", "a"), (None, None, "user", "x"), (3, None, "assistant", "first"), (3, 0, "assistant", "then")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, run int")
    made = chat_format.format_chats(df).select("conv_id", "n_turns", "formatted", chat_format.parse_turns(F.col("formatted")).alias("turns"), chat_format.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    want = collections.defaultdict(list)
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] or 0, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    got = {r.conv_id: r for r in made.collect()}
    assert got.keys() == want.keys()
    for c, r in got.items():
        assert [tuple(t) for t in r.turns] == want[c] and r.n_turns == len(want[c])
        assert r.loss == "".join(t for role, t in want[c] if role == "assistant")
    assert chat_format.format_chats(df.limit(0)).count() == 0
    assert got[2].formatted == "<s>[/INST]a[TURN][/INST]b[TURN][/INST]b</s>"


def brute_quality(text):
    words = (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [None, "", " \n\t", LONG, "a b c a b c a", "a\u00a0b \u2003c", "x\n\nx\n x\nx", "a b", "# | <> é"] + [" ".join(rng.choice(list("abcd"), 60)) for _ in range(20)]
    df = spark.createDataFrame([(i, t, i, True) for i, t in enumerate(texts)], "doc_id long, text string, n_words int, kept boolean")
    for lookups in (64, 1):
        monkeypatch.setattr(quality_rules, "LOOKUPS", lookups)
        for r in quality_rules.judge(df).collect():
            n, *rest = brute_quality(r.text)
            assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == [n, *rest], r.text
            assert r.base_failed == (n < 50 or 100 * rest[-1] > 50 * n) and not (r.kept and r.base_failed)
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_quality_counts_are_made_once(spark, sf):
    """A filter on the verdict doesn't copy the counts into itself."""
    kept = quality_rules.judge(queries.table(spark, sf, "documents")).where("kept").select("doc_id", "text")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64(") == 1 and plan.count("split(") == 2


def test_quality_repeats_and_thresholds(spark):
    """Repeated rows are judged row by row; a limit may be a fraction; meeting it isn't passing it."""
    text = " ".join(["a b c d"] + ["a b c"] + [f"w{i}" for i in range(60)])
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None)], "doc_id long, text string")
    share = 100 * 6 / 67
    for high, failed in ((share, False), (share - 0.01, True), (share + 0.01, False)):
        rules = (quality_rules.Rule("too_repetitive", "repeat_percent", None, high),)
        got = quality_rules.judge(df, rules=rules).collect()
        assert len(got) == 4 and [r.base_failed for r in got if r.text] == [failed] * 3


def brute_lines(docs, min_docs, keep_first=False):
    where = collections.defaultdict(list)
    strip = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keys = [[x.strip(strip).translate(low) for x in (t or "").split("\n")] for _, t in docs]
    for k, (i, _) in enumerate(docs):
        for p, key in enumerate(keys[k]):
            if key:
                where[key].append((-1 if i is None else i, p, k))
    gone = {(k, p) for places in where.values() if len({i for i, *_ in places}) >= min_docs for i, p, k in (sorted(places)[1:] if keep_first else places)}
    return [(i, "\n".join(x for p, x in enumerate((t or "").split("\n")) if (k, p) not in gone), len(keys[k]), sum((k, p) in gone for p in range(len(keys[k])))) for k, (i, t) in enumerate(docs)]


@pytest.mark.parametrize(("keep_first", "few"), [(False, 200_000), (True, 200_000), (False, 0), (True, 0)])
def test_line_dedup_odd_rows(spark, monkeypatch, keep_first, few):
    monkeypatch.setattr(line_dedup, "FEW", few)
    rng = np.random.default_rng(6)
    pool = ["Same LINE ", "same line", "É", "é", "", " ", "\ttab", "İx", "z" * 300]
    docs = [(i, "\n".join(rng.choice(pool, int(rng.integers(1, 200))))) for i in range(12)]
    docs += [(100, None), (101, ""), (None, "same line\nother"), (103, "\n".join(f"own {i}" for i in range(500)) + "\nSAME LINE")]
    if not keep_first:
        docs += [(3, "same line\nrepeated id"), (103, "É\nrepeated id"), (5, docs[5][1])]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], "doc_id long, text string, n_lines int, pos string")
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_lines(df, min_docs=11, keep_first=keep_first).collect()]
    assert sorted(got, key=repr) == sorted(brute_lines(docs, 11, keep_first), key=repr)
    assert line_dedup.drop_lines(df.limit(0)).count() == 0


def test_line_dedup_copies_of_a_row_are_treated_alike(spark):
    rows = [(1, "shared\nown")] * 2 + [(i, f"shared\nof {i}") for i in range(2, 12)]
    got = line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"), keep_first=True).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(1, "shared\nown")] * 2 + [(i, f"of {i}") for i in range(2, 12)])


def test_license_scan(spark):
    mit = license_scan.LICENSES["MIT"]
    texts = [mit, "Copyright (c) 2020 A. Person\nAll rights reserved.\n\n" + mit.upper().replace("LICENSE", "LICENCE").replace(",", ";"), mit + " more", None, "", "x\nReleased under the M.I.T.\nReleased under the MIT Licence", LONG]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(5, "licensed under cc by-nc 4.0", "z")], "doc_id long, text string, license string")
    got = sorted((r.doc_id, r.license, r.notices) for r in license_scan.scan(df).collect())
    assert [g[1] for g in got] == ["MIT", "MIT", None, None, None, None, None, None]
    assert [g[2] for g in got if g[0] == 5] == [["CC-BY-NC-4.0", "MIT"]] * 2 and all(not g[2] for g in got if g[0] != 5)
    assert license_scan.scan(df.limit(0)).count() == 0


def test_url_filter(spark):
    urls = [None, "", "no scheme/x", "HTTP://WWW.Example.COM/en/7?q=/x#y", "a://b://c/d", "http://example.net/de/81", "http://sub.example.net/de/9", "http://badexample.net/de/8", "http://com/en/", "x://example.com", "http://org/es/ok", "http://h.io/a/%41?/b"]
    pages = [(i, u, 1) for i, u in enumerate(urls)] + [(100 + i, f"http://shop.io/{'spam' if i % 2 else 'news'}/item-{'abcdefghijklmnopqrstuvwxyz'[i % 26]}x.html", 0) for i in range(200)]
    df = spark.createDataFrame(pages, "page_id long, url string, host int")
    labels = spark.createDataFrame([(100 + i, int(i % 2 == 1)) for i in range(0, 200, 3)] + [(101, 0), (None, 1)], "page_id long, bad int")
    got = {r.page_id: r for r in url_filter.judge(df, queries.URL_RULES, labels).collect()}
    assert len(got) == len(pages)
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(12)] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("www.example.com", "/en/7", "example.com/en/7", "allow"), ("b:", "//c/d", None, "allow"),
        ("example.net", "/de/81", "example.net/de/8", "block"), ("sub.example.net", "/de/9", "net/de/", "allow"),
        ("badexample.net", "/de/8", "net/de/", "allow"), ("com", "/en/", "com/en/", "block"), ("example.com", "", None, "allow"),
        ("org", "/es/ok", "org/es/", "block"), ("h.io", "/a/%41", None, "allow"),
    ]
    assert all(got[100 + i].verdict == ("block" if i % 2 else "allow") for i in range(200))  # held out: two of three have no label
    assert {r.verdict for r in url_filter.judge(df, {}).collect()} == {"allow"}
    assert url_filter.judge(df.limit(0), queries.URL_RULES, labels).count() == 0


def test_license_scan_odd_rows_and_large_tables(spark, monkeypatch):
    notice, whole = "Licensed under the MIT License.", license_scan.LICENSES["ISC"]
    rows = [(None, notice, "x"), (None, "nothing", "y"), (1, whole, "z"), (1, notice, "z"), (2, None, None), (3, "line\n" * 5000 + notice, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")

    def result():
        return sorted((r.doc_id or 0, r.license or "", tuple(r.notices)) for r in license_scan.scan(df).collect())

    want = sorted([(0, "", ("MIT",)), (0, "", ("MIT",)), (1, "ISC", ("MIT",)), (1, "", ("MIT",)), (2, "", ()), (3, "", ("MIT",))])
    assert result() == want
    monkeypatch.setattr(license_scan, "FEW", 1)
    monkeypatch.setattr(license_scan, "FEW_NOTICES", 1)
    assert result() == want


def test_url_filter_odd_rows(spark):
    long = "http://a.b/" + "seg/" * 2000
    rows = [(1, long, 0), (1, long, 0), (None, "HTTP://Shop.example.com/en/7x", 0), (None, None, 0), (2, "http://example.com/en/x", 0), (3, "no scheme", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "page_id long, bad int")
    got = sorted(((r.page_id or 0, r.host, len(r.path), r.rule, r.verdict) for r in url_filter.judge(df, queries.URL_RULES, labels).collect()), key=repr)
    # The long page has all labels there are, and they are bad: its purity and the prior are 1.
    assert got == sorted([(1, "a.b", 8001, None, "block")] * 2 + [(0, "shop.example.com", 6, "example.com/en/7", "allow"), (0, "", 0, None, "allow"), (2, "example.com", 5, "com/en/", "block"), (3, "", 0, None, "allow")], key=repr)


# SentencePiece


@pytest.fixture(scope="module")
def piece_model():
    return queries.tokenizer_path("piece_bpe_32k.model")


def test_sentencepiece_query_is_the_library(spark, sf, piece_model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    docs = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    got = {r.doc_id: r for r in queries.op6_sentencepiece(spark, sf).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        ids = sp.encode(text or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
        assert got[i].n_bytes == len(text.encode())


def odd_texts():
    rng = np.random.default_rng(7)
    alphabet = ["a", "b ", " ", "é", "▁", "\n", "<s>", "0x", "日", "🙂", "ｱ", "ﬁ", "the "]
    made = ["".join(rng.choice(alphabet, int(rng.integers(1, 50)))) for _ in range(400)]
    return ["", " ", "  a  b  ", "▁a▁▁b ▁", "<s> </s> <unk> <0x0A>", " " * 100, "\x00\x01", "é"] + made


@pytest.mark.parametrize("plain", [True, False])
def test_spans_are_the_library_s(piece_model, plain):
    import sentencepiece

    sp, codec = sentencepiece.SentencePieceProcessor(model_file=piece_model), sentencepiece_codec.Codec(piece_model)
    codec.plain = plain
    for text in [*odd_texts(), LONG[:30000]]:
        ids, start, ends = codec.encode(text)
        pieces = sp.encode(text, return_type="proto").pieces
        assert ids.tolist() == [p.id for p in pieces]
        assert [start, *ends.tolist()][: len(ends)] == [p.begin for p in pieces] and ends.tolist() == [p.end for p in pieces]


@pytest.mark.parametrize("squeeze", [True, False])
def test_compiled_map_is_the_library_s(piece_model, squeeze):
    import sentencepiece

    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", remove_extra_whitespaces=squeeze, add_dummy_prefix=False, escape_whitespaces=False)
    spec = dict(sentencepiece_codec._fields(dict(sentencepiece_codec._fields(library.serialized_model_proto()))[3]))
    codec = sentencepiece_codec.Codec(piece_model)
    codec.map, codec.squeeze, codec.prefix, codec.escape = sentencepiece_codec.CharsMap(spec[2]), squeeze, False, False
    for text in [*odd_texts(), "ｱｲｳ ①② ㌔ が　ガ ½  é"]:
        shown, source = codec.normalise(text)
        assert shown == library.normalize(text)
        assert len(source) == len(shown) + 1 and source == sorted(source)


def test_sentencepiece_rows(spark, piece_model):
    df = spark.createDataFrame([(1, None, 5), (1, "", 5), (None, "a b", 5), (3, LONG, 5)], "doc_id long, text string, ids int")
    got = sentencepiece_codec.decode(sentencepiece_codec.encode(df, piece_model), piece_model).collect()
    assert sorted((r.doc_id or 0, r.decoded[:3], len(r.decoded)) for r in got) == [(0, "a b", 3), (1, "", 0), (1, "", 0), (3, "wor", len(LONG))]
    assert sentencepiece_codec.encode(df.limit(0), piece_model).count() == 0


# language models


def test_lm_scoring_separates_held_out_texts(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(200)]
    bias = np.linspace(1, 5, 200)
    texts = [" ".join(rng.choice(words, 80, p=(bias if i % 2 else bias[::-1]) / bias.sum())) for i in range(300)]
    docs = spark.createDataFrame([*enumerate(texts), (900, None), (901, " ")], "doc_id long, text string")
    targets = spark.createDataFrame([(i,) for i in range(1, 150, 2)] + [(None,), (1,)], "doc_id long")
    got = {r.doc_id: r.score for r in lm_scoring.score(docs, targets).collect()}
    held = [(got[i], i % 2) for i in range(150, 300)]
    wins = [(a < b) + 0.5 * (a == b) for a, x in held for b, y in held if x and not y]
    assert np.mean(wins) > 0.95 and got[900] is None and got[901] is None
    assert lm_scoring.score(docs.limit(0), targets).count() == 0
    assert lm_scoring.score(docs, targets.limit(0)).where("score is not null").count() == 300


# pipeline


def test_pipeline_is_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    verdicts = {r.doc_id: r.kept for r in queries.op2_quality_rules(spark, sf).collect()}
    kept = [(i, t) for i, t in docs if verdicts[i]]
    kept = [(i, t) for i, t, *_ in brute_lines(kept, 10, keep_first=True)]
    prints = {i: brute_fingerprint(t) for i, t in kept}
    root = groups(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= simhash.DISTANCE])
    kept = [(i, t) for i, t in kept if root[i] == i]
    assert 0 < len(kept) < len(docs)
    want = dict(zip([i for i, _ in kept], ids_of([t for _, t in kept]), strict=True))
    check_packed(corpus_pipeline.run(spark, sf).collect(), want, 4096)


def test_stages_keep_the_columns_of_documents(spark, sf):
    docs = queries.table(spark, sf, "documents").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_stages_take_odd_rows(spark, sf):
    """Null columns, repeated rows, long texts and empty ones go through all stages, extra columns too."""
    docs = queries.table(spark, sf, "documents").limit(60)
    odd = docs.limit(4).select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "n_chars")
    long = docs.limit(1).select(F.lit(10**6).alias("doc_id"), F.lit(LONG).alias("text"), "lang", "source", "n_chars")
    none = docs.limit(2).select("doc_id", F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars")
    given = docs.union(docs.limit(5)).union(odd).union(long).union(none).withColumn("part", F.lit(1)).withColumn("kept", F.lit("x"))
    made = given
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, made, sf)
        assert made.schema.simpleString() == given.schema.simpleString()
    packed = corpus_pipeline.STAGES[-1][1](spark, made, sf)
    assert packed.agg(F.sum("length")).first()[0] == sum(len(t) for t in ids_of([r.text for r in made.collect()]))
