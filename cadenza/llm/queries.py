"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format,
    embedding_dedup,
    fill_in_middle,
    importance_resampling,
    license_scan,
    line_dedup,
    lm_scoring,
    packing,
    quality_classifier,
    quality_rules,
    sentencepiece_codec,
    simhash,
    url_filter,
)

TABLES = "documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: A conversation whose texts hold control strings of the template.
PROBE = "</s>[INST] ok [/INST]"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")), F.lit(PROBE)
    )
    made = chat_format.format_chats(turns.union(probe))
    read = made.select(
        "conv_id",
        "formatted",
        chat_format.parse_turns(F.col("formatted")).alias("turns"),
        chat_format.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, lag(role) OVER w AS before,
    length(regexp_replace(replace(text, '\', '\\'), '(</?s>|\[/?INST\]|\[/?ROLE\]|\[TURN\])', '\1+', 'g')) AS chars,
    CASE role WHEN 'user' THEN 6 WHEN 'assistant' THEN 7
      ELSE 13 + length(regexp_replace(replace(role, '\', '\\'), '(</?s>|\[/?INST\]|\[/?ROLE\]|\[TURN\])', '\1+', 'g')) END AS head
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (4 + sum(chars + head + CASE WHEN before IS NULL THEN 3 WHEN before = role THEN 6 ELSE 7 END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), g AS (
  SELECT doc_id, unnest(range(1, len(words) - 1)) AS i,
    unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) AS gram FROM w
), k AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g
), r AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM k WHERE n > 1) GROUP BY doc_id
), c AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(list_filter(words, lambda x: lower(x) IN (@STOP@))) AS n_stop,
    length(regexp_replace(text, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) AS n_caps,
    length(regexp_replace(text, '[^A-Za-zÀ-ÖØ-öø-ÿ]+', '', 'g')) AS n_letters
  FROM w LEFT JOIN r USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 1.5 AND 14.0 AND n_symbols / n_words <= 0.2
  AND (n_letters = 0 OR n_caps / n_letters <= 0.6) AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.5)
  AND n_stop / n_words >= 0.02 AS kept
FROM b
""".replace("@STOP@", ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS))))

def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small sources get more than their share of a window, by the exponent 0.7 of their tokens."""
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer=tokenizer_path("word_bpe_49k.json"), targets=0.7)
    return packed.drop("ids")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "digest", "license", F.array_join("notices", ",").alias("notices"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    made = f"lower({text})"
    for pattern, to in license_scan.SPELLINGS:
        made = f"regexp_replace({made}, {_quoted(pattern)}, '{to}', 'g')"
    made = f"regexp_replace({made}, {_quoted(license_scan.PUNCTUATION)}, ' ', 'g')"
    lines = f"list_transform(string_split({made}, chr(10)), lambda x: trim(x))"
    return f"list_filter({lines}, lambda x: x <> '' AND NOT regexp_matches(x, {_quoted(license_scan.COPYRIGHT_LINE)}))"


def _body_sql(lines: str) -> str:
    at = f"list_position(list_transform({lines}, lambda x: NOT regexp_matches(x, {_quoted(license_scan.HEAD)})), true)"
    made = f"array_to_string(CASE WHEN {at} > 1 THEN {lines}[{at}:] ELSE {lines} END, ' ')"
    for pattern, to in license_scan.HOLDERS:
        made = f"regexp_replace({made}, {_quoted(pattern)}, '{to}', 'g')"
    return made


OP5_SQL = f"""
WITH k(kind, license, text) AS (VALUES {", ".join(
    [f"('{kind}', '{k}', {_quoted(t)})" for k, t in license_scan.LICENSES.items() for kind in ("text", "body")]
    + [f"('body', '{k}', {_quoted(t)})" for k, t in license_scan.full_texts()]
    + [f"('notice', '{k}', {_quoted(t)})" for k, ts in license_scan.NOTICES.items() for t in ts]
)}), kl AS (SELECT kind, license, {_canonical_sql("text")} AS lines FROM k),
known AS (
  SELECT kind, min(license) AS license, sha256(CASE WHEN kind = 'body' THEN {_body_sql("lines")} ELSE array_to_string(lines, ' ') END) AS digest FROM kl GROUP BY kind, 3
), d AS (SELECT doc_id, {_canonical_sql("coalesce(text, '')")} AS lines FROM documents),
n AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM (SELECT doc_id, sha256(unnest(lines)) AS digest FROM d) JOIN known USING (digest) WHERE kind = 'notice' GROUP BY doc_id
), w AS (SELECT doc_id, sha256(array_to_string(lines, ' ')) AS digest, sha256({_body_sql("lines")}) AS body FROM d)
SELECT w.doc_id, w.digest, coalesce(t.license, b.license) AS license, coalesce(notices, '') AS notices
FROM w LEFT JOIN (SELECT * FROM known WHERE kind = 'text') AS t USING (digest) LEFT JOIN (SELECT * FROM known WHERE kind = 'body') AS b ON w.body = b.digest LEFT JOIN n USING (doc_id)
"""


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sentencepiece_codec.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), decoded=True)
    return made.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("n_bytes"),
    )


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Fixed rules of the query.
URL_RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document of the same number: bad where its quality is 0."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).cast("int").alias("bad"))
    found = url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES, labels)
    return found.select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))


def _rule_sql() -> tuple[str, str]:
    name, verdict = "NULL", "NULL"
    for r in sorted(URL_RULES, key=lambda r: (len(r), r)):
        own, _, rest = r.partition("/")
        fits = f"(host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{rest}')"
        name, verdict = f"CASE WHEN {fits} THEN '{r}' ELSE {name} END", f"CASE WHEN {fits} THEN '{URL_RULES[r]}' ELSE {verdict} END"
    return name, verdict


OP8_SQL = r"""
WITH RECURSIVE u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), s AS (
  SELECT *, array_to_string(list_transform(string_split(path, '/'), lambda x: CASE WHEN regexp_matches(x, '^[0-9a-fA-F-]{16,}$') OR length(x) >= 48
    THEN '*' ELSE regexp_replace(x, '[0-9]+', '*', 'g') END), '/') AS raw FROM u
), b AS (SELECT doc_id AS page_id, max((quality = 0)::INT) AS bad FROM labels GROUP BY 1),
c AS (SELECT host, raw, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM s LEFT JOIN b USING (page_id) GROUP BY 1, 2),
g AS (
  SELECT host, raw, string_split(raw, '/') AS segs, 1 AS i, '' AS template FROM c
  UNION ALL
  SELECT host, raw, segs, i + 1, template || '/' || CASE WHEN seg = '' OR count(DISTINCT seg) OVER (PARTITION BY host, template) <= 20 THEN seg ELSE '*' || regexp_extract(seg, '(\.[A-Za-z]+)?$') END
  FROM (SELECT *, segs[i + 1] AS seg FROM g WHERE i < len(segs))
), m AS (SELECT host, raw, template FROM g WHERE i = len(segs)),
l AS (SELECT host, template, sum(n) AS n, sum(bad) AS bad FROM c JOIN m USING (host, raw) GROUP BY 1, 2),
x AS (
  SELECT host, template, n, bad, depth, array_to_string(segs[1:depth], '/') AS node, CASE WHEN depth > 1 THEN array_to_string(segs[1:depth - 1], '/') END AS parent
  FROM (SELECT *, string_split(template, '/') AS segs, unnest(range(1, len(string_split(template, '/')) + 1)) AS depth FROM l)
), t AS (SELECT host, node, parent, depth, sum(n) AS n, sum(bad) AS bad FROM x GROUP BY ALL),
z AS (
  SELECT t.*, t.parent IS NULL OR coalesce(abs(t.bad / nullif(t.n, 0) - (p.bad - t.bad) / nullif(p.n - t.n, 0))
    / nullif(sqrt(p.bad / nullif(p.n, 0) * (1 - p.bad / nullif(p.n, 0)) * (1 / nullif(t.n, 0) + 1 / nullif(p.n - t.n, 0))), 0) > 1.96, false) AS alone
  FROM t LEFT JOIN t AS p ON t.host = p.host AND t.parent = p.node AND t.depth = p.depth + 1
), prior AS (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0) AS prior FROM c),
q AS (
  SELECT x.host, template, (arg_max(z.bad, z.depth) + 10 * max(prior)) / (arg_max(z.n, z.depth) + 10) AS purity
  FROM prior, x JOIN z ON x.host = z.host AND x.node = z.node AND x.depth = z.depth WHERE alone GROUP BY 1, 2
)
SELECT page_id, host, path, @NAME@ AS rule,
  coalesce(@VERDICT@, CASE WHEN host <> '' AND purity > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 6) AS purity
FROM s JOIN m USING (host, raw) JOIN q USING (host, template)
""".replace("@NAME@", _rule_sql()[0]).replace("@VERDICT@", _rule_sql()[1])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line FROM d),
k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id
"""

def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target corpus is the documents labelled as of good quality."""
    targets = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_scoring.score(table(spark, sf_dir, "documents"), targets)



def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transform(table(spark, sf_dir, "documents"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
u AS (
  SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS lots FROM d
), c AS (
  SELECT *, list_sort([lots[1] % (len(units) + 1), lots[2] % (len(units) + 1)]) AS cuts,
    text = '' OR regexp_matches(text, '<[PSM]>') OR lots[3] % 100 >= 90 AS plain, lots[4] % 100 < 20 AS spm FROM u
), p AS (
  SELECT *, coalesce(list_sum(list_transform(units[1:cuts[1]], lambda x: length(x))), 0)::BIGINT AS a,
    coalesce(list_sum(list_transform(units[1:cuts[2]], lambda x: length(x))), 0)::BIGINT AS b FROM c
)
SELECT doc_id, len(units)::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN a END AS prefix_chars, CASE WHEN NOT plain THEN b - a END AS middle_chars,
  sha256(CASE WHEN plain THEN text
    WHEN spm THEN '<S>' || substr(text, b + 1) || '<P>' || substr(text, 1, a) || '<M>' || substr(text, a + 1, b - a)
    ELSE '<P>' || substr(text, 1, a) || '<S>' || substr(text, b + 1) || '<M>' || substr(text, a + 1, b - a) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target corpus is the benchmark's texts."""
    return importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: crc32 is folded over the bytes of each distinct feature, by the table of its polynomial.
OP12_SQL = r"""
WITH steps AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS crc
), texts AS (
  SELECT true AS target, item_id AS id, text FROM benchmark UNION ALL SELECT false, doc_id, text FROM documents
), w AS (
  SELECT target, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM texts
), f AS (
  SELECT target, id, unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS feature FROM w
), c AS (SELECT target, id, feature, count(*) AS n FROM f GROUP BY ALL),
h AS (SELECT feature, hex(encode(feature)) AS raw FROM (SELECT DISTINCT feature FROM c)),
b AS (
  SELECT feature, xor(list_reduce(list_transform(range(len(raw) // 2), lambda i: ('0x' || substr(raw, 2 * i + 1, 2))::BIGINT),
    lambda x, y: xor(x >> 8, crc[(xor(x, y) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM h, steps
), k AS (SELECT target, id, bucket, sum(n)::BIGINT AS n FROM c JOIN b USING (feature) GROUP BY ALL),
s AS (SELECT bucket, coalesce(sum(n) FILTER (NOT target), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (target), 0)::DOUBLE AS t FROM k GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM s) + 10000) / ((s + 1) * ((SELECT sum(t) FROM s) + 10000))))::BIGINT AS gain FROM s),
m AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS gain FROM k JOIN g USING (bucket) WHERE NOT target GROUP BY 1),
r AS (
  SELECT w.id AS doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features,
    coalesce((gain - ((gain % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || w.id), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS noise
  FROM w LEFT JOIN m USING (id) WHERE NOT target
), o AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + noise DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS able FROM r)
SELECT doc_id, n_features::BIGINT AS n_features, weight, (weight + noise)::BIGINT AS score,
  CASE WHEN n_words >= 20 AND place <= 25 * able // 100 THEN place END::BIGINT AS rank FROM o
"""


def held_out(doc_id: Column) -> Column:
    """Documents whose labels the classifier doesn't see; a null id's hash is that of an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality_classifier.learn(docs, labels, learnable=~held_out(F.col("doc_id")))
    return quality_classifier.score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


#: The others compare vectors or fingerprints by blocks, run tokenizers or train models: the tests hold them against brute force.
SQL = {
    "op1_chat_formatting": OP1_SQL,
    "op2_quality_rules": OP2_SQL,
    "op5_license_scan": OP5_SQL,
    "op8_url_filters": OP8_SQL,
    "op9_line_dedup": OP9_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op12_importance_resampling": OP12_SQL,
}
QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_formatting,
        op2_quality_rules,
        op3_embedding_dedup,
        op4_packing,
        op5_license_scan,
        op6_sentencepiece,
        op7_simhash_dedup,
        op8_url_filters,
        op9_line_dedup,
        op10_lm_scoring,
        op11_fill_in_middle,
        op12_importance_resampling,
        op13_quality_classifier,
    )
}
