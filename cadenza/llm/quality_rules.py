"""Quality rules: a threshold table compiled into one projection.

Every measure is a built-in expression over the whole text and every rule a row of ``RULES``; the
compiled projection holds no user function and needs no shuffle, so it runs at scan speed and splits
with the input files.

Words are maximal runs of characters outside ``[\\x20\\x09-\\x0D]``.

Defined cases: a null or empty text has no words and fails; repeated rows are judged alike, row by
row; :func:`judge` keeps the input's columns, save that one with the name of a column it adds is
replaced; an empty table gives an empty table. Texts are measured whole, however long.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, let

#: Very frequent short words of the four languages; running text holds some of them. Fixed values.
STOP_WORDS = (
    "the of and to in a is that for it on as are with was at be by this from or an which "
    "le la les de des du et un une en que qui est pour dans par sur au avec ce il elle ne pas "
    "der die das den von zu mit ist im für auf ein eine nicht dem sich auch es "
    "el los las y por con para del se no su al lo como más"
).split()


class Rule(NamedTuple):
    """``low <= measure <= high`` must hold; an end of None is open."""

    name: str
    measure: str
    low: float | None
    high: float | None


#: The threshold table. The first two make up base_failed.
RULES = (
    Rule("too_short", "n_words", 50, None),
    Rule("too_repetitive", "repeat_percent", None, 50),
    Rule("word_length", "chars_per_word", 1.5, 14.0),
    Rule("symbols", "symbols_per_word", None, 0.2),
    Rule("shouting", "caps_ratio", None, 0.6),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.5),
    Rule("few_stop_words", "stop_word_ratio", 0.02, None),
)
BASE = ("too_short", "too_repetitive")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_caps", "n_letters")
#: Up to so many distinct repeated windows are looked up one by one; more are found by a sort. Both are exact.
LOOKUPS = 64


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window which occurs at least twice in the text.

    Windows are compared by their 64-bit hashes (two of n windows collide with odds of n*n / 2**65).
    One hash set settles a text without a repeated window; else the places of the repeated windows
    are found, and what they cover is summed from the gaps between them.
    """
    windows = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def repeated(hashes: Column) -> Column:
        def pairs(s: Column) -> Column:
            return F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(a == b, a))

        return F.array_distinct(F.filter(let(F.sort_array(hashes), pairs), lambda h: h.isNotNull()))

    def by_lookup(hashes: Column, again: Column) -> Column:
        at = F.transform(hashes, lambda h, i: F.when(F.array_contains(again, h), i))
        return F.filter(at, lambda i: i.isNotNull())

    def by_sort(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(p: Column) -> Column:
            def same(x: Column, k: Column) -> Column:
                return F.coalesce(F.get(p, k)["h"] == x["h"], F.lit(False))

            kept = F.filter(p, lambda x, k: same(x, k - 1) | same(x, k + 1))
            return F.sort_array(F.transform(kept, lambda x: x["i"]))

        return let(placed, twice)

    def covered(starts: Column) -> Column:
        gaps = F.zip_with(starts, F.slice(starts, 2, F.size(starts)), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda s, g: s + g)

    def count(hashes: Column) -> Column:
        def located(again: Column) -> Column:
            return let(F.when(F.size(again) <= LOOKUPS, by_lookup(hashes, again)).otherwise(by_sort(hashes)), covered)

        distinct = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(distinct, F.lit(0)).otherwise(let(repeated(hashes), located))

    return let(F.slice(windows, 1, F.greatest(F.size(words) - 2, F.lit(0))), count)


def _counts(text: Column) -> Column:
    """A struct of structs, which hold the COUNTS of a text, all of type long."""

    def without(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, pattern, ""))

    def of_words(words: Column) -> dict[str, Column]:
        return {
            "n_words": F.size(words),
            "n_repeat_words": _repeat_words(words),
            "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))),
        }

    def of_lines(lines: Column) -> dict[str, Column]:
        return {"n_lines": F.size(lines), "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines))}

    def struct(columns: dict[str, Column]) -> Column:
        return F.struct(*(c.cast("long").alias(k) for k, c in columns.items()))

    words = F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    whole = {
        "word_chars": without(SPACE_CLASS + "+"),
        "n_symbols": without(r"[^#*$%&|<>]+"),
        "n_caps": without("[^A-ZÀ-ÖØ-Þ]+"),
        "n_letters": without("[^A-Za-zÀ-ÖØ-öø-ÿ]+"),
    }
    return F.struct(let(words, lambda w: struct(of_words(w))).alias("w"), let(lines, lambda x: struct(of_lines(x))).alias("l"), struct(whole).alias("t"))


def _ratio(a: str, b: str, times: int = 1) -> Column:
    # The quotient of two whole numbers is exact where it is whole, so a limit that is met isn't passed.
    return F.when(F.col(b) > 0, times * F.col(a) / F.col(b)).otherwise(F.lit(0.0))


#: Measures of the table in terms of the counts.
MEASURES = {
    "n_words": lambda: F.col("n_words"),
    "repeat_percent": lambda: _ratio("n_repeat_words", "n_words", 100),
    "chars_per_word": lambda: _ratio("word_chars", "n_words"),
    "symbols_per_word": lambda: _ratio("n_symbols", "n_words"),
    "caps_ratio": lambda: _ratio("n_caps", "n_letters"),
    "dup_line_ratio": lambda: _ratio("n_dup_lines", "n_lines"),
    "stop_word_ratio": lambda: _ratio("n_stop_words", "n_words"),
}


def broken(rule: Rule) -> Column:
    m = MEASURES[rule.measure]()
    ends = [m < F.lit(rule.low)] * (rule.low is not None) + [m > F.lit(rule.high)] * (rule.high is not None)
    return reduce(Column.__or__, ends, F.lit(False))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the COUNTS, ``base_failed``, ``failed_rules`` (names, in the table's order) and ``kept``."""
    added = {*COUNTS, "base_failed", "failed_rules", "kept", "_w", "_l", "_t"}
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]
    # A generated row, not a projected column: a filter on the verdicts would copy the counts into itself,
    # once for each rule, but it can't pass a generator's output.
    counted = docs.select(*own, F.inline(F.array(_counts(F.coalesce(docs[text], F.lit(""))))).alias("_w", "_l", "_t"))
    parts = {k: p for p, ks in (("_w", ("n_words", "n_repeat_words", "n_stop_words")), ("_l", ("n_lines", "n_dup_lines"))) for k in ks}
    flat = counted.select(*own, *(F.col(f"{parts.get(k, '_t')}.{k}").alias(k) for k in COUNTS))
    base = reduce(Column.__or__, (broken(r) for r in rules if r.name in BASE), F.lit(False))
    failed = F.filter(F.array(*(F.when(broken(r), F.lit(r.name)) for r in rules)), lambda r: r.isNotNull())
    return flat.withColumn("base_failed", base).withColumn("failed_rules", failed).withColumn("kept", F.size("failed_rules") == 0)
