"""LM scoring by cross-entropy difference (Moore and Lewis, 2010).

A target model and a background model are trained alike: interpolated bigram models over one shared
vocabulary, from counts of the whole corpus. The target's counts come from the rows marked as target,
the background's from all rows. A row is scored by models that leave its own counts out, so that no text
is told from others by having been learnt itself; what other rows repeat of it still counts. The score is
the mean over its tokens of the target loss less the background loss, in nats; lower is closer to the target.

Words are the ASCII white-space separated parts of the text, with A-Z lower-cased. Every word of the corpus
and every bigram is counted, without a cap, and nothing of it passes through the driver:

1. documents are dealt by their id into groups of some ``GROUP_BYTES`` of text. A group counts its distinct
   words and bigrams once, and sends each block in which it has keys one message of sorted, delta-coded keys and packed
   counts: some six bytes a key. There are as many blocks as groups, so a task's work stays the same size. A block
   without a key of the group hears nothing from it, so there are never more messages than keys.
2. a block sums its messages and answers each with what the other groups counted for the same keys, in the
   same order. The blocks' totals, five numbers each, are summed from the same shuffle, and one row of them is broadcast;
3. a group meets its answers and scores its rows. Its texts are shuffled once for both steps.

Keys are 64-bit hashes (XXH64) of words, and of pairs of them; two of n keys are alike with odds of n * n / 2**65.

Defined cases: a null or empty text has no tokens and a null score; a null doc_id is no target; rows are
documents of their own, repeated or not; without any (other) target row the target model is uniform over the
vocabulary; texts are scored whole, however long, a longer one than a group being a group; extra columns are
ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a group of documents, about.
GROUP_BYTES = 8 << 20
TOTALS = ["size", "tokens", "target_tokens", "texts", "target_texts"]
#: Weights of the bigram, the unigram and the uniform part.
MIX = (0.6, 0.3, 0.1)
#: The key of the start of a text as the word before, and the factors that mix the keys of two words.
START, LEFT, RIGHT = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def packed(counts: np.ndarray) -> bytes:
    """Counts as compressed numbers of the least width that holds them."""
    width = np.min_scalar_type(int(counts.max(initial=0)))
    return bytes([width.itemsize]) + zlib.compress(counts.astype(width).tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(memoryview(raw)[1:]), f"<u{raw[0]}").astype(np.int64)


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys: the first, and the bytes that the differences need."""
    steps = np.diff(keys)
    width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    return keys[:1].astype("<u8").tobytes() + bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked_keys(raw: bytes) -> np.ndarray:
    if len(raw) < 9:
        return np.zeros(0, np.uint64)
    some = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, raw[8])
    steps = np.zeros((len(some) + 1, 8), np.uint8)
    steps[0], steps[1:, : raw[8]] = np.frombuffer(raw, np.uint8, 8), some
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def bounds(keys: np.ndarray, blocks: int) -> np.ndarray:
    """Where each block begins among ascending keys, and where the last ends; blocks are equal ranges of keys."""
    block = (keys >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
    return np.searchsorted(block, np.arange(blocks + 1, dtype=np.uint64))


def repeats(row: np.ndarray, what: np.ndarray) -> np.ndarray:
    """How often each token's ``what`` occurs in the token's row."""
    _, place, n = np.unique(row * (int(what.max(initial=0)) + 1) + what, return_inverse=True, return_counts=True)
    return n[place]


class Group(NamedTuple):
    """The texts of a group in terms of its own words and bigrams, both numbered by ascending keys.

    Tokens are the words of the rows one after the other; ``before`` is the word before in the row, or the number
    of words at its start. The counts have a row for all, one for targets; the words' a second pair, of the texts'
    last words."""

    words: np.ndarray
    pairs: np.ndarray
    word_counts: np.ndarray
    pair_counts: np.ndarray
    row: np.ndarray
    token: np.ndarray
    before: np.ndarray
    pair: np.ndarray
    targeted: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Group:
        is_mark = table.column("_mark").to_numpy(zero_copy_only=False)
        docs = table.column("_doc").combine_chunks()
        targeted = pc.is_in(docs, value_set=docs.filter(pa.array(is_mark)).drop_null(), skip_nulls=True).to_numpy(zero_copy_only=False)
        texts = pc.ascii_lower(table.column("_text").cast(pa.large_string()).combine_chunks().fill_null(""))
        parts = pc.ascii_split_whitespace(texts)
        row = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
        parts = parts.flatten()
        whole = pc.greater(pc.binary_length(parts), 0)
        row, parts = row[whole.to_numpy(zero_copy_only=False)], parts.filter(whole).dictionary_encode()
        words = np.fromiter((xxhash.xxh64_intdigest(w) for w in parts.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(parts.dictionary))
        order = np.argsort(words)
        words, rank = words[order], np.empty(len(words), np.int64)
        rank[order] = np.arange(len(order))
        token = rank[parts.indices.to_numpy()]
        first = np.diff(row, prepend=-1) != 0
        last = np.diff(row, append=len(texts)) != 0
        before = np.where(first, len(words), np.roll(token, 1))
        codes, pair = np.unique(before * max(1, len(words)) + token, return_inverse=True)
        keys = np.append(words, START)[codes // max(1, len(words))] * LEFT + words[codes % max(1, len(words))] * RIGHT
        keys ^= keys >> np.uint64(31)
        order = np.argsort(keys)
        pairs, rank = keys[order], np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(order))
        pair = rank[pair]
        mine = targeted[row]

        def counted(x: np.ndarray, size: int, some: np.ndarray) -> list[np.ndarray]:
            return [np.bincount(x[where], minlength=size) for where in (some, some & mine)]

        words_n = np.array(counted(token, len(words), np.full(len(token), True)) + counted(token, len(words), last))
        pairs_n = np.array(counted(pair, len(pairs), np.full(len(pair), True)))
        return cls(words, pairs, words_n, pairs_n, row, token, before, pair, targeted)

    def losses(self, words: np.ndarray, pairs: np.ndarray, total: int, texts: int, size: int, mine: bool) -> np.ndarray:
        """-ln p of each token by one model, without its row's own counts.

        ``words`` has the whole corpus' counts of the words, and of the words at a text's end, ``pairs`` of the bigrams."""
        a, b, c = MIX
        # A word is a context as often as it is a token, but for a text's last one.
        contexts = np.append(words[0] - words[1], texts)
        one, seen, both, every = words[0][self.token], contexts[self.before], pairs[self.pair], np.full(len(self.row), total)
        # The target's counts hold a row only if it is a target.
        own = np.flatnonzero(self.targeted[self.row]) if mine else slice(None)
        row = self.row[own]
        one[own] -= repeats(row, self.token[own])
        seen[own] -= repeats(row, self.before[own])
        both[own] -= repeats(row, self.pair[own])
        every[own] -= np.bincount(row, minlength=len(self.targeted))[row]
        uniform = one / np.maximum(every, 1)
        # A context never seen gives its weight to the unigrams.
        two = np.where(seen > 0, both / np.maximum(seen, 1), uniform)
        return np.where(every > 0, -np.log(a * two + b * uniform + c / size), np.log(size))


def summed(messages: pa.Table, keys: str, counts: str, kinds: int) -> list[np.ndarray]:
    """For each message what all others count for its keys."""
    sent = [unpacked_keys(raw) for raw in messages.column(keys).to_pylist()]
    own = np.concatenate([unpacked(raw).reshape(kinds, -1) for raw in messages.column(counts).to_pylist()], axis=1)
    distinct, at = np.unique(np.concatenate(sent), return_inverse=True)
    every = np.array([np.bincount(at, x, len(distinct)) for x in own]).astype(np.int64)
    return np.split(every[:, at] - own, np.cumsum([len(x) for x in sent])[:-1], axis=1)


def total(messages: pa.Table) -> pa.Table:
    """A block's share of the totals: words, tokens, target tokens, texts, target texts."""
    distinct = len(np.unique(np.concatenate([unpacked_keys(raw) for raw in messages.column("words").to_pylist()])))
    sums = np.sum([unpacked(raw).reshape(4, -1).sum(axis=1) for raw in messages.column("word_counts").to_pylist()], axis=0)
    return pa.table([pa.array([int(x)]) for x in (distinct, *sums)], TOTALS)


def score(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) for each row; means over the tokens.

    ``targets`` has the doc_id of the target corpus' documents; they are sent to the documents' groups."""
    held = docs.agg(F.coalesce(F.sum(F.octet_length(docs[text])), F.lit(0)).alias("bytes")).first()["bytes"]
    groups = max(1, -(-held // group_bytes))
    kind = docs.schema[doc_id].dataType
    rows = docs.select(docs[doc_id].alias("_doc"), docs[text].alias("_text"), F.lit(False).alias("_mark"))
    marks = targets.select(F.col("doc_id").cast(kind).alias("_doc"), F.lit(None).cast(docs.schema[text].dataType).alias("_text"), F.lit(True).alias("_mark"))
    dealt = F.pmod(F.when(F.col("_doc").isNull(), F.xxhash64("_text")).otherwise(F.xxhash64("_doc")), F.lit(groups)).cast("int")
    grouped = rows.unionByName(marks).select(dealt.alias("_group"), "_doc", "_text", "_mark")

    def count(table: pa.Table) -> pa.Table:
        g = Group.of(table)
        columns, ends = [], [bounds(keys, groups) for keys in (g.words, g.pairs)]
        blocks = np.flatnonzero((np.diff(ends[0]) > 0) | (np.diff(ends[1]) > 0))
        for at, keys, counts in zip(ends, (g.words, g.pairs), (g.word_counts, g.pair_counts), strict=True):
            cuts = [slice(at[k], at[k + 1]) for k in blocks]
            columns += [pa.array([packed_keys(keys[x]) for x in cuts], pa.binary()), pa.array([packed(counts[:, x]) for x in cuts], pa.binary())]
        own = np.full(len(blocks), table.column("_group")[0].as_py(), np.int32)
        return pa.table([pa.array(blocks.astype(np.int32)), pa.array(own), *columns], ["block", "group", "words", "word_counts", "pairs", "pair_counts"])

    sent = grouped.groupBy("_group").applyInArrow(count, "block int, group int, words binary, word_counts binary, pairs binary, pair_counts binary")

    def answer(messages: pa.Table) -> pa.Table:
        columns = [pa.array([packed(x) for x in summed(messages, *some)], pa.binary()) for some in (("words", "word_counts", 4), ("pairs", "pair_counts", 2))]
        return pa.table([messages.column("block"), messages.column("group"), *columns], ["block", "group", "words", "pairs"])

    back = sent.groupBy("block").applyInArrow(answer, "block int, group int, words binary, pairs binary")
    totals = sent.groupBy("block").applyInArrow(total, ", ".join(f"{c} bigint" for c in TOTALS)).agg(*(F.sum(c).alias(c) for c in TOTALS))
    back = back.withColumn("one", F.lit(1)).join(F.broadcast(totals.withColumn("one", F.lit(1))), "one").drop("one")

    def losses(table: pa.Table, answers: pa.Table) -> pa.Table:
        g = Group.of(table)
        answers = answers.sort_by("block")
        words, pairs = (np.concatenate([np.zeros((kinds, 0), np.int64), *(unpacked(raw).reshape(kinds, -1) for raw in answers.column(c).to_pylist())], axis=1) for c, kinds in (("words", 4), ("pairs", 2)))
        words, pairs = words + g.word_counts, pairs + g.pair_counts
        # A group without tokens hears no totals, and needs none.
        size, *totals = ((answers.column(c)[0].as_py() if len(answers) else 0) for c in TOTALS)
        tokens = np.bincount(g.row, minlength=len(g.targeted))
        # As in the models, the start and an unknown word have their share of the uniform part.
        means = [
            np.bincount(g.row, g.losses(words[[k, k + 2]], pairs[k], totals[k], totals[k + 2], size + 2, bool(k)), len(tokens)) / np.maximum(tokens, 1)
            for k in (1, 0)
        ]
        whole = np.flatnonzero(~table.column("_mark").to_numpy(zero_copy_only=False))
        none = tokens[whole] == 0
        near, far = (pa.array(x[whole], mask=none) for x in means)
        return pa.table([table.column("_doc").take(pa.array(whole)), pa.array(tokens[whole]), near, far], ["doc_id", "n_tokens", "target_loss", "background_loss"])

    scored = grouped.groupBy("_group").cogroup(back.groupBy("group")).applyInArrow(losses, f"doc_id {kind.simpleString()}, n_tokens bigint, target_loss double, background_loss double")
    return scored.withColumn("score", F.col("target_loss") - F.col("background_loss"))
