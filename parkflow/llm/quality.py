"""Quality rules: counts over words and lines, and repetition within a text by a suffix array over its words.

The suffixes of a text's words are sorted by doubling, common prefixes of neighbours form intervals, and each interval
of LEAST words or more whose members go on differently to the left is a maximal repeated substring. The union of their
occurrences is what a text repeats of itself. Texts are sorted many at a time: each has symbols of its own, so no
repeat crosses from one into another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parkflow.llm.common import task
from parkflow.llm.substrings import intervals

#: A text fails where repeats of LEAST words cover more than COVERED percent of its words, or one is over LONGEST words.
LEAST, COVERED, LONGEST = 10, 15, 50
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\r\x0b\x0c"
#: Texts are sorted together up to so many words; a longer one by itself.
AT_ONCE = 200_000


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of the suffixes of s, and for 1, 2, 4, ... symbols a rank of each suffix by so many first ones. Only
    suffixes that aren't told apart yet are sorted again."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = s[order[1:]] != s[order[:-1]]
    slots, at, k = np.arange(n), order, 1
    rank, levels = np.empty(n, np.int32), []
    while True:
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(fresh, slots, 0))
        levels.append(rank)
        again = ~(fresh & np.append(fresh[1:], True))
        slots = slots[again]
        if not len(slots):
            return order, levels
        at = order[slots]
        one, two = rank[at], np.where(at + k < n, rank[np.minimum(at + k, n - 1)], -1)
        new = np.lexsort((two, one))
        at, one, two = at[new], one[new], two[new]
        order[slots] = at
        fresh = np.ones(len(at), bool)
        fresh[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        k *= 2


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], least: int) -> np.ndarray:
    """How many first symbols each suffix shares with the one before it in order; 0 where certainly fewer than least."""
    n, out = len(order), np.zeros(len(order), np.int64)
    enough = min(len(levels) - 1, least.bit_length() - 1)
    pairs = np.flatnonzero(levels[enough][order[1:]] == levels[enough][order[:-1]]) + 1
    x, y, length = order[pairs - 1], order[pairs], np.zeros(len(pairs), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.maximum(x, y) + length < n
        a, b = (levels[k][np.minimum(p + length, n - 1)] for p in (x, y))
        length += np.where(inside & (a == b), 1 << k, 0)
    out[pairs] = length
    return out


def covered(reach: np.ndarray, least: int) -> np.ndarray:
    """Which symbols stand in a repeat of `least` or more; reach: the longest repeat that starts at each."""
    from_ = np.flatnonzero(reach >= least)
    edges = np.bincount(from_, minlength=len(reach) + 1) - np.bincount(from_ + reach[from_], minlength=len(reach) + 1)
    return np.cumsum(edges)[:-1] > 0


class Repeats:
    """What each of some texts, given as lists of words, repeats of itself."""

    def __init__(self, texts: list[list[bytes]], least: int):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.of = np.repeat(np.arange(len(texts)), sizes)
        number: dict[bytes, int] = {}
        words = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64, len(self.of))
        s = self.of * max(1, len(number)) + words
        n = len(s)
        self.reach, self.found = np.zeros(n, np.int64), []
        if n < 2:
            return
        order, levels = suffix_array(s)
        shared = common_prefixes(order, levels, min(least, 5))
        np.maximum.at(self.reach, order, np.maximum(shared, np.append(shared[1:], 0)))
        left = np.where(order > 0, s[order - 1], -1)
        changes = np.cumsum(np.append(False, left[1:] != left[:-1]))
        deep = np.flatnonzero(shared >= least)
        for run in np.split(deep, np.flatnonzero(np.diff(deep) > 1) + 1):
            for length, first, last in intervals(shared[run].tolist()) if len(run) else ():
                a, b = run[0] - 1 + first, run[0] - 1 + last
                if length >= least and changes[b] > changes[a]:
                    self.found.append((int(length), int(self.of[order[a]]), order[a : b + 1]))

    def maximal(self) -> Iterator[tuple[int, int, list[int]]]:
        """(text, words, where it starts in its text, in order) of each maximal repeat."""
        for length, text, at in self.found:
            yield text, length, sorted((at - (self.ends[text - 1] if text else 0)).tolist())


def quality_batches(batches: Iterator[pa.RecordBatch], least: int, percent: int, longest: int) -> Iterator[pa.RecordBatch]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "n_repeats", "longest_repeat", "repeats"]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 3 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    for whole in batches:
        at = 0
        while at < whole.num_rows:
            texts, words, n = [], [], 0
            while at < whole.num_rows and (not texts or n < AT_ONCE):
                texts.append(whole.column("text")[at].as_py() or "")
                words.append(texts[-1].encode().split())
                n += len(words[-1])
                at += 1
            batch = whole.slice(at - len(texts), len(texts))
            found = Repeats(words, least)
            size = np.array([len(w) for w in words], np.int64)
            count = lambda mask: np.bincount(found.of[mask], minlength=len(texts)).astype(np.int64)  # noqa: B023, E731
            twice, cover = count(covered(found.reach, 5)), covered(found.reach, least)
            over = count(cover)
            n_repeats, most = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for length, text, _ in found.found:
                n_repeats[text] += 1
                most[text] = max(most[text], length)
            lines = [[x for x in t.split("\n") if x.strip(SPACES)] for t in texts]
            chars = [len(t) - sum(map(t.count, SPACES)) for t in texts]
            failed = (size < 10) | (100 * twice > 20 * size)
            kept = ~failed & (100 * over <= percent * size) & (most <= longest)
            spans: list[list] = [[] for _ in texts]
            for a, b in np.flatnonzero(np.diff(np.concatenate([[0], cover, [0]]))).reshape(-1, 2).tolist():
                while a < b:  # a run that goes from one text to the next is one in each
                    text = int(found.of[a])
                    stop = min(b, int(found.ends[text]))
                    base = int(found.ends[text]) - int(size[text])
                    spans[text].append({"start": a - base, "end": stop - base})
                    a = stop
            columns = [size, chars, [sum(map(t.count, SYMBOLS)) for t in texts], [len(x) - len(set(x)) for x in lines], twice, failed, kept, over, n_repeats, most, spans]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds)]], ["doc_id", *names])


def judge_quality(docs: DataFrame, least: int = LEAST, percent: int = COVERED, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept for every row of
    docs(doc_id, text), with covered_words (in repeats of `least` words or more), n_repeats (how many maximal ones),
    longest_repeat (in words, 0 for none) and repeats (the union of their spans, as word numbers from 0, end exclusive).

    base_failed: fewer than 10 words, or over 20 % of them in 5-word windows found twice. kept: not base_failed, no
    more than `percent` % of the words in repeats, and no repeat of over `longest` words.

    A null text is one without words, and not kept. Repeated rows are judged each, rows without doc_id too; other
    columns are ignored. A text is sorted in one task, with a rank of 4 bytes a word for each doubling of its longest
    repeat; there is no shuffle.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, n_repeats long, longest_repeat long, repeats array<struct<start: long, end: long>>"
    return docs.select("doc_id", "text").mapInArrow(task("parkflow.llm.quality", "quality_batches", least=least, percent=percent, longest=longest), f"doc_id {kind}, {columns}")
