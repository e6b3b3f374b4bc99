"""Quality rules against plain counting of windows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parkflow.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def covered(words, k):
    n = Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return len({j for i in range(len(words) - k + 1) if n[tuple(words[i : i + k])] > 1 for j in range(i, i + k)})


def maximal(words, least):
    """Every repeated substring that no longer one covers at all of its places."""
    where = defaultdict(list)
    for a in range(len(words)):
        for b in range(a + least, len(words) + 1):
            where[tuple(words[a:b])].append(a)
    out = []
    for s, at in where.items():
        if len(at) > 1 and len({words[a - 1] if a else None for a in at}) > 1 and len({words[a + len(s)] if a + len(s) < len(words) else None for a in at}) > 1:
            out.append((len(s), at))
    return sorted(out)


def plain(text, least=quality.LEAST):
    words = WORD.findall(text or "")
    n, twice, over = len(words), covered(words, 5), covered(words, least)
    longest = next((k for k in range(n - 1, least - 1, -1) if covered(words, k)), 0) if over else 0
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = n < 10 or 100 * twice > 20 * n
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), twice, failed, not failed and 100 * over <= 15 * n and longest <= 50, over, longest)


def long_text(rng, n, *repeats):
    words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    for size, times in repeats:
        own = [f"r{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(times):
            at = rng.randrange(len(words))
            words[at:at] = [f"x{rng.randrange(10**6)}", *own]
    return " ".join(words)


def test_rules(spark, docs_of, odd):
    rng = random.Random(3)
    rows = [*odd, *[r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if len(r.text) < 20_000]]
    rows += [long_text(rng, 600, (51, 2)), long_text(rng, 600, (50, 2)), long_text(rng, 100, (12, 2)), long_text(rng, 150, (12, 2)), long_text(rng, 90, (9, 2)), "a\nb\na \na\n\n\n", "a b c d e " * 3, "# * $ % & | < > " + " ".join(map(str, range(20)))]
    got = {r.doc_id: r for r in quality.judge_quality(docs_of(rows)).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        r = got[i]
        want = plain(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.covered_words, r.longest_repeat) == want, t
        assert sum(s.end - s.start for s in r.repeats) == r.covered_words
        assert all(a.end < b.start for a, b in zip(r.repeats, r.repeats[1:]))
    assert [got[len(rows) - 8 + k].kept for k in range(5)] == [False, True, False, True, True]
    assert quality.judge_quality(docs_of(["x"]).limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), min_size=1, max_size=4), st.integers(2, 6))
def test_maximal_repeats(texts, least):
    found = quality.Repeats(texts, least)
    by_text = defaultdict(list)
    for text, length, at in found.maximal():
        by_text[text].append((length, at))
    for i, t in enumerate(texts):
        assert sorted(by_text[i]) == maximal(t, least)


@pytest.mark.parametrize("n", [1, 2, 3, 1000])
def test_suffix_array(n):
    s = np.random.default_rng(n).integers(0, 3, n)
    order, levels = quality.suffix_array(s)
    assert order.tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
    shared = quality.common_prefixes(order, levels, 1)
    for a, b, k in zip(order, order[1:], shared[1:]):
        own = next((j for j, (x, y) in enumerate(zip(s[a:], s[b:])) if x != y), min(n - a, n - b))
        assert own == k


def test_one_word_many_times():
    found = quality.Repeats([[b"a"] * 50_000], 10)
    assert found.reach.max() == 49_999 and quality.covered(found.reach, 10).all()
