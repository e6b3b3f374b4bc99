"""Repeated strings against a count of all strings."""

import hashlib
import os
import random
import re
from collections import Counter

import pytest

from parkflow.llm import substrings


def plain(texts, least):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + least] for d in data for i in range(len(d) - least + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - least + 1):
            if seen[d[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        kept = bytes(b for b, g in zip(d, gone) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check(docs_of, texts, least, **options):
    got = {r.doc_id: r for r in substrings.remove_repeats(docs_of(texts), least, **options).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(plain(texts, least)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want, (i, texts[i])


def some_texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(30), prose(14)
    texts = [f"{prose(rng.randint(0, 40))} {passage} {prose(rng.randint(0, 40))}" for _ in range(60)]
    texts += [f"{prose(20)} {other[rng.randint(0, 30):]} {prose(9)}{passage[rng.randint(0, 60):]}" for _ in range(50)]
    texts += [prose(60)] * 3 + ["a" * 900, "ab" * 300, "x" * 63, "x" * 64, "y" * 65, passage, passage + passage]
    return texts


@pytest.mark.parametrize("group_rows", [50_000, 4])
def test_removed_bytes(spark, docs_of, odd, group_rows):
    check(docs_of, [*[t for t in odd if len(t or "") < 2000], *some_texts()], 64, group_rows=group_rows)


def test_given_documents(spark, docs_of):
    rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    check(docs_of, rows[:120], 400)


def test_long_texts_and_empty_table(spark, docs_of, odd):
    rows = ["x" * 20000, "word " * 3000, None, ""]
    got = {r.doc_id: r for r in substrings.remove_repeats(docs_of(rows)).collect()}
    assert [got[i].n_removed for i in range(4)] == [20000, 15000, 0, 0]
    assert substrings.remove_repeats(docs_of(["x"]).limit(0)).collect() == []


def test_every_long_string_holds_a_place():
    data = os.urandom(3000) + b"abc" * 400 + b"z" * 700
    at = set(substrings.places(data, 100)[0].tolist())
    assert all(any(p in at for p in range(i, i + 100 - substrings.GRAM + 1)) for i in range(len(data) - 99))


def test_intervals_are_the_tree():
    words = sorted(["banana", "bandana", "ban", "band", "can", "cane", "x"])
    lcp = [len(os.path.commonprefix(p)) for p in zip(words, words[1:])]
    assert sorted(substrings.intervals(lcp)) == sorted([(0, 0, 6), (3, 0, 3), (4, 2, 3), (3, 4, 5)])


def test_tree_gives_what_all_pairs_give():
    rng = random.Random(8)
    base = "".join(rng.choice("abcd") for _ in range(200))
    left, right = [], []
    for _ in range(150):
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(200)] = rng.choice("xyz")
        left.append("".join(t[:90][::-1][: rng.randint(60, 90)]).encode())
        right.append("".join(t[90:][: rng.randint(70, 110)]).encode())
    lengths = (100, 60)
    want: list[dict] = [{}, {}]
    for i in range(len(left)):
        for j in range(len(left)):
            a, b = (len(os.path.commonprefix([x[i], x[j]])) for x in (left, right))
            for reach, least in zip(want, lengths):
                if i != j and a + b >= least:
                    reach[i] = max(a, reach.get(i, (0, 0))[0]), max(b, reach.get(i, (0, 0))[1])
    assert substrings.tree_reaches(left, right, lengths) == want


def plain_passages(texts, shortest, words):
    """Runs of bytes in strings that also start elsewhere, with so many whole words."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + shortest] for d in data for i in range(len(d) - shortest + 1))
    out = []
    for d in data:
        inside = bytearray(len(d))
        for i in range(len(d) - shortest + 1):
            if seen[d[i : i + shortest]] > 1:
                inside[i : i + shortest] = b"\1" * shortest
        runs = [(m.start(), m.end()) for m in re.finditer(b"\1+", inside)]
        spots = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", d)]
        full = [r for r in runs if sum(r[0] <= a and b <= r[1] for a, b in spots) >= words]
        out.append((len(full), sum(b - a for a, b in full)))
    return out


@pytest.mark.parametrize("group_rows", [50_000, 4])
def test_passages(spark, docs_of, group_rows):
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(n))
    passages = [prose(n) for n in (9, 11, 12, 14, 30)]
    texts = [f"{prose(rng.randint(1, 30))} {passages[i % 5]}{rng.choice([' ', '.'])}{prose(rng.randint(1, 30))}" for i in range(90)]
    texts += [prose(40), None, "", passages[2], f"{passages[3]} {passages[3]}"]
    got = {r.doc_id: r for r in substrings.remove_repeats(docs_of(texts), 64, shortest=40, words=10, group_rows=group_rows).collect()}
    assert [(got[i].n_passages, got[i].passage_bytes) for i in range(len(texts))] == plain_passages(texts, 40, 10)
    assert any(r.n_passages and not r.n_removed for r in got.values())


def test_passages_within_one_document_do_not_count(spark, docs_of):
    line = " ".join(f"w{i}" for i in range(150))
    got = substrings.remove_repeats(docs_of([f"{line} and {line}", "other text"])).collect()
    assert [(r.n_passages, r.n_removed > 0) for r in sorted(got)] == [(0, True), (0, False)]
