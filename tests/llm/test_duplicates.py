"""Near duplicates against all pairs; SuperMinHash against its own definition."""

import random

import numpy as np

from parkflow.llm import neardup
from parkflow.operators.graph import connected_components


def plain_set(text, width=3):
    words = bytes(text or "", "utf-8").lower().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def plain_components(texts, percent=85):
    sets = [plain_set(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            n = len(a & b)
            if a and b and 100 * n >= percent * (len(a) + len(b) - n):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def family(rng, n, edits, words=80):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            k = rng.randrange(len(own))
            kind = rng.random()
            if kind < 0.6:
                own[k] = f"x{rng.randrange(5000)}"
            elif kind < 0.8:
                del own[k]
            else:
                own.insert(k, f"y{rng.randrange(5000)}")
        out.append(" ".join(own))
    return out


def check(docs_of, rows):
    got = {r.doc_id: r for r in neardup.near_duplicates(docs_of(rows)).collect()}
    sizes, components = plain_components(rows)
    assert len(got) == len(rows)
    for i in range(len(rows)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (sizes[i], components[i], components[i] == i), rows[i]


def test_near_duplicates(spark, docs_of, odd):
    rng = random.Random(1)
    rows = [*odd, "A b C", "a B c", "a b", "A B", "a b c d e f g h", "a b c d e f g h i", *["same text again and again"] * 30]
    rows += family(rng, 150, 9) + family(rng, 60, 5, 20) + family(rng, 40, 4, 12)
    chain = family(rng, 1, 1, 120)[0].split()
    for i in range(12):
        chain[i * 9] = f"c{i}"
        rows.append(" ".join(chain))
    check(docs_of, rows)


def test_given_documents(spark, docs_of):
    rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    check(docs_of, rows)


def test_blocks_of_one_hub(spark, docs_of):
    rng = random.Random(7)
    rows = family(rng, 120, 12, 60)
    df = docs_of(rows)
    texts = df.selectExpr("doc_id", "xxhash64(text) as of_text", "text")
    pairs = texts.filter("doc_id > 0").selectExpr("doc_id as a", "of_text as a_text").crossJoin(texts.filter("doc_id = 0").selectExpr("doc_id as hub", "of_text as hub_text"))
    links = neardup.all_links(pairs, texts, 3, 85, block=16)
    got = {r.id: r.component for r in connected_components(texts.selectExpr("doc_id as id"), links).collect()}
    assert [got[i] for i in range(len(rows))] == plain_components(rows)[1]


def test_empty_and_missing_ids(spark, docs_of):
    assert neardup.near_duplicates(docs_of(["x"]).limit(0)).collect() == []
    df = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c")], "doc_id long, text string")
    assert [tuple(r) for r in neardup.near_duplicates(df).collect()] == [(3, 1, 3, True)]


def test_two_texts_under_one_id(spark):
    """The text with the fewest shingles is the document; the other one links with nothing."""
    one, other = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, one), (5, other), (7, other), (8, other + " c"), (9, one), (9, None)]
    got = sorted(tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(5, 48, 5, True), (7, 58, 7, True), (8, 59, 7, False), (9, 0, 9, True)]


def plain_super_minhash(items, slots):
    """One item and one step at a time, without stopping early."""
    h = [float("inf")] * slots
    for x in items:
        p = list(range(slots))
        for j in range(slots):
            with np.errstate(over="ignore"):
                v = int(neardup.mix(np.array([x], np.uint64) + np.uint64(j + 1) * np.uint64(0x9E3779B97F4A7C15))[0])
            k = j + (v & 0xFFFFFF) % (slots - j)
            p[j], p[k] = p[k], p[j]
            h[p[j]] = min(h[p[j]], (j << 40) | (v >> 24))
    return h


def test_super_minhash():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 40, 300):
        items = rng.integers(0, 2**63, n).astype(np.uint64)
        with np.errstate(over="ignore"):
            assert neardup.super_minhash(items, 32).tolist() == plain_super_minhash(items, 32)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    with np.errstate(over="ignore"):
        same = np.mean([neardup.super_minhash(a[:900] + np.uint64(s)) == neardup.super_minhash(a[100:] + np.uint64(s)) for s in range(20)])
    assert abs(same - 0.8) < 0.04


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    parent = {i: i for i in range(400)}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        parent[q] = p
    got = connected_components(spark.range(400), spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == {i: find(i) for i in range(400)}
