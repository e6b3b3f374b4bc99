"""The prefix trie against a plain one."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import md5, sha256

import pytest

from parkflow.llm import trie

KIND = "conv_id long, turn long, role string, text string, n_convs long, node string, pos int, block int, depth string"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    key = lambda t: (t[0], t[1], md5(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).hexdigest())
    own = {c: [t[2:] for t in sorted(v, key=key)] for c, v in own.items()}
    convs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
    members = defaultdict(set)
    for c, s in convs.items():
        for d in range(len(s) + 1):
            members[s[:d]].add(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for s in members:
        if s:
            children[s[:-1]] += 1
    for s, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        for d in range(len(s) + 1):
            leaves[s[:d]] += s not in children
            saved[s[:d]] += (len(m) - 1) * words
    ends = lambda s: sha256(",".join(map(str, sorted(c for c in members[s] if len(convs[c]) == len(s)))).encode()).hexdigest()
    return Counter((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), children[s], leaves[s], saved[s], ends(s)) for s, m in members.items())


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2, 3, "y") for r in rows], KIND)
    return Counter(map(tuple, trie.rebuilt_trie(df).collect()))


def made(rng, n, longest, roles=("user", "assistant", None), texts=("a b", "c", "", None, "d  e\tf")):
    return [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(n) for t in range(rng.randint(1, longest))]


@pytest.mark.parametrize(("n", "longest"), [(0, 1), (1, 1), (60, 6), (50, 12)])
def test_small_tries(spark, n, longest):
    rows = made(random.Random(n), n, longest)
    assert run(spark, rows) == plain(rows)


def test_long_conversations(spark):
    rng = random.Random(5)
    base = [(rng.choice("ab"), f"t{i}") for i in range(150)]
    rows = []
    for c in range(40):
        n = rng.choice([7, 8, 9, 39, 40, 41, 71, 72, 73, 105, 150])
        own = list(base[:n])
        if c % 3 == 0:
            own[rng.randrange(3, n)] = ("x", f"other {c}")
        rows += [(c, t, *x) for t, x in enumerate(own)]
    assert run(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (0, None, "user", "n"), (0, None, "user", "n"), (0, 5, None, None), (0, 5, None, ""), (3, 1, "u", "a"), (7, 2, "u", "a"), (7, 1, "u", "a"), (21, 1, "u", "a"), (27, 0, "u", "a"), (33, 0, "u", "a"), (-3, 1, "u", "b"), (10**15, 1, "u", "a")]
    rows = [r for r in rows if r[0] != -3]
    assert run(spark, rows) == plain(rows)


def test_given_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert Counter(map(tuple, trie.rebuilt_trie(df).collect())) == plain(rows)


def test_ends_of_one_node_in_chunks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(trie, "CHUNK", 3)
    ids = {"a": list(range(8)), "b": [5], "c": [1, 2, 3]}
    rows = [(n, c) for n, v in ids.items() for c in v]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), pa.array([r[1] for r in part])], ["node", "conv_id"]) for part in (rows[:4], rows[4:9], rows[9:])]
    chunks = list(trie.chunk_batches(iter(batches)))
    assert sum(b.num_rows for b in chunks) == 5
    got = {n: s for b in trie.hash_batches(iter(chunks)) for n, s in zip(*[c.to_pylist() for c in b.columns])}
    assert got == {n: sha256(",".join(map(str, v)).encode()).hexdigest() for n, v in ids.items()}
