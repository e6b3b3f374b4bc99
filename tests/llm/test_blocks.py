"""Blocks of documents compared with one hub: bounded memory, the same links."""

import random
import tracemalloc

import pyarrow as pa

from parkflow.llm import neardup


def block(rng, n, size, hub=20_000):
    rows = []
    for i in range(n):
        lacks = sorted(rng.sample(range(hub), size))
        rows.append({"hub": 0, "a": i, "n": hub, "n_hub": hub, "link": i % 5 == 0, "lacks": lacks, "beside": [rng.getrandbits(62) for _ in range(size)]})
    kinds = pa.schema([("hub", pa.int64()), ("a", pa.int64()), ("n", pa.int64()), ("n_hub", pa.int64()), ("link", pa.bool_()), ("lacks", pa.list_(pa.int64())), ("beside", pa.list_(pa.int64())), ("side", pa.int32())])
    x = [r | {"side": 0} for r in rows]
    y = [r | {"side": 1} for r in rows if not r["link"]]
    return rows, pa.concat_tables([pa.Table.from_pylist(p, kinds) for p in (x, y)])


def test_links_within_a_block():
    rng = random.Random(1)
    rows, table = block(rng, 40, 30, 100)
    for r in rows[1:9]:
        r["lacks"], r["beside"] = sorted({*rows[9]["lacks"][:-1], rng.randrange(100)}), rows[9]["beside"][:-2]
        r["n"] = 100 - len(r["lacks"]) + len(r["beside"])
    table = pa.concat_tables([pa.Table.from_pylist([r | {"side": s} for r in rows if s == 0 or not r["link"]], table.schema) for s in (0, 1)])
    sets = [set(range(100)) - set(r["lacks"]) | {-1 - b for b in r["beside"]} for r in rows]
    component = list(range(40))
    for a in range(40):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if (100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n) or rows[a]["link"] and rows[b]["link"]) and component[a] != component[b]:
                low, high = sorted((component[a], component[b]))
                component = [low if c == high else c for c in component]
    found = neardup.link_apart(table, 80).to_pylist()
    got = list(range(40))
    for a, b in [(r["a"], r["b"]) for r in found] + [(5 * i, 5 * i + 5) for i in range(7)]:
        if got[a] != got[b]:
            low, high = sorted((got[a], got[b]))
            got = [low if c == high else c for c in got]
    assert got == component and len(set(component)) < 30


def test_memory_of_a_block():
    _, table = block(random.Random(2), 120, 4000)
    tracemalloc.start()
    neardup.link_apart(table, 85)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 6 * table.nbytes
