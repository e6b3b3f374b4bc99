"""The Merkle manifest against a plain tree with hashlib."""

import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from parkflow.llm import manifest

KIND = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root int, s string, p string, part long, n long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels_of(nodes):
    """All levels of the tree over some nodes, from below."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def way(levels, at):
    for level in levels[:-1]:
        first = at // 16 * 16
        yield at - first, level[first:at] + level[at + 1 : first + 16]
        at //= 16


def plain(rows):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[1]].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in sources}
    top = levels_of([trees[s][-1][0] for s in sources]) if sources else []
    out = []
    for k, s in enumerate(sources):
        for at, (_, _, leaf, row) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            segments = [*way(trees[s], at), *way(top, k)]
            lower = row[4] and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4])
            own = leaf_of((*row[:4], lower)) if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 else leaf
            for digit, others in segments:
                own = h(*others[:digit], own, *others[digit:])
            root = top[-1][0]
            out.append((row[0], leaf, trees[s][-1][0], root, h(*[x for _, o in segments for x in o]), own, own == root))
    return Counter(out)


def rows_of(sizes):
    return [(1000 * k + i, s, "en" if i % 3 else None, i, f"Text {i} of Ünï {s}" if i % 7 else (None, "")[i % 2]) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"a": 1}, {None: 1}, {"a": 2, "b": 1}, {"a": 16, "b": 17, None: 1}, {"a": 300, "": 33, "é": 1, "z": 15}, {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_proofs(spark, sizes):
    rows = rows_of(sizes)
    df = spark.createDataFrame([(*r, "x", 1, "y", "z", 2, 3) for r in rows], KIND)
    got = manifest.verify_documents(df).collect()
    assert Counter(map(tuple, got)) == plain(rows)


def test_null_and_repeated_rows(spark):
    rows = [(None, "a", None, None, None), (None, "a", None, None, "X"), (5, None, None, None, "Y"), (5, "a", "de", 3, None), *[(7, "a", "de", 3, "Same")] * 40, *[(15, "a", "de", 3, "Other")] * 3, (7, "b", None, None, "")]
    df = spark.createDataFrame([(*r, "x", 1, "y", "z", 2, 3) for r in rows], KIND)
    assert Counter(map(tuple, manifest.verify_documents(df).collect())) == plain(rows)


def test_some_requests(spark):
    rows = rows_of({"a": 600, "b": 20, "c": 1})
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    leaves = df.select("doc_id", "source", manifest.leaf_digest({c: F.col(c) for c in manifest.FIELDS}).alias("leaf"), F.monotonically_increasing_id().alias("__row"))
    made = manifest.build_manifest(leaves)
    asked = made.runs.select("s", "p", F.filter("own", lambda x: x["doc_id"].isin(3, 599, 1019, 2000)).alias("wanted")).filter(F.size("wanted") > 0)
    found = manifest.prove(made, asked).select("root", F.explode("own").alias("x")).select("root", "x.*").collect()
    assert sorted(r.doc_id for r in found) == [3, 599, 1019, 2000]
    for r in found:
        own = r.leaf
        for digit, others in r.segments:
            own = h(*others[:digit], own, *others[digit:])
        assert own == r.root
    assert len({r.root for r in found}) == 1


def test_each_step_is_planned_once(spark):
    """The plan grows with the height of the tallest tree, not with its power."""
    rows = spark.range(4400).select("id", F.when(F.col("id") < 4200, "a").when(F.col("id") < 4390, "b").when(F.col("id") < 4399, "c").otherwise("d").alias("source"))
    leaves = rows.select(F.col("id").alias("doc_id"), "source", manifest.digest(F.col("id").cast("string")).alias("leaf"), F.col("id").alias("__row"))
    made = manifest.build_manifest(leaves)
    found = manifest.prove(made, made.runs.select("s", "p", F.col("own").alias("wanted")))
    assert len(made.tree) == 4 and found._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode") == 3
    checked = found.select("root", F.explode("own").alias("x")).filter(manifest.fold(F.col("x.leaf"), F.col("x.segments")) == F.col("root"))
    assert checked.select("x.doc_id").distinct().count() == 4400
