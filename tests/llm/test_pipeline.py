"""The pipeline's stages, each against a plain version on its own input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parkflow.llm.queries import ORACLE_SQL, QUERIES, vocabulary
from tests.llm.test_duplicates import family, plain_components, plain_set
from tests.llm.test_small_operators import plain_targets
from tests.llm.test_text_operators import plain

STAGE = {f.__name__: f for _, f in corpus_pipeline.STAGES}


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_stages_are_in_order():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mixture", "pack"]


def test_language_stage(spark, docs_of, odd):
    docs = docs_of([*odd, ("12 34", None, None), ("hello there you all", "en", "a")])
    got = STAGE["language"](spark, docs, "")
    assert got.schema == docs.schema
    keep = [r for r in docs.collect() if re.search(r"[^\W\d_]", r.text or "")]
    assert rows_of(got) == sorted(map(repr, keep))


ODD_ROWS = "doc_id long, text string, lang string, source string, n_chars long, __row int, __hash string, __pii int, row_key string, position_in_run double, tags map<string,int>, `a.b` timestamp"


@pytest.fixture(scope="module")
def odd_rows(spark, tmp_path_factory):
    """Rows that differ in where their nulls are, in a map, in a column of any name; as rows and as files."""
    from datetime import datetime

    words = " ".join(f"word{i} of the text" for i in range(30))
    rows = [(1, None, "web", None), (1, None, None, "web"), (2, "web", None, None), (2, None, "web", None), (None, "", "en", "a"), (None, "", "en", "a"), (None, None, None, None), (3, words, "en", "a"), (3, words, "en", "b"), (4, words + " more", None, "b")]
    full = [(*r, None, i % 2, "h", 7, "k", 0.25, {"x": 1}, datetime(2024, 1, 1)) for i, r in enumerate(rows[:4])]
    full += [(*r, 5, None, None, None, None, None, {"x": i} if i < 2 else None, datetime(2024, 1, 1, 0, 0, 0, i)) for i, r in enumerate(rows[4:])]
    full += [full[0], (*full[0][:10], {"x": 2}, full[0][11])]
    df = spark.createDataFrame(full, ODD_ROWS)
    where = str(tmp_path_factory.mktemp("odd") / "rows.parquet")
    df.repartition(3).write.parquet(where)
    return df, spark.read.parquet(where), full


def test_duplicate_stage_loses_no_row(spark, odd_rows):
    rows, files, full = odd_rows
    for df in (rows, files, files.filter("true")):
        got = STAGE["near_duplicates"](spark, df, "")
        assert got.schema == df.schema
        # of the texts with words ("web" of one, the long ones) one each; of the others all that aren't repeated whole
        kept = [r for r in full if r[1] in (None, "")]
        want = {repr(spark.createDataFrame([r], ODD_ROWS).first()) for r in [*kept, full[2], full[7]]}
        found = [repr(r) for r in got.collect()]
        assert len(found) == len(set(found)) and {x for x in found if "word0" not in x} == {x for x in want if "word0" not in x}
        assert sum("word0" in x for x in found) == 1


@pytest.mark.parametrize("name", ["language", "personal_data", "mixture"])
def test_stages_keep_columns_of_any_name(spark, odd_rows, name):
    for df in odd_rows[:2]:
        got = STAGE[name](spark, df, "")
        assert got.schema == df.schema
        rows, given = got.collect(), [tuple(r)[5:] for r in df.collect()]
        assert rows and all(tuple(r)[5:] in given for r in rows)
        if name == "personal_data":
            assert rows_of(got) == rows_of(df)


def test_language_stage_rejects_what_fits_no_language(spark, docs_of):
    rng = random.Random(2)
    real = [(r.text, r.lang, "a") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    junk = [" ".join("".join(rng.choice("bcdfghjkqvwxzçłß") for _ in range(rng.randint(5, 9))) for _ in range(40)) for _ in range(4)] + ["ꙮꙮꙮ ꙋꙋꙋꙋ ꙮꙋꙮ"]
    got = {r.doc_id for r in STAGE["language"](spark, docs_of([*real, *[(t, None, "a") for t in junk]]), "").collect()}
    assert got == set(range(len(real)))


def test_duplicate_stage(spark, docs_of, odd):
    texts = [*odd, "a b c d", "A b C d", "a b c e f g", "same again"] + ["copy of it all"] * 9
    docs = docs_of(texts)
    got = STAGE["near_duplicates"](spark, docs.unionAll(docs.filter("doc_id = 1")), "")
    assert got.columns == docs.columns
    _, components = plain_components(texts)
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, c in enumerate(components) if i == c)


def test_duplicate_stage_compares_rows_not_ids(spark, docs_of):
    one, other = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(60))
    docs = docs_of([one, other, other + " c", one, "x y", "x y"])
    docs = docs.withColumn("doc_id", F.expr("case when doc_id < 2 then 4 when doc_id = 5 then null else doc_id end"))
    for d in (docs, docs.repartition(3, "text")):
        got = STAGE["near_duplicates"](spark, d, "").collect()
        assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("3", one), ("2", other + " c"), ("4", "x y")])


def test_duplicate_stage_by_five_words(spark, docs_of, odd):
    rng = random.Random(3)
    long = [f"w{i}" for i in range(1200)]
    scattered = [f"v{i}" for i in range(1000)]
    edited = [f"e{i}" if i % 40 == 20 else w for i, w in enumerate(scattered)]  # 0.86 by three words, 0.78 by five
    texts = [*odd, " ".join(long[:1000]), " ".join(long), " ".join(scattered), " ".join(edited), *family(rng, 100, 9), *family(rng, 40, 5, 24)]
    sets = [plain_set(t, 5) for t in texts]
    component = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and 100 * n >= 80 * (len(a) + len(sets[j]) - n) and component[i] != component[j]:
                low, high = sorted((component[i], component[j]))
                component = [low if c == high else c for c in component]
    got = sorted(r.doc_id for r in STAGE["near_duplicates"](spark, docs_of(texts), "").collect())
    assert got == sorted(set(component))
    at = len(odd)
    assert at in got and at + 1 not in got and {at + 2, at + 3} <= set(got)


def test_personal_data_stage(spark, docs_of, odd):
    texts = [*odd, "write to a@b.co or +1 415 555 2671, 10.0.0.1", "4111 1111 1111 1111.1.1.1", None]
    docs = docs_of(texts)
    got = STAGE["personal_data"](spark, docs, "")
    assert got.columns == docs.columns
    for r in got.collect():
        text = texts[r.doc_id]
        out, at = "", 0
        for start, _, end, kind in plain(text):
            if start >= at:
                out += (text or "")[at:start] + f"[{kind.upper()}]"
            at = max(at, end)
        assert r.text == (None if text is None else out + text[at:])


def test_mixture_stage(spark, docs_of):
    texts = [(" ".join(["w"] * (5 + i % 7)), "en", s) for i, s in enumerate(["a"] * 60 + ["b"] * 40 + [None] * 30 + ["c"] * 2)] + [("", "en", "a"), (None, "en", "b")]
    docs = docs_of(texts)
    got = STAGE["mixture"](spark, docs, "")
    assert got.columns == docs.columns
    copies, words, sizes = Counter(), Counter(), Counter()
    for t, _, s in texts:
        sizes[s] += len((t or "").split())
    for r in got.collect():
        copies[r.doc_id] += 1
        words[r.source] += len(r.text.split())
        assert (r.text, r.source) == (texts[r.doc_id][0], texts[r.doc_id][2])
    assert max(copies.values()) <= 3
    for s, target in plain_targets(dict(sizes)).items():
        assert abs(words[s] - target) <= 12


def test_mixture_follows_the_curriculum_in_any_layout(spark, docs_of):
    rng = random.Random(8)
    texts = [(" ".join(["w"] * rng.randint(1, 30)), "en", s) for s in "a" * 90 + "b" * 25 + "c" * 12]
    docs = docs_of(texts)
    got = [r.doc_id for r in STAGE["mixture"](spark, docs, "").collect()]
    size = [len(t.split()) for t, _, _ in texts]
    sizes = {s: sum(n for n, (_, _, x) in zip(size, texts) if x == s) for s in "abc"}
    places = {}
    for g, (s, target) in zip((-0.5, 0.0, 0.5), sorted(plain_targets(sizes).items())):
        start = 0
        for i in sorted((i for i, t in enumerate(texts) if t[2] == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
            taken = sum(max(0, min(size[i], int(target) - r * sizes[s] - start)) for r in range(3))
            shares = [min(1, (start + size[i] / 2 + r * sizes[s]) / target) for r in range(int(taken / size[i] + 0.5))]
            places[i] = [x if g == 0 else (math.sqrt((1 - g) ** 2 + 4 * g * x) - (1 - g)) / (2 * g) for x in shares]
            start += size[i]
    assert Counter(got) == {i: len(p) for i, p in places.items() if p}
    assert max(map(len, places.values())) > 1 and min(map(len, places.values())) == 0
    order = [places[i].pop(0) for i in got]
    assert all(a <= b + 1e-9 for a, b in zip(order, order[1:]))

    mixed = docs.withColumn("doc_id", F.expr("if(doc_id % 5 = 0, null, if(doc_id % 5 = 1, 1, doc_id))")).withColumn("n_chars", F.hash("text", F.rand(1)))
    mixed = spark.createDataFrame(mixed.collect(), mixed.schema)
    first, second = ([tuple(r) for r in STAGE["mixture"](spark, d, "").collect()] for d in (mixed.coalesce(1), mixed.repartition(7, F.rand(2))))
    assert first == second and any(r[0] is None for r in first)


def test_pack_stage_and_run(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.withColumn("kept", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    fill, places = Counter(), {}
    for r in got:
        fill[r.sequence_id] += r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert max(fill.values()) <= 2048
    assert all(sum(n for _, n in sorted(p)[:k]) == o for p in places.values() for k, (o, _) in enumerate(sorted(p)))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in STAGE["personal_data"](spark, docs, "").collect()}
    for r in got[:60]:
        ids = [*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 0][r.start : r.start + r.length]
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)) == r.ids_crc32


@pytest.mark.parametrize("name", list(STAGE))
def test_empty_table(spark, docs_of, name):
    assert STAGE[name](spark, docs_of(["x"]).limit(0), "").collect() == []


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    order = sorted(df.columns)
    assert sorted(columns) == order
    at = [columns.index(c) for c in order]
    assert sorted(map(repr, ([r[c] for c in order] for r in df.collect()))) == sorted(map(repr, ([r[i] for i in at] for r in want.fetchall())))
