"""Token counts, packing, mixing, media and top-k against plain versions."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from parkflow.llm import media, mixing, packing, tokencount, topk
from parkflow.llm.queries import vocabulary

PATHS = {"piece": vocabulary("piece_bpe_32k.model"), "word": vocabulary("word_bpe_49k.json")}


def texts(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]


def test_token_counts(spark, docs_of, odd):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATHS["piece"])
    rows = [*odd, *texts(spark)]
    got = {r.doc_id: r for r in tokencount.count_tokens(docs_of(rows), PATHS["piece"]).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        n = len(model.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 4096), t


def test_frequent_words_come_from_the_corpus(spark, docs_of, odd):
    words = tokencount.frequent_words(docs_of(["b a a c", "c a  c\nb d", None, "", "a" * 90, "▁x ▁x ▁x ▁x"]), 3)
    assert words == ["▁x", "a", "c"]
    table = tokencount.LengthTable([*words, "internationally"], PATHS["piece"])
    lengths = tokencount.Lengths(tokencount._model(PATHS["piece"]), {})
    assert table.open() == {f" {w}": lengths[f" {w}"] for w in ("a", "c", "internationally")} and max(table.open().values()) > 1
    assert tokencount.LengthTable([], PATHS["piece"]).open() == {} and tokencount.frequent_words(docs_of(["x"]).limit(0)) == []


def test_packing(spark, docs_of, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATHS["word"])
    rows = [*odd, *texts(spark)]
    got = packing.pack_documents(docs_of(rows), PATHS["word"], 2048, shard_rows=60).collect()
    by_doc, by_sequence = defaultdict(dict), defaultdict(list)
    for r in got:
        by_doc[r.doc_id][r.piece] = r
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(rows):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert sorted(by_doc[i]) == list(range(-(-len(ids) // 2048)))
        for k, r in by_doc[i].items():
            part = ids[2048 * k : 2048 * (k + 1)]
            assert (r.start, r.length, r.ids_crc32) == (2048 * k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())), t
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) <= 1.06 * sum(r.length for r in got) / 2048 + 2


def test_evolution_never_loses_items():
    import random

    rng = random.Random(4)
    lengths = [rng.randint(1, 900) for _ in range(300)]
    a, b = packing.Bins(lengths, 1000), packing.Bins(lengths, 1000)
    a.best_fit(range(300))
    b.best_fit(sorted(range(300), key=lambda x: -lengths[x]))
    for child in (packing.crossover(a, b, rng), packing.mutate(a, rng), packing.evolve(lengths, 1000, 1, [])):
        assert sorted(x for items in child.bins for x in items) == list(range(300))
        assert all(sum(lengths[x] for x in items) == 1000 - f >= 0 for items, f in zip(child.bins, child.free))
    assert len(packing.evolve(lengths, 1000, 1, [a, b]).bins) <= min(len(a.bins), len(b.bins))


def triplets(seed, n):
    """Items of which three fill a bin each, so that n bins are enough."""
    import random

    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a, b = rng.randint(260, 480), rng.randint(260, 370)
        out += [a, b, 1000 - a - b]
    rng.shuffle(out)
    return out


def uniform(seed):
    import random

    rng = random.Random(seed)
    return [rng.randint(150, 600) for _ in range(45)]


@pytest.mark.parametrize("kind", ["triplets", "uniform"])
def test_islands_beat_best_fit(spark, kind):
    """What best fit of the longest first needs, islands apart, and islands that send each other their best."""
    make = (lambda s: triplets(s, 40)) if kind == "triplets" else uniform
    data = {shard: make(shard) for shard in range(8)}
    rows = [(shard, 1000 * shard + i, n) for shard, own in data.items() for i, n in enumerate(own)]
    items = spark.createDataFrame(rows, "shard long, item long, length int")
    used = {}
    for rounds in (0, 3):
        got = packing.search(items, 1000, islands=2, rounds=rounds).collect()
        fill = defaultdict(int)
        for r in got:
            fill[r.shard, r.bin] += r.length
        assert sorted((r.shard, r.item, r.length) for r in got) == sorted(rows) and max(fill.values()) <= 1000
        used[rounds] = len(fill)
    plain = 0
    for own in data.values():
        bins = packing.Bins(own, 1000)
        bins.best_fit(sorted(range(len(own)), key=lambda x: -own[x]))
        plain += len(bins.bins)
    assert used[3] <= used[0] < plain
    assert used[3] < used[0] or kind == "triplets"


def test_leftovers_of_shards_are_packed_together(spark):
    rows = [(100 + i % 7,) for i in range(400)]
    pieces = spark.createDataFrame(rows, "length int")
    got = packing.pack_pieces(pieces, 1000, shard_rows=20).collect()
    fill = defaultdict(int)
    for r in got:
        fill[r.sequence_id] += r.length
    assert len(got) == 400 and max(fill.values()) <= 1000
    assert len(fill) <= 400 // 9 + 3  # nine fit; each of the 20 shards would leave one part-filled


def plain_targets(sizes, epochs=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * share > epochs * sizes[s]}
        if not full:
            return target | {s: weight[s] * share for s in open_}
        for s in full:
            target[s] = float(epochs * sizes[s])
            left -= target[s]
        open_ -= full
    return target


def test_mixing(spark, docs_of, odd):
    rows = [(t, None, s) for s, n in (("a", 40), ("b", 3), (None, 20), ("é", 1), ("z", 5), ("", 2)) for t in (odd + texts(spark))[-n:]]
    rows += [(None, "en", "empty"), ("", None, "empty")]
    got = mixing.mix_sources(docs_of(rows)).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for t, _, s in rows:
        sizes[s] += len((t or "").encode().split())
    targets = plain_targets(sizes)
    for r in got:
        t, _, s = rows[r.doc_id]
        assert (r.source, r.size, r.source_size) == (s, len((t or "").encode().split()), sizes[s])
        assert math.isclose(r.target, targets[s], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        assert (r.first_position is None) == (r.taken == 0) and (r.taken == 0 or 0 <= r.first_position <= 1)
        taken[s] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)
    assert sum(taken.values()) == pytest.approx(sum(sizes.values()), abs=len(sizes))


def test_curriculum_inverts_demand(spark):
    df = spark.range(101).selectExpr("id / 100 as t")
    from pyspark.sql import functions as F

    for g in (-0.5, 0.0, 0.5):
        t = F.col("t")
        back = df.select(t, mixing.time_of(t + g * (t * t - t), F.lit(g)).alias("back")).collect()
        assert all(abs(r.t - r.back) < 1e-9 for r in back)


def test_training_order_is_sorted(spark, docs_of):
    order = mixing.training_order(mixing.mix_sources(docs_of([("a b c", "en", s) for s in "aabbcc"]))).collect()
    assert [r.first_position for r in order] == sorted(r.first_position for r in order)


def test_every_round_has_its_position(docs_of):
    mix = mixing.mix_sources(docs_of([("a b c d", "en", s) for s in "aaaaaaaabbc"]))
    rows = mix.collect()
    assert [r.first_position for r in rows] == sorted((r.first_position for r in rows), key=lambda x: (x is not None, x))
    for r in rows:
        assert len(r.positions) == -(-r.taken // r.size) and r.positions == sorted(r.positions)
        assert r.first_position == (r.positions[0] if r.positions else None)
    order = [r.position for r in mixing.training_rounds(mix).collect()]
    assert order == sorted(order) == sorted(p for r in rows for p in r.positions)
    assert max(len(r.positions) for r in rows) > 1


def test_media_round_trip(spark, docs_of, odd):
    rows = [*odd, *texts(spark)[:60], bytes(range(128)).decode() * 100, "ÿ" * 5000]
    stored = media.store_media(docs_of(rows))
    got = {r.doc_id: r for r in media.media_features(stored).collect()}
    files = {r.doc_id: bytes(r.media) for r in stored.collect()}
    for i, t in enumerate(rows):
        data = (t or "").encode()
        payload = data + b"\0" * (-len(data) % 64) if data else b"\0" * 64
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(files[i]), hashlib.sha256(files[i]).hexdigest())
        assert r.clips[0].first_frame == 0 and all(a.end_frame == b.first_frame for a, b in zip(r.clips, r.clips[1:]))
    assert got[7].feature == got[8].feature and got[7].media_sha256 == got[8].media_sha256
    assert media.clips(media.media_features(stored)).count() == sum(len(r.clips) for r in got.values())


def test_lossless_frames_and_shots():
    rng = np.random.default_rng(3)
    frames = rng.integers(0, 256, (5, 7, 64), dtype=np.uint8)
    frames[1] = 255
    frames[2] = 0
    assert (media.decode_frames(media.encode_frames(frames)) == frames).all()
    still = np.full((30, 8, 64), 40, np.uint8)
    still[15:] = 200
    assert media.detect_shots(still)[0] == [0, 15]


def test_top_k(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in rng.normal(size=20) * (1 if i % 3 else 0.2)]) for i in range(300)]
    vectors += [(300, None), (301, [None] * 20), (302, [float("nan")] * 20), (303, [float("inf")] * 20), (350, vectors[7][1]), (351, vectors[7][1]), (400, [1.0] * 3), (401, [2.0] * 3), (402, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<float>, rank int, score int")
    got = topk.top_k(df.unionAll(df.filter("vec_id = 9")).repartition(5), df.filter("vec_id % 50 = 0"), 5, query_rows=3, candidate_rows=64, block=16).collect()
    clean = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in clean:
        if q % 50 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(clean[q], v)), i) for i, v in clean.items() if i != q and len(v) == len(clean[q])))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_top_k_of_repeated_rows(spark):
    import duckdb

    rows = [(0, [1.0, 0.0])] * 3 + [(1, [9.0, 0.0])] * 20 + [(2, [8.0, 1.0])] * 7 + [(3, [0.5, 0.0]), (3, [7.0, 0.0])] + [(i, [7.0 - i / 10, 2.0]) for i in range(4, 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    given = "with v as (select unnest(?) as vec_id, unnest(?::double[][]) as e), d as (select distinct vec_id, list_transform(e, lambda x: floor(256*x)) as e from v)"
    want = duckdb.execute(given + """, s as (select q.vec_id as q, c.vec_id as c, max(cast(list_dot_product(q.e, c.e) as bigint)) as s from d q join d c on q.vec_id=0 and c.vec_id<>0 group by 1,2)
     select q, row_number() over (order by s desc, c) as r, c, s from s qualify r<=5""", [[i for i, _ in rows], [v for _, v in rows]]).fetchall()
    for part in (df.coalesce(1), df.repartition(4)):
        for block in (8192, 6):
            got = topk.top_k(part, df.filter("vec_id = 0"), 5, candidate_rows=block, block=block).collect()
            assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    few = topk.top_k(df.filter("vec_id < 3").coalesce(1), df.filter("vec_id = 0"), 5).collect()
    assert sorted((r["rank"], r.vec_id) for r in few) == [(1, 1), (2, 2)]


@pytest.mark.parametrize("scale", [1, 256])
def test_top_k_of_large_values(spark, scale):
    """Exact at any size; scores are clamped to what a long holds, ties to the smaller id."""
    vectors = {0: [1e12, 1.0, 0.0], 1: [1e12, 2.0, 5.0], 2: [1e12, 3.0, -5.0], 3: [-3e12, 1e300, 1.0], 4: [1e308, 1e308, 1.0], 5: [-1e308, 3.0, 3.0], 6: [2e9, 7.0, 1.0], 7: [-2e9, 7.0, 1.0], 8: [3e5, 0.0, 0.0], 9: [-1e200, -1e250, 0.0], 10: [-1e300, 0.0, 0.0], 11: [-1e301, 0.0, 0.0]}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    most = np.finfo(np.float64).max
    clean = {i: [int(min(max(np.floor(scale * np.float64(x)), -most), most)) for x in v] for i, v in vectors.items()}
    for k in (2, 5, 11):
        got = topk.top_k(df, df, k, scale=scale, block=4).collect()
        want = []
        for q, v in clean.items():
            scores = sorted((-min(max(sum(a * b for a, b in zip(v, w)), -(2**63)), 2**63 - 1), i) for i, w in clean.items() if i != q)
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


@pytest.mark.parametrize("call", [lambda d: tokencount.count_tokens(d, PATHS["piece"]), lambda d: packing.pack_documents(d, PATHS["word"]), mixing.mix_sources, lambda d: media.media_features(media.store_media(d))])
def test_empty_table(docs_of, call):
    assert call(docs_of(["x"]).limit(0)).collect() == []
