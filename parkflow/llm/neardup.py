"""Near-duplicate documents by SuperMinHash signatures, banding, exact verification and connected components.

Documents with the same shingle set count as one from the start. Bands of the signatures put the others into buckets.
The pairs of a bucket are never all listed: each document is compared with its bucket's most central one (the one that
shares the most bands with others), links are joined to components, and further rounds compare what is still apart.
Which pairs can still link follows from how the two share the shingles of the centre they were compared with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parkflow.llm.common import heavy_join, saved, task
from parkflow.operators.graph import connected_components

SLOTS, ROWS = 125, 5
BANDS = SLOTS // ROWS
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; A-Z in lower case, words between white space."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < width:
        out = np.array([len(words)], np.uint64)
        for x in h:
            out = mix(out * _M2 + x)
        return out
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = mix(out * _M2 + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def super_minhash(items: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The signature: slot p[j] takes the least r_j + j over the items, for a random order p and random r of each item.

    All items take step j together. The search stops early: once every slot holds a value below j + 1, later steps
    can't lower any. Random numbers are bits of a hash of the item and the step.
    """
    n = len(items)
    signature = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    order = np.broadcast_to(np.arange(slots, dtype=np.int16), (n, slots)) if n else None
    every = np.arange(n)
    for j in range(slots):
        h = mix(items + np.uint64(j + 1) * np.uint64(0x9E3779B97F4A7C15))
        k = j + (h & np.uint64(0xFFFFFF)).astype(np.int64) % (slots - j)
        value = (np.uint64(j) << np.uint64(40)) | (h >> np.uint64(24))
        if j == 0:
            slot = k
        else:
            if j == 1:
                order = order.copy()
                order[every, first], order[:, 0] = 0, first
            slot = order[every, k].astype(np.int64)
            order[every, k] = order[:, j]
            order[:, j] = slot
        first = slot
        np.minimum.at(signature, slot, value)
        if int(signature.max()) >> 40 <= j:
            break
    return signature


def band_hashes(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(-1, ROWS)
    out = mix(np.arange(1, len(rows) + 1, dtype=np.uint64))
    for k in range(ROWS):
        out = mix(out * _M2 + rows[:, k])
    return out.view(np.int64)


def sign_batches(batches: Iterator[pa.RecordBatch], width: int, bands: int = BANDS) -> Iterator[pa.RecordBatch]:
    """doc_id, n_shingles, two halves of a hash of the set, the text's own hash, and the bands."""
    with np.errstate(over="ignore"):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                n, one, two, hashes = [], [], [], []
                for text in batch.column("text"):
                    s = shingle_set(text.as_py(), width)
                    n.append(len(s))
                    one.append(int(mix(s + np.uint64(1)).sum(dtype=np.uint64).astype(np.int64)))
                    two.append(int(mix(s ^ _M1).sum(dtype=np.uint64).astype(np.int64)))
                    hashes.append(band_hashes(super_minhash(s, bands * ROWS)) if len(s) else [])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), batch.column("of_text"), pa.array(hashes, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "one", "two", "of_text", "bands"])


_kept: dict = {}


def _cached_set(key, text: str, width: int) -> np.ndarray:
    if key not in _kept:
        if len(_kept) > 64:
            _kept.clear()
        _kept[key] = shingle_set(text, width)
    return _kept[key]


def compare_batches(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, hub) of whole texts: the sizes of both sets, whether they link, and how a differs from the hub: which
    of the hub's shingles (by rank in its sorted set) it lacks, and which it has besides."""
    _kept.clear()
    with np.errstate(over="ignore"):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows: list[list] = [[], [], [], [], []]
                for b, ta, tb in zip(batch.column("hub").to_pylist(), batch.column("text_a"), batch.column("text_b")):
                    x, hub = shingle_set(ta.as_py(), width), _cached_set(b, tb.as_py(), width)
                    lacks = np.flatnonzero(~np.isin(hub, x, assume_unique=True))
                    common = len(hub) - len(lacks)
                    beside = x[~np.isin(x, hub, assume_unique=True)] if common < len(x) else x[:0]
                    for column, value in zip(rows, (len(x), len(hub), 100 * common >= percent * (len(x) + len(hub) - common), lacks, beside.view(np.int64))):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("hub"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.bool_()), pa.array(rows[3], pa.list_(pa.int64())), pa.array(rows[4], pa.list_(pa.int64()))], ["a", "hub", "n", "n_hub", "link", "lacks", "beside"])


def _features(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of each feature: a shingle that a row lacks or has besides."""
    rows, values = [], []
    for name, besides in (("lacks", 0), ("beside", 1)):
        lists = part.column(name)
        rows.append(np.repeat(np.arange(part.num_rows, dtype=np.int32), pc.list_value_length(lists).to_numpy().astype(np.int64)))
        values.append((pc.list_flatten(lists).to_numpy() << 1) | besides)
    return np.concatenate(rows), np.concatenate(values)


def _shared(row: np.ndarray, values: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each feature that is one of `keep`, in the order of the columns."""
    column = np.minimum(np.searchsorted(keep, values), len(keep) - 1)
    ok = keep[column] == values
    row, column = row[ok], column[ok].astype(np.int32)
    order = np.argsort(column, kind="stable")
    return row[order], column[order]


def link_apart(table: pa.Table, percent: int) -> pa.Table:
    """Links between documents that don't link with the hub (side y) and others compared with it (side x).

    Both sets follow from what they lack and have besides: common = hub - lacks of either + lacks of both + besides of
    both. Of all links, a spanning forest is enough; those that link with the hub are one tree already. The lists stay
    arrays of numbers, as they came.
    """
    side = table.column("side").to_numpy()
    xs, ys = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
    out_a, out_b = [], []
    if xs.num_rows and ys.num_rows:
        x, y = _features(xs), _features(ys)
        keep = np.intersect1d(np.unique(x[1]), np.unique(y[1]), assume_unique=True)
        both = np.zeros((ys.num_rows, xs.num_rows), np.float32)
        if len(keep):
            (xr, xc), (yr, yc) = _shared(*x, keep), _shared(*y, keep)
            for at in range(0, len(keep), 4096):
                size = min(4096, len(keep) - at)
                mx, my = np.zeros((xs.num_rows, size), np.float32), np.zeros((ys.num_rows, size), np.float32)
                for m, r, c in ((mx, xr, xc), (my, yr, yc)):
                    a, b = np.searchsorted(c, [at, at + size])
                    m[r[a:b], c[a:b] - at] = 1
                both += my @ mx.T
        numbers = lambda part, name: part.column(name).to_numpy()
        n_x, n_y = numbers(xs, "n"), numbers(ys, "n")
        d_x, d_y = (pc.list_value_length(part.column("lacks")).to_numpy().astype(np.int64) for part in (xs, ys))
        common = np.rint(both).astype(np.int64) + int(numbers(xs, "n_hub")[0]) - d_x[None, :] - d_y[:, None]
        links = 100 * common >= percent * (n_x[None, :] + n_y[:, None] - common)
        id_x, id_y = xs.column("a").to_pylist(), ys.column("a").to_pylist()
        parent = list(range(len(id_x) + len(id_y) + 1))  # the last is the hub's tree

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        of = {a: len(id_y) + j for j, a in enumerate(id_x)}
        for i, a in enumerate(id_y):
            if a in of:
                parent[find(of[a])] = find(i)
        for j in np.flatnonzero(xs.column("link").to_numpy()):
            parent[find(len(id_y) + j)] = find(len(parent) - 1)
        for i, j in np.argwhere(links):
            p, q = find(i), find(len(id_y) + j)
            if p != q:
                parent[p] = q
                out_a.append(id_y[i])
                out_b.append(id_x[j])
    kind = table.schema.field("a").type
    return pa.table({"a": pa.array(out_a, kind), "b": pa.array(out_b, kind)})


#: A block of documents that are compared with one hub holds about so many numbers (of 8 bytes) of how they differ from it.
NUMBERS = 2_000_000


def hub_pairs(sets: DataFrame) -> DataFrame:
    """a and hub: each document of sets(rep, bands) with the most central one of each of its buckets."""
    buckets = sets.select(F.col("rep").alias("a"), F.explode("bands").alias("band"))
    sizes = buckets.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = saved(buckets.join(sizes, "band"))
    central = buckets.groupBy("a").agg(F.sum("size").alias("central"))
    hubs = buckets.join(central, "a").groupBy("band").agg(F.min(F.struct((-F.col("central")).alias("less"), "a")).alias("h")).select("band", F.col("h.a").alias("hub"))
    return buckets.join(hubs, "band").filter("a <> hub").select("a", "hub").distinct()


def all_links(pairs: DataFrame, texts: DataFrame, width: int, percent: int, block: int = 512) -> DataFrame:
    """a and b of enough links to connect what any link within a bucket connects, for pairs(a, a_text, hub, hub_text)
    and texts(doc_id, of_text, text); a_text and hub_text say which text of a document is meant."""
    # Both sides of the joins with texts grow with the input, so they are merged at any size, never broadcast.
    pairs, texts = saved(pairs), texts.hint("merge")
    kind = pairs.schema["a"].dataType.simpleString()
    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("of_text").alias("a_text"), F.col("text").alias("text_a")), ["a", "a_text"])
    hubs = saved(pairs.groupBy("hub", "hub_text").agg(F.count("*").alias("n")))
    of_hubs = hubs.join(texts.select(F.col("doc_id").alias("hub"), F.col("of_text").alias("hub_text"), F.col("text").alias("text_b")), ["hub", "hub_text"])
    both = heavy_join(left, of_hubs, ["hub", "hub_text"], "n", block, hubs, ["a"])
    compared = saved(both.select("a", "hub", "text_a", "text_b").mapInArrow(task("parkflow.llm.neardup", "compare_batches", width=width, percent=percent), f"a {kind}, hub {kind}, n long, n_hub long, link boolean, lacks array<long>, beside array<long>"))
    apart, numbers = ~F.col("link"), (F.size("lacks") + F.size("beside")).cast("long")
    groups = compared.groupBy("hub").agg(F.count("*").alias("n_x"), F.count_if(apart).alias("n_y"), F.sum(numbers).alias("w_x"), F.coalesce(F.sum(F.when(apart, numbers)), F.lit(0)).alias("w_y")).filter("n_y > 0 and n_x > 1")
    blocks = lambda side: F.greatest(F.ceil(F.col(f"n_{side}") / block), F.ceil(F.col(f"w_{side}") / NUMBERS)).cast("int").alias(f"{side}_blocks")
    groups = saved(groups.select("hub", F.col("n_x").alias("meets"), blocks("x"), blocks("y")))
    open_ = heavy_join(compared, groups, ["hub"], "meets", spread=["a"])
    block_of = lambda n: F.pmod(F.xxhash64(F.col("a"), F.lit(1)), F.col(n)).cast("int")
    columns = ["hub", "a", "n", "n_hub", "link", "lacks", "beside"]
    x = open_.select(*columns, F.lit(0).alias("side"), block_of("x_blocks").alias("x_block"), F.explode(F.sequence(F.lit(0), F.col("y_blocks") - 1)).alias("y_block"))
    y = open_.filter("not link").select(*columns, F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("x_blocks") - 1)).alias("x_block"), block_of("y_blocks").alias("y_block"))
    # Dealt by all three, so that the blocks of one hub are tasks of their own.
    more = x.unionByName(y).repartition("hub", "x_block", "y_block").groupBy("hub", "x_block", "y_block").applyInArrow(task("parkflow.llm.neardup", "link_apart", percent=percent), f"a {kind}, b {kind}")
    return compared.filter("link").select("a", F.col("hub").alias("b")).unionByName(more)


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for docs(doc_id, text): documents are linked when 100 times the size
    of the intersection of their shingle sets is at least `percent` times that of the union.

    A text without words (null and empty ones too) has no shingles and is linked with nothing; with fewer than `width`
    words, the whole sequence is the one shingle. Rows without a doc_id are left out; rows repeated under one doc_id
    count as one, by the text with the fewest shingles (the least hash of several), which is also the one compared. Other
    columns are ignored. doc_id is a number, or a text.

    125 slots in 25 bands of five: two documents at a similarity of 0.85 share no band with a probability of
    (1 - 0.85**5)**25 < 5e-7. A lower `percent` needs more `bands`: at 0.8, 25 miss 5e-5 and 40 miss 1.3e-7.
    """
    kind = "string" if docs.schema["doc_id"].dataType.simpleString() == "string" else "long"
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast(kind).alias("doc_id"), F.xxhash64("text").alias("of_text"), "text")
    signed = saved(texts.mapInArrow(task("parkflow.llm.neardup", "sign_batches", width=width, bands=bands), f"doc_id {kind}, n_shingles long, one long, two long, of_text long, bands array<long>"))
    signed = signed.groupBy("doc_id").agg(F.min(F.struct("n_shingles", "one", "two", "of_text", "bands")).alias("s")).select("doc_id", "s.*")
    sets = signed.filter("n_shingles > 0").groupBy("one", "two", "n_shingles").agg(F.min(F.struct("doc_id", "of_text")).alias("rep"), F.first("bands").alias("bands"))
    sets = saved(sets.select("one", "two", "n_shingles", F.col("rep.doc_id").alias("rep"), "rep.of_text", "bands"))
    own = lambda side: sets.select(F.col("rep").alias(side), F.col("of_text").alias(f"{side}_text"))
    pairs = hub_pairs(sets).join(own("a"), "a").join(own("hub"), "hub")
    links = all_links(pairs, texts, width, percent)
    components = connected_components(sets.select(F.col("rep").alias("id")), links)
    found = signed.join(sets.select("one", "two", "n_shingles", "rep"), ["one", "two", "n_shingles"], "left").join(components.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.coalesce("component", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
