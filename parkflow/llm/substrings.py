"""Repeated byte strings across and within documents, by common-prefix interval trees over sampled suffixes.

Suffixes are sampled where the hash of 32 bytes is the least in some window, so that any string of `shortest` bytes
holds a sampled place that depends on its bytes only: two occurrences of it share one. The suffixes of places with the
same 32 bytes are sorted, the array of their common prefixes is scanned with a stack, and each interval of it is a
repeated string to the right of the place. Left of it, the reversed prefixes of the interval's members are kept in
order: where neighbours go on alike they belong to one repeat, where they differ a maximal repeat ends. No more than
`least` bytes to the right and `shortest` less 32 to the left are looked at: a repeat of `least` bytes holds a place
within its first `shortest`, and longer ones hold further places.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parkflow.llm.common import dropped, heavy_join, saved, task

GRAM = 32
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _gram_hashes(data: bytes) -> np.ndarray:
    n = len(data) - 7
    words = np.ndarray((n,), "<u8", data, strides=(1,)).astype(np.uint64)
    m = len(data) - GRAM + 1
    h = words[:m] * _A
    for k in range(8, GRAM, 8):
        h = ((h ^ (h >> np.uint64(29))) + words[k : k + m]) * _A
    h = (h ^ (h >> np.uint64(32))) * _B
    return h ^ (h >> np.uint64(31))


def _sliding(x: np.ndarray, w: int, op, fill) -> np.ndarray:
    """op over each window of w numbers, by running values within blocks from both ends."""
    n = len(x) - w + 1
    blocks = np.concatenate([x, np.full(-len(x) % w, fill, x.dtype)]).reshape(-1, w)
    ahead = op.accumulate(blocks, axis=1).reshape(-1)
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return op(behind[:n], ahead[w - 1 : w - 1 + n])


def places(data: bytes, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions, and the hash of the 32 bytes at each."""
    if len(data) < least:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = _gram_hashes(data)
    w = least - GRAM + 1
    low = _sliding(h, w, np.minimum, np.uint64(2**64 - 1))
    edge = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([edge, low, edge]), w, np.maximum, np.uint64(0)) == h)
    return at, h[at]


def place_batches(batches: Iterator[pa.RecordBatch], least: int, shortest: int) -> Iterator[pa.RecordBatch]:
    """k1, k2 (the document), pos, key (hash at the place) and context (hash of all that is looked at around it)."""
    from xxhash import xxh3_64_intdigest

    ahead = shortest - GRAM
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            counts, positions, keys, contexts = [], [], [], []
            for text in batch.column("text"):
                data = (text.as_py() or "").encode()
                pos, key = places(data, shortest)
                counts.append(len(pos))
                positions.append(pos)
                keys.append(key)
                contexts += [xxh3_64_intdigest(data[max(0, p - ahead) : p + least], min(p, ahead)) for p in pos.tolist()]
            row = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            yield pa.RecordBatch.from_arrays([batch.column("k1").take(row), batch.column("k2").take(row), pa.array(np.concatenate(positions), pa.int32()), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.array(contexts, np.uint64).view(np.int64))], ["k1", "k2", "pos", "key", "context"])


AROUND = "key long, single boolean, shared boolean, k1 long, k2 int, pos int, left binary, n_left int, right binary, n_right int"


def _padded(n: int) -> int:
    return -(-n // 8) * 8


def context_batches(batches: Iterator[pa.RecordBatch], least: int, shortest: int) -> Iterator[pa.RecordBatch]:
    """What stands left (reversed) and right of the places asked for, filled up to one width, and how much it is."""
    ahead = shortest - GRAM
    wide_l, wide_r = _padded(ahead), _padded(least)
    names = [x.split()[0] for x in AROUND.split(", ")]
    kinds = (pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.int32())
    for whole in batches:
        for at in range(0, whole.num_rows, 128):
            columns: list[list] = [[] for _ in names]
            for r in whole.slice(at, 128).to_pylist():
                data = (r["text"] or "").encode()
                for p in r["asked"]:
                    pos = p["pos"]
                    left, right = data[max(0, pos - ahead) : pos][::-1], data[pos : pos + least]
                    row = (p["key"], p["single"], p["shared"], r["k1"], r["k2"], pos, left.ljust(wide_l, b"\0"), len(left), right.ljust(wide_r, b"\0"), len(right))
                    for column, value in zip(columns, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid
    return low


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the intervals of a common-prefix array; lcp[i] is between members i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > value:
            length, first = stack.pop()
            yield length, first, i
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def maximal_repeats(left: list[bytes], right: list[bytes], least: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """(bytes to the right, members, bytes to the left that each member shares with its nearest other) of the groups
    of suffixes that share `least` bytes or more around their place."""
    n = len(left)
    by_right = sorted(range(n), key=right.__getitem__)
    rank = [0] * n
    for k, i in enumerate(sorted(range(n), key=left.__getitem__)):
        rank[i] = k
    most = max(map(len, left))
    for length, first, last in intervals([common_prefix(right[a], right[b]) for a, b in zip(by_right, by_right[1:])]):
        if length + most < least:
            continue
        members = sorted(by_right[first : last + 1], key=rank.__getitem__)
        shared = [common_prefix(left[a], left[b]) for a, b in zip(members, members[1:])]
        run = 0
        for k in range(len(members)):
            if k == len(members) - 1 or shared[k] + length < least:  # left extensions differ too early: the repeat ends
                if k > run:
                    group = members[run : k + 1]
                    near = [max(shared[j - 1] if j > run else 0, shared[j] if j < k else 0) for j in range(run, k + 1)]
                    yield length, group, near
                run = k + 1


def _matrix(column: pa.Array) -> np.ndarray:
    """Binary values of one width as rows of 8-byte words."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), -1).view("<u8")


def _common(x: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefixes of rows a and b of a matrix, whose values are n bytes long."""
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), 8192):
        i, j = a[at : at + 8192], b[at : at + 8192]
        differ = x[i] ^ x[j]
        word = (differ != 0).argmax(axis=1)
        bits = differ[np.arange(len(i)), word]
        with np.errstate(over="ignore"):
            byte = np.log2((bits & (~bits + np.uint64(1))).astype(np.float64), out=np.zeros(len(i)), where=bits > 0).astype(np.int64) // 8
        out[at : at + 8192] = np.minimum(np.where(bits > 0, 8 * word + byte, 8 * x.shape[1]), np.minimum(n[i], n[j]))
    return out


class _Reaches:
    """How far the repeats of each of n places reach to the left and to the right, for each of some least lengths."""

    def __init__(self, n: int, lengths: tuple[int, ...]):
        self.lengths = lengths
        self.left, self.right = np.full((len(lengths), n), -1, np.int32), np.full((len(lengths), n), -1, np.int32)

    def met(self, i, j, left, right) -> None:
        """Places i and j (numbers or arrays without repeats) share `left` bytes before and `right` bytes from the place."""
        for k, least in enumerate(self.lengths):
            ok = left + right >= least
            for p in (i, j):
                self.left[k, p] = np.where(ok, np.maximum(self.left[k, p], left), self.left[k, p])
                self.right[k, p] = np.where(ok, np.maximum(self.right[k, p], right), self.right[k, p])


def _absorb(into: list[int], new: list[int], depth: int, lcp_left, met) -> None:
    """Add the members of one child of an interval, by their place in the order of what stands left of them, to those of
    another. Only neighbours in that order need to be compared: anything farther shares less, or met deeper down."""
    for x in new:
        k = bisect_left(into, x)
        if k:
            met(into[k - 1], x, lcp_left(into[k - 1], x), depth)
        if k < len(into):
            met(x, into[k], lcp_left(x, into[k]), depth)
        into.insert(k, x)


def tree_reaches(left: list[bytes], right: list[bytes], lengths: tuple[int, ...]) -> list[dict[int, tuple[int, int]]]:
    """For each least length, the farthest that any repeat of each member reaches to the left and to the right.

    The stack holds the open intervals with their members in the order of what stands left; when an interval closes,
    its members go to the one around it, the fewer into the more. Where neighbours share enough on both sides, a repeat
    passes through both.
    """
    n = len(right)
    by_right, by_left = sorted(range(n), key=right.__getitem__), sorted(range(n), key=left.__getitem__)
    rank = [0] * n
    for k, i in enumerate(by_left):
        rank[i] = k
    found: list[dict[int, tuple[int, int]]] = [{} for _ in lengths]

    def met(x: int, y: int, a: int, b: int) -> None:
        for reach, least in zip(found, lengths):
            if a + b >= least:
                for p in (by_left[x], by_left[y]):
                    old = reach.get(p)
                    reach[p] = (a, b) if old is None else (max(a, old[0]), max(b, old[1]))

    lcp_left = lambda x, y: common_prefix(left[by_left[x]], left[by_left[y]])
    shared = [common_prefix(right[a], right[b]) for a, b in zip(by_right, by_right[1:])]
    stack: list[tuple[int, list[int]]] = []
    for i, value in enumerate([*shared, -1]):
        open_ = [rank[by_right[i]]]
        while stack and stack[-1][0] > value:
            depth, members = stack.pop()
            more, fewer = (members, open_) if len(members) >= len(open_) else (open_, members)
            _absorb(more, fewer, depth, lcp_left, met)
            open_ = more
        if stack and stack[-1][0] == value:
            depth, members = stack.pop()
            more, fewer = (members, open_) if len(members) >= len(open_) else (open_, members)
            _absorb(more, fewer, depth, lcp_left, met)
            open_ = more
        if value >= 0:
            stack.append((value, open_))
    return found


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, batched so that no key (batches are sorted by it) is divided."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_numpy()
        if held and held[-1].column("key")[0].as_py() != keys[0]:
            yield pa.concat_batches(held)
            held = []
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.concat_batches(held)


def repeat_batches(batches: Iterator[pa.RecordBatch], least: int, shortest: int) -> Iterator[pa.RecordBatch]:
    """How far each place's repeats reach, those of `least` bytes (to_) and those of `shortest` (near_); -1 for none."""
    lengths = (least, shortest)
    for batch in _whole_groups(batches):
        keys = batch.column("key").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.concatenate([first, [len(keys)]]))
        reach = _Reaches(len(keys), lengths)
        pair = first[size == 2]  # one interval with two members
        left, right = _matrix(batch.column("left")), _matrix(batch.column("right"))
        n_left, n_right = (batch.column(x).to_numpy() for x in ("n_left", "n_right"))
        reach.met(pair, pair + 1, _common(left, n_left, pair, pair + 1), _common(right, n_right, pair, pair + 1))
        for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
            own = [[x[:k] for x, k in zip(batch.column(c).slice(at, n).to_pylist(), batch.column(f"n_{c}").slice(at, n).to_pylist())] for c in ("left", "right")]
            for k, found in enumerate(tree_reaches(*own, lengths)):
                for i, (a, b) in found.items():
                    reach.left[k, at + i], reach.right[k, at + i] = a, b
        hit = np.flatnonzero((reach.right[1] >= 0) & batch.column("single").to_numpy(zero_copy_only=False))
        near = batch.column("shared").to_numpy(zero_copy_only=False)[hit]
        place = [batch.column(c).take(pa.array(hit)) for c in ("k1", "k2", "pos")]
        reached = [reach.left[0, hit], reach.right[0, hit], np.where(near, reach.left[1, hit], -1), np.where(near, reach.right[1, hit], -1)]
        yield pa.RecordBatch.from_arrays([*place, *[pa.array(x, pa.int32()) for x in reached]], ["k1", "k2", "pos", "to_left", "to_right", "near_left", "near_right"])


def window_batches(batches: Iterator[pa.RecordBatch], lengths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Every string of some lengths around each place, as two hashes: for places that too many documents share."""
    from xxhash import xxh3_128_digest

    names = ["size", "w1", "w2", "k1", "k2", "pos", "to_left", "single", "shared"]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())
    for whole in batches:
        for at in range(0, whole.num_rows, 64):
            out = []
            for r in whole.slice(at, 64).to_pylist():
                n = r["n_left"]
                data = r["left"][:n][::-1] + r["right"][: r["n_right"]]
                for size in lengths:
                    for start in range(max(0, n + GRAM - size), min(n, len(data) - size) + 1):
                        h = xxh3_128_digest(data[start : start + size])
                        out.append((size, int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True), r["k1"], r["k2"], r["pos"], n - start, r["single"], r["shared"]))
            columns = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def _runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as maximal runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _words_in(data: bytes, a: int, b: int) -> int:
    """Words that stand whole in data[a:b]."""
    n = len(data[a:b].split())
    cut = lambda i: 0 < i < len(data) and not data[i - 1 : i].isspace() and not data[i : i + 1].isspace()
    return n - cut(a) - cut(b)


def cut_batches(batches: Iterator[pa.RecordBatch], least: int, shortest: int, words: int) -> Iterator[pa.RecordBatch]:
    """Remove the spans from each text: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_bytes, kept."""
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes", "kept"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            rows: list[list] = [[] for _ in names]
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                data, spans = (text.as_py() or "").encode(), spans.as_py() or ()
                clipped = lambda name, size: [(a, b) for s in spans if s[f"{name}_right"] >= 0 and (b := min(len(data), s["pos"] + s[f"{name}_right"])) - (a := max(0, s["pos"] - s[f"{name}_left"])) >= size]  # noqa: B023, E731
                gone = _runs(clipped("to", least))
                kept = b"".join(data[a:b] for a, b in zip([0, *[b for _, b in gone]], [*[a for a, _ in gone], len(data)]))
                passages = [(a, b) for a, b in _runs(clipped("near", shortest)) if _words_in(data, a, b) >= words]
                for column, value in zip(rows, (len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), len(passages), sum(b - a for a, b in passages), kept)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(rows, kinds)]], ["doc_id", *names])


def remove_repeats(docs: DataFrame, least: int = 400, shortest: int = 256, words: int = 51, group_rows: int = 50_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_bytes and kept (the bytes left) for every
    row of docs(doc_id, text): each byte covered by a string of `least` bytes that also starts anywhere else is removed.

    n_passages counts the runs covered by strings of `shortest` bytes that also start elsewhere which hold at least
    `words` whole words, and passage_bytes what they cover; they are reported, not removed. Strings count for them where
    the 32 bytes at a sampled place of theirs are also in another document.

    Strings are those of the input; a null text is an empty one. Repeated rows are documents each, so they remove one
    another; other columns are ignored.

    Places whose whole surroundings are equal are settled by counting. The others are compared in groups of one key;
    a key with more than `group_rows` different surroundings isn't compared in one task: the strings around its places
    are counted instead, which finds the same.
    """
    shortest = min(shortest, least)
    texts = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2"))
    run = lambda name, **args: task("parkflow.llm.substrings", name, **args)
    every = saved(texts.select("k1", "k2", "text").mapInArrow(run("place_batches", least=least, shortest=shortest), "k1 long, k2 int, pos int, key long, context long"))
    twice = saved(every.groupBy("key").agg(F.count("*").alias("n"), (F.min("k1") != F.max("k1")).alias("shared")).filter("n > 1"))
    found = saved(heavy_join(every, twice, ["key"], "n"))
    dropped(every)
    dropped(twice)
    kinds = saved(found.groupBy("key", "context").agg(F.count("*").alias("n"), F.first("shared").alias("shared"), F.min(F.struct("k1", "k2", "pos")).alias("first")))
    groups = saved(kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("singles")).filter("kinds > 1 and singles > 0").withColumn("many", F.col("kinds") > group_rows))

    def around(which: DataFrame) -> DataFrame:
        asked = heavy_join(kinds, which.select("key", "kinds"), ["key"], "kinds").select("key", (F.col("n") == 1).alias("single"), "shared", "first.*")
        asked = asked.groupBy("k1", "k2").agg(F.collect_list(F.struct("key", "single", "shared", "pos")).alias("asked"))
        # With the columns of the last join below, so that Spark shuffles the texts once for both.
        return texts.join(asked, ["k1", "k2"]).mapInArrow(run("context_batches", least=least, shortest=shortest), AROUND)

    reach = "k1 long, k2 int, pos int, to_left int, to_right int, near_left int, near_right int"
    spans = around(groups.filter("not many")).repartition("key").sortWithinPartitions("key").mapInArrow(run("repeat_batches", least=least, shortest=shortest), reach)
    whole = heavy_join(found, kinds.filter("n > 1").select("key", "context", "n"), ["key", "context"], "n")
    near = lambda x: F.when(F.col("shared"), x).otherwise(-1)
    spans = spans.unionByName(whole.select("k1", "k2", "pos", F.lit(shortest - GRAM).alias("to_left"), F.lit(least).alias("to_right"), near(shortest - GRAM).alias("near_left"), near(least).alias("near_right")))
    if not groups.filter("many").isEmpty():
        windows = around(groups.filter("many")).mapInArrow(run("window_batches", lengths=tuple({least, shortest})), "size int, w1 long, w2 long, k1 long, k2 int, pos int, to_left int, single boolean, shared boolean")
        occurrence = F.struct("k1", "k2", F.col("pos") - F.col("to_left"))  # places of one document may see the same string
        met = windows.groupBy("size", "w1", "w2").agg(F.count("*").alias("n"), F.min(occurrence).alias("first"), F.max(occurrence).alias("last"), F.bool_and("single").alias("single"))
        met = saved(met.filter("first <> last or not single").select("size", "w1", "w2", "n"))
        own = heavy_join(windows.filter("single"), met, ["size", "w1", "w2"], "n")
        of = lambda size, value: F.coalesce(F.max(F.when(F.col("size") == size, value)), F.lit(-1))
        left, right = F.col("to_left"), F.col("size") - F.col("to_left")
        counted = own.groupBy("k1", "k2", "pos", "shared").agg(of(least, left).alias("to_left"), of(least, right).alias("to_right"), of(shortest, left).alias("near_left"), of(shortest, right).alias("near_right"))
        spans = spans.unionByName(counted.select("k1", "k2", "pos", "to_left", "to_right", near(F.col("near_left")).alias("near_left"), near(F.col("near_right")).alias("near_right")))
    spans = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("pos", "to_left", "to_right", "near_left", "near_right")).alias("spans"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(run("cut_batches", least=least, shortest=shortest, words=words), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_bytes long, kept binary")
