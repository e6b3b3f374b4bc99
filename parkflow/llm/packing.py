"""Packing documents into sequences by a grouping genetic algorithm.

Tokens are counted where the text is; only (piece, length) pairs move. Pieces are dealt by hash into shards of bounded
size, and each shard is packed by several islands (populations that evolve apart, one group each). In rounds, each
island's best packing migrates to the next island, which evolves on with it; shards that reach the least possible
number of sequences leave the rounds. What each shard leaves over, its emptiest sequence, is packed once more among
neighbouring shards.
"""

from __future__ import annotations

import os
import random
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parkflow.llm.common import saved, task

CACHE_ENTRIES = 400_000
_tokenizers: dict = {}


#: What the vocabulary's rules make of a lower-case text without characters beyond U+00FF; such a text needs no composition.
FAST = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^0-9²³¹¼-¾a-zªµºß-öø-ÿ\\t-\\r \\x85\\xa0]+")


def _byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(extra)
            extra += 1
    return [letters[b] for b in range(256)]


class WordIds(dict):
    """Word (Latin-1 bytes between white space) -> its ids as little-endian unsigned 32-bit numbers.

    The vocabulary drops white space and no rule of it looks across, so the ids of a text are those of its words.
    Words and the pre-tokens they consist of are kept for as long as there is room.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters, self.parts = self.tokenizer.model, _byte_letters(), {}

    def __missing__(self, word: bytes) -> bytes:
        ids = []
        for part in FAST.findall(word.decode("latin-1")):
            known = self.parts.get(part)
            if known is None:
                tokens = self.model.tokenize("".join([self.letters[b] for b in part.encode()]))
                known = self.parts[part] = b"".join([t.id.to_bytes(4, "little") for t in tokens])
            ids.append(known)
        self[word] = found = b"".join(ids)
        return found

    def encode(self, text: str) -> bytes:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        if len(self.parts) > CACHE_ENTRIES:
            self.parts.clear()
        try:
            fast = bool(text.encode("latin-1")) and "<|" not in text
        except UnicodeEncodeError:
            fast = False
        if not fast:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.lower().encode("latin-1").split()))


def cut_batches(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    """Pieces of each document: doc_id, piece, start, length, ids_crc32."""
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    ids = _tokenizers[path]
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            rows: list[tuple[int, int, int, int, int]] = []
            for k, text in enumerate(batch.column("text")):
                data = ids.encode(text.as_py() or "") + b"\0\0\0\0"
                for piece, start in enumerate(range(0, len(data) // 4, capacity)):
                    part = data[4 * start : 4 * (start + capacity)]
                    rows.append((k, piece, start, len(part) // 4, zlib.crc32(part)))
            k, piece, start, length, crc = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(k)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])


class Bins:
    """A packing: lists of items, and what is free in each."""

    def __init__(self, lengths, capacity: int, bins=(), free=()):
        self.lengths, self.capacity, self.bins, self.free = lengths, capacity, list(bins), list(free)
        self.by_free = sorted((f, i) for i, f in enumerate(self.free))

    def best_fit(self, items) -> None:
        """Each item into the fullest bin that still takes it, else into a new one."""
        for item in items:
            n = self.lengths[item]
            k = bisect_left(self.by_free, (n, -1))
            if k < len(self.by_free):
                f, i = self.by_free.pop(k)
                self.bins[i] = [*self.bins[i], item]
                self.free[i] = f - n
            else:
                i = len(self.bins)
                self.bins.append([item])
                self.free.append(self.capacity - n)
            insort(self.by_free, (self.free[i], i))

    def fitness(self):
        """More is better: fewer bins, then fuller ones."""
        return (-len(self.bins), sum((self.capacity - f) ** 2 for f in self.free))

    def without(self, gone: set[int]):
        kept = [i for i in range(len(self.bins)) if i not in gone]
        return Bins(self.lengths, self.capacity, [self.bins[i] for i in kept], [self.free[i] for i in kept])


def exchange(a: Bins, items: list[int], most: int = 8) -> list[int]:
    """Put larger displaced items in place of one or two smaller ones where a bin (of at most `most` items) gets fuller
    by it; returns what is displaced then."""
    lengths = a.lengths
    loose = sorted(items, key=lengths.__getitem__)
    sizes = [lengths[x] for x in loose]
    for i, own in enumerate(a.bins):
        if not a.free[i] or len(own) > most or not loose:
            continue
        best = (0, 0, ())
        for x, p in enumerate(own):
            for q in (None, *own[x + 1 :]):
                out = lengths[p] + (lengths[q] if q is not None else 0)
                k = bisect_left(sizes, out + a.free[i] + 1) - 1
                if k >= 0 and sizes[k] - out > best[0]:
                    best = (sizes[k] - out, k, (p,) if q is None else (p, q))
        gain, k, gone = best
        if gain:
            item = loose.pop(k)
            sizes.pop(k)
            a.bins[i] = [*(x for x in own if x not in gone), item]
            a.free[i] -= gain
            for x in gone:
                at = bisect_left(sizes, lengths[x])
                loose.insert(at, x)
                sizes.insert(at, lengths[x])
    a.by_free = sorted((f, i) for i, f in enumerate(a.free))
    return loose


def _place_again(child: Bins, displaced: list[int], key) -> Bins:
    child.best_fit(sorted(exchange(child, displaced), key=key))
    return child


def crossover(a: Bins, b: Bins, rng: random.Random, share: float = 0.25) -> Bins:
    """Well-filled bins of b go whole into a; a's bins that hold the same items are dissolved, and the items that lost
    their bin are placed again by best fit."""
    fullest = sorted(range(len(b.bins)), key=b.free.__getitem__)
    pool = fullest[: max(1, len(fullest) // 2)]
    chosen = [i for i in pool if rng.random() < 2 * share] or pool[:1]
    injected = {x for i in chosen for x in b.bins[i]}
    hit = {i for i, items in enumerate(a.bins) if not injected.isdisjoint(items)}
    displaced = [x for i in hit for x in a.bins[i] if x not in injected]
    child = a.without(hit)
    child = Bins(a.lengths, a.capacity, child.bins + [b.bins[i] for i in chosen], child.free + [b.free[i] for i in chosen])
    return _place_again(child, displaced, lambda x: -a.lengths[x])


def mutate(a: Bins, rng: random.Random) -> Bins:
    """Dissolve the emptiest bins and a few others, and place their items again."""
    emptiest = sorted(range(len(a.bins)), key=lambda i: -a.free[i])[: max(1, len(a.bins) // 50)]
    gone = {*emptiest, *rng.sample(range(len(a.bins)), min(len(a.bins), 1 + len(a.bins) // 20))}
    return _place_again(a.without(gone), [x for i in gone for x in a.bins[i]], lambda x: -a.lengths[x] * rng.uniform(0.9, 1.1))


def least_bins(lengths, capacity: int) -> int:
    """No packing has fewer bins."""
    return -(-sum(lengths) // capacity)


def evolve_population(lengths, capacity: int, seed: int, population: list[Bins], size: int = 4, generations: int = 12) -> list[Bins]:
    """The population after some generations, the best packing first; it ends early at the least number of bins."""
    rng = random.Random(seed)
    every = list(population)
    least = least_bins(lengths, capacity)
    while len(every) < size and not any(len(p.bins) <= least for p in every):
        noise = 0.05 * len(every)  # the first of all is plain best fit of the longest first
        fresh = Bins(lengths, capacity)
        fresh.best_fit(sorted(range(len(lengths)), key=lambda x: -lengths[x] * rng.uniform(1 - noise, 1 + noise)))
        every.append(fresh)
    every.sort(key=Bins.fitness, reverse=True)
    for _ in range(generations):
        if len(every) < 2 or len(every[0].bins) <= least:
            break
        mother, father = rng.sample(every, 2)
        child = crossover(mother, father, rng)
        every[-1] = max(child, mutate(child, rng), mutate(every[0], rng), key=Bins.fitness)
        every.sort(key=Bins.fitness, reverse=True)
    return every


def evolve(lengths, capacity: int, seed: int, elites: list[Bins], population: int = 4, generations: int = 12) -> Bins:
    return evolve_population(lengths, capacity, seed, elites, max(population, len(elites)), generations)[0]


def _as_bins(lengths: list[int], capacity: int, numbers: list[int]) -> Bins:
    """A packing from the number of the bin of each item."""
    bins: dict[int, list[int]] = {}
    for item, b in enumerate(numbers):
        bins.setdefault(b, []).append(item)
    return Bins(lengths, capacity, bins.values(), [capacity - sum(lengths[x] for x in items) for items in bins.values()])


def _numbers(packing: Bins) -> list[int]:
    out = [0] * len(packing.lengths)
    for b, items in enumerate(packing.bins):
        for x in items:
            out[x] = b
    return out


ISLAND = "shard long, island int, item long, length int, bins array<int>, n_bins int, least int"


def evolve_island(rows: pd.DataFrame, capacity: int, seed: int, size: int = 4) -> pd.DataFrame:
    """One round of one island: its population and the guests evolve together, and the fittest stay. bins: of each item
    the bin in every packing of the population, the best first."""
    guests = rows["guest"].to_numpy(bool)
    own, visiting = (rows[x].sort_values(["length", "item"], ascending=[False, True], kind="stable") for x in (~guests, guests))
    lengths = own["length"].tolist()
    known = [_as_bins(lengths, capacity, column) for part in (own, visiting) if len(part) for column in zip(*part["bins"].tolist())]
    shard, island = int(own["shard"].iloc[0]), int(own["island"].iloc[0])
    every = evolve_population(lengths, capacity, (seed * 31 + island) * 1_000_003 + shard, known, size)[:size]
    bins = list(map(list, zip(*map(_numbers, every))))
    return pd.DataFrame({"shard": own["shard"], "island": own["island"], "item": own["item"], "length": own["length"], "bins": bins, "n_bins": len(every[0].bins), "least": least_bins(lengths, capacity)})


def cut_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 for each piece of each row of docs(doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(task("parkflow.llm.packing", "cut_batches", path=tokenizer_path, capacity=capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _migrated(islands: DataFrame, n: int) -> DataFrame:
    """The islands' own rows, and their best packings as guests on the next island."""
    rows = islands.select("shard", "island", "item", "length", "bins", F.lit(False).alias("guest"))
    guests = islands.select("shard", ((F.col("island") + 1) % n).alias("island"), "item", "length", F.slice("bins", 1, 1).alias("bins"), F.lit(True).alias("guest"))
    return rows.unionByName(guests)


def search(items: DataFrame, capacity: int, islands: int = 2, rounds: int = 3) -> DataFrame:
    """shard, item, length and bin for items(shard, item, length): the best packing of each shard that its islands find.

    After each round but the last, shards that one island has packed into the least possible number are done.
    """
    evolved = lambda rows, seed: rows.groupBy("shard", "island").applyInPandas(task("parkflow.llm.packing", "evolve_island", capacity=capacity, seed=seed), ISLAND)
    first = items.select("*", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), F.array().cast("array<int>").alias("bins"), F.lit(False).alias("guest"))
    now = saved(evolved(first, 0))
    done = []
    for r in range(1, rounds + 1 if islands > 1 else 1):
        shards = now.groupBy("shard").agg((F.min("n_bins") > F.first("least")).alias("open"))
        if shards.filter("open").isEmpty():
            break
        done.append(now.join(shards.filter("not open").select("shard"), "shard", "left_semi"))
        now = saved(evolved(_migrated(now.join(shards.filter("open").select("shard"), "shard", "left_semi"), islands), r))
    for part in done:
        now = now.unionByName(part)
    best = now.groupBy("shard").agg(F.min(F.struct("n_bins", "island"))["island"].alias("island"))
    return now.join(best, ["shard", "island"]).select("shard", "item", "length", F.col("bins")[0].alias("bin"))


def _gather_leftovers(packed: DataFrame, capacity: int, shards: int) -> DataFrame:
    """The emptiest bin of each shard goes, with those of `shards` shards, into one more group; bins are numbered by
    (shard, bin), groups as negative shards. Every group starts from the bins as they are, so it never needs more."""
    fill = packed.groupBy("shard", "bin").agg(F.sum("length").alias("fill"))
    emptiest = fill.groupBy("shard").agg(F.min(F.struct("fill", "bin")).alias("e")).filter(F.col("e.fill") < capacity).select("shard", F.col("e.bin").alias("bin"))
    rest = packed.join(emptiest, ["shard", "bin"])
    kept = packed.join(emptiest, ["shard", "bin"], "left_anti")
    group = rest.select((-1 - F.floor(F.col("shard") / shards)).cast("long").alias("shard"), F.lit(0).alias("island"), "item", "length", F.array(F.col("shard").cast("int")).alias("bins"), F.lit(False).alias("guest"))
    again = group.groupBy("shard", "island").applyInPandas(task("parkflow.llm.packing", "evolve_island", capacity=capacity, seed=99), ISLAND)
    return kept.select("shard", "item", "length", "bin").unionByName(again.select("shard", "item", "length", F.col("bins")[0].alias("bin")))


def pack_pieces(pieces: DataFrame, capacity: int = 2048, shard_rows: int = 2000, islands: int = 2, rounds: int = 3) -> DataFrame:
    """Adds sequence_id and offset to pieces(length, ...), none longer than capacity.

    Pieces that fill a sequence alone aren't searched over. A shard holds about shard_rows pieces whatever the size of
    the input, so the work grows in proportion; the part-filled sequence that each shard is left with is packed once
    more with those of 15 others.
    """
    pieces = saved(pieces.withColumn("__item", F.monotonically_increasing_id()))
    shards = max(1, pieces.filter(F.col("length") < capacity).count() // shard_rows)
    dealt = F.pmod(F.xxhash64("__item"), F.lit(shards)).alias("shard")
    items = pieces.filter(F.col("length") < capacity).select(dealt, F.col("__item").alias("item"), F.col("length").cast("int").alias("length"))
    packed = saved(search(items, capacity, islands, rounds))
    placed = _gather_leftovers(packed, capacity, 16)
    before = Window.partitionBy("shard", "bin").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    best = placed.select(F.col("item").alias("__item"), (F.col("shard") * 2**31 + F.col("bin")).alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
    top = shards * 2**31
    alone = pieces.filter(F.col("length") >= capacity).select("__item", (top + F.col("__item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return pieces.join(best.unionByName(alone), "__item").drop("__item")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, shard_rows: int = 2000, islands: int = 2) -> DataFrame:
    """Tokenize, cut and pack docs(doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end token alone. Repeated rows are packed each; an empty table gives no rows; other
    columns are ignored.
    """
    return pack_pieces(cut_documents(docs, tokenizer_path, capacity), capacity, shard_rows, islands)
