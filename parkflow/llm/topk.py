"""Exact top-k search by inner product: columnar branch and bound.

Vectors are packed into blocks in vertical layout (one row of numbers per dimension). Blocks of queries and blocks of
candidates are dealt into groups, and each pair of groups is a cell, searched by one task: for a few queries at a time
scores grow by a group of dimensions, and after each group the candidates whose score plus the largest that the
remaining dimensions can add (the product of the remaining lengths) stays below the k-th best so far of all these
queries are dropped and the rest compacted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parkflow.llm.common import task

SCHEMA = "block int, dims int, n int, ids binary, values binary"


def pack_batches(batches: Iterator[pa.RecordBatch], rows: int, scale: int) -> Iterator[pa.RecordBatch]:
    """Vectors -> blocks of at most `rows` vectors of one dimension each: ids, and floor(scale * x) by dimension."""
    held: dict[int, list] = {}

    def block(dims: int) -> pa.RecordBatch:
        ids, values = zip(*held.pop(dims))
        columns = np.ascontiguousarray(np.array(values, dtype=np.float64).T)
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((0, pa.int32()), (dims, pa.int32()), (len(ids), pa.int32()), (np.array(ids, dtype=np.int64).tobytes(), pa.binary()), (columns.tobytes(), pa.binary()))], ["block", "dims", "n", "ids", "values"])

    for batch in batches:
        vectors = batch.column("vector")
        ids = batch.column("id").to_pylist()
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
        starts = vectors.offsets.to_numpy()[:-1]
        with np.errstate(over="ignore"):
            flat = np.floor(scale * vectors.values.to_numpy(zero_copy_only=False).astype(np.float64))
        flat = np.clip(flat, -np.finfo(np.float64).max, np.finfo(np.float64).max)
        for i, at, n in zip(ids, starts, sizes):
            own = held.setdefault(int(n), [])
            own.append((i, flat[at : at + n]))
            if len(own) >= rows:
                yield block(int(n))
    for dims in list(held):
        yield block(dims)


def _open(blocks: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The ids, and the numbers by dimension, of all blocks (of one number of dimensions)."""
    rows = blocks.to_pylist()
    ids = [np.frombuffer(r["ids"], np.int64) for r in rows]
    values = [np.frombuffer(r["values"], np.float64).reshape(r["dims"], r["n"]) for r in rows]
    return np.concatenate(ids), np.concatenate(values, axis=1)


LOWEST, HIGHEST = -(2**63), 2**63 - 1


def _float(x: np.ndarray) -> np.ndarray:
    """As doubles; whole numbers beyond their range as infinite."""

    def one(v) -> float:
        try:
            return float(v)
        except OverflowError:
            return np.inf if v > 0 else -np.inf

    return x if x.dtype == np.float64 else np.array([[one(v) for v in row] for row in x], np.float64).reshape(x.shape)


def _clamped(x: np.ndarray) -> np.ndarray:
    """Whole numbers as the nearest ones that a long holds."""
    return np.array([[min(max(v, LOWEST), HIGHEST) for v in row] for row in x], object).reshape(x.shape)


def _rest(values: np.ndarray, step: int) -> list[np.ndarray]:
    """Length of what is left of each vector after each group of dimensions."""
    with np.errstate(over="ignore"):
        square = values * values
    return [np.sqrt(square[d:].sum(axis=0)) for d in range(step, len(values) + step, step)]


def _first_of_each(order: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The first k places of `order` whose ids differ."""
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


def best(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, step: int = 16, rows: int = 2048, together: int = 64) -> list[tuple]:
    """(query id, candidate id, score) of the k best of each query among these candidates, the query itself left out. An
    id that is repeated among the candidates has one place, that of its best score. q and c: numbers by dimension."""
    with np.errstate(over="ignore"):
        order = np.argsort(-(c * c).sum(axis=0), kind="stable")  # long vectors first: the k-th best rises early
    c_ids, c = c_ids[order], c[:, order]
    c_rest = _rest(c, step)
    exact = np.float64 if max(np.abs(q).max(initial=0), 1) * max(np.abs(c).max(initial=0), 1) * len(q) < 2**52 else object
    if exact is object:  # beyond what doubles hold exactly
        c = np.array([[int(x) for x in row] for row in c], dtype=object).reshape(c.shape)
    repeated = len(np.unique(c_ids)) < len(c_ids)
    out: list[tuple] = []
    for at in range(0, len(q_ids), together):
        own = q[:, at : at + together]
        q_rest = _rest(own, step)
        if exact is object:
            own = np.array([[int(x) for x in row] for row in own], dtype=object).reshape(own.shape)
        out += _best(q_ids[at : at + together], own, q_rest, c_ids, c, c_rest, k, step, rows, exact, repeated)
    return out


def _best(q_ids, q, q_rest, c_ids, c, c_rest, k, step, rows, exact, repeated) -> list[tuple]:
    top_s = np.full((len(q_ids), k), -np.inf, dtype=exact)
    top_i = np.full((len(q_ids), k), np.iinfo(np.int64).max)
    for at in range(0, len(c_ids), rows):
        ids = c_ids[at : at + rows]
        alive = np.arange(len(ids))
        score = np.zeros((len(q_ids), len(ids)), dtype=exact)
        for g, d in enumerate(range(0, len(q), step)):
            score = score + q[d : d + step].T @ c[d : d + step, at + alive]
            with np.errstate(over="ignore", invalid="ignore"):  # what can't be told from infinite lengths is kept
                bound = _float(score) + q_rest[g][:, None] * c_rest[g][at + alive] * (1 + 1e-9) + 1e-6
            keep = ~(np.maximum(bound, LOWEST) < _float(top_s[:, -1:])).all(axis=0)
            if not keep.all():
                alive, score = alive[keep], score[:, keep]
        if not len(alive):
            continue
        score = score.copy() if exact is np.float64 else _clamped(score)
        score[q_ids[:, None] == ids[alive]] = -np.inf
        all_s = np.concatenate([top_s, score], axis=1)
        all_i = np.concatenate([top_i, np.broadcast_to(ids[alive], score.shape)], axis=1)
        for r in np.flatnonzero((score >= top_s[:, -1:]).any(axis=1)):
            pick = np.lexsort((all_i[r], -all_s[r])) if exact is not object else np.array(sorted(range(all_s.shape[1]), key=lambda j: (-all_s[r, j], all_i[r, j])))
            pick = _first_of_each(pick, all_i[r], k) if repeated else pick[:k]
            top_s[r], top_i[r] = -np.inf, np.iinfo(np.int64).max
            top_s[r, : len(pick)], top_i[r, : len(pick)] = all_s[r, pick], all_i[r, pick]
    found = np.argwhere(top_s > -np.inf)
    return [(int(q_ids[r]), int(top_i[r, j]), int(top_s[r, j])) for r, j in found]


def search_cell(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """The k best of each query of a cell among its candidates."""
    found = best(*_open(queries), *_open(candidates), k) if queries.num_rows and candidates.num_rows else []
    return pa.table([pa.array(x, pa.int64()) for x in (zip(*found) if found else ([], [], []))], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, query_rows: int = 16_384, candidate_rows: int = 65_536, block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of vectors(vec_id, embedding) with the highest inner product for each
    row of queries(vec_id, embedding), the row of the same id left out; ties go to the smaller id.

    Components are floor(scale * x), those beyond doubles the largest double. Products are exact at any size; a score that
    a long doesn't hold is the nearest that it holds. Vectors that are null, or hold a null or a component that isn't finite, take no
    part; vectors of different lengths never meet; an empty vector scores 0. Rows repeated under one id take part
    once, by their best score. A query set against all rows: a cell is about query_rows by candidate_rows of them (fewer
    candidates where there would be fewer cells than shuffle partitions), each block is sent to the cells of its group,
    and only k rows of each query of a cell are shuffled further.
    """
    def packed(df: DataFrame) -> DataFrame:
        whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        df = df.filter("vec_id is not null").filter(whole).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
        return df.mapInArrow(task("parkflow.llm.topk", "pack_batches", rows=block, scale=scale), SCHEMA).drop("block")

    cells = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q_groups = -(-queries.count() // query_rows) or 1
    n = vectors.count()
    c_groups = max(-(-n // candidate_rows), min(-(-cells // q_groups), -(-n // (2 * block)))) or 1
    group = lambda groups: F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int")
    every = lambda groups: F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    q = packed(queries).withColumn("q_group", group(q_groups)).withColumn("c_group", every(c_groups))
    c = packed(vectors).withColumn("c_group", group(c_groups)).withColumn("q_group", every(q_groups))
    on = ["dims", "q_group", "c_group"]
    found = q.groupBy(*on).cogroup(c.groupBy(*on)).applyInArrow(task("parkflow.llm.topk", "search_cell", sides=2, k=k), "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
