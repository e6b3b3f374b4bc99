"""Greedy one-to-one matching in a given order, without going through it one by one.

Edges are ordered; going through them, one is taken if neither of its ends is taken yet. That is the one stable matching
in which each end prefers the edge that comes first, so ends can bid as in deferred acceptance: where an end's first edge
leads, all later edges are ruled out, whatever the others do. All ends on both sides bid at once, in rounds over the whole
table; an edge that comes first at both of its ends is taken. What the rounds leave undecided are small tangles (their
connected components), which are gone through one by one, by ids and scores only.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parkflow.operators.graph import connected_components
from parkflow.tables import written


def _rounds(edges: DataFrame, ties: bool, rounds: int) -> tuple[DataFrame, DataFrame]:
    """The pairs that are certain, and the edges left. ties: edges alike in (o1, o2, r) are left to be told apart."""
    by_l, by_r = Window.partitionBy("l"), Window.partitionBy("r")
    order = F.struct("o1", "o2", "r", *([] if ties else ["l"]))
    later = lambda bids, w: F.coalesce(order > F.min(F.when(F.col(bids), order)).over(w), F.lit(False))
    left, taken, open_ = edges.select("l", "r", F.col("o1").cast("double"), F.col("o2").cast("double")), [], None
    for _ in range(rounds):
        bids = left.withColumn("from_l", order == F.min(order).over(by_l)).withColumn("from_r", order == F.min(order).over(by_r))
        bids = bids.withColumn("from_r", F.col("from_r") & (F.count_if("from_r").over(by_r) == 1))  # else it isn't known whose bid it is
        bids = bids.withColumn("gone", later("from_l", by_r)).withColumn("gone", F.col("gone") | later("from_r", by_l))
        found = written(bids.select("l", "r", "o1", "o2", (F.col("from_l") & F.col("from_r")).alias("take"), "gone").filter("take or not gone"))
        taken.append(found.filter("take").select("l", "r"))
        left = found.filter("not take").drop("take", "gone")
        before, open_ = open_, left.count()
        if open_ in (0, before):  # nothing is left, or only what no round can tell apart
            break
    return reduce(DataFrame.unionByName, taken), left


def _gone_through(edges: DataFrame, each: int = 20_000) -> DataFrame:
    """(l, r, head) taken of edges(l, r, o1, o2, head, tangle): whole tangles, many small ones to a task."""
    edges = written(edges)
    together = F.pmod(F.xxhash64("tangle"), F.lit(-(-edges.count() // each) or 1))
    return edges.groupBy(together).applyInPandas(_go_through, "l long, r long, head long")


def _go_through(edges: pd.DataFrame) -> pd.DataFrame:
    """Tangles: (l, r) taken in the order of o1, o2, r and then where l's chain begins, head being its first for now."""
    begins: dict[int, int] = {}
    used_l, used_r, out = set(), set(), []
    rows = sorted(zip(edges["o1"].tolist(), edges["o2"].tolist(), edges["r"].tolist(), edges["head"].tolist(), edges["l"].tolist()))
    at = 0
    while at < len(rows):
        end = at + 1
        while end < len(rows) and rows[end][:3] == rows[at][:3]:
            end += 1
        right = rows[at][2]
        if right not in used_r:
            free = [(begins.get(head, head), left, head) for *_, head, left in rows[at:end] if left not in used_l]
            if free:
                begin, left, head = min(free)
                used_l.add(left)
                used_r.add(right)
                begins[right] = begin
                out.append((left, right, head))
        at = end
    return pd.DataFrame(out, columns=["l", "r", "head"])


def greedy_pairs(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """(l, r) of the pairs taken, for edges(l, r, o1, o2) in the order of o1, o2, r and l. l and r number different
    things."""
    taken, left = _rounds(edges, False, rounds)
    if left.isEmpty():
        return taken
    ends = left.select((F.col("l") * 2).alias("a"), (F.col("r") * 2 + 1).alias("b"))
    tangle = connected_components(ends.select(F.col("a").alias("id")), ends).withColumnRenamed("component", "tangle")
    own = left.join(tangle, F.col("l") * 2 == F.col("id")).select("l", "r", "o1", "o2", (F.col("l") - 2**62).alias("head"), "tangle")  # no number of a right end
    return taken.unionByName(_gone_through(own).select("l", "r"))


def greedy_chains(nodes: DataFrame, edges: DataFrame, rounds: int = 8) -> DataFrame:
    """id and chain (the first id of its chain) for nodes(id), where a taken edge (l, r) continues the chain that ends in
    l by r: each id is continued once, and continues one. l < r; edges alike in o1, o2 and r are in the order in which
    their chains begin."""
    taken, left = _rounds(edges, True, rounds)
    chains = written(connected_components(nodes, taken.select(F.col("l").alias("a"), F.col("r").alias("b"))))
    if not left.isEmpty():
        left = written(left.join(chains.select(F.col("id").alias("l"), F.col("component").alias("head")), "l"))
        ends = left.select(F.col("head").alias("a"), F.col("r").alias("b"))  # what is left begins a chain
        ids = ends.select(F.col("a").alias("id")).unionByName(ends.select(F.col("b").alias("id")))
        tangle = connected_components(ids, ends).select(F.col("id").alias("head"), F.col("component").alias("tangle"))
        more = written(_gone_through(left.join(tangle, "head")))
        whole = connected_components(ids, more.select(F.col("head").alias("a"), F.col("r").alias("b"))).select(F.col("id").alias("component"), F.col("component").alias("whole"))
        chains = chains.join(whole, "component", "left").select("id", F.coalesce("whole", "component").alias("component"))
    return chains.select("id", F.col("component").alias("chain"))
