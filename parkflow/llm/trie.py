"""The prefix trie of conversations, by ROLLUP over columns of turn ids.

A conversation's turns stand in columns, one row for each block of them: the first FIRST turns, then MORE in each further
block, which is keyed by the node that the turns before it lead to. ROLLUP over the columns of a block puts together all
prefixes that end in it at once, and grouping_id tells how long each is. A second ROLLUP over the nodes sums what stands
below them within their block; what stands in further blocks is first added to the nodes that those continue.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parkflow.llm.common import heavy_join, saved, task

FIRST, MORE = 8, 32
ROOT, EMPTY = "root", hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """Equal for equal (role, text) only (128 bits of a hash), with the text's number of words."""
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("string")
    return F.concat(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)), F.lit(":"), words)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0, by turn, nulls first, equal ones by turn id) and turn_id."""
    rows = conversations.filter("conv_id is not null").select("conv_id", "turn", turn_id(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("turn_id"))
    return rows.select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "turn_id")) - 1).alias("pos"), "turn_id")


def rebuilt(turns: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations c that begin with the first h turns of conversation c - c % group and go on with their own after
    the first h, with h the CRC-32 of c as a decimal number, modulo `heads`: their (conv_id, length), and their turns."""
    n = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    first = n.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    ids = n.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), h.alias("h")).join(first, "base", "left")
    ids = saved(ids.withColumn("head", F.least("h", F.coalesce("n_base", F.lit(0))).cast("int")))
    heads_ = turns.filter((F.col("pos") < heads - 1) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "base")
    taken = ids.select("conv_id", "base", "head").join(heads_, "base").filter("pos < head").select("conv_id", "pos", "turn_id")
    own = turns.join(ids.select("conv_id", "h", "head"), "conv_id").filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "turn_id")
    return ids.select("conv_id", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("length")), taken.unionByName(own)


def _names(width: int) -> list[str]:
    return [f"t{k}" for k in range(1, width + 1)]


def _key(*parts: Column) -> Column:
    return F.md5(F.concat_ws(",", *parts))


def _filled(width: int) -> Column:
    return F.array_compact(F.array(*_names(width)))


def blocks(lengths: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each block of each conversation: conv_id, length, block, t1, ..., prior (the node it continues), next (the
    node that a full block leads to) and path (the ends of all blocks before it); a conversation without turns has one."""
    block = F.when(F.col("pos") < FIRST, 0).otherwise(1 + F.floor((F.col("pos") - FIRST) / MORE)).cast("int")
    slot = F.when(F.col("pos") < FIRST, F.col("pos")).otherwise((F.col("pos") - FIRST) % MORE)
    rows = turns.select("conv_id", "turn_id", block.alias("block"), slot.alias("slot"))
    wide = rows.groupBy("conv_id", "block").agg(*[F.max(F.when(F.col("slot") == k, F.col("turn_id"))).alias(t) for k, t in enumerate(_names(MORE))])
    wide = lengths.join(wide, "conv_id", "left").withColumn("block", F.coalesce("block", F.lit(0))).withColumn("own", _key(_filled(MORE)))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    wide = wide.withColumn("ahead", F.collect_list("own").over(before))
    path = F.when(F.col("block") > 0, F.transform(F.sequence(F.lit(1), F.size("ahead")), lambda i: _key(F.slice("ahead", F.lit(1), i)))).otherwise(F.array().cast("array<string>"))
    wide = wide.withColumn("path", path).withColumn("next", _key(F.col("ahead"), F.col("own")))
    return wide.withColumn("prior", F.when(F.col("block") > 0, F.element_at("path", -1)).otherwise(ROOT)).drop("ahead", "own")


def _start() -> Column:
    return F.when(F.col("block") > 0, FIRST + (F.col("block") - 1) * MORE).otherwise(0).cast("long")


def _rollup(rows: DataFrame, width: int, aggregates: str) -> DataFrame:
    """The aggregates of each prefix of the block's columns that isn't longer than its conversation, with its level; the
    empty prefix only where no earlier block has it."""
    columns = ", ".join(_names(width))
    sql = f"select block, prior, {columns}, {width} - bit_count(grouping_id()) as level, {aggregates} from {{rows}} group by block, prior, rollup ({columns})"
    return rows.sparkSession.sql(sql, rows=rows).filter((F.size(_filled(width)) == F.col("level")) & ((F.col("level") > 0) | (F.col("block") == 0)))


def nodes_of(rows: DataFrame, width: int) -> DataFrame:
    """The nodes of blocks of one width: block, prior, t1, ..., node, parent, depth, conv_id, n_convs, leaf and saved_own."""
    found = _rollup(rows, width, "count(*) as n_convs, min(conv_id) as conv_id, max(length) as longest, min(next) as next")
    level, filled = F.col("level"), _filled(width)
    node = F.when(level == 0, ROOT).when(level == width, F.col("next")).otherwise(_key(F.col("prior"), filled))
    parent = F.when(level == 1, F.col("prior")).when(level > 1, _key(F.col("prior"), F.slice(filled, F.lit(1), level - 1)))
    words = F.when(level > 0, F.split_part(F.element_at(filled, level), F.lit(":"), F.lit(2)).cast("long")).otherwise(0)
    found = found.withColumns({"node": node, "parent": parent, "depth": _start() + level, "saved_own": (F.col("n_convs") - 1) * words})
    return found.withColumn("leaf", (F.col("longest") == F.col("depth")).cast("long")).drop("level", "longest", "next")


def _summed(nodes: DataFrame, width: int) -> DataFrame:
    """node, parent, depth, conv_id and n_convs of the nodes with the sums over what stands below them."""
    of = "min_by(struct(node, parent, depth, conv_id, n_convs), depth) as own, sum(leaf) as n_leaves, sum(saved_own) as saved_tokens"
    return _rollup(nodes, width, of).select("own.*", "n_leaves", "saved_tokens")


CHUNK = 4096


def chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and conv_id, up to CHUNK ids of a node as one row: node, first and ids."""
    node, ids = None, []
    out: list[tuple[str, int, str]] = []

    def close() -> None:
        if ids:
            out.append((node, ids[0], ",".join(map(str, ids))))
            ids.clear()

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out)) or [(), (), ()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()))], ["node", "first", "ids"])

    for rows in batches:
        for n, c in zip(rows.column("node").to_pylist(), rows.column("conv_id").to_pylist()):
            if n != node or len(ids) == CHUNK:
                close()
                node = n
            ids.append(c)
        yield batch()
    close()
    yield batch()


def hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by node and first: node and ends_sha256. A node's ids pass through as a stream."""
    node, state, out = None, None, []
    for rows in batches:
        for n, ids in zip(rows.column("node").to_pylist(), rows.column("ids").to_pylist()):
            if n != node:
                out += [(node, state.hexdigest())] if state else []
                node, state = n, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    out += [(node, state.hexdigest())] if state else []
    for at in range(0, len(out), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out[at : at + 10_000])], ["node", "ends_sha256"])


def _ends(rows: DataFrame) -> DataFrame:
    """node and ends_sha256 of the nodes where conversations end."""
    width = F.when(F.col("block") > 0, MORE).otherwise(FIRST)
    filled = _filled(MORE)
    node = F.when(F.size(filled) == 0, ROOT).when(F.size(filled) == width, F.col("next")).otherwise(_key(F.col("prior"), filled))
    ends = rows.filter(F.col("length") <= _start() + width).select(node.alias("node"), F.col("conv_id").cast("long").alias("conv_id"))
    run = lambda name: task("parkflow.llm.trie", name)
    chunks = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(run("chunk_batches"), "node string, first long, ids string")
    return chunks.repartition("node").sortWithinPartitions("node", "first").mapInArrow(run("hash_batches"), "node string, ends_sha256 string")


def prefix_trie(lengths: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, length) with turns(conv_id, pos from 0 without gaps, turn_id): each
    different beginning of d turns is a node of that depth, from the root, to which all conversations belong.

    conv_id (the smallest one that begins so), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves
    (childless nodes below it and itself), saved_tokens (summed below it and itself: the words of a node's last text for
    each conversation but one) and ends_sha256 (SHA-256 of the decimal conv_ids of the conversations that end there,
    ascending, with commas).

    Everything is a fixed number of steps, however long the conversations are. A beginning that very many conversations
    share is pre-aggregated where the rows are; a node with very many children is dealt when they are joined with it. The
    ids that end at one node pass through one task, as the digest of their sequence needs, in chunks and never all at
    once. No conversations, no nodes.
    """
    rows = saved(blocks(lengths, turns))
    begin, go_on = rows.filter("block = 0").drop(*_names(MORE)[FIRST:]), rows.filter("block > 0")
    first, more = saved(nodes_of(begin, FIRST)), saved(nodes_of(go_on, MORE))
    below = more.groupBy("prior").agg(F.sum("leaf").alias("leaf"), F.sum("saved_own").alias("saved_own"))
    paths = go_on.groupBy("prior").agg(F.first("path").alias("path"))
    ends = below.join(paths, "prior").select(F.explode("path").alias("node"), "leaf", "saved_own")
    ends = saved(ends.groupBy("node").agg(F.sum("leaf").alias("more_leaves"), F.sum("saved_own").alias("more_saved")))

    def whole(nodes: DataFrame) -> DataFrame:
        plus = lambda c, more: F.col(c) + F.coalesce(more, F.lit(0))
        return nodes.join(ends, "node", "left").withColumns({"leaf": plus("leaf", "more_leaves"), "saved_own": plus("saved_own", "more_saved")})

    nodes = saved(_summed(whole(first), FIRST).unionByName(_summed(whole(more), MORE)))
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = saved(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).join(_ends(rows), "node", "left"))
    parents = nodes.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("meets"))
    linked = heavy_join(nodes.filter("depth > 0"), parents, ["parent"], "meets", spread=["node"])
    linked = linked.unionByName(nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast(nodes.schema["conv_id"].dataType)))
    return linked.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations(conv_id, turn, role, text), each rebuilt (see `rebuilt`).

    Turns stand in order of `turn`, nulls first, equal ones by their content; a null role or text is an empty one.
    Repeated rows are turns each. Rows without conv_id belong to no conversation and are left out. A conversation without
    turns once rebuilt counts for the root. Other columns are ignored; an empty table gives no rows.
    """
    return prefix_trie(*rebuilt(saved(ordered_turns(conversations))))
