"""A manifest of a dataset as a Merkle tree, stored as a content-addressed graph of digest-to-children records.

Rows are leaves. The leaves of a source, in order of doc_id, form a tree of 16 children a node; the sources' roots, in
order of source, form another one above. A proof is read by descent: from the root, by the 16-ary digits of the source's
number and then of the row's rank in it, each step joins the records by digest and keeps the children that weren't chosen
as a segment of the path. Requests that share a way descend it as one, down to the run of leaves they stand in. The
segments in reverse order are the proof.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parkflow.llm.common import dropped, heavy_join, saved
from parkflow.tables import numbered

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column | str) -> Column:
    return F.sha2(text, 256)


def joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def leaf_digest(columns: dict[str, Column]) -> Column:
    """Of each field `-` if null, else how many bytes it has, a colon and its value."""
    one = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return digest(F.concat(*[one(c.cast("string")) for c in columns.values()]))


def height(n: int) -> int:
    """How many times n nodes are put together until one remains."""
    h = 0
    while FAN**h < n:
        h += 1
    return h


@dataclass
class Manifest:
    """tree[h], top[h]: digest, children and n (how many nodes have it) of the nodes h + 1 steps above the leaves, or
    above the sources' roots. roots: s (a source's number) and n (how many leaves). runs: s, p and own, the (digit, leaf,
    and what else was carried) of the up to 16 leaves of each run. root: one row, digest."""

    tree: list[DataFrame]
    top: list[DataFrame]
    roots: DataFrame
    runs: DataFrame
    root: DataFrame


def _above(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes (keys, p, digest) put together by 16."""
    own = F.sort_array(F.collect_list(F.struct((F.col("p") % FAN).alias("digit"), "digest")))["digest"]
    up = nodes.groupBy(*keys, F.floor(F.col("p") / FAN).alias("p")).agg(own.alias("children"))
    return up.withColumn("digest", digest(joined(F.col("children"))))


def _records(nodes: DataFrame) -> DataFrame:
    return saved(nodes.groupBy("digest").agg(F.first("children").alias("children"), F.count("*").alias("n")))


def build_manifest(leaves: DataFrame, carry: tuple[str, ...] = ()) -> Manifest:
    """The manifest of leaves(doc_id, source, leaf) and more columns to carry along.

    Leaves of a source are ranked by doc_id (nulls first), equal ids by leaf; a null source is a source, the first one.
    Rows are range-sorted by source and doc_id, and ranks follow from the sizes of the parts, so a source of any size is
    many tasks. Repeated rows are leaves each.
    """
    by = ["source", "doc_id", "leaf", "__row"]
    parts = leaves.repartitionByRange(*by).sortWithinPartitions(*by)
    parts = saved(parts.select("source", "doc_id", "leaf", *carry, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(2**33 - 1).alias("at")))
    sizes = parts.groupBy("source", "part").agg(F.count("*").alias("in_part"), F.min("at").alias("first"))
    own = Window.partitionBy("source").orderBy("part")
    sizes = sizes.withColumns({"before": F.coalesce(F.sum("in_part").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("in_part").over(Window.partitionBy("source"))})
    sizes = saved(sizes.drop("in_part"))
    roots = saved(numbered(sizes.select("source", "n").distinct(), ["source"], into="s"))
    here = sizes.join(roots.select(F.col("source").alias("of"), "s"), F.col("source").eqNullSafe(F.col("of"))).select(F.col("part").alias("in_part"), "of", "s", "n", (F.col("before") - F.col("first")).alias("from"))
    placed = parts.join(here, (F.col("part") == F.col("in_part")) & F.col("source").eqNullSafe(F.col("of"))).withColumn("rank", F.col("from") + F.col("at"))
    one = F.struct((F.col("rank") % FAN).cast("int").alias("digit"), "leaf", "doc_id", *carry)
    runs = saved(placed.groupBy("s", F.floor(F.col("rank") / FAN).alias("p")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(one)).alias("own")))
    dropped(parts)

    n_sources, largest = roots.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    lone = F.col("n") == 1
    nodes = runs.select("s", "p", "n", F.col("own.leaf").alias("children")).withColumn("digest", F.when(lone, F.col("children")[0]).otherwise(digest(joined(F.col("children")))))
    found, tree = [], []
    for h in range(1, max(1, height(largest)) + 1):
        if h > 1:
            nodes = saved(_above(nodes.filter(F.col("n") > FAN ** (h - 1)), ["s", "n"]))
        tree.append(_records(nodes.filter("n > 1")))
        found.append(nodes.filter(F.col("n") <= FAN**h).select(F.col("s").alias("p"), "digest"))
    upper, top = saved(reduce(DataFrame.unionByName, found)), []
    for _ in range(height(n_sources)):
        upper = saved(_above(upper, []))
        top.append(_records(upper))
    return Manifest(tree, top, roots.select("s", "n"), runs, upper.select("digest"))


def _by_digest(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """The nodes with their children. Equal subtrees, as of repeated rows, share a record; one that very many nodes share
    is dealt."""
    if records.filter("n > 5000").isEmpty():
        return nodes.join(records.drop("n"), "digest")
    return heavy_join(nodes, records, ["digest"], "n", spread=["s", "p"] if "p" in nodes.columns else ["s"])


def _step(frontier: DataFrame, records: DataFrame, prefix: str) -> DataFrame:
    """One step down: every child, its digit added to the prefix, and the children beside it as a segment of the path."""
    found = _by_digest(frontier, records)
    found = found.select(*[c for c in frontier.columns if c != "digest"], "children", F.posexplode("children").alias("digit", "digest"))
    segment = F.struct("digit", beside(F.col("children"), F.col("digit")).alias("others"))
    return found.withColumns({prefix: F.col(prefix) * FAN + F.col("digit"), "path": F.concat("path", F.array(segment))}).drop("children", "digit")


def beside(children: Column, digit: Column) -> Column:
    """The children without one of them."""
    return F.concat(F.slice(children, F.lit(1), digit), F.slice(children, digit + 2, F.lit(FAN)))


def fold(leaf: Column, segments: Column) -> Column:
    """The root that follows from a leaf and its proof, segments of (digit, others) from below."""
    return F.aggregate(segments, leaf, lambda x, g: digest(joined(F.concat(F.slice(g["others"], F.lit(1), g["digit"]), F.array(x), F.slice(g["others"], g["digit"] + 1, F.lit(FAN))))))


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """requests(s, p, wanted) with subroot, root and own, for each run of leaves with requests: wanted is an array of
    structs with the digit of a leaf, and own gives each with its segments (digit, others), from below.

    A request goes the way from the root by its digits; those of one run go it together, and ways that no request goes
    are left. The hot top of the graph has few rows, since a step's rows are the different ways so far.
    """
    wanted = lambda c, h: requests.select(F.floor(F.col(c) / FAN**h).alias("__way"), *(["s"] if c == "p" else [])).distinct()
    at = manifest.root.select("digest", F.col("digest").alias("root"), F.lit(0).cast("long").alias("s"), F.array().cast("array<struct<digit: int, others: array<string>>>").alias("path"))
    for h in range(len(manifest.top) - 1, -1, -1):
        at = _step(at, manifest.top[h], "s")
        ways = wanted("s", h)
        at = at.join(ways, at["s"] == ways["__way"], "left_semi")
    subs = saved(at.withColumns({"subroot": F.col("digest"), "p": F.lit(0).cast("long")}).join(manifest.roots, "s"))
    at = subs.filter("false")
    for h in range(len(manifest.tree) - 1, 0, -1):
        # The sources whose own root is at this height join those on their way down, so that each step is read once.
        at = at.unionByName(subs.filter((F.col("n") > FAN**h) & (F.col("n") <= FAN ** (h + 1))))
        ways = wanted("p", h - 1).withColumnRenamed("s", "__s")
        at = _step(at.withColumnRenamed("n", "leaves"), manifest.tree[h], "p").withColumnRenamed("leaves", "n")
        at = at.join(ways, (at["s"] == ways["__s"]) & (at["p"] == ways["__way"]), "left_semi") if h > 1 else at
    at = at.unionByName(subs.filter((F.col("n") > 1) & (F.col("n") <= FAN))).join(requests, ["s", "p"])
    alone = subs.filter("n = 1").join(requests, ["s", "p"]).withColumn("children", F.array("digest"))
    found = _by_digest(at.withColumnRenamed("n", "leaves"), manifest.tree[0]).withColumnRenamed("leaves", "n").unionByName(alone)
    last = lambda x: F.when(F.col("n") > 1, F.array(F.struct(x["digit"].alias("digit"), beside(F.col("children"), x["digit"]).alias("others"))))
    own = F.transform("wanted", lambda x: x.withField("segments", F.reverse(F.concat("path", F.coalesce(last(x), F.expr("cast(array() as array<struct<digit: int, others: array<string>>>)"))))))
    return found.select("s", "p", "subroot", "root", own.alias("own"))


def verify_documents(docs: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 (of the siblings of all levels, from below, left to right), folded_root
    and verified for every row of docs(doc_id, source, lang, n_chars, text).

    folded_root follows from a row's leaf and its proof; where `tampered` holds, from the leaf of the row with the A-Z of
    its text in lower case, so that it differs from root (verified is false) unless there were none. By default those
    rows are tampered whose doc_id, written as a decimal number, has a CRC-32 that 5 divides; a null doc_id has none.

    Nulls are `-` in a leaf, an empty text isn't. A null source is the first source, null doc_ids stand first in their
    source, equal ids by leaf; repeated rows are leaves each. A source with one row has its leaf as subroot, a table with
    one source its subroot as root. An empty table gives no rows. Other columns are ignored.
    """
    if tampered is None:
        tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    columns = {c: F.col(c) for c in fields}
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaves = docs.select("doc_id", "source", leaf_digest(columns).alias("leaf"), F.when(tampered, leaf_digest(columns | {"text": lower})).alias("changed"), F.monotonically_increasing_id().alias("__row"))
    manifest = build_manifest(saved(leaves), carry=("changed",))
    proofs = prove(manifest, manifest.runs.select("s", "p", F.col("own").alias("wanted")))
    each = proofs.select("subroot", "root", F.explode("own").alias("x")).select("x.*", "subroot", "root")
    each = each.select("doc_id", "leaf", "subroot", "root", digest(joined(F.flatten(F.transform("segments", lambda g: g["others"])))).alias("proof_sha256"), fold(F.coalesce("changed", "leaf"), F.col("segments")).alias("folded_root"))
    return each.withColumn("verified", F.col("folded_root") == F.col("root"))
