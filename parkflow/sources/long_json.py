"""Long JSON documents read in parts: one file of any size is many tasks.

A file is cut at its closing braces by the text source, whose splits are byte ranges. What a piece means hangs on what
stands before it: whether a text is open, how deep it is, which keys lead there. Each split is summed up in one small row
for both ways in which it can begin, and only these rows are gone through in the file's order. Pieces stay in the task
that reads their split, in their order: what runs on from piece to piece is added up there, and only objects that stand
in two splits or more are put together elsewhere.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parkflow.tables import task, written

SUMS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("quotes", pa.int64()), ("step0", pa.int64()), ("step1", pa.int64())])
KINDS = "split long, at long, first boolean, ended boolean, depth long, after long, outer string, inner string, text string"
RECORDS = pa.schema([(c, {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[t]) for c, t in (x.split() for x in KINDS.split(", "))])

#: What the files of a document that a task writes have in their names, behind what they share, and their number.
ROLLED = r"-c(\d+)(?:\.[^/]*)?$"
ESCAPE, TOKEN = re.compile(r"\\.", re.S), re.compile(r'"[^"]*+"|[^"{]++|\{')
KEY = re.compile(r'"[^"]*+"|[^"]++')


def _masked(text: Column) -> Column:
    """Escapes become two plain characters, so that quotes only begin and end texts."""
    return F.when(text.contains("\\"), F.regexp_replace(text, r"(?s)\\.", "__")).otherwise(text)


def _pieces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """What stands between closing braces, in the order of the file: file, start (of the split) and text."""
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    return spark.read.option("lineSep", "}").text(paths).select(*meta, F.col("value").alias("text"))


def _counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each piece the quotes, the opening braces, and how many of these open objects if no text is open where the piece
    begins; if one is, the others do."""
    if pc.any(pc.match_substring(texts, "\\")).as_py():  # escapes become two plain characters
        texts = pc.replace_substring_regex(texts, r"(?s)\\.", "__")
    ends = np.frombuffer(texts.buffers()[1], "int32")[texts.offset : texts.offset + len(texts) + 1].astype("int64")
    data = np.frombuffer(texts.buffers()[2] or b"", "uint8")[ends[0] : ends[-1]]
    ends -= ends[0]
    quotes, braces = np.flatnonzero(data == ord('"')), np.flatnonzero(data == ord("{"))
    before = np.searchsorted(quotes, ends)
    of = np.searchsorted(ends, braces, side="right") - 1
    outside = (np.searchsorted(quotes, braces) - before[of]) % 2 == 0
    return np.diff(before), np.bincount(of, minlength=len(texts)), np.bincount(of[outside], minlength=len(texts))


def _stretches(batch: pa.RecordBatch, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, split by split."""
    turns = [pc.not_equal(batch[k][1:], batch[k][:-1]).to_numpy(zero_copy_only=False) for k in keys]
    ends = [0, *(np.flatnonzero(np.logical_or.reduce(turns)) + 1), batch.num_rows]
    for begin, end in zip(ends, ends[1:]):
        yield batch.slice(begin, end - begin)


def _steps(counts: tuple[np.ndarray, np.ndarray, np.ndarray], inside: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each piece whether its brace closes an object and isn't part of a text, and by how much it goes deeper; inside:
    whether a text is open where the first begins."""
    quotes, braces, opened = counts
    begun = (inside + np.cumsum(quotes) - quotes) % 2
    closes = (begun + quotes) % 2 == 0
    return closes, np.where(begun == 0, opened, braces - opened) - closes


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each split."""
    row = lambda: pa.RecordBatch.from_pylist([dict(zip(SUMS.names, (*split, *sums)))], schema=SUMS)
    split, sums = None, None
    for batch in batches:
        for rows in _stretches(batch, ["file", "start"]) if batch.num_rows else ():
            own = rows["file"][0].as_py(), rows["start"][0].as_py()
            if own != split:
                if split:
                    yield row()
                split, sums = own, [0, 0, 0]
            counts = _counts(rows["text"])
            steps = [int(_steps(counts, (sums[0] + begun) % 2)[1].sum()) for begun in (0, 1)]
            sums = [sums[0] + int(counts[0].sum()), sums[1] + steps[0], sums[2] + steps[1]]
    if split:
        yield row()


def _joined(texts: pa.Array, ends: np.ndarray) -> pa.Array:
    """Pieces put together, up to each end."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), texts), "}")


def _last_key_in(text: str, masked: str) -> str | None:
    """As _last_key and read as JSON, within a task."""
    keys = [m for m in KEY.finditer(masked) if m[0][0] == '"' and masked[m.end() :].lstrip(" \t\n\x0b\f\r")[:1] == ":"]
    try:
        return json.loads(text[keys[-1].start() : keys[-1].end()]).encode("utf-8", "replace").decode() if keys else None
    except ValueError:
        return None


def _opened(text: str, depth: int) -> tuple[str | None, str | None, str]:
    """As _keyed within a task: the keys that stand in a record, outer and inner, and its object."""
    masked = ESCAPE.sub("__", text)
    braces = [m.start() for m in TOKEN.finditer(masked) if m[0] == "{"]
    outer_at = braces[1 - depth] if depth < 2 else 0
    inner_at = braces[2 - depth]
    outer = _last_key_in(text[:outer_at], masked[:outer_at]) if depth < 2 else None
    return outer, _last_key_in(text[outer_at:inner_at], masked[outer_at:inner_at]), text[inner_at:]


def _objects(texts: pa.Array, depth: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Outer and inner keys, null where none stand in a record, and the objects alone.

    The object follows on the (3 - depth)-th brace; what stands before the last two braces has the keys. Most objects
    follow on another: no text stands before them."""
    brace, quote = (pc.find_substring(texts, c).to_numpy() for c in ("{", '"'))
    keyed = (depth < 2) | (brace < 0) | (quote >= 0) & (quote < brace)
    objects = pc.replace_substring_regex(texts, "^[^{]*", "", max_replacements=1)
    outer, inner = [None] * len(texts), [None] * len(texts)
    at = np.flatnonzero(keyed)
    if len(at):
        own = []
        for i in at.tolist():
            outer[i], inner[i], one = _opened(texts[i].as_py(), int(depth[i]))
            own.append(one)
        objects = pc.replace_with_mask(objects, pa.array(keyed), pa.array(own, pa.string()))
    return pa.array(outer, pa.string()), pa.array(inner, pa.string()), objects


def _lists(records: pa.RecordBatch, most: int) -> pa.RecordBatch:
    """Records that follow one another under the same keys as one, a list of no more than `most` objects."""
    n = records.num_rows
    new = np.arange(n) % most == 0
    for c in ("outer", "inner"):
        key = records[c].dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= key[1:] != key[:-1]
    starts = np.flatnonzero(new)
    lists = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, n), pa.int32()), records["text"]), ",")
    found = records.take(pa.array(starts))
    return found.set_column(RECORDS.get_field_index("text"), RECORDS.field("text"), pc.binary_join_element_wise("[", lists, "]", ""))


def _recorded(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """An object of the third level and all that stands between it and the one before is one record: the depth where it
    begins and the one after it, the keys that hold there, as far as they stand in this split, and the object. Records that
    may begin in a split before (first) or end in a later one (not ended) have their whole text. A row more for each split,
    in which `ended` is null, has the last keys. most: if not 0, objects are put together as lists (see _lists)."""
    split = inside = depth = at = begun = None
    first, held = True, []  # what has no end yet
    last: dict[str, str | None] = {}
    one = lambda **own: pa.RecordBatch.from_pylist([{"split": split, **last, **own}], schema=RECORDS)

    def rest() -> Iterator[pa.RecordBatch]:
        if held:
            yield one(at=at, first=first, ended=False, depth=begun, text="}".join(held) + "}")
        if split is not None:
            yield one()

    def keyed(records: pa.RecordBatch) -> pa.RecordBatch:
        keys = _objects(records["text"], records["depth"].to_numpy())
        for c, own in zip(("outer", "inner"), keys):
            filled = pc.fill_null_forward(pa.concat_arrays([pa.array([last[c]], pa.string()), own]))[1:]
            last[c] = filled[-1].as_py()
            records = records.set_column(RECORDS.get_field_index(c), RECORDS.field(c), filled)
        records = records.set_column(RECORDS.get_field_index("text"), RECORDS.field("text"), keys[2])
        return _lists(records, most) if most else records

    for batch in batches:
        for rows in _stretches(batch, ["split"]) if batch.num_rows else ():
            if (own := rows["split"][0].as_py()) != split:
                yield from rest()
                split, inside, depth, at, first, held = own, rows["begun"][0].as_py(), rows["before"][0].as_py(), 0, True, []
                last = {"outer": None, "inner": None}
            texts = rows["text"]
            counts = _counts(texts)
            closes, step = _steps(counts, inside)
            after = depth + np.cumsum(step)
            before = after - step
            inside, depth = (inside + int(counts[0].sum())) % 2, int(after[-1])
            ends = np.flatnonzero(closes & (after <= 2)) + 1
            if len(ends):
                n, begins = len(ends), before[np.append(0, ends[:-1])]
                found = _joined(texts, ends)
                if held:
                    found = pa.concat_arrays([pa.array(["}".join([*held, found[0].as_py()])], pa.string()), found[1:]])
                    begins[0] = begun
                none = pa.nulls(n, pa.string())
                columns = [np.full(n, split), at + np.arange(n), np.arange(n) < int(first), np.full(n, True), begins, after[ends - 1]]
                records = pa.RecordBatch.from_arrays([*map(pa.array, columns), none, none, pc.binary_join_element_wise(found, "}", "")], schema=RECORDS)
                if first:
                    yield records[:1]
                records = records.filter(pa.array(~columns[2] & (columns[5] == 2)))
                if records.num_rows:
                    yield keyed(records)
                at, first, held, texts, before = at + n, False, [], texts[int(ends[-1]) :], before[ends[-1] :]
            if len(texts):
                begun = begun if held else int(before[0])
                held.append(_joined(texts, np.array([len(texts)]))[0].as_py())
    yield from rest()


def _splits(pieces: DataFrame, rolled: bool) -> DataFrame:
    """split (its number), file, start, document and place (of the split in it), begun (whether a text is open where it
    begins) and before (the depth there). rolled: files of a document stand 2^40 bytes apart."""
    sums = written(pieces.mapInArrow(task(__name__, "_summed"), "file string, start long, quotes long, step0 long, step1 long"))
    number = F.try_to_number(F.regexp_extract("file", ROLLED, 1), F.lit("9" * 18)).cast("long") if rolled else F.lit(0).cast("long")
    number = F.coalesce(number, F.raise_error(F.concat(F.lit("not one of a document's files: "), "file")).cast("long"))
    sums = sums.withColumn("document", F.regexp_replace("file", ROLLED, "") if rolled else F.col("file")).withColumn("number", number)
    sums = sums.withColumn("place", F.col("number") * 2**40 + F.col("start"))
    file, every = Window.partitionBy("document").orderBy("place"), Window.partitionBy("document")
    sums = sums.withColumn("gap", F.col("number") - F.lag("number", 1, -1).over(file) > 1)
    ahead = lambda value: F.coalesce(F.sum(value).over(file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("begun", ahead("quotes") % 2).withColumn("step", F.when(F.col("begun") == 0, F.col("step0")).otherwise(F.col("step1")))
    # Behind the last brace there may be blanks, which no brace follows.
    sound = F.sum("step").over(every).isin(0, -1) & (F.sum("quotes").over(every) % 2 == 0)
    before = F.when(F.col("gap"), F.raise_error(F.concat(F.lit("a file is missing: "), "document")).cast("long")).when(sound, ahead("step"))
    before = before.otherwise(F.raise_error(F.concat(F.lit("not whole JSON: "), "document")).cast("long"))
    return written(sums.select(F.monotonically_increasing_id().alias("split"), "file", "start", "document", "place", "begun", before.alias("before")))


def _together(tokens: Column, first: Column | int, n: Column) -> Column:
    return F.concat_ws("", F.slice(tokens, first, n))


def _last_key(head: Column) -> Column:
    """The last key in a text of JSON, as it is written; null if there is none."""
    tokens = F.regexp_extract_all(_masked(head), F.lit(r'"[^"]*+"(?:\s*+:)?|[^"]++'), F.lit(0))
    keys = F.transform(tokens, lambda t: t.startswith('"') & t.endswith(":"))
    i = (F.size(tokens) - F.array_position(F.reverse(keys), True) + 1).cast("int")
    before = F.length(_together(tokens, 1, i - 1))
    key = F.substring(head, before + 1, F.length(F.get(tokens, i - 1)))
    return F.when(F.array_contains(keys, True), F.regexp_extract(key, r'(?s)^(".*")\s*:$', 1))


def _keyed(records: DataFrame) -> DataFrame:
    """records(depth, text) with the keys that stand in them, outer and inner, and the object alone as text.

    The object follows on the (3 - depth)-th brace; what stands before the last two braces has the keys. Most objects
    follow on another: no text stands before them."""
    columns = [c for c in records.columns if c != "text"]
    keys = (F.col("depth") < 2) | ~F.col("text").rlike(r'^[^"{]*+\{')
    records = records.withColumn("tokens", F.when(keys, F.regexp_extract_all(_masked(F.col("text")), F.lit(r'"[^"]*+"|[^"{]++|\{'), F.lit(0))))
    tokens, keys = F.col("tokens"), F.col("tokens").isNotNull()
    braces = F.filter(F.sequence(F.lit(1), F.size(tokens)), lambda i: F.get(tokens, i - 1) == "{")
    at = lambda level: F.length(_together(tokens, 1, F.get(braces, (F.lit(level - 1) - F.col("depth")).cast("int")) - 1))
    records = records.withColumn("outer_at", F.when(keys & (F.col("depth") < 2), at(2))).withColumn("inner_at", F.when(keys, at(3)).otherwise(F.instr("text", "{") - 1))
    head = F.substring("text", F.coalesce(F.col("outer_at"), F.lit(0)) + 1, F.col("inner_at") - F.coalesce(F.col("outer_at"), F.lit(0)))
    outer = F.when(F.col("outer_at").isNotNull(), _last_key(F.substring("text", F.lit(1), F.col("outer_at"))))
    plain = lambda c: F.from_json(F.concat(F.lit('{"k":'), c, F.lit("}")), "k string")["k"]
    return records.select(*columns, plain(outer).alias("outer"), plain(F.when(keys, _last_key(head))).alias("inner"), F.substring("text", F.col("inner_at") + 1, F.length("text")).alias("text"))


def listed_objects(spark: SparkSession, paths: str | list[str], under: str, rolled: bool = False, most: int = 0) -> DataFrame:
    """key and value (JSON text) of the objects listed in {under: {key: [object, ...], ...}, ...}, of files of any size.

    Objects within objects, other fields beside `under`, braces and escapes within keys and texts are all right. Keys
    without objects give no rows, nor do entries that aren't objects; of a repeated key both lists are read. Braces or
    quotes that don't match are an error; a missing last brace isn't noticed. An object is small, a file needn't be; a file
    that is compressed by bzip2 is many tasks as well. rolled: a document is several files, of any compression, that end at
    closing braces and follow one another by the numbers in their names, as those of a task do (see `write_listed`). most:
    if not 0, a value is a list of up to so many objects of a key, which costs less to go on with than one by one.

    Files are read twice, and the records are written once. Of each split one row goes to every task, as the scan itself
    keeps one. Were a file cut otherwise the second time, that is an error.
    """
    pieces = _pieces(spark, paths)
    splits = _splits(pieces, rolled)
    found = pieces.join(F.broadcast(splits.select("file", "start", "split", "begun", "before")), ["file", "start"], "left")
    number = F.coalesce("split", F.raise_error(F.concat(F.lit("cut otherwise when read again: "), "file")).cast("long"))
    own = written(found.select(number.alias("split"), "begun", "before", "text").mapInArrow(task(__name__, "_recorded", most=most), KINDS))
    whole = F.col("ended") & ~F.col("first")

    edges = own.filter(~whole).join(splits.select("split", "document", "place"), "split")
    ahead = Window.partitionBy("document").orderBy("place", "at").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("ends", F.coalesce(F.sum(F.col("ended").cast("int")).over(ahead), F.lit(0)))
    edges = edges.groupBy("document", "ends").agg(F.array_sort(F.collect_list(F.struct("place", "at", "split", "ended", "depth", "after", "text"))).alias("own"))
    last = F.element_at("own", -1)
    edges = edges.filter(last["ended"] & (last["after"] == 2)).select(last["split"].alias("split"), F.col("own")[0]["depth"].alias("depth"), F.concat_ws("", F.col("own.text")).alias("text"))
    edges = written(_keyed(edges))
    single = F.concat(F.lit("["), "text", F.lit("]")).alias("text") if most else F.col("text")

    ends = own.filter("ended is null").select("split", *[F.col(c).alias(f"{c}_end") for c in ("outer", "inner")])
    keys = splits.select("split", "document", "place").join(edges.select("split", "outer", "inner"), "split", "left").join(ends, "split", "left")
    before = Window.partitionBy("document").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    keys = written(keys.select("split", *[F.coalesce(c, F.last(F.coalesce(f"{c}_end", c), ignorenulls=True).over(before)).alias(f"{c}_before") for c in ("outer", "inner")]))
    every = own.filter(whole).select("split", "outer", "inner", "text").unionByName(edges.select("split", "outer", "inner", single)).join(F.broadcast(keys), "split")
    key = lambda c: F.coalesce(c, f"{c}_before")
    return every.filter(key("outer") == under).select(key("inner").alias("key"), F.col("text").alias("value"))
