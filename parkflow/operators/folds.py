"""Folds over time, taken in parts that begin before it is known what comes in.

Each group is cut into consecutive parts of bounded size. All parts run at once, as if nothing came in; a part then runs
again while what the part before hands on isn't what it was given. After k rounds the first k parts of each group are
final, so the result is that of one fold; mostly two or three rounds do, since what lies long ago decides little.
"""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from parkflow.tables import written

#: A fold of one part: its rows and the arrays that came in (none: nothing) to the rows found and the arrays handed on.
Fold = Callable[[pd.DataFrame, list[np.ndarray]], tuple[pd.DataFrame, list[np.ndarray]]]


def _packed(arrays: list[np.ndarray]) -> bytes | None:
    """None where the arrays are empty, so that nothing handed on is as if no part came before."""
    if not arrays or not len(arrays[0]):
        return None
    out = io.BytesIO()
    for a in arrays:
        np.save(out, a, allow_pickle=False)
    return out.getvalue()


def _unpacked(state: bytes | None) -> list[np.ndarray]:
    data, out = io.BytesIO(state or b""), []
    while data.tell() < len(state or b""):
        out.append(np.load(data, allow_pickle=False))
    return out


def fold_in_parts(rows: DataFrame, group: str, fold: Fold, found: str) -> DataFrame:
    """The rows (of schema `found`) that a fold finds in rows(group, part, ...): parts of a group count up by one, and one
    that is missing hands nothing on. No group is null."""
    rows = written(rows)
    own_fields = StructType.fromDDL(found)
    names = own_fields.names
    schema = StructType([StructField("__group", rows.schema[group].dataType), StructField("__part", LongType()), StructField("__last", BooleanType()), StructField("__state", BinaryType()), StructField("__given", BinaryType()), *own_fields])
    arrow = to_arrow_schema(schema)

    def run(own: pa.Table, given: pa.Table) -> pa.Table:
        if not own.num_rows:
            return arrow.empty_table()
        came = given["given"][0].as_py() if given.num_rows else None
        out, handed = fold(own.to_pandas(integer_object_nulls=True), _unpacked(came))
        at = [own[group][0].as_py(), own["part"][0].as_py()]
        columns = [*([v] * len(out) for v in (*at, False, None, None)), *(out[c] for c in names)]
        last = [[v] for v in (*at, True, _packed(handed), came)] + [[None]] * len(names)
        pieces = [pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cs, arrow)], schema=arrow) for cs in (columns, last)]
        return pa.concat_tables(pieces).combine_chunks()

    todo = rows.select(F.col(group).alias("__group"), F.col("part").alias("__part")).limit(0).withColumn("given", F.lit(None).cast("binary"))
    work, runs, ends = rows, [], None
    while True:
        done = written(work.groupBy(group, "part").cogroup(todo.groupBy("__group", "__part")).applyInArrow(run, schema))
        own = done.filter("__last").select("__group", "__part", "__state", "__given")
        runs.append(done.withColumn("__run", F.lit(len(runs))))
        ends = written(own if ends is None else ends.join(own.select("__group", "__part"), ["__group", "__part"], "left_anti").unionByName(own))
        before = ends.select("__group", (F.col("__part") + 1).alias("__part"), F.col("__state").alias("given"))
        todo = written(ends.join(before, ["__group", "__part"], "left").filter(~F.col("__given").eqNullSafe(F.col("given"))).select("__group", "__part", "given"))
        if todo.isEmpty():
            break
        work = rows.join(todo.select(F.col("__group").alias(group), F.col("__part").alias("part")), [group, "part"], "left_semi")
    if len(runs) == 1:
        return runs[0].filter("not __last").select(*names)
    every = runs[0]
    for r in runs[1:]:
        every = every.unionByName(r)
    latest = every.filter("__last").groupBy("__group", "__part").agg(F.max("__run").alias("__run"))
    return every.filter("not __last").join(latest, ["__group", "__part", "__run"], "left_semi").select(*names)
