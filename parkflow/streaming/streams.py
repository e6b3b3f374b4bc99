"""The same rules over streams: state by key, bounded by watermarks."""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parkflow.operators.bundles import Bundles


def stream_new_media(paths: DataFrame, late: str | None = None) -> DataFrame:
    """Each path once. With `late`, paths(path, modified) are remembered only until the watermark of `modified` has
    passed them, so state doesn't grow for ever; without it every path is remembered."""
    if late is None:
        return paths.dropDuplicates(["path"])
    return paths.withWatermark("modified", late).dropDuplicatesWithinWatermark(["path"])


def late_rows(progress: list[dict]) -> int:
    """How many rows came behind the watermark and were dropped, from a query's progress reports (recentProgress, or a
    listener's for a long run). A stream with two stateful steps counts what either drops."""
    return sum(o["numRowsDroppedByWatermark"] for p in progress for o in p["stateOperators"])


def stream_dwell(readings: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of each plate: readings(plate_text, ts) no further apart than gap."""
    s = readings.filter("plate_text is not null").withWatermark("ts", late).groupBy(F.session_window("ts", gap), "plate_text")
    return s.agg(F.min("ts").alias("entry"), F.max("ts").alias("exit"), F.count("*").alias("sightings")).select("plate_text", "entry", "exit", "sightings")


def stream_interval_counts(instances: DataFrame, width: str, late: str) -> DataFrame:
    """Entities of each type in each interval, each once: first by entity, then by type."""
    w = F.window("ts", width)
    once = instances.withWatermark("ts", late).groupBy(w, "entity_id").agg(F.min(F.struct("ts", "type_id"))["type_id"].alias("type_id"))
    return once.groupBy(F.window(F.window_time("window"), width), "type_id").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "type_id", "n")


def _occupancy(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    entered, exited, least = state.get if state.exists else (0, 0, 0)
    rows = pd.concat(list(batches)).sort_values(["t", "step", "entity_id"], ascending=[True, False, True])
    out = []
    for r in rows.itertuples():
        entered, exited = entered + (r.step > 0), exited + (r.step < 0)
        least = min(least, entered - exited)
        out.append((key[0], r.t, r.entity_id, entered, exited, entered - exited, least))
    state.update((int(entered), int(exited), int(least)))
    yield pd.DataFrame(out, columns=["site", "t", "entity_id", "entered_total", "exited_total", "running", "least"])


def stream_occupancy(events: DataFrame) -> DataFrame:
    """Running totals of each site, with the least value so far (the whole history is what a lift would need).

    Events are ordered by time within a micro-batch. One that arrives in a later micro-batch than its time is counted
    where it arrives: totals from there on include it, rows that are out already don't. Where the order over batches
    matters, the finished timeline is what the batch operator gives.
    """
    return events.groupBy("site").applyInPandasWithState(_occupancy, "site long, t long, entity_id long, entered_total long, exited_total long, running long, least long", "entered long, exited long, least long", "append", GroupStateTimeout.NoTimeout)


def _skip(n: int, skip: int):
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("frame_index")
        kept = []
        for r in rows[rows["frame_index"] % n == 0].itertuples():
            if left:
                left -= 1
            else:
                kept.append((key[0], r.frame_index))
                left = skip if r.detections == 0 else 0
        state.update((int(left),))
        yield pd.DataFrame(kept, columns=["video", "frame_index"])

    return step


def stream_adaptive_skip(frames: DataFrame, n: int, skip: int) -> DataFrame:
    """Every n-th frame, but after an empty one the next `skip` of them are left out."""
    return frames.groupBy("video").applyInPandasWithState(_skip(n, skip), "video string, frame_index long", "left int", "append", GroupStateTimeout.NoTimeout)


STORE = "spark.sql.streaming.stateStore.providerClass"
DEFAULT_STORE, ROCKSDB = (f"org.apache.spark.sql.execution.streaming.state.{x}StateStoreProvider" for x in ("HDFSBacked", "RocksDB"))


AT = "__at"


def _packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of the stretches of rows that are alike in all columns."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    starts = np.flatnonzero(new).tolist()
    return list(zip(starts, [*starts[1:], len(new)]))


class InOrder(StatefulProcessor):
    """Rows of a key in the order of event time, however they come: each waits until the watermark has passed its time,
    when nothing earlier can follow, and is then handed to `take` with the others that are due.

    What waits is a map from a stretch of time and a number to rows, in columns: each batch adds pieces of its own, and
    only those that are due are read again, a stretch at a time. A key has one timer at a time: for its earliest stretch,
    or earlier where `until` asks for one. columns: what is kept of a row; the first is the event time.
    """

    columns: tuple[str, ...] = ()
    stretch_us = 1_000_000
    most_bytes = 64_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "stretch long, piece long", "rows binary")

    def take(self, key, due: Iterator[pd.DataFrame], now: int) -> Iterator[pd.DataFrame]:
        """What comes out as the watermark reaches `now` (microseconds), with the rows up to there: one stretch after the
        other, all of which are to be taken, with their times (microseconds) as AT and the other columns."""
        raise NotImplementedError

    def until(self) -> int | None:
        """The time (microseconds) at which the key is to be looked at though no row is due."""
        return None

    def _pieces(self) -> dict[int, list[int]]:
        found: dict[int, list[int]] = {}
        for stretch, piece in self.waiting.keys():
            found.setdefault(stretch, []).append(piece)
        return found

    def _keep(self, parts: list[pd.DataFrame], pieces: dict[int, list[int]]) -> None:
        rows = pd.concat(parts, ignore_index=True)
        times = rows[self.columns[0]].astype("datetime64[us]").astype("int64").to_numpy()
        stretch = times // self.stretch_us
        order = np.argsort(stretch, kind="stable")
        rows, stretch = rows[list(self.columns[1:])].assign(**{AT: times}).iloc[order], stretch[order]
        for begin, end in _runs(stretch):
            own = pieces.setdefault(int(stretch[begin]), [])
            own.append(max(own, default=-1) + 1)
            self.waiting.updateValue((int(stretch[begin]), own[-1]), (_packed(rows.iloc[begin:end]),))

    def _due(self, pieces: dict[int, list[int]], now: int) -> Iterator[pd.DataFrame]:
        """The rows up to now, by stretches; what is later stays, and `pieces` with it."""
        for stretch in sorted(k for k in pieces if k * self.stretch_us <= now):
            rows = pd.concat([_unpacked(self.waiting.getValue((stretch, piece))[0]) for piece in pieces[stretch]], ignore_index=True)
            later = rows[AT] > now
            if not later.all():
                for piece in pieces.pop(stretch):
                    self.waiting.removeKey((stretch, piece))
                if later.any():
                    pieces[stretch] = [0]
                    self.waiting.updateValue((stretch, 0), (_packed(rows[later]),))
                yield rows[~later]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pieces, parts, n = self._pieces(), [], 0
        for part in rows:
            parts.append(part[list(self.columns)])
            n += int(parts[-1].memory_usage(deep=True).sum())
            if n >= self.most_bytes:
                self._keep(parts, pieces)
                parts, n = [], 0
        if parts:
            self._keep(parts, pieces)
        self._wake(pieces, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_ms, pieces = timerValues.getCurrentWatermarkInMs(), self._pieces()
        for found in self.take(key, self._due(pieces, 1000 * now_ms), 1000 * now_ms):
            yield found[self.out]
        self._wake(pieces, now_ms)

    def _wake(self, stretches: Iterable[int], now_ms: int) -> None:
        times = [k * self.stretch_us for k in stretches]
        if (other := self.until()) is not None:
            times.append(other)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if times:
            self.handle.registerTimer(max(now_ms + 1, -(-min(times) // 1000)))

    def close(self) -> None:
        pass


def _in_order(rows: DataFrame, key: str, processor: InOrder, late: str, out: str) -> DataFrame:
    """Sets the session's state store to RocksDB where none is named: the default one has no maps and timers."""
    if rows.sparkSession.conf.get(STORE, None) in (None, DEFAULT_STORE):
        rows.sparkSession.conf.set(STORE, ROCKSDB)
    processor.out = [c.strip().split()[0] for c in out.split(",")]
    held = rows.withWatermark(processor.columns[0], late)
    return held.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime")


class _Occupancy(InOrder):
    columns = ("ts", "t", "entity_id", "step")

    def init(self, handle) -> None:
        super().init(handle)
        self.totals = handle.getValueState("totals", "entered long, exited long, least long")

    def take(self, key, due, now):
        entered, exited, least = self.totals.get() if self.totals.exists() else (0, 0, 0)
        for rows in due:
            rows = rows.sort_values([AT, "t", "step", "entity_id"], ascending=[True, True, False, True])
            came, went = entered + (rows["step"] > 0).cumsum(), exited + (rows["step"] < 0).cumsum()
            low = (came - went).cummin().clip(upper=least)
            yield rows.assign(site=key[0], entered_total=came, exited_total=went, running=came - went, least=low)
            entered, exited, least = int(came.iloc[-1]), int(went.iloc[-1]), int(low.iloc[-1])
        self.totals.update((entered, exited, least))


def stream_occupancy_in_order(events: DataFrame, late: str) -> DataFrame:
    """As stream_occupancy for events(site, ts, t, entity_id, step), in the order of event time over all micro-batches: a
    row comes out once the watermark has passed it, so totals that are out never change. What comes later than `late` is
    dropped and counted. Needs the RocksDB state store (see `state_store`)."""
    return _in_order(events, "site", _Occupancy(), late, "site long, t long, entity_id long, entered_total long, exited_total long, running long, least long")


class _Skip(InOrder):
    columns = ("ts", "frame_index", "detections")

    def __init__(self, n: int, skip: int):
        self.n, self.skip = n, skip

    def init(self, handle) -> None:
        super().init(handle)
        self.left = handle.getValueState("left", "left int")

    def take(self, key, due, now):
        left = self.left.get()[0] if self.left.exists() else 0
        for rows in due:
            rows = rows[rows["frame_index"] % self.n == 0].sort_values([AT, "frame_index", "detections"])
            kept = []
            for frame, detections in zip(rows["frame_index"].tolist(), rows["detections"].tolist()):
                if left:
                    left -= 1
                else:
                    kept.append((key[0], frame))
                    left = self.skip if detections == 0 else 0
            yield pd.DataFrame(kept, columns=self.out)
        self.left.update((left,))


def stream_adaptive_skip_in_order(frames: DataFrame, n: int, skip: int, late: str) -> DataFrame:
    """As stream_adaptive_skip for frames(video, ts, frame_index, detections), in the order of event time over all
    micro-batches. Needs the RocksDB state store (see `state_store`)."""
    return _in_order(frames, "video", _Skip(n, skip), late, "video string, frame_index long")


def _framed(most: int, counted: bool = False):
    """Boxes (x, y, w, h) of a frame as one row, as far as they are in the same task and its next `most` rows: what keeps
    state takes rows one at a time. counted: equal boxes once, as (x, y, w, h, n), and `most` counts different boxes."""
    keys, boxes = ["video", "ts", "frame_index"], [*"xywh", "n"] if counted else [*"xywh"]

    def packed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        video = rows["video"].combine_chunks().dictionary_encode(null_encoding="encode").indices
        columns = [c.fill_null(-(2**63)).to_numpy() for c in (video.cast("int64"), rows["ts"].cast("int64"), rows["frame_index"])]
        order = np.lexsort(columns[::-1])
        starts = np.array([begin for begin, _ in _runs(*[c[order] for c in columns])], dtype="int64")
        own = np.column_stack([rows[c].to_numpy() for c in boxes]).astype(float)[order]
        ends = np.append(starts, len(own)) * own.itemsize * len(boxes)
        found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype("int32")), pa.py_buffer(own.tobytes())])
        yield from rows.select(keys).take(pa.array(order[starts])).append_column("boxes", found).to_batches(max_chunksize=4096)

    def alike(rows: pa.Table) -> pa.Table:
        found = rows.group_by([*keys, *"xywh"], use_threads=False).aggregate([("n", "sum")])
        return found.rename_columns({"n_sum": "n"}).select([*keys, *boxes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.append_column("n", pa.array(np.ones(batch.num_rows, "int64"))) if counted else batch)
            n += batch.num_rows
            if n >= most:
                rows = pa.Table.from_batches(held)
                if counted:
                    rows = alike(rows)
                    held, n = rows.combine_chunks().to_batches(), rows.num_rows
                    if 2 * n < most:
                        continue
                yield from packed(rows)
                held, n = [], 0
        if n:
            rows = pa.Table.from_batches(held)
            yield from packed(alike(rows) if counted else rows)

    return run


class _Tracks(InOrder):
    """Live tracks (see Bundles): of each piece the first frame and how many boxes, of each last box its frame and time. The
    counter of numbers stays when all tracks have ended."""

    columns = ("ts", "frame_index", "boxes")
    pieces, last, box = ["track_id", "n", "first_frame", "boxes"], ["last_frame", "at"], ["x", "y", "w", "h"]

    def __init__(self, iou: float, alive: int, fps: float):
        self.iou, self.alive, self.lives = iou, alive, int(1e6 * alive / fps)

    def init(self, handle) -> None:
        super().init(handle)
        self.following = handle.getValueState("following", "id long")
        self.live = handle.getValueState("live", "rows binary, at long")

    def _ended(self, video: str, gone: list[tuple[np.ndarray, list]]) -> pd.DataFrame:
        """A row for each track of the bundles that have gone."""
        rows = np.array([(*p, at[0]) for ats, held in gone for at, pieces in zip(ats.tolist(), held) for p in pieces], "int64").reshape(-1, 5)
        n = rows[:, 1]
        found = pd.DataFrame(np.repeat(rows, n, axis=0)[:, [0, 2, 4, 3]], columns=["track_id", "first_frame", "last_frame", "boxes"])
        found["track_id"] += np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return found.assign(video=video)

    def take(self, key, due, now):
        new = self.following.get()[0] if self.following.exists() else 1
        stored = _unpacked(self.live.get()[0]) if self.live.exists() else pd.DataFrame(columns=[*self.pieces, *self.last, *self.box])
        live = Bundles.of(stored[self.box].to_numpy(float), stored[self.last].to_numpy("int64"), list(zip(*(stored[c].tolist() for c in self.pieces))))
        on = lambda p: (*p[:3], p[3] + 1)
        for rows in due:
            rows = rows.sort_values([AT, "frame_index"])
            times, frames, boxes = rows[AT].to_numpy(), rows["frame_index"].to_numpy("int64"), rows["boxes"].to_numpy()
            gone = []
            for begin, end in _runs(times, frames):
                gone.append(live.leave(frames[begin] - live.at[:, 0] <= self.alive))
                own = np.frombuffer(b"".join(boxes[begin:end])).reshape(-1, 5)
                own = own[np.lexsort(own[:, 3::-1].T)]
                first = np.flatnonzero(np.append(True, (own[1:, :4] != own[:-1, :4]).any(axis=1)))
                many = np.add.reduceat(own[:, 4], first).astype("int64").tolist()
                _, new = live.follow(own[first, :4], np.array([frames[begin], times[begin]]), many, self.iou, new, (int(frames[begin]), 1), on)
            yield self._ended(key[0], gone)
        yield self._ended(key[0], [live.leave(live.at[:, 1] + self.lives >= now)])
        self.following.update((new,))
        if live.held:
            box, last, pieces = live.single()
            rows = pd.DataFrame(pieces, columns=self.pieces).join(pd.DataFrame(last, columns=self.last)).join(pd.DataFrame(box, columns=self.box))
            self.live.update((_packed(rows), int(last[:, 1].min())))
        else:
            self.live.clear()

    def until(self):
        return self.live.get()[1] + self.lives + 1000 if self.live.exists() else None


def stream_tracks(detections: DataFrame, late: str, iou: float = 0.15, alive: int = 60, fps: float = 30.0) -> DataFrame:
    """Finished tracks of detections(video, ts, frame_index, x, y, w, h), as track_frames finds them: a track ends when no
    box followed for `alive` frames, or when its video is silent for as long (alive / fps seconds of event time).

    Frames are taken in the order of event time over all micro-batches, each once the watermark has passed it. Numbers
    count from 1 in each video and go on after a silence. Boxes without a frame don't count. Boxes of a frame that come
    together go through as one row, so where late rows are counted these are one, and equal ones of them with how many they
    are; their tracks go on together (see Bundles). Needs the RocksDB state store (see `state_store`)."""
    boxes = detections.filter("frame_index is not null").select("video", "ts", F.col("frame_index").cast("long").alias("frame_index"), *[F.col(c).cast("double").alias(c) for c in "xywh"])
    ts = detections.schema["ts"].dataType.simpleString()
    detections = boxes.mapInArrow(_framed(2_000_000, counted=True), f"video string, ts {ts}, frame_index long, boxes binary")
    return _in_order(detections, "video", _Tracks(iou, alive, fps), late, "video string, track_id long, first_frame long, last_frame long, boxes long")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams built and started within keep their state in RocksDB, as those with maps and timers need; the session's
    setting is as before afterwards."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


class LateRows(StreamingQueryListener):
    """Counts, while queries run, the rows that came behind the watermark and were dropped: (run, batch, dropped)."""

    def __init__(self) -> None:
        self.counts: dict[tuple[str, int], int] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.counts[str(p.runId), p.batchId] = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    def table(self, spark: SparkSession, run_id: str, patience_s: float = 60) -> DataFrame:
        """batch and dropped of a query that has ended, a row for each micro-batch."""
        waited = 0.0
        while run_id not in self.ended and waited < patience_s:
            time.sleep(0.1)
            waited += 0.1
        return spark.createDataFrame([(b, n) for (run, b), n in sorted(self.counts.items()) if run == run_id], "batch long, dropped long")
