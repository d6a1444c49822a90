"""Boxes of one picture followed into the next: a stateful stream of frames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_BOX = ("x0", "y0", "x1", "y1")


def overlap(a: Sequence[float], b: Sequence[float]) -> float:
    """Intersection over union of two boxes (x0, y0, x1, y1); 0 where both have no area."""
    both = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    area = lambda x: max(0.0, x[2] - x[0]) * max(0.0, x[3] - x[1])
    return both / ((area(a) + area(b) - both) or 1.0)


class _Tracker(StatefulProcessor):
    """State of a camera: the boxes of its last frame as a list, the next free number and the time of the last frame.

    A timer clears the boxes when the watermark says that no later frame can still follow on them; the number stays.
    """

    def __init__(self, least: float, gap_us: int, required: int):
        self.least, self.gap, self.required = least, gap_us, required

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.boxes = handle.getListState("boxes", "x0 double, y0 double, x1 double, y1 double, id string, track long, seen long")
        self.last = handle.getValueState("last", "next long, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number, before = self.last.get() if self.last.exists() else (1, None)
        held = [tuple(t) for t in self.boxes.get()]
        out, batch = [], pd.concat(list(rows)).sort_values(["at", "n"], na_position="first")
        columns = [batch[c].tolist() for c in ("at", "n", *_BOX, "id", "small")]
        for at, frame in groupby(zip(*columns, strict=True), key=lambda r: r[0]):
            if before is not None and at <= before:
                continue
            free = list(held) if before is not None and at - before < self.gap else []
            held = []
            for _, n, *box, name, small in frame:
                if pd.isna(n):
                    continue
                shares = [overlap(old, box) for old in free]
                best = max(range(len(free)), key=shares.__getitem__, default=None)  # the first of equal ones
                old = free.pop(best) if best is not None and shares[best] >= self.least else None
                track, number = (old[5], number) if old else (number, number + 1)
                seen = 0 if name is None else old[6] + 1 if old and old[4] == name else 1
                held.append((*box, name, track, seen))
                out.append((key[0], at, int(n), track, seen, seen >= self.required and not small))
            before = at
        if before is not None:
            self.last.update((number, before))
            self.boxes.put(held) if held else self.boxes.clear()
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer((before + self.gap) // 1000 + 1)
        yield pd.DataFrame(out, columns=["camera", "at", "n", "track", "seen", "confirmed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.boxes.clear()
        yield pd.DataFrame(columns=["camera", "at", "n", "track", "seen", "confirmed"])

    def close(self) -> None:
        pass


def tracked(frames: DataFrame, camera: str, ts_col: str, boxes_col: str, late: str = "0 seconds", least: float = 0.4, gap_ms: int = 1800, required: int = 3) -> DataFrame:
    """(camera, at, n, track, seen, confirmed) of every box of a stream of frames (camera, time, boxes).

    ``boxes`` is an array of (x0, y0, x1, y1, id, small), in the order in which they choose; id is what a box was recognised
    as, or null. A box goes on with the unclaimed box of the camera's last frame that it overlaps most, if by ``least``
    and within ``gap_ms``; otherwise it begins a new track. ``seen`` counts the frames in a row that agree on the id,
    and from ``required`` on a box that isn't small is confirmed. A frame without boxes ends all tracks. Frames that are
    not newer than the camera's last one are passed over, so a replayed frame changes nothing; ``late`` is how far the watermark stays behind.
    Runs on the RocksDB state store (``state.drain(..., rocksdb=True)``).
    """
    kind = frames.schema[camera].dataType.simpleString()
    rows = frames.select(F.col(camera).alias("camera"), F.col(ts_col).cast("timestamp").alias("ts"), F.posexplode_outer(boxes_col).alias("n", "b"))
    flat = rows.withWatermark("ts", late).select("camera", "ts", F.unix_micros("ts").alias("at"), "n", *[F.col(f"b.{c}").cast("double").alias(c) for c in _BOX], F.col("b.id").alias("id"), F.coalesce("b.small", F.lit(False)).alias("small"))
    return flat.groupBy("camera").transformWithStateInPandas(
        statefulProcessor=_Tracker(least, gap_ms * 1000, required),
        outputStructType=f"camera {kind}, at long, n int, track long, seen long, confirmed boolean",
        outputMode="append", timeMode="EventTime",
    )
