"""State kept per key by the streaming jobs.

``InOrder`` jobs look at neighbouring rows of a key, so their result must not depend on how rows were cut into batches: arriving
rows are put aside, and when the watermark has passed them - no earlier row can follow - they are released in event order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ORDER = ["ts", "event_id"]


def _packed(frame: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


def _due(times: pd.Series) -> np.ndarray:
    """The watermark, in milliseconds, that has passed each of these times."""
    return -(-times.to_numpy("datetime64[us]").astype(np.int64) // 1000)


class InOrder(StatefulProcessor):
    """Rows of a key in event order, each once, as soon as the watermark has passed them.

    State of a key: rows put aside, and what subclasses keep of the rows released so far.  A row that follows its predecessor
    by more than ``forget_ms`` starts anew, so what is kept can go when the watermark has passed that time, unseen.
    """

    kept: list[T.StructField] = []

    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "first long, last long, rows binary")
        self.state = handle.getValueState("last", T.StructType([T.StructField("due", T.LongType()), *self.kept]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        wake = None
        for frame in rows:
            if len(frame):
                due = _due(frame["ts"])
                self.waiting.appendValue((int(due.min()), int(due.max()), _packed(frame)))
                wake = int(due.min()) if wake is None else min(wake, int(due.min()))
        if wake is not None:
            self.handle.registerTimer(wake)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        ready, later, touched = [], [], False
        for first, last, rows in self.waiting.get():
            if first > mark:
                later.append((first, last, rows))
                continue
            touched = True
            frame = _unpacked(bytes(rows))
            if last > mark:
                due = _due(frame["ts"])
                rest = due > mark
                later.append((int(due[rest].min()), int(last), _packed(frame[rest])))
                frame = frame[~rest]
            ready.append(frame)
        if touched:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        last = self.state.get() if self.state.exists() else None
        due = last[0] if last else None
        if ready:
            frame = pd.concat(ready).sort_values(ORDER, kind="stable").reset_index(drop=True)
            before = last if last is not None and not self._apart(frame["ts"].iloc[:1], due)[0] else None
            out, values = self.fold(key, frame, self._apart(frame["ts"], None), before[1:] if before else None)
            due = int(_due(frame["ts"].iloc[-1:])[0])
            yield out
        if later:
            self.handle.registerTimer(min(first for first, _, _ in later))
        if due is not None and due + self.forget_ms < mark:
            self.state.clear()
        elif ready:
            self.state.update((due, *values))
            if not later:
                self.handle.registerTimer(due + self.forget_ms + 1)

    def _apart(self, times: pd.Series, before: int | None) -> np.ndarray:
        """Which rows follow their predecessor by more than the time to forget; ``before`` is that of the first row."""
        due = _due(times)
        return np.diff(due, prepend=due[0] if before is None else before) > self.forget_ms

    def fold(self, key, rows: pd.DataFrame, apart: np.ndarray, last: tuple | None) -> tuple[pd.DataFrame, tuple]:
        """Output for rows in order and the values to keep; ``last`` is what was kept of the row before, if it counts."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class ChangeNotices(InOrder):
    """A notice when the check state of a listing model differs from the one seen before."""

    kept = [T.StructField("state", T.StringType())]

    def fold(self, key, rows, apart, last):
        states = rows["state"]
        before = states.shift(1).mask(apart)
        before.iloc[0] = last[0] if last else None
        changed = rows[(states != before) & states.isin(["warning", "failed"])]
        out = pd.DataFrame({"listing": key[0], "model": key[1], "event_id": changed["event_id"], "state": changed["state"]})
        return out, (states.iloc[-1],)


class RepeatDetector(InOrder):
    """A warning at the third equal (command, output) in a row and a stop from the sixth."""

    kept = [T.StructField("print", T.StringType()), T.StructField("repeats", T.LongType())]

    def fold(self, key, rows, apart, last):
        prints = rows["print"]
        new = (prints != prints.shift(1)) | apart
        new.iloc[0] = last is None or last[0] != prints.iloc[0]
        island = new.cumsum()
        repeats = rows.groupby(island).cumcount() + 1
        if last is not None:
            repeats = repeats + (island == 0) * int(last[1])
        hit = (repeats == 3) | (repeats >= 6)
        out = pd.DataFrame(
            {
                "run": key[0],
                "event_id": rows["event_id"][hit],
                "repeats": repeats[hit].astype("int64"),
                "action": repeats[hit].ge(6).map({True: "stop", False: "warn"}),
            }
        )
        return out, (prints.iloc[-1], int(repeats.iloc[-1]))


class CounterDelta(InOrder):
    """Growth of a counter since the previous scrape; a falling counter is a reset.  A scrape without a value is passed over."""

    kept = [T.StructField("counter", T.LongType())]

    def fold(self, key, rows, apart, last):
        counter = rows["counter"].astype("Int64")
        start = pd.Series(apart, index=rows.index).cumsum()
        before = counter.groupby(start).transform(lambda c: c.shift(1).ffill())
        if last is not None and last[0] is not None:
            head = (start == 0) & before.isna()
            before = before.mask(head, int(last[0]))
        growth = counter - before
        reset = growth.lt(0).fillna(False)
        out = pd.DataFrame(
            {"source": key[0], "event_id": rows["event_id"], "reset": reset.astype(bool), "delta": growth.mask(reset)}
        )
        seen = counter[start == start.iloc[-1]].dropna()
        carried = last[0] if last is not None and start.iloc[-1] == 0 else None
        return out, (int(seen.iloc[-1]) if len(seen) else carried,)


class LateRows(StatefulProcessor):
    """Rows of a source in arrival order, each marked late if an earlier one was ahead of it by more than the lateness.

    State of a source: the latest event time so far, in microseconds.  Every source has its own clock, so a slow source is not late because
    another one is ahead.
    """

    def __init__(self, late_us: int):
        self.late_us = late_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", "latest long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("event_id", kind="stable")
        at = frame["at_us"].to_numpy(np.int64)
        known = self.state.get()[0] if self.state.exists() else np.iinfo(np.int64).min
        latest = np.maximum.accumulate(np.concatenate([[known], at]))
        self.state.update((int(latest[-1]),))
        # The first row of a source has nothing before it.
        behind = np.where(latest[:-1] == np.iinfo(np.int64).min, 0, latest[:-1] - at)
        yield pd.DataFrame(
            {"source": key[0], "event_id": frame["event_id"], "at_us": at, "late": behind > self.late_us, "behind": np.maximum(behind, 0)}
        )

    def close(self) -> None:
        pass
