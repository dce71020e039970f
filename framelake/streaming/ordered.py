"""State per video for frames that may arrive in any order: smoothing, a ring of hidden states, windows of a number of frames.

Each processor takes a video's frames in the order of idx, from 0 on. A frame
that comes before one it follows waits in state; one that was taken before is left out.
Vectors are arrays of doubles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framelake.operators.temporal import CACHE, OVERLAP, STEP, WINDOW

#: The second of a cache's states is this many frames back, or the first frame before that.
SECOND_BACK = 41
#: step(vector, cached states, oldest first) -> (output, new hidden state)
Step = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


#: Values of idx whose waiting frames are one value of the state, so that a call reads or writes them together.
EARLY = 256


class InOrder(StatefulProcessor):
    """Hands over a video's frames in order; what came early is held in state until its turn."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "idx long, early long")
        self.early = handle.getMapState("early", "block long", "idx array<long>, vector array<array<double>>, at array<long>")

    def due(self, rows: Iterator[pd.DataFrame]) -> list[tuple[int, np.ndarray, int]]:
        """(idx, vector, time in ms) of the frames whose turn has come."""
        idx, waiting = self.next.get() or (0, 0)
        came = {}
        for batch in rows:
            at = batch["at"].tolist() if "at" in batch else [0] * len(batch)
            for i, v, t in zip(batch["idx"].tolist(), batch["vector"], at, strict=True):
                if i >= idx:
                    came.setdefault(i, (np.asarray(v, dtype=float), t))
        blocks, changed = {}, set()

        def block_of(i: int) -> dict[int, tuple]:
            if (block := i // EARLY) not in blocks:
                kept = self.early.getValue((block,)) if any_waits else None
                blocks[block] = {k: (v, t) for k, v, t in zip(*kept, strict=True)} if kept else {}
            return blocks[block]

        # A frame whose turn it is never waits, so that nothing is due unless the next one came.
        any_waits, out = waiting > 0, []
        while idx in came or (out and waiting and idx in block_of(idx)):
            early = block_of(idx).pop(idx, None) if waiting else None
            if early:
                waiting -= 1
                changed.add(idx // EARLY)
            vector, at = came.pop(idx) if idx in came else early
            out.append((idx, np.asarray(vector, dtype=float), at))
            idx += 1
        for i, (vector, at) in came.items():
            waiting += i not in block_of(i)
            block_of(i)[i] = (vector.tolist(), at)
            changed.add(i // EARLY)
        for block in changed:
            if kept := blocks[block]:
                self.early.updateValue((block,), (list(kept), [v for v, _ in kept.values()], [t for _, t in kept.values()]))
            elif any_waits:
                self.early.removeKey((block,))
        self.next.update((idx, waiting))
        return out

    def close(self) -> None:
        pass


class Smoothing(InOrder):
    """Running smoothed value of each video; a video's state is its own."""

    def __init__(self, a: float) -> None:
        self.a = a

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        previous = (self.last.get() or (None,))[0]
        out = []
        for idx, vector, _ in self.due(rows):
            v = float(vector[0])
            previous = v if previous is None or self.a == 0 else self.a * v + (1 - self.a) * previous
            out.append((key[0], idx, previous))
        if out:
            self.last.update((previous,))
            yield pd.DataFrame(out, columns=["video", "idx", "smoothed"])


def smooth_stream(frames: DataFrame, a: float) -> DataFrame:
    """video, idx, smoothed from a stream of (video long, idx long, value double)."""
    given = frames.select("video", "idx", F.array(F.col("value").cast("double")).alias("vector"))
    return given.groupBy("video").transformWithStateInPandas(Smoothing(a), "video long, idx long, smoothed double", "append", "none")


class HiddenStates(InOrder):
    """Ring of hidden states of a temporal model, held as vectors in state.

    A model attends to 31 states: the first two of the ring and its last 29. The first
    frame's state fills the ring 32 times; each later one is appended, and once
    there are more than 42, the second leaves. So the ring keeps the first frame's
    state and the latest 41, where those before the first count as the first.
    """

    SEEDED, KEPT = WINDOW, SECOND_BACK + 1

    def __init__(self, step: Step) -> None:
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.ring = handle.getValueState("ring", "idx array<long>, state array<array<double>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = self.due(rows)
        if not frames:
            return
        ring = [(i, np.asarray(s, dtype=float)) for i, s in zip(*(self.ring.get() or ((), ())), strict=True)]
        out = []
        for idx, vector, _ in frames:
            attended = [*ring[:2], *ring[-(CACHE - 2) :]] if ring else []
            cache = np.array([s for _, s in attended]) if attended else np.empty((0, 0))
            result, state = self.step(vector, cache)
            if ring:
                ring.append((idx, state))
            else:
                ring = [(idx, state)] * self.SEEDED
            if len(ring) > self.KEPT:
                del ring[1]
            out.append((key[0], idx, [i for i, _ in attended], np.asarray(result, dtype=float).tolist()))
        self.ring.update(([i for i, _ in ring], [s.tolist() for _, s in ring]))
        yield pd.DataFrame(out, columns=["video", "idx", "attended", "out"])


def hidden_state_stream(frames: DataFrame, step: Step) -> DataFrame:
    """video, idx, attended, out from a stream of (video long, idx long, vector array<double>).

    ``attended`` are the frames whose states the model saw, in order; ``out`` is what ``step`` returned.
    """
    return frames.select("video", "idx", "vector").groupBy("video").transformWithStateInPandas(HiddenStates(step), "video long, idx long, attended array<long>, out array<double>", "append", "none")


def _no_output(vector: np.ndarray, cache: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.empty(0), np.empty(0)


def attended_stream(frames: DataFrame) -> DataFrame:
    """video, idx, attended: only which frames each frame attends to, from a stream of (video, idx)."""
    given = frames.select("video", "idx", F.array().cast("array<double>").alias("vector"))
    return hidden_state_stream(given, _no_output).select("video", "idx", "attended")


class CountWindows(InOrder):
    """Windows of 32 frames, one every 22, whose first slots are taken over from the window before.

    A window is emitted as soon as its last frame is there. When a video has
    been silent for ``gap_ms`` of event time, its timer pads what is left with the last frame
    and clears its state, frames behind one that never came included; a frame that comes later starts the video anew.
    """

    def __init__(self, gap_ms: int) -> None:
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getValueState("held", "idx array<long>, vector array<array<double>>")
        self.place = handle.getValueState("place", "window long, latest long")

    def _frames(self) -> dict[int, list[float]]:
        return dict(zip(*(self.held.get() or ((), ())), strict=True))

    def _slots(self, window: int, last: int) -> list[int]:
        """The frames of a window's slots; frames after ``last`` repeat it."""
        start = window * STEP
        taken = [0, start - OVERLAP] if window else [0, min(1, last)]
        return [*taken, *(min(start + j, last) for j in range(2, WINDOW))]

    def _rows(self, key, window: int, frames: dict[int, list[float]], last: int) -> list[tuple]:
        return [(key[0], window, slot, f, frames[f]) for slot, f in enumerate(self._slots(window, last))]

    _COLUMNS = ["video", "window", "slot", "frame", "vector"]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        window, latest = self.place.get() or (0, None)
        rows, out, before = list(rows), [], latest
        latest = max([*(int(batch["at"].max()) for batch in rows), *([] if latest is None else [latest])])
        due = self.due(iter(rows))
        frames = self._frames() if due else {}
        for idx, vector, _ in due:
            frames[idx] = vector.tolist()
            if idx == window * STEP + WINDOW - 1:
                out += self._rows(key, window, frames, idx)
                window += 1
                frames = {i: v for i, v in frames.items() if i == 0 or i >= window * STEP - OVERLAP}
        if due:
            self.held.update((list(frames), list(frames.values())))
        if out or latest != before:
            self.place.update((window, latest))
        if before is None:
            self.handle.registerTimer(latest + self.gap_ms)
        if out:
            yield pd.DataFrame(out, columns=self._COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        window, latest = self.place.get()
        # The timer is of the video's first batch; where later frames have put the end off, it is set again.
        if latest + self.gap_ms > max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()):
            self.handle.registerTimer(latest + self.gap_ms)
            return
        frames = self._frames()
        n, waiting = self.next.get()
        out = []
        while window * STEP < n:
            out += self._rows(key, window, frames, n - 1)
            window += 1
        for state in (self.held, self.place, self.next, *([self.early] if waiting else [])):
            state.clear()
        if out:
            yield pd.DataFrame(out, columns=self._COLUMNS)


def window_stream(frames: DataFrame, gap: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """video, window, slot, frame, vector from a stream of (video long, idx long, ts timestamp, vector array<double>).

    The same windows as ``operators.temporal.windows`` gives for whole videos. A
    video ends when the watermark, ``lateness`` behind the latest frame of any video, is ``gap`` after its own latest one.
    """
    gap_ms = int(pd.Timedelta(gap).total_seconds() * 1000)
    given = frames.withWatermark("ts", lateness).select("video", "idx", "vector", "ts", F.unix_millis("ts").alias("at"))
    return given.groupBy("video").transformWithStateInPandas(CountWindows(gap_ms), "video long, window long, slot int, frame long, vector array<double>", "append", "eventTime")
