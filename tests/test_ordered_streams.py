"""State per video: streams against replays in plain Python, frames shuffled over files, across restarts."""

import datetime
import math
import random

import numpy as np
import pandas as pd
import pytest

from framelake.operators import temporal as tp
from framelake.streaming import hidden_state_stream, run_once, smooth_stream, window_stream

T0 = datetime.datetime(2024, 1, 1)


def recurrent():
    """A model whose memory depends on all it saw; made here, so that it goes to workers by value."""

    def step(vector, cache):
        seen = cache.mean(axis=0) if len(cache) else np.zeros(2)
        state = np.array([0.5 * vector[0] + 0.5 * seen[0], len(cache) + seen[1] / 2])
        return np.array([vector[0] - seen[0], *state]), state

    return step


def replay(values, step):
    """(attended, output) of each frame, from a list of states as long as it gets, its second dropped when it has 43."""
    cache, ids, out = [], [], []
    for i, v in enumerate(values):
        at = [*ids[:2], *ids[-29:]] if cache else []
        result, state = step(np.array([v]), np.array([*cache[:2], *cache[-29:]]) if cache else np.empty((0, 0)))
        cache, ids = (cache + [state], ids + [i]) if cache else ([state] * 32, [i] * 32)
        if len(cache) == 43:
            del cache[1], ids[1]
        out.append((at, result))
    return out


def videos(seed=3, lengths=(1, 2, 33, 70)):
    rng = random.Random(seed)
    return {k: [rng.uniform(-5, 5) for _ in range(n)] for k, n in enumerate(lengths)}


def in_files(spark, folder, rows, schema, files, seed):
    """Rows dealt over files at random, one file at a time, so micro-batches get them in no order."""
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    for k in range(files):
        spark.createDataFrame(rows[k::files], schema).coalesce(1).write.mode("append").parquet(folder)


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_hidden_states_equal_a_replay_across_restarts(spark, tmp_path):
    schema = "video long, idx long, vector array<double>"
    values = videos()
    rows = [(k, i, [v]) for k, vs in values.items() for i, v in enumerate(vs)]
    random.Random(1).shuffle(rows)
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for part in (rows[:40], rows[40:] + rows[:5]):  # two runs on one checkpoint; some frames come twice
        in_files(spark, folder, part, schema, 3, 2)
        run_once(hidden_state_stream(stream_of(spark, folder, schema), recurrent()), out, state)
    got = {(r.video, r.idx): r for r in spark.read.parquet(out).collect()}
    assert len(got) == len(rows) == spark.read.parquet(out).count()
    for k, vs in values.items():
        for i, (attended, result) in enumerate(replay(vs, recurrent())):
            assert got[k, i].attended == attended and np.allclose(got[k, i].out, result, rtol=1e-12), (k, i)


def test_smoothing_takes_frames_in_order(spark, tmp_path):
    schema = "video long, idx long, value double"
    values = videos(5, (40, 3))
    folder = str(tmp_path / "in")
    in_files(spark, folder, [(k, i, v) for k, vs in values.items() for i, v in enumerate(vs)], schema, 5, 4)
    run_once(smooth_stream(stream_of(spark, folder, schema), 0.75), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r.video, r.idx): r.smoothed for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    for k, vs in values.items():
        last = None
        for i, v in enumerate(vs):
            last = v if last is None else 0.75 * v + 0.25 * last
            assert math.isclose(got[k, i], last, rel_tol=1e-12)


def test_windows_on_a_stream(spark, tmp_path):
    schema = "video long, idx long, ts timestamp, vector array<double>"
    lengths = (1, 21, 22, 23, 31, 32, 33, 54, 55, 100)
    values = videos(7, lengths)
    rows = [(k, i, T0 + datetime.timedelta(minutes=i), [v]) for k, vs in values.items() for i, v in enumerate(vs)]
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    in_files(spark, folder, rows, schema, 4, 6)
    run_once(window_stream(stream_of(spark, folder, schema), "1 hour", "10 hours"), out, state)
    before = spark.read.parquet(out).filter("window = 0").select("video").distinct().count()
    assert before == sum(n >= 32 for n in lengths)  # no video has ended yet
    # A frame of another video moves the watermark on, so timers fire: after a restart.
    in_files(spark, folder, [(99, 0, T0 + datetime.timedelta(days=9), [0.0])], schema, 1, 0)
    run_once(window_stream(stream_of(spark, folder, schema), "1 hour", "10 hours"), out, state)
    got = sorted((r.video, r.window, r.slot, r.frame) for r in spark.read.parquet(out).filter("video < 99").collect())
    want = tp.windows(spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "video long, n long")).collect()
    assert got == sorted((r.video, r.window, r.slot, r.frame) for r in want)
    for r in spark.read.parquet(out).filter("video < 99").collect():
        assert r.vector == [values[r.video][r.frame]]


@pytest.mark.parametrize("a", [0.0, 0.3, 1.0])
def test_blocks_of_smoothing_meet(spark, a):
    rng = random.Random(8)
    rows = [(k, i * 3 + 1, rng.uniform(-9, 9)) for k, n in ((1, 1), (2, 700), (None, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "video long, idx long, value double").repartition(3)
    want = {(r.video, r.idx): r.smoothed for r in tp.ema_long(df, a).collect()}
    for block in (1, 16, 4096):
        got = {(r.video, r.idx): r.smoothed for r in tp.ema(df, a, block=block).collect()}
        assert got == pytest.approx(want, rel=1e-12)


class Kept:
    """State of one video that counts the calls to it."""

    def __init__(self, calls):
        self.calls, self.held = calls, {}

    def __getattr__(self, name):
        def call(*given):
            self.calls.append(name)
            if name in ("get", "getValue"):
                return self.held.get(given)
            if name in ("exists", "containsKey"):
                return given in self.held
            if name in ("removeKey", "clear"):
                self.held.pop(given, None)
            else:
                self.held[given[:-1]] = given[-1]

        return call


class Handle:
    def __init__(self):
        self.calls, self.timers = [], []
        self.getValueState = self.getMapState = self.getListState = lambda *_: Kept(self.calls)
        self.registerTimer = self.timers.append


def test_state_is_read_and_written_in_blocks_of_frames():
    """Frames of 600 in three shuffled batches: a few calls a block and batch, none for each frame."""
    from framelake.streaming.ordered import Smoothing

    handle, order = Handle(), np.random.default_rng(3).permutation(600)
    processor = Smoothing(0.5)
    processor.init(handle)
    out = []
    for part in np.array_split(np.concatenate([order, order[:50]]), 3):
        rows = pd.DataFrame({"idx": part, "vector": [[float(i)] for i in part], "at": part * 10})
        out += [(i, v.tolist(), at) for i, v, at in processor.due(iter([rows]))]
    assert out == [(i, [float(i)], i * 10) for i in range(600)]
    assert len(handle.calls) <= 3 * (2 + 2 * 3)


def test_a_window_timer_is_moved_only_where_it_expires():
    from types import SimpleNamespace

    from framelake.streaming.ordered import CountWindows

    handle, processor = Handle(), CountWindows(1000)
    processor.init(handle)
    for i in (0, 1, 2):
        assert not list(processor.handleInputRows((5,), iter([pd.DataFrame({"idx": [i], "vector": [[float(i)]], "at": [i * 500]})]), None))
    assert handle.timers == [1000]
    expire = lambda at, mark: list(processor.handleExpiredTimer((5,), SimpleNamespace(getCurrentWatermarkInMs=lambda: mark), SimpleNamespace(getExpiryTimeInMs=lambda: at)))
    assert expire(1000, 1500) == [] and handle.timers == [1000, 2000]
    [padded] = expire(2000, 2100)
    assert len(padded) == 32 and padded["frame"].max() == 2
