"""Recordings and jobs followed while they run, with Structured Streaming."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rigtables.operators.jobs import TERMINAL_STATES, trial_lifecycle
from rigtables.operators.stage import latest_position
from rigtables.sources.readers import SIDECAR, recording_of

FIRST_WINDOW_S, WINDOW_S, HEARTBEAT_TIMEOUT_S, IDLE_S = 2, 60, 120, 86_400
#: States that sessions share (a stream goes on from a checkpoint with the same number alone); saves waiting there that are read and written at once; stands for a session that is null.
SHELVES, BLOCK, NO_SESSION = 512, 16_384, -(1 << 63)


def stream_frame_metadata(spark: SparkSession, glob: str, depth: int = 2, files: int = 10_000) -> DataFrame:
    """Sidecar rows as their files arrive, `files` a trigger at most."""
    raw = spark.readStream.schema(SIDECAR).option("header", True).option("maxFilesPerTrigger", files).csv(glob)
    return raw.select(recording_of(F.col("_metadata.file_path"), depth).alias("recording_id"), *raw.columns)


def write_stream(df: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Append to Parquet; with `once` what is there now is worked off and the query ends."""
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def saver_perf_grid(saves: DataFrame, seconds: int = WINDOW_S, late: str = "10 minutes") -> DataFrame:
    """Mean save time (whole us) and queue length in windows of a fixed grid; saves: (session, at, save_us, queue_length)."""
    windows = saves.withWatermark("at", late) if saves.isStreaming else saves
    got = windows.groupBy("session", F.window("at", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"), F.expr("sum(save_us) div count(*)").alias("mean_save_us"), F.avg("queue_length").alias("mean_queue_length"))
    return got.select("session", F.col("w.start").alias("window_start"), "n", "mean_save_us", "mean_queue_length")


def _set_timer(handle: StatefulProcessorHandle, at_ms: int | None) -> None:
    """The key's one timer is at at_ms, or there is none."""
    set_ = list(handle.listTimers())
    for t in set_:
        if t != at_ms:
            handle.deleteTimer(t)
    if at_ms is not None and at_ms not in set_:
        handle.registerTimer(at_ms)


SAVES, SESSIONS = ["at_us", "save_us", "queue_length", "session"], ["session", "start_us", "first", "n", "save_us", "queue", "last_us", "waiting"]


class SaverWindows(StatefulProcessor):
    """Windows that restart at the save which closes them: 2 s first, then 60 s; that save is still counted.

    Sessions share one of SHELVES states, so that a batch asks for few. Saves wait there until the watermark has passed them, and then count
    in the order of their time, duration and queue, whichever batch brought them. They wait in blocks of up to `block`, from a block's least
    time to that of the next one (more only where they are of one time), so that those of a long session are not held as a whole.
    A session of which nothing came for IDLE_S is forgotten.
    """

    def __init__(self, block: int) -> None:
        self.block = block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kinds = ", ".join(f"{c} array<{'boolean' if c == 'first' else 'long'}>" for c in SESSIONS)
        self.shelf = handle.getValueState("shelf", f"timer_ms long, blocks array<long>, least array<long>, {kinds}")
        self.waiting = handle.getMapState("waiting", "block long", ", ".join(f"{c} array<long>" for c in SAVES))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, blocks, least, sessions = self._state()
        for part in rows:
            saves = part[SAVES].to_numpy(np.int64)
            for name, n in zip(*(x.tolist() for x in np.unique(saves[:, 3], return_counts=True)), strict=True):
                sessions.setdefault(name, [None, True, 0, 0, 0, None, 0])[-1] += n
            self._wait(saves, blocks, least)
        yield from self._release(timerValues.getCurrentWatermarkInMs(), timer, blocks, least, sessions)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, blocks, least, sessions = self._state()  # the timer goes by itself
        yield from self._release(timerValues.getCurrentWatermarkInMs(), None, blocks, least, sessions)

    def _state(self) -> tuple[int | None, list[int], list[int], dict[int, list]]:
        """(timer, names of blocks, their least times, what is known of each session: the columns of SESSIONS after its name)."""
        have = self.shelf.get()
        if have is None:
            return None, [], [], {}
        return have[0], list(have[1]), list(have[2]), {name: known for name, *known in map(list, zip(*have[3:], strict=True))}

    def _wait(self, saves: np.ndarray, blocks: list[int], least: list[int]) -> None:
        """The saves (rows of SAVES) into the blocks, which are in order of time; one that grows too large is cut."""
        old = len(blocks) > 0
        if not old:
            blocks.append(0)
            least.append(int(saves[:, 0].min()))
        at = np.maximum(np.searchsorted(least, saves[:, 0], side="right") - 1, 0)
        for k in sorted(set(at.tolist()), reverse=True):  # from the last, so that the places of those to come stay
            some = saves[at == k]
            if old:
                some = np.concatenate([np.array(self.waiting.getValue((blocks[k],)), np.int64).T, some])
            pieces = [some]
            if len(some) > self.block:
                some = some[np.argsort(some[:, 0], kind="stable")]
                first = np.searchsorted(some[:, 0], some[:: self.block // 2, 0])  # saves of one time stay together
                pieces = np.split(some, np.unique(first)[1:])
            names = [blocks[k], *range(max(blocks) + 1, max(blocks) + len(pieces))]
            blocks[k : k + 1], least[k : k + 1] = names, [int(p[:, 0].min()) for p in pieces]
            for name, piece in zip(names, pieces, strict=True):
                self.waiting.updateValue((name,), tuple(piece.T.tolist()))

    def _release(self, watermark_ms: int, timer: int | None, blocks: list[int], least: list[int], sessions: dict[int, list]) -> Iterator[pd.DataFrame]:
        upto = watermark_ms * 1000
        while blocks and least[0] <= upto:
            saves = sorted(zip(*self.waiting.getValue((blocks[0],)), strict=True))
            out, n_passed = [], bisect_right(saves, upto, key=lambda x: x[0])
            for at, took, length, name in saves[:n_passed]:
                start, first, n, save, queue, _, waiting = sessions[name]
                start = at if start is None else start
                n, save, queue = n + 1, save + took, queue + length
                if at - start >= (FIRST_WINDOW_S if first else WINDOW_S) * 1_000_000:
                    out.append((name, start, at, n, save // n, queue / n))
                    start, first, n, save, queue = at, False, 0, 0, 0
                sessions[name] = [start, first, n, save, queue, at, waiting - 1]
            if out:
                yield pd.DataFrame(out, columns=WINDOWS)
            left = saves[n_passed:]
            if left:
                self.waiting.updateValue((blocks[0],), tuple(map(list, zip(*left, strict=True))))
                least[0] = left[0][0]
                break
            self.waiting.removeKey((blocks.pop(0),))
            least.pop(0)
        idle = {name: x[5] // 1000 + IDLE_S * 1000 for name, x in sessions.items() if not x[6]}
        for name in [name for name, ms in idle.items() if ms <= watermark_ms]:
            del sessions[name], idle[name]
        next_ = min([*idle.values(), *(-(-x // 1000) for x in least[:1])], default=None)
        if timer != next_:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if next_ is not None:
                self.handle.registerTimer(next_)
        if sessions:
            self.shelf.update((next_, blocks, least, *map(list, zip(*((name, *x) for name, x in sessions.items()), strict=True))))
        else:
            self.shelf.clear()

    def close(self) -> None:
        pass


WINDOWS = ["session", "start_us", "end_us", "n", "mean_save_us", "mean_queue_length"]


def saver_perf_windows(saves: DataFrame, late: str = "10 seconds") -> DataFrame:
    """(session, start_us, end_us, n, mean_save_us, mean_queue_length); saves: (session long, at_us, save_us, queue_length), a stream.

    A save may come up to `late` after later ones, in any batch; what comes later still is left out. Saves are counted once the
    watermark has passed them, so a session's last ones wait until any session goes on.
    """
    named = saves.where("at_us IS NOT NULL").withColumns({"at": F.timestamp_micros("at_us"), "session": F.coalesce("session", F.lit(NO_SESSION))})
    timed = named.withColumn("shelf", F.pmod(F.xxhash64("session"), F.lit(SHELVES))).withWatermark("at", late)
    out = "session long, start_us long, end_us long, n long, mean_save_us long, mean_queue_length double"
    made = timed.groupBy("shelf").transformWithStateInPandas(SaverWindows(BLOCK), outputStructType=out, outputMode="Append", timeMode="EventTime")
    return made.withColumn("session", F.nullif("session", F.lit(NO_SESSION)))


class Heartbeats(StatefulProcessor):
    """Names a job once its last beat is older than the timeout; a new beat sets it going again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(part["at_ms"].max()) for part in rows)
        if self.last.exists():
            newest = max(newest, self.last.get()[0])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.last.update((newest,))
        self.handle.registerTimer(newest + HEARTBEAT_TIMEOUT_S * 1000)
        yield pd.DataFrame({"job_id": [], "last_beat_ms": []})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"job_id": [key[0]], "last_beat_ms": [last]})

    def close(self) -> None:
        pass


def heartbeat_timeouts(beats: DataFrame, late: str = "1 minute") -> DataFrame:
    """(job_id long, last_beat_ms) of jobs that fell silent; beats: (job_id long, at timestamp)."""
    timed = beats.select("job_id", "at", F.unix_millis("at").alias("at_ms")).withWatermark("at", late)
    return timed.groupBy("job_id").transformWithStateInPandas(Heartbeats(), outputStructType="job_id long, last_beat_ms long", outputMode="Append", timeMode="EventTime")


def trial_lifecycle_updates(events: DataFrame) -> DataFrame:
    """The state of each trial, kept up to date (output mode update): the first terminal state stands, else the latest."""
    return trial_lifecycle(events)


def latest_stage_position(log: DataFrame) -> DataFrame:
    """The last stage sample of each recording, kept up to date (output mode update)."""
    return latest_position(log)


class PartialGroups(StatefulProcessor):
    """Frames of a recording in groups of three: a full group leaves with its third frame, a partial one at the end or when it is quiet."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "frame_ids array<long>, last_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames, last = self.open.get() if self.open.exists() else ([], 0)
        groups: dict[int, set[int]] = {}
        for f in frames:
            groups.setdefault(f // 3, set()).add(f)
        ended = False
        for part in rows:
            out = []
            last = max(last, int(part["at_ms"].max()))
            ended |= bool(part["ended"].any())
            for f in part["frame_id"].dropna().astype("int64").tolist():
                one = groups.setdefault(f // 3, set())
                one.add(f)
                if len(one) == 3:
                    out.append((key[0], f // 3, 3, sorted(groups.pop(f // 3)), "full"))
            yield _groups(out)
        if ended:
            yield self._flush(key, groups, "ended")
            return
        self.open.update((sorted(f for one in groups.values() for f in one), last))
        _set_timer(self.handle, last + self.quiet_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        frames, _ = self.open.get() if self.open.exists() else ([], 0)
        groups: dict[int, set[int]] = {}
        for f in frames:
            groups.setdefault(f // 3, set()).add(f)
        yield self._flush(key, groups, "quiet")

    def _flush(self, key, groups: dict[int, set[int]], why: str) -> pd.DataFrame:
        self.open.clear()
        _set_timer(self.handle, None)
        return _groups([(key[0], g, len(f), sorted(f), why) for g, f in sorted(groups.items())])

    def close(self) -> None:
        pass


def _groups(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["recording_id", "group_id", "num_valid", "frame_ids", "why"])


def stream_partial_groups(frames: DataFrame, late: str = "10 seconds", quiet_s: float = 60) -> DataFrame:
    """(recording_id, group_id, num_valid, frame_ids, why): groups of three by id, from a stream (recording_id long, frame_id, at, [ended]).

    A group leaves as soon as its third frame is there (`full`). What is partial leaves when a row of the recording says `ended`
    (its frame_id may be null), or once the watermark is `quiet_s` past the recording's last frame. Frames of a batch may come in any
    order, and a frame that comes twice while its group is open counts once. A frame that comes after its group has left makes a
    partial group of its own, which leaves in the same way; one that is behind the watermark (`late` after the latest frame of any
    recording) is left out. The state holds open groups alone.
    """
    marked = frames if "ended" in frames.columns else frames.withColumn("ended", F.lit(False))
    timed = marked.select("recording_id", "frame_id", "at", F.unix_millis("at").alias("at_ms"), F.coalesce("ended", F.lit(False)).alias("ended")).withWatermark("at", late)
    out = "recording_id long, group_id long, num_valid long, frame_ids array<long>, why string"
    return timed.groupBy("recording_id").transformWithStateInPandas(PartialGroups(int(quiet_s * 1000)), outputStructType=out, outputMode="Append", timeMode="EventTime")


class LiveJobs(StatefulProcessor):
    """The trials of a job while it runs; a job that is aborted or falls silent takes its open trials with it."""

    def __init__(self, idle_s: int):
        self.idle_s = idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "beat_ms long, last_ms long, gone string")
        self.open = handle.getMapState("open", "trial_id long", "status string")
        self.done = handle.getMapState("done", "trial_id long", "status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        beat, last, gone = self.job.get() if self.job.exists() else (None, 0, None)
        # a batch's events of one job count in the order of their time; equal ones as they are numbered
        events = pd.concat(list(rows)).sort_values(["at_us", "event_id"])
        out = []
        for at, kind, trial, status in zip(events["at_us"], events["kind"], events["trial_id"], events["status"], strict=True):
            now = int(at) // 1000
            last = max(last, now)
            if kind == "beat":
                beat = max(beat or 0, now)
            elif kind == "abort":
                gone = gone or "aborted"
                out += self._fail(key, gone)
            elif kind == "trial" and not self.done.containsKey((int(trial),)):
                trial = int(trial)
                if status in TERMINAL_STATES or gone:
                    out.append((key[0], trial, status if status in TERMINAL_STATES else "failed", "own" if status in TERMINAL_STATES else gone))
                    self.done.updateValue((trial,), (out[-1][2],))
                    if self.open.containsKey((trial,)):
                        self.open.removeKey((trial,))
                else:
                    self.open.updateValue((trial,), (status,))
        self.job.update((beat, last, gone))
        _set_timer(self.handle, last + self.idle_s * 1000 if gone or beat is None else beat + HEARTBEAT_TIMEOUT_S * 1000 + 1)
        yield pd.DataFrame(out, columns=TRIALS)

    def _fail(self, key, why: str) -> list[tuple]:
        """Every open trial has failed."""
        failed = [(key[0], trial, "failed", why) for (trial,) in sorted(self.open.keys())]
        for _, trial, status, _ in failed:
            self.done.updateValue((trial,), (status,))
        self.open.clear()
        return failed

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        beat, last, gone = self.job.get() if self.job.exists() else (None, 0, None)
        if gone is None and beat is not None:
            self.job.update((beat, last, "silent"))
            _set_timer(self.handle, max(last, beat + HEARTBEAT_TIMEOUT_S * 1000) + self.idle_s * 1000)
            yield pd.DataFrame(self._fail(key, "silent"), columns=TRIALS)
            return
        for state in (self.job, self.open, self.done):
            state.clear()
        _set_timer(self.handle, None)
        yield pd.DataFrame([], columns=TRIALS)

    def close(self) -> None:
        pass


TRIALS = ["job_id", "trial_id", "status", "why"]


def live_jobs(events: DataFrame, late: str = "1 minute", idle_s: int = IDLE_S) -> DataFrame:
    """(job_id, trial_id, status, why): each trial once, as it ends; events: (job_id long, kind, trial_id, status, at, event_id), a stream.

    kind is `trial` (with trial_id and status), `beat` or `abort`. The first terminal status of a trial stands (why: `own`). An abort
    fails all open trials of its job (`aborted`); so does a last beat that is more than HEARTBEAT_TIMEOUT_S behind the watermark
    (`silent`). Trials that a job still reports after that fail at once, if they are not at an end. A job without any beat is never
    silent. Of jobs that are over, or never beat, the state is dropped `idle_s` after their last event.
    """
    timed = events.select("job_id", "kind", "trial_id", "status", "at", F.unix_micros("at").alias("at_us"), "event_id").withWatermark("at", late)
    out = "job_id long, trial_id long, status string, why string"
    return timed.groupBy("job_id").transformWithStateInPandas(LiveJobs(idle_s), outputStructType=out, outputMode="Append", timeMode="EventTime")
