"""DET-07 live: predicted boxes wait until their track is detected again.

Per (clip, track) the state holds the frame of the last detection and the boxes predicted since. A
detection within the buffer lets them out, flagged predicted, before the detected box; a later one,
or the end of the buffer on the event-time clock, discards them. So what waits is bounded by the
buffer, and trailing predictions never surface.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "clip string, track_id long, frame long, x1 double, y1 double, x2 double, y2 double, predicted boolean"
STATE = "last long, pending string"


class PendingPredictions:
    """The state machine of one track; rows come in order of frames within a batch."""

    def __init__(self, buffer_frames: int, buffer_ms: int) -> None:
        self.buffer_frames, self.buffer_ms = buffer_frames, buffer_ms

    def step(self, last: int | None, pending: list[list], rows: list[list]) -> tuple[int | None, list[list], list[list]]:
        """rows: [frame, x1, y1, x2, y2, predicted]. Gives the new state and what comes out."""
        out: list[list] = []
        for row in rows:
            frame, predicted = row[0], row[5]
            if last is not None and frame - last > self.buffer_frames:
                pending = []
                if predicted:
                    continue
            if predicted:
                if last is not None:
                    pending.append(row)
                continue
            out += pending + [row]
            last, pending = frame, []
        return last, pending, out

    def __call__(self, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import json

        if state.hasTimedOut:
            state.remove()
            return
        last, pending = state.get if state.exists else (None, "[]")
        got = pd.concat(list(frames)).sort_values("frame")
        rows = got[["frame", "x1", "y1", "x2", "y2", "predicted"]].astype(object).values.tolist()
        last, waiting, out = self.step(None if last is None or last < 0 else last, json.loads(pending), [[int(r[0]), *map(float, r[1:5]), bool(r[5])] for r in rows])
        state.update((-1 if last is None else last, json.dumps(waiting)))
        now = max(state.getCurrentWatermarkMs(), int(got["at"].max().timestamp() * 1000))
        state.setTimeoutTimestamp(now + self.buffer_ms)
        if out:
            yield pd.DataFrame([[*key, *r] for r in out], columns=["clip", "track_id", "frame", "x1", "y1", "x2", "y2", "predicted"])


def bridge_live(boxes: DataFrame, buffer_frames: int, buffer_s: float = 60.0, late: str = "1 minute") -> DataFrame:
    """boxes: clip, track_id, frame, x1, y1, x2, y2, predicted, at (event time), streaming."""
    machine = PendingPredictions(buffer_frames, int(buffer_s * 1000))
    keyed = boxes.withWatermark("at", late).groupBy("clip", "track_id")
    return keyed.applyInPandasWithState(machine, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
