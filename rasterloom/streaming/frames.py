"""Frames as a stream: each animation's canvas is the state, every frame that arrives gives the whole canvas after it.

Rows are (anim, k, x0, y0, w, h, v, dispose) as in rasterloom.operators.animation, with frames of one animation in order of k. A
frame that comes after a later one was drawn is late and is dropped, but counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "anim long, k long, total long, mark long, late long"
STATE = "canvas binary, k long, x0 long, y0 long, w long, h long, late long"


def drawn(canvas: np.ndarray, last: tuple | None, frame) -> tuple[np.ndarray, tuple | None]:
    """The canvas after a frame, and the rectangle to clear before the next one."""
    if last:
        x, y, w, h = last
        canvas[y : y + h, x : x + w] = 0
    canvas[frame.y0 : frame.y0 + frame.h, frame.x0 : frame.x0 + frame.w] = frame.v
    return canvas, (frame.x0, frame.y0, frame.w, frame.h) if frame.dispose else None


def canvases(frames: DataFrame, width: int, height: int) -> DataFrame:
    """A row for each frame: the sum of its canvas, a sum weighted by place, and how many frames came too late so far."""
    weight = (np.arange(width)[None, :] + 16 * np.arange(height)[:, None] + 1).astype(np.int64)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            raw, k, x, y, w, h, late = state.get
            canvas, last = np.frombuffer(raw, np.int64).reshape(height, width).copy(), (x, y, w, h) if w else None
        else:
            canvas, last, k, late = np.zeros((height, width), np.int64), None, -1, 0
        out = []
        for f in pd.concat(list(batches)).sort_values("k").itertuples():
            if f.k <= k:
                late += 1
                continue
            canvas, last = drawn(canvas, last, f)
            k = f.k
            out.append((key[0], k, int(canvas.sum()), int((canvas * weight).sum()), late))
        x, y, w, h = last or (0, 0, 0, 0)
        state.update((canvas.tobytes(), int(k), int(x), int(y), int(w), int(h), int(late)))
        yield pd.DataFrame(out, columns=["anim", "k", "total", "mark", "late"])

    return frames.groupBy("anim").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
