"""The segment windows of lifecycle.segment_windows on a stream of samples and control events.

State for each session's display is its open window; events arrive in order within a display."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lifecycle import WINDOWS, OpenWindow

_STATE = "interval long, start long, count long, last long, sequence long, paused string"
_CONTROLS = {"kind": "string", "cause": "string", "interval": "long"}


def segment_windows(events: DataFrame, interval: int) -> DataFrame:
    """Closed windows as they close; events: a streaming DataFrame (session_id, display_id, id, at) of samples, with kind,
    cause and interval if it holds control events too (kind is null for samples; one row for each display)."""
    events = events.withColumns({c: F.lit(None).cast(t) for c, t in _CONTROLS.items() if c not in events.columns})

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        w = OpenWindow(*(state.get if state.exists else (interval, None, 0, None, 0, None)))
        rows = []
        pdf = pd.concat(list(batches))
        pdf = pdf.assign(late=pdf["kind"].notna()).sort_values(["at", "late", "id"])
        for at, kind, cause, new in pdf[["at", "kind", "cause", "interval"]].itertuples(index=False):
            closed = w.control(int(at), kind, cause, None if pd.isna(new) else int(new)) if isinstance(kind, str) else w.sample(int(at))
            if closed:
                rows.append((*key, *closed))
        state.update((w.interval, w.start, w.count, w.last, w.sequence, w.paused))
        yield pd.DataFrame(rows, columns=["session_id", "display_id", "sequence", "s", "e", "sample_count", "last_sample", "reason"])

    return events.groupBy("session_id", "display_id").applyInPandasWithState(step, WINDOWS, _STATE, "append", GroupStateTimeout.NoTimeout)
