"""Steps of trainings and evaluations folded on a stream, in a state store keyed by record."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from crewlens.streaming.changes import STEPS


class StatusProcessor(StatefulProcessor):
    """Keeps each record's latest status; with ``keep_ms``, one that rests so long is forgotten."""

    def __init__(self, keep_ms: int | None = None) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("status", "status string, ts timestamp, step int", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = self.state.get() if self.state.exists() else None
        for pdf in rows:
            for status, ts in zip(pdf["status"], pdf["ts"], strict=True):
                step = STEPS.get(status, 0)
                if best is None or (pd.Timestamp(ts), step) >= (pd.Timestamp(best[1]), best[2]):
                    best = (status, pd.Timestamp(ts).to_pydatetime(), step)
        self.state.update(best)
        yield pd.DataFrame({"training_id": [key[0]], "status": [best[0]], "ts": [best[1]]})

    def close(self) -> None:
        pass


def fold_status_stream(events: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """A stream of each changed record's latest status. events: training_id, status, ts (timestamp).

    State that is to end (keep_ms) needs processing time, whose queries run until they are stopped.
    """
    mode = "None" if keep_ms is None else "ProcessingTime"
    return events.groupBy("training_id").transformWithStateInPandas(StatusProcessor(keep_ms), "training_id long, status string, ts timestamp", "Update", mode)


class EvaluationProcessor(StatefulProcessor):
    """Pending, then scored once by the first score at or after it, whatever the order in which events come.

    Scores before the first pending known are kept, as an earlier pending may still come.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("evaluation", "pending_at timestamp, scored_at timestamp, score double")
        self.early = handle.getListState("early", "ts timestamp, score double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pending, scored, score = self.state.get() if self.state.exists() else (None, None, None)
        waiting = [tuple(r) for r in self.early.get()]
        for pdf in rows:
            for status, ts, value in zip(pdf["status"], pdf["ts"], pdf["score"], strict=True):
                at = pd.Timestamp(ts).to_pydatetime()
                if status == "pending":
                    pending = at if pending is None else min(pending, at)
                elif status == "scored":
                    waiting.append((at, None if pd.isna(value) else float(value)))
        left = []
        for at, value in waiting:
            if pending is None or at < pending:
                left.append((at, value))
            elif scored is None or at < scored:
                scored, score = at, value
        self.early.put(left) if left else self.early.clear()
        self.state.update((pending, scored, score))
        if pending is not None:
            yield pd.DataFrame({"record_id": [key[0]], "status": ["pending" if scored is None else "scored"], "score": pd.Series([score], dtype=float), "pending_at": [pending], "scored_at": pd.Series([scored], dtype="datetime64[us]")})

    def close(self) -> None:
        pass


def fold_evaluation_stream(events: DataFrame) -> DataFrame:
    """A stream of each changed record's evaluation. events: record_id, status, score (double), ts (timestamp)."""
    schema = "record_id long, status string, score double, pending_at timestamp, scored_at timestamp"
    return events.groupBy("record_id").transformWithStateInPandas(EvaluationProcessor(), schema, "Update", "None")
