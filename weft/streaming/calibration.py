"""Calibration kept as the state of a stream: a project's last outcomes, its bias and its Brier score.

Every event is a prediction and what came of it: a chance with its outcome (p, y), or a number of impacted
files with the actual one (predicted, actual). For each project the last KEPT events are state, and a
row with the figures after it goes out for every event, in order of ``ord`` within a batch. A
restart goes on from the checkpoint. Batch forms of the figures are ``evaluation.brier`` and
``evaluation.recent_bias``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Events that are kept, of which bias is learned from the last RECENT with an actual number and held within
#: CAP; events that a score or a bias needs at least (fixed values).
KEPT, RECENT, CAP, LEAST = 500, 20, 0.15, 3
EVENT = "ord bigint, p double, y double, predicted double, actual double"
FIGURES = "project string, ord bigint, n_events bigint, n_chances bigint, brier double, bias double"
#: What a stream with state needs of the session.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def figures(events: list[tuple], bias: float) -> tuple[int, int, float | None, float]:
    """(events, chances, Brier score, bias) after the last of events (ord, p, y, predicted, actual), given the
    bias before it."""
    chances = [(p, y) for _, p, y, _, _ in events if p is not None and y is not None]
    brier = sum((p - y) ** 2 for p, y in chances) / len(chances) if len(chances) >= LEAST else None
    if events[-1][4] is not None and len(events) >= LEAST:
        recent = [(a, b) for _, _, _, a, b in events if b is not None][-RECENT:]
        bias = max(-CAP, min(CAP, sum(a - b for a, b in recent) / len(recent) / 100))
    return len(events), len(chances), brier, bias


class Calibration(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getListState("events", EVENT)
        self.bias = handle.getValueState("bias", "bias double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(r) for r in self.events.get()] if self.events.exists() else []
        bias = self.bias.get()[0] if self.bias.exists() else 0.0
        columns = ["ord", "p", "y", "predicted", "actual"]
        new = pd.concat(list(rows))[columns].sort_values("ord", kind="stable")
        out = []
        for event in new.itertuples(index=False):
            held = [*held, (int(event.ord), *(None if pd.isna(x) else float(x) for x in event[1:]))][-KEPT:]
            n, chances, brier, bias = figures(held, bias)
            out.append((key[0], held[-1][0], n, chances, brier, bias))
        self.events.put(held)
        self.bias.update((bias,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FIGURES.split(", ")])

    def close(self) -> None:
        pass


def calibrated(events: DataFrame) -> DataFrame:
    """(project, ord, n_events, n_chances, brier, bias) after every event of a stream (project, ord, p, y, predicted,
    actual). The session needs SETTINGS."""
    return events.groupBy("project").transformWithStateInPandas(Calibration(), FIGURES, "Append", "None")
