"""Sequence checks and event-time reordering of a stream, with state for each symbol.

Rows of a key don't reach a task in the order of arrival, so each micro-batch of a symbol is sorted by
its ``arrival`` columns first. State is the largest sequence, the latest event time, the number of rows
let out and the rows held; what is held is bounded by the window, not by the stream. Late rows are
never dropped. A row of kind ``flush`` lets out all that its symbol holds, as the end of a stream does;
so does a pause of ``idle_ms`` without rows.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.ticks import SCAN_COLUMNS
from tidemark.operators.sequencing import DEFAULT_WINDOW_NS

FLUSH = "flush"
_TYPES = {c: "long" if c.endswith(("_ns", "_ticks")) or c == "sequence" else "string" for c in SCAN_COLUMNS}
OUTPUT = ", ".join([*[f"{c} {t}" for c, t in _TYPES.items()], "reordered boolean, event_type string, expected long, gap_size long, release_no long"])
STATE = "high_water long, latest long, released long, seen long, held string"


class Tracker:
    """One symbol's sequence state and reorder buffer."""

    def __init__(self, window_ns: int, high_water: int = -1, latest: int = -1, released: int = 0, seen: int = 0, held: str = "[]"):
        self.window_ns, self.high_water, self.latest, self.released, self.seen = window_ns, high_water, latest, released, seen
        self.held = [(r[0], r[1], r[2]) for r in json.loads(held)]
        heapq.heapify(self.held)

    def state(self) -> tuple:
        return self.high_water, self.latest, self.released, self.seen, json.dumps(self.held)

    def checked(self, sequence: int) -> tuple[str | None, int | None, int | None]:
        """Event, expected sequence and size of a gap; sequence 0 is not tracked, an equal one passes."""
        event = (None, None, None)
        if sequence == 0:
            return event
        if self.high_water >= 0 and sequence > self.high_water + 1:
            event = ("gap", self.high_water + 1, sequence - self.high_water - 1)
        elif sequence < self.high_water:
            event = ("out_of_order", None, None)
        self.high_water = max(self.high_water, sequence)
        return event

    def push(self, row: list) -> list[list]:
        """Takes a row in; gives what may leave now, by event time and arrival."""
        ts, sequence = row[SCAN_COLUMNS.index("exchange_ts_ns")], row[SCAN_COLUMNS.index("sequence")]
        late = ts < self.latest
        self.latest = max(self.latest, ts)
        heapq.heappush(self.held, (ts, self.seen, [*row, late, *self.checked(sequence)]))
        self.seen += 1
        return self.flush(ts - self.window_ns)

    def flush(self, until: int | None = None) -> list[list]:
        out = []
        while self.held and (until is None or self.held[0][0] <= until):
            out.append([*heapq.heappop(self.held)[2], self.released])
            self.released += 1
        return out


def _frame(rows: list[list]) -> pd.DataFrame:
    names = [x.split()[0] for x in OUTPUT.split(", ")]
    out = pd.DataFrame(rows, columns=names, dtype=object)
    whole = [n for n, t in _TYPES.items() if t == "long"] + ["release_no"]
    out = out.astype(dict.fromkeys(whole, "int64") | dict.fromkeys(("expected", "gap_size"), "Int64"))
    return out.astype({"reordered": "bool"})


def sequenced(ticks: DataFrame, arrival: list[str], window_ns: int = DEFAULT_WINDOW_NS, idle_ms: int | None = None) -> DataFrame:
    """A stream of ticks, reordered within ``window_ns``, with what the sequence check found on each.

    ``release_no`` counts a symbol's rows in the order they leave; a sink sorts by it. ``arrival`` may
    name columns beyond those of a tick."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t = Tracker(window_ns, *(state.get if state.exists else ()))
        out: list[list] = []
        if state.hasTimedOut:
            out = t.flush()
        else:
            got = pd.concat([*batches]).sort_values(arrival, kind="stable")
            kinds = got["kind"].tolist()
            columns = [[None if pd.isna(x) else x for x in got[c].tolist()] for c in SCAN_COLUMNS]
            for kind, *row in zip(kinds, *columns, strict=True):
                out += t.flush() if kind == FLUSH else t.push(row)
        state.update(t.state())
        if idle_ms and t.held:
            state.setTimeoutDuration(idle_ms)
        if out:
            yield _frame(out)

    names = [*SCAN_COLUMNS, *[c for c in arrival if c not in SCAN_COLUMNS]]
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return ticks.select(*names).groupBy("symbol").applyInPandasWithState(run, OUTPUT, STATE, "append", timeout)
