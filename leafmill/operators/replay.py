"""State machines over one key's outcomes in order of time, and how frames run through them.

Their state feeds back on itself, so a key is replayed in order.  In a batch the rows are dealt by key
and sorted within their partition; one pass then carries a single key's state, whatever its length.
Streams keep the same state per key (see ``streaming``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Machine(Protocol):
    """What a replay needs: inputs beside the key, outputs with types, and state as plain values."""

    inputs: tuple[str, ...]
    outputs: tuple[tuple[str, str], ...]
    state: str

    def step(self, *values: Any) -> tuple: ...

    def save(self) -> tuple: ...

    def load(self, saved: tuple) -> None: ...


class FailureWindow:
    """Failure rate of the last ``size`` outcomes, and whether it throttles: ``least`` outcomes at
    least, of which over ``limit`` failed."""

    inputs = ("ok",)
    outputs = (("n", "long"), ("failure_rate", "double"), ("throttled", "boolean"))
    state = "last array<boolean>"

    def __init__(self, size: int = 50, least: int = 10, limit: float = 0.2) -> None:
        self.size, self.least, self.limit = size, least, limit
        self.last: list[bool] = []

    def step(self, ok: bool) -> tuple:
        self.last = [*self.last, bool(ok)][-self.size :]
        n = len(self.last)
        rate = round((n - sum(self.last)) / n, 6)
        return n, rate, n >= self.least and rate > self.limit

    def save(self) -> tuple:
        return (self.last,)

    def load(self, saved: tuple) -> None:
        self.last = list(saved[0])


class Breaker:
    """Circuit breaker: ``failures`` within less than ``window_s`` seconds open it, also while it is
    open, which begins the wait anew; after more than ``open_s`` seconds it is half open, where a failure
    opens it again and ``successes`` close it and forget the failures.  The last ``kept`` failures count."""

    inputs = ("at", "ok")
    outputs = (("state", "string"),)
    state = "mode string, failed array<double>, since double, good int"

    def __init__(self, failures: int = 5, window_s: float = 60.0, open_s: float = 60.0, successes: int = 2, kept: int = 20) -> None:
        self.failures, self.window_s, self.open_s, self.successes, self.kept = failures, window_s, open_s, successes, kept
        self.mode, self.failed, self.since, self.good = "CLOSED", [], 0.0, 0

    def step(self, at: float, ok: bool) -> tuple:
        at = float(at)
        if self.mode == "OPEN" and at - self.since > self.open_s:
            self.mode, self.good = "HALF_OPEN", 0
        if ok:
            if self.mode == "HALF_OPEN":
                self.good += 1
                if self.good >= self.successes:
                    self.mode, self.failed = "CLOSED", []
            return (self.mode,)
        self.failed = [*self.failed, at][-self.kept :]
        if self.mode == "HALF_OPEN" or sum(at - t < self.window_s for t in self.failed) >= self.failures:
            self.mode, self.since = "OPEN", at
        return (self.mode,)

    def save(self) -> tuple:
        return self.mode, self.failed, self.since, self.good

    def load(self, saved: tuple) -> None:
        self.mode, self.failed, self.since, self.good = saved[0], list(saved[1]), saved[2], saved[3]


class Admission:
    """Rate limits of one provider: ``requests`` admitted in the trailing ``seconds`` refuse the next
    one, and so do its tokens where they exceed what is left of ``tokens``.  A request that passes the
    first limit counts against it even if the second refuses it.  Tokens of admitted requests add up
    until ``idle_s`` seconds pass without one."""

    inputs = ("at", "tokens")
    outputs = (("admitted", "boolean"), ("refused_by", "string"))
    state = "held array<double>, spent double, last double"

    def __init__(self, requests: int = 60, seconds: float = 60.0, tokens: float = 100_000, idle_s: float = 120.0) -> None:
        self.requests, self.seconds, self.tokens, self.idle_s = requests, seconds, tokens, idle_s
        self.held, self.spent, self.last = [], 0.0, 0.0

    def step(self, at: float, tokens: float) -> tuple:
        at, tokens = float(at), float(tokens)
        self.held = [t for t in self.held if at - t < self.seconds]
        if len(self.held) >= self.requests:
            return False, "requests"
        self.held.append(at)
        if at - self.last >= self.idle_s:
            self.spent = 0.0
        if tokens > 0 and self.spent + tokens > self.tokens:
            return False, "tokens"
        if tokens > 0:
            self.spent, self.last = self.spent + tokens, at
        return True, None

    def save(self) -> tuple:
        return self.held, self.spent, self.last

    def load(self, saved: tuple) -> None:
        self.held, self.spent, self.last = list(saved[0]), saved[1], saved[2]


_ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def schema_of(machine: type, key: str = "k") -> str:
    return ", ".join(["event_id long", f"{key} long", *(f"{n} {t}" for n, t in machine.outputs)])


def replayed(df: DataFrame, machine: type, **settings: Any) -> DataFrame:
    """``event_id``, ``k`` and the machine's outputs for every row of ``df`` (``event_id``, ``k`` and the
    machine's inputs), each key in order of event_id."""
    kinds = [_ARROW[t] for _, t in machine.outputs]
    names = ["event_id", "k", *(n for n, _ in machine.outputs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live, key = None, None
        for batch in batches:
            keys = batch.column(1).to_pylist()
            inputs = [c.to_pylist() for c in batch.columns[2:]]
            out = []
            for k, *values in zip(keys, *inputs, strict=True):
                if live is None or k != key:
                    live, key = machine(**settings), k
                out.append(live.step(*values))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    # A global key has one partition: its replay is one chain of decisions.
    dealt = df.select(F.col("event_id").cast("long"), F.col("k").cast("long"), *machine.inputs).repartition("k").sortWithinPartitions("k", "event_id")
    return dealt.mapInArrow(run, schema_of(machine))
