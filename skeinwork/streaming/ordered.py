"""State machines over the events of a key in order of time, with deadlines; one machine serves batch and stream.

A machine says what an event does (``step``), when its state ends without one (``due``), and what then
follows (``expire``).  A deadline that lies before or at an event's time comes first.

In batch, events are dealt by key, sorted and streamed through the machine.  In a stream every event waits
in its key's list state until the watermark has passed it; a timer then hands what has become ready to
the machine in order, and another stands for the machine's own deadline.  So the order of arrival changes nothing
as long as events are no later than the watermark allows; later ones are dropped by Spark and found again by
``reconcile``.  What the machine has not ended by the watermark stays state.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any, NamedTuple, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Machine(Protocol):
    """Times are microseconds; a state is None at first and must pickle; ``schema`` is the DDL of what is told."""

    schema: str

    def step(self, state: Any, at: int, row: tuple) -> tuple[Any, list[tuple]]: ...

    def due(self, state: Any) -> int | None: ...

    def expire(self, state: Any, at: int) -> tuple[Any, list[tuple]]: ...


def advance(machine: Machine, state: Any, rows: list[tuple[int, tuple]], upto: int | None) -> tuple[Any, list[tuple]]:
    """State and what is told after ``rows`` (time, row) in order and, if given, after the time ``upto``."""
    out: list[tuple] = []
    for at, row in [*rows, *([(upto, None)] if upto is not None else [])]:
        while (due := machine.due(state)) is not None and due <= at:
            state, told = machine.expire(state, due)
            out += told
        if row is not None:
            state, told = machine.step(state, at, row)
            out += told
    return state, out


def _timed(events: DataFrame, ts: str, columns: list[str]) -> DataFrame:
    return events.select(*columns, F.unix_micros(F.col(ts).cast("timestamp")).alias("at__"))


def run(events: DataFrame, key: str, ts: str, columns: list[str], machine: Machine, upto: int | None = None) -> DataFrame:
    """(key, *told) of a table of events; the machine sees ``columns``, whose first breaks ties of time.  With ``upto``
    (microseconds) only events up to it count, and deadlines up to it pass.  Null times are passed over; a key of any size needs the memory of a batch of rows."""
    kind = dict(events.dtypes)[key]
    timed = _timed(events, ts, [F.col(key).alias("key__"), *columns]).filter("at__ is not null")
    timed = timed if upto is None else timed.filter(F.col("at__") <= upto)
    dealt = timed.repartition("key__").sortWithinPartitions("key__", "at__", columns[0])
    names = [key, *(c.split()[0] for c in machine.schema.split(", "))]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, some = None, None, False
        for batch in batches:
            out = []
            for k, part in batch.groupby("key__", sort=False, dropna=False):
                if some and k != at and not (pd.isna(k) and pd.isna(at)):
                    out += [(at, *x) for x in advance(machine, state, [], upto)[1]]
                    state = None
                at, some = k, True
                state, told = advance(machine, state, list(zip(part["at__"].tolist(), part[columns].itertuples(index=False, name=None))), None)
                out += [(at, *x) for x in told]
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame([(at, *x) for x in advance(machine, state, [], upto)[1]] if some else [], columns=names)

    return dealt.mapInPandas(fold, f"{key} {kind}, {machine.schema}")


class _Waiting(StatefulProcessor):
    """Events of a key that wait for the watermark, and the key's machine."""

    def __init__(self, machine: Machine, key: str, columns: list[str]) -> None:
        self.machine, self.key, self.columns = machine, key, columns

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, event binary")
        self.state = handle.getValueState("state", "state binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for batch in rows:
            batch = batch[batch["at__"].notna()]
            made = [(int(at), pickle.dumps(row)) for at, row in zip(batch["at__"], batch[self.columns].itertuples(index=False, name=None))]
            if made:
                self.held.appendList(made)
                first = min([at for at, _ in made] + ([first] if first is not None else []))
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = [(at, event) for at, event in self.held.get()] if self.held.exists() else []
        ready = sorted((at, pickle.loads(event)) for at, event in held if at <= now)
        rest = [(at, event) for at, event in held if at > now]
        state = pickle.loads(self.state.get()[0]) if self.state.exists() else None
        state, told = advance(self.machine, state, ready, now)
        self.held.clear()
        if rest:
            self.held.put(rest)
        self.state.update((pickle.dumps(state),))
        later = [*(at for at, _ in rest), *([due] if (due := self.machine.due(state)) is not None else [])]
        if later:
            self.handle.registerTimer(-(-min(later) // 1000))
        if told:
            names = [self.key, *(c.split()[0] for c in self.machine.schema.split(", "))]
            yield pd.DataFrame([(key[0], *x) for x in told], columns=names)

    def close(self) -> None:
        pass


def run_stream(events: DataFrame, key: str, ts: str, columns: list[str], machine: Machine, late: str) -> DataFrame:
    """The same of a stream whose events come ``late`` ("10 minutes") at most.

    The session needs the RocksDB state store (``PROVIDER``) while the stream starts.
    """
    kind = dict(events.dtypes)[key]
    timed = events.withColumn("time__", F.col(ts).cast("timestamp")).withWatermark("time__", late).withColumn("at__", F.unix_micros("time__"))
    dealt = timed.select(F.col(key).alias("key__"), *columns, "at__", "time__").groupBy("key__")
    return dealt.transformWithStateInPandas(_Waiting(machine, key, columns), f"{key} {kind}, {machine.schema}", "append", "eventtime")


class Open(NamedTuple):
    began: int
    last: int
    ids: dict


class Collector:
    """Collections of messages (id, target): one begins with a message past the boundary ``after`` and ends at its first
    target, ``total`` seconds after it began, or, unless the target is waited for (``quiet`` None), after ``quiet`` seconds of silence.

    Tells (number, began, closed, reason, n, hit); a message that comes again counts once.
    """

    schema = "number long, began long, closed long, reason string, n long, hit long"

    def __init__(self, quiet: float | None, total: float, after: int | None = None) -> None:
        self.quiet, self.total, self.after = None if quiet is None else int(quiet * 1_000_000), int(total * 1_000_000), after

    def step(self, state: tuple[int, Open | None] | None, at: int, row: tuple) -> tuple[tuple[int, Open | None], list[tuple]]:
        (number, held), (message, target) = state or (0, None), row
        if self.after is not None and message <= self.after:
            return (number, held), []
        held = Open(held.began, at, held.ids) if held else Open(at, at, {})
        held.ids[message] = True
        if target:
            return (number + 1, None), [(number, held.began, at, "target", len(held.ids), message)]
        return (number, held), []

    def due(self, state: tuple[int, Open | None] | None) -> int | None:
        if not state or not state[1]:
            return None
        end = state[1].began + self.total
        return end if self.quiet is None else min(end, state[1].last + self.quiet)

    def expire(self, state: tuple[int, Open], at: int) -> tuple[tuple[int, None], list[tuple]]:
        number, held = state
        silent = self.quiet is not None and held.last + self.quiet <= at
        return (number + 1, None), [(number, held.began, at, "quiet" if silent else "total", len(held.ids), None)]


class Circuit:
    """A circuit of events (id, failed): a failure opens it for ``seconds``, in which events are skipped; then a timer closes it.

    Tells (at, id, said): opened, skipped, passed, or closed with the id of the failure that opened it.
    """

    schema = "at long, id long, said string"

    def __init__(self, seconds: float) -> None:
        self.open_for = int(seconds * 1_000_000)

    def step(self, state: tuple[int, int] | None, at: int, row: tuple) -> tuple[tuple[int, int] | None, list[tuple]]:
        event, failed = row
        if state:
            return state, [(at, event, "skipped")]
        return ((at + self.open_for, event), [(at, event, "opened")]) if failed else (None, [(at, event, "passed")])

    def due(self, state: tuple[int, int] | None) -> int | None:
        return state[0] if state else None

    def expire(self, state: tuple[int, int], at: int) -> tuple[None, list[tuple]]:
        return None, [(at, state[1], "closed")]


def reconcile(waits: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """What a history read again adds to collections that time has closed: (key, n, hit, reopened).

    ``waits`` (key, after, revision): one row a key, the last message known and its revision, perhaps null.  ``history`` (key,
    id, revision, target).  Messages past the known one count; that one itself only if its revision is known and
    has changed, so an old message cannot end a new collection.  ``hit``: the first target, by id; keys to which nothing
    is added have n = 0.
    """
    rows = history.select(key, "id", F.col("revision").alias("now"), "target")
    edited = (F.col("id") == F.col("after")) & F.col("revision").isNotNull() & ~F.col("now").eqNullSafe(F.col("revision"))
    both = waits.join(rows, key, "left").withColumn("counts", F.coalesce((F.col("id") > F.col("after")) | edited, F.lit(False))).withColumn("edited", F.coalesce(edited, F.lit(False)))
    return both.groupBy(key).agg(
        F.count_if("counts").alias("n"), F.min(F.when(F.col("counts") & F.col("target"), F.col("id"))).alias("hit"), F.coalesce(F.bool_or("edited"), F.lit(False)).alias("reopened")
    )
