"""Keyed folds over events: one step function serves the batch and the stream.

A step takes (state, time in seconds, value) and gives (state, what it says of the event or None).  State
starts as None and must pickle.  In batch, rows are dealt by key, sorted, and streamed through the
step, so a key of any size needs no more memory than a batch of rows; a stream keeps each key's state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from skeinwork.streaming import ordered

Step = Callable[[Any, float, Any], tuple[Any, str | None]]


def cooldown(seconds: float) -> Step:
    """``accepted`` when at least ``seconds`` after the last accepted one."""

    def step(last: float | None, at: float, value: Any) -> tuple[float, str]:
        if last is None or at - last >= seconds:
            return at, "accepted"
        return last, "limited"

    return step


def debounce(seconds: float) -> Step:
    """``active`` at most once in ``seconds``; others say nothing."""
    inner = cooldown(seconds)

    def step(last: float | None, at: float, value: Any) -> tuple[float, str | None]:
        last, said = inner(last, at, value)
        return last, "active" if said == "accepted" else None

    return step


def breaker(seconds: float, failed: Callable[[Any], bool]) -> Step:
    """After a failure the circuit is open, and events ``skipped``, for ``seconds``."""

    def step(until: float | None, at: float, value: Any) -> tuple[float | None, str]:
        if until is not None and at < until:
            return until, "skipped"
        return (at + seconds, "opened") if failed(value) else (None, "passed")

    return step


def pacing(start_ms: float = 1500, least_ms: float = 1100, most_ms: float = 5000, failed: Callable[[Any], bool] = bool) -> Step:
    """The gap to keep: 1.75 times as long after a rate limit, 50 ms less after 500 successes in a row."""

    def step(state: tuple[float, int] | None, at: float, value: Any) -> tuple[tuple[float, int], str]:
        gap, run = state or (start_ms, 0)
        if failed(value):
            gap, run = min(most_ms, gap * 1.75), 0
        else:
            run += 1
            if run % 500 == 0:
                gap = max(least_ms, gap - 50)
        return (gap, run), f"{gap:.0f}"

    return step


def collector(quiet: float, total: float, done: Callable[[list], bool] = lambda values: False) -> Step:
    """Numbers collections of events: one closes after ``quiet`` seconds of silence, ``total`` seconds in all, or
    as soon as what it holds is ``done``."""

    def step(state: tuple | None, at: float, value: Any) -> tuple[tuple, str]:
        number, began, last, held = state or (0, at, at, None)
        if held is None or at - last >= quiet or at - began >= total:
            number, began, held = number + (held is not None), at, []
        held.append(value)
        over = done(held)
        return (number + over, began, at, None if over else held), str(number)

    return step


def coalesce(busy: float) -> Step:
    """``queued``, or ``dropped`` while an equal key is pending or active for ``busy`` seconds."""
    inner = cooldown(busy)

    def step(last: float | None, at: float, value: Any) -> tuple[float, str]:
        last, said = inner(last, at, value)
        return last, "queued" if said == "accepted" else "dropped"

    return step


def _said(rows: pd.DataFrame, ts: str, value: str, step: Step, state: Any) -> tuple[Any, list]:
    out = []
    for at, x in zip(rows[ts], rows[value]):
        state, said = step(state, at.timestamp(), x)
        out.append(said)
    return state, out


def fold(events: DataFrame, key: str, ts: str, value: str, step: Step, tie: str) -> DataFrame:
    """``events`` with ``said``; a key's events in order of ``ts``, then ``tie``."""
    dealt = events.repartition(key).sortWithinPartitions(key, ts, tie)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = object(), None
        for rows in batches:
            out: list = []
            for k, part in rows.groupby(key, sort=False, dropna=False):
                state = state if k == at else None
                at = k
                state, said = _said(part, ts, value, step, state)
                out += said
            yield rows.assign(said=out)

    return dealt.mapInPandas(run, f"{', '.join(f'`{n}` {t}' for n, t in dealt.dtypes)}, said string")


class Fold:
    """A step as a machine of ``ordered``: of events (tie, value) it tells (tie, said)."""

    def __init__(self, step: Step, tie: str, kind: str) -> None:
        self.inner, self.schema = step, f"{tie} {kind}, said string"

    def step(self, state: Any, at: int, row: tuple) -> tuple[Any, list[tuple]]:
        state, said = self.inner(state, at / 1_000_000, row[1])
        return state, [(row[0], said)]

    def due(self, state: Any) -> None:
        return None

    def expire(self, state: Any, at: int) -> tuple[Any, list[tuple]]:
        return state, []


def fold_stream(events: DataFrame, key: str, ts: str, value: str, step: Step, tie: str, late: str = "0 seconds") -> DataFrame:
    """(key, tie, said) of a stream, in order of ``ts``, then ``tie``, whatever the order of arrival within ``late``."""
    return ordered.run_stream(events, key, ts, [tie, value], Fold(step, tie, dict(events.dtypes)[tie]), late)
