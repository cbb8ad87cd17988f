"""State kept by key that forgets: bounded buffers and sessions with expiry, as machines for batch and stream."""

from __future__ import annotations

from typing import NamedTuple

# Fixed value: messages that a buffer holds.
HELD = 300


class Buffer:
    """The newest ``most`` events (id) of a key, numbered from 1 in order of time.

    Tells (at, id, seq, left, held): each event's number, the id that it pushes out, if any, and how many are then held.
    """

    schema = "at long, id long, seq long, left long, held long"

    def __init__(self, most: int = HELD) -> None:
        self.most = most

    def step(self, state: tuple[int, tuple] | None, at: int, row: tuple) -> tuple[tuple[int, tuple], list[tuple]]:
        (seq, ids), event = state or (0, ()), row[0]
        left = ids[0] if len(ids) == self.most else None
        ids = (*ids[len(ids) == self.most :], event)
        return (seq + 1, ids), [(at, event, seq + 1, left, len(ids))]

    def due(self, state: tuple[int, tuple] | None) -> None:
        return None

    def expire(self, state: tuple[int, tuple], at: int) -> tuple[tuple[int, tuple], list[tuple]]:
        return state, []


class Session(NamedTuple):
    value: str | None
    until: int
    by: int


class Sessions:
    """A session of a key, stored for a time: events (id, deed, value, seconds) set, get or delete it; others change nothing.

    A later set replaces value and end; one of no or null seconds stores nothing and ends what was there.  A session is gone
    from its end on, the very moment included.  Tells (at, id, said, value): set, hit or miss with the value, deleted,
    and expired with the id of the event that set it.
    """

    schema = "at long, id long, said string, value string"

    def step(self, state: Session | None, at: int, row: tuple) -> tuple[Session | None, list[tuple]]:
        event, deed, value, seconds = row
        if deed == "set":
            lasts = seconds is not None and seconds == seconds and seconds > 0
            return (Session(value, at + int(seconds * 1_000_000), event) if lasts else None), [(at, event, "set", value)]
        if deed == "get":
            return state, [(at, event, "hit", state.value) if state else (at, event, "miss", None)]
        if deed == "delete":
            return None, [(at, event, "deleted", state.value if state else None)]
        return state, []

    def due(self, state: Session | None) -> int | None:
        return state.until if state else None

    def expire(self, state: Session, at: int) -> tuple[None, list[tuple]]:
        return None, [(at, state.by, "expired", state.value)]
