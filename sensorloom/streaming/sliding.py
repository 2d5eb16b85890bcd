"""Window functions over the newest entries of a growing history, at constant work per entry."""

from __future__ import annotations

from collections.abc import Callable
from math import isnan, nan

from sensorloom.functions.formula import WindowCall
from sensorloom.operators.windows import LOWEST


class Running:
    """An aggregate of the entries from `start` on, in order. Entries come at the end and go at the front.

    The older entries are held as aggregates of what follows them, the newer ones as one aggregate. An entry moves
    from the newer to the older once, so the work per entry is constant, and as nothing is subtracted, NaN and large
    values leave no trace when they go.
    """

    def __init__(self, merge: Callable, start: int):
        self.merge, self.start = merge, start
        self.older: list = []  # the last is the aggregate of all older entries
        self.newer: list = []
        self.of_newer = None

    def push(self, entry) -> None:
        self.newer.append(entry)
        self.of_newer = entry if len(self.newer) == 1 else self.merge(self.of_newer, entry)

    def advance(self, start: int) -> None:
        """Let go what stands before `start`."""
        while self.start < start:
            if not self.older:
                after = None
                for entry in reversed(self.newer):
                    after = entry if after is None else self.merge(entry, after)
                    self.older.append(after)
                self.newer, self.of_newer = [], None
            self.older.pop()
            self.start += 1

    def total(self):
        if not self.older or not self.newer:
            return self.older[-1] if self.older else self.of_newer
        return self.merge(self.older[-1], self.of_newer)


def _number(value: float | None) -> float | None:
    return None if value is None or isnan(value) else value


def _either(pick: Callable) -> Callable:
    return lambda a, b: b if a is None else a if b is None else pick(a, b)


def _added(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def _average(parts: tuple) -> float | None:
    total, nulls, rows = parts
    return None if nulls else total / rows


# Name: what is taken of a value, how two stretches merge, and the result; a null value makes an average null, as in batches.
_AGGREGATES: dict[str, tuple[Callable, Callable, Callable]] = {
    "avg": (lambda v: (v or 0.0, v is None, 1), _added, _average),
    "max": (_number, _either(max), lambda x: LOWEST if x is None else max(x, LOWEST)),
    "min": (_number, _either(min), lambda x: nan if x is None else x),
}

BUILT_IN = {*_AGGREGATES, "rate"}


class Windows:
    """The windows of one sensor over `values`, a list to whose end its readings are added."""

    def __init__(self, values: list[float | None]):
        self.values = values
        self.running: dict[WindowCall, Running] = {}

    def result(self, call: WindowCall, first: int) -> float | None:
        """The result of a built-in window at the newest value; values before the place `first` are too old."""
        n = len(self.values)
        start = max(first, n - call.size)
        if call.size <= 0:
            return {"avg": nan, "max": LOWEST}.get(call.name, 0.0)
        if call.name == "rate":
            oldest, newest = self.values[start], self.values[-1]
            if n - start < 2 or oldest == 0:
                return 0.0
            return None if oldest is None or newest is None else (newest - oldest) / oldest * 100
        take, merge, finish = _AGGREGATES[call.name]
        held = self.running.get(call)
        if held is None:
            held = self.running[call] = Running(merge, start)
        for value in self.values[held.start + len(held.older) + len(held.newer):]:
            held.push(take(value))
        held.advance(start)
        return finish(held.total())
