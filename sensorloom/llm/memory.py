"""What a Python worker remembers from one batch to the next."""

from __future__ import annotations

from collections.abc import Callable


class Memory:
    """Results by text, in two generations: when the younger is full, the older goes, and what is used again stays.

    `make` gives the results of a list of new texts, `weigh` the bytes of a result; about `most` bytes are held, besides
    what one call needs.
    """

    def __init__(self, make: Callable[[list[str]], list], weigh: Callable[[object], int], most: Callable[[], int]):
        self.make, self.weigh, self.most = make, weigh, most
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}
        self.size = 0

    def of(self, texts: set[str]) -> dict[str, object]:
        """A table that holds the results of all these texts; new ones are made together."""
        missing = texts - self.young.keys()
        again = missing & self.old.keys()
        found = {t: self.old[t] for t in again}
        fresh = list(missing - again)
        found.update(zip(fresh, self.make(fresh)))
        # an entry is two objects and a place in a table, besides its letters and result
        self.size += 200 * len(found) + sum(map(len, found)) + sum(map(self.weigh, found.values()))
        self.young.update(found)
        held = self.young
        if self.size > self.most() // 2:
            self.young, self.old, self.size = {}, self.young, 0
        return held
