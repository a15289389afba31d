"""What a Python worker remembers of strings it has seen, bounded in bytes.

Entries live in a recent and an old generation. When the recent one is full it
becomes the old one, and what was the old one goes; an entry that is met again
moves to the recent one. So frequent strings stay, and no string is learned twice
in short order because the memory was emptied.
"""

from __future__ import annotations

from collections.abc import Iterable

#: Bytes that an entry takes beside its strings.
ENTRY_BYTES = 220


class Generations:
    """Several values for each string; `recent[k]` is the mapping of the k-th value."""

    def __init__(self, values: int, limit: int = 96 << 20):
        self.limit, self.held = limit, 0
        self.recent: list[dict] = [{} for _ in range(values)]
        self.old: list[dict] = [{} for _ in range(values)]

    def missing(self, wanted: set[str]) -> list[str]:
        """Those of the wanted strings that must be learned; all others are in `recent` until the next call."""
        if self.held > self.limit:
            self.old, self.recent, self.held = self.recent, [{} for _ in self.recent], 0
        new = wanted.difference(self.recent[0])
        again = [w for w in new if w in self.old[0]] if self.old[0] else []
        if again:
            self.add(again, *[list(map(o.__getitem__, again)) for o in self.old])
            new.difference_update(again)
        return list(new)

    def add(self, keys: list[str], *values: Iterable) -> None:
        for recent, v in zip(self.recent, values, strict=True):
            recent.update(zip(keys, v, strict=True))
            self.held += sum(map(len, v))
        self.held += sum(map(len, keys)) + ENTRY_BYTES * len(keys)
