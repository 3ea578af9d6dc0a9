"""A bounded memory of what was looked up lately."""

from __future__ import annotations

from collections.abc import Callable, Iterable


class Recent:
    """Two generations of entries: a full one becomes the old one, of which what is asked for again is kept."""

    def __init__(self, most: int, find: Callable[[list], Iterable[tuple]]):
        self.most, self.find = most, find
        self.held: dict = {}
        self._old: dict = {}

    def know(self, keys: Iterable) -> dict:
        """A dictionary that has all these keys, until the next call."""
        if len(self.held) > self.most:
            self._old, self.held = self.held, {}
        wanted = set(keys).difference(self.held)
        again = self._old.keys() & wanted  # looks at the fewer of both
        self.held.update((key, self._old[key]) for key in again)
        if new := list(wanted - again):
            self.held.update(self.find(new))
        return self.held

    def values(self, keys: list) -> list:
        """What is found for each key, none of it None; keys that are held are looked up once and no more."""
        values = list(map(self.held.get, keys))
        if others := [place for place, value in enumerate(values) if value is None]:
            known = self.know(keys[place] for place in others)
            for place in others:
                values[place] = known[keys[place]]
        return values
