"""Id dictionaries that can be remapped to user keys and reversed, loaded only when looked at."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Mapping


class RemappableDictionary(Mapping):
    """id -> number; after `remap`, key -> number for ids that have a key. `original` is as before the last remapping."""

    def __init__(self, source: Mapping | Callable[[], Mapping]):
        if not callable(source) and not isinstance(source, Mapping):
            raise ValueError("a mapping is needed")
        self._source, self._current, self._before = source, None, None

    @property
    def resolved(self) -> bool:
        return self._current is not None or not callable(self._source)

    @property
    def _data(self) -> dict:
        if self._current is None:
            self._current = dict(self._source() if callable(self._source) else self._source)
        return self._current

    @property
    def original(self) -> dict:
        return self._data if self._before is None else self._before

    @property
    def reversed(self) -> dict:
        """number -> key; of keys that share a number the last one."""
        return {v: k for k, v in self._data.items()}

    def remap(self, keys: Mapping) -> None:
        """Keys take the place of the ids that they belong to; other ids stay."""
        if not isinstance(keys, Mapping):
            raise ValueError("a mapping is needed")
        self._before = dict(self._data)
        self._current = {keys.get(k, k): v for k, v in self._data.items()}

    def unmap(self) -> None:
        """Back to before the last remapping."""
        if self._before is not None:
            self._current, self._before = self._before, None

    def __getitem__(self, key):
        return self._data[key]

    def __iter__(self) -> Iterator:
        return iter(self._data)

    def __len__(self) -> int:
        return len(self._data)


class Dictionaries:
    """Named dictionaries as attributes; a name that was never set raises ValueError."""

    def __init__(self):
        self.__dict__["_all"] = {}

    def __setattr__(self, name: str, source) -> None:
        self._all[name] = source if isinstance(source, RemappableDictionary) else RemappableDictionary(source)

    def __getattr__(self, name: str) -> RemappableDictionary:
        if name.startswith("__"):
            raise AttributeError(name)
        if name not in self._all:
            raise ValueError(f"no dictionary {name}")
        return self._all[name]

    def __iter__(self):
        return iter(self._all)

    def __len__(self) -> int:
        return len(self._all)


def deprecated(what: str) -> None:
    warnings.warn(what, DeprecationWarning, stacklevel=3)
