"""The settings that queries run with."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from .. import settings

_VALUES: dict[str, Any] = settings.load()


def tuned(operator: Callable) -> Callable:
    """The operator with the settings of this moment."""
    return settings.bound(operator, _VALUES)


@contextmanager
def using(path: str) -> Iterator[dict[str, Any]]:
    """Queries built within take the overrides of a settings file."""
    before = dict(_VALUES)
    _VALUES.update(settings.load(path))
    try:
        yield _VALUES
    finally:
        _VALUES.update(before)
