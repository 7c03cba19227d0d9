"""Declared shapes of settings, and one walker that holds values against them.

A shape is a type or a tuple of types, a set of allowed values, a Range, a list of one shape (each item
has it) or a dict of shapes by key. A dict may hold other keys too, unless it has the entry CLOSED; keys
that end in '?' may be missing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from typing import Any

CLOSED = object()


@dataclass(frozen=True)
class Range:
    """A finite number from low to high."""

    low: float = -math.inf
    high: float = math.inf


#: A share of a whole.
SHARE = Range(0, 1)


@dataclass(frozen=True)
class Fault:
    path: str
    what: str
    kind: type[Exception] = ValueError


def faults(value: Any, shape: Any, path: str = "settings") -> Iterator[Fault]:
    """What in value isn't as shape says, in the order of the shape."""
    if isinstance(shape, Range):
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            yield Fault(path, "must be numeric", TypeError)
        elif not (math.isfinite(value) and shape.low <= value <= shape.high):
            yield Fault(path, f"must lie in [{shape.low:g}, {shape.high:g}]")
    elif isinstance(shape, (set, frozenset)):
        if not any(value == x and type(value) is type(x) for x in shape):
            yield Fault(path, f"must be one of {sorted(map(repr, shape))}, not {value!r}")
    elif isinstance(shape, list):
        if isinstance(value, (str, bytes)) or not isinstance(value, (list, tuple)):
            yield Fault(path, "must be a list", TypeError)
        else:
            for i, item in enumerate(value):
                yield from faults(item, shape[0], f"{path}[{i}]")
    elif isinstance(shape, dict):
        if not isinstance(value, Mapping):
            yield Fault(path, "must be an object", TypeError)
            return
        names = {k.removesuffix("?"): v for k, v in shape.items() if k is not CLOSED}
        if lost := [k for k in shape if k is not CLOSED and not k.endswith("?") and k not in value]:
            yield Fault(path, f"lacks {sorted(lost)}")
        if CLOSED in shape and (strange := set(value) - set(names)):
            yield Fault(path, f"has unknown entries {sorted(strange)}")
        for k, v in names.items():
            if k in value:
                yield from faults(value[k], v, f"{path}.{k}")
    elif not isinstance(value, shape) or (isinstance(value, bool) and shape is not bool):
        yield Fault(path, f"is of the wrong type {type(value).__name__}", TypeError)
    elif value == "":
        yield Fault(path, "must not be empty")


def hold(value: Any, shape: Any, path: str = "settings") -> Any:
    """value, if it has the shape; else the first fault is raised as its kind of error."""
    for f in faults(value, shape, path):
        raise f.kind(f"{f.path} {f.what}")
    return value
