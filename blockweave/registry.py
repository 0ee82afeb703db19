"""Operators by id: the built-in ones, and plugins that a program adds."""

from __future__ import annotations

from typing import Any

from blockweave.errors import BlockError, UnsupportedError
from blockweave.operators.lz import CODERS
from blockweave.operators.models import MODELS
from blockweave.operators.transforms import TRANSFORMS

# The ids left to plugins, and how many each kind may have.
FIRST, LAST, MOST = 0xFF00, 0xFFFF, 16
_BUILT_IN: dict[str, dict[int, Any]] = {"model": MODELS, "transform": TRANSFORMS, "entropy": CODERS}
_PLUGINS: dict[str, dict[int, Any]] = {k: {} for k in _BUILT_IN}
#: Methods that each kind of operator must have.
_NEEDS = {"model": ("encode", "decode", "residual_dtype", "check"), "transform": ("encode", "decode", "out_dtype", "out_size"), "entropy": ("encode", "decode")}


def register(kind: str, key: int, operator: Any) -> None:
    """Adds a plugin. It is pickled with the tasks that use it, so executors see it."""
    if kind not in _PLUGINS or not FIRST <= key <= LAST:
        raise BlockError(f"plugins are model, transform or entropy with ids {FIRST:#x} to {LAST:#x}")
    if key in _PLUGINS[kind]:
        raise BlockError(f"{kind} {key:#x} is taken")
    if len(_PLUGINS[kind]) >= MOST:
        raise BlockError(f"{MOST} {kind} plugins at most")
    if missing := [m for m in _NEEDS[kind] if not callable(getattr(operator, m, None))]:
        raise BlockError(f"{kind} {key:#x} lacks {', '.join(missing)}")
    _PLUGINS[kind][key] = operator


def clear() -> None:
    """Forgets all plugins."""
    for found in _PLUGINS.values():
        found.clear()


def plugins() -> dict[str, dict[int, Any]]:
    return {k: dict(v) for k, v in _PLUGINS.items()}


def adopt(found: dict[str, dict[int, Any]]) -> None:
    """Takes over the plugins of another process, as tasks do."""
    for kind, entries in found.items():
        _PLUGINS[kind].update(entries)


def find(kind: str, key: int) -> Any:
    operator = _BUILT_IN[kind].get(key) or _PLUGINS[kind].get(key)
    if operator is None:
        raise UnsupportedError(f"{kind} {key:#x} is not registered")
    return operator
