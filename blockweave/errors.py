"""Errors of encoding, decoding and reading; each carries a status code."""

from __future__ import annotations

# The format's status codes.
OK, INVALID, NO_MEMORY, UNSUPPORTED, DTYPE, LAYOUT, SHAPE, TOO_SMALL, CORRUPT, VERSION, IO = range(11)


class BlockError(ValueError):
    code = INVALID


class UnsupportedError(BlockError):
    """No such model, transform or entropy coder."""

    code = UNSUPPORTED


class DTypeError(BlockError):
    code = DTYPE


class LayoutError(BlockError):
    code = LAYOUT


class ShapeError(BlockError):
    code = SHAPE


class TooSmallError(BlockError):
    code = TOO_SMALL


class CorruptError(BlockError):
    code = CORRUPT


class VersionError(BlockError):
    code = VERSION


class ContainerIOError(BlockError):
    code = IO


def message(code: int) -> str:
    """A short text for a status code."""
    texts = {
        OK: "ok",
        INVALID: "invalid argument",
        NO_MEMORY: "out of memory",
        UNSUPPORTED: "unsupported operator",
        DTYPE: "data type not accepted",
        LAYOUT: "layout not accepted",
        SHAPE: "invalid shape",
        TOO_SMALL: "buffer too small",
        CORRUPT: "corrupt data",
        VERSION: "unknown version",
        IO: "input or output failed",
    }
    return texts.get(code, "unknown status")
