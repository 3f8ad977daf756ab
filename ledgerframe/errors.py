"""Conditions that callers tell apart. Wrappers keep what caused them, so ``is_error`` finds a condition at any depth."""

from __future__ import annotations


class LedgerError(Exception):
    """Base of this library's errors."""


class StoreInitError(LedgerError):
    """A store couldn't be set up."""


class StreamNotFound(LedgerError):
    """The stream was never written, or deleted altogether."""


class StreamVersionMismatch(LedgerError):
    """Another writer came first: the stream isn't at the expected version."""

    def __init__(self, stream_id: str, expected: int, actual: int):
        super().__init__(f"stream {stream_id}: expected version {expected}, found {actual}")
        self.stream_id, self.expected, self.actual = stream_id, expected, actual


class IteratorClosed(LedgerError):
    """An iterator was used after it was closed."""


class EventEncodeError(LedgerError):
    """An event can't be written as JSON."""


class EventDecodeError(LedgerError):
    """A stored event can't be read back."""


class AggregateNotFound(LedgerError):
    """No events, and no snapshot, of the aggregate."""


class NilAggregate(LedgerError, ValueError):
    """An aggregate was needed, and none given."""


class EventsAppended(LedgerError):
    """The events are stored although the operation failed after that."""


class SnapshotNotFound(LedgerError):
    """No snapshot in the bounds."""


class CheckpointNotFound(LedgerError):
    """The projection has no checkpoint."""


class _Operation(LedgerError):
    what = "operation"

    def __init__(self, operation: str, cause: BaseException | None = None):
        super().__init__(f"{self.what}: {operation}" + (f": {cause}" if cause else ""))
        self.operation = operation
        self.__cause__ = cause


class InitializeError(_Operation):
    what = "initialize"


class LoadError(_Operation):
    what = "load"


class HydrateError(_Operation):
    what = "hydrate"


class SaveError(_Operation):
    what = "save"


def is_error(exc: BaseException | None, kind: type[BaseException]) -> bool:
    """Whether the error, or anything that it was raised from, is of the kind."""
    while exc is not None:
        if isinstance(exc, kind):
            return True
        exc = exc.__cause__ or exc.__context__
    return False
