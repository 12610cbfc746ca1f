"""Status codes and the exception that carries them (OP-07)."""

from __future__ import annotations

from enum import IntEnum


class Status(IntEnum):
    """The store's status codes."""

    SUCC = 0
    NOT_FOUND = 1
    CORRUPTION = 2
    NOT_SUPPORTED = 3
    INVALID_ARGUMENT = 4
    IO_ERROR = 5
    INCOMPLETE = 6
    TIMEDOUT = 7
    FULL = 8
    OUT_OF_MEMORY = 9


class StoreError(Exception):
    """An operation on a store failed with a status."""

    def __init__(self, status: Status, message: str = ""):
        super().__init__(f"{status.name}: {message}" if message else status.name)
        self.status = status
