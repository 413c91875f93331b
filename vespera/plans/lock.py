"""One writer for each dataset."""

from __future__ import annotations

import fcntl
import os
import threading

from vespera.sources.files import Files
from vespera.types import EngineError

_held: set[str] = set()
_guard = threading.Lock()


class OwnerLock:
    """A file that one writer holds; within this process also a registry of paths.

    In the driver's file system the operating system locks the file, and frees it when its writer ends in
    any way. Elsewhere the writer creates and removes it; after a crash it stays, and `break_lock` removes
    it once it is certain that its writer is gone.
    """

    def __init__(self, files: Files, path: str):
        self.files, self.path, self.mine = files, path, False
        self.local, self._open = files.local(path), -1

    def acquire(self) -> bool:
        if self.mine:
            return True
        with _guard:
            if self.path in _held or not self._take():
                return False
            _held.add(self.path)
            self.mine = True
            return True

    def _take(self) -> bool:
        if self.local is None:
            return self.files.create(self.path)
        if not os.path.isdir(os.path.dirname(self.local)):
            return False
        found = os.open(self.local, os.O_RDWR | os.O_CREAT)
        try:
            fcntl.flock(found, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError:
            os.close(found)
            return False
        self._open = found
        return True

    def demand(self) -> None:
        if not self.acquire():
            raise EngineError("another writer owns this dataset")

    def release(self) -> None:
        if self.mine:
            with _guard:
                _held.discard(self.path)
            if self.local is None:
                self.files.remove(self.path)
            else:
                os.close(self._open)  # the file stays: its lock is what counts
            self.mine = False

    def break_lock(self) -> None:
        with _guard:
            _held.discard(self.path)
        if self.local is None:
            self.files.remove(self.path)
