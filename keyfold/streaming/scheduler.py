"""Compaction beside the writer: one thread, one round for each notice."""

from __future__ import annotations

import queue
import threading

from ..sources.store import Store


class CompactionScheduler:
    """Runs due compactions when told of a flush. A round that fails leaves its error in ``errors`` and the store as it was.

    The store has one writer: rounds take ``lock``, and who writes while the scheduler runs takes it as well.
    """

    def __init__(self, store: Store):
        self.store, self.lock = store, threading.RLock()
        self.errors: list[Exception] = []
        self.rounds = 0
        self._notices: queue.Queue = queue.Queue()
        self._thread: threading.Thread | None = None

    def start(self) -> None:
        if self._thread is None:
            self._thread = threading.Thread(target=self._run, daemon=True)
            self._thread.start()

    def notify_flush(self) -> None:
        self._notices.put(True)

    def shutdown(self) -> None:
        """Waits for the rounds that were asked for before, then ends."""
        if self._thread is not None:
            self._notices.put(False)
            self._thread.join()
            self._thread = None

    def _run(self) -> None:
        while self._notices.get():
            try:
                with self.lock:
                    self.store.compact_range()
            except Exception as e:  # noqa: BLE001  the next notice tries again
                self.errors.append(e)
            self.rounds += 1
