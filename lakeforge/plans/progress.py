"""A counter of finished functions, and of the answers that a stage has got so far."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

log = logging.getLogger(__name__)

WIDTH = 30


class Progress:
    def __init__(self, total: int, clock=time.monotonic):
        self.total, self.done, self.answers, self._clock, self._lock = total, 0, 0, clock, threading.Lock()
        self._start = clock()

    def tick(self, n: int = 1) -> None:
        with self._lock:
            self.done += max(n, 0)

    def text(self) -> str:
        """'' without a total; whole percent, filled places of WIDTH, functions a second."""
        if self.total <= 0:
            return ""
        seconds = self._clock() - self._start
        fill = min(self.done * WIDTH // self.total, WIDTH)
        return f"[{'#' * fill}{'.' * (WIDTH - fill)}] {self.done * 100 // self.total}% {self.done}/{self.total} {self.done / seconds if seconds > 0 else 0.0:.2f} fn/s"

    @contextmanager
    def following(self, count: Callable[[], int] | None, every: float = 1.0) -> Iterator[None]:
        """While a stage runs, takes over and logs how many answers there are, whenever that has changed."""
        if count is None:
            yield
            return
        over = threading.Event()

        def follow() -> None:
            while not over.wait(every):
                if (now := count()) != self.answers:
                    self.answers = now
                    log.info("answers so far: %d", now)

        thread = threading.Thread(target=follow, daemon=True)
        thread.start()
        try:
            yield
        finally:
            over.set()
            thread.join()
            self.answers = count()
